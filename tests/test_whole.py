"""The engine as one object, the store's commits, sinks, SQL functions and what operators do at their edges."""

import json
import random
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.functions import fingerprint as fp
from tagweave.functions import sql
from tagweave.functions import text as tx
from tagweave.operators import keywords, search, synonyms
from tagweave.plans import scratch, store
from tagweave.plans.prepared import prepared
from tagweave.sources import files
from tagweave.streaming.watch import Watch, windows

THEN = datetime(2024, 1, 1)
FILES = (("rust.md", "Rust is a systems language. #rust #programming #systems\n\nA second paragraph about ownership."), ("programming.md", "Programming computers. #programming #computers"), ("systems.md", "Systems and memory. #systems #memory #performance"))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    rows = files.inline(spark.createDataFrame(FILES, "name string, content string"), F.lit(THEN).cast("timestamp"))
    e.ingest_documents(rows)
    return e


def test_engine_answers(engine):
    assert engine.stats() == {"atoms": 4, "sources": 3, "tags": 10} and engine.health() == {"status": "ok", "empty": False}
    found = engine.search("rust programming", as_of=THEN).collect()
    assert [r.kind for r in found] == ["planet", "planet", "moon"] and found[0].content.startswith("Rust is") and "#rust" in found[0].tags and [r.position for r in found] == [1, 2, 3]
    assert {r.source_path for r in engine.search("what is this about", as_of=THEN).collect()} == set()  # stop words alone: all of them must be there
    assert {r.source_path for r in engine.search("is a", as_of=THEN).filter("kind = 'planet'").collect()} == {"inline:rust.md"}
    nodes, told = engine.illuminate("#rust")
    assert [r.hop_distance for r in nodes.collect()] == [0, 1, 1] and told == {"total": 3, "nodes_explored": 3, "deepest": 1}
    assert engine.seeds("ownership paragraph").count() == 1 and engine.seeds(None).count() == 4
    rows, told = engine.search_with_budget("rust systems", as_of=THEN)
    assert told["tokens_used"] == sum(r.tokens for r in rows.collect()) and told["utilization"] == round(told["tokens_used"] / 8192, 9)
    assert engine.read_file("inline:rust.md", 2, 3) == "A second paragraph about ownership." and [r.id for r in engine.list_compounds("#memory").collect()] == ["src_systems.md"]
    with pytest.raises(KeyError):
        engine.read_file("none")
    said = engine.chat([{"role": "user", "content": "memory"}], THEN)
    assert said["query"] == "memory" and said["planets"] == 1 and len(said["context"]) == 2 and engine.chat([], THEN)["query"] == "general query"


def test_engine_sinks(engine, tmp_path):
    out = engine.distill("#rust", write=True, as_of=THEN)
    with open(out["file"].removeprefix("file://")) as f:
        held = json.load(f)
    assert out["file"].endswith("distill__rust_20240101_000000.json") and held["records"] == out["records"] and held["total_sources"] == 3 and engine.distill(None)["total_atoms"] == 4
    rings = engine.synonyms(f"file://{tmp_path}/s")
    assert json.loads(next((tmp_path / "s/json").glob("*.json")).read_text().splitlines()[0])["synonyms"]
    summary = next((tmp_path / "s/summary").glob("*.txt")).read_text()
    assert summary.startswith("# Synonyms\n\n") and summary.count("| #") == rings.count()
    engine.use_synonyms(rings)
    assert engine.search("performance", as_of=THEN).filter("kind = 'planet'").count() == 2
    engine.ring = None
    files.cleaned_copies(engine.store.contents(), f"file://{tmp_path}/clean")
    files.mirrored(engine.store.contents(), "inline:", f"file://{tmp_path}/mirror")
    assert len(list((tmp_path / "clean").glob("*.md"))) == 3 and {p.name for p in (tmp_path / "mirror").iterdir()} == {"inline:rust.md", "inline:programming.md", "inline:systems.md"}


def test_a_commit_touches_only_its_parts(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s")
    rows = lambda *docs: files.inline(spark.createDataFrame(docs, "name string, content string"), F.lit(THEN).cast("timestamp"))
    assert s.ingest(rows(*((f"f{k}", f"text number{k} #t{k}") for k in range(12))))["sources"] == 12
    before = s._state()[1]
    opened = s.table("atoms")
    s.ingest(rows(("f3", "changed"), ("new", "fresh #x")))
    after = s._state()[1]
    assert sum(before["atoms"].get(p) != f for p, f in after["atoms"].items()) <= 2
    assert opened.count() == 12 and s.table("atoms").count() == 13  # a table that was opened stays as it was
    assert s.index().search(["changed"]).count() == 1 and s.index().search(["number3"]).isEmpty()
    with pytest.raises(Exception, match="exist"):
        s._commit(s._state()[0], after)  # another writer was first
    monkeypatch.setattr(store, "KEPT", 1)
    monkeypatch.setattr(store, "FOLDERS", 2)
    for k in range(4):
        s.ingest(rows(("new", f"again {k}"), ("new", f"again {k}")))
    assert len(s._commits()) == 1 and s.table("sources").count() == 13 and s.table("atoms").count() == 13
    held = {f.split("/")[1] for fs in s._state()[1]["atoms"].values() for f in fs}
    assert {p.name for p in (tmp_path / "s/atoms").iterdir()} == held and max(len(f) for f in s._state()[1]["atoms"].values()) <= 3
    s.rebuild_index()
    assert s.index().search(["again"]).count() == 1


def test_watch_adds_and_removes_paths(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / f"{k}.md").write_text(f"text of {k}")
    s = store.Store(spark, f"file://{tmp_path}/s")
    w = Watch(spark, f"file://{tmp_path}/a", s, f"file://{tmp_path}/ck")
    assert w.add_path(f"file://{tmp_path}/b") and not w.add_path(f"file://{tmp_path}/b") and not w.remove_path("none")
    w.start(once=True)
    for q in w.queries.values():
        q.awaitTermination()
    assert w.state()["processed"] == 2 and w.state()["errors"] == 0 and s.table("sources").count() == 2
    assert w.remove_path(f"file://{tmp_path}/b") and w.state()["paths"] == [f"file://{tmp_path}/a"]
    w.reset()
    assert w.state()["processed"] == 0


def test_windows_of_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = windows(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("streamed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r[0], r[1], r[2]) for r in spark.table("streamed").collect()) == sorted((r[0], r[1], r[2]) for r in windows(events).collect())


def test_walk_of_a_folder_with_rules(spark, tmp_path):
    for name in ("a.md", "b.tmp", "keep.tmp", "docs/c.md", "docs/build/d.md", "node_modules/e.md", "out/f.md", "x/out/g.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / ".gitignore").write_text("# rules\n*.tmp\n!keep.tmp\nbuild/\n/out\n")
    got = {r.content for r in files.walk(spark, f"{tmp_path}").collect()}
    assert got == {"a.md", "keep.tmp", "docs/c.md", "x/out/g.md"}
    assert {r.content for r in files.scan(spark, f"file://{tmp_path}").collect()} == got | {"b.tmp", "docs/build/d.md", "out/f.md"}
    (tmp_path / "docs/deep").mkdir()
    for name in ("docs/deep/h.md", "docs/deep/i.tmp", "docs/deep/j.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "docs/.gitignore").write_text("deep/h.md\n!i.tmp\n")  # nearer than the rule that leaves out all .tmp
    (tmp_path / "docs/deep/.gitignore").write_text("/*.txt\n")
    assert {r.content for r in files.walk(spark, f"{tmp_path}").collect()} == got | {"docs/deep/i.tmp"}
    assert {r.bucket for r in files.walk(spark, f"{tmp_path}").filter("path like '%c.md'").collect()} == {"docs"}


def test_sql_functions(spark):
    assert "tw_simhash" in sql.register(spark)
    row = spark.sql("select tw_tokenize('Hello, wörld 3') a, tw_simhash('a b c') b, tw_hamming(1L, 2L) c, tw_similarity(1L, 2L) d, tw_tag('Ab') e, tw_gravity(2, 0, 32, 0.5) f").first()
    plain = fp.simhash(spark.createDataFrame([(0, "a b c")], "doc_id int, text string")).first()["simhash"]
    assert tuple(row) == (["hello", "wörld", "3"], plain, 2, 0.96875, "#ab", 0.5)
    assert spark.sql(r"select tw_is_transient('error: x\nerror: y\nerror: z\nup to date\nq') t").first().t is True
    assert [tuple(r) for r in spark.sql(r"select * from tw_atomize('a\n\nb c\n\n\nd')").collect()] == [(0, "a"), (1, "b c"), (2, "d")]


def test_token_hashes(spark):
    rows = spark.createDataFrame([("hello",), ("",), ("The quick brown fox jumps over the lazy dog",), (None,)], "t string")
    got = [r[0] for r in rows.select(fp.token_hash(F.col("t"), "murmur3")).collect()]
    assert [None if x is None else x % (1 << 64) for x in got] == [0xCBD8A7B341BD9B02, 0, 0xE34BBC7BBC071B6C, None]  # published values
    docs = spark.createDataFrame([(1, ["hello", "world"]), (2, ["world", "hello"]), (3, []), (4, None), (5, ["hello"])], "id long, t array<string>")
    for mode in ("xxhash64", "md5", "murmur3"):
        prints = dict(fp.simhash_tokens(docs, "id", "t", mode).collect())
        assert prints[1] == prints[2] and prints[3] == prints[4] == 0 and len(prints) == 5
        assert prints[5] == spark.range(1).select(fp.token_hash(F.lit("hello"), mode)).first()[0]


def test_simhash_by_definition(spark):
    r = random.Random(3)
    docs = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(60)))) for k in range(30)]
    words = sorted({w for _, t in docs for w in t.split()})
    hashes = {x.t: x.h for x in spark.createDataFrame([(w,) for w in words], "t string").select("t", F.xxhash64("t").alias("h")).collect()}

    def brute(ts):
        out = sum(1 << b for b in range(64) if 2 * sum(hashes[t] >> b & 1 for t in ts) > len(ts))
        return out - (1 << 64) if out >> 63 else out

    assert dict(fp.simhash(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == {k: brute(t.split()) for k, t in docs}


def test_nearest_fingerprints(spark):
    r = random.Random(7)
    rows = [(k, r.getrandbits(64) - (1 << 63)) for k in range(80)] + [(200 + k, 5) for k in range(6)]
    prints = spark.createDataFrame(rows, "doc_id long, simhash long")
    got = {(x.query_id, x["rank"]): (x.id, x.similarity) for x in fp.similar_topk(prints, F.col("doc_id") % 20 == 0, 7).collect()}
    for q, h in rows:
        if q % 20 == 0:
            want = sorted((((h ^ v) % (1 << 64)).bit_count(), i) for i, v in rows if i != q)[:7]
            assert [got[q, n + 1] for n in range(7)] == [(i, 1 - d / 64) for d, i in want]
    assert fp.similar_topk(prints.limit(0), F.col("doc_id") == 0).isEmpty()


def test_transient_counts_lines(spark):
    lines = ["error: x", "  Error: y", "text", "", "npm WARN a", "100%", "==========", "a segmentation fault here", "an exception came at noon", "fine\r", "error: z\r", "----------\r", "at least"]
    r = random.Random(2)
    rows = [(k, r.choice(("\n", "\r\n")).join(r.choice(lines) for _ in range(r.randrange(12))) + r.choice(("", "\n"))) for k in range(120)]
    frame = spark.createDataFrame(rows, "k int, t string")
    one = "(?iu)(?d)" + "|".join(f"(?:{p})" for family in tx.TRANSIENT.values() for p in family)
    per = frame.select("k", tx.lines(F.col("t")).alias("l"), tx.transient(F.col("t")).alias("x"))
    assert per.filter((F.size("l") != F.col("x.total")) | (F.size(F.filter("l", lambda x: x.rlike(one))) != F.col("x.transient"))).isEmpty()


def test_ranges_and_markup(spark):
    row = spark.createDataFrame([("aé<b> & c",)], "t string").select(tx.byte_range(F.col("t"), 0, 2).alias("a"), tx.byte_range(F.col("t"), 1, 3).alias("b"), tx.wrapped(F.lit(3), F.lit(0.5), F.col("t")).alias("x")).first()
    assert tuple(row) == ("a�", "é", '<atom id="3" relevance="0.5000">aé&lt;b&gt; &amp; c</atom>')
    flags = spark.createDataFrame([("---\na: b\n---\n<p>x",)], "t string").select(tx.cleaning_flags(F.col("t")).alias("f")).first()["f"]
    assert flags.front_matter and flags.html_tags and not flags.code_fences


def test_small_functions(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    assert [r for r in spark.range(1).select(synonyms.jaccard(a(1, 2, 3), a(2, 3, 4)), synonyms.jaccard(a(), a()), synonyms.jaccard(a(1), a())).first()] == [0.5, 1.0, 0.0]
    docs = spark.createDataFrame([(1, "rust rust go the"), (2, "go go"), (3, None)], "doc_id long, text string")
    best = {(r.doc_id, r.term): r.score for r in keywords.tfidf(docs).collect()}
    for term in ("rust", "go"):
        assert {r.doc_id: round(r.score, 9) for r in keywords.term_score(docs, F.col("doc_id") <= 2, term).collect()} == {i: round(best.get((i, term), 0.0), 9) for i in (1, 2)}
    info = spark.createDataFrame([('{"full_name": "o/r", "stargazers_count": 3}',), ("no",)], "j string").select(files.repository_info(F.col("j")).alias("r"), F.col("j"), files.metadata(F.col("j")).cast("string").alias("m")).collect()
    assert info[0].r.full_name == "o/r" and info[0].r.stargazers_count == 3 and info[1].m is None and "o/r" in info[0].m
    assert [r[0] for r in spark.createDataFrame([(512,), (1536,), (3 << 20,)], "n long").select(files.size_text(F.col("n"))).collect()] == ["512 B", "1.5 KB", "3.0 MB"]
    (ring := spark.createDataFrame([('{"#a": ["#b", "#c"]}',)], "value string")).write.mode("overwrite").text(f"{scratch.scratch(spark)}/ring")
    assert ring.count() == 1


def test_rings_are_read(spark, tmp_path):
    (tmp_path / "ring.json").write_text('{"#a": ["#b", "#c"]}')
    assert {tuple(r) for r in keywords.load_ring(spark, f"file://{tmp_path}/ring.json").collect()} == {("#a", "#b"), ("#b", "#a"), ("#a", "#c"), ("#c", "#a")}


def test_results_are_deduplicated_by_each_layer(spark):
    base, tail = "the quick brown fox jumps over the lazy dog and runs far away from all of it " * 8, "x" * 30
    rows = [
        (1, 9.0, "a", 0, 100, base + "one", 0), (2, 8.0, "b", 0, 100, base + "two", -1), (3, 7.0, "c", 0, 100, "brown fox jumps over", 1 << 40), (4, 6.0, "d", 0, 100, "thE quick brown fax jumps over the lazy dog and runs far away from all of it or not" + tail, 1 << 41 | 0xFFFF),
        (5, 5.0, "a", 40, 120, "apart", 0xFF00FF), (6, 4.0, "e", 0, 9, "near print", 7), (7, 3.0, "f", 0, 9, "none of these", 0xFFFFFFFF),
    ]
    frame = spark.createDataFrame(rows, "atom_id long, relevance double, source string, char_start long, char_end long, text string, simhash long")
    assert sorted(r.atom_id for r in search.deduplicated(frame).collect()) == [1, 7]
    assert search.deduplicated(frame, bits=0).filter("atom_id = 6").count() == 1


def test_order_and_paths(spark):
    e = spark.createDataFrame([(1, "#q"), (1, "#x"), (2, "#x"), (2, "#y"), (3, "#y")], "atom_id long, tag string")
    atoms = spark.createDataFrame([(i, 0, f"2024-01-0{4 - i} 00:00:00") for i in (1, 2, 3)], "atom_id long, simhash long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = search.scored(atoms, e, ["#q"], 0, F.lit("2024-01-01").cast("timestamp"), search.SearchConfig(hops=2), with_path=True)
    assert {r.atom_id: r.path for r in rows.collect()} == {1: ["#q"], 2: ["#q", "#x"], 3: ["#q", "#x", "#y"]}
    assert [(r.atom_id, r.position) for r in search.ordered(rows, atoms, "time").orderBy("position").collect()] == [(3, 1), (2, 2), (1, 3)]
    with pytest.raises(ValueError):
        search.ordered(rows, atoms, "none")


def test_settings_keep_what_they_do_not_know(tmp_path):
    text = '{"inbox_path": "./inbox", "watch_paths": ["w"], "ingestion_batch_size": 7, "theme": "dark"}'
    s = files.Settings.load(text)
    assert s.ingestion_batch_size == 7 and s.watched() == ["w", "./inbox"] and json.loads(s.dump())["theme"] == "dark" and s.watcher_stability_threshold_ms == 500
    s.write(f"{tmp_path}/s.json")
    assert files.Settings.read(f"{tmp_path}/s.json") == s and files.Settings.read(f"{tmp_path}/none") == files.Settings()


def test_scratch_tables(spark, tmp_path):
    t = scratch.materialize(spark.range(5))
    assert t.count() == 5
    scratch.discard(t)
    with pytest.raises(Exception, match="(?i)exist|not_found"):
        t.count()
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch(far)


def test_prepared_tables_follow_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, "alpha alpha")], "doc_id long, text string").write.parquet(path)
    first = prepared(spark, path, "md5")
    assert first is prepared(spark, path, "md5") and [r.tag for r in first.build().edges.collect()] == ["#alpha"]
    spark.createDataFrame([(1, "beta beta beta")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    assert [r.tag for r in prepared(spark, path, "md5").edges.collect()] == ["#beta"]
