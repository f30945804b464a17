import tarfile

import pytest
from pyspark.sql import functions as F

from tagweave.operators import graph, keywords, search, synonyms
from tagweave.plans.store import IngestOptions, Store
from tagweave.sources import files
from tagweave.streaming.watch import Watch



def at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def edges(spark, tags):
    return spark.createDataFrame([(i, t) for i, ts in tags.items() for t in ts], "atom_id long, tag string")


def inline(spark, docs):
    return files.inline(spark.createDataFrame(docs, "name string, content string"), at())


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.is_empty()
    docs = [("rust.md", "Rust rust language. #rust\n\nSystems #programming systems"), ("b/c", "memory memory\n\nmemory")]
    s.ingest(inline(spark, docs))
    first = sorted(map(tuple, s.table("atoms").select("atom_id", "seq").collect()))
    assert len(first) == 4 and {r.tag for r in s.table("tags").collect()} >= {"#rust", "#programming", "#memory"}
    s.ingest(inline(spark, docs))  # the same again: nothing doubles
    assert sorted(map(tuple, s.table("atoms").select("atom_id", "seq").collect())) == first
    s.ingest(inline(spark, [("b/c", "changed")]))
    assert s.table("sources").count() == 2 and s.table("atoms").count() == 3
    a = s.table("atoms").first()["atom_id"]
    n = s.table("tags").count()
    s.add_tags(spark.createDataFrame([(a, "#new", None), (a, "#new", None)], "atom_id long, tag string, bucket string"))
    assert s.table("tags").count() == n + 1
    s.delete_atom(a)
    assert s.table("tags").filter(F.col("atom_id") == a).isEmpty()
    s.delete_source("src_b_c")
    assert s.table("sources").count() == 1
    with pytest.raises(KeyError):
        s.delete_source("src_b_c")
    assert s.stats().first()["sources"] == 1
    s.wipe()
    assert s.is_empty()


def test_ingest_options(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/o")
    s.ingest(inline(spark, [("a", "x\n\ny")]), IngestOptions(extract_tags=False))
    assert s.table("tags").isEmpty() and s.table("atoms").count() == 2


def test_walk_and_illuminate(spark):
    e = edges(spark, {1: ["#rust", "#programming", "#systems"], 2: ["#programming", "#computers"], 3: ["#systems", "#memory"], 4: ["#memory"], 5: ["#other"]})
    seeds = spark.createDataFrame([(1,)], "atom_id long")
    assert dict(graph.walk(seeds, e, 1).collect()) == {1: 0, 2: 1, 3: 1}
    assert dict(graph.walk(seeds, e, 5).collect()) == {1: 0, 2: 1, 3: 1, 4: 2}
    got = graph.illuminate(seeds, e, 2, 3).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0), (2, 1, 0.85), (3, 1, 0.85)]
    assert graph.walk(seeds.limit(0), e, 2).isEmpty()


def test_distill_keeps_the_nearest_copy(spark):
    e = edges(spark, {1: ["#a"], 2: ["#a", "#b"], 3: ["#b"]})
    atoms = spark.createDataFrame([(1, "s", 0, "one two", "k"), (2, "s", 9, "three", "z"), (3, "t", 0, "one two", "k")], "atom_id long, source string, char_start long, content string, dedup_key string")
    out = graph.distill(spark.createDataFrame([(1,)], "atom_id long"), e, atoms)
    assert [tuple(r) for r in out["records"].collect()] == [("s", "one two\nthree\n", 2, 1)]
    assert out["summary"].first()["compression_ratio"] == 0.6


def test_search(spark):
    e = edges(spark, {1: ["#q", "#x"], 2: ["#x"], 3: ["#y"]})
    atoms = spark.createDataFrame([(i, 0) for i in (1, 2, 3)], "atom_id long, simhash long").withColumn("ts", at())
    c = search.SearchConfig()
    rows = search.scored(atoms, e, ["#q"], 0, at(), c)
    assert {(r.atom_id, r.kind, r.relevance) for r in rows.collect()} == {(1, "planet", 1.0), (2, "moon", 0.85)}
    only = lambda m: [r.atom_id for r in search.within_results(rows, search.SearchConfig(mode=m)).collect()]
    assert only("planets_only") == [1] and only("moons_only") == [2] and sorted(only("combined")) == [1, 2]
    ring = keywords.ring(spark.createDataFrame([("#q", "#y")], "term string, synonym string"))
    assert {r.atom_id for r in search.scored(atoms, e, ["#q"], 0, at(), c, ring).filter("hop = 0").collect()} == {1, 3}
    with pytest.raises(ValueError):
        search.SearchConfig(mode="none").validated()
    assert search.SearchConfig(total_tokens=20000).effective().hops == 3 and search.SearchConfig.deep().hops == 3


def test_synonyms(spark):
    e = edges(spark, {1: ["#a", "#b"], 2: ["#a", "#b"], 3: ["#a", "#c"]})
    assert [tuple(r) for r in synonyms.by_cooccurrence(e).collect()] == [("#a", "#b", 2.0)]
    assert {(r.a, r.b): r.weight for r in synonyms.by_neighbourhood(e, 0.3).collect()} == {("#a", "#b"): round(2 / 3, 9), ("#a", "#c"): round(1 / 3, 9)}
    merged = synonyms.merged({"one": synonyms.by_cooccurrence(e), "two": synonyms.by_neighbourhood(e, 0.3)})
    assert {r.tag: r.synonyms for r in merged.collect()} == {"#a": ["#b", "#c"], "#b": ["#a"], "#c": ["#a"]}


def test_archive(spark, tmp_path):
    (tmp_path / "top").mkdir()
    (tmp_path / "top/a.md").write_text("hello")
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        t.add(tmp_path / "top", "top")
    assert [tuple(r) for r in files.archive(spark, f"file://{tmp_path}/x.tar.gz").collect()] == [("a.md", "hello")]


def test_watch(spark, tmp_path):
    inbox, s = tmp_path / "inbox", Store(spark, f"file://{tmp_path}/s")
    (inbox / "sub").mkdir(parents=True)
    (inbox / "sub/a.md").write_text("alpha alpha\n\nbeta")
    (inbox / "b.log").write_text("ignored")
    w = Watch(spark, f"file://{inbox}", s, f"file://{tmp_path}/ck")
    w.start(once=True).awaitTermination()
    assert s.table("sources").count() == 1 and s.table("atoms").count() == 2
    (inbox / "c.md").write_text("gamma")
    w.start(once=True).awaitTermination()
    assert s.table("sources").count() == 2 and not w.state()["running"]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "star_search" in e.queries()


def test_hops_deal_no_edges(spark):
    e = edges(spark, {k: [f"#t{k % 7}", f"#u{k % 11}"] for k in range(200)})
    both = graph.bucketed(e)
    seeds = spark.createDataFrame([(3,), (9,)], "atom_id long")
    assert sorted(map(tuple, graph.walk(seeds, both, 2).collect())) == sorted(map(tuple, graph.walk(seeds, e, 2).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = graph.neighbours(seeds, both)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "Scan parquet" in line and "tagweave_" in line:  # up from the edges to their join there is no exchange
            d = depth(line)
            for above in reversed(plan[:k]):
                if depth(above) < d:
                    assert "Exchange" not in above
                    d = depth(above)
                    if "Join" in above:
                        break
    assert sum("tagweave_" in line and "Scan parquet" in line for line in plan) == 2
