"""The inverted index: blocks, skipping, boolean queries, content in chunks; and how a store keeps them."""

import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.operators import chunks as ch
from tagweave.operators import index as ix
from tagweave.operators.match import And, Near, Not, Or, Phrase, parsed
from tagweave.plans.store import Store
from tagweave.sources import files

THEN = datetime(2024, 1, 1)


def made(n, seed=1):
    draw = random.Random(seed)
    vocabulary = ["the", "and", "of", "in", "that", "tion", "tions", "tic", "Über", "naïve", "x2", "de", *(f"w{k}" for k in range(30))]
    docs = [(k, " ".join(draw.choices(vocabulary, weights=[9, 7, 6, 5, 5, 3, 2, 2, 2, 2, 2, 4, *[1] * 30], k=draw.randrange(0, 80)))) for k in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "_ -"), (n + 3, "the, the; The_the! " * 3000)]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain(docs, counts, holds, scored, k=None):
    """BM25 of units by counting them in every text: counts(words) gives a list."""
    every = {i: words(t) for i, t in docs if words(t)}
    mean = sum(map(len, every.values())) / len(every)
    n = {i: counts(w) for i, w in every.items()}
    df = [sum(c[u] > 0 for c in n.values()) for u in range(len(next(iter(n.values()))))]
    idf = [math.log(1 + (len(every) - d + 0.5) / (d + 0.5)) for d in df]
    score = lambda i: sum(idf[u] * n[i][u] * 2.2 / (n[i][u] + 1.2 * (0.25 + 0.75 * len(every[i]) / mean)) for u in scored)
    out = sorted(((-round(score(i), 9), i) for i in every if holds(n[i])))[:k]
    return [(i, -s) for s, i in out]


def listed(df):
    return [(r.atom_id, r.score) for r in df.collect()]


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 2e-9 for a, b in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def docs():
    return made(400)


@pytest.fixture(scope="module")
def index(spark, docs):
    return ix.Index.of(spark.createDataFrame(docs, "doc_id long, text string"))


def test_postings_of_blocks(spark, docs, index):
    want = sorted((w, i, [k for k, x in enumerate(ws) if x == w], len(ws)) for i, t in docs for ws in [words(t)] for w in set(ws))
    got = sorted((r.term, r.atom_id, r.positions, r.dl) for r in ix.unblocked(index.blocks).collect())
    assert got == want and index.docs == sum(bool(words(t)) for _, t in docs) and index.tokens == sum(len(words(t)) for _, t in docs)
    bad = index.blocks.filter((F.col("df") > ix.BLOCK) | (F.col("df") != F.size("entries")) | (F.col("df") != F.size("positions")))
    assert bad.isEmpty()


@pytest.mark.parametrize("terms,any_term", [(["the"], False), (["the", "of", "in"], False), (["the", "w3"], True), (["w3", "none"], True), (["w3", "none"], False), (["über", "naïve"], False), ([], False)])
@pytest.mark.parametrize("k", [3, 20, None])
def test_search_equals_counting(docs, index, terms, any_term, k):
    holds = any if any_term else all
    want = plain(docs, lambda ws: [ws.count(t) for t in terms], lambda n: bool(terms) and holds(n), range(len(terms)), k) if terms else []
    got = listed(index.search(terms, k, any_term))
    same(got if k else sorted(got, key=lambda r: (-r[1], r[0])), want)


def test_search_skips_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    index = ix.Index.of(spark.createDataFrame(docs, "doc_id long, text string"))
    read = lambda terms, k: {t: index.blocks.filter((F.col("term") == t) & (index._bound() >= low)).agg(F.sum("df")).first()[0] for t, low in index.cuts(terms, k)[0].items()}
    n = index.cuts(["the", "w3"], None)[1]
    assert read(["the"], 5)["the"] < n["the"] / 4
    assert sum(read(["w3", "w4"], 2).values()) < sum(index.cuts(["w3", "w4"], None)[1].values())
    for terms in (["the"], ["w3", "w4"], ["the", "of"]):
        same(listed(index.search(terms, 5)), plain(docs, lambda ws: [ws.count(t) for t in terms], all, range(len(terms)), 5))
    older = ix.Index(index.blocks, index.docs, index.tokens // 3)  # texts have become shorter, or longer, since the blocks were made
    newer = ix.Index(index.blocks, index.docs, index.tokens * 3)
    for other in (older, newer):
        every = sorted(listed(other.search(["the", "of"], None)), key=lambda r: (-r[1], r[0]))
        assert listed(other.search(["the", "of"], 5)) == every[:5]


def test_queries_are_read():
    a, b, c = (Phrase((x,)) for x in "abc")
    assert parsed("a b OR c") == Or((And((a, b)), c)) and parsed("a AND b NOT c") == And((a, Not(b, c))) and parsed("(a OR b) c") == And((Or((a, b)), c))
    assert parsed('"A  b" c*') == And((Phrase(("a", "b")), Phrase(("c",), True))) and parsed("a + b*") == Phrase(("a", "b"), True) and parsed("^a-b") == Phrase(("a", "b"), initial=True)
    assert parsed("NEAR(a b)") == Near((a, b)) and parsed('NEAR("a b" c, 3)') == Near((Phrase(("a", "b")), c), 3) and parsed("near") == Phrase(("near",))
    for bad in ("", "(a", "a)", "AND a", "a OR", '"a', "NOT a", '"!"', "NEAR(a, 2", "a NOT"):
        with pytest.raises(ValueError):
            parsed(bad)


def phrase(ws, *tokens):
    return sum(ws[k : k + len(tokens)] == list(tokens) for k in range(len(ws)))


def close(ws, tests, distance):
    """Places that close a NEAR group of one-word phrases, by trying all earlier places."""
    out = 0
    for k in range(len(ws)):
        mine = [j for j, t in enumerate(tests) if t(ws[k])]
        for j in mine[:1]:
            last = [max((x for x in range(k + 1) if t(ws[x])), default=-1) if i != j else k for i, t in enumerate(tests)]
            out += min(last) >= 0 and k - (min(last) + 1) <= distance
    return out


CASES = [
    ('"the and"', lambda w: [phrase(w, "the", "and")], any, [0]),
    ('"the the the"', lambda w: [phrase(w, "the", "the", "the")], any, [0]),
    ("ti* NOT tic", lambda w: [sum(x.startswith("ti") for x in w), w.count("tic")], lambda n: n[0] and not n[1], [0]),
    ('"of ti" *', lambda w: [sum(a == "of" and b.startswith("ti") for a, b in zip(w, w[1:], strict=False))], any, [0]),
    ("^the OR ^and", lambda w: [int(w[0] == "the"), int(w[0] == "and")], any, [0, 1]),
    ("NEAR(in that, 3)", lambda w: [close(w, [lambda x: x == "in", lambda x: x == "that"], 3)], any, [0]),
    ("NEAR(in that w1*, 6)", lambda w: [close(w, [lambda x: x == "in", lambda x: x == "that", lambda x: x.startswith("w1")], 6)], any, [0]),
    ('("the and" OR "of the") (x2 OR über) NOT "de de"', lambda w: [phrase(w, "the", "and"), phrase(w, "of", "the"), w.count("x2"), w.count("über"), phrase(w, "de", "de")], lambda n: (n[0] or n[1]) and (n[2] or n[3]) and not n[4], [0, 1, 2, 3]),
    ("none* OR w5", lambda w: [0, w.count("w5")], any, [0, 1]),
    ("none", lambda w: [0], any, [0]),
]


@pytest.mark.parametrize("query,counts,holds,scored", CASES, ids=[c[0] for c in CASES])
def test_match_equals_counting(docs, index, query, counts, holds, scored):
    same(listed(index.match(query, 30)), plain(docs, counts, holds, scored, 30))


def test_an_empty_index(spark, tmp_path):
    empty = ix.Index.of(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert empty.search(["a"]).isEmpty() and empty.match("a OR b*").isEmpty() and empty.docs == 0
    again = empty.written(f"{tmp_path}/i")
    assert again.search(["a"]).isEmpty() and (again.docs, again.tokens) == (0, 0)


# content


def test_chunks_and_ranges(spark):
    draw = random.Random(2)
    texts = {f"t{k}": "".join(draw.choices("aé漢😀\n ", k=draw.choice([1, 7, 8, 9, 40, 500]))) for k in range(30)} | {"none": None, "empty": ""}
    docs = spark.createDataFrame(list(texts.items()), "id string, content string")
    chunks = ch.cut(docs, size=8).withColumnRenamed("id", "source_id")
    assert {r.source_id: r.content for r in ch.whole(chunks).collect()} == {k: v for k, v in texts.items() if v}
    asked = [(n, i, draw.randrange(-5, 60), draw.randrange(-5, 600)) for n, i in enumerate(list(texts) * 5)] + [(999, "absent", 0, 5)]
    wanted = spark.createDataFrame(asked, "n long, source_id string, start long, end long")
    cut = lambda x, s, e: x[max(s, 0) : max(e, 0)] if x else x
    chars = {n: cut(texts.get(i), s, e) for n, i, s, e in asked}
    assert {r.n: r.piece for r in ch.char_ranges(wanted, chunks, ["n"], 8).collect()} == {n: x for n, x in chars.items() if x}
    held = {n: cut((texts.get(i) or "").encode(), s, e) for n, i, s, e in asked}
    assert {r.n: bytes(r.piece) for r in ch.byte_ranges(wanted, chunks, ["n"], 8).collect()} == {n: x for n, x in held.items() if x}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    rows = [(f"s{k}", f"alpha beta number{k}.\n\ngamma delta alpha {'é' * k}") for k in range(12)]
    e.ingest_documents(files.inline(spark.createDataFrame(rows, "name string, content string"), F.lit(THEN).cast("timestamp")))
    return e


def test_store_keeps_positions_through_changes(spark, engine):
    s = engine.store
    text = {"src_s" + str(k): f"alpha beta number{k}.\n\ngamma delta alpha {'é' * k}" for k in range(12)}
    check = lambda q: sorted(r.content for r in engine.match(q).collect())
    assert len(check('"alpha beta"')) == 12 and len(check("NEAR(gamma alpha, 1) NOT éé*")) == 2 and check("number7") == ["alpha beta number7."]
    engine.ingest("s7", "beta alpha number7\n\nnew words", as_of=THEN)
    assert len(check('"alpha beta"')) == 11 and check('"beta alpha"') == ["beta alpha number7"]
    s.delete_source("src_s3")
    assert len(check('"alpha beta"')) == 10
    s.rebuild_index()
    assert len(check('"alpha beta"')) == 10 and s.index().docs == s.table("atoms").count() == 22
    own = s.index()
    assert own.tokens == sum(r.dl for r in ix.unblocked(own.blocks).filter(F.get("positions", 0) == 0).collect())
    assert {r.id: r.content for r in s.contents().collect()}["src_s5"] == text["src_s5"]


def test_only_the_chunks_of_results_are_read(engine):
    ids = ["src_s5"]
    part, every = engine.store.chunks(ids), engine.store.chunks()
    assert part.count() == 1 and len(part.inputFiles()) < len(every.inputFiles()) and every.count() > 1
    assert engine.read_range("inline:s5", 6, 10) == "beta" and engine.read_range("src_s5", 0, 1 << 40, "byte").decode().startswith("alpha beta number5") and engine.read_range("src_s5", 900, 905) == ""
    with pytest.raises(KeyError):
        engine.read_range("none", 0, 1)


def test_wipe_is_a_commit(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.ingest(files.inline(spark.createDataFrame([("a", "some text")], "name string, content string"), F.lit(THEN).cast("timestamp")))
    opened = s.table("atoms")
    s.wipe()
    assert s.is_empty() and s.index().search(["some"]).isEmpty() and s.table("chunks").isEmpty() and opened.count() == 1  # who reads it goes on
    s.ingest(files.inline(spark.createDataFrame([("b", "other text")], "name string, content string"), F.lit(THEN).cast("timestamp")))
    assert s.table("sources").count() == 1
