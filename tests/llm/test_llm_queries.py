"""The operators on tables: brute force, and nulls, repeats, empty tables and clashing columns."""

import inspect
import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagweave.llm import neardup
from tagweave.llm.common import table
from tagweave.llm.html_text import extract
from tagweave.llm.lm import score
from tagweave.llm.media import document_media, gathered, resolve, sequences
from tagweave.llm.mixing import mix
from tagweave.llm.neardup import near_duplicates
from tagweave.llm.packing import pack
from tagweave.llm.pii import detect
from tagweave.llm.quality import op10_quality, quality
from tagweave.llm.registry import QUERIES, SQL
from tagweave.llm.token_counts import token_counts
from tagweave.llm.topk import search

#: Extra columns whose names clash with results.
ODD = [
    (1, "a b c d e f g", "s1", 0, "z"), (2, "A b c d e f g", "s1", 0, "z"), (2, "A b c d e f g", "s1", 0, "z"), (3, "", None, 0, "z"), (4, None, "s2", 0, "z"),
    (None, "a b c d e f g", None, 0, "z"), (5, "x@y.org " * 3000, "s2", None, None), (6, "q", "s2", 1, "z"), (7, "q", "é", 1, "z"),
]
SCHEMA = "doc_id long, text string, source string, size long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    table(spark, "/root/testdata/sf0.001", "region")  # sends the package
    return spark.createDataFrame(ODD, SCHEMA)


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def operators(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (2, 0, "x"), (2, 1, "x")], "doc_id long, quality int, score string")
    return {
        "pii": lambda d: detect(d), "neardup": lambda d: near_duplicates(d, 2), "tokens": lambda d: token_counts(d, tokenizer("piece_bpe_32k.model")),
        "pack": lambda d: pack(d, tokenizer("word_bpe_49k.json")), "lm": lambda d: score(d), "media": lambda d: document_media(d), "mix": lambda d: mix(d), "quality": lambda d: quality(d, labels),
    }


@pytest.mark.parametrize("name", ["pii", "neardup", "tokens", "pack", "lm", "media", "mix", "quality"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    got = Counter(r["doc_id"] for r in run(odd).collect())
    if name == "pack":
        assert set(got) == {r[0] for r in ODD}
    else:
        assert got == Counter(r[0] for r in ODD)
    assert run(odd.limit(0)).count() == 0


def test_near_duplicates_odd(spark, odd):
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(odd, 2).collect()}
    assert got == {(1, 1, True, 6), (2, 1, False, 6), (3, 3, True, 0), (4, 4, True, 0), (None, None, False, 6), (5, 5, True, 1), (6, 6, True, 1), (7, 6, False, 1)}


def brute_components(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("sizes", [(neardup.BLOCK, neardup.FAMILY), (8, 6)])
def test_near_duplicates_brute(spark, odd, monkeypatch, sizes):
    """One large group of mutated copies; small blocks take the same paths as large groups do."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", sizes[0])
    monkeypatch.setattr(neardup, "FAMILY", sizes[1])
    r, docs = random.Random(6), []
    for g in range(3):
        base = [f"w{r.randrange(400)}" for _ in range(80)]
        for k in range((40, 6, 1)[g]):
            w = list(base)
            for _ in range(r.randrange(9)):
                w[r.randrange(80)] = f"m{r.randrange(999)}"
            docs.append((100 * g + k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == brute_components(docs, 2, 80)


def test_search_odd(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.25]), (100, [1.0]), (7, None), (8, [nan, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (4, []), (5, [float("inf"), 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = [tuple(r) for r in search(v, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 100, 524288), (0, 2, 2, 393216), (0, 3, 3, 393216), (100, 1, 0, 524288), (100, 2, 2, 524288), (100, 3, 3, 524288)]
    assert search(v.limit(0), F.col("vec_id") == 0).count() == 0


def test_pages_odd(spark, odd):
    p = spark.createDataFrame([(1, "u", "<p>a<img src='sha256:ff' alt='x'>"), (2, None, None), (2, "u", ""), (None, "u", "b")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_lines) for r in extract(p, keep=("url",)).collect()) == [(0, "b", 1), (1, "a x", 1), (2, "", 0), (2, "", 0)]
    clash = p.withColumns({"text": F.lit("t"), "Items": F.lit("i"), "items_": F.lit("j"), "spans": F.lit("s"), "score": F.lit("c")})
    assert extract(clash, keep=("text", "url")).columns == ["page_id", "text_", "url", "text", "n_chars", "n_lines"]
    assert {(r.text, r.text_) for r in extract(clash, keep=("text", "url")).collect()} == {("b", "t"), ("a x", "t"), ("", "t")}
    assert {(r["Items_"], r["items__"]) for r in sequences(clash, keep=("Items", "items_")).collect()} == {("i", "j")}
    assert {r.spans_ for r in detect(clash, False, "page_id", "html", keep=("spans",)).collect()} == {"s"}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.score_) for r in quality(clash.withColumnRenamed("page_id", "doc_id"), labels, text_col="html", keep=("score",)).collect()} == {(0.5, "c")}
    store = spark.createDataFrame([("ff", bytearray(b"12"))], "digest string, media binary")
    items = gathered(resolve(sequences(p), store, ("media",)).filter("page_id = 1")).first()["items"]
    assert [(i.position, i.kind, i.media) for i in items] == [(0, "text", None), (1, "image", bytearray(b"12"))]


def test_mix_comes_near_its_targets(spark, sf):
    m = mix(table(spark, sf, "documents")).toPandas()
    per = m.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), largest=("size", "max"))
    assert abs(per.target.sum() - 1.5 * m["size"].sum()) < 1e-6 * m["size"].sum() and (per.target <= 2 * per["size"] + 1e-6).all()
    assert ((per.taken - per.target).abs() <= per.largest).all() and m.copies.between(0, 2).all()
    free = per[per.target < 2 * per["size"] - 1e-6]
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(per.index))}
    level = [t / weight[s] for s, t in free.target.items()]
    assert max(level) - min(level) < 1e-6 * max(level)
    again = mix(table(spark, sf, "documents").repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert m[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_base_scores_brute(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    words = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), b""] for d in docs}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = score(table(spark, sf, "documents")).collect()
    for r in got:
        ws = words[r.doc_id]
        assert r.n_tokens == len(ws) and r.n_known == sum(w in c for w in ws) and r.train_tokens == n and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_bigrams_of_small_counts_are_held(spark, sf):
    """The filter never undercounts a level, so no score is below that of exact quantised counts, whatever cap the function takes."""
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    words = {d["doc_id"]: [b"", *(d["text"] or "").encode().lower().split(), b""] for d in docs}
    train = [ws for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(w for ws in train for w in ws[1:]), Counter(p for ws in train for p in zip(ws, ws[1:], strict=False))
    n, v = sum(c.values()), len(c)
    cap = {"filter_bytes": 8} if "filter_bytes" in inspect.signature(score).parameters else {}
    got = {r.doc_id: r.score for r in score(table(spark, sf, "documents"), block_bytes=1 << 14, **cap).collect()}
    want = {}
    for i, ws in words.items():
        seen = [(min(2 ** (pairs[u, w].bit_length() - 1) if pairs[u, w] else 0, c[u], c[w]), u, w) for u, w in zip(ws, ws[1:], strict=False)]
        want[i] = sum(math.log10(0.4 * max(q - 0.75, 0) / max(c[u], 1) + 0.6 * (c[w] + 1) / (n + v + 1)) for q, u, w in seen)
    assert all(got[i] >= want[i] - 1e-6 for i in words)
    assert sum(got.values()) - sum(want.values()) < -0.01 * sum(want.values())


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [r for r in op10_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert len(held) > 50 and sum(r.predicted == label[r.doc_id] for r in held) / len(held) > 0.95


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    comp = brute_components([(d, (t or "").translate({c: c + 32 for c in range(65, 91)})) for d, t in docs.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(comp.values()))
    redacted = stages["redact_pii"](spark, docs, sf)
    assert redacted.columns == docs.columns and redacted.filter("text rlike '@mail[0-9]'").isEmpty() and redacted.count() == docs.count()
    times = Counter(r.doc_id for r in stages["mix_sources"](spark, docs, sf).select("doc_id").collect())
    assert times == Counter({r.doc_id: r.copies for r in mix(docs).collect() if r.copies})
    good = stages["quality_filter"](spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    assert set(corpus_pipeline.run(spark, sf).columns) >= {"doc_id", "ids", "sequence_id"}
