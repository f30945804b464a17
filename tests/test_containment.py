"""Containment over a corpus against all pairs."""

import random

from tagweave.operators import containment as ct


def plain(docs):
    first, n = {}, {}
    for i, t in sorted(docs):
        first.setdefault(t or "", i)
        n[t or ""] = n.get(t or "", 0) + 1
    out = []
    for i, t in docs:
        t = t or ""
        size = len(t.encode())
        inside = sorted((-len(u.encode()), k) for u, k in first.items() if size >= ct.LEAST and len(u.encode()) > size and t in u)
        out.append((i, first[t], n[t], inside[0][1] if inside else None))
    return sorted(out, key=str)


def test_fingerprints_of_a_part_are_the_whole_s(monkeypatch):
    draw = random.Random(1)
    text = bytes(draw.choices(b"abcdefgh \xc3\xa9", k=3000))
    every = set(ct.fingerprints(text).tolist())
    for _ in range(200):
        a, n = draw.randrange(2900), draw.randrange(0, 90)
        part = ct.fingerprints(text[a : a + n])
        assert set(part.tolist()) <= every and (len(part) > 0) == (len(text[a : a + n]) >= ct.LEAST)
    monkeypatch.setattr(ct, "SEGMENT", 64)
    assert set(ct.fingerprints(text).tolist()) == every


def test_containment_equals_all_pairs(spark):
    draw = random.Random(2)
    passages = [" ".join(draw.choices(["ein", "passage", "texte", "naïve", "über", "x"], k=draw.randrange(4, 30))) for _ in range(12)]
    docs = [(k, draw.choice([" ", "\n", ". "]).join(draw.choices(passages, k=draw.randrange(1, 6)))) for k in range(150)]
    docs += [(200 + k, passages[0]) for k in range(60)] + [(300, None), (301, ""), (302, "short"), (303, passages[3][5:]), (304, "z" * 400), (305, "z" * 401), (306, "é" * 16), (307, "é" * 40), (308, " ".join(passages) * 20)]
    df = spark.createDataFrame([(i, t, 7, "b") for i, t in docs], "doc_id long, text string, id int, digest string")
    got = ct.containment(df)
    assert got.columns == ["doc_id", "class_id", "members", "container"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


def test_containment_of_nothing(spark):
    assert ct.containment(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    assert [tuple(r) for r in ct.containment(spark.createDataFrame([(5, "x")], "doc_id long, text string")).collect()] == [(5, 5, 1, None)]


def test_each_step_deals_its_table_once(spark, tmp_path, monkeypatch):
    """Texts stay in their buckets, and fingerprints that one text alone has go no further than their shuffle."""
    draw = random.Random(4)
    docs = [(k, "".join(draw.choices("abcdefghij ", k=draw.randrange(20, 300)))) for k in range(200)]
    docs += [(300 + k, docs[k][1][5:-5]) for k in range(40)] + [(400 + k, docs[k][1]) for k in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    plans, made = [], ct.materialize

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        plans.append((["rows"], (out := made(df)).count()))
        return out

    monkeypatch.setattr(ct, "materialize", seen)
    monkeypatch.setattr(ct, "BATCH", 100)
    assert sorted(map(tuple, ct.containment(spark.read.parquet(f"{tmp_path}/d")).collect()), key=str) == plain(docs)
    found = {tuple(columns): (plan, rows) for (columns, plan), (_, rows) in zip(plans[::2], plans[1::2], strict=True)}
    every = sum(len(ct.fingerprints(t.encode())) for _, t in docs)
    assert all("print" not in columns or rows < every / 2 for columns, (_, rows) in found.items())
    plan = found["class_id", "container"][0]
    assert "Bucketed: true" in plan and plan.count("Exchange") == 5  # of pairs and their sides, and of what is found
