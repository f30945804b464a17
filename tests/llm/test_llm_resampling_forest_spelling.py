"""op11 to op13 against plain versions, and with nulls, ties, repeats, clashing columns, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagweave.llm.hash_forest import forest_top, level_for, nearest
from tagweave.llm.resampling import features, resample
from tagweave.llm.spelling import spelling_variants, variants, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# importance resampling


def plain_features(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    runs = ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]
    return [zlib.crc32(r.encode()) % 10000 for r in runs], len(ws)


def plain_resample(docs, target, least=20, percent=25):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(plain_features(x)[0])
    for x in target:
        t.update(plain_features(x)[0])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)}
    out, fit = [], []
    for k, (i, x) in enumerate(docs):
        f, n = plain_features(x)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), w, score, None])
        if n >= least:
            fit.append((-score, i is None, i, k))
    for rank, (*_, k) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        out[k][4] = rank
    return out


def made_docs(n, seed):
    draw, vocabulary = random.Random(seed), [f"w{k}" for k in range(60)] + ["Äpfel", "été", "X9", "naïve"]
    return [(k, " ".join(draw.choices(vocabulary, k=draw.randrange(0, 60)))) for k in range(n)]


def rows(df):
    return sorted((list(r) for r in df.collect()), key=str)


def test_features_are_runs_of_words():
    for text in ("", "a", "A b-c_d", "Été—x\x00y 12", " x y"):
        got, n = features(text.encode())
        assert (sorted(got), n) == (sorted(plain_features(text)[0]), plain_features(text)[1])


def test_resample_equals_plain_version(spark):
    docs = made_docs(300, 1)
    docs += [(1000 + k, docs[3][1]) for k in range(150)]  # a text that a third of all rows hold
    docs += [(2000, None), (2001, ""), (2002, "word " * 30000), (None, "null id " * 15)]
    target = [x for _, x in made_docs(20, 2)]
    df = spark.createDataFrame([(i, x, 1.0, "s") for i, x in docs], "doc_id long, text string, score double, digest string")
    got = resample(df, spark.createDataFrame([(x,) for x in target] + [(None,)], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows(got) == sorted(plain_resample(docs, target), key=str)


def test_resample_cold_copies_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr("tagweave.llm.resampling.HOT", 2)  # hardly any text is hot: weights return by the join
    docs = made_docs(200, 3) + made_docs(40, 3)
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"))
    want = plain_resample(docs, ["w1 w2"])
    strip = lambda r: sorted(map(str, (x[:4] for x in r)))
    assert strip(rows(got)) == strip(want)
    assert sorted(r[4] for r in rows(got) if r[4]) == list(range(1, 1 + sum(x[4] is not None for x in want)))


def test_resample_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none.select("text")).count() == 0
    got = resample(spark.createDataFrame([(1, "a " * 40), (2, "b " * 40), (3, "c " * 40), (4, "d " * 40)], "doc_id long, text string"), none.select("text"))
    assert sum(r["rank"] is not None for r in got.collect()) == 1


# nearest neighbours


def exact(q, q_ids, x, x_ids, k):
    out = []
    for a in range(len(q)):
        score = x @ q[a]
        order = [b for b in np.lexsort((x_ids, -np.round(score, 12))) if x_ids[b] != q_ids[a]]
        out.append([x_ids[b] for b in order[:k]])
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "lengths"])
def test_forest_recall(kind):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((4000, 48))
    if kind == "clusters":
        x = draw.standard_normal((40, 48))[draw.integers(0, 40, 4000)] * 3 + x * 0.3
    if kind != "lengths":
        x /= np.sqrt(np.square(x).sum(axis=1))[:, None]
    else:
        x *= draw.gamma(2, 1, 4000)[:, None]
    ids, q = np.arange(4000), np.arange(0, 4000, 20)
    score, row, tested = forest_top(x[q], q, x, ids, 20)
    want = exact(x[q], q, x, ids, 20)
    assert np.mean([len(set(w) & set(ids[r].tolist())) / 20 for w, r in zip(want, row, strict=True)]) >= 0.9
    assert np.allclose(score, np.einsum("ij,ikj->ik", x[q], x[row]))
    assert (np.diff(score, axis=1) <= 0).all() and not (ids[row] == q[:, None]).any()
    if kind == "clusters":
        assert tested < 0.4 * len(q) * len(x)  # dense places stop deep


def test_levels_fall_with_the_cosine():
    level = level_for(np.array([-1, 0, 0.3, 0.6, 0.9, 0.999, 1, 2]), 48, 32, 0.1)
    assert (np.diff(level) >= 0).all() and level[0] == 0 and level[-1] == 32


def test_nearest_through_spark(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((600, 16)).round(3)
    data = [(k, x[k].tolist(), 0.0) for k in range(600)] + [(k, x[k].tolist(), 0.0) for k in range(0, 600, 100)]  # repeated rows count once
    data += [(700, x[0].tolist(), 0.0), (701, None, 0.0), (702, [0.0] * 16, 0.0), (703, [float("nan")] * 16, 0.0), (704, [float("inf")] * 16, 0.0), (705, [None] * 16, 0.0), (None, x[1].tolist(), 0.0), (720, [], 0.0), (740, [1.0, 2.0], 0.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double").withColumn("rank", F.lit(1))
    got = nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    x_all = {**{k: x[k] for k in range(600)}, 700: x[0], 740: np.r_[1.0, 2.0, np.zeros(14)]}
    ids = np.array(list(x_all))
    m = np.array(list(x_all.values()))
    asked = ids[ids % 20 == 0]
    found = {}
    for r in got:
        assert abs(r["score"] - x_all[r["query_id"]] @ x_all[r["vec_id"]]) < 1e-9
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(found) == set(asked.tolist()) and all([k for k, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in found.values())
    want = exact(m[np.isin(ids, asked)], asked, m, ids, 5)
    assert np.mean([len({v for _, v in found[i]} & set(w)) / 5 for i, w in zip(asked.tolist(), want, strict=True)]) >= 0.9


def test_nearest_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, -1.0)]
    assert nearest(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") == 0).count() == 0


# spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def plain_variants(counts, ratio=5):
    found = {}
    for w in counts:
        met = sorted((-counts[v], v) for v in counts if near(w, v))
        good = met and -met[0][0] >= ratio * counts[w]
        found[w] = (len(met), met[0][1] if good else None)
    out = []
    for w, (m, form) in found.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        out.append([w, form, root, counts[w], m, counts[form] if form else None])
    return sorted(out, key=str)


@pytest.mark.parametrize("letters,length", [("ab", 5), ("abc", 7), ("aé", 9)])
def test_variants_equal_all_pairs(spark, letters, length):
    draw = random.Random(length)
    counts = {"".join(draw.choices(letters, k=draw.randrange(1, length))): 0 for _ in range(250)}
    counts |= {"prefix" * 8 + w: 0 for w in list(counts)[:60]}  # long words with one stem
    counts = {w: 5 ** draw.randrange(0, 6) + draw.randrange(3) for w in counts}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == plain_variants(counts)


def test_variants_very_long_words(spark):
    long = "x" * 20000
    counts = {long: 500, long + "y": 5, long[:-1] + "z": 5, "short": 5}
    assert rows(variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain_variants(counts)


def plain_words(doc_id, text):
    out = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = lower(run)
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if h % 199 == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= 6:
            out[run] += 1
    return out


def test_spelling_of_documents(spark, monkeypatch):
    monkeypatch.setattr("tagweave.llm.spelling.HELD", 50)
    draw = random.Random(6)
    base = ["letters", "Letterss", "lettres", "größere", "GRößere", "analysis", "analysys", "×÷×÷×÷", "short", "naïveté"] + ["".join(draw.choices("abcd", k=6)) for _ in range(40)]
    docs = [(k, " ".join(draw.choices(base, weights=[50, 9, 5, 30, 3, 60, 4, 5, 9, 9] + [2] * 40, k=60))) for k in range(120)]
    docs += [(500, None), (501, ""), (None, "letters " * 40), (502, "letters, " * 50000), (3, docs[3][1])]
    counts = Counter()
    for i, x in docs:
        assert words(i, (x or "").encode()) == plain_words(i, x)
        counts.update(plain_words(i, x))
    df = spark.createDataFrame([(i, x, "w") for i, x in docs], "doc_id long, text string, word string")
    assert rows(spelling_variants(df)) == plain_variants({w: n for w, n in counts.items() if n >= 5})
    assert spelling_variants(df.limit(0)).count() == 0


def test_ratio_must_shorten_chains(spark):
    with pytest.raises(ValueError, match="ratio"):
        variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)
