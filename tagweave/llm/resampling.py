"""op11: importance resampling towards a target distribution, with identical texts collapsed.

Features are hashed runs of words. Texts that are equal have equal features, so that documents are first grouped by their
full text: features are read once per distinct text, and its counts enter the corpus's bucket totals times its number of
copies. The weight of a text is the floored mean of its buckets' gains, how much more often the target has them. Weights
return to the documents by a digest of the text, and only then is each document's own noise added, so that copies are
drawn independently of each other. The best scores are drawn.

What is bounded and therefore goes through the driver or to all executors: bucket totals (`buckets` rows); weights of
texts that hold more than a `HOT`th of all rows, of which there are fewer than HOT; counts of rows by score, whose
range the logarithms of counts bound, whatever the input.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import discard, map_rows, materialize, table, texts

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: A text that more than one in HOT rows hold has its weight sent to all tasks: there are fewer than HOT of them.
HOT = 1000

#: Lower-cases A-Z and puts a blank for what no word has: words are runs of 0-9, a-z and bytes from 0x80 on.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """(bucket of each run of 1 to `longest` consecutive words, repeats counted; number of words)."""
    words = text.translate(_WORDS).split()
    sums = list(map(zlib.crc32, words))
    found = [c % buckets for c in sums]
    for n in range(1, longest):  # runs of n + 1 words go on where those of n ended
        sums = [zlib.crc32(b" " + w, c) for c, w in zip(sums, words[n:], strict=False)]
        found += [c % buckets for c in sums]
    return found, len(words)


def totals(df: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Number of features in each bucket over (times, text) rows, a text counted `times` times."""
    seen = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for times, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                found = np.array(features(text, longest, buckets)[0], np.int64)
                sums += times * np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], schema=seen)

    return _gathered(map_rows(df, run, "bucket int, n long"), buckets)


def _gathered(rows: DataFrame, buckets: int) -> np.ndarray:
    """(bucket, n) rows, summed; as many come here as there are buckets."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each bucket; B: the number of buckets."""
    whole, aim, b = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = ((t + 1) * (whole + b) / ((s + 1) * (aim + b)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _distinct(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(digest, times, found, n_features, n_words), a row per distinct text; found: its features' buckets, two bytes each."""
    rows = docs.groupBy("text").agg(F.count(F.lit(1)).alias("times")).select("times", "text")
    schema = pa.schema([("digest", pa.binary()), ("times", pa.int64()), ("found", pa.binary()), ("n_features", pa.int64()), ("n_words", pa.int64())])
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, longest, buckets) for t in texts(b.column(1))]
            found = pa.array([np.array(f, kind).tobytes() for f, _ in got], pa.binary())
            sizes = [pa.array([len(f) for f, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), found, *sizes], schema=schema)

    return map_rows(rows.select("times", "text", _digest().alias("digest")), run, "digest binary, times long, found binary, n_features long, n_words long")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """id_col, n_features, weight, score, rank of every row of docs; rank is null where a row isn't drawn.

    Words are runs of 0-9, A-Z (lower-cased), a-z and all beyond ASCII; features are their runs of up to `longest`, each
    in the bucket crc32 modulo `buckets`. weight is the floored mean gain of a text's features (none: 0); score adds
    Gumbel noise, floor(-1000 ln(-ln(u))), u from the first 8 hex digits of sha256("seed:id"). Of the N rows of at least
    `least_words` words floor(percent * N / 100) are drawn: the highest scores, ties to the smaller id, null ids last.

    A null or empty text has no features, weight 0, and is never drawn unless least_words is 0. Rows that repeat an id
    are rows of their own with equal noise, in any order among themselves. An empty target gives every bucket t = 0; an
    empty docs gives no rows. Other columns are ignored, whatever their names. Texts are read whole, of any length.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    aim = totals(target.select(F.lit(1).cast("long").alias("times"), F.coalesce(F.col(target_col), F.lit("")).alias("text")), buckets, longest)

    distinct = materialize(_distinct(docs, longest, buckets))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            for times, found in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                sums += times * np.bincount(np.frombuffer(found, kind), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["bucket", "n"])

    corpus = _gathered(map_rows(distinct.select("times", "found"), summed, "bucket int, n long"), buckets)
    gain = gains(corpus, aim)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = (np.frombuffer(x, kind) for x in texts(b.column(1)))
            mean = [int(gain[i].sum()) // len(i) if len(i) else 0 for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, pa.int64()), *b.columns[2:]], names=["digest", "weight", "times", "n_features", "n_words"])

    kept = "digest binary, weight long, times long, n_features long, n_words long"
    weights = materialize(map_rows(distinct.select("digest", "found", "times", "n_features", "n_words"), weighed, kept))
    rows = weights.agg(F.sum("times")).first()[0] or 0
    hot = weights.filter(F.col("times") * HOT > rows)

    # documents of texts with very many copies find their weight where they are, all others by a join on the digest
    told = docs.select("id", _digest().alias("digest"))
    near = told.join(F.broadcast(hot.select("digest", "weight", "n_features", "n_words")), "digest", "left")
    near = materialize(near)
    rest = near.filter("weight IS NULL").select("id", "digest").join(weights.filter(F.col("times") * HOT <= rows).drop("times").hint("merge"), "digest")
    every = near.filter("weight IS NOT NULL").unionByName(rest)
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))
    scored = materialize(every.select("id", "n_features", "n_words", "weight", score.alias("score")))
    discard(distinct, weights, near)
    return _drawn(spark, scored, least_words, percent).withColumnRenamed("id", id_col)


def _drawn(spark: SparkSession, scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored with rank: the number of better scores comes from their counts, the place among equal ones from a window.

    Noise spreads even copies of one text over thousands of scores, of which none is taken by more than one row in 2700
    on average.
    """
    fit = F.col("n_words") >= least_words
    by_score = Counter(dict(scored.filter(fit).groupBy("score").agg(F.count(F.lit(1))).collect()))
    take, before, better = percent * sum(by_score.values()) // 100, 0, []
    for s in sorted(by_score, reverse=True):
        if before >= take:
            break
        better.append((s, before))
        before += by_score[s]
    cut = better[-1][0] if better else None
    out = [F.col("id"), F.col("n_features"), F.col("weight"), F.col("score")]
    no_rank = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return scored.select(*out, no_rank)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last())).cast("long")
    ahead = spark.createDataFrame(better, "score long, ahead long")
    high = scored.filter(fit & (F.col("score") >= cut)).withColumn("place", place).join(F.broadcast(ahead), "score")
    rank = F.col("ahead") + F.col("place")
    high = high.select(*out, F.when(rank <= take, rank).alias("rank"))
    return high.unionByName(scored.filter(~fit | (F.col("score") < cut)).select(*out, no_rank))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn to be like the benchmark's texts; all documents with rank or null."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 of an UTF-8 text in a column w, byte by byte over a table that is made from the polynomial.
CRC_TABLE = """
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) FOR k IN range(8)]),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text expression; crc (CRC_TABLE) must be joined."""
    h = f"hex(encode({text}))"
    return (
        f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length({h}) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr({h}, CAST(2 * i + 1 AS BIGINT), 2) AS INT) AS BIGINT))), "
        "lambda a, b: xor(crc.t[CAST(xor(a, b) & 255 AS INT) + 1], a >> 8)))"
    )


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH {CRC_TABLE.strip()},
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT {_WORDS_SQL} AS ws FROM benchmark),
df AS (SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
v AS (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN v USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN v USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df) AS S, (SELECT count(*) FROM bf) AS T),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.t, 0) + 1) * (n.S + 10000) AS DOUBLE) / CAST((s.s + 1) * (n.T + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT k, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM df JOIN v USING (f) JOIN g USING (bucket) GROUP BY k),
r AS (SELECT d.k, d.doc_id, CAST(greatest(0, 2 * len(ws) - 1) AS BIGINT) AS n_features, len(ws) >= 20 AS fit, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w ON d.k = w.k),
p AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY fit) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM p
"""
