"""op8: exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each segment its mean and its deviation (root of the sum of squares around the mean)
are kept. Inside a segment of length n, the squared distance of q and x is at least
n * (mean_q - mean_x)^2 + (dev_q - dev_x)^2, so that

    |q - x|^2 >= |q|^2 + |x|^2 - 2 * sum(n * mean_q * mean_x + dev_q * dev_x)

and, as q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, that sum bounds the inner product from above. Before segments are cut,
vectors are turned to the principal axes of their block: products stay what they are, and few segments hold most of
them. Bounds are taken first over few long segments and then over more short ones; exact products are computed only for
pairs whose bound reaches the query's k-th best score so far. Rows that lie alike on the first axes share a tile, whose
envelope (least and greatest means, greatest deviation) bounds all of them at once: the nearest tile comes first, and
tiles beyond reach are skipped. In a first tile, the pairs with the best bounds give a query its first k scores.

Queries and candidates are dealt into blocks; each pair of blocks is one group of a cogrouped map and returns the best
k of each of its queries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import partitions, table

#: Lengths of the segments, from coarse to fine.
SEGMENTS = (16, 4, 2)
QUERY_BLOCK = 1 << 14
#: Candidates of a block at most, and at least where there are cores for more blocks.
CANDIDATE_BLOCK, SMALL_BLOCK = 1 << 16, 1 << 13
#: Queries and candidates whose bounds are in memory at once.
TILE = (256, 2048)
#: Longest vectors whose principal axes are taken, and rows that they are taken from.
AXES, AXES_ROWS = 1024, 8192
#: Pairs whose products are taken at once.
PAIRS = 1 << 14


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as doubles, filled with zeros to the longest."""
    a = column.combine_chunks()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    offsets = a.offsets.to_numpy()
    flat = a.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    out = np.zeros((len(a), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def statistics(x: np.ndarray, segment: int) -> np.ndarray:
    """Means (times the root of the length) and deviations of each segment, side by side."""
    pad = -x.shape[1] % segment
    parts = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, segment)
    mean = parts.mean(axis=2)
    dev = np.sqrt(np.square(parts - mean[:, :, None]).sum(axis=2))
    return np.hstack([mean * math.sqrt(segment), dev])


def _exact(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products of rows side by side, as longs; products that exceed a long stop at its ends.

    small: all partial sums are integers that a double holds.
    """
    if small:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    product = (sum(int(a) * int(b) for a, b in zip(u, w, strict=True)) for u, w in zip(q, x, strict=True))
    return np.array([min(max(v, -(2**63)), 2**63 - 1) for v in product], np.int64)


def _turned(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the principal axes of x, the one with the most variance first; as they are where vectors are too long."""
    d = x.shape[1]
    if not 1 < d <= AXES or len(x) < 2:
        return q, x
    some = x[:: max(1, len(x) // AXES_ROWS)]
    axes = np.linalg.eigh(some.T @ some)[1][:, ::-1]
    return q @ axes, x @ axes


def _best(best: np.ndarray, rows: np.ndarray, at: np.ndarray, which: np.ndarray, points: np.ndarray, x_ids: np.ndarray) -> None:
    """Puts scored pairs (query `at`, row `which`) among the best of their queries, ties to the smaller id; in place."""
    have = np.nonzero(rows >= 0)
    who, points, which = np.r_[have[0], at], np.r_[best[have], points], np.r_[rows[have], which]
    sort = np.lexsort((x_ids[which], ~points, who))
    who, points, which = who[sort], points[sort], which[sort]
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    keep = rank < best.shape[1]
    best[who[keep], rank[keep]] = points[keep]
    rows[who[keep], rank[keep]] = which[keep]


def block_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, segments: tuple[int, ...] = SEGMENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """(score, row of x) of the k best rows of x for each row of q, by score and then id; row -1 where there are fewer.

    Rows of x that have a query's own id are left out. The third value is the number of pairs whose product was taken.
    """
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (q, x))
    length_q, length_x = (np.sqrt(np.square(a).sum(axis=1)) for a in (q, x))
    best, rows = np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), -1, np.int64)
    if not len(q) or not len(x):
        return best, rows, 0
    small = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, d) < 2.0**53
    turned_q, turned_x = _turned(q, x)
    order = np.lexsort((-length_x, *(turned_x[:, c] > 0 for c in range(min(d, 6) - 1, -1, -1))))
    levels = [s for s in segments if s <= max(2, d)] if d else []
    qs, xs = [statistics(turned_q, s) for s in levels], [statistics(turned_x, s) for s in levels]
    tiles = [order[b : b + TILE[1]] for b in range(0, len(x), TILE[1])]
    slack = 0.5 + 1e-9 * length_x.max() * length_q  # half a unit and a part of the lengths cover rounding
    tested = 0
    for a in range(0, len(q), TILE[0]):
        mine = slice(a, min(a + TILE[0], len(q)))
        top, found = best[mine], rows[mine]
        reach = np.full((len(tiles), mine.stop - a), np.inf)
        if levels and len(tiles) > 1:
            half = xs[-1].shape[1] // 2
            m, v = qs[-1][mine, :half], qs[-1][mine, half:]
            for t, cols in enumerate(tiles):
                low, high = xs[-1][cols, :half].min(axis=0), xs[-1][cols, :half].max(axis=0)
                reach[t] = np.maximum(m, 0) @ high + np.minimum(m, 0) @ low + v @ xs[-1][cols, half:].max(axis=0) + slack[mine]
        for t in np.argsort(-reach.max(axis=1), kind="stable"):
            least = np.where(found[:, -1] >= 0, top[:, -1].astype(np.float64), -np.inf)
            near, cols = np.flatnonzero(reach[t] >= least), tiles[t]
            bound = np.full((len(near), len(cols)), np.inf)
            for sq, sx in zip(qs, xs, strict=True):  # coarse to fine
                bound = sq[mine][near] @ sx[cols].T + slack[mine][near, None]
                some = (bound >= least[near, None]).any(axis=0)
                cols, bound = cols[some], bound[:, some]
            bound[q_ids[mine][near, None] == x_ids[cols][None, :]] = -np.inf
            open_ = near[~np.isfinite(least[near])] if levels else near[:0]
            if len(open_) and len(cols) > 4 * k:  # the pairs with the best bounds raise the least score first
                some = np.argpartition(-bound[np.isin(near, open_)], 4 * k - 1, axis=1)[:, : 4 * k]
                at, col = np.repeat(open_, 4 * k), cols[some.ravel()]
                real = q_ids[mine][at] != x_ids[col]
                at, col = at[real], col[real]
                tested += len(at)
                _best(top, found, at, col, _exact(q[mine][at], x[col], small), x_ids)
                bound[np.searchsorted(near, np.repeat(open_, 4 * k)), some.ravel()] = -np.inf
                least = np.where(found[:, -1] >= 0, top[:, -1].astype(np.float64), -np.inf)
            at, col = np.nonzero((bound >= least[near, None]) & (bound > -np.inf))
            high = bound[at, col]
            falling = np.argsort(-high)
            for c in range(0, len(at), PAIRS):
                some = falling[c : c + PAIRS]
                some = some[high[some] >= np.where(found[:, -1] >= 0, top[:, -1].astype(np.float64), -np.inf)[near[at[some]]]]
                who, which = near[at[some]], cols[col[some]]
                tested += len(who)
                score = _exact(q[mine][who], x[which], small)
                good = score >= np.where(found[who, -1] >= 0, top[who, -1], np.iinfo(np.int64).min)
                if good.any():
                    _best(top, found, who[good], which[good], score[good], x_ids)
    return best, rows, tested


def search(vecs: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the highest integer inner products for each query row; ties go to the smaller id.

    A component x counts as floor(scale * x). is_query marks the queries; every row is a candidate, but for rows with
    the query's own id. Rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of
    unlike length meet as if the shorter one ended in zeros. A row that stands there several times counts once, as does
    one of several vectors under one id (the smallest). Fewer than k candidates: all. Scores beyond a long stop at its
    ends. Vectors may be of any length; a block holds its rows filled up to the longest of them. Other columns are ignored; an empty table gives no rows. Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vecs.sparkSession
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    short = dict(vecs.dtypes)[vector_col] in ("array<float>", "array<tinyint>", "array<smallint>")  # half the bytes on their way
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if short else "array<double>").alias("v"), is_query.alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    r = max(1, math.ceil(sizes[1] / QUERY_BLOCK))
    c = max(math.ceil(sizes[0] / CANDIDATE_BLOCK), min(2 * partitions(spark), math.ceil(sizes[0] / SMALL_BLOCK)), 1)
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.array(*map(F.lit, range(n)))) if n < 2 else F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.filter("ask").select("id", "v", block(r, 1).alias("r"), every(c).alias("c"))
    held = rows.select("id", "v", block(c, 2).alias("c"), every(r).alias("r"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def once(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, v = t.column("id").to_numpy(), np.floor(scale * vectors(t.column("v")))
        order = np.lexsort((*v.T[::-1], ids)) if len(ids) != len(np.unique(ids)) else np.argsort(ids)
        ids, v = ids[order], v[order]
        new = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
        return ids[new], v[new]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        (q_ids, q), (x_ids, x) = once(left), once(right)
        best, found, _ = block_top(q, q_ids, x, x_ids, k)
        at, rank = np.nonzero(found >= 0)
        return pa.table([pa.array(q_ids[at]), pa.array(x_ids[found[at, rank]]), pa.array(best[at, rank])], schema=out)

    part = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 10
"""
