"""op12: approximate nearest neighbours by inner product with a forest of hash prefixes.

Each tree gives every vector a long string of bits, the sides of random hyperplanes that it lies on, and keeps the
strings sorted. A query descends every tree to the longest prefix that it shares with any row, the place where its
own string would stand, and then all trees ascend together: at a level l the rows that share l bits with the query in any
tree are its candidates, a range of each sorted array, and their products are taken.

How far to ascend follows from what was found. A row whose cosine with the query is c or more agrees in a bit with
chance p = 1 - acos(c) / pi at least, so that all trees miss it at level l with chance (1 - p^l)^trees. With c of the
k-th best product so far, a query stops at the level that brings this down to `miss`. Queries in dense places stop deep,
among few rows; where neighbours are hardly nearer than others, as among random directions, candidates are a large share
of all rows, at any size of the table. Products are turned to cosines by one more component, which gives all rows of a
block the length of the longest.

Every row is indexed: rows are dealt into blocks, each with its own forest, and queries meet all blocks, which return
their best k. So memory is bounded by the size of blocks and the forest needs no sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import partitions, table
from tagweave.llm.topk import vectors

TREES, BITS, MISS = 48, 32, 0.1
#: Levels that all trees ascend at once at most.
STRIDE = 3
QUERY_BLOCK = 1 << 12
#: Candidates of a block at most, and at least where there are cores for more blocks.
CANDIDATE_BLOCK, SMALL_BLOCK = 1 << 16, 1 << 13
#: Products that are held at once; pairs that are taken at once, and those of a range below which it is taken so.
PRODUCTS, PAIRS, SMALL = 1 << 22, 1 << 15, 1 << 11


def hyperplanes(dimensions: int, trees: int, bits: int) -> np.ndarray:
    """(trees, bits, dimensions) normals; those of one tree are orthogonal, as far as there are dimensions for it."""
    draw, out = np.random.default_rng(12), np.empty((trees, bits, dimensions))
    for t in range(trees):
        for b in range(0, bits, dimensions):
            n = min(dimensions, bits - b)
            out[t, b : b + n] = np.linalg.qr(draw.standard_normal((dimensions, n)))[0].T
    return out


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The bits of each row as an integer, the first bit highest."""
    out = np.zeros(len(x), np.int64)
    for b in planes:
        out = (out << 1) | (x @ b > 0)
    return out


def level_for(cosine: np.ndarray, trees: int, bits: int, miss: float) -> np.ndarray:
    """The deepest level at which rows of this cosine or more are missed with a chance of `miss` at most."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi
    met = 1 - miss ** (1 / trees)  # the chance that one tree must have
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log(met) / np.log(np.minimum(p, 1 - 1e-12))), 0, bits).astype(np.int64)


class _Best:
    """The k best rows so far of each query: largest product, then smallest id; each row once."""

    def __init__(self, q: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> None:
        self.q, self.x, self.x_ids, self.k = q, x, x_ids, k
        self.score, self.row = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        # single precision for a first look, where it can hold the squares; slack covers its error
        lengths = [np.sqrt(np.square(a).sum(axis=1)) for a in (q, x)]
        kind = np.float32 if max((n.max(initial=0) for n in lengths)) < 1e15 else np.float64
        self.q_low, self.x_low = q.astype(kind), x.astype(kind)
        self.slack = 1.1 * (q.shape[1] + 4) * np.finfo(np.float32).eps * lengths[0] * lengths[1].max(initial=0) + 1e-30
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def offer(self, who: np.ndarray, row: np.ndarray) -> None:
        """Pairs whose product may be among the best."""
        self.waiting.append(who * len(self.x) + row)
        self.held += len(who)
        if self.held > PRODUCTS:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        new = np.unique(np.concatenate(self.waiting))
        self.waiting, self.held = [], 0
        who, row = np.divmod(new, len(self.x))
        score = np.empty(len(who))
        for b in range(0, len(who), 1 << 15):
            score[b : b + (1 << 15)] = np.einsum("ij,ij->i", self.q[who[b : b + (1 << 15)]], self.x[row[b : b + (1 << 15)]])
        have = np.nonzero((self.row >= 0) & np.isin(np.arange(len(self.q)), who)[:, None])
        old = ~np.isin(have[0] * len(self.x) + self.row[have], new)
        have = have[0][old], have[1][old]
        who, score, row = np.r_[have[0], who], np.r_[self.score[have], score], np.r_[self.row[have], row]
        order = np.lexsort((self.x_ids[row], -score, who))
        who, score, row = who[order], score[order], row[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        keep = rank < self.k
        self.score[who[keep], rank[keep]] = score[keep]
        self.row[who[keep], rank[keep]] = row[keep]


def forest_top(
    q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, trees: int = TREES, bits: int = BITS, miss: float = MISS
) -> tuple[np.ndarray, np.ndarray, int]:
    """(score, row of x; -1 where there are fewer) of the k nearest rows found for each row of q, and the number of products taken.

    Rows of x must have ids of their own; a row that has the query's own id is left out.
    """
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, d - a.shape[1]))) for a in (q, x))
    best = _Best(q, x, x_ids, k)
    if not len(q) or not len(x):
        return best.score, best.row, 0
    norm = np.sqrt(np.square(x).sum(axis=1))
    reach = np.sqrt(np.square(q).sum(axis=1)) * norm.max()
    planes = hyperplanes(d + 1, trees, bits)
    level_x = np.c_[x, np.sqrt(np.maximum(0, norm.max() ** 2 - norm**2))]
    level_q = np.c_[q, np.zeros(len(q))]
    order, sorted_, asked = [], [], np.empty((trees, len(q)), np.int64)
    for t in range(trees):
        s = strings(level_x, planes[t])
        order.append(np.argsort(s, kind="stable").astype(np.int32))
        sorted_.append(s[order[t]])
        asked[t] = strings(level_q, planes[t])

    def ranges(level: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows with the queries' prefixes begin and end in each tree."""
        low = asked[:, who] >> (bits - level) << (bits - level)
        high = low + (np.int64(1) << (bits - level))
        begin = np.stack([np.searchsorted(s, v) for s, v in zip(sorted_, low, strict=True)])
        return begin, np.stack([np.searchsorted(s, v) for s, v in zip(sorted_, high, strict=True)])

    # descend: the deepest level whose ranges have more than k rows in all
    level, everyone = np.zeros(len(q), np.int64), np.arange(len(q))
    for step in (32, 16, 8, 4, 2, 1):
        deeper = np.minimum(level + step, bits)
        begin, end = ranges(deeper, everyone)
        level = np.where((end - begin).sum(axis=0) > k, deeper, level)
    seen_begin = np.zeros((trees, len(q)), np.int32)
    seen_end = np.zeros((trees, len(q)), np.int32)
    open_, tested = everyone, 0
    while len(open_):
        begin, end = ranges(level[open_], open_)
        for t in range(trees):
            tested += _products(best, open_, order[t], begin[t], end[t], seen_begin[t, open_], seen_end[t, open_], q_ids)
        best.settle()
        seen_begin[:, open_], seen_end[:, open_] = begin, end
        full = best.row[open_, -1] >= 0
        # products stand to lengths as cosines; a block with fewer than k rows is read whole
        want = np.where(full, level_for(np.where(full, best.score[open_, -1], 0) / np.maximum(reach[open_], 1e-300), trees, bits, miss), 0)
        go = want < level[open_]
        level[open_] = np.maximum(want, level[open_] - STRIDE)
        open_ = open_[go]
    return best.score, best.row, tested


def _products(best: _Best, who: np.ndarray, order: np.ndarray, begin: np.ndarray, end: np.ndarray, seen_begin: np.ndarray, seen_end: np.ndarray, q_ids: np.ndarray) -> int:
    """Takes the products of queries with the rows of one tree's new ranges: those left and right of what they have seen.

    Queries that share a range share one matrix product; small ranges are taken pair by pair, many at once. Products are
    first taken in single precision; pairs that may be among the best, by its error bound, go on.
    """
    fresh = seen_begin == seen_end
    left = np.stack([begin, np.where(fresh, end, seen_begin)])
    right = np.stack([np.where(fresh, end, seen_end), end])
    least = best.score[who, -1] - best.slack[who]
    tested = 0

    def offer(a: np.ndarray, rows: np.ndarray) -> None:
        other = q_ids[a] != best.x_ids[rows]
        best.offer(a[other], rows[other])

    for low, high in (left, right):
        at = np.flatnonzero(high > low)
        if not len(at):
            continue
        key = low[at].astype(np.int64) * (len(order) + 1) + high[at]
        at = at[np.argsort(key, kind="stable")]
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        queries = np.diff(np.r_[first, len(at)])
        small = queries * (high - low)[at[first]] < SMALL
        few = at[np.repeat(small, queries)]
        lengths = (high - low)[few].astype(np.int64)
        tested += int(lengths.sum())
        ends = np.cumsum(lengths)
        cut = np.r_[0, np.searchsorted(ends, np.arange(PAIRS, ends[-1] + 1, PAIRS)), len(few)] if len(few) else np.zeros(1, np.int64)
        for b, e in zip(cut[:-1], cut[1:], strict=True):
            n = lengths[b:e]
            mine = np.repeat(few[b:e], n)
            rows = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[few[b:e]], n)]
            good = np.einsum("ij,ij->i", best.q_low[who[mine]], best.x_low[rows]) >= least[mine]
            offer(who[mine[good]], rows[good])
        for g in np.flatnonzero(~small):
            group = at[first[g] : first[g] + queries[g]]
            rows = order[low[group[0]] : high[group[0]]]
            some, x = max(1, PRODUCTS // len(rows)), best.x_low[rows].T
            for c in range(0, len(group), some):
                mine = group[c : c + some]
                product = best.q_low[who[mine]] @ x
                a, r = np.nonzero(product >= least[mine][:, None])
                offer(who[mine[a]], rows[r])
                tested += product.size
    return tested


def nearest(
    vecs: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, bits: int = BITS, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, by inner product in doubles.

    is_query marks the queries; candidates are all rows but those with the query's own id. Ties go to the smaller id.
    Rows with a null id, a null, empty or zero vector, or a null or non-finite component take no part. Vectors of unlike
    length meet as if the shorter one ended in zeros. A row that stands there several times counts once, as does one of
    several vectors under one id (the smallest). Fewer than k candidates: all. Other columns are ignored, whatever their
    names; an empty table gives no rows. A block holds its rows filled up to the longest of them.
    """
    spark = vecs.sparkSession
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    short = dict(vecs.dtypes)[vector_col] in ("array<float>", "array<tinyint>", "array<smallint>")  # half the bytes on their way
    rows = vecs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if short else "array<double>").alias("v"), is_query.alias("ask"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda e: e != 0))
    sizes = rows.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    r = max(1, math.ceil(sizes[1] / QUERY_BLOCK))
    c = max(math.ceil(sizes[0] / CANDIDATE_BLOCK), min(2 * partitions(spark), math.ceil(sizes[0] / SMALL_BLOCK)), 1)
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    asked = rows.filter("ask").select("id", "v", block(r, 1).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("c"))
    held = rows.select("id", "v", block(c, 2).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def once(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, v = t.column("id").to_numpy(), vectors(t.column("v"))
        by = np.lexsort((*v.T[::-1], ids)) if len(ids) != len(np.unique(ids)) else np.argsort(ids)
        ids, v = ids[by], v[by]
        new = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
        return ids[new], v[new]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        (q_ids, q), (x_ids, x) = once(left), once(right)
        score, row, _ = forest_top(q, q_ids, x, x_ids, k, trees, bits, miss)
        at, place = np.nonzero(row >= 0)
        return pa.table([pa.array(q_ids[at]), pa.array(x_ids[row[at, place]]), pa.array(score[at, place])], schema=out)

    part = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInArrow(pair, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return part.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
