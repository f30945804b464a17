"""op5: language-model scores from a log-frequency Bloom filter.

Counts are exact where the base score needs them and sketched where pairs of tokens do:

* Documents are dealt into blocks of bounded size. A block's distinct tokens and bigrams go, as sorted hashes (64 bits of
  tokens, 48 of bigrams) in packed arrays, to the bucket that their upper bits name; a bucket adds the counts that its blocks sent and
  answers each block with the counts of the tokens it named, in the same order. So a token crosses the network once a
  block and not once a document, and no worker holds the vocabulary.
* A bigram's count c is quantised to floor(log2(c)) + 1 levels. For each level the filter holds (bigram, level); a
  lookup probes level 1, 2, ... until one is absent, and level j stands for a count of 2^(j-1). Each bucket builds
  its own segment of the filter, sized by its keys, probes it for the bigrams that its blocks named, held-out ones
  too, and answers each block with their levels. So the filter grows with the corpus, every bigram of the training
  texts is in it, and no worker holds more of it than one bucket's segment.

The probability of token w after u is a * max(q(u, w) - D, 0) / c(u) + (1 - a) * p(w), with q from the filter, an
absolute discount D (what occurs once in the corpus tells little of what comes next), the exact count c(u), p(w) =
(c(w) + 1) / (N + V + 1), and a weight a, which is 0 after a token u that no training text has: there all weight is
p's, whose sum over the vocabulary and one unknown token is 1. After other tokens the sum is below 1 by what the discount
and the quantised counts take, and a bigram that the filter doesn't hold costs a text no more than log10(1 - a).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import discard, id_crc, materialize, partitions, release, table

#: Bits of a bigram's hash and of a token's.
BITS, TOKEN_BITS = 48, 64
#: Text in a block and packed entries in a bucket, about.
BLOCK_BYTES, BUCKET_ENTRIES = 6 << 20, 3_000_000
#: The filter: bits for each (bigram, level), and probes for each key.
BITS_PER_KEY, PROBES = 8, 4
#: The weight of the bigrams, of which the single-token model has the rest, and what is taken off their counts.
WEIGHT, DISCOUNT = 0.4, 0.75
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64 well-spread bits of each number."""
    h = h + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _ODD[1]
    h = (h ^ (h >> np.uint64(27))) * _ODD[2]
    return h ^ (h >> np.uint64(31))


class Tokens:
    """The texts of a block as runs of token hashes: words with A-Z lower-cased, and one end for each text."""

    def __init__(self, docs: list[bytes]) -> None:
        number: dict[bytes, int] = {b"": 0}
        runs = []
        for d in docs:
            r = [number.setdefault(w, len(number)) for w in d.lower().split()]
            r.append(0)
            runs.append(np.array(r, np.int32))
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        self.keys, at = np.unique(own, return_inverse=True)  # sorted distinct token hashes
        self.lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        self.run = at.astype(np.int32)[np.concatenate(runs)] if runs else np.zeros(0, np.int32)
        self.doc = np.repeat(np.arange(len(runs), dtype=np.int32), self.lengths)
        self.end = int(at[0])
        # the token before each: the first of a text stands after an end
        self.before = np.roll(self.run, 1)
        first = np.cumsum(np.r_[0, self.lengths])[:-1]
        self.before[first] = self.end

    def bigrams(self) -> np.ndarray:
        """A hash for each token with the one before it."""
        return mixed(self.keys[self.before] * _ODD[2] + self.keys[self.run], 7) >> np.uint64(64 - BITS)


def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences (4, 6 or 8 bytes each) and counts (1, 4 or 8 bytes each), after their size."""
    gap = np.diff(np.r_[np.uint64(0), keys]).astype("<u8")
    widest, most = int(gap.max(initial=0)), int(counts.max(initial=0))
    size = 4 if widest < 1 << 32 else 6 if widest < 1 << 48 else 8
    kind = np.uint8 if most < 256 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([size]) + gap.view(np.uint8).reshape(-1, 8)[:, :size].tobytes(), bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    size = b[0]
    gap = np.zeros(((len(b) - 1) // size, 8), np.uint8)
    gap[:, :size] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, size)
    return np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64)


def unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def bucket_edges(keys: np.ndarray, buckets: int, bits: int = BITS) -> np.ndarray:
    """Where the keys of each bucket begin, and the end: bucket j holds keys from j/buckets of the range on."""
    cuts = np.array([(j << bits) // buckets for j in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(keys, cuts), len(keys)]


def levels(counts: np.ndarray) -> np.ndarray:
    """floor(log2(count)) + 1; 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1]


def places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of (key, level) in a segment of the filter, one array for each probe."""
    a, b = mixed(keys, 2 * level), mixed(keys, 2 * level + 1) | np.uint64(1)
    for k in range(PROBES):
        yield ((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64)


def segment(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The bytes of one bucket's segment, sized by what it holds; q: the levels of the keys, of which those above 0 are held."""
    size = max(8, math.ceil(int(q.sum()) * BITS_PER_KEY / 8))
    bits = np.zeros(8 * size, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at in places(keys[q >= level], level, 8 * size):
            bits[at] = 1
    return np.packbits(bits, bitorder="little")


def probed(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of the keys by a segment: probes level by level while they hit; 0: not even the first."""
    out = np.zeros(len(keys), np.int64)
    live, level = np.arange(len(keys)), 1
    while len(live) and level <= 62:
        hit = np.ones(len(live), bool)
        for at in places(keys[live], level, 8 * len(held)):
            hit &= (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        live = live[hit]
        out[live] = level
        level += 1
    return out


def _texts(t: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    """Ids and texts of a block, in a fixed order, and how often each stands there."""
    texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in t.column("text")]
    return t.column("doc_id").to_pylist(), texts, t.column("times").to_numpy()


def _counted(flat: DataFrame) -> DataFrame:
    """(doc_id, text, times) of (doc_id, text) rows: those that repeat are one, by a partial aggregation where they are.

    Only rows whose id, length and checksum repeat are looked at, so that texts aren't moved for it otherwise.
    """
    key = [F.col("doc_id"), F.octet_length("text").alias("size"), F.crc32("text").alias("crc")]
    again = materialize(flat.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "size", "crc"))
    if again.isEmpty():
        discard(again)
        return flat.withColumn("times", F.lit(1).cast("long"))
    rows, a = flat.withColumns({"size": key[1], "crc": key[2]}).alias("r"), again.alias("a")
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("r.size").eqNullSafe(F.col("a.size")) & F.col("r.crc").eqNullSafe(F.col("a.crc"))
    repeated = rows.join(a, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(a, same, "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times")).unionByName(repeated)


def score(
    docs: DataFrame,
    held_mod: int = 7,
    held_rest: int = 2,
    weight: float = WEIGHT,
    discount: float = DISCOUNT,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scores of every whole text under a model of the texts whose crc32(id) mod held_mod is not held_rest.

    Returns id_col, held_out, n_tokens (words and one end), n_known (tokens that the training texts have), train_tokens,
    base_score (sum of log10((c + 1) / (N + V + 1))), score (of the bigram model) and mean_score (score / n_tokens). A null text counts as empty: one
    token, the end. A null id counts as empty text for held_out. Repeated rows train and are scored each time. Without
    training texts, N and V are 0. Other columns are ignored; an empty table gives no rows. Texts of any length are read
    whole, and a block holds one at least. Tokens are told apart by 64 bits of their hash: among a billion of them two
    share one with a chance of 1 in 37. Every bigram of the training texts is held at every size, with 8 bits for each
    (bigram, level), so that error rates stay the same as well.
    """
    spark = docs.sparkSession
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, size = flat.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes), math.ceil(rows / 100_000), min(partitions(spark), math.ceil((size or 0) / (1 << 20))))
    buckets = max(1, math.ceil((size or 0) / 4 / BUCKET_ENTRIES), min(blocks, 16))
    # ids may hold many rows: the length tells most of them apart, the text the others; equal ones are counted
    block = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.crc32("text")), F.lit(blocks)).cast("int")
    dealt = _counted(flat).withColumn("block", block)

    def train(ids: list) -> np.ndarray:
        return np.array([id_crc(i) % held_mod != held_rest for i in ids], bool)

    def send(t: pa.Table) -> pa.Table:
        ids, texts, times = _texts(t)
        k = Tokens(texts)
        weight = np.where(train(ids), times, 0)[k.doc]
        counts = np.bincount(k.run, weight, len(k.keys)).astype(np.int64)
        pairs, at = np.unique(k.bigrams(), return_inverse=True)  # held-out ones are named with a count of 0, to be answered
        met = np.bincount(at, weight, len(pairs)).astype(np.int64)
        out = []
        for kind, keys, n, bits in ((0, k.keys, counts, TOKEN_BITS), (1, pairs, met, BITS)):
            edge = bucket_edges(keys, buckets, bits)
            out += [(kind, j, t.column("block")[0].as_py(), *pack(keys[a:b], n[a:b])) for j, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
        return pa.table(list(map(list, zip(*out, strict=True))), schema=sent)

    sent = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    counted = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def add(t: pa.Table) -> pa.Table:
        """A bucket's answers to its blocks: sums and totals of tokens; levels of bigrams, from its segment of the filter."""
        kind, bucket = t.column("kind")[0].as_py(), t.column("bucket")[0].as_py()
        from_blocks = t.column("block").to_pylist()
        keys = [unpack_keys(b.as_buffer()) for b in t.column("keys")]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack_counts(b.as_buffer()) for b in t.column("counts")]), len(every)).astype(np.int64)
        if kind:
            total = probed(segment(every, levels(total)), every)
        cut = np.cumsum(np.r_[0, [len(k) for k in keys]])
        out = [(kind, bucket, b, pack(every[:0], total[at[x:y]])[1], 0, 0) for b, x, y in zip(from_blocks, cut, cut[1:], strict=False)]
        if kind == 0:
            out.append((0, bucket, -1, b"", int(total.sum()), int((total > 0).sum())))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=counted)

    to_buckets = dealt.groupBy("block").applyInArrow(send, "kind int, bucket int, block int, keys binary, counts binary")
    sums = materialize(to_buckets.groupBy("kind", "bucket").applyInArrow(add, "kind int, bucket int, block int, counts binary, tokens long, types long"))
    n, v = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("types")).first())

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        ids, texts, times = _texts(left)
        k = Tokens(texts)
        kinds, order = right.column("kind").to_numpy(), np.argsort(right.column("bucket").to_numpy(), kind="stable")
        c, level = (np.concatenate([unpack_counts(right.column("counts")[int(j)].as_buffer()) for j in order if kinds[j] == kind]) for kind in (0, 1))
        logs = np.log10((c + 1) / (n + v + 1))
        own = c[k.run]
        at = np.unique(k.bigrams(), return_inverse=True)[1]
        seen = np.minimum(np.where(level > 0, 2.0 ** (level - 1), 0)[at], np.minimum(own, c[k.before]))  # no pair is more frequent than its tokens
        w = np.where(c[k.before] > 0, weight, 0)
        p = w * np.maximum(seen - discount, 0) / np.maximum(c[k.before], 1) + (1 - w) * (own + 1) / (n + v + 1)
        d = len(ids)
        total = np.bincount(k.doc, np.log10(p), d)
        columns = [
            ids, ~train(ids), k.lengths, np.bincount(k.doc, own > 0, d).astype(np.int64), np.full(d, n),
            np.bincount(k.doc, logs[k.run], d), total, total / k.lengths, times,
        ]
        release()
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    out = pa.schema([(id_col, pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("mean_score", pa.float64()), ("times", pa.int64())])
    ddl = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double, times long"
    answers = sums.filter("block >= 0").select("kind", "block", "bucket", "counts")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, ddl)
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(table(spark, sf_dir, "documents"))
