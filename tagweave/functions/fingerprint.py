"""64-bit SimHash, Hamming distances and gravity."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.functions.text import tokens

BITS = 64


def _murmur3():
    """The lower 64 bits of MurmurHash3 x64 128 (seed 0) of each string's UTF-8 form, as signed longs.

    The function that this returns goes to workers by its code: they needn't have this package.
    """
    whole = (1 << 64) - 1
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F  # fixed values of the public algorithm

    def turned(x: int, n: int) -> int:
        return (x << n | x >> (64 - n)) & whole

    def spread(x: int) -> int:
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & whole
        return x ^ x >> 33

    def one(s: str) -> int:
        data = s.encode()
        padded = data + bytes(-len(data) % 16)
        a = b = 0
        for at in range(0, len(padded), 16):
            x, y = (int.from_bytes(padded[at + k : at + k + 8], "little") for k in (0, 8))
            x, y = turned(x * c1 & whole, 31) * c2 & whole, turned(y * c2 & whole, 33) * c1 & whole
            if at + 16 > len(data):  # what is left over is mixed in without the steps between
                a, b = a ^ x, b ^ y
            else:
                a = ((turned(a ^ x, 27) + b) * 5 + 0x52DCE729) & whole
                b = ((turned(b ^ y, 31) + a) * 5 + 0x38495AB5) & whole
        a, b = a ^ len(data), b ^ len(data)
        a = (a + b) & whole
        b = (b + a) & whole
        a, b = spread(a), spread(b)
        a = (a + b) & whole
        return a - (1 << 64) if a >> 63 else a

    def hashes(terms: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else one(s) for s in terms], dtype="Int64")

    return hashes


def _md5():
    """The first 8 bytes of the MD5 of each string's UTF-8 form, as signed longs; null is no string here. It goes to workers
    as what `_murmur3` returns does."""
    from hashlib import md5

    def hashes(terms: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join([md5(s.encode()).digest() for s in terms]), ">i8")[::2].astype(np.int64))

    return hashes


def token_hash(term: Column, mode: str = "xxhash64") -> Column:
    """64 bits of a token: 'xxhash64' (native), 'md5' (its first 16 hex digits, which other engines have too), or 'murmur3'
    (the lower half of MurmurHash3 x64 128, by Arrow batches)."""
    if mode == "xxhash64":
        return F.when(term.isNotNull(), F.xxhash64(term))
    if mode == "md5":
        return F.conv(F.substring(F.md5(term.cast("binary")), 1, 16), 16, -10).cast("long")
    if mode == "murmur3":
        return F.pandas_udf(_murmur3(), "long")(term)
    raise ValueError(f"unknown token hash: {mode}")


_LANES = 0x100000001
#: Names of an id's sums: tokens, then the counts of bits b and b + 32 in one number, each below 2^31.
_SUMS = ["n", *(f"b{b}" for b in range(BITS // 2))]


def _fingerprints(sums: DataFrame, id_col: str) -> DataFrame:
    """(id, simhash) of an id's sums: bit b is set where more than half of its hashes have it."""
    value = F.lit(0).cast("long")
    for b in range(BITS):
        lane = F.col(f"b{b % 32}")
        count = F.shiftrightunsigned(lane, 32) if b >= 32 else lane.bitwiseAND(F.lit((1 << 32) - 1))
        value = value.bitwiseOR(F.when(2 * count > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(id_col, value.alias("simhash"))


#: The most that one byte counts, and pieces of so many tokens whose counts are gathered at once.
BYTE, TOGETHER = 255, 256


def _summed(hashes, names: list[str]):
    """Batches of (id, array of tokens) to (id, sums); goes to workers by its code.

    Each distinct token of a batch is hashed once. A hash is 64 counts of one byte each in 8 numbers; these are added up
    for up to BYTE tokens of a row, and then for the row.
    """
    most, together = BYTE, TOGETHER

    def sums(tokens: pa.ListArray) -> list[np.ndarray]:
        told = tokens.flatten().dictionary_encode()
        number = told.indices.fill_null(len(told.dictionary)).to_numpy()
        h = hashes(pd.Series(told.dictionary.to_numpy(zero_copy_only=False), dtype=object)).to_numpy(np.int64).view(np.uint64)
        counts = np.zeros((len(h) + 1, 8), np.uint64)  # the last is a null's
        counts[:-1] = h[:, None] >> np.arange(8, dtype=np.uint64) & np.uint64(0x0101010101010101)
        size = tokens.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        pieces = -(-size // most)
        first = np.cumsum(pieces) - pieces
        at = np.repeat(np.cumsum(size) - size - first * most, pieces) + np.arange(pieces.sum()) * most
        added = [np.zeros((0, 8), np.uint64)]
        for a in range(0, len(at), together):
            here = at[a : a + together]
            end = at[a + together] if a + together < len(at) else len(number)
            added.append(np.add.reduceat(counts[number[here[0] : end]], here - here[0], axis=0))
        by_byte = np.concatenate(added).view(np.uint8).reshape(-1, 8, 8).swapaxes(1, 2).reshape(-1, 64)
        bits, n, some = np.zeros((len(size), 64), np.int64), np.zeros(len(size), np.int64), size > 0
        if some.any():
            bits[some] = np.add.reduceat(by_byte, first[some], axis=0, dtype=np.int64)
            n[some] = np.add.reduceat(number < len(h), (np.cumsum(size) - size)[some], dtype=np.int64)
        return [n, *(bits[:, :32] | bits[:, 32:] << 32).T]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in sums(b.column(1)))], names=names)

    return run


def simhash_tokens(rows: DataFrame, id_col: str, tokens_col: str, mode: str = "xxhash64") -> DataFrame:
    """(id, simhash) of rows with an array of tokens: each counts as often as it occurs; none, or null: 0.

    Tokens are hashed and counted where they are; 33 partial sums for each id and task are all that a shuffle moves. Rows
    that repeat an id are one text, and null tokens don't count. 'xxhash64' is taken of the exploded tokens; the other
    hashes, which cost more than all else, in Python of the distinct tokens of a batch.
    """
    rows = rows.select(F.col(id_col), F.col(tokens_col).alias("terms"))
    if mode in ("md5", "murmur3"):
        made = _summed({"md5": _md5, "murmur3": _murmur3}[mode](), [id_col, *_SUMS])
        schema = StructType([rows.schema[0], *(StructField(c, LongType()) for c in _SUMS)])
        return _fingerprints(rows.mapInArrow(made, schema).groupBy(id_col).agg(*(F.sum(c).alias(c) for c in _SUMS)), id_col)
    hashed = rows.select(id_col, F.explode_outer("terms").alias("term")).select(id_col, token_hash(F.col("term"), mode).alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(_LANES))).alias(f"b{b}") for b in range(BITS // 2)]
    return _fingerprints(hashed.groupBy(id_col).agg(F.count("h").alias("n"), *sums), id_col)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "xxhash64") -> DataFrame:
    """(id, simhash) of every document's tokens; without tokens: 0."""
    return simhash_tokens(docs.select(id_col, tokens(F.col(text_col)).alias("tokens")), id_col, "tokens", mode)


def simhash_of(terms: list[str], spark, mode: str = "xxhash64") -> int:
    """The fingerprint of a few tokens, such as a query's: one row, without a shuffle."""
    if not terms:
        return 0
    hashes = spark.range(1).select(*(token_hash(F.lit(t), mode) for t in terms)).first()
    value = sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


#: Bytes of a text whose windows are in memory at once.
PIECE = 1 << 16


def simhash_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mode: str = "xxhash64") -> DataFrame:
    """(id, simhash) over all 8-byte windows of the UTF-8 form; texts of less than 8 bytes, and null: 0.

    A text goes in pieces, each with the 7 bytes that follow it, so that no row has all windows of a long one.
    """
    digits, cut = F.hex(F.encode(text_col, "UTF-8")), F.lit(f"(.{{1,{2 * PIECE}}})(?=(.{{0,14}}))")
    pieces = F.arrays_zip(F.regexp_extract_all(digits, cut, F.lit(1)).alias("piece"), F.regexp_extract_all(digits, cut, F.lit(2)).alias("next"))
    rows = docs.select(id_col, F.explode_outer(pieces).alias("p"))
    windows = F.regexp_extract_all(F.concat("p.piece", "p.next"), F.lit("(?=(.{16}))(?:..)"), F.lit(1))
    return simhash_tokens(rows.select(id_col, windows.alias("windows")), id_col, "windows", mode)


def hex_form(fingerprint: Column) -> Column:
    """16 hex digits."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def from_hex(digits: Column) -> Column:
    """The number that 16 hex digits stand for; anything else: 0."""
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(digits, 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def weight(a: Column) -> Column:
    return F.bit_count(a)


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(float(BITS))


def damping(hop: Column, gamma: float = 0.85, mode: str = "power") -> Column:
    """gamma^hop ('power'), or gamma^(hop * (hop + 1) / 2) where each hop damps what was damped before ('compound')."""
    if mode == "power":
        return F.pow(F.lit(gamma), hop)
    if mode == "compound":
        return F.pow(F.lit(gamma), hop * (hop + 1) / 2)
    raise ValueError(f"unknown damping: {mode}")


_HOURS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}


def gravity(shared: Column, ts: Column, as_of: Column, distance: Column, damped: Column, decay: float = 0.00001, unit: str = "hour") -> Column:
    """shared * e^(-decay * time between) * (1 - distance / 64) * damped; decay is by `unit` of time."""
    apart = F.abs(F.unix_micros(as_of) - F.unix_micros(ts)) / (1e6 * _HOURS[unit])
    return shared * F.exp(-decay * apart) * (1 - distance / F.lit(float(BITS))) * damped


def hamming_pairs(prints: DataFrame, most: int = 5, blocks: int | None = None, id_col: str = "doc_id", hash_col: str = "simhash") -> DataFrame:
    """Pairs (a, b, distance), a < b, of class representatives whose distinct fingerprints differ in at most `most` bits.

    A representative is the smallest id of a fingerprint (`fingerprint_classes` has the members), so that copies make no
    pairs. 64 bits are cut into `blocks` parts; two fingerprints that differ in `most` bits agree in blocks - most of
    them, so every choice of that many parts is an equi-join key. More blocks make more keys, and each more selective:
    the default grows with the number of fingerprints. Keys of one join carry the choice's number. That join is by a sort:
    Spark takes the keys for as many rows as there are fingerprints, and would send them all through the driver.
    """
    reps = prints.groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("id"))
    if blocks is None:
        blocks = blocks_for(prints.count(), most)
    keyed = hamming_keys(reps, most, blocks)
    a = keyed.select(F.col("id").alias("a"), F.col("h").alias("ha"), "choice", "key")
    b = keyed.select(F.col("id").alias("b"), F.col("h").alias("hb"), "choice", "key")
    met = first_met(a.join(b.hint("merge"), ["choice", "key"]).filter("a < b"), most, blocks)
    return met.select("a", "b", hamming(F.col("ha"), F.col("hb")).cast("long").alias("distance"))


def blocks_for(n: int, most: int) -> int:
    """The blocks that n fingerprints are cut into."""
    blocks = most + 1
    while blocks < most + 4 and n > 1 << (64 * (blocks - most) // blocks + 3):
        blocks += 1
    return blocks


def _parts(h: Column, blocks: int) -> tuple[list[Column], list[int]]:
    """The blocks of a fingerprint, and the bits of each."""
    size = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [F.shiftrightunsigned(h, sum(size[:k])).bitwiseAND((1 << size[k]) - 1) for k in range(blocks)], size


def hamming_keys(rows: DataFrame, most: int, blocks: int) -> DataFrame:
    """rows with a fingerprint h, once for each choice of blocks - most blocks: choice, their set as bits, and key, their value.

    Two fingerprints that differ in at most `most` bits have a key in common.
    """
    part, size = _parts(F.col("h"), blocks)
    choices = list(itertools.combinations(range(blocks), blocks - most))
    assert len(choices) == math.comb(blocks, most)

    def key(c: tuple[int, ...]) -> Column:
        value, at = F.lit(0).cast("long"), 0
        for k in c:
            value, at = value.bitwiseOR(F.shiftleft(part[k], at)), at + size[k]
        return F.struct(F.lit(sum(1 << k for k in c)).alias("choice"), value.alias("key"))

    return rows.select("*", F.explode(F.array(*map(key, choices))).alias("k")).select(*rows.columns, "k.*")


def first_met(pairs: DataFrame, most: int, blocks: int) -> DataFrame:
    """Of (ha, hb, choice, ...) rows those within `most` bits, each pair once.

    A pair meets at every choice of blocks that it agrees in; it counts at the first, which has no such block before its
    last.
    """
    part, _ = _parts(F.col("ha").bitwiseXOR(F.col("hb")), blocks)
    agrees = F.lit(0)
    for k in range(blocks):
        agrees = agrees.bitwiseOR(F.when(part[k] == 0, 1 << k).otherwise(0))
    last = F.expr("shiftleft(2, 31 - length(substring_index(lpad(bin(choice), 32, '0'), '1', 1))) - 1")  # all bits up to the highest
    return pairs.filter((hamming(F.col("ha"), F.col("hb")) <= most) & (agrees.bitwiseAND(last) == F.col("choice")))


#: Queries, and candidates, that meet in one task.
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 14, 1 << 16


def similar_topk(prints: DataFrame, is_query: Column, k: int = 20, id_col: str = "doc_id", hash_col: str = "simhash") -> DataFrame:
    """(query_id, rank, id, similarity): the k rows whose fingerprints are nearest to each query's, ties to the smaller id.

    is_query marks the queries; every row but a query's own is a candidate. Blocks of queries meet blocks of candidates,
    and each pair of blocks returns k rows a query at most.
    """
    spark = prints.sparkSession
    rows = prints.select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).alias("h"), is_query.alias("ask")).filter("id IS NOT NULL")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    r = max(1, math.ceil(asked / QUERY_BLOCK))
    c = max(1, math.ceil(n / CANDIDATE_BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 4096)))
    block = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    left = rows.filter("ask").select("id", "h", block(r, 1).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(c - 1))).alias("c"))
    right = rows.select("id", "h", block(c, 2).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("r"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.int64())])

    def nearest(q: pa.Table, x: pa.Table) -> pa.Table:
        x = x.sort_by("id")
        ids, h = x.column("id").to_numpy(), x.column("h").to_numpy().view(np.uint64)
        q_ids, q_h = q.column("id").to_numpy(), q.column("h").to_numpy().view(np.uint64)
        parts = [(q_ids[:0], ids[:0], ids[:0])]
        for at in range(0, len(q_ids) if len(ids) else 0, 128):
            mine = slice(at, at + 128)
            apart = np.bitwise_count(q_h[mine, None] ^ h[None, :]).astype(np.int64)
            apart[q_ids[mine, None] == ids[None, :]] = 65
            order = apart * len(ids) + np.arange(len(ids))  # by distance and then id, all distinct
            some = np.argpartition(order, min(k, len(ids)) - 1, axis=1)[:, :k]
            d = np.take_along_axis(apart, some, 1)
            own, real = np.repeat(q_ids[mine], some.shape[1]), d.ravel() <= 64
            parts.append((own[real], ids[some.ravel()][real], d.ravel()[real]))
        return pa.table([pa.array(np.concatenate(col)) for col in zip(*parts, strict=True)], schema=schema)

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(nearest, "query_id long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    best = found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", (1 - F.col("distance") / F.lit(float(BITS))).alias("similarity"))


def fingerprint_classes(prints: DataFrame, id_col: str = "doc_id", hash_col: str = "simhash") -> DataFrame:
    """(id, representative, members) of every document: the smallest id and the number with its fingerprint.

    Counts are aggregated first; a fingerprint with very many documents is a skewed join, not one window.
    """
    per = prints.groupBy(hash_col).agg(F.min(id_col).alias("representative"), F.count(F.lit(1)).alias("members"))
    return prints.join(per, hash_col).select(id_col, "representative", "members")
