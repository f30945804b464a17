"""Texts that lie in other texts of a corpus, as a layer of deduplication: classes and containers, no pairs.

Fingerprints are window minima: of the hashes of a text's GRAM-byte passages the least of each WINDOW in a row. A window
depends on what it covers alone, so a text that lies in another one has no fingerprint that the other lacks. So a text
with a fingerprint of its own lies in none, which spares most texts of a corpus all else; of the others the rarest
fingerprint finds candidates, and whole texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagweave.plans.scratch import bucketed, dealt, discard, materialize, ship, tasks

GRAM, WINDOW = 16, 16
#: Bytes of the shortest text that is looked for: one window.
LEAST = GRAM + WINDOW - 1
#: Bytes that are hashed at once.
SEGMENT = 1 << 22
_U = np.uint64


def fingerprints(text: bytes) -> np.ndarray:
    """The distinct window minima of a text, as signed numbers; none if it has fewer than LEAST bytes."""
    found = [np.zeros(0, np.uint64)]
    for begin in range(0, max(0, len(text) - LEAST + 1), SEGMENT):
        h = np.frombuffer(text[begin : begin + SEGMENT + LEAST - 1], np.uint8).astype(np.uint64) + _U(1)
        factor, n = 0x9E3779B97F4A7C15, 1
        while n < GRAM:  # a hash of 2n bytes from those of n bytes side by side
            h = h[:-n] * _U(factor) + h[n:]
            factor, n = factor * factor % (1 << 64), 2 * n
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        n = 1
        while n < WINDOW:
            h = np.minimum(h[:-n], h[n:])
            n *= 2
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)).view(np.int64)


#: Shares of the texts whose fingerprints one task sorts: more parts would tear a text's rows apart, which then compress badly.
SORTED = 8
#: Fingerprints that go to Spark at once, about.
BATCH = 1 << 16


def _prints(rows: DataFrame) -> DataFrame:
    """(id, sizes, print) of (id, text) rows; sizes has a text's bytes, times 2^32, and the number of its fingerprints."""

    def packed(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        own = [len(found) for _, _, found in held]
        columns = [np.repeat(np.array(c, np.int64), own) for c in ([i for i, _, _ in held], [n << 32 | len(found) for _, n, found in held])]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate([found for _, _, found in held]))], names=["id", "sizes", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(1)[k].as_buffer()
                found = fingerprints(text.to_pybytes())
                if len(found):
                    held.append((b.column(0)[k].as_py(), text.size, found))
                    n += len(found)
                if n >= BATCH:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "id long, sizes long, print long")


def containment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, members, container) of every row.

    Equal texts are a class: class_id is its smallest id, members the number of its rows. container is the class_id of the
    longest text that a text lies in (more bytes than its own; ties to the smaller id), null where there is none or the
    text has fewer than LEAST bytes. A null text counts as empty. Ids must be distinct and not null. Of a class one row
    goes on, so that copies cost nothing but their digests. Of texts, one shuffle makes buckets by id, in which they are
    read again; all fingerprints are dealt once, and after that only those that several texts have. A text has a
    fingerprint once, so that none has more rows than there are texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = materialize(rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest")))
    classes = materialize(told.groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members")))
    first = classes.select(F.col("class_id").alias("id"))
    long = rows.filter(F.octet_length("text") >= LEAST)
    n = min(1 << 14, tasks(long))
    texts = bucketed(long.join(first.repartition(n, "id").hint("merge"), "id", "left_semi"), n, "id")  # dealt as the ids are

    df = F.count(F.lit(1)).over(Window.partitionBy("print"))
    shared = materialize(dealt(_prints(texts), "print", shares=SORTED).withColumn("df", df).filter("df > 1"))
    every = shared.groupBy("id", "sizes").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("df", "print")).alias("rarest"))
    sought = materialize(every.filter("met = sizes & 4294967295").select(F.col("id").alias("inner"), F.shiftright("sizes", 32).alias("size"), F.col("rarest.print").alias("print")))

    pairs = shared.select("id", "print", F.shiftright("sizes", 32).alias("n_bytes")).join(sought.hint("merge"), "print").filter("n_bytes > size").select("inner", "id", "n_bytes")
    inner = texts.select(F.col("id").alias("inner"), F.col("text").alias("sought"))
    met = pairs.join(inner.hint("merge"), "inner").join(texts.hint("merge"), "id").filter(F.col("text").contains(F.col("sought")))
    longest = materialize(met.groupBy("inner").agg(F.min(F.struct((-F.col("n_bytes")).alias("order"), "id")).alias("c")).select(F.col("inner").alias("class_id"), F.col("c.id").alias("container")))
    discard(texts, shared, sought)
    named = told.join(classes.hint("merge"), "digest").join(longest, "class_id", "left")
    return named.select(F.col("id").alias(id_col), "class_id", "members", "container")
