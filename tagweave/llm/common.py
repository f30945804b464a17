"""What the operators of this subpackage share: tables, shared scratch tables, words."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.plans.scratch import discard, materialize, ship

__all__ = ["WORD_PATTERN", "crc_mod", "discard", "id_crc", "map_rows", "materialize", "own_names", "partitions", "release", "ship", "slices", "table", "texts"]

#: What separates words: the ASCII white space bytes 0x20 and 0x09 to 0x0D, as bytes.split() has them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the package goes to the executors as well."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_names(keep: Iterable[str], results: Iterable[str]) -> list[str]:
    """Names of kept columns in a result: one that is called like the result's own columns gets underscores at its end."""
    taken, out = {r.lower() for r in results}, []
    for c in keep:
        while c.lower() in taken:
            c += "_"
        taken.add(c.lower())
        out.append(c)
    return out


def id_crc(doc_id: int | None) -> int:
    """crc32 of an id as text; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def crc_mod(doc_id: Column, n: int) -> Column:
    """The same as a column: crc32(id as text) mod n."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % n


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text of an Arrow column as UTF-8; null: empty."""
    for x in column:
        yield b"" if not x.is_valid else x.as_buffer().to_pybytes()


def slices(batches: Iterable[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column holds about `most` bytes in each: one row at least, rows are never cut."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for k, n in enumerate(lengths):
            if k > begin and held + n > most:
                yield b.slice(begin, k - begin)
                begin, held = k, 0
            held += int(n)
        yield b.slice(begin)


def release() -> None:
    """Gives the memory that this process holds and doesn't use back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, most: int = 4 << 20) -> DataFrame:
    """mapInArrow; f gets batches whose second column, the text, is of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(slices(batches, 1, most))
        release()

    return df.mapInArrow(run, schema)
