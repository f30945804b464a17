"""Content in chunks of a fixed number of characters, and reads of ranges from the chunks that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk; the last one of a text may have fewer.
SIZE = 1 << 16
CHUNKS = "source_id string, seq long, byte_start long, byte_end long, content string"


def cut(docs: DataFrame, id_col: str = "id", text_col: str = "content", size: int = SIZE) -> DataFrame:
    """(id, seq, byte_start, byte_end, content): chunk seq has the characters from seq * size on.

    A text is cut in one pass where it is, and nothing is shuffled. Null and empty texts have no chunk.
    """
    rows = docs.select(id_col, F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("pieces"))
    ends = F.aggregate("pieces", F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.octet_length(x)))
    rows = rows.select(id_col, F.posexplode_outer(F.arrays_zip("pieces", ends.alias("starts"))).alias("seq", "c")).filter("c.pieces IS NOT NULL")
    return rows.select(id_col, F.col("seq").cast("long").alias("seq"), F.col("c.starts").alias("byte_start"), (F.col("c.starts") + F.octet_length("c.pieces")).alias("byte_end"), F.col("c.pieces").alias("content"))


def _joined(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key, piece: the pieces (key, seq, piece) of each key in order, as one."""
    each = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    empty = F.lit(b"") if dict(pieces.dtypes)["piece"] == "binary" else F.lit("")
    return pieces.groupBy(*key).agg(F.aggregate(each, empty, lambda a, x: F.concat(a, x["piece"])).alias("piece"))


def _spans(wanted: DataFrame, size: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)))


def char_ranges(wanted: DataFrame, chunks: DataFrame, key: list[str], size: int = SIZE, id_col: str = "source_id") -> DataFrame:
    """key, piece: characters [start, end), from 0, of (key, id_col, start, end) rows, read from the chunks they touch.

    key tells the rows apart. Each chunk gives the part that a range has of it before pieces of a range meet. A range
    beyond a text's end stops there; one that has nothing of its text has no row.
    """
    asked = wanted.filter("start < end AND end > 0").withColumn("start", F.greatest("start", F.lit(0))).select(*key, F.col(id_col).alias("of"), "start", "end", _spans(wanted, size).alias("at"))
    held = chunks.select(F.col(id_col).alias("of"), F.col("seq").alias("at"), "content")
    low, high = F.greatest(F.col("start") - F.col("at") * size, F.lit(0)), F.least(F.col("end") - F.col("at") * size, F.lit(size))
    piece = F.col("content").substr((low + 1).cast("int"), (high - low).cast("int"))
    return _joined(asked.join(held, ["of", "at"]).select(*key, F.col("at").alias("seq"), piece.alias("piece")).filter("piece <> ''"), key)


def byte_ranges(wanted: DataFrame, chunks: DataFrame, key: list[str], size: int = SIZE, id_col: str = "source_id") -> DataFrame:
    """The same for bytes [start, end) of the UTF-8 form; piece is binary.

    Ranges and chunks meet in strips of `size` bytes, of which a chunk has five at most, and each pair in the first that
    both have.
    """
    asked = wanted.filter("start < end AND end > 0").withColumn("start", F.greatest("start", F.lit(0))).select(*key, F.col(id_col).alias("of"), "start", "end", _spans(wanted, size).alias("strip"))
    strips = F.explode(F.sequence(F.floor(F.col("byte_start") / size), F.floor((F.col("byte_end") - 1) / size))).alias("strip")
    held = chunks.select(F.col(id_col).alias("of"), "seq", "byte_start", "byte_end", "content", strips)
    first = F.greatest(F.floor(F.col("start") / size), F.floor(F.col("byte_start") / size))
    met = asked.join(held, ["of", "strip"]).filter((F.col("strip") == first) & (F.col("start") < F.col("byte_end")) & (F.col("byte_start") < F.col("end")))
    low, high = F.greatest(F.col("start") - F.col("byte_start"), F.lit(0)), F.least("end", "byte_end") - F.col("byte_start")
    piece = F.encode("content", "UTF-8").substr((low + 1).cast("int"), (high - low).cast("int"))
    return _joined(met.select(*key, "seq", piece.alias("piece")), key)


def whole(chunks: DataFrame, id_col: str = "source_id") -> DataFrame:
    """(id_col, content): whole texts again."""
    return _joined(chunks.select(id_col, "seq", F.col("content").alias("piece")), [id_col]).withColumnRenamed("piece", "content")
