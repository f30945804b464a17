"""A training corpus from documents in five stages; each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import materialize, ship, table
from tagweave.llm.mixing import mix
from tagweave.llm.neardup import near_duplicates
from tagweave.llm.packing import pack
from tagweave.llm.pii import detect
from tagweave.llm.quality import quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns that a stage doesn't use under names that no operator gives; the columns as they were, of these."""
    name = {c: c if c in used else f"aside{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()), [F.col(n).alias(c) for c, n in name.items()]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of label 1; it learns from labels that aren't held out.

    Null and empty texts are scored like others; repeated rows stay or go together; other columns pass through, whatever
    their names. An empty table gives an empty one.
    """
    ship(spark)
    docs, as_were = _aside(docs, "doc_id", "text")
    scored = quality(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scored.filter("predicted = 1").select(*as_were)


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column without nulls that tells its rows apart: doc_id where it does, else one that is written with them."""
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    row = next(c for c in ("row", "_row", "__row") if c not in docs.columns)
    return materialize(docs.withColumn(row, F.monotonically_increasing_id())), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that with the smallest id; shingles of five words, 80 %.

    Each row is a document of its own, so that exact repeats go too, whether their ids are alike, unlike or null; a null
    id counts as the largest. Rows without words are linked with nothing and stay. Columns of any name pass through; an
    empty table gives an empty one.
    """
    ship(spark)
    rows, row = _identified(docs)
    found = near_duplicates(rows.select(row, "text"), id_col=row, unique=True)
    if row == "doc_id":
        gone = found.filter("NOT kept").select(row)
    else:
        order = rows.select(row, F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("order"))
        named = materialize(found.select(row, F.col("component_id").alias("component")).join(order, row))
        per = named.groupBy("component").agg(F.min("order").getField(row).alias("first"), F.count(F.lit(1)).alias("n"))
        gone = named.join(materialize(per.filter("n > 1")), "component").filter(F.col(row) != F.col("first")).select(row)
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each personal span in its place; n_chars counts the new text.

    A null text stays null, and its n_chars is null. Repeated rows stay; other columns pass through, whatever their
    names. An empty table gives an empty one.
    """
    ship(spark)
    docs, as_were = _aside(docs, "doc_id", "text", "n_chars")
    found = detect(docs.drop("n_chars"), keep=tuple(c for c in docs.columns if c != "n_chars")).withColumnRenamed("redacted", "text")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*as_were)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times.

    Each row is a document of its own, whatever its id. Null and empty texts, of size 0, are taken as often as all of their
    source's documents are at least; a null source is one of its own, the last; other columns pass through, whatever their names. An empty table gives an empty one.
    """
    ship(spark)
    docs, as_were = _aside(docs, "doc_id", "text", "source")
    rows, row = _identified(docs)
    given = mix(rows, id_col=row).filter("copies > 0").select(F.col(row).alias("given"), "copies")
    taken = rows.join(given.hint("merge"), rows[row] == F.col("given"))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*as_were)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of 2048 tokens: one row a piece, with its ids.

    A null or empty text is a document of one token, its end; repeated rows are documents of their own; other columns
    are ignored. An empty table gives no rows.
    """
    import public_tokenizers

    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A trained classifier and a tokenizer are no SQL: tests/llm holds the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage returns; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
