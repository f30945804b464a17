"""What a search reads, built once for a table of documents: tags, fingerprints and postings, each in order of its key."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tagweave.functions import fingerprint as fp
from tagweave.operators.graph import Edges, bucketed
from tagweave.operators.index import Index
from tagweave.operators.keywords import tag_edges
from tagweave.plans.scratch import hadoop_path, materialize, spread


class Prepared:
    """Tables over (doc_id, text) rows, written to the scratch folder when they are first asked for.

    They are sorted by what searches filter on, so that Parquet's statistics leave out what a query's tags and terms
    don't touch.
    """

    def __init__(self, docs: DataFrame, mode: str) -> None:
        self.docs, self.mode = docs, mode

    @cached_property
    def edges(self) -> DataFrame:
        """(atom_id, tag), by tag."""
        return materialize(tag_edges(self.docs).sort("tag", "atom_id"))

    @cached_property
    def sides(self) -> Edges:
        """The edges in buckets by tag and by atom, for walks."""
        return bucketed(self.edges)

    @cached_property
    def prints(self) -> DataFrame:
        """(doc_id, simhash)."""
        return materialize(fp.simhash(spread(self.docs.select("doc_id", "text")), mode=self.mode))

    @cached_property
    def index(self) -> Index:
        """Blocks of postings by term."""
        return Index.of(self.docs)

    def build(self) -> Prepared:
        """Everything at once."""
        assert self.sides and self.prints and self.index
        return self


_prepared: dict[tuple, Prepared] = {}


def prepared(spark: SparkSession, path: str, mode: str) -> Prepared:
    """The tables for the Parquet documents at a path, built by whichever query of the application comes first.

    Files that have changed since are a table of their own.
    """
    there, fs = hadoop_path(spark, path)
    status = fs.getFileStatus(there)
    files = fs.listStatus(there) if status.isDirectory() else [status]
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
    key = (spark.sparkContext.applicationId, path, mode, state)
    if key not in _prepared:
        _prepared[key] = Prepared(spark.read.parquet(path), mode)
    return _prepared[key]
