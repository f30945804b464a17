"""Inverted index in blocks with positions, BM25 search that skips blocks, and boolean queries over positions.

A block has postings of one term that weigh about the same: ids, counts and lengths, positions in a column of their own,
and the largest weight, by the mean length of texts when it was made. A term's postings stand in order of their weight,
so that a search for the best reads the heavy blocks first and skips those that can't reach the k-th best score, whatever
the other terms add. Positions are read by queries with phrases, prefixes or distances alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import TOKEN, tokens
from tagweave.operators.match import Match, parsed
from tagweave.plans.scratch import discard, materialize, spread, tasks

K1, B = 1.2, 0.75
#: Postings of a block at most, and steps of weight by which a search counts blocks.
BLOCK, LEVELS = 128, 64
#: Postings of each term that are read for a first k-th best score, for each of the k.
AHEAD = 4

#: Tokens of texts that a task of postings sorts at once.
TOKENS = 1 << 18

BLOCKS = "term string, df long, most double, mean double, entries array<struct<atom_id:bigint,n:bigint,dl:bigint>>, positions array<array<int>>"


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """A query's distinct tokens, by the same functions as texts'."""
    return spark.range(1).select(F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TOKEN), F.lit(0)))).first()[0]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, atom_id, n, dl, positions): each token of each text with its positions, from 0, and the text's number of tokens.

    Texts are read where they are and nothing is shuffled: the JVM cuts tokens, and the tokens of a batch of texts are
    sorted as numbers, stably, so that positions stay in order. Of a batch, about TOKENS are sorted at once.
    """
    schema = pa.schema([("term", pa.string()), ("atom_id", pa.int64()), ("n", pa.int64()), ("dl", pa.int64()), ("positions", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, begin = np.cumsum(b.column(1).value_lengths().fill_null(0).to_numpy()), 0
            while begin < b.num_rows:
                held = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, held + TOKENS, "right")))
                yield b.slice(begin, end - begin)
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            flat = b.column(1).flatten()
            lengths = b.column(1).value_lengths().fill_null(0).to_numpy()
            row = np.repeat(np.arange(b.num_rows), lengths)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            coded = flat.dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])][: len(row)])
            n = np.diff(np.r_[first, len(row)])
            ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            positions = pa.ListArray.from_arrays(ends, pa.array(at[order].astype(np.int32)))
            arrays = [coded.dictionary.take(pa.array(code[first])), b.column(0).take(pa.array(row[first])), pa.array(n.astype(np.int64)), pa.array(lengths[row[first]].astype(np.int64)), positions]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    rows = spread(docs.select(F.col(id_col).cast("long").alias("atom_id"), text_col)).select("atom_id", tokens(F.col(text_col)).alias("t"))
    return rows.mapInArrow(run, "term string, atom_id long, n long, dl long, positions array<int>")


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """(by, docs, tokens) of postings: each text counts at its first token."""
    first = rows.filter(F.get("positions", 0) == 0)
    return first.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens"))


def weight(n: Column, dl: Column, mean: float) -> Column:
    """What BM25 makes of a count in a text of so many tokens, below K1 + 1."""
    return n * (K1 + 1) / (n + K1 * (1 - B + B * dl / mean))


def weighed(rows: DataFrame, mean: float) -> DataFrame:
    """postings with their weight at a mean length, and that."""
    return rows.withColumn("weight", weight(F.col("n"), F.col("dl"), mean)).withColumn("mean", F.lit(mean))


#: The order that blocks are made in: columns, and whether they rise.
ORDER = {"term": True, "weight": False, "atom_id": True}


def packed(rows: DataFrame, *more: str) -> DataFrame:
    """BLOCKS rows, and `more`, of weighed postings that are in ORDER inside of each partition: runs of up to BLOCK rows of one term.

    Runs also end with a batch or a partition, so that no term, however frequent, is one group.
    """
    names = ["term", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for k in range(len(names)):
                code = b.column(k).dictionary_encode().indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            start = np.flatnonzero(new)
            since = np.arange(b.num_rows) - np.repeat(start, np.diff(np.r_[start, b.num_rows]))
            first = np.flatnonzero(since % BLOCK == 0)
            ends, at = pa.array(np.r_[first, b.num_rows].astype(np.int32)), pa.array(first)
            most, mean, ids, n, dl, positions = (b.column(len(names) + k) for k in range(6))
            entries = pa.StructArray.from_arrays([ids, n, dl], names=["atom_id", "n", "dl"])
            lists = [pa.ListArray.from_arrays(ends, entries), pa.ListArray.from_arrays(ends, positions)]
            arrays = [b.column(0).take(at), pa.array(np.diff(np.r_[first, b.num_rows])), most.take(at), mean.take(at), *lists, *(b.column(k).take(at) for k in range(1, len(names)))]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "df", "most", "mean", "entries", "positions", *more])

    kept = dict(rows.dtypes)
    schema = BLOCKS + "".join(f", {c} {kept[c]}" for c in more)
    return rows.select(*names, "weight", "mean", "atom_id", "n", "dl", "positions").mapInArrow(run, schema)


def unblocked(blocks: DataFrame) -> DataFrame:
    """The postings of BLOCKS rows, with the blocks' further columns."""
    rest = [c for c in blocks.columns if c not in ("term", "df", "most", "mean", "entries", "positions")]
    e = blocks.select("term", *rest, F.inline(F.arrays_zip("entries", "positions")))
    return e.select("term", "entries.atom_id", "entries.n", "entries.dl", "positions", *rest)


@dataclass
class Index:
    """BLOCKS rows, in ORDER of their postings; the numbers of texts with tokens and of their tokens."""

    blocks: DataFrame
    docs: int
    tokens: int
    known: dict[str, list[tuple[float, float, int]]] = field(default_factory=dict)  # what _levels() has read

    @classmethod
    def of(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
        """The index of (id, text) rows, in the scratch folder."""
        rows = materialize(postings(docs, id_col, text_col))
        n, held = totals(rows).first()
        by = [F.col(c).asc() if rises else F.col(c).desc() for c, rises in ORDER.items()]
        blocks = materialize(packed(weighed(rows, held / n if n else 1.0).repartitionByRange(tasks(rows), *by).sortWithinPartitions(*by)))
        discard(rows)
        return cls(blocks, n, held)

    def written(self, path: str) -> Index:
        """The index below a path, in place of what is there."""
        spark = self.blocks.sparkSession
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        spark.createDataFrame([(self.docs, self.tokens)], "docs long, tokens long").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        """The index that was written below a path."""
        return cls(spark.read.parquet(f"{path}/blocks"), *spark.read.parquet(f"{path}/totals").first())

    # ranked search

    def _mean(self) -> float:
        return self.tokens / self.docs if self.docs else 1.0

    def _idf(self, df: int) -> float:
        return math.log(1 + (self.docs - df + 0.5) / (df + 0.5))

    def _bound(self) -> Column:
        """What no posting of a block weighs more than now: if the mean length has grown by r since, r times as much at most."""
        return F.col("most") * F.greatest(F.lit(1.0), F.lit(self._mean()) / F.col("mean"))

    def _levels(self, terms: list[str]) -> dict[str, list[tuple[float, float, int]]]:
        """For each term that is anywhere (largest bound, least bound, postings) of its blocks by steps of their bounds, heaviest first.

        Only the heads of the blocks are read, once for each term; about LEVELS rows a term come here.
        """
        terms, asked = [t for t in terms if t not in self.known], terms
        step = F.floor(self._bound() * (LEVELS / (K1 + 1))).alias("step")
        heads = self.blocks.filter(F.col("term").isin(terms)).groupBy("term", step)
        found: dict[str, list] = {t: [] for t in terms}
        for r in heads.agg(F.sum("df").alias("df"), F.min(self._bound()).alias("low"), F.max(self._bound()).alias("high")).collect() if terms else ():
            found[r.term].append((r.high, r.low, r.df))
        self.known |= {t: sorted(ls, reverse=True) for t, ls in found.items()}
        return {t: self.known[t] for t in asked if self.known[t]}

    def _scored(self, cuts: dict[str, float], idf: dict[str, float], least: int) -> DataFrame:
        """(atom_id, score) of atoms with at least so many terms, from the blocks of each term with its bound or more."""
        keep = reduce(lambda x, y: x | y, ((F.col("term") == t) & (self._bound() >= low) for t, low in cuts.items()))
        weights = F.create_map(*(F.lit(x) for kv in idf.items() for x in kv))
        rows = self.blocks.filter(keep).select(F.try_element_at(weights, F.col("term")).alias("idf"), F.inline("entries"))
        part = F.col("idf") * weight(F.col("n"), F.col("dl"), self._mean())
        found = rows.groupBy("atom_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched")).filter(F.col("matched") >= least)
        return found.select("atom_id", F.round("score", 9).alias("score"))

    def cuts(self, terms: list[str], k: int | None, any_term: bool = False) -> tuple[dict[str, float], dict[str, int]]:
        """The least bound of the blocks that a search for the k best reads of each term; the number of atoms of each.

        The heaviest postings, AHEAD * k of each term, give k atoms and their scores, or else more are read for it. An atom
        with a posting in a block whose bound and the other terms' largest bounds don't reach the k-th of these scores is
        none of the k best.
        """
        levels = self._levels(terms)
        every, df = dict.fromkeys(levels, 0.0), {t: sum(n for *_, n in ls) for t, ls in levels.items()}
        if k is None or not levels or not any_term and len(levels) < len(terms):
            return every, df
        idf, ahead = {t: self._idf(n) for t, n in df.items()}, AHEAD * k
        while True:
            first = {}
            for t, ls in levels.items():
                held = 0
                for _, low, n in ls:
                    first[t], held = low, held + n
                    if held >= ahead:
                        break
            if all(first[t] <= ls[-1][1] for t, ls in levels.items()):
                return every, df
            top = self._scored(first, idf, 1 if any_term else len(terms)).orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
            if top[0] == k:
                break
            ahead *= 8
        most = {t: idf[t] * ls[0][0] for t, ls in levels.items()}
        spare = top[1] - 2e-9 - sum(most.values())  # scores are rounded to 9 digits
        return {t: max(0.0, (spare + most[t]) / idf[t] - 1e-9) for t in levels}, df

    def search(self, terms: list[str], k: int | None = 100, any_term: bool = False) -> DataFrame:
        """(atom_id, score): the k best atoms that have all terms (or any), by BM25, ties to the smaller id.

        An empty index or no terms: no rows.
        """
        cuts, df = self.cuts(terms, k, any_term) if terms else ({}, {})
        if not df or not any_term and len(df) < len(terms):
            return self.blocks.select(F.lit(0).cast("long").alias("atom_id"), F.lit(0.0).alias("score")).limit(0)
        found = self._scored(cuts, {t: self._idf(n) for t, n in df.items()}, 1 if any_term else len(terms))
        return found if k is None else found.orderBy(F.col("score").desc(), "atom_id").limit(k)

    # boolean queries

    def match(self, query: str | Match, k: int | None = 100) -> DataFrame:
        """(atom_id, score): the k best atoms that a query of match.parsed() holds for, ties to the smaller id.

        The postings of all words and prefixes of the query meet once, by atom. BM25 counts each phrase, prefix or NEAR
        group of the query as one term; those after NOT have no score.
        """
        query = parsed(query) if isinstance(query, str) else query
        words, prefixes = query.words()
        wanted = F.col("term").isin([w for w in words if not w.endswith("*")])
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        rows = unblocked(self.blocks.filter(wanted).select("term", "entries", "positions"))
        is_word = {w: F.col("term").startswith(w[:-1]) if w.endswith("*") else F.col("term") == w for w in words}
        slots = {w: f"s{k}" for k, w in enumerate(words)}
        gathered = [F.array_sort(F.flatten(F.collect_list(F.when(is_word[w], F.col("positions"))))).alias(s) for w, s in slots.items()]
        atoms = rows.groupBy("atom_id").agg(F.first("dl").alias("dl"), *gathered)
        units = query.units()
        names = {u: f"u{k}" for k, u in enumerate(units)}
        atoms = atoms.select("atom_id", "dl", *(u.count(slots).alias(names[u]) for u in units))
        atoms = materialize(atoms)
        df = atoms.agg(*(F.count_if(F.col(names[u]) > 0).alias(names[u]) for u in units)).first()
        score = F.lit(0.0)
        for u in query.scored():
            score = score + F.lit(self._idf(df[names[u]])) * weight(F.col(names[u]), F.col("dl"), self._mean())
        found = atoms.filter(query.holds(names)).select("atom_id", F.round(score, 9).alias("score"))
        return found if k is None else found.orderBy(F.col("score").desc(), "atom_id").limit(k)
