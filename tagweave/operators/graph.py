"""Walks over the graph of atoms and tags: neighbours, illuminate, distill."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.fingerprint import damping, simhash_bytes
from tagweave.functions.text import words
from tagweave.plans.scratch import dealt, materialize, scratch, spread


@dataclass(frozen=True)
class Edges:
    """(atom_id, tag) in two forms: dealt by tag and dealt by atom, so that either side of a hop finds its own."""

    by_tag: DataFrame
    by_atom: DataFrame


def sides(edges: DataFrame | Edges) -> Edges:
    return edges if isinstance(edges, Edges) else Edges(edges, edges)


#: Edges of a bucket, about.
BUCKET = 1 << 22


def bucketed(edges: DataFrame) -> Edges:
    """The edges as two tables in the scratch folder, in buckets by tag and by atom.

    A join on the one or the other then deals its other side alone, the frontier of a walk, and no edge. There are as
    many buckets as a shuffle has parts at least, or Spark would deal the edges anew, and more for large tables.
    """
    spark = edges.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 14, edges.count() // BUCKET))
    made = []
    for key in ("tag", "atom_id"):
        name = f"tagweave_{uuid.uuid4().hex}"
        rows = edges.select("atom_id", "tag").repartition(n, key)  # one file a bucket
        rows.write.bucketBy(n, key).sortBy(key).option("path", scratch(spark)).saveAsTable(name)
        made.append(spark.table(name))
    return Edges(*made)


def neighbours(frontier: DataFrame, edges: DataFrame | Edges, most_degree: int | None = None) -> DataFrame:
    """(atom_id): atoms that share a tag with the frontier, itself included.

    The frontier's distinct tags stand between the two joins, so that a tag's atoms are listed once and not once for
    each atom that leads to it. most_degree leaves out tags with more atoms; none by default.
    """
    edges = sides(edges)
    tags = edges.by_atom.join(frontier.select("atom_id"), "atom_id", "left_semi").select("tag").distinct()
    if most_degree:
        small = edges.by_tag.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_degree)
        tags = tags.join(small, "tag", "left_semi")
    return edges.by_tag.join(tags, "tag", "left_semi").select("atom_id").distinct()


def walk(seeds: DataFrame, edges: DataFrame | Edges, depth: int, most: int | None = None, most_degree: int | None = None) -> DataFrame:
    """(atom_id, hop): breadth-first distances of at most `depth` from the seeds, which have hop 0.

    Each hop is written to the shared scratch folder: lineage stays short and a lost executor repeats one hop at most.
    Stops early once a hop finds nothing or, with `most`, enough.
    """
    seen = seeds.select("atom_id").distinct().withColumn("hop", F.lit(0).cast("long"))
    frontier = seen
    for hop in range(1, depth + 1):
        new = neighbours(frontier, edges, most_degree).join(seen, "atom_id", "left_anti").withColumn("hop", F.lit(hop).cast("long"))
        if hop < depth:
            new = materialize(new)
            n = new.count()
            if n == 0:
                break
            if most and n + seen.count() >= most:
                return seen.unionByName(new)
        frontier, seen = new, seen.unionByName(new)
    return seen


def illuminate(seeds: DataFrame, edges: DataFrame | Edges, depth: int = 2, max_nodes: int = 50, gamma: float = 0.85, mode: str = "compound") -> DataFrame:
    """(atom_id, hop_distance, gravity_score): the first max_nodes atoms around the seeds by hop and id."""
    return illuminated(seeds, edges, depth, max_nodes, gamma, mode)["nodes"]


def illuminated(seeds: DataFrame, edges: DataFrame | Edges, depth: int = 2, max_nodes: int = 50, gamma: float = 0.85, mode: str = "compound") -> dict[str, DataFrame]:
    """nodes as `illuminate` has them, and summary: (total, nodes_explored, deepest), with the atoms that the walk met.

    The walk ends with the hop that brings max_nodes atoms together.
    """
    found = materialize(walk(seeds, edges, depth, max_nodes))
    score = F.round(damping(F.col("hop"), gamma, mode), 9)
    nodes = found.select("atom_id", F.col("hop").alias("hop_distance"), score.alias("gravity_score")).orderBy("hop_distance", "atom_id").limit(max_nodes)
    explored = found.agg(F.count(F.lit(1)).alias("nodes_explored"))
    summary = nodes.agg(F.count(F.lit(1)).alias("total"), F.max("hop_distance").alias("deepest")).crossJoin(explored).select("total", "nodes_explored", "deepest")
    return {"nodes": nodes, "summary": summary}


def first_of_class(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The first row of each key by `order`, whose last column tells rows apart: a partial aggregation, no window."""
    rest = [c for c in rows.columns if c not in (*order, key)]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return least.select(key, "r.*").select(*rows.columns)


def distill(
    seeds: DataFrame, edges: DataFrame | Edges, atoms: DataFrame, radius: int = 2, max_atoms: int = 1000, gamma: float = 0.85, hash_mode: str = "xxhash64", content: Callable[[DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Blocks around the seeds, without duplicates, gathered into one record for each source.

    atoms: (atom_id, source, char_start, content); with `content`, that function adds the column to the atoms that the walk
    met, and no other content is read. Of the atoms that the walk met, at most max_atoms, those with one
    fingerprint of their bytes are duplicates (texts of less than 8 bytes, which all have the fingerprint 0, if they are
    equal): the one with the smallest hop and id stays; others still lead on. Returns blocks (atom_id, source, hop,
    gravity, chars), records (source, content, blocks, total_hops), and summary (words before and after, ratio = after /
    before, atoms, records).
    """
    near = walk(seeds, edges, radius, max_atoms).orderBy("hop", "atom_id").limit(max_atoms)
    met = materialize(content(atoms.join(near, "atom_id")) if content else atoms.select("atom_id", "source", "char_start", "content").join(near, "atom_id"))
    short = F.when(F.octet_length("content") < 8, F.md5(F.col("content").cast("binary"))).otherwise("")
    keyed = met.join(simhash_bytes(spread(met), "atom_id", "content", hash_mode), "atom_id").withColumn("dedup_key", F.concat(F.col("simhash").cast("string"), F.lit("/"), short))
    unique = first_of_class(keyed.select("dedup_key", "hop", "atom_id", "source", "char_start", "content"), "dedup_key", ("hop", "atom_id"))
    blocks = unique.select("atom_id", "source", "hop", F.round(damping(F.col("hop"), gamma), 9).alias("gravity"), F.length("content").cast("long").alias("chars"))
    body = F.array_sort(F.collect_list(F.struct("char_start", "atom_id", "content")))  # at most max_atoms rows in all
    records = unique.groupBy("source").agg(body.alias("b"), F.count(F.lit(1)).alias("blocks"), F.max("hop").alias("total_hops"))
    records = records.select("source", F.concat(F.array_join(F.transform("b", lambda x: x["content"]), "\n"), F.lit("\n")).alias("content"), "blocks", "total_hops")
    before = met.agg(F.coalesce(F.sum(words(F.col("content"))), F.lit(0)).alias("words_before"), F.count(F.lit(1)).alias("atoms"))
    after = unique.agg(F.coalesce(F.sum(words(F.col("content"))), F.lit(0)).alias("words_after"), F.count(F.lit(1)).alias("unique_atoms"))
    ratio = F.when(F.col("words_before") > 0, F.round(F.col("words_after") / F.col("words_before"), 9)).otherwise(1.0)
    summary = before.crossJoin(after).withColumn("compression_ratio", ratio)
    return {"blocks": blocks, "records": records, "summary": summary}


def pair_counts(edges: DataFrame, left: str, item: str, least: int = 2) -> DataFrame:
    """(a, b, n), a < b: how often two items meet in one group; n >= least.

    Parts of groups, and of pairs, follow the size of the edges.
    """
    edges = dealt(edges.select(left, item), left)
    a = edges.select(left, F.col(item).alias("a"))
    b = edges.select(left, F.col(item).alias("b"))
    return dealt(a.join(b, left).filter("a < b").select("a", "b"), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
