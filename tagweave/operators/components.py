"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.plans.scratch import discard, materialize


#: Links of a task, about: tables of few links are read and written by few tasks, however many parts a shuffle has.
TASK = 1 << 17


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Links (a, b), a < b, after one round: each node hands its larger (or its smaller) neighbours to its least one.

    The least neighbour of a node comes from a partial aggregation and is written before the join, so that a node with
    very many links is a skewed join, which Spark splits, and never one group. links is a table of this module's own,
    which goes once the next one is written.
    """
    ends = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        ends = ends.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = materialize(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks))
    met = ends.join(least, "u")
    if large:
        out = met.filter("v > u").select("v", "m")
    else:
        out = met.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    new = materialize(out.filter("v <> m").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).distinct().coalesce(tasks))
    discard(links, least)
    return new


def _stars(links: DataFrame, tasks: int) -> bool:
    """Whether every component is a star around its least node: all others have one link, and to it."""
    ends = links.select(F.col("a").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("least"))
    ends = ends.unionByName(links.select(F.col("b").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("least")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("least").alias("least")).coalesce(tasks).filter("below + least > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the least node that it reaches.

    Loops and repeated links change nothing; an empty table gives no rows. At the end every node but the least of a
    component has one link, to the least. The rounds needed grow with the logarithm of the longest chain.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(links)
    tasks = max(1, math.ceil(links.count() / TASK))
    while not _stars(links, tasks):
        links = _star(_star(links, True, tasks), False, tasks)
    ends = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return ends.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
