"""STAR search: planets match the query's tags, moons share tags with planets; gravity orders both."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.functions.fingerprint import gravity, hamming
from tagweave.functions.text import STOP_WORDS, tag, tokens
from tagweave.operators.graph import Edges, sides
from tagweave.operators.keywords import expanded
from tagweave.plans.scratch import materialize

MODES = ("combined", "planets_only", "moons_only", "max_recall")


@dataclass(frozen=True)
class SearchConfig:
    """What a search is given; `validated` raises where a value makes no sense."""

    mode: str = "combined"
    max_results: int = 50
    min_relevance: float = 0.1
    planet_share: float = 0.7
    hops: int = 1
    decay: float = 0.00001
    gamma: float = 0.85
    total_tokens: int = 8192

    def validated(self) -> SearchConfig:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if not (0 <= self.planet_share <= 1 and self.max_results > 0 and self.hops >= 0 and 0 < self.gamma <= 1 and self.total_tokens > 0):
            raise ValueError(f"search settings out of range: {self}")
        return self

    @classmethod
    def quick(cls) -> SearchConfig:
        return cls(max_results=20, hops=1)

    @classmethod
    def deep(cls) -> SearchConfig:
        return cls(max_results=100, hops=3, gamma=0.75)

    def effective(self) -> SearchConfig:
        """Max recall, asked for or implied by a budget of 16384 tokens: three hops, no decay."""
        if self.mode == "max_recall" or self.total_tokens >= 16384:
            return replace(self, mode="max_recall", hops=3, decay=0.0, gamma=0.75)
        return self


def query_tags(spark: SparkSession, query: str, k: int = 20, least: float = 0.2) -> list[str]:
    """The tags that a query asks for: its k best keywords of a score above `least`, as texts' keywords are, in one row."""
    words = F.filter(tokens(F.lit(query)), lambda t: ~t.isin(*STOP_WORDS))
    each = F.transform(F.array_distinct("ws"), lambda t: F.struct(F.size(F.filter("ws", lambda w: w == t)).alias("n"), t.alias("term"), tag(t).alias("tag")))
    found = spark.range(1).select(words.alias("ws")).select(each.alias("k")).first()[0]
    best = sorted(found, key=lambda r: (-r.n, r.term.encode()))[:k]
    return sorted(r.tag for r in best if r.n > least * best[0].n)


def scored(
    atoms: DataFrame, edges: DataFrame | Edges, query_tags: list[str], query_hash: int, as_of: Column, config: SearchConfig, synonyms: DataFrame | None = None, planets: DataFrame | None = None, with_path: bool = False
) -> DataFrame:
    """(atom_id, kind, hop, shared_tags, relevance): planets (hop 0) and moons (hops 1 to config.hops) with their gravity.

    atoms: (atom_id, ts, simhash). A planet shares tags with the query, a moon of hop h tags that atoms of hop h - 1 have
    and no earlier step used; the distance is always that to the query's fingerprint. Between the joins stand distinct
    tags, so that the work grows with the edges it touches and not with pairs of atoms; each step is written before the
    next reads it. planets: (atom_id, shared_tags) of a query that has no tags, found by its text. with_path adds path,
    the tags that lead from the query to the atom, the least of them by order where several do.
    """
    spark, edges = atoms.sparkSession, sides(edges)
    tags = spark.createDataFrame([(t,) for t in query_tags], "term string")
    if synonyms is not None:
        tags = materialize(expanded(tags, synonyms))
    path = [F.min("path").alias("path")] if with_path else []
    step = tags.select(F.col("term").alias("tag")).distinct()
    if with_path:
        step = step.withColumn("path", F.array("tag"))
    used, found = step.select("tag"), None
    for hop in range(config.hops + 1):
        if hop == 0 and planets is not None:
            new = planets.select("atom_id", "shared_tags", *([F.array().cast("array<string>").alias("path")] if with_path else []))
        else:
            met = edges.by_tag.filter(F.col("tag").isin(query_tags)) if hop == 0 and synonyms is None and not with_path else edges.by_tag.join(step, "tag")
            new = met.groupBy("atom_id").agg(F.count(F.lit(1)).alias("shared_tags"), *path)
        new = (new if found is None else new.join(found, "atom_id", "left_anti")).withColumn("hop", F.lit(hop).cast("long"))
        if hop < config.hops:
            new = materialize(new)
            reached = edges.by_atom.join(new.select("atom_id", *(["path"] if with_path else [])), "atom_id").join(used, "tag", "left_anti")
            step = reached.groupBy("tag").agg(F.min(F.array_append("path", F.col("tag"))).alias("path")) if with_path else reached.select("tag").distinct()
            step = materialize(step)
            used = used.unionByName(step.select("tag"))
        found = new if found is None else found.unionByName(new)
    distance = hamming(F.col("simhash"), F.lit(query_hash).cast("long"))
    score = gravity(F.col("shared_tags"), F.col("ts"), as_of, distance, F.pow(F.lit(config.gamma), F.col("hop")), config.decay)
    rows = found.join(atoms, "atom_id").withColumn("relevance", F.round(score, 6))
    columns = ["atom_id", F.when(F.col("hop") == 0, "planet").otherwise("moon").alias("kind"), "hop", "shared_tags", "relevance"]
    return rows.select(*columns, *(["path"] if with_path else []))


def within_results(rows: DataFrame, config: SearchConfig) -> DataFrame:
    """Results by the mode: planets up to their share (rounded down), moons in what is left of max_results.

    Each kind is cut by a top-k first, so that the ranking that follows has max_results rows of a kind at most.
    """
    rows = rows.filter(F.col("relevance") >= config.min_relevance)
    best = [F.col("relevance").desc(), F.col("atom_id")]
    n = config.max_results
    planets, moons = rows.filter("kind = 'planet'"), rows.filter("kind = 'moon'")
    if config.mode == "planets_only":
        return planets.orderBy(*best).limit(n)
    if config.mode == "moons_only":
        return moons.orderBy(*best).limit(n)
    some = planets.orderBy(*best).limit(int(n * config.planet_share))
    taken = some.agg(F.count(F.lit(1)).alias("taken"))
    ranked = moons.orderBy(*best).limit(n).withColumn("r", F.row_number().over(Window.orderBy(*best)))
    rest = ranked.crossJoin(F.broadcast(taken)).filter(F.col("r") <= n - F.col("taken")).drop("r", "taken")
    return some.unionByName(rest)


def within_chars(rows: DataFrame, most: int) -> DataFrame:
    """(…, running): rows (atom_id, n) in order of id while the sum of their lengths n is at most `most`.

    A row with text takes one character at least, so that no more than `most` of them need to be summed up.
    """
    some = rows.filter("n > 0").orderBy("atom_id").limit(most)
    w = Window.orderBy("atom_id").rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("running", F.sum("n").over(w)).filter(F.col("running") <= most)


def within_tokens(rows: DataFrame, sizes: DataFrame, config: SearchConfig) -> DataFrame:
    """(…, tokens, running): best results of each kind while their tokens fit the kind's share of total_tokens.

    sizes: (atom_id, tokens). The running sum is over max_results rows of a kind at most.
    """
    out = None
    for kind, share in (("planet", config.planet_share), ("moon", 1 - config.planet_share)):
        top = rows.filter((F.col("kind") == kind) & (F.col("relevance") >= config.min_relevance)).orderBy(F.col("relevance").desc(), "atom_id").limit(config.max_results)
        w = Window.orderBy(F.col("relevance").desc(), "atom_id").rowsBetween(Window.unboundedPreceding, 0)
        part = top.join(sizes, "atom_id").withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= int(config.total_tokens * share + 1e-9))
        out = part if out is None else out.unionByName(part)
    return out


def summary(results: DataFrame) -> DataFrame:
    """(planets, moons, results)."""
    return results.agg(F.count_if(F.col("kind") == "planet").alias("planets"), F.count_if(F.col("kind") == "moon").alias("moons"), F.count(F.lit(1)).alias("results"))


def package(rows: DataFrame, config: SearchConfig) -> DataFrame:
    """(planets, moons, tokens_used, budget_limit, utilization) of the rows that within_tokens left; utilization = used / limit."""
    used = F.coalesce(F.sum("tokens"), F.lit(0)).cast("long")
    counts = rows.agg(F.count_if(F.col("kind") == "planet").alias("planets"), F.count_if(F.col("kind") == "moon").alias("moons"), used.alias("tokens_used"))
    limit = F.lit(config.total_tokens).cast("long")
    return counts.select("*", limit.alias("budget_limit"), F.round(F.col("tokens_used") / limit, 9).alias("utilization"))


def ordered(rows: DataFrame, atoms: DataFrame, order_by: str = "relevance") -> DataFrame:
    """rows with their position (from 1) by 'relevance', best first, or by 'time', oldest first; ties by id.

    rows: results that a limit has cut; atoms: (atom_id, ts).
    """
    if order_by not in ("relevance", "time"):
        raise ValueError(f"unknown order: {order_by}")
    first = F.col("relevance").desc() if order_by == "relevance" else F.col("ts")
    return rows.join(atoms.select("atom_id", "ts"), "atom_id").withColumn("position", F.row_number().over(Window.orderBy(first, "atom_id")).cast("long"))


def deduplicated(rows: DataFrame, prefix: int = 500, fuzzy: int = 80, fuzzy_most: int = 8, overlap: float = 0.5, bits: int = 5) -> DataFrame:
    """rows without those that a better one repeats: (atom_id, relevance, source, char_start, char_end, text, simhash).

    rows are the results of a search, which a limit has cut, so that comparing each with the better ones is cheap. A row
    goes if with any better row (by relevance and then id) it has in common: the first `prefix` characters; all of its
    text, inside the other's; a beginning of `fuzzy` characters, if both have as many, but for fuzzy_most edits; a range of the
    same source that covers `overlap` of the shorter one; or a fingerprint but for fewer than `bits` bits.
    """
    better = rows.select(*(F.col(c).alias(f"b_{c}") for c in ("atom_id", "relevance", "source", "char_start", "char_end", "text", "simhash")))
    first = (F.col("b_relevance") > F.col("relevance")) | ((F.col("b_relevance") == F.col("relevance")) & (F.col("b_atom_id") < F.col("atom_id")))
    head = lambda c, n: F.substring(c, 1, n)
    shared = F.least("char_end", "b_char_end") - F.greatest("char_start", "b_char_start")
    shorter = F.least(F.col("char_end") - F.col("char_start"), F.col("b_char_end") - F.col("b_char_start"))
    same = (
        (F.md5(head("text", prefix).cast("binary")) == F.md5(head("b_text", prefix).cast("binary")))
        | F.col("b_text").contains(F.col("text"))
        | ((F.length("text") >= fuzzy) & (F.length("b_text") >= fuzzy) & (F.levenshtein(head("text", fuzzy), head("b_text", fuzzy)) <= fuzzy_most))
        | ((F.col("source") == F.col("b_source")) & (shared > 0) & (shared >= overlap * shorter))
        | (hamming(F.col("simhash"), F.col("b_simhash")) < bits)
    )
    return rows.join(better, first & same, "left_anti")
