"""op9: mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same real number of copies, target / source size. Whole copies are kept
aside; what is left is a probability p in [0, 1). Two documents meet: mass (words times p) moves from one to the other,
in a random direction that keeps each expectation, until one of them is at 0 or 1. The other meets the next. A group
of documents so leaves at most one fractional document, and the groups' leftovers form the next level's groups: a
reduction tree. The mass of a source never changes before its last leftover is rounded, so that what a source gives
differs from its target by less than one document. A group takes its documents from the longest to the shortest: then
the one that stays fractional is as short as those it met last, and the final rounding errs by few words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.llm.common import WORD_PATTERN, materialize, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mean number of documents in a group of the reduction tree.
FAN_IN = 200
EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """source, source_size, target of each source of (source, size) rows.

    The sources, in code point order with null last, weigh `weights`, repeating, and divide share * all words. A target
    stops at ceiling times its source's size; the excess goes to the others by weight until none is above: with the
    sources in order of ceiling * size / weight, the first ones stop at their ceilings and the rest share one level.
    Requires share <= ceiling. A source without words has the target 0. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = ceiling * F.col("source_size")
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    own = per.withColumn("w", w).withColumn("cap", cap).withColumn("level", level)
    # the level at the first source that stays below its ceiling holds for all sources after it, and is above the
    # ceilings of those before it
    at = F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True)
    at = at.over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(at * F.col("w"), F.col("cap")))
    return own.select("source", "source_size", target.alias("target"))


def _unit(*key: Column) -> Column:
    """A number in [0, 1) that depends only on the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


def _meet(items: Column, seed: int, last: bool) -> Column:
    """Fold of one group: struct(out: resolved documents, carry: the fractional one or null).

    The state holds the document that is still fractional. Each next one with a fraction meets it.
    """
    kind = "struct<less:bigint,key:bigint,id:bigint,size:bigint,whole:bigint,p:double>"

    with_p = lambda d, p: F.struct(*(d[k].alias(k) for k in ("less", "key", "id", "size", "whole")), p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        c = state["carry"]
        mc, mx = c["size"] * c["p"], x["size"] * x["p"]  # mass of either
        # one way takes from x and gives to c, the other way round; each ends with one of the two at 0 or 1
        to_c = F.least(mx, c["size"] * (1 - c["p"]))
        to_x = F.least(mc, x["size"] * (1 - x["p"]))
        gives = _unit(c["key"], x["key"], F.lit(seed)) * (to_c + to_x) < to_x
        move = F.when(gives, to_c).otherwise(-to_x)
        pc, px = c["p"] + move / c["size"], x["p"] - move / x["size"]
        snap = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)
        pair = F.struct(snap(pc).alias("pc"), snap(px).alias("px"))
        settled = lambda p: (p == 0.0) | (p == 1.0)

        def after(p: Column) -> Column:
            nc, nx = with_p(c, p["pc"]), with_p(x, p["px"])
            both = settled(p["pc"]) & settled(p["px"])
            return F.when(both, F.struct(F.concat(state["out"], F.array(nc, nx)).alias("out"), F.lit(None).cast(kind).alias("carry"))).when(
                settled(p["pc"]), F.struct(F.concat(state["out"], F.array(nc)).alias("out"), nx.alias("carry"))
            ).otherwise(F.struct(F.concat(state["out"], F.array(nx)).alias("out"), nc.alias("carry")))

        met = F.element_at(F.transform(F.array(pair), after), 1)
        idle = settled(x["p"]) | (x["size"] == 0)
        return (
            F.when(idle, F.struct(F.concat(state["out"], F.array(with_p(x, F.when(x["p"] >= 1.0, 1.0).otherwise(0.0)))).alias("out"), c.alias("carry")))
            .when(c.isNull(), F.struct(state["out"].alias("out"), x.alias("carry")))
            .otherwise(met)
        )

    empty = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("carry"))

    def end(state: Column) -> Column:
        c = state["carry"]
        if not last:
            return state
        p = F.when(_unit(c["key"], F.lit(seed + 1)) < c["p"], 1.0).otherwise(0.0)
        one = with_p(c, p)
        return F.struct(F.when(c.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out"), F.lit(None).cast(kind).alias("carry"))

    return F.aggregate(items, empty, step, end)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Copies of every document in a mix whose sources come near their targets.

    Returns id_col, source, size (words of the text; null: 0), source_size, target, copies (0 to ceiling), taken
    (copies * size), one row per input row. What a source's documents give in all differs from its target by less than
    its largest document. Null sources form one source, which comes last; null ids and repeated rows are documents of
    their own kind: equal (id, source, size) rows are told apart only by their number, so results depend on no order.
    Other columns are ignored. An empty table gives no rows. Randomness comes from hashes: reruns agree.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    # one row for each distinct (id, source, size) and the number of times it stands there
    sizes = materialize(flat.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("times")).alias("size")), weights, share, ceiling)
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    per_source = sizes.groupBy("source").agg(F.sum("times").alias("docs"))
    targets = materialize(targets.join(per_source, targets["source"].eqNullSafe(per_source["source"])).drop(per_source["source"]))
    most = targets.agg(F.max("docs")).first()[0] or 1

    t = F.broadcast(targets) if targets.count() <= 10_000 else targets
    s = sizes.alias("s").join(t.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    rows = s.select("s.id", "s.source", "s.size", "t.docs", "t.rate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("s.times"))).alias("nth"))
    key = F.xxhash64("id", "size", "source", "nth", F.lit(seed))
    whole = F.least(F.floor("rate"), F.lit(math.floor(ceiling)))
    level = rows.select("id", "source", "size", "docs", key.alias("key"), whole.cast("long").alias("whole"), (F.col("rate") - whole).alias("p"))

    levels = max(1, math.ceil(math.log(max(most, 2)) / math.log(fan_in)))
    entry = level.select("source", "docs", F.struct((-F.col("size")).alias("less"), "key", "id", "size", "whole", "p").alias("x"))
    done = None
    for k in range(levels):
        last = k == levels - 1
        groups = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("docs") / float(fan_in) ** (k + 1)))
        group = F.pmod(F.xxhash64("x.key", F.lit(seed + 10 + k)), groups).alias("group")
        packed = entry.select("source", "docs", group, "x").groupBy("source", "docs", "group").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        met = materialize(packed.select("source", "docs", _meet(F.col("xs"), seed + 100 + 2 * k, last).alias("m")))
        out = met.select("source", F.explode("m.out").alias("x"))
        done = out if done is None else done.unionByName(out)
        entry = met.filter(F.col("m.carry").isNotNull()).select("source", "docs", F.col("m.carry").alias("x"))
    copies = F.col("x.whole") + F.col("x.p").cast("long")
    back = done.withColumn("copies", copies).alias("c").join(t.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    taken = F.col("copies") * F.col("x.size")
    return back.select(F.col("x.id").alias(id_col), F.col("c.source").alias("source"), F.col("x.size").alias("size"), "t.source_size", "t.target", "copies", taken.alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each of the documents."""
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
