"""op13: spelling variants one edit apart, by errata-trie merging over the distinct words.

The words form a trie, whose nodes are prefixes. At each node the child with the most words is heavy, the others are
light, as is the end of a word there; so a word has few light edges on its way, less than the logarithm of the number
of words, and all merging goes from the smaller side to the larger one. Two words one edit apart part at one node, and at
least one of them by a light edge. Each light subtree is merged into its node with one character replaced, skipped or
put in; a terminal that coincides with another is a pair:

    replaced by the heavy character: meets a word of the heavy subtree
    replaced by a blank: meets words of other light subtrees, which have the same key
    skipped: meets a word that lacks this character
    the heavy character put in before: meets a word of the heavy subtree that has one character more

Every pair is met once: a key tells at which node its words part. Merging is a join on the terminals' strings, so that
no task holds a trie. Nodes are told by hashes of their prefixes; two nodes of one hash would share their heavy
character, which changes what is merged into what and no result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import discard, map_rows, materialize, table, texts
from tagweave.llm.resampling import CRC_TABLE, crc_sql

LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO, DIVISOR = 6, 5, 5, 199
#: Words that a task counts before it hands its counts on.
HELD = 1 << 18
#: Bytes of a word up to which it travels with each of its prefixes; longer ones are told by a digest.
SHORT = 32
#: A node less than DEEP characters deep with more than a HOT-th of the words below it is sent to all tasks: they are
#: fewer than DEEP * HOT.
HOT, DEEP = 1000, 64


def words(doc_id: int | None, text: bytes, divisor: int = DIVISOR, least: int = LEAST_LENGTH) -> Counter[str]:
    """Words of a text with `least` or more code points and their counts.

    Where crc32("doc_id:run") is a multiple of divisor, the run's code point at crc32 modulo its length is deleted.
    """
    seen = Counter(re.findall(f"[{LETTERS}]{{{least},}}", text.lower().decode("utf-8", "replace")))
    head = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    out: Counter[str] = Counter()
    for run, n in seen.items():
        h = zlib.crc32(run.encode(), head)
        if h % divisor == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, least_count: int = LEAST_COUNT, least: int = LEAST_LENGTH, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with `least_count` or more occurrences in all texts; counted where the texts are first."""

    def out(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                for w, n in words(doc_id, text, divisor, least).items():
                    counts[w] += n
            if len(counts) > HELD:
                yield out(counts)
                counts.clear()
        yield out(counts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _spread(codes: np.ndarray) -> np.ndarray:
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _edges(found: DataFrame) -> DataFrame:
    """(name, n, node, depth, next): each step of each word through the trie; next is empty at its end.

    name is the word, or its digest after a blank where it is long.
    """
    schema = pa.schema([("name", pa.string()), ("n", pa.int64()), ("node", pa.int64()), ("depth", pa.int32()), ("next", pa.string())])

    def steps(b: pa.RecordBatch) -> pa.RecordBatch:
        each = b.column(2).to_pylist()
        lengths = np.array([len(w) + 1 for w in each], np.int64)
        starts = np.cumsum(lengths) - lengths
        codes = np.frombuffer("".join(w + "\0" for w in each).encode("utf-32-le"), np.uint32)
        depth = np.arange(len(codes)) - np.repeat(starts, lengths)
        power = np.concatenate([np.ones(1, np.uint64), np.full(max(0, int(lengths.max(initial=1)) - 1), 0xD6E8FEB86659FD93, np.uint64)]).cumprod()
        total = np.cumsum(_spread(codes) * power[depth])
        before = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
        node = _spread(before - np.repeat(before[starts], lengths) + depth.astype(np.uint64) * np.uint64(0x94D049BB133111EB))
        chars = pa.array([c if c != "\0" else "" for c in "".join(w + "\0" for w in each)], pa.string())
        take = pa.array(np.repeat(np.arange(len(each)), lengths))
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(node.view(np.int64)), pa.array(depth.astype(np.int32)), chars], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 4096):
                part = b.slice(begin, 4096)
                if part.num_rows:
                    yield steps(part)

    named = found.select(_name(F.col("word")).alias("name"), "word", "n").select("name", "n", "word")
    return named.mapInArrow(run, "name string, n long, node long, depth int, next string")


def _name(word: Column) -> Column:
    return F.when(F.octet_length(word) <= SHORT, word).otherwise(F.concat(F.lit(" "), F.md5(word.cast("binary"))))


def _light(found: DataFrame, scrap: list[DataFrame]) -> DataFrame:
    """(word, n, depth, next, heavy): the light edges, and the heavy character of their nodes."""
    steps = _edges(found)
    below = steps.groupBy("node", "depth", "next").agg(F.count(F.lit(1)).alias("m"))
    heavy = F.max_by("next", F.when(F.col("next") != "", F.struct("m", "next")))
    nodes = below.groupBy("node", "depth").agg(heavy.alias("heavy"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("ways")).filter("ways > 1").drop("ways")
    nodes = _kept(nodes, scrap)
    least = F.lit(max(1, found.count() // HOT))
    is_hot = (F.col("depth") < DEEP) & (F.col("m") > least)
    hot = F.broadcast(nodes.filter(is_hot).select("node", "heavy"))
    cold = nodes.filter(~is_hot).select("node", "heavy")
    out = steps.join(hot, "node").unionByName(steps.join(hot.select("node"), "node", "left_anti").join(cold.hint("merge"), "node")).filter("next <> heavy")
    out = _kept(out.select("name", "n", "depth", "next", "heavy"), scrap)
    told = F.substring("name", 1, 1) == " "
    long = found.filter(F.octet_length("word") > SHORT).select(_name(F.col("word")).alias("name"), "word")
    return out.filter(~told).withColumnRenamed("name", "word").unionByName(out.filter(told).join(long, "name").select("word", "n", "depth", "next", "heavy"))


def _kept(df: DataFrame, scrap: list[DataFrame]) -> DataFrame:
    scrap.append(materialize(df))
    return scrap[-1]


def near_words(found: DataFrame, scrap: list[DataFrame]) -> DataFrame:
    """(word, n_near, near, near_n): the number of a word's near words and the most frequent of them, ties to the smaller."""
    light = _kept(_light(found, scrap), scrap)
    d, inner = F.col("depth"), F.col("next") != ""
    head, rest, after = F.substring("word", F.lit(1), d), F.substring("word", d + 1, F.length("word")), F.substring("word", d + 2, F.length("word"))
    terminals = F.array(
        F.concat(head, "heavy", rest),
        F.when(inner, F.concat(head, "heavy", after)),
        F.when(inner & (F.substring("word", d + 2, F.lit(1)) != F.col("next")), F.concat(head, after)),  # of a run of one character only the last is skipped
    )
    probes = light.select("word", "n", F.explode(terminals).alias("key")).filter("key IS NOT NULL")
    met = _kept(probes.join(found.select(F.col("word").alias("key"), F.col("n").alias("key_n")).hint("merge"), "key"), scrap)
    one = F.lit(1).cast("long").alias("m")
    best = lambda n, w: F.struct((-F.col(n)).alias("order"), F.col(w).alias("w")).alias("best")
    sides = met.select("word", one, best("key_n", "key")).unionByName(met.select(F.col("key").alias("word"), one, best("n", "word")))

    # light subtrees of one node: a key has one word for each character at most, so that its list is short
    blank = light.filter(inner).select(F.concat(head, F.lit(" "), after).alias("key"), F.struct((-F.col("n")).alias("order"), F.col("word").alias("w")).alias("me"))
    groups = blank.groupBy("key").agg(F.array_sort(F.collect_list("me")).alias("all")).filter(F.size("all") > 1)
    each = groups.select(F.explode("all").alias("me"), "all")
    other = F.when(F.col("me") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0])
    sides = sides.unionByName(each.select(F.col("me.w").alias("word"), (F.size("all") - 1).cast("long").alias("m"), other.alias("best")))
    near = sides.groupBy("word").agg(F.sum("m").alias("n_near"), F.min("best").alias("best"))
    return near.select("word", "n_near", F.col("best.w").alias("near"), (-F.col("best.order")).alias("near_n"))


def variants(found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) rows.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of
    the largest n, ties to the smallest in code-point order, if that is at least ratio times the word's n; else null, as is
    form_n. root follows forms to the last one. As n grows by ratio with each step, chains are short and have no circles
    (ratio must be 2 or more); they are shortened to half in each round.

    Words must be distinct, without nulls, blanks or characters U+0000, of any length; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    scrap: list[DataFrame] = []
    found = materialize(found.select("word", "n"))
    near = near_words(found, scrap).withColumnRenamed("word", "of")
    joined = found.join(near, found["word"] == near["of"], "left").drop("of")
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    discard(found, *scrap)
    roots = materialize(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        met = materialize(roots.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        discard(roots)
        roots = met.select("word", "root")
        if met.filter("moved").isEmpty():
            break
    named = out.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, least: int = LEAST_LENGTH, ratio: int = RATIO, divisor: int = DIVISOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the words of all texts.

    Words are maximal runs of A-Z (lower-cased), a-z and U+00C0 to U+00FF, with one code point deleted where words()
    says so. A null or empty text has none; a null id counts as empty. Repeated rows count as often as they stand there.
    Other columns are ignored, whatever their names; an empty table gives no rows. Texts are read whole.
    """
    return variants(word_counts(docs, least_count, least, divisor, id_col, text_col), ratio)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE.strip()},
r AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r, crc),
m AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS short FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
e AS (
  SELECT a.word AS x, a.n AS xn, b.word AS y, b.n AS yn FROM d a JOIN d b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.short = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.short = w.word),
o AS (SELECT *, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY yn DESC, y) AS place FROM e),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN yn >= 5 * n THEN y END AS form, CASE WHEN yn >= 5 * n THEN yn END AS form_n
  FROM w LEFT JOIN o ON word = x AND place = 1),
c(word, root, depth) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, f.form, coalesce(z.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN z ON f.word = z.word
"""
