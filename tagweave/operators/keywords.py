"""Keywords, tags, TF-IDF, RAKE and synonym rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagweave.functions.text import STOP_WORDS, tag, tokens
from tagweave.plans.scratch import dealt, tasks


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, n): texts are dealt by id once, and counting happens where they are.

    A task's counts take up many times its texts' room, so that the number of tasks follows the size of the texts.
    """
    rows = docs.select(id_col, text_col).repartition(tasks(docs), id_col).select(id_col, F.explode(tokens(F.col(text_col))).alias("term"))
    if stop_words:
        rows = rows.filter(~F.col("term").isin(*stop_words))
    return rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))


def keywords(docs: DataFrame, k: int = 10, tf: str = "max", id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, score, rank): each text's k best terms; tf 'max': n / largest n, 'sum': n / all n.

    The windows partition by id, as the counts are, so that they need no further shuffle.
    """
    counts = term_counts(docs, id_col, text_col, stop_words)
    whole = F.max("n") if tf == "max" else F.sum("n")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("n").desc(), "term"))
    scored = counts.withColumn("score", F.col("n") / whole.over(Window.partitionBy(id_col))).withColumn("rank", rank)
    return scored.filter(F.col("rank") <= k).select(id_col, "term", "score", F.col("rank").cast("long").alias("rank"))


def tag_edges(docs: DataFrame, k: int = 10, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(atom_id, tag): the bipartite graph of texts and their keywords of score `least` or more; without repeats."""
    return keywords(docs, k, "max", id_col, text_col).filter(F.col("score") >= least).select(F.col(id_col).alias("atom_id"), tag(F.col("term")).alias("tag"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, n): documents and occurrences of every term."""
    return dealt(term_counts(docs, id_col, text_col), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


def tfidf(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, score, rank): the k best terms by n / all n * (ln((N + 1) / (df + 1)) + 1).

    df comes back by a join on the term, and the counts return to their texts; parts of both follow the texts' size.
    """
    counts = term_counts(docs, id_col, text_col, stop_words)
    length = F.sum("n").over(Window.partitionBy(id_col))
    df = dealt(counts.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.select(F.count(F.lit(1)).alias("n_docs"))
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    met = dealt(counts.withColumn("tf", F.col("n") / length), "term").join(df.hint("merge"), "term").crossJoin(F.broadcast(n))
    scored = met.select(id_col, "term", (F.col("tf") * idf).alias("score")).repartition(tasks(docs), id_col)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.round("score", 12).desc(), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "term", "score", F.col("rank").cast("long").alias("rank"))


def rake(docs: DataFrame, k: int = 10, min_word_length: int = 2, max_phrase_length: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, score, rank): phrases between stop words and punctuation, scored by their words' degree / frequency.

    Words are what white space separates inside a part without punctuation; those that are shorter than min_word_length
    are left out of their phrase. All of it is SQL functions: a phrase's words are counted where the document is.
    """
    parts = F.split(F.lower(text_col), r"[^\p{L}\p{N}\s]+|\n")
    split = F.transform(F.split(F.trim("part"), r"\s+"), lambda w: F.when(w.isin(*STOP_WORDS), "|").otherwise(w))
    pieces = docs.select(id_col, text_col).repartition(tasks(docs), id_col).select(id_col, F.explode(parts).alias("part"))
    pieces = pieces.select(id_col, F.explode(F.split(F.array_join(split, " "), r"\|")).alias("part"))
    phrase = F.filter(F.split(F.trim("part"), r"\s+"), lambda w: F.length(w) >= min_word_length)
    rows = pieces.select(id_col, phrase.alias("ws")).filter((F.size("ws") > 0) & (F.size("ws") <= max_phrase_length))
    rows = rows.groupBy(id_col, "ws").agg(F.count(F.lit(1)).alias("n"))
    each = rows.select(id_col, "ws", "n", F.explode("ws").alias("w"))
    word = Window.partitionBy(id_col, "w")
    score = F.sum(F.size("ws") * F.col("n")).over(word) / F.sum("n").over(word)
    total = each.select(id_col, "ws", score.alias("s")).groupBy(id_col, "ws").agg(F.sum("s").alias("score"))
    named = total.select(id_col, F.array_join("ws", " ").alias("phrase"), F.round("score", 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("score").desc(), "phrase"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= k).select(id_col, "phrase", "score", F.col("rank").cast("long").alias("rank"))


def term_score(docs: DataFrame, doc: Column, term: str, id_col: str = "doc_id", text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, score): the TF-IDF of one term in the documents that `doc` holds for; 0 where they lack it."""
    has = F.array_contains(tokens(F.col(text_col)), term)
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(has).alias("df"))
    rows = docs.filter(doc).select(id_col, F.filter(tokens(F.col(text_col)), lambda t: ~t.isin(*stop_words)).alias("ts"))
    tf = F.when(F.size("ts") > 0, F.size(F.filter("ts", lambda t: t == term)) / F.size("ts")).otherwise(0.0)
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1
    return rows.crossJoin(F.broadcast(stats)).select(id_col, F.lit(term).alias("term"), (tf * idf).alias("score"))


def ring(pairs: DataFrame) -> DataFrame:
    """(term, synonym) in both directions, without repeats, of (term, synonym) pairs."""
    return pairs.select("term", "synonym").unionByName(pairs.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"))).filter("term <> synonym").distinct()


def expanded(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term): the terms with all their synonyms in the ring."""
    return terms.select("term").unionByName(terms.join(synonyms, "term").select(F.col("synonym").alias("term"))).distinct()


def load_ring(spark: SparkSession, path: str) -> DataFrame:
    """A ring from a JSON object {term: [synonyms]}, one in a file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return ring(raw.select(F.explode("m").alias("term", "all")).select("term", F.explode("all").alias("synonym")))
