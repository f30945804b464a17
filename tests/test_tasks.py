"""Steps whose tasks hold what they are dealt: parts follow the size of the files, and change no result."""

import pytest

from tagweave.operators import graph, keywords
from tagweave.operators.index import Index
from tagweave.plans import scratch, store


@pytest.fixture
def docs(spark, tmp_path):
    words = ["tion", "er", "the", "über", "x2", *(f"w{k}" for k in range(40))]
    rows = [(k, " ".join(words[(k * 7 + j * j) % len(words)] for j in range(k % 90)) + (". Or on" if k % 3 else "")) for k in range(300)]
    spark.createDataFrame([*rows, (300, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def steps(docs):
    edges = keywords.tag_edges(docs)
    index = Index.of(docs)
    found = {"edges": edges, "vocabulary": keywords.vocabulary(docs), "tfidf": keywords.tfidf(docs), "rake": keywords.rake(docs), "pairs": graph.pair_counts(edges, "atom_id", "tag", 1)}
    found |= {"tags": store.atoms_with_tags(docs.selectExpr("doc_id AS atom_id"), edges), "postings": index.blocks.selectExpr("term", "inline(entries)"), "search": index.search(["er", "w3"], 20)}
    return {k: sorted(map(str, df.collect())) for k, df in found.items()}


def test_more_parts_change_no_result(spark, docs, monkeypatch):
    want = steps(docs)
    monkeypatch.setattr(scratch, "SHARE", 200)
    assert scratch.tasks(docs) > 20
    assert steps(docs) == want


def test_parts_follow_the_files(spark, docs, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.tasks(docs) == least == scratch.tasks(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    monkeypatch.setattr(scratch, "SHARE", 200)
    n = scratch.tasks(docs)
    assert n > least and keywords.term_counts(docs).rdd.getNumPartitions() == n
