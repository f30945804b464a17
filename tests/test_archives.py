"""Repository archives as a source, in a batch and a stream."""

import os
import tarfile
from datetime import datetime

from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.sources import archives


def pack(folder, name, files, changed):
    top = folder / f"top-{name}"
    for path, text in files.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    out = folder / "in" / f"{name}.tar.gz"
    out.parent.mkdir(exist_ok=True)
    with tarfile.open(out, "w:gz") as t:
        t.add(top, "top")
    os.utime(out, (changed, changed))
    for path in files:
        (top / path).unlink()


def test_batch_and_stream_read_equal_rows(spark, tmp_path):
    archives.register(spark)
    pack(tmp_path, "a", {"x.md": "eins", "d/y.md": "zwei"}, 1000)
    pack(tmp_path, "b", {"z.md": "drei é" * 5000}, 1000)
    (tmp_path / "in/other.txt").write_text("no archive")
    batch = spark.read.format("repository_archives").load(f"{tmp_path}/in")
    rows = lambda df: sorted((r.archive.rpartition("/")[2], r.path, r.size, r.content) for r in df.collect())
    want = rows(batch)
    assert [r[:2] for r in want] == [("a.tar.gz", "d/y.md"), ("a.tar.gz", "x.md"), ("b.tar.gz", "z.md")] and batch.rdd.getNumPartitions() == 2

    def run():
        stream = spark.readStream.format("repository_archives").load(f"{tmp_path}/in")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(archives.SCHEMA).parquet(f"{tmp_path}/out"))

    assert run() == want and run() == want  # nothing twice
    pack(tmp_path, "a", {"x.md": "neu"}, 2000)
    assert run() == sorted([*want, ("a.tar.gz", "x.md", 3, "neu")])


def test_a_repeated_sync_replaces_what_is_gone(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e")
    pack(tmp_path, "a", {"x.md": "eins", "d/y.md": "zwei"}, 1000)
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    e.ingest_archive(f"{tmp_path}/in/a.tar.gz", "o/r", at)
    pack(tmp_path, "a", {"x.md": "neu"}, 2000)
    e.ingest_archive(f"{tmp_path}/in/a.tar.gz", "o/r", at)
    assert {r.path: r.content for r in e.store.contents().collect()} == {"repository:o/r/x.md": "neu"}
