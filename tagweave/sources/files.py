"""Files as sources: scans, walks with ignore rules, inline content, repository archives."""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import squeezed
from tagweave.plans.scratch import hadoop_path, read_text

#: Patterns that a walk ignores: *x is the end of a file name, others a part of a name or folder.
IGNORED = (".git", "node_modules", "target", "*.swp", "*.bak", "*.log")


def bucket(path: Column) -> Column:
    """The name of a path's folder; without one: default."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("default"))


def source_id(path: Column) -> Column:
    return F.concat(F.lit("src_"), F.lpad(F.lower(F.hex(F.xxhash64(path))), 16, "0"))


def inline_id(name: Column) -> Column:
    return F.concat(F.lit("src_"), F.translate(name, "/\\", "__"))


def mirror_name(source: Column, extension: str = "md") -> Column:
    """Name of a source's cleaned copy."""
    return F.concat(F.sha2(source, 256), F.lit(f".{extension}"))


def _part_has(parts: Column, wanted: str) -> Column:
    return F.exists(parts, lambda x: x.contains(wanted))


def ignored(path: Column, patterns: tuple[str, ...] = IGNORED) -> Column:
    """Whether a pattern meets a path's file name or one of its folders."""
    parts = F.split(path, "/")
    name, out = F.element_at(parts, -1), F.lit(False)
    for p in patterns:
        out = out | (name.endswith(p[1:]) if p.startswith("*") else _part_has(parts, p))
    return out


def scan(spark: SparkSession, path: str, recursive: bool = True, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """(id, path, bucket, ts, size, content) of all text files below a path that aren't ignored."""
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
    return documents(raw, patterns)


def documents(raw: DataFrame, patterns: tuple[str, ...] = IGNORED) -> DataFrame:
    """The same columns of a whole-text scan, batch or stream."""
    p = F.col("_metadata.file_path")
    rows = raw.select(F.regexp_replace(p, "^file:/+", "/").alias("path"), F.col("_metadata.file_modification_time").alias("ts"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))
    return rows.filter(~ignored(F.col("path"), patterns)).select(source_id(F.col("path")).alias("id"), "path", bucket(F.col("path")).alias("bucket"), "ts", "size", "content")


def inline(rows: DataFrame, as_of: Column) -> DataFrame:
    """The columns of `scan` for (name, content) rows that are given and not read."""
    path = F.concat(F.lit("inline:"), "name")
    return rows.select(inline_id(F.col("name")).alias("id"), path.alias("path"), F.lit("inline").alias("bucket"), as_of.alias("ts"), F.octet_length("content").cast("long").alias("size"), "content")


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the text files in gzipped tar archives, without their top folder; one task an archive."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for raw in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as tar:
                    for member in tar:
                        name = member.name.partition("/")[2]
                        if member.isfile() and name:
                            yield pd.DataFrame({"path": [name], "content": [tar.extractfile(member).read().decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "path string, content string")


def repository(url: Column) -> Column:
    """struct(owner, repo, ref) of owner/repo or a github.com address, with /tree/ref if given; else null."""
    pattern = r"^(?:https?://github\.com/)?([\w.-]+)/([\w.-]+?)(?:\.git)?(?:/tree/([^?#]+?))?/?(?:[?#].*)?$"
    part = lambda k: F.regexp_extract(url, pattern, k)
    return F.when(url.rlike(pattern), F.struct(part(1).alias("owner"), part(2).alias("repo"), F.nullif(part(3), F.lit("")).alias("ref")))


def tarball_url(repo: Column) -> Column:
    """Address of a repository's archive."""
    base = F.concat(F.lit("https://api.github.com/repos/"), repo["owner"], F.lit("/"), repo["repo"], F.lit("/tarball"))
    return F.concat(base, F.coalesce(F.concat(F.lit("/"), repo["ref"]), F.lit("")))


def folder_name(repo: Column) -> Column:
    return F.concat(repo["owner"], F.lit("-"), repo["repo"])


def due(tracked: DataFrame, as_of: Column) -> DataFrame:
    """Tracked repositories (enabled, last_sync, interval_seconds) whose sync is due."""
    elapsed = (F.unix_micros(as_of) - F.unix_micros(F.col("last_sync").cast("timestamp"))) / 1e6
    return tracked.filter(F.col("enabled") & (F.col("last_sync").isNull() | (elapsed >= F.col("interval_seconds"))))


def gitignored(path: Column, rules: str) -> Column:
    """Whether the rules of a .gitignore file ignore a path below its folder: of the rules that meet it the last decides."""
    return F.coalesce(_decision(path, rules), F.lit(False))


def _decision(path: Column, rules: str) -> Column:
    """The same; null where no rule meets the path."""
    out = F.lit(None).cast("boolean")
    for line in rules.splitlines():
        line = line.rstrip()
        if line and not line.startswith("#"):
            keeps, folder = line.startswith("!"), line.endswith("/")
            line = line.lstrip("!").rstrip("/")
            tied = "/" in line
            out = F.when(path.rlike(f"^{'' if tied else '(?:.*/)?'}{_glob(line.lstrip('/'))}{'/.*' if folder else '(?:/.*)?'}$"), F.lit(not keeps)).otherwise(out)
    return out


def _glob(pattern: str) -> str:
    """The regular expression of a .gitignore pattern."""
    signs = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^]]+\]|.", pattern)
    return "".join(signs.get(x) or (x.replace("[!", "[^") if x[0] == "[" and len(x) > 1 else re.escape(x)) for x in parts)


def _rule_files(spark: SparkSession, root: str) -> list[str]:
    """The .gitignore files below a folder, those nearer to it first; a level of folders at a time, listed by the JVM."""
    out, level = [], root.rstrip("/")
    while True:
        there, fs = hadoop_path(spark, f"{level}/.gitignore")
        out += [f.getPath().toString() for f in fs.globStatus(there) or ()]
        level += "/*"
        if not len(fs.globStatus(hadoop_path(spark, level)[0]) or ()):
            return out


def walk(spark: SparkSession, path: str, patterns: tuple[str, ...] = IGNORED, rules: str = "") -> DataFrame:
    """`scan` of a folder with the rules of its .gitignore files, of which the one nearest to a path decides, after global ones."""
    rows = scan(spark, path, True, patterns)
    plain = lambda p: "/" + re.sub("^file:", "", p).strip("/")
    below = lambda folder: F.regexp_replace("path", "^" + re.escape(folder + "/"), "")
    out = _decision(below(plain(path)), rules)
    for file in _rule_files(spark, path):
        folder = plain(file.removesuffix("/.gitignore"))
        out = F.coalesce(F.when(F.col("path").startswith(folder + "/"), _decision(below(folder), read_text(spark, file))), out)
    return rows.filter(~F.coalesce(out, F.lit(False)))


def repository_info(answer: Column) -> Column:
    """struct of what a repository's JSON description says; nulls where it says nothing or isn't JSON."""
    return F.from_json(answer, "full_name string, description string, default_branch string, private boolean, stargazers_count long, size long, updated_at timestamp")


def metadata(text: Column) -> Column:
    """Free-form JSON as a variant; anything else: null."""
    return F.try_parse_json(text)


def size_text(size: Column) -> Column:
    """Bytes in a form for people: 512 B, 1.5 KB, 2.0 MB, 3.1 GB."""
    unit = lambda n, name: F.format_string(f"%.1f {name}", size / float(n))
    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, unit(1 << 10, "KB")).when(size < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def write_copies(rows: DataFrame, path: str) -> None:
    """A file for each of (name, content) rows, at its name below a path; one that is there already is replaced.

    Tasks write through Arrow's file systems (local, HDFS, S3 and others), each file under another name first, so that a
    task that is run again, or lost, leaves no half of a file. Steps like .. are left out of names.
    """
    root = path if "://" in path else f"file://{path}"

    def write(part: Iterator[Row]) -> None:
        system, base = pafs.FileSystem.from_uri(root)
        for row in part:
            steps = [s for s in row.name.replace("\\", "/").split("/") if s not in ("", ".", "..")]
            if steps:
                folder = "/".join([base.rstrip("/"), *steps[:-1]])
                system.create_dir(folder, recursive=True)
                unfinished = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(unfinished) as out:
                    out.write((row.content or "").encode())
                system.move(unfinished, f"{folder}/{steps[-1]}")

    rows.select("name", "content").foreachPartition(write)


def cleaned_copies(sources: DataFrame, path: str) -> None:
    """The content of (id, content) sources, squeezed, under the hash of their ids."""
    write_copies(sources.select(mirror_name(F.col("id")).alias("name"), squeezed(F.col("content")).alias("content")), path)


def mirrored(sources: DataFrame, root: str, path: str) -> None:
    """The content of (path, content) sources as it is, under their paths below root."""
    write_copies(sources.select(F.regexp_replace("path", "^" + re.escape(root.rstrip("/") + "/"), "").alias("name"), "content"), path)


@dataclass
class Settings:
    """What a user sets, as JSON. Keys that aren't known stay as they came."""

    watch_paths: list[str] = field(default_factory=list)
    inbox_path: str | None = None
    external_inbox_path: str | None = None
    mirrored_brain_path: str | None = None
    database_path: str | None = None
    github_token: str | None = None
    watcher_stability_threshold_ms: int = 500
    auto_ingest: bool = True
    ingestion_batch_size: int = 50
    other: dict = field(default_factory=dict)

    @classmethod
    def load(cls, text: str) -> Settings:
        given = json.loads(text)
        known = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "other"}
        return cls(**known, other={k: v for k, v in given.items() if k not in known})

    @classmethod
    def read(cls, path: str) -> Settings:
        """The settings in a file of the driver; the defaults where there is none."""
        try:
            return cls.load(Path(path).read_text())
        except FileNotFoundError:
            return cls()

    def write(self, path: str) -> None:
        Path(path).write_text(self.dump())

    def dump(self) -> str:
        own = asdict(self)
        return json.dumps(own.pop("other") | own, indent=2)

    def watched(self) -> list[str]:
        """All folders to watch."""
        return [*self.watch_paths, *(p for p in (self.inbox_path, self.external_inbox_path) if p and p not in self.watch_paths)]

    def add_path(self, path: str) -> bool:
        """Whether the path is new."""
        if path in self.watch_paths:
            return False
        self.watch_paths.append(path)
        return True

    def remove_path(self, path: str) -> bool:
        """Whether the path was there."""
        if path not in self.watch_paths:
            return False
        self.watch_paths.remove(path)
        return True
