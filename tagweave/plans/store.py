"""The store: sources, atoms, tags and the index as Parquet tables, and what changes them."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.fingerprint import simhash
from tagweave.functions.text import STOP_WORDS, atoms, cleaned, hashtags, transient
from tagweave.operators import chunks as ch
from tagweave.operators import index, near
from tagweave.operators.index import BLOCKS, Index, packed, postings, totals, unblocked, weighed
from tagweave.operators.keywords import keywords
from tagweave.plans.scratch import dealt, discard, hadoop_path, materialize, read_text

SOURCES = "id string, path string, bucket string, created_at timestamp, updated_at timestamp, metadata string"
ATOMS = "atom_id long, source_id string, source_path string, seq long, char_start long, char_end long, ts timestamp, simhash long, metadata string"
TAGS = "atom_id long, tag string, bucket string, source_id string"
#: A sketch of the distinct tags in a folder of the tags; folders that no commit names any more count for nothing.
SKETCHES = "folder string, tags binary"
#: Bits of a sketch's number of registers: 4096, a relative error of about 1.6 %.
REGISTERS = 12
QUARANTINED = "source_id string, path string, bucket string, ts timestamp, reason string, content string"
TABLES = {"sources": SOURCES, "atoms": ATOMS, "tags": TAGS, "chunks": ch.CHUNKS, "postings": BLOCKS, "keys": near.KEYS, "links": near.LINKS, "quarantined": QUARANTINED, "sketches": SKETCHES}
#: What deals the rows of a table to parts, where it isn't their source.
DEALT = {"sources": "id", "keys": "key", "links": "a", "sketches": "folder"}
#: What the rows of a part are in order of, so that a filter on it leaves out most of a file.
ORDER = {"postings": index.ORDER, "tags": {"tag": True}, "chunks": {"source_id": True, "seq": True}, "keys": {"choice": True, "key": True}}
#: Parts of each table, by the hash of the source, of a store that isn't told another number: a change rewrites the parts
#: that it removes rows from, and no others.
PARTS = 32
#: Folders of one part beyond which the next change that touches it makes them one.
FOLDERS = 16
#: Commits whose files stay, for tables that were opened before the newest.
KEPT = 5


@dataclass(frozen=True)
class IngestOptions:
    extract_tags: bool = True
    max_keywords: int = 10
    least_score: float = 0.3
    sanitize: bool = True
    drop_transient: bool = False
    hash_mode: str = "xxhash64"


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those that have their keys."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among keys."""
    return rows.join(keys.select(key), key, "left_anti").select(*rows.columns)


def ingested(docs: DataFrame, options: IngestOptions = IngestOptions()) -> dict[str, DataFrame]:
    """sources, chunks, atoms, tags and postings of (id, path, bucket, ts, content) rows: cleaned, cut, fingerprinted and tagged.

    Atom ids are hashes of source and position: the same content gets the same ids on every run. Of rows that repeat an
    id the newest counts. The cut text is written once and read for fingerprints, keywords and offsets.
    """
    newest = docs.groupBy("id").agg(F.max(F.struct("ts", "path", "bucket", "content")).alias("d")).select("id", "d.*")
    body = cleaned(F.col("content")) if options.sanitize else F.col("content")
    rows = newest.withColumn("content", body)
    if options.drop_transient:
        rows = rows.filter(~transient(F.col("content"))["is_transient"])
    rows = materialize(rows)
    sources = rows.select("id", "path", "bucket", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.lit(None).cast("string").alias("metadata"))
    cut = materialize(atoms(rows, "id", "content").withColumn("atom_id", F.xxhash64("id", "seq")))
    prints = simhash(cut, "atom_id", "content", options.hash_mode)
    named = cut.join(rows.select("id", "path", "bucket", "ts"), "id")
    found = named.join(prints, "atom_id").select("atom_id", F.col("id").alias("source_id"), F.col("path").alias("source_path"), "seq", "char_start", "char_end", "ts", "simhash", F.lit(None).cast("string").alias("metadata"))
    if options.extract_tags:
        best = keywords(cut, options.max_keywords, "max", "atom_id", "content", STOP_WORDS).filter(F.col("score") >= options.least_score)
        every = best.select("atom_id", F.concat(F.lit("#"), "term").alias("tag")).unionByName(cut.select("atom_id", F.explode(hashtags(F.col("content"))).alias("tag"))).distinct()
        tags = every.join(named.select("atom_id", "bucket", F.col("id").alias("source_id")), "atom_id").select("atom_id", "tag", "bucket", "source_id")
    else:
        tags = docs.sparkSession.createDataFrame([], TAGS)
    owners = cut.select("atom_id", F.col("id").alias("source_id"))
    pieces = ch.cut(rows).withColumnRenamed("id", "source_id")
    return {"sources": sources, "chunks": pieces, "atoms": found, "tags": tags, "postings": postings(cut, "atom_id", "content").join(owners, "atom_id")}


_locks: dict[str, threading.RLock] = {}


class Store:
    """Tables in a folder, cut into parts by source. A commit names the folders of every part of every table.

    A change writes new folders and then one commit file, which fails if another writer made a commit meanwhile; so all
    tables change at once, readers see one commit, and what a change costs grows with the parts that it touches and not
    with the store. The first commit fixes the number of parts. Folders that older commits named and none of the last KEPT commits does are removed.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.lock = _locks.setdefault(self.path, threading.RLock())  # changes by one driver wait for each other
        self.parts = self._held().get("parts", parts)
        self.fresh: dict[str, list[int]] = {}  # texts and tokens of the posting folders that the next commit may name

    def part_of(self, source_id: Column) -> Column:
        return F.pmod(F.xxhash64(source_id), F.lit(self.parts)).cast("int")

    def _names(self, path: str) -> list[str]:
        there, fs = hadoop_path(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []

    def _commits(self) -> list[str]:
        return [n for n in self._names(f"{self.path}/commits") if n.endswith(".json")]

    def _held(self) -> dict:
        """The newest commit; empty before the first."""
        commits = self._commits()
        return json.loads(read_text(self.spark, f"{self.path}/commits/{commits[-1]}")) if commits else {}

    def _read(self, commit: str) -> dict[str, dict[str, list[str]]]:
        return json.loads(read_text(self.spark, f"{self.path}/commits/{commit}"))["tables"]

    def _state(self) -> tuple[int, dict[str, dict[str, list[str]]]]:
        """Number of the newest commit, and its folders by table and part."""
        commits = self._commits()
        return (int(commits[-1][:12]), self._read(commits[-1])) if commits else (0, {n: {} for n in TABLES})

    def _commit(self, number: int, state: dict[str, dict[str, list[str]]]) -> None:
        there, fs = hadoop_path(self.spark, f"{self.path}/commits/{number:012d}.json")
        counted, folders = {**self._held().get("totals", {}), **self.fresh}, {f for fs in state.get("postings", {}).values() for f in fs}
        stream = fs.create(there, False)  # an error if another writer was first
        stream.write(bytearray(json.dumps({"parts": self.parts, "tables": state, "totals": {f: n for f, n in counted.items() if f in folders}}).encode()))
        stream.close()
        self.fresh = {}
        commits = self._commits()
        old, kept = commits[:-KEPT], commits[-KEPT:]
        if not old:
            return
        named = lambda cs: {f.rpartition("/")[0] for c in cs for parts in self._read(c).values() for fs in parts.values() for f in fs}
        for path in [*(named(old) - named(kept)), *(f"commits/{c}" for c in old)]:
            gone, fs = hadoop_path(self.spark, f"{self.path}/{path}")
            fs.delete(gone, True)

    def _written(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows of one table by part; the folder of each part. Postings come as rows with their sources and become blocks."""
        key = F.col(DEALT.get(name, "source_id")).cast("string")
        folder, counted = f"{name}/{uuid.uuid4().hex}", None
        rows = rows.withColumn("part", self.part_of(key))
        if name == "postings":
            rows = materialize(rows)
            counted = {str(p): [n, t] for p, n, t in totals(rows, "part").collect()}  # self.parts at most
            n, held = (sum(x) for x in zip(*counted.values(), strict=True)) if counted else (0, 0)
            rows = weighed(rows, held / n if n else 1.0).drop("source_id")
        else:
            rows = rows.select(*self.spark.createDataFrame([], TABLES[name]).columns, "part")
        order = {"part": True} | ORDER.get(name, {})
        dealt = rows.hint("rebalance", "part").sortWithinPartitions(*order, ascending=[*order.values()])  # large parts are split
        (packed(dealt, "part") if name == "postings" else dealt).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        made = {n[5:]: [f"{folder}/{n}"] for n in self._names(f"{self.path}/{folder}") if n.startswith("part=")}
        if not made:
            there, fs = hadoop_path(self.spark, f"{self.path}/{folder}")
            fs.delete(there, True)
        if counted is not None:
            self.fresh |= {made[p][0]: n for p, n in counted.items()}
        return made

    def _opened(self, name: str, state: dict, parts: list[str] | None = None) -> DataFrame:
        folders = [f for p, fs in state[name].items() if parts is None or p in parts for f in fs]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(f"{self.path}/{f}" for f in folders))

    def table(self, name: str) -> DataFrame:
        """The table as of the newest commit; empty before the first."""
        return self._opened(name, self._state()[1])

    def index(self) -> Index:
        """The inverted index, kept with the atoms; how many atoms and tokens there are stands in the commit."""
        held = self._held()
        named = list(held.get("totals", {}).values())
        blocks = self._opened("postings", held.get("tables", {"postings": {}}))
        return Index(blocks, sum(n for n, _ in named), sum(t for _, t in named))

    def near_classes(self) -> DataFrame:
        """(atom_id, class_id): atoms whose fingerprints are linked have one class, its smallest atom."""
        return near.classes(self.table("atoms").select("atom_id", "simhash"), self.table("links"))

    def chunks(self, ids: list[str] | None = None) -> DataFrame:
        """The chunks of all sources, or of some, for which only their parts are opened and their rows are read."""
        state = self._state()[1]
        if ids is None:
            return self._opened("chunks", state)
        rows = self.spark.createDataFrame([(i,) for i in ids], "id string").select(self.part_of(F.col("id")).cast("string")).distinct()
        return self._opened("chunks", state, [r[0] for r in rows.collect()]).filter(F.col("source_id").isin(ids))

    def contents(self, ids: list[str] | None = None) -> DataFrame:
        """sources with their whole content."""
        sources = self.table("sources") if ids is None else self.table("sources").filter(F.col("id").isin(ids))
        text = ch.whole(self.chunks(ids)).withColumnRenamed("source_id", "id")
        return sources.join(text, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))

    def _change(self, new: dict[str, DataFrame], gone: DataFrame | None = None, key: str = "source_id") -> None:
        """One commit: rows whose `key` is in gone (key, part) leave all tables that have it, new rows come."""
        with self.lock:
            self._change_now(new, gone, key)

    def _change_now(self, new: dict[str, DataFrame], gone: DataFrame | None, key: str) -> None:
        number, state = self._state()
        state = {n: dict(state.get(n, {})) for n in TABLES}
        parts = [str(r[0]) for r in gone.select("part").distinct().collect()] if gone is not None else []  # self.parts at most
        touched = {n: set() if n in ("keys", "links", "sketches") else set(parts) for n in TABLES}  # fingerprints stay known
        fresh, before = {n: self._written(n, rows) for n, rows in new.items()}, dict(state["atoms"])
        for n, by_part in fresh.items():
            touched[n] |= {p for p in by_part if len(state[n].get(p, ())) >= FOLDERS}
        for n in TABLES:
            if touched[n]:
                rows, own = self._opened(n, state, list(touched[n])), "id" if n == "sources" and key == "source_id" else key
                if n == "postings":  # their sources stand with their atoms
                    owners = self._opened("atoms", {"atoms": before}, list(touched[n])).select("atom_id", "source_id")
                    rows = unblocked(rows).join(owners, "atom_id")
                if gone is not None and own in rows.columns:
                    rows = rows.join(gone.select(F.col(key).alias(own)).distinct(), own, "left_anti")
                kept = self._written(n, rows)
                state[n] = {p: f for p, f in state[n].items() if p not in touched[n]} | kept
            for p, folders in fresh.get(n, {}).items():
                state[n][p] = [*state[n].get(p, []), *folders]
        known = {f for fs in self._state()[1].get("tags", {}).values() for f in fs}
        made = self._sketched([f for fs in state["tags"].values() for f in fs if f not in known])
        for p, folders in (self._written("sketches", made) if made is not None else {}).items():
            state["sketches"][p] = [*state["sketches"].get(p, []), *folders]
        self._commit(number + 1, state)

    def _sketched(self, folders: list[str]) -> DataFrame | None:
        """SKETCHES rows of new folders of the tags, a change's; none for none."""
        if not folders:
            return None
        rows = self.spark.read.schema(TABLES["tags"]).parquet(*(f"{self.path}/{f}" for f in folders))
        folder = F.regexp_extract(F.col("_metadata.file_path"), "(tags/[^/]+/part=[0-9]+)/[^/]*$", 1)
        return materialize(rows.groupBy(folder.alias("folder")).agg(F.hll_sketch_agg("tag", REGISTERS).alias("tags")))

    def ingest(self, docs: DataFrame, options: IngestOptions = IngestOptions()) -> dict[str, int]:
        """Adds (id, path, bucket, ts, content) rows; a source that is there already is replaced with its atoms and tags.

        New fingerprints are linked to near ones, in the store and among themselves. Returns the numbers of sources, chunks,
        atoms, tags and postings of these documents.
        """
        new = {k: materialize(v) for k, v in ingested(docs, options).items()}
        counts = {k: v.count() for k, v in new.items()}
        ids = docs.select(F.col("id").alias("source_id")).distinct()
        with self.lock:
            here = self.table("sources").select(F.col("id").alias("source_id")).unionByName(self.table("quarantined").select("source_id"))
            gone = materialize(here.join(ids, "source_id", "left_semi").withColumn("part", self.part_of(F.col("source_id"))))
            keys = self.table("keys")
            new["keys"] = materialize(near.keyed(near.fresh(new["atoms"].select(F.col("simhash").alias("h")), keys)))
            new["links"] = materialize(near.links(new["keys"], keys))
            self._change(new, None if gone.isEmpty() else gone)
        discard(gone, *new.values())
        return counts

    def quarantine(self, source_id: str, reason: str) -> None:
        """Takes a source out of all tables and keeps its content aside, in one commit; KeyError where there is none."""
        kept = self.contents([source_id]).select(F.col("id").alias("source_id"), "path", "bucket", F.col("updated_at").alias("ts"), F.lit(reason).alias("reason"), "content")
        gone = self.table("sources").filter(F.col("id") == source_id).select(F.col("id").alias("source_id"), self.part_of(F.col("id")).alias("part"))
        if gone.isEmpty():
            raise KeyError(source_id)
        self._change({"quarantined": materialize(kept)}, gone)

    def restore(self, source_id: str, options: IngestOptions = IngestOptions()) -> None:
        """Brings a source back from quarantine, in one commit; its content was cleaned before. KeyError where it isn't there."""
        held = self.table("quarantined").filter(F.col("source_id") == source_id)
        if held.isEmpty():
            raise KeyError(source_id)
        self.ingest(held.select(F.col("source_id").alias("id"), "path", "bucket", "ts", "content"), replace(options, sanitize=False))

    def delete_source(self, source_id: str) -> None:
        """Removes a source with its atoms and tags; KeyError where there is none."""
        gone = self.table("sources").filter(F.col("id") == source_id).select(F.col("id").alias("source_id"), self.part_of(F.col("id")).alias("part"))
        if gone.isEmpty():
            raise KeyError(source_id)
        self._change({}, gone)

    def delete_atom(self, atom_id: int) -> None:
        """Removes an atom with its tags; KeyError where there is none."""
        gone = self.table("atoms").filter(F.col("atom_id") == atom_id).select("atom_id", self.part_of(F.col("source_id")).alias("part"))
        if gone.isEmpty():
            raise KeyError(atom_id)
        self._change({}, gone, "atom_id")

    def add_tags(self, rows: DataFrame) -> None:
        """Adds (atom_id, tag, bucket) rows of atoms that are there; tags that an atom has already stay single."""
        fresh = rows.dropDuplicates(["atom_id", "tag"]).join(self.table("tags").select("atom_id", "tag"), ["atom_id", "tag"], "left_anti")
        self._change({"tags": fresh.join(self.table("atoms").select("atom_id", "source_id"), "atom_id").select("atom_id", "tag", "bucket", "source_id")})

    def rebuild_index(self) -> None:
        """Postings anew from the sources' content, in one commit."""
        with self.lock:
            number, state = self._state()
            rows = self.table("atoms").select("atom_id", "source_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
            text = ch.char_ranges(rows, self.chunks(), ["atom_id", "source_id"])
            made = postings(text, "atom_id", "piece").join(text.select("atom_id", "source_id"), "atom_id")
            self._commit(number + 1, state | {"postings": self._written("postings", made)})

    def wipe(self) -> None:
        """Empties all tables by one commit: who reads the one before goes on reading it."""
        with self.lock:
            self._commit(self._state()[0] + 1, {n: {} for n in TABLES})

    def is_empty(self) -> bool:
        return self.table("atoms").isEmpty()

    def stats(self, exact: bool = True) -> DataFrame:
        """(atoms, sources, tags). Not exact: the number of distinct tags is estimated from a sketch for each part and commit,
        which their union gives within some per cent, and no tag is read; the others are the files' own numbers of rows."""
        if exact:
            return stats(self.table("atoms"), self.table("sources"), self.table("tags"))
        state = self._state()[1]
        named = [f for fs in state["tags"].values() for f in fs]
        held = self._opened("sketches", state).filter(F.col("folder").isin(named)).groupBy("folder").agg(F.first("tags").alias("tags"))
        tags = held.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("tags")), F.lit(0).cast("long")).alias("tags"))
        count = lambda n: self.table(n).agg(F.count(F.lit(1)).alias(n))
        return count("atoms").crossJoin(count("sources")).crossJoin(tags)


def stats(self) -> DataFrame:
        return stats(self.table("atoms"), self.table("sources"), self.table("tags"))


def stats(atoms_df: DataFrame, sources: DataFrame, tags: DataFrame) -> DataFrame:
    """(atoms, sources, tags): numbers of rows, and of distinct tags."""
    one = lambda d, e, n: d.agg(e.alias(n))
    parts = [one(atoms_df, F.count(F.lit(1)), "atoms"), one(sources, F.count(F.lit(1)), "sources"), one(tags, F.countDistinct("tag"), "tags")]
    return reduce(lambda x, y: x.crossJoin(y), parts)


def atoms_with_tags(atoms_df: DataFrame, edges: DataFrame) -> DataFrame:
    """Every atom with its tags in order; none: an empty array."""
    per = dealt(edges.select("atom_id", "tag"), "atom_id").groupBy("atom_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return atoms_df.join(per, "atom_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def atoms_by_tag(atoms_df: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    return atoms_df.join(edges.filter(F.col("tag") == tag).select("atom_id"), "atom_id", "left_semi")


def compounds(sources: DataFrame, atoms_df: DataFrame, edges: DataFrame, wanted: str | None = None) -> DataFrame:
    """(id, atoms): sources, all or those that have the tag `wanted` or hold it in their path."""
    count = atoms_df.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("atoms"))
    out = sources.join(count, "id", "left").withColumn("atoms", F.coalesce("atoms", F.lit(0)))
    if wanted is None:
        return out.select("id", "atoms")
    tagged = atoms_by_tag(atoms_df, edges, wanted).select(F.col("source_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return out.join(tagged, "id", "left").filter(F.col("hit") | F.col("path").contains(wanted)).select("id", "atoms")
