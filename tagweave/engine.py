"""The engine as one object: a store, what changes it and what is asked of it."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import fingerprint as fp
from tagweave.functions import text as tx
from tagweave.operators import chunks as ch
from tagweave.operators import graph
from tagweave.operators import search as star
from tagweave.operators import synonyms as syn
from tagweave.operators.index import query_terms
from tagweave.plans import store as st
from tagweave.plans.scratch import hadoop_path, materialize
from tagweave.sources import files


class Engine:
    """Ingest, search, illuminate, distill and the smaller questions, over a store in a folder."""

    def __init__(self, spark: SparkSession, path: str, options: st.IngestOptions = st.IngestOptions(), ring: DataFrame | None = None, settings: files.Settings | None = None) -> None:
        self.spark, self.path, self.options, self.ring = spark, path.rstrip("/"), options, ring
        self.store, self.settings = st.Store(spark, f"{self.path}/store"), settings or files.Settings()

    # what changes the store

    def ingest(self, source: str, content: str, bucket: str | None = None, as_of: datetime | None = None) -> dict[str, int]:
        """Adds one text under a name; the same name again replaces it."""
        given = self.spark.createDataFrame([(source, content)], "name string, content string")
        rows = files.inline(given, F.lit(as_of or datetime.now(timezone.utc)).cast("timestamp"))
        return self.ingest_documents(rows.withColumn("bucket", F.lit(bucket)) if bucket else rows)

    def ingest_file(self, path: str) -> dict[str, int]:
        """Adds a text file, or all files below a folder that its rules don't ignore."""
        return self.ingest_documents(files.scan(self.spark, path))

    def ingest_documents(self, rows: DataFrame) -> dict[str, int]:
        """Adds (id, path, bucket, ts, content) rows."""
        counts = self.store.ingest(rows, self.options)
        if self.settings.mirrored_brain_path:
            files.cleaned_copies(rows, self.settings.mirrored_brain_path)
        return counts

    def ingest_archive(self, path: str, repository: str, as_of: Column | None = None) -> dict[str, int]:
        """Adds the files of a repository's archive, in place of all that it had before."""
        root = f"repository:{repository}/"
        found = files.archive(self.spark, path).filter(~files.ignored(F.col("path")))
        now = F.current_timestamp() if as_of is None else as_of
        rows = materialize(found.select(F.concat(F.lit(root), "path").alias("path"), "content").select(files.source_id(F.col("path")).alias("id"), "path", files.bucket(F.col("path")).alias("bucket"), now.alias("ts"), "content"))
        left = self.store.table("sources").filter(F.col("path").startswith(root)).join(rows.select("id"), "id", "left_anti")
        gone = materialize(left.select(F.col("id").alias("source_id"), self.store.part_of(F.col("id")).alias("part")))
        counts = self.ingest_documents(rows)
        if not gone.isEmpty():
            self.store._change({}, gone)
        return counts

    # what is asked of it

    def _edges(self) -> DataFrame:
        return self.store.table("tags").select("atom_id", "tag")

    def _content(self, atoms: DataFrame, limited: bool = False) -> DataFrame:
        """atoms with content: joined late, for rows that a limit has cut, from the chunks that they lie in.

        limited: they are so few that their sources' names may go through the driver, so that no other chunk is read.
        """
        ids = [r[0] for r in atoms.select("source_id").distinct().collect()] if limited else None
        wanted = atoms.select("atom_id", "source_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
        text = ch.char_ranges(wanted, self.store.chunks(ids), ["atom_id"])
        return atoms.join(text.withColumnRenamed("piece", "content"), "atom_id")

    def found(self, query: str, config: star.SearchConfig = star.SearchConfig(), as_of: datetime | None = None, with_path: bool = False) -> DataFrame:
        """All planets and moons of a query with their gravity; by its tags, or by its words where it has no keywords."""
        config = config.validated().effective()
        tags, terms = star.query_tags(self.spark, query), query_terms(self.spark, query)
        atoms = self.store.table("atoms").select("atom_id", "ts", "simhash")
        planets = None if tags else self.store.index().search(terms, 100).select("atom_id", F.lit(1).cast("long").alias("shared_tags"))
        now = F.lit(as_of or datetime.now(timezone.utc)).cast("timestamp")
        return star.scored(atoms, self._edges(), tags, fp.simhash_of(terms, self.spark, self.options.hash_mode), now, config, self.ring, planets, with_path)

    def search(self, query: str, config: star.SearchConfig = star.SearchConfig(), as_of: datetime | None = None, order_by: str = "relevance", deduplicate: bool = False) -> DataFrame:
        """The results of a query with their content and tags, in order of position."""
        atoms = self.store.table("atoms")
        best = materialize(star.within_results(self.found(query, config, as_of), config.validated().effective()))
        if deduplicate:
            rows = self._content(atoms.join(best.select("atom_id", "relevance"), "atom_id"), True).select("atom_id", "relevance", F.col("source_id").alias("source"), "char_start", "char_end", F.col("content").alias("text"), "simhash")
            best = best.join(star.deduplicated(rows).select("atom_id"), "atom_id")
        full = self._content(atoms.select("atom_id", "source_id", "source_path", "char_start", "char_end", "ts").join(best, "atom_id"), True)
        return star.ordered(st.atoms_with_tags(full.drop("ts"), self._edges()), atoms, order_by).orderBy("position")

    def search_with_budget(self, query: str, config: star.SearchConfig = star.SearchConfig(), as_of: datetime | None = None) -> tuple[DataFrame, dict]:
        """Results that fit the token budget, and how much of it they use."""
        config = config.validated().effective()
        atoms = self.store.table("atoms").select("atom_id", "source_id", "char_start", "char_end")
        found = materialize(self.found(query, config, as_of))
        sizes = self._content(atoms.join(found.select("atom_id"), "atom_id", "left_semi")).select("atom_id", tx.words(F.col("content")).alias("tokens"))
        rows = materialize(star.within_tokens(found, sizes, config))
        return rows, star.package(rows, config).first().asDict()

    def seeds(self, seed: str | None, k: int = 100) -> DataFrame:
        """(atom_id): the atoms of a tag (#…), the k best of a text in the index, or all atoms for None."""
        if seed is None:
            return self.store.table("atoms").select("atom_id")
        if seed.startswith("#"):
            return self._edges().filter(F.col("tag") == seed.lower()).select("atom_id").orderBy("atom_id").limit(k)
        return self.store.index().search(query_terms(self.spark, seed), k).select("atom_id")

    def illuminate(self, seed: str, depth: int = 2, max_nodes: int = 50) -> tuple[DataFrame, dict]:
        """Nodes around a seed with their content and tags, and how many were explored."""
        out = graph.illuminated(self.seeds(seed), self._edges(), depth, max_nodes)
        atoms = self.store.table("atoms").select("atom_id", "source_id", "source_path", "char_start", "char_end", "simhash")
        nodes = self._content(atoms.join(out["nodes"], "atom_id"), True).withColumn("simhash", fp.hex_form(F.col("simhash")))
        return st.atoms_with_tags(nodes, self._edges()).orderBy("hop_distance", "atom_id"), out["summary"].first().asDict()

    def distill(self, seed: str | None = None, radius: int = 2, max_atoms: int = 1000, write: bool = False, as_of: datetime | None = None) -> dict:
        """Decision records around a seed, as a dictionary; with `write` also as a JSON file below distills, named in `file`."""
        atoms = self.store.table("atoms").select("atom_id", "source_id", F.col("source_path").alias("source"), "char_start", "char_end")
        out = graph.distill(self.seeds(seed), self._edges(), atoms, radius, max_atoms, hash_mode=self.options.hash_mode, content=lambda met: self._content(materialize(met), True))
        records = [r.asDict() for r in out["records"].orderBy("source").collect()]  # of max_atoms atoms at most
        told = out["summary"].first().asDict()
        result = {"seed": seed, "radius": radius, "total_atoms": told["atoms"], "total_sources": len(records), "compression_ratio": told["compression_ratio"], "records": records}
        if write:
            when = (as_of or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
            result["file"] = f"{self.path}/distills/distill_{re.sub(r'[^0-9A-Za-z]', '_', seed or 'all')}_{when}.json"
            there, fs = hadoop_path(self.spark, result["file"])
            stream = fs.create(there, True)
            stream.write(bytearray(json.dumps(result, indent=2, ensure_ascii=False).encode()))
            stream.close()
        return result

    def synonyms(self, path: str | None = None) -> DataFrame:
        """(tag, synonyms) of all three strategies over the store; written with their summary below a path, if given."""
        edges, prints = materialize(self._edges()), self.store.table("atoms").select("atom_id", "simhash")
        rings = syn.merged({"cooccurrence": syn.by_cooccurrence(edges), "neighbourhood": syn.by_neighbourhood(edges), "fingerprint": syn.by_fingerprint(edges, prints)})
        if path:
            rings = materialize(rings)
            syn.write(rings, path)
        return rings

    def use_synonyms(self, rings: DataFrame) -> None:
        """From now on queries ask for their tags' synonyms as well; rings: (tag, synonyms)."""
        pairs = rings.select(F.col("tag").alias("term"), F.explode("synonyms").alias("synonym"))
        self.ring = materialize(pairs.distinct())

    def chat(self, messages: list[dict[str, str]], as_of: datetime | None = None) -> dict:
        """An answer of what the last message finds: five of the ten best results, and counts. No language model is asked."""
        query = messages[-1]["content"] if messages else "general query"
        found = self.search(query, star.SearchConfig(max_results=10), as_of).limit(5).collect()
        context = [f"[{r.atom_id}] {r.content[:200]}" for r in found]
        return {"query": query, "context": context, "content": f"{len(context)} passages found for: {query}", "planets": sum(r.kind == "planet" for r in found), "moons": sum(r.kind == "moon" for r in found)}

    def stats(self) -> dict[str, int]:
        return self.store.stats().first().asDict()

    def read_file(self, path: str, start_line: int = 0, end_line: int = 1 << 30) -> str:
        """Lines [start_line, end_line) of a source, from 0; KeyError where there is none of that path or id."""
        named = self.store.table("sources").filter((F.col("path") == path) | (F.col("id") == path)).select("id").first()
        if named is None:
            raise KeyError(path)
        return self.store.contents([named.id]).select(tx.line_range(F.col("content"), start_line, end_line)).first()[0]

    def read_range(self, path: str, start: int, end: int, unit: str = "char") -> str | bytes:
        """Characters (or bytes) [start, end) of a source, from 0, read from the chunks that they lie in; KeyError as above."""
        named = self.store.table("sources").filter((F.col("path") == path) | (F.col("id") == path)).select("id").first()
        if named is None:
            raise KeyError(path)
        wanted = self.spark.createDataFrame([(named.id, start, end)], "source_id string, start long, end long")
        chunks = self.store.chunks([named.id])
        if unit == "char":
            chunks = chunks.filter(F.col("seq").between(start // ch.SIZE, max(start, end - 1) // ch.SIZE))
            row = ch.char_ranges(wanted, chunks, ["source_id"]).first()
            return row.piece if row else ""
        row = ch.byte_ranges(wanted, chunks.filter((F.col("byte_start") < end) & (F.col("byte_end") > start)), ["source_id"]).first()
        return bytes(row.piece) if row else b""

    def match(self, query: str, k: int = 100) -> DataFrame:
        """The k best atoms of a boolean query (words, "phrases", pre*, AND, OR, NOT, NEAR) with their content, best first."""
        best = materialize(self.store.index().match(query, k))
        atoms = self.store.table("atoms").select("atom_id", "source_id", "source_path", "char_start", "char_end")
        return self._content(atoms.join(best, "atom_id"), True).orderBy(F.col("score").desc(), "atom_id")

    def list_compounds(self, wanted: str | None = None) -> DataFrame:
        return st.compounds(self.store.table("sources"), self.store.table("atoms"), self.store.table("tags"), wanted)

    def health(self) -> dict:
        return {"status": "ok", "empty": self.store.is_empty()}
