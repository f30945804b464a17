"""op4: harmonic packing of documents into sequences of a fixed capacity.

A piece belongs to class k when k pieces of its length just fill a sequence. Each class fills its own sequences with a
fixed count of pieces, k, so that a worker needs no search and no knowledge of other workers. Documents may be cut: one
whose length is no reciprocal fraction of the capacity (within `slack`) gives up a piece that is, and its rest, which is
less than the gap between two fractions, goes on to a finer class. What a worker's classes hold in part at the end is
laid end to end and cut at the capacity; the last of it goes into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.common import map_rows, table, texts

#: Words whose ids a Python worker keeps because they were met again, and of those met once; about 150 bytes each. It
#: starts anew beyond that, which only costs time.
CACHE, FRESH = 500_000, 200_000
#: Words of these characters are their own lower-casing and normal form, character by character; 'C0-'FF without signs.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: how the word tokenizer's file splits lower-case text, for plain characters.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordIds:
    """Ids of white-space separated words as little-endian unsigned 32-bit bytes, by the tokenizers library.

    A text's ids are those of its words one after another: the tokenizer drops white space, and nothing that it matches
    or composes reaches across. Plain words are encoded many at a time; their ids end where as many word-end tokens
    have passed as the word has parts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, odd, out = [], [], {}
        for w in words:
            s = w.decode("utf-8", "replace")
            (plain if PLAIN.fullmatch(s) and "<|" not in s else odd).append((w, s))
        for begin in range(0, len(plain), 64):
            part = plain[begin : begin + 64]
            (got,) = self._encode([" ".join(s for _, s in part)])
            ids = np.frombuffer(got, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            parts = np.cumsum([len(SPLIT.findall(s.lower())) for _, s in part])
            if len(last) == parts[-1]:
                cut = [0, *(4 * last[parts - 1]).tolist()]
                out.update((w, got[a:b]) for (w, _), a, b in zip(part, cut, cut[1:], strict=False))
            else:
                odd += part
        if odd:
            out.update(zip((w for w, _ in odd), self._encode([s for _, s in odd]), strict=True))
        return out

    def of(self, docs: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [d.split() for d in docs]
        words = set(chain.from_iterable(split))
        found = {w: self.known[w] for w in words & self.known.keys()}
        words.difference_update(found)
        again = {w: self.once.pop(w) for w in words & self.once.keys()}
        fresh = self._learn(list(words.difference(again)))
        for held, more, most in ((self.known, again, CACHE), (self.once, fresh, FRESH)):
            if len(held) > most:
                held.clear()
            held.update(more)
        get = (found | again | fresh).__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def harmonic_cuts(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(class, piece length) of a document's pieces: whole sequences first, then ever finer fractions of one."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest > slack:
            k += 1
            out.append((k, capacity // k))
            rest -= capacity // k
        else:
            out.append((k, rest))
            rest = 0
    return out


class Packer:
    """One worker's open sequences; add() and close() return the sequences that are ready, as lists of pieces.

    A piece is (row, start, length, ids as bytes).
    """

    def __init__(self, capacity: int, slack: int) -> None:
        self.capacity, self.slack, self.open = capacity, slack, defaultdict(list)

    def add(self, row: tuple, ids: bytes) -> Iterator[list[tuple]]:
        start = 0
        for k, n in harmonic_cuts(len(ids) // 4, self.capacity, self.slack):
            held = self.open[k]
            held.append((row, start, n, ids[4 * start : 4 * (start + n)]))
            start += n
            if len(held) == k:
                yield held
                self.open[k] = []

    def close(self) -> Iterator[list[tuple]]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left = sum(p[2] for p in rest)
        self.open.clear()
        current, room = [], 0
        for row, start, n, ids in rest:
            at = 0
            while at < n:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= room
                take = min(room, n - at)
                current.append((row, start + at, take, ids[4 * at : 4 * (at + take)]))
                at += take
                room -= take
                if not room:
                    yield current
                    current = []


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    slack: int = 32,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packed pieces of all documents, each document's ids followed by end_id.

    Returns per piece id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids (array). A
    sequence of less than `capacity` tokens is to be padded to it, unless its length is a power of two. Every id is in
    one piece; pieces fill sequences from offset 0 without gaps. slack: padding that a class may leave in a sequence. A
    null or empty text is a document of end_id alone; repeated rows are documents of their own; other columns are
    ignored; an empty table gives no rows. capacity is a power of two. Each partition packs by itself and keeps less
    than one sequence per class, about 2 * sqrt(capacity) of them.
    """
    end = np.array([end_id], "<u4").tobytes()
    fields = [(id_col, pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] * with_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, packer = _word_ids(tokenizer_path), Packer(capacity, slack)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for (doc_id, total), start, n, ids in pieces:
                row = (doc_id, start, n, zlib.crc32(ids), total, sequence, offset)
                out.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
                offset += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), words.of(list(texts(b.column(1)))), strict=True):
                ids += end
                for pieces in packer.add((doc_id, len(ids) // 4), ids):
                    put(pieces)
            if out:
                yield flush()
        for pieces in packer.close():
            put(pieces)
        if out:
            yield flush()

    ddl = ", ".join(f"{n} long" for n, _ in fields) + ", ids array<int>" * with_ids
    return map_rows(docs.select(id_col, text_col), run, ddl)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
