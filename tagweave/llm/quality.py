"""op10: a quality classifier over averaged subword embeddings, trained by stochastic gradient descent in numpy.

The features of a document are its words, the character n-grams of its words (byte n-grams inside a word's marks), and
its pairs of neighbouring words, hashed into one table of learned vectors; a word that repeats its neighbour makes the
pair "same". A document's vector is the mean of its features' vectors; a softmax layer gives the classes.

Scoring needs no vectors: the layer is linear, so that each bucket's vector becomes one number (the difference of the
two classes' products), each distinct word the sum of its buckets' numbers, and a document the mean over its features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import crc_mod, id_crc, map_rows, materialize, own_names, table, texts

#: Rows that training takes at most (by hash of their ids), and distinct features of one of them: a documented bound.
SAMPLE, BUCKETS = 4096, 1 << 16
NGRAMS = (3, 4)
#: Bytes of packed features that training takes at most: the other bound of the sample.
FEATURE_BYTES = 128 << 20
#: Bytes of text of which features are computed at once.
PIECE = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Odd multipliers of the hashes.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Bits of h spread over its upper half."""
    h = h ^ (h >> np.uint64(29))
    h = h * ODD[1]
    return h ^ (h >> np.uint64(32))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (_mix(h + np.uint64(kind) * ODD[2]) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Words:
    """Distinct words of a batch of texts: hash of each, n-gram buckets (ragged), and the texts as runs of word numbers."""

    hashes: np.ndarray
    gram_bucket: np.ndarray
    gram_word: np.ndarray
    sequence: np.ndarray
    begin: np.ndarray  # where each text starts in sequence, and its end

    @classmethod
    def of(cls, docs: list[bytes]) -> Words:
        number: dict[bytes, int] = {}
        runs = [np.array([number.setdefault(w, len(number)) for w in d.split()], np.int32) for d in docs]
        sequence = np.concatenate(runs) if runs else np.zeros(0, np.int32)
        begin = np.cumsum([0, *map(len, runs)])
        lengths = np.fromiter(map(len, number), np.int64, len(number)) + 2
        flat = np.frombuffer(b"".join(b"\x02%b\x03" % w for w in number), np.uint8).astype(np.uint64)
        start = np.cumsum(np.r_[0, lengths])
        word = np.repeat(np.arange(len(number), dtype=np.int32), lengths)
        place = np.arange(len(flat)) - start[word] if len(flat) else flat.astype(np.int64)
        # a word's hash: the sum of its bytes' hashes with their places
        h = _mix((flat + np.uint64(1)) * ODD[0] + place.astype(np.uint64) * ODD[2])
        hashes = np.add.reduceat(h, start[:-1]) if len(number) else h
        buckets, words = [], []
        for n in NGRAMS:
            if len(flat) < n:
                continue
            inside = word[: len(flat) - n + 1] == word[n - 1 :]
            g = np.zeros(len(flat) - n + 1, np.uint64)
            for k in range(n):
                g = g * np.uint64(257) + flat[k : len(flat) - n + 1 + k]
            buckets.append(_bucket(g[inside], n))
            words.append(word[: len(flat) - n + 1][inside])
        cat = lambda a: np.concatenate(a) if a else np.zeros(0, np.int64)
        return cls(hashes, cat(buckets), cat(words), sequence, begin)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each word and its successor in a text, and where they stand in sequence."""
        inner = np.ones(len(self.sequence), bool)
        inner[self.begin[1:][np.diff(self.begin) > 0] - 1] = False
        at = np.flatnonzero(inner)
        a, b = self.sequence[at], self.sequence[at + 1]
        same = a == b
        h = self.hashes[a] * ODD[0] + self.hashes[b]
        h[same] = 0
        return _bucket(h, 1), at


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text, ascending, and how often each occurs; one of them is a feature that every text has."""
    counts = np.bincount([0], minlength=BUCKETS)
    for piece, carried in _pieces(text):
        w = Words.of([piece])
        times = np.bincount(w.sequence[int(carried) :], minlength=len(w.hashes))
        counts += np.bincount(_bucket(w.hashes, 0), times, BUCKETS).astype(np.int64)
        counts += np.bincount(w.gram_bucket, times[w.gram_word], BUCKETS).astype(np.int64)
        counts += np.bincount(w.pairs()[0], minlength=BUCKETS)
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


@dataclass
class Model:
    """value: of each bucket, the difference of the two classes' products with its vector; bias likewise."""

    value: np.ndarray
    bias: float

    def scores(self, docs: list[bytes]) -> np.ndarray:
        """Probability of class 1 for each text; texts meet in groups of about PIECE bytes, and longer ones in pieces."""
        total, size = np.full(len(docs), self.value[0]), np.ones(len(docs))
        held: list[tuple[int, bytes, bool]] = []
        room = PIECE
        for k, d in enumerate(docs):
            for piece, carried in _pieces(d):
                if held and len(piece) > room:
                    self._add(held, total, size)
                    held, room = [], PIECE
                held.append((k, piece, carried))
                room -= len(piece)
        if held:
            self._add(held, total, size)
        return 1 / (1 + np.exp(-np.clip(total / size + self.bias, -500, 500)))

    def _add(self, held: list[tuple[int, bytes, bool]], total: np.ndarray, size: np.ndarray) -> None:
        """Adds the values and the number of the features of pieces to those of their texts.

        A piece that is carried on begins with the last word of the one before, which counts there.
        """
        w = Words.of([piece for _, piece, _ in held])
        n = len(w.hashes)
        words = self.value[_bucket(w.hashes, 0)] + np.bincount(w.gram_word, self.value[w.gram_bucket], n)
        count = 1.0 + np.bincount(w.gram_word, minlength=n)
        pair, at = w.pairs()
        value, number = words[w.sequence], count[w.sequence]
        first = w.begin[:-1][[carried for _, _, carried in held]]
        value[first] = number[first] = 0
        value[at] += self.value[pair]
        number[at] += 1
        full = np.flatnonzero(np.diff(w.begin))
        if len(full):
            of = np.array([k for k, _, _ in held])[full]
            np.add.at(total, of, np.add.reduceat(value, w.begin[full]))
            np.add.at(size, of, np.add.reduceat(number, w.begin[full]))


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in pieces of about PIECE bytes, cut where words end; each but the first begins with the last word before it."""
    begin, last = 0, b""
    while True:
        gap = _GAP.search(text, begin + PIECE) if len(text) - begin > PIECE else None
        piece = text[begin : gap.start()] if gap else text[begin:]
        yield (b"%b %b" % (last, piece) if last else piece), bool(last)
        if not gap:
            return
        begin, last = gap.start(), (piece.rsplit(None, 1) or [last])[-1]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 12, least_steps: int = 20_000, rate: float = 0.6, seed: int = 5) -> Model:
    """Fits vectors and softmax layer to (distinct buckets, their counts, label 0 or 1) rows, one row at a time.

    As many passes as it takes to make about least_steps steps, 4 at least and 60 at most.
    """
    epochs = min(60, max(4, least_steps // max(1, len(rows))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    layer, bias = np.zeros((2, dim)), np.zeros(2)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, counts, label = rows[k]
            weight = counts / counts.sum()
            hidden = weight @ vectors[buckets]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = rate * (1 - done / steps)
            back = p @ layer
            layer -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            vectors[buckets] -= weight[:, None] * (step * back)
            done += 1
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most `most` labelled documents, those with the lowest hashes of their ids.

    Rows without id or label are left out, and those with crc32(id) mod 5 = 0, which are held out. An id that stands
    there repeatedly counts once, with its highest label and one of its texts. Ids and labels of the sample (bounded)
    are broadcast; features are computed where the texts are. The driver takes FEATURE_BYTES of them at most: documents
    beyond, in the order of those hashes, are no part of the sample.
    """
    spark = docs.sparkSession
    label = F.when(F.col(label_col) >= 0.5, 1).otherwise(0)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (crc_mod(F.col(id_col), 5) != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = {r[0]: r[1] for r in sample.collect()}
    ids = spark.createDataFrame([(i,) for i in chosen], "id long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.concatenate(features(t)).astype("<u4").tobytes() for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "f"])

    found = materialize(map_rows(rows, run, "id long, f binary").groupBy("id").agg(F.min("f").alias("f")))
    sizes = dict(found.select("id", F.length("f")).toLocalIterator())
    fit = [i for i, end in zip(chosen, accumulate(sizes.get(i, 0) for i in chosen), strict=True) if end <= FEATURE_BYTES]
    found = found.join(F.broadcast(spark.createDataFrame([(i,) for i in fit], "id long")), "id", "left_semi")
    out = []
    for batch in found.toArrow().to_batches():
        for i, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            both = np.frombuffer(f.as_buffer(), "<u4").reshape(2, -1)
            out.append((i, both[0].astype(np.int32), both[1].astype(np.float32), chosen[i]))
    return [r[1:] for r in sorted(out, key=lambda r: r[0])]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Quality of every whole text, from a model of the labelled ones that aren't held out.

    Returns id_col, held_out (crc32(id) mod 5 = 0), score (0 to 1, of label 1), predicted (1 if score >= threshold), and
    the columns in `keep`, with an underscore at the end of names that results have. A null text counts as empty, and empty texts are scored too; a null id counts as empty text
    for held_out. Repeated rows get equal scores, ties are left as they are, an empty table gives no rows. Without any label the score is 0.5 everywhere. Other columns are
    never inputs of a score. Texts of any length are read whole, in pieces of PIECE bytes. The model, one number for each of 65536 buckets, goes to the workers with the function.
    """
    model = train(training_rows(docs, labels, most, id_col, text_col))
    packed = (model.value.astype(np.float64), model.bias)
    extra = [c for c in keep if c not in (id_col, text_col)]
    types = dict(docs.dtypes)
    names = [id_col, "held_out", "score", "predicted"]
    mine = [c for c in keep if c != id_col]
    kept_names = own_names(mine, names)
    ddl = f"`{id_col}` long, held_out boolean, score double, predicted int" + "".join(f", `{n}` {types[c]}" for n, c in zip(kept_names, mine, strict=True))
    names += kept_names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*packed)
        for b in batches:
            score = m.scores(list(texts(b.column(1))))
            held = pa.array([id_crc(i) % 5 == 0 for i in b.column(0).to_pylist()], pa.bool_())
            place = {text_col: 1} | {c: 2 + k for k, c in enumerate(extra)}
            kept = [b.column(place[c]) for c in mine]
            yield pa.RecordBatch.from_arrays([b.column(0), held, pa.array(score), pa.array((score >= threshold).astype(np.int32)), *kept], names)

    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_col, *extra), run, ddl)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
