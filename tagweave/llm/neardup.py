"""op2: near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature. One permutation, s, spreads the shingles of a document over the 32-bit numbers; a second one, p, is shifted
in a circle: coordinate k is the least p(s(x) - k) over the shingles x. So two permutations make all coordinates. p is
a bijective mixer of 32-bit numbers. Groups of ROWS coordinates form bands.

Links. Documents with equal shingle sets form a class, of which only the one with the smallest id goes on. In each
bucket (one value of one band) signatures tell which members may be near each other; edges that span those, less than
one a member, leave the bucket, and their components are families: every pair that a bucket shows and that signatures
allow lies in one family. Inside a family the full shingle sets are compared, but for pairs that links found before
have joined. Buckets and families of any size are searched in blocks of bounded size. So no link between components is
lost that a band shows, and no group emits its pairs. A bucket or family that is one component costs work in proportion
to its size; only rows outside a group's largest component meet all its others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import discard, map_rows, materialize, table, texts
from tagweave.operators.components import components

BANDS, ROWS = 32, 5
#: Elements of which signatures are computed at once: they stay in a core's cache.
CHUNK = 1 << 15
#: Members of a bucket, and texts of a family, that meet in one group; bytes of those texts.
BLOCK, FAMILY, FAMILY_BYTES = 2048, 512, 4 << 20
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_U = np.uint64


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(_ODD[1])
    h = (h ^ (h >> _U(27))) * _U(_ODD[2])
    return h ^ (h >> _U(31))


def shingle_sets(docs: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of `width` words; A-Z count as lower case.

    A text with fewer words has one shingle, all its words; one without words has none.
    """
    number: dict[bytes, int] = {}
    runs = [[number.setdefault(w, len(number)) for w in d.lower().split()] for d in docs]
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
    out = []
    for r in runs:
        h = words[r] if r else words[:0]
        n = max(1, len(h) - width + 1) if len(h) else 0
        take = min(width, len(h))
        g = np.full(n, take, np.uint64)
        for k in range(take):
            g = _mix64(g * _U(_ODD[0]) + h[k : k + n])
        out.append(np.unique(g))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of 32-bit coordinates for each set; sets must not be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    begin = 0
    while begin < len(sets):
        end, held = begin, 0
        while end < len(sets) and (end == begin or held + len(sets[end]) <= CHUNK):
            held += len(sets[end])
            end += 1
        starts = np.cumsum([0, *map(len, sets[begin : end - 1])])
        spread = (_mix64(np.concatenate(sets[begin:end]) + _U(_ODD[0])) >> _U(32)).astype(np.uint32)
        t, half = np.empty_like(spread), np.empty_like(spread)
        for k in range(coordinates):  # p(s(x) - k): the shifted permutation
            np.subtract(spread, np.uint32(k), out=t)
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(t, shift, out=half)
                np.bitwise_xor(t, half, out=t)
                np.multiply(t, np.uint32(factor), out=t)
            np.right_shift(t, 16, out=half)
            np.bitwise_xor(t, half, out=t)
            out[begin:end, k] = np.minimum.reduceat(t, starts)
        begin = end
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    out = np.tile(np.arange(bands, dtype=np.uint64) + _U(1), (len(sig), 1))
    for k in range(rows):
        out = _mix64(out * _U(_ODD[0]) + sig[:, k : bands * rows : rows].astype(np.uint64))
    return out.view(np.int64)


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_bytes, n_shingles, d1, d2, bands, signature) of (doc_id, text) rows; d1 and d2: digest of the shingle set.

    signature holds the lowest four bits of each coordinate. Texts without shingles have nulls.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = list(texts(b.column(1)))
            sets = shingle_sets(raw, width)
            full = [k for k, s in enumerate(sets) if len(s)]
            sig = signatures([sets[k] for k in full], bands * rows)
            keys = band_keys(sig, bands, rows).tolist()
            low = halves(sig)
            none: list = [None] * len(sets)
            columns = [list(none) for _ in range(4)]
            for at, k in enumerate(full):
                d = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64).tolist()
                columns[0][k], columns[1][k], columns[2][k], columns[3][k] = d[0], d[1], keys[at], low[at].tobytes()
            sizes = [pa.array(map(len, x), pa.int64()) for x in (raw, sets)]
            arrays = [b.column(0), *sizes, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[3:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return map_rows(docs, run, "doc_id long, n_bytes long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary")


def halves(sig: np.ndarray) -> np.ndarray:
    """The lowest four bits of each coordinate, two in a byte; an odd number of coordinates gets one that is 0."""
    low = (np.pad(sig, ((0, 0), (0, sig.shape[1] % 2))) & 15).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << 4


def _merge(labels: np.ndarray, into: int, others: np.ndarray) -> None:
    labels[np.isin(labels, others)] = into


def forest(sig: np.ndarray, n: np.ndarray, labels: np.ndarray, least: int, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that join the components of rows whose signatures agree in `least` coordinates and whose sizes may match.

    Rows with equal labels are joined already. sides: only pairs of unlike sides are looked at.
    """
    labels, out = labels.copy(), []
    for p in range(len(sig) - 1):
        q = p + 1 + np.flatnonzero(labels[p + 1 :] != labels[p])
        if sides is not None:
            q = q[sides[q] != sides[p]]
        q = q[100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p])]
        q = q[(sig[q] == sig[p]).sum(axis=1) >= least]
        if len(q):
            met, first = np.unique(labels[q], return_index=True)
            out += [(p, x) for x in q[first].tolist()]
            _merge(labels, labels[p], met)
    return out


def exact_links(sets: list[np.ndarray], sig: np.ndarray, labels: np.ndarray, least: int, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join all rows which links join, given labels of rows that are joined already.

    Every pair with unlike labels whose sizes and signatures allow it is tested on the full sets, unless links found
    before have joined it. sides: only pairs of unlike sides are looked at.
    """
    labels, out = labels.copy(), []
    n = np.array([len(s) for s in sets])
    for p in range(len(sets) - 1):
        q = p + 1 + np.flatnonzero(labels[p + 1 :] != labels[p])
        if sides is not None:
            q = q[sides[q] != sides[p]]
        q = q[100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p])]
        for x in q[(sig[q] == sig[p]).sum(axis=1) >= least].tolist():
            if labels[x] != labels[p]:
                both = len(np.intersect1d(sets[p], sets[x], assume_unique=True))
                if 100 * both >= percent * (n[p] + n[x] - both):
                    out.append((p, x))
                    _merge(labels, labels[p], labels[x : x + 1])
    return out


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _segments(t: pa.Table, by: tuple[str, ...]) -> Iterator[np.ndarray]:
    """Row numbers of each group of equal values in `by`."""
    columns = [t.column(c).to_numpy() for c in by]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new)[1:]) if len(order) else ()


def _signatures(t: pa.Table) -> np.ndarray:
    """A row of four-bit coordinates for each signature; their order is of no matter."""
    both = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("signature")])
    return np.hstack([both & 15, both >> 4]) if len(both) else both


def _pairs(rep: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    at = np.array(found, np.int64).reshape(-1, 2)
    return pa.table([pa.array(np.minimum(rep[at[:, 0]], rep[at[:, 1]])), pa.array(np.maximum(rep[at[:, 0]], rep[at[:, 1]]))], schema=PAIRS)


def _dealt(rows: DataFrame, group: str, units: int) -> DataFrame:
    """rows with i, the block of their group that they are dealt to, and unit; groups of one block share units."""
    i = F.pmod(F.xxhash64("rep", group), "blocks").cast("int")
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(max(1, units)))).otherwise(F.xxhash64(group, "i"))
    return rows.withColumn("i", i).withColumn("unit", unit).withColumn("j", F.lit(0)).withColumn("side", F.lit(0))


def _labelled(rows: DataFrame, now: DataFrame) -> DataFrame:
    """rows with comp, the component of their rep in `now` (node, component); a rep that isn't there is its own."""
    named = now.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return rows.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _outside(rows: DataFrame, group: str, most: int, scrap: list[DataFrame]) -> DataFrame:
    """Each group's rows outside its largest component so far, dealt into parts, that meet every row of the group.

    rows: (group, rep, blocks, comp, ...). Where a group is one component there are none and nothing is returned.
    """
    counts = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy(group).agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("c")).filter("m > c")
    main = materialize(main.select(group, "main", F.ceil((F.col("m") - F.col("c")) / most).cast("int").alias("parts")))
    scrap.append(main)
    rows = rows.join(main, group).withColumn("i", F.pmod(F.xxhash64("rep", group), "blocks").cast("int"))
    body = rows.withColumn("side", F.lit(0)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    few = rows.filter("comp <> main").withColumn("side", F.lit(1)).withColumn("j", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int"))
    few = few.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return body.unionByName(few.select(*body.columns)).withColumn("unit", F.xxhash64(group, "i", "j"))


def _searched(rows: DataFrame, group: str, units: int, most: int, filled, test, scrap: list[DataFrame]) -> DataFrame:
    """(node, component) under the edges (a, b) that `test` finds in groups of any size: all rows meet that any two can join.

    First every block of a group is searched by itself. Of groups of several blocks, one row of each component so far
    meets those of the others, again and again while that joins components; at last their rows outside the largest
    component meet all others. So the work grows in proportion to a group that is one component, however large: all of
    its rows travel once. A group emits less than one edge a row and step and not its pairs. filled(rows) adds to
    (group, rep, blocks) rows what `test` needs to have of them.
    """

    def found(dealt: DataFrame) -> DataFrame:
        return dealt.groupBy("unit").applyInArrow(test, "a long, b long")

    def joined(now: DataFrame, edges: DataFrame) -> DataFrame:
        return table_of(components(now.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(edges)), scrap)

    rows = table_of(rows, scrap)
    now = table_of(components(found(_dealt(filled(rows), group, units).withColumn("comp", F.col("rep")))), scrap)
    large = table_of(rows.filter("blocks > 1"), scrap)
    if large.isEmpty():
        return now
    before = large.count()  # a step that would deal the same rows again is left out
    while True:
        lead = _labelled(large, now).groupBy(group, "comp").agg(F.min("rep").alias("rep"))
        several = lead.groupBy(group).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        lead = table_of(lead.join(several, group).withColumn("blocks", F.ceil(F.col("m") / most).cast("int")).drop("m"), scrap)
        n = lead.count()
        if not n:
            return now
        if n > 0.9 * before:
            break
        before = n
        now = joined(now, found(_dealt(filled(lead), group, math.ceil(n / most))))
    return joined(now, found(filled(_outside(_labelled(large, now), group, most, scrap))))


def table_of(df: DataFrame, scrap: list[DataFrame]) -> DataFrame:
    """df, written; the table goes with the scrap."""
    scrap.append(materialize(df))
    return scrap[-1]


def strong(shared: DataFrame, sizes: DataFrame, reps: DataFrame, least: int, percent: int, scrap: list[DataFrame]) -> DataFrame:
    """(node, component): families, which join bucket by bucket the members whose signatures agree in `least` coordinates.

    shared: (key, rep); sizes: (key, m). A bucket of more than BLOCK members is dealt into blocks.
    """
    rows = shared.join(sizes.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key")
    units = math.ceil((sizes.filter(F.col("m") <= BLOCK).agg(F.sum("m")).first()[0] or 0) / BLOCK)

    def filled(rows: DataFrame) -> DataFrame:
        return rows.join(reps.select("rep", "signature", "n_shingles"), "rep")

    def spans(t: pa.Table) -> pa.Table:
        rep, n, sig = t.column("rep").to_numpy(), t.column("n_shingles").to_numpy(), _signatures(t)
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        found = []
        for k in _segments(t, ("key", "i", "j")):
            sides = side[k] if side[k].any() else None
            found += [(k[x], k[y]) for x, y in forest(sig[k], n[k], comp[k], least, percent, sides)]
        return _pairs(rep, found)

    return _searched(rows, "key", units, BLOCK, filled, spans, scrap)


def verified(families: DataFrame, reps: DataFrame, docs: DataFrame, width: int, least: int, percent: int, scrap: list[DataFrame]) -> DataFrame:
    """(node, component) under exact links, which are looked for in families (node, component).

    Texts of families are taken out once, so that no step moves the others again; each travels to its block of its family.
    Blocks are bounded by rows and by bytes.
    """
    named = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(reps.select("rep", "n_bytes"), "rep")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY, F.sum("n_bytes") / FAMILY_BYTES)).cast("int")
    sizes = table_of(named.groupBy("family").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m"), F.sum("n_bytes").alias("bytes")), scrap)
    rows, size = sizes.agg(F.sum("m"), F.sum("bytes")).first()
    every = docs.select(F.col("doc_id").alias("rep"), "text").filter("rep IS NOT NULL")
    members = table_of(every.join(named.select("rep").hint("merge"), "rep").join(reps.select("rep", "signature"), "rep"), scrap)

    def filled(rows: DataFrame) -> DataFrame:
        return rows.join(members, "rep")

    def test(t: pa.Table) -> pa.Table:
        rep, sig = t.column("rep").to_numpy(), _signatures(t)
        sets = shingle_sets([x.as_buffer().to_pybytes() if x.is_valid else b"" for x in t.column("text")], width)
        comp, side = t.column("comp").to_numpy(), t.column("side").to_numpy()
        found = []
        for k in _segments(t, ("family", "i", "j")):
            sides = side[k] if side[k].any() else None
            found += [(k[x], k[y]) for x, y in exact_links([sets[q] for q in k], sig[k], comp[k], least, percent, sides)]
        return _pairs(rep, found)

    units = math.ceil(max((rows or 0) / FAMILY, (size or 0) / FAMILY_BYTES))
    return _searched(named.drop("n_bytes").join(sizes.select("family", "blocks"), "family"), "family", units, FAMILY, filled, test, scrap)


def one_text(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with each id once, by its smallest text, rows without id as they are; the ids that stood there repeatedly."""
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = materialize(again)
    if again.isEmpty():
        discard(again)
        return docs, None
    least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(least), again


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", unique: bool = False
) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row: components of links with Jaccard of percent / 100 or more.

    Words are separated by ASCII white space, A-Z lower-cased; a document's set holds its distinct shingles of `width`
    words, or all its words as one where it has fewer. A null or empty text has no shingles and no link. component_id
    is the smallest id that links reach, kept tells whether it is the row's own. Rows with a null id are linked with
    nothing: component_id null, kept false. Rows that repeat an id are one document, by the smallest of its texts; each
    gets its row; unique tells that there are none. Other columns are ignored; an empty table gives no rows. Texts of any
    length are read whole. Set sizes come from 64-bit hashes of shingles.

    Two steps are not exact. A pair at 80 % shares no band with a chance of 3 in a million (at 85 %, 1 in 100 million).
    And before full sets are compared, lowest bytes of signatures must agree in as many coordinates as a pair at
    `percent` has less five standard deviations: of 12000 made-up pairs at 80 to 82 % none had fewer.
    """
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    flat, again = (flat, None) if unique else one_text(flat)
    scrap: list[DataFrame] = []
    every = materialize(sketch(flat, width, bands, rows))
    known = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    copies = table_of(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep < last").select("d1", "d2", "rep"), scrap)
    copied = materialize(known.select("doc_id", "d1", "d2").join(copies, ["d1", "d2"]).filter("doc_id <> rep").select("doc_id", "rep"))
    reps = table_of(known.join(copied.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), "n_bytes", "n_shingles", "bands", "signature"), scrap)

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = table_of(keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("m")).filter("low < high").select("key", "m"), scrap)
    shared = keyed.join(sizes.select("key"), "key", "left_semi")
    coordinates, s = bands * rows, percent / 100
    least = math.floor(s * coordinates - 5 * math.sqrt(coordinates * s * (1 - s)))
    families = strong(shared, sizes, reps, least, percent, scrap)
    found = verified(families, reps, flat, width, least, percent, scrap)
    discard(*(t for t in scrap if t is not found))

    named = every.select("doc_id", "n_shingles").join(copied, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = named.join(found, named["rep"] == found["node"], "left").withColumn("component_id", F.coalesce("component", "rep"))
    if again is not None:
        out = out.join(again, "doc_id", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS ss FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
m AS (SELECT s.doc_id, c.rep FROM s JOIN c ON list_sort(s.sh) = c.ss),
e AS (SELECT rep, len(ss) AS n, unnest(ss) AS g FROM c),
l AS (
  SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, reach) AS (SELECT rep, rep FROM c UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(min(r.reach), s.doc_id) AS component_id,
  coalesce(min(r.reach), s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN m ON s.doc_id = m.doc_id LEFT JOIN r ON m.rep = r.node
GROUP BY s.doc_id, len(s.sh)
"""
