"""op7: media columns as interleaved document sequences.

An HTML document becomes an ordered list of items: runs of text, and references to media with their alternative text
and caption. A reference names its payload by digest (src="sha256:<hex>"). Payloads lie once each in a media table,
as losslessly compressed 8-bit grey images; a join on the digest resolves the references, and each item keeps its
position and caption, whatever order the join returns.

A text becomes such a document: its runs stand in turn with references to the images that hold its payload, one for
each PART bytes. What the query tells of a payload is read back from the stored images in the order of their positions.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import map_rows, materialize, own_names, table, texts
from tagweave.llm.markup import Markup

#: Samples in a row of a stored image, and the unit that payloads are filled up to (24 rows).
WIDTH, UNIT, FILL = 24, 576, b"\xff"
#: Bytes of a payload in one image at most: a multiple of UNIT.
PART = 113 * UNIT
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,url:string,alt:string,caption:string>"
_PNG = b"\x89PNG\r\n\x1a\n"
#: Elements whose content is no text, that are media, and that end a run of text.
SILENT = {"script", "style", "template", "head", "noscript"}
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source", "embed": "embed"}
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


class _Sequence(Markup):
    """Collects items in reading order; a figure's caption goes to all media of that figure."""

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.figures: list[int] = []  # number of the first item of each open figure
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            self.items.append({"kind": "text", "text": text})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in BLOCKS or tag == "br":
            (self.caption if self.caption is not None else self.run).append(" ")
            if self.caption is None and tag != "br":
                self.flush()
        if tag == "figure":
            self.figures.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            src = a.get("src") or ""
            if src:
                self.flush()
                digest = src[len(SCHEME) :].lower() if src.startswith(SCHEME) else None
                self.items.append({"kind": MEDIA[tag], "digest": digest, "url": src, "alt": a.get("alt")})

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            return
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figures[-1] if self.figures else len(self.items) :]:
                if item["kind"] != "text":
                    item["caption"] = text
        elif tag in BLOCKS and self.caption is None:
            self.flush()
        if tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.caption if self.caption is not None else self.run).append(data)


def interleaved(page: str) -> list[dict]:
    """The items of one page, numbered from 0."""
    p = _Sequence()
    p.feed(page)
    if p.caption is not None:  # a caption that never ends is text
        p.run += p.caption
    p.flush()
    empty = dict.fromkeys(("text", "digest", "url", "alt", "caption"))
    return [{"position": k} | empty | item for k, item in enumerate(p.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, items (array of structs in reading order) and `keep` for every page.

    A null or empty page has no items; repeated rows give repeated results, an empty table none. A kept column that is
    called like a result gets an underscore at the end of its name.
    """
    types = dict(pages.dtypes)
    names = own_names(keep, (id_col, "items"))
    item = pa.list_(pa.struct([("position", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "digest", "url", "alt", "caption"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([interleaved(x or "") for x in b.column(1).to_pylist()], item)
            yield pa.RecordBatch.from_arrays([b.column(0), items, *b.columns[2:]], [id_col, "items", *names])

    return map_rows(pages.select(id_col, html_col, *keep), run, f"`{id_col}` {types[id_col]}, items array<{ITEM}>" + "".join(f", `{n}` {types[c]}" for n, c in zip(names, keep, strict=True)))


def resolve(sequences: DataFrame, media: DataFrame, columns: tuple[str, ...], id_col: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per item, with `columns` of the media table where its digest is found there, else null.

    media has a row for each digest. The join is on the digest alone: many references to one payload are a skewed join,
    which Spark splits. Rows keep id and position, by which `gathered` puts them in order again.
    """
    items = sequences.select(id_col, *keep, F.explode("items").alias("item")).select(id_col, *keep, "item.*")
    return resolve_items(items, media, columns)


def resolve_items(items: DataFrame, media: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Item rows with `columns` of the media table by their digests. Runs of text, which have none, take no part in the join."""
    held = media.select("digest", *columns)
    found = items.filter("digest IS NOT NULL").join(held, "digest", "left")
    nothing = {c: F.lit(None).cast(held.schema[c].dataType) for c in columns}
    return found.unionByName(items.filter("digest IS NULL").withColumns(nothing).select(*found.columns))


def gathered(items: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Resolved items as one row per document again, in order of position."""
    rest = [c for c in items.columns if c not in (id_col, "position")]
    return items.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", *rest))).alias("items"))


def to_image(payload: bytes) -> bytes:
    """A grey PNG of WIDTH columns; the payload's length is a multiple of UNIT."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(stored: bytes) -> np.ndarray:
    """Samples of an image that to_image wrote, one row a line; raises where it is damaged."""
    if stored[:8] != _PNG:
        raise ValueError("not an image of this store")
    at, data, shape = 8, [], (0, 0)
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a histogram of 8 bins in thousandths, and an average hash of 8 by 8 areas."""
    flat = samples.ravel()
    count = np.bincount(flat, minlength=256)
    values = np.arange(256)
    mean = int((count * values).sum()) / len(flat)
    dev = max(0.0, int((count * values * values).sum()) / len(flat) - mean * mean) ** 0.5
    bins = count.reshape(8, 32).sum(axis=1) * 1000 // len(flat)
    edge = np.arange(8) * len(samples) // 8
    areas = np.add.reduceat(samples.reshape(len(samples), 8, -1).sum(axis=2, dtype=np.int64), edge, axis=0) / np.diff(np.r_[edge, len(samples)])[:, None]
    bits = np.packbits((areas > areas.mean()).ravel()).tobytes().hex()
    return f"mean={mean:.4f};dev={dev:.4f};hist={','.join(map(str, bins.tolist()))};ahash={bits}"


def payload_of(text: bytes) -> bytes:
    """A text's bytes, filled up to a positive multiple of UNIT."""
    return text + FILL * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def page_of(text: str, digests: list[str]) -> str:
    """A page of the text's runs, each with the image of one part of its payload, captioned by its number."""
    n, cut = len(digests), [k * len(text) // len(digests) for k in range(len(digests) + 1)]
    parts = (
        f'<p>{html.escape(text[cut[k] : cut[k + 1]], False)}</p><figure><img src="{SCHEME}{d}" alt="bytes from {k * PART}"><figcaption>part {k + 1} of {n}</figcaption></figure>'
        for k, d in enumerate(digests)
    )
    return f"<article>{''.join(parts)}</article>"


def sequence_sha256(items: list[dict]) -> str:
    """A digest of all items in order: their kinds, runs of text, references and captions."""
    parts = (f"{i['kind']}\x1f{i['text'] or ''}\x1f{i['digest'] or ''}\x1f{i['caption'] or ''}\x1e" for i in items)
    return hashlib.sha256("".join(parts).encode()).hexdigest()


REFERENCE = pa.struct([("position", pa.int32()), ("digest", pa.string()), ("caption", pa.string())])
IMAGE = pa.struct([("digest", pa.string()), ("media", pa.binary()), ("several", pa.bool_())])


def stored_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, n_items, sequence_sha256, refs, images) of every text.

    Items and digest are those of its page, runs of text and media in turn; refs are its media references, images those
    that hold its payload.

    An image that a task has stored before isn't stored again, which is most of a group of copies. Images of payloads with
    several parts are marked and stored for themselves, so that they are found without a look at all others.
    """
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int64()), ("sequence_sha256", pa.string()), ("refs", pa.list_(REFERENCE)), ("images", pa.list_(IMAGE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bool]] = set()  # 16 bytes of digest each
        for b in batches:
            sizes, numbers, told, refs, images = [], [], [], [], []
            for t in texts(b.column(1)):
                payload, digests, fresh = payload_of(t), [], []
                for at in range(0, len(payload), PART):
                    part = payload[at : at + PART]
                    digest = hashlib.sha256(part)
                    digests.append(digest.hexdigest())
                    key = digest.digest()[:16], len(payload) > PART
                    if key not in seen:
                        seen.add(key)
                        fresh.append({"digest": digests[-1], "media": to_image(part), "several": key[1]})
                items = interleaved(page_of(t.decode("utf-8", "replace"), digests))
                sizes.append(len(t))
                numbers.append(len(items))
                told.append(sequence_sha256(items))
                refs.append([{k: i[k] for k in ("position", "digest", "caption")} for i in items if i["kind"] == "image"])
                images.append(fresh)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array(told, pa.string()), pa.array(refs, pa.list_(REFERENCE)), pa.array(images, pa.list_(IMAGE))], schema=schema)

    ddl = f"`{id_col}` long, n_bytes long, n_items long, sequence_sha256 string, refs array<struct<position:int,digest:string,caption:string>>, images array<struct<digest:string,media:binary,several:boolean>>"
    return map_rows(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), run, ddl)


TOLD = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(stored: list[bytes]) -> tuple[int, str, int, int, str, str]:
    """The values of TOLD of a payload whose parts' images these are, in order."""
    samples = np.concatenate([from_image(s) for s in stored])
    payload = samples.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), sum(map(len, stored)), hashlib.sha256(b"".join(stored)).hexdigest(), feature(samples)


def _told(keys: list, name: str, kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(name, kind), *(pa.field(f.split()[0], types[f.split()[1]]) for f in TOLD.split(", "))]
    columns = zip(*rows, strict=True) if rows else [()] * (len(fields) - 1)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, f.type) for c, f in zip(columns, fields[1:], strict=True))], schema=pa.schema(fields))


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes of each digest hold, read back: one row per digest of (digest, media) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _told(b.column(0).to_pylist(), "digest", pa.string(), [read_back([m]) for m in texts(b.column(1))])

    return map_rows(media, run, f"digest string, {TOLD}").dropDuplicates(["digest"])


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a payload of media columns: stored, referred to, resolved and read back.

    Returns id_col, n_bytes, n_items and sequence_sha256 (of its page's runs of text and images in order), payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and captions
    (of its references in order, joined by "; "). A null or empty text is a payload of UNIT fill bytes. A payload of more
    than PART bytes lies in several images, which come back in the order of their positions; media_bytes and
    media_sha256 are those of the images one after another. Equal texts share their stored images and have equal values;
    null ids stay null; repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    The images of one text meet in one task, and of no more than one text at a time. Equal texts are read back once.
    """
    whole = "whole" if id_col != "whole" else "_whole"
    made = materialize(stored_documents(docs, id_col, text_col))
    store = made.select(F.explode("images").alias("i")).select("i.*")
    own = ["n_bytes", "n_items", "sequence_sha256"]
    columns = [f.split()[0] for f in TOLD.split(", ")]

    one = made.filter(F.size("refs") == 1).select(id_col, *own, F.col("refs")[0].alias("r")).select(id_col, *own, "r.*")
    told = materialize(described(store.filter("NOT several").select("digest", "media")))
    single = resolve_items(one, told, columns).select(id_col, *own, *columns, F.col("caption").alias("captions"))
    several = made.filter(F.size("refs") > 1).select(id_col, *own, "refs", F.sha2(F.array_join("refs.digest", ""), 256).alias(whole))
    if several.isEmpty():
        return single

    parts = several.groupBy(whole).agg(F.first("refs").alias("refs")).select(whole, F.explode("refs").alias("r")).select(whole, "r.position", "r.digest")
    pieces = resolve_items(parts, store.filter("several").select("digest", "media").dropDuplicates(["digest"]), ["media"])

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("position")
        stored = [x.as_buffer().to_pybytes() for x in t.column("media")]
        return pa.Table.from_batches([_told([t.column(whole)[0].as_py()], whole, pa.string(), [read_back(stored)])])

    back = pieces.select(whole, "position", "media").groupBy(whole).applyInArrow(gather, f"{whole} string, {TOLD}")
    captions = F.array_join(F.transform(F.array_sort("refs"), lambda r: r["caption"]), "; ")
    heads = several.select(id_col, *own, whole, captions.alias("captions"))
    return single.unionByName(heads.join(back, whole).select(id_col, *own, *columns, "captions"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as media payloads."""
    return document_media(table(spark, sf_dir, "documents"))
