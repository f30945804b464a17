"""Every column of the queries against brute force over whole texts, with long, repeated and odd ones added."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagweave.llm import media, pii
from tagweave.llm.neardup import near_duplicates
from tagweave.llm.registry import QUERIES
from tests.llm.test_llm_queries import brute_components
from tests.llm.test_llm_units import brute_base

FULL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The smallest tables with more documents: long, empty, null, repeated, and with clashing columns."""
    at = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long_ = " ".join(f"long{k % 977} é{k}" for k in range(30_000))
    rows = [(9001, long_, "en", "src1", 0), (9002, long_, "en", "src2", 0), (9003, "", "en", None, 0), (9004, None, None, "src1", None), (9005, "x" * 200_000, "en", "src1", 0),
            (9006, "a\x00b <b>&amp;   中日 𝔘", "en", "é", 0), (9007, "mail a@b.co, +1 (555) 555-2345 or 4539578763621486 at 10.0.0.1", "en", "src1", 0)]
    more = docs.unionByName(spark.createDataFrame(rows, FULL))
    more = more.withColumns({c: F.lit("clash") for c in ("n_tokens", "spans", "component_id", "media", "held_out", "size", "row", "score", "sequence_id", "redacted", "rep", "block")})
    more.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(tables):
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_op1(spark, tables, docs):
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, tables).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        base, r = brute_base(t), got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0]))) and r.n_spans == len(spans)
        assert [r.n_iban, r.n_ssn, r.n_secret] == [sum(k == kind for k, _, _ in spans) for kind in pii.OTHERS]


def test_op3(spark, tables, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op3_token_counts"](spark, tables).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        n = len(library.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_op4(spark, tables, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in docs.items()}
    rows = QUERIES["op4_packing"](spark, tables).collect()
    per, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    assert set(per) == set(docs)
    for i, pieces in per.items():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and sum(r.length for r in pieces) == len(ids[i])
    used = padded = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist() and n <= 2048
        used, padded = used + n, padded + (n if n & (n - 1) == 0 else 2048)
    assert used > 0.97 * padded


def test_op7(spark, tables, docs):
    got = {r.doc_id: r for r in QUERIES["op7_media_columns"](spark, tables).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        raw, r = t.encode(), got[i]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = [media.to_image(payload[k : k + media.PART]) for k in range(0, len(payload), media.PART)]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (sum(map(len, stored)), hashlib.sha256(b"".join(stored)).hexdigest())
        assert r.feature == media.feature(np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH))
        n, sequence = len(stored), []  # a run of text, if there is one, and an image in turn
        for k in range(n):
            run = " ".join((t or "")[k * len(t) // n : (k + 1) * len(t) // n].split())
            sequence += [f"text\x1f{run}\x1f\x1f\x1e"] * bool(run)
            sequence.append(f"image\x1f\x1f{hashlib.sha256(payload[k * media.PART : (k + 1) * media.PART]).hexdigest()}\x1fpart {k + 1} of {n}\x1e")
        assert (r.n_items, r.sequence_sha256) == (len(sequence), hashlib.sha256("".join(sequence).encode()).hexdigest())
        assert r.captions == "; ".join(f"part {k + 1} of {len(stored)}" for k in range(len(stored)))
    assert got[9001].captions.count("part") > 3 and got[9001][1:] == got[9002][1:]


def test_pages_interleave_runs_and_images():
    text = "one <b>two</b> &amp; three " * 9000
    digests = [f"{k:064x}" for k in range(4)]
    items = media.interleaved(media.page_of(text, digests))
    assert [i["kind"] for i in items] == ["text", "image"] * 4 and [i["digest"] for i in items[1::2]] == digests
    cut = [k * len(text) // 4 for k in range(5)]
    assert [i["text"] for i in items[::2]] == [" ".join(text[a:b].split()) for a, b in zip(cut, cut[1:], strict=False)]
    assert [i["position"] for i in items] == list(range(8)) and items[3]["caption"] == "part 2 of 4"


def test_op9(spark, tables, docs):
    source = {r["doc_id"]: r["source"] for r in pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "source"]).to_pylist()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in docs.items()}
    per = Counter()
    for i, n in size.items():
        per[source[i]] += n
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(per.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * per[s]}
        target.update({s: 2.0 * per[s] for s in above} if above else share)
        left -= sum(2 * per[s] for s in above)
        free = free - above if above else set()
    got = {r.doc_id: r for r in QUERIES["op9_mixing"](spark, tables).collect()}
    assert set(got) == set(docs)
    taken = Counter()
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], per[source[i]]) and abs(r.target - target[source[i]]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
        taken[source[i]] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(size[i] for i in docs if source[i] == s)


def test_op10(spark, tables, docs):
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, tables).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert got[9001].score == got[9002].score and got[9003].score == got[9004].score


def test_near_copies_of_one_bucket_grow_linearly(spark, monkeypatch):
    """Rows that leave the searches of one large family: in proportion to its size."""
    from tagweave.llm import neardup

    rng, base = np.random.default_rng(3), [f"w{k}" for k in range(200)]
    seen = []
    whole = neardup._searched

    def watched(rows, group, units, most, filled, test, scrap):
        def counted(r):
            seen.append(r.count())
            return filled(r)

        return whole(rows, group, units, most, counted, test, scrap)

    monkeypatch.setattr(neardup, "_searched", watched)
    monkeypatch.setattr(neardup, "BLOCK", 30)
    monkeypatch.setattr(neardup, "FAMILY", 20)
    rows = []
    for n in (120, 480):
        docs = []
        for k in range(n):
            w = list(base)
            w[int(rng.integers(200))] = f"m{k}"
            docs.append((k, " ".join(w)))
        seen.clear()
        got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), bands=6, unique=True)
        assert got.select("component_id").distinct().count() == 1
        rows.append(sum(seen))
    assert rows[1] < 5 * rows[0]


def test_ids_with_several_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w"), (None, "a b c d e f g"), (None, "a b c d e f g")]
    for _ in range(2):
        got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept, r.n_shingles) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()))
        assert got == [(0, 0, False, 6), (0, 0, False, 6), (1, 1, True, 6), (1, 1, True, 6), (2, 1, False, 6), (3, 3, True, 6)]


def odd_documents(spark):
    rows = [(1, "a b c d e f g h", "en", "s1", 8), (1, "a b c d e f g h", "en", "s1", 8), (None, "a b c d e f g h", "en", "s1", 8), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s1", 8),
            (3, "", None, None, None), (4, None, "en", "s2", None), (None, None, None, None, None), (5, "w " * 60_000, "en", "s2", 0), (6, "x@y.org", "en", "s2", 7), (7, "q", "é", "é", 1)]
    return spark.createDataFrame([(*r, "z", "z") for r in rows], FULL + ", row string, predicted string")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, sf, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    rows = stage(spark, docs, sf).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "near_dedup":  # exact repeats go, whatever their ids; rows without words stay
        assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, None: 1, 5: 1, 6: 1, 7: 1})
    elif name == "redact_pii":
        assert ids == Counter(r.doc_id for r in docs.collect()) and {r.text for r in rows if r.doc_id == 6} == {"[EMAIL]"}
    elif name == "pack_sequences":
        assert set(ids) == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    if name != "pack_sequences":
        assert stage(spark, docs, sf).columns == docs.columns
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_dedup_of_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, twice, sf).collect()]
    comp = brute_components([(d, (t or "").translate({c: c + 32 for c in range(65, 91)})) for d, t in docs.select("doc_id", "text").collect()], 5, 80)
    assert {i for i in kept if i is not None} == set(comp.values())
    assert len(kept) - len(set(kept)) <= 2 * 3 * sum(not (r.text or "").split() for r in docs.collect())


def test_repeated_rows_train_and_score_each_time(spark):
    from tagweave.llm.lm import score

    rows = [(None, "a b c")] * 40 + [(3, "a b d")] * 2 + [(3, "x y")] + [(4, None)] * 3 + [(5, "a b c")]
    got = Counter(tuple(r) for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(i, [*(t or "").encode().split(), b""]) for i, t in rows]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, ws in want if not held[i] for w in ws)
    assert sum(got.values()) == len(rows) and {r[4] for r in got} == {sum(c.values())}
    assert Counter((r[0], r[1], r[2], r[3]) for r in got.elements()) == Counter((i, held[i], len(ws), sum(w in c for w in ws)) for i, ws in want)
    assert all(abs(r[7] - r[6] / r[2]) < 1e-12 for r in got)


def test_token_hashes_and_packing_of_arrays():
    from tagweave.llm import lm

    rng = np.random.default_rng(4)
    for top in (1 << 20, 1 << 40, (1 << 64) - 1):
        keys = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        counts = rng.integers(0, 300, len(keys))
        a, b = lm.pack(keys, counts)
        assert (lm.unpack_keys(a) == keys).all() and (lm.unpack_counts(b) == counts).all()
    assert len(lm.unpack_keys(lm.pack(keys[:0], counts[:0])[0])) == 0
    edge = lm.bucket_edges(keys, 5, lm.TOKEN_BITS)
    assert edge[0] == 0 and edge[-1] == len(keys) and (np.diff(edge) >= 0).all()


def test_op7_images_of_several_parts_are_stored_for_themselves(spark):
    """So that reading them back needs no look at the images of all other texts; an equal image of a single part is another row."""
    from tagweave.llm.media import PART, document_media, from_image, payload_of, stored_documents

    part = "ab" * (PART // 2)
    docs = spark.createDataFrame([(1, part), (2, part + "tail"), (3, part + "tail"), (4, "tail")], "doc_id long, text string").coalesce(1)
    images = [i for r in stored_documents(docs, "doc_id", "text").collect() for i in r.images]
    assert sorted((from_image(i.media).size, i.several) for i in images) == [(576, False), (576, True), (PART, False), (PART, True)]
    got = {r.doc_id: r for r in document_media(docs).collect()}
    assert {k: r.payload_bytes for k, r in got.items()} == {1: PART, 2: PART + 576, 3: PART + 576, 4: 576}
    assert got[2].payload_sha256 == hashlib.sha256(payload_of((part + "tail").encode())).hexdigest() and got[2][1:] == got[3][1:]
    assert got[2].captions == "part 1 of 2; part 2 of 2"
