from pyspark.sql import functions as F

from tagweave.functions import fingerprint as fp
from tagweave.functions import text as tx
from tagweave.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    count = lambda t: one(spark, F.size(tx.tokens(F.col("t"))), t=t)
    assert count("Hello, world! This is a test.") == 6
    assert one(spark, tx.tokens(F.col("t")), t="Hello HELLO heLLo") == ["hello"] * 3
    assert count("Test 123 with 456 numbers") == 5 and count("你好，世界！Hello, World!") == 4
    assert count("") == 0 and count("  \n") == 0 and count("a_b") == 2


def test_hamming(spark):
    d = lambda a, b: one(spark, fp.hamming(F.col("a"), F.col("b")), a=a, b=b)
    assert d(5, 5) == 0 and d(0, -1) == 64 and d(0, 1) == 1 and d(0xAAAA, 0x5555) == 16 == d(0x5555, 0xAAAA)
    assert one(spark, fp.weight(F.col("a")), a=0b1010101010101010) == 8
    assert one(spark, fp.similarity(F.col("a"), F.col("b")), a=0, b=0xFFFFFFFF) == 0.5
    assert one(spark, fp.from_hex(fp.hex_form(F.col("a"))), a=-77) == -77 and one(spark, fp.from_hex(F.col("t")), t="zz") == 0


def test_simhash(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "world  HELLO!"), (3, ""), (4, None), (5, "hello")], "doc_id long, text string")
    for mode in ("xxhash64", "md5"):
        got = dict(fp.simhash(docs, mode=mode).collect())
        assert got[1] == got[2] and got[3] == got[4] == 0 and got[5] != 0
        assert fp.simhash_of(["hello", "world"], spark, mode) == got[1]
    assert dict(fp.simhash_bytes(docs).collect())[5] == 0


def test_hamming_pairs_are_all_pairs(spark):
    import random

    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(20)]
    values = [b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(7))) for b in base for _ in range(6)]
    rows = list(enumerate(values))
    reps = {}
    for i, v in rows:
        reps.setdefault(v, i)
    want = {(min(i, j), max(i, j)) for v, i in reps.items() for w, j in reps.items() if i < j and (v ^ w).bit_count() <= 5}
    prints = spark.createDataFrame(rows, "doc_id long, simhash long")
    for blocks in (None, 7, 8):
        assert {(a, b) for a, b, _ in fp.hamming_pairs(prints, 5, blocks).collect()} == want


def test_hamming_pairs_go_by_no_broadcast(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("simhash")).write.parquet(f"{tmp_path}/p")
    plan = fp.hamming_pairs(spark.read.parquet(f"{tmp_path}/p"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_transient(spark):
    t = lambda s: one(spark, tx.transient(F.col("t")), t=s)
    assert not t("npm WARN a\nnpm ERR! b\nadded 3 packages\nup to date")["is_transient"]  # four lines
    assert t("npm WARN a\nnpm ERR! b\nadded 3 packages\nup to date\nerror: x\r\n")["is_transient"]
    assert t("# Title\ntext\nmore\nerror: x\nend")["ratio"] == 0.2
    assert t("")["total"] == 0 and t(None)["total"] == 0


def test_atoms_cover_their_text(spark):
    text = "First paragraph.\n\nSecond.\n\n\nThird ünd last."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    got = tx.atoms(docs, "id", "text").orderBy("seq").collect()
    assert [r["content"] for r in got] == ["First paragraph.", "Second.", "Third ünd last."]
    assert all(text[r["char_start"] : r["char_end"]] == r["content"] for r in got)


def test_molecules(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\na\n## Two\nb\n#### no\n")], "id long, text string")
    assert [(r["header"], r["content"]) for r in tx.molecules(docs, "id", "text").orderBy("seq").collect()] == [(None, "intro\n"), ("One", "# One\na\n"), ("Two", "## Two\nb\n#### no\n")]


def test_repository(spark):
    r = lambda u: one(spark, files.repository(F.col("u")), u=u)
    assert (r("owner/repo")["owner"], r("owner/repo")["repo"], r("owner/repo")["ref"]) == ("owner", "repo", None)
    assert r("https://github.com/o/r/tree/main")["ref"] == "main" and r("https://github.com/o/r?x=1")["repo"] == "r"
    assert r("invalid") is None and r("https://gitlab.com/o/r") is None
    assert one(spark, files.tarball_url(files.repository(F.col("u"))), u="o/r") == "https://api.github.com/repos/o/r/tarball"


def test_paths(spark):
    b = lambda p: one(spark, files.bucket(F.col("p")), p=p)
    assert b("inbox/Code/file.md") == "Code" and b("external-inbox/docs/readme.txt") == "docs" and b("file.md") == "default"
    i = lambda p: one(spark, files.ignored(F.col("p")), p=p)
    assert i("a/node_modules/x") and i("target/x") and i("x.swp") and i(".gitignore")
    assert not i("document") and not i("code/README") and not i(".bashrc")


def test_settings():
    s = files.Settings()
    assert s.add_path("x") and not s.add_path("x") and files.Settings.load(s.dump()) == s and s.remove_path("x") and not s.remove_path("x")


def test_simhash_bytes_of_pieces(spark, monkeypatch):
    texts = [None, "", "short", "12345678", "é" * 4, "abcdefghi" * 40, "x" * 37, "0123456789abcdef" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = dict(map(tuple, fp.simhash_bytes(df).collect()))
    monkeypatch.setattr(fp, "PIECE", 16)
    assert dict(map(tuple, fp.simhash_bytes(df).collect())) == whole
    windows = [texts[5].encode()[k : k + 8].decode() for k in range(len(texts[5]) - 7)]
    hexed = spark.createDataFrame([(5, [w.encode().hex().upper() for w in windows])], "doc_id int, t array<string>")
    assert fp.simhash_tokens(hexed, "doc_id", "t").first()["simhash"] == whole[5] and whole[0] == whole[2] == 0


def test_simhash_of_hashes_by_python(spark, monkeypatch):
    import hashlib
    import random

    draw = random.Random(3)
    words = [*(f"w{k}" for k in range(90)), "über", "你好", "", None]
    rows = [(k % 40, draw.choices(words, k=draw.choice([0, 1, 5, 254, 255, 256, 700]))) for k in range(60)] + [(50, None), (51, []), (52, [None]), (53, ["a"] * 600), (54, [None, "a", "b"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>").coalesce(2)
    murmur = spark.createDataFrame([(w,) for w in [*words, "a", "b"] if w is not None], "t string").select("t", fp.token_hash(F.col("t"), "murmur3"))
    hashed = {"md5": lambda w: int.from_bytes(hashlib.md5(w.encode()).digest()[:8]), "murmur3": {t: h % (1 << 64) for t, h in murmur.collect()}.__getitem__}

    def brute(terms, mode):
        h = [hashed[mode](t) for t in terms if t is not None]
        value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        return value - (1 << 64) if value >> 63 else value

    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).extend(t or [])
    for mode in hashed:
        got = fp.simhash_tokens(df, "id", "t", mode)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each token
        assert dict(map(tuple, got.collect())) == {i: brute(t, mode) for i, t in texts.items()}
        monkeypatch.setattr(fp, "TOGETHER", 2)
        assert dict(map(tuple, fp.simhash_tokens(df, "id", "t", mode).collect())) == dict(map(tuple, got.collect()))
        monkeypatch.undo()
    strings = df.selectExpr("concat('n', id) AS id", "t")
    assert {i: h for i, h in fp.simhash_tokens(strings, "id", "t", "md5").collect() if i} == {f"n{i}": brute(t, "md5") for i, t in texts.items() if i is not None}
