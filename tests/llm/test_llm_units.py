"""The operators' Python parts against brute force."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from tagweave.llm import html_text, lm, media, mixing, neardup, packing, pii, quality, topk
from tagweave.llm.ragged_bpe import PieceModel, count_tokens
from tagweave.llm.token_counts import pretokens


def test_token_counts_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model, r = sentencepiece.SentencePieceProcessor(model_file=path), PieceModel(path), random.Random(1)
    for _ in range(1500):
        letters = r.choice(["ab ", "a", " \n\taé½ﬁ中日▁<s>x\0", "thequickbrown ", "     a", "0123 .,", "<s></s>x ", "==--  //"])
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert int(sum(count_tokens(pretokens(t), model))) == len(library.encode(t)), t
    for t in ("a" * 5000, "".join(r.choice("etaoin") for _ in range(3000)), " " * 999):  # long sequences
        assert int(sum(count_tokens(pretokens(t), model))) == len(library.encode(t))


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


def test_base_spans():
    r = random.Random(4)
    for _ in range(5000):
        letters = r.choice(["a.@1 -+é", "0123456789 -", "1.2.3.255", "+1 (23)-.4", "ab@c.d-e@", "@@a.b"])
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_base(t), t


def test_candidate_models_on_unseen_sentences():
    trained, r = pii.models(), random.Random(99)
    right = []
    for _ in range(800):
        text, kind, a, b, label = pii._made_up(r)
        m = trained[kind]
        right.append((m.probability(np.array([pii.candidate_features(kind, text, a, b)], float))[0] >= m.threshold) == bool(label))
    assert np.mean(right) > 0.95
    text = 'write a@b.co token = "0cb1a9fee807a05366fcb8b6c95c7c565ede51a7" or 1.2.3.4'
    base, every = pii.find(text, trained)
    assert set(base) < set(every) and pii.redacted(text, every) == 'write [EMAIL] token = "[SECRET]" or [IP]'
    assert pii.find("The plain text has 3 numbers and 2 words.", trained) == ([], [])


def test_recall_on_formats_that_no_model_has_seen():
    """Planted finds in formats and sentences that are not those of the training rows, and look-alikes."""
    trained, r = pii.models(), random.Random(77)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    of = lambda s, n: "".join(r.choice(s) for _ in range(n))
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    every = low + low.upper() + "0123456789"
    told = "please find below the record of our customer from last week as noted in a letter that she sent to us".split()

    def iban(country, n):
        body = d(n)
        return f"{country}{98 - int(body + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02d}{body}"

    planted = {
        "email": (("", "reach me at ", "E-Mail: "), (lambda: f"{of(low, 5)}.{of(low, 6)} (at) {of(low, 7)} (dot) net", lambda: f"{of(low, 6)}[at]{of(low, 5)}[dot]co[dot]uk", lambda: f"jürgen.{of(low, 6)}@{of(low, 8)}.de")),
        "ip": (("", "from host "), (lambda: "fe80::" + ":".join(of(hexa, 4) for _ in range(3)),)),
        "phone": (("Tel. ", "call ", ""), (lambda: f"0{d(3)}/{d(6)}", lambda: f"00{d(2)} {d(2)} {d(4)} {d(3)}", lambda: f"({d(3)}) {d(3)}-{d(4)}")),
        "iban": (("IBAN ", "", "account "), (lambda: iban("AT", 16), lambda: iban("ES", 20))),
        "ssn": (("SSN ", "social security number ", ""), (lambda: f"{r.randrange(100, 665)}-{d(2)}-{d(4)}",)),
        "secret": (('token = "', "api_key: ", "AWS_SECRET_ACCESS_KEY=", "Authorization: Bearer ", "password is "), (lambda: "AKIA" + of(every.upper(), 15) + "7", lambda: "ghp_" + of(every, 36) + "1", lambda: of(hexa, 64), lambda: "eyJ" + of(every + "_-", 160) + "1", lambda: of(every + "+/", 43) + "2=")),
    }
    said = lambda: " ".join(r.choice(told) for _ in range(r.randrange(3, 12)))
    for kind, (leads, forms) in planted.items():
        hits = []
        for k in range(120):
            s, lead = forms[k % len(forms)](), r.choice(leads)
            text = f"{said()} {lead}{s}{lead[-1:] if lead.endswith(chr(34)) else ''} {said()}"
            at = text.index(s)
            hits.append(sum(max(0, min(at + len(s), b) - max(at, a)) for _, a, b in pii.find(text, trained)[1]) >= 0.9 * len(s))
        assert np.mean(hits) >= 0.9, kind
    other = (lambda: f"order {d(16)}", lambda: f"version {d(1)}.{d(2)}.{d(3)}", lambda: f"at 12:{d(2)}:{d(2)}", lambda: f"build {of(hexa, 40)}", lambda: f"isbn 978-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"on 2019-03-1{d(1)}", lambda: f"http://x.org/{of(low, 8)}/{of(low, 12)}-{d(4)}")
    wrong = [bool(pii.find(f"{said()} {other[k % len(other)]()} {said()}", trained)[1]) for k in range(420)]
    assert np.mean(wrong) <= 0.05


def test_generators_run_by_what_they_need():
    trained, r = pii.models(), random.Random(5)
    for t, found in (("write to anna (at) firma (dot) org today", "anna (at) firma (dot) org"), ("anna[at]firma[dot]org", "anna[at]firma[dot]org")):
        assert [(k, t[a:b]) for k, a, b in pii.find(t, trained)[1]] == [("email", found)]
    assert [k for k, _, _ in pii.candidates("host fe::abc up")] == ["ip"] and not list(pii.candidates("no such thing (here)"))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for n, at in ((20, 0), (129, 3), (600, 500), (33, 30), (2000, 1999)):
        key = "".join(r.choice(letters) for _ in range(n))
        key = f"{key[:at]}7{key[at:]}"
        t = f'the token = "{key}" is'
        assert [(k, t[a:b]) for k, a, b in pii.find(t, trained)[1]] == [("secret", key)], n
    assert not list(pii.candidates("a" * 40 + " 7"))  # the digit must be in the run
    assert list(pii.candidates("a" * 300_000 + "1===")) == []
    for n in (70, 400):  # names and labels of any length
        t = f"to {'a' * n}(at){'b' * n}.{'c' * n}.{'.'.join('xyzuvw')}.org now"
        assert [(k, t[a:b]) for k, a, b in pii.candidates(t)] == [("email", t[3:-4])]


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, whole, r = packing.WordIds(path), Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(r.choice("abÀé's 'll't9.#\ńİΣ中<|") for _ in range(r.randint(0, 60))) for _ in range(800)] + ["a <|endoftext|> b", "<|endoftext|>x", ""]
    for t, got in zip(texts, words.of([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_packer_keeps_every_id_once():
    r = random.Random(3)
    packer, docs, out = packing.Packer(64, 2), {}, []
    for k in range(300):
        docs[k] = np.arange(r.choice([1, 3, 20, 33, 64, 65, 500]), dtype="<u4").tobytes()
        out += packer.add((k, 0), docs[k])
    out += packer.close()
    joined = {k: b"" for k in docs}
    for row, start, n, ids in sorted((p for s in out for p in s), key=lambda p: (p[0], p[1])):
        assert start * 4 == len(joined[row[0]]) and len(ids) == 4 * n
        joined[row[0]] += ids
    sizes = [sum(p[2] for p in s) for s in out]
    assert joined == docs and max(sizes) <= 64
    assert sum(sizes) / sum(n if n & (n - 1) == 0 else 64 for n in sizes) > 0.95


def test_filter_never_undercounts_a_level():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << lm.BITS, 3000).astype(np.uint64))
    counts = r.integers(1, 500, len(keys))
    held = lm.segment(keys, lm.levels(counts))
    got = lm.probed(held, keys)
    assert (got >= lm.levels(counts)).all() and (got == lm.levels(counts)).mean() > 0.95
    assert (lm.probed(held, r.integers(0, 1 << lm.BITS, 3000).astype(np.uint64)) > 0).mean() < 0.05
    a, b = lm.pack(keys, counts)
    assert (lm.unpack_keys(a) == keys).all() and (lm.unpack_counts(b) == counts).all()


def test_signatures_estimate_jaccard():
    r = np.random.default_rng(2)
    common, a, b = (r.integers(0, 1 << 62, n).astype(np.uint64) for n in (800, 100, 100))
    sig = neardup.signatures([np.unique(np.r_[common, a]), np.unique(np.r_[common, b])], 400)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08


def test_shingles():
    one, two, none, same = neardup.shingle_sets([b"A b", b"a\tB c", b" \n", b"x x x x"], 2)
    assert len(one) == 1 and len(two) == 2 and len(none) == 0 and len(same) == 1 and one[0] in two
    assert len(neardup.shingle_sets([b"x"], 2)[0]) == 1


def test_html():
    page = """<head><title>T</title><style>.h{display:none}</style></head><h1>Head</h1>some <b>bold</b>text<p>one<p>two<ul><li>a<li>b<ol><li>x</ol></ul>
    <div class=h>gone</div><div hidden>gone</div><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table><pre> a\n  b</pre>end &amp;<script>no</script>"""
    assert html_text.rendered(page) == "Head\n\nsome boldtext\n\none\n\ntwo\n\n- a\n- b\n    1. x\n\nName       Qty\napple pie  3\n\n a\n  b\n\nend &"
    for broken in ("", "<", "<p", "</", "<!--", "<a href='", "&", "<table><td>x", "</td>y", "<div>" * 5000 + "z", "<ul><li>" * 500 + "z", "<!-- a"):
        html_text.rendered(broken)
    assert html_text.rendered("a<5 b") == "a<5 b" and html_text.rendered("<div>" * 5000 + "z").strip() == "z"


def test_tables_lists_and_what_is_closed():
    r = html_text.rendered
    assert r("<table><caption>a long caption</caption><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>") == "a long caption\nA  B  C\n   D  E"
    assert r("<table><caption>cap</caption><td>x<td>y</table>") == "cap\nx  y" and r("<table><tr><td>a</td></tr><td>b<td>c</table>") == "a\nb  c"
    assert r("<ol reversed><li>a<li>b<li value=7>c<li>d</ol>") == "4. a\n3. b\n7. c\n6. d"
    assert r("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>") == "yes"
    assert r("<style>.h{visibility:hidden}.v{visibility:visible}</style><p class=h>a<b class=v>b</b></p>") == "b"
    assert r("<details>t<summary>s</summary>u</details>") == "s" and r("<details open><summary>s</summary>u</details>") == "s\nu"
    assert r("<input type=email value='e@x'><input type=password value=p><input value=v>") == "e@x v"
    wide = r(f"<table><tr><td>{'w' * 100}<td>b<tr><td>c<td>d</table>").split("\n")
    assert wide[0] == "w" * 100 and wide[1].index("b") == wide[2].index("d") == html_text.COLUMN + 2


def test_every_visible_word_comes_out_once():
    r = random.Random(8)
    inline, block, gone = ["b", "i", "span", "a", "code"], ["div", "p", "ul", "li", "table", "tr", "td", "section", "h2", "blockquote", "dl", "dd", "caption", "ol", "pre"], ["script", "template", "noscript"]
    for _ in range(300):
        words, page, n = [], [], 0
        for _ in range(r.randint(1, 60)):
            n += 1
            k = r.random()
            if k < 0.45:
                page.append(f" w{n}w ")
                words.append(f"w{n}w")
            elif k < 0.75:
                span = f" rowspan={r.randint(0, 3)} colspan={r.randint(0, 3)}" if r.random() < 0.3 else ""
                page.append(f"<{r.choice(inline + block)}{span}>")
            elif k < 0.92:
                page.append(f"</{r.choice(inline + block)}>")
            elif k < 0.96:
                page.append(f"<div style='display:none'><b>h{n}h</b></div>")
            else:
                t = r.choice(gone)
                page.append(f"<{t}>h{n}h</{t}>")
        assert sorted(re.findall("[wh][0-9]+[wh]", html_text.rendered("".join(page)))) == sorted(words), "".join(page)


@pytest.mark.parametrize("unit, end", [
    ("<ul><li>x", ""), ("<tr><td>a<td>b", "<tr><td>" + "l" * 5000 + "<td>z"), ("<table><tr><td>x", ""), ("<td>c", ""), ("<blockquote>x", ""), ("<p>x", ""),
    ("<tr><td rowspan=1000>a<td>b", ""), ("<tr><td colspan=1000>a<td>b", ""), ("<b>x<i>", ""), ("<dl><dt>x<dd>y", ""), ("<details open><summary>x", ""),
])
def test_layout_is_linear(unit, end):
    import time

    took, size = [], []
    for n in (2000, 16000):
        begin = time.process_time()
        size.append(len(html_text.rendered("<table><tr>" * unit.startswith("<t") + unit * n + end)))
        took.append(time.process_time() - begin)
    assert size[1] <= 10 * size[0] + 100 and size[1] <= 16000 * 2 * (html_text.LINE + 50) and took[1] < 24 * took[0] + 0.5


def test_what_hides_and_what_does_not():
    page = lambda css, body, more="": html_text.rendered(f"<head><style{more}>{css}</style></head>{body}")
    note = "<div class=note>seen</div>"
    for css in ("@media print{.nav,.note{display:none}}", "@media (max-width:600px){.x{color:red}.note{display:none}}", "@media screen and (max-width:9px){.note{display:none}}",
                "@supports (x:y){@media screen{.note{display:none}}}", ".a{color:red;.note{display:none}}", ".note{content:'};display:none'}", "/*.note{display:none}*/"):
        assert page(css, note) == "seen", css
    for css in (".note{display:none}", "@media screen{p{margin:0}.note{display:none}}", "@layer a{@media all, print{.note{display:none}}}", "@import url(x);.note{color:red;display:none}",
                "@media print{p{display:none}}.x,.note{display:none", "a{content:'}'}/* { */.note{visibility:hidden}"):
        assert page(css, note) == "", css
    assert page(".note{display:none}", note, " media=print") == "seen"
    far = ",".join(f".c{k}" for k in range(600)) + ",.x-p,.note"
    for pad in range(5):  # wherever a list of more than 2000 characters might be cut
        assert page(f"{'q' * pad},{far}{{display:none}}", f"<p>one{note}<p>two<div class=c0>no</div>") == "one\n\ntwo"
    assert html_text.rendered("a <svg><title/><defs/><defs><text>no</text></defs><path d='m'/><text>one</text><text>two</text></svg> b") == "a one two b"
    assert html_text.rendered("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>") == "x=2"
    assert html_text.rendered("pick <select><option>red<option selected>blue</select> now") == "pick\nred\nblue\nnow"
    for broken in ("{" * 100_000, "/*" * 100_000, "a{" * 50_000 + "}" * 9, "'" * 100_000, "@media " * 50_000, "}" * 100_000):
        page(broken, "z")


def test_media_round_trip():
    for t in (b"", b"x", b"y" * 576, bytes(range(256)) * 9):
        p = media.payload_of(t)
        assert len(p) % 576 == 0 and len(p) > 0 and p.startswith(t) and set(p[len(t) :]) <= {255}
        assert media.from_image(media.to_image(p)).tobytes() == p
    damaged = bytearray(media.to_image(media.payload_of(b"abc")))
    damaged[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_image(bytes(damaged))


def test_interleaving_keeps_captions_and_order():
    page = '<h1>A</h1>x <figure><img src="a.png" alt="q"><video src="sha256:AB"></video><figcaption>cap <b>t</b></figcaption></figure><p>y<img src=z>w<script>no</script>'
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.interleaved(page)] == [
        (0, "text", "A", None, None), (1, "text", "x", None, None), (2, "image", None, None, "cap t"), (3, "video", None, "ab", "cap t"),
        (4, "text", "y", None, None), (5, "image", None, None, None), (6, "text", "w", None, None),
    ]


@pytest.mark.parametrize("scale", [3, 1000, 10**7, 10**12])
def test_block_top_is_exact(scale):
    r = np.random.default_rng(scale)
    x = r.integers(-scale, scale + 1, (900, 20)).astype(float)
    x[500:] = x[:400]  # ties
    ids = np.arange(900) * 3
    best, rows, _ = topk.block_top(x[::90], ids[::90], x, ids, 7)
    whole = [[int(v) for v in row] for row in x]
    for k, q in enumerate(range(0, 900, 90)):
        score = [min(max(sum(a * b for a, b in zip(whole[q], w, strict=True)), -(2**63)), 2**63 - 1) for w in whole]
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], ids[i]))[:7]
        assert rows[k].tolist() == want and best[k].tolist() == [score[i] for i in want]


def test_bounds_spare_most_products():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id")
    x, ids = np.floor(1024 * topk.vectors(t.column("embedding"))), t.column("vec_id").to_numpy()
    r = np.random.default_rng(1)
    near = np.floor(1024 * (r.normal(size=(40, 64))[r.integers(0, 40, 6000)] + 0.15 * r.normal(size=(6000, 64))))
    for x, ids, most in ((x, ids, 0.5), (near, np.arange(6000), 0.4)):  # directions at random, and in clusters
        q = ids % 100 == 0
        best, rows, tested = topk.block_top(x[q], ids[q], x, ids, 10)
        score = (x[q] @ x.T).astype(np.int64)
        score[ids[q][:, None] == ids] = np.iinfo(np.int64).min
        assert (rows == [np.lexsort((ids, ~s))[:10] for s in score]).all() and (np.take_along_axis(score, rows, 1) == best).all()
        assert tested < most * q.sum() * (len(x) - 1)


def test_vectors_of_odd_shapes():
    for n, d in ((1, 1), (5, 0), (40, 1), (40, 3), (3, 2000)):
        x = np.random.default_rng(n).integers(-9, 10, (n, d)).astype(float)
        ids = np.arange(n)
        best, rows, _ = topk.block_top(x, ids, x, ids, 4)
        for k in range(n):
            want = sorted((i for i in range(n) if i != k), key=lambda i: (-(x[k] @ x[i]), i))[:4]
            assert [i for i in rows[k].tolist() if i >= 0] == want


def test_long_texts_have_the_features_of_their_pieces(monkeypatch):
    docs = [b"  " + b"x" * 5000 + b" \n" * 600 + b"y " * 900, b" " * 9000, b"a b c " * 2000]
    m = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1)
    whole, scores = [quality.features(d) for d in docs], m.scores(docs)
    monkeypatch.setattr(quality, "PIECE", 700)
    for d, (f, n) in zip(docs, whole, strict=True):
        g, k = quality.features(d)
        assert f.tolist() == g.tolist() and n.tolist() == k.tolist()
    assert np.allclose(m.scores(docs), scores)


def test_features_and_scores_agree():
    docs = [b"", b"one", b"one one two", "é ### a".encode(), b"x " * 50]
    m = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.1)
    want = [1 / (1 + np.exp(-(np.average(m.value[f], weights=n) + m.bias))) for f, n in map(quality.features, docs)]
    assert np.allclose(m.scores(docs), want)


def test_weights_repeat():
    assert mixing.WEIGHTS == (3.0, 1.0, 2.0)


@pytest.mark.parametrize(
    ("css", "body", "want"),
    [
        (".a{display:none}.a{display:block}", "<p class=a>x", "x"),
        (".a{display:none}", "<p class=a style='display:block'>x", "x"),
        (".a{display:none}#b{display:block}", "<p id=b class=a>x", "x"),
        ("#b{display:block}.a{display:none}", "<p id=b class=a>x", "x"),
        ("p{display:none} .a{display:block}", "<p class=a>x<p>y", "x"),
        ("", "<p style='display:none;display:block'>x", "x"),
        (".a{display:none!important}", "<p class=a style='display:block'>x", ""),
        (".a.b{display:none}", "<p class='a'>x<p class='b a'>y", "x"),
        ("nav .c{display:none}", "<div class=c>x</div><nav><i><b class=c>y</b></i></nav><b class=c>z</b>", "x\nz"),
        ("div>p{display:none}", "<div><p>x</p><span><p>y</p></span></div>", "y"),
        ("[data-x]{display:none} [type='a b;}']{display:none}", "<b data-x>x</b><b type='a b;}'>y</b>z", "z"),
        ("a[href^='#']{display:none} a[rel~=me]{display:none}", "<a href='#x'>x</a><a href=y rel='no me'>y</a><a href=z>z</a>", "z"),
        ("*.z{display:none}", "<b class=z>x</b>y", "y"),
        ("p:not(.k, #m){display:none}", "<p class=k>x<p id=m>y<p>z", "x\n\ny"),
        (":is(.a,.b){display:none} .a:hover{display:none}", "<p class=a>x<p class=b>y", "x\n\ny"),
        (r".md\:hidden{display:none}", "<p class=md:hidden>x</p>y", "y"),
        ("html body > div.q .r{display:none} body{display:none}", "<body><div class=q><b class=r>x</b>y</div></body>", "y"),
        (".f{display:flex}", "<p hidden>x<p hidden class=f>y", "y"),
        (".v{visibility:hidden}.w{visibility:visible}", "<div class=v>x<b class=w>y</b></div>", "y"),
        ("", "<pre>\n a\n b</pre>", " a\n b"),
    ],
)
def test_cascade(css, body, want):
    assert html_text.rendered(f"<head><style>{css}</style></head>{body}") == want


def test_end_tags_and_rules_cost_what_they_touch():
    for n, page in (
        (8000, lambda n: "<i><table><td>" + "<div>" * n + "</i>" * n),
        (4000, lambda n: "<style>" + ".x .y .z{display:none}" * n + "</style>" + "<p class=x>" * n),
        (4000, lambda n: "<style>" + "".join(f".x{k} p{{display:none}}" for k in range(n)) + "</style>" + "<p class=x>" * n),
    ):
        took = []
        for m in (n, 4 * n):
            begin = time.process_time()
            html_text.rendered(page(m))
            took.append(time.process_time() - begin)
        assert took[1] < 10 * took[0] + 0.5, took


def test_secrets_of_several_parts_and_short_passwords():
    trained = pii.models()
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, trained)[1]]
    signed = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6Ik5vIE9uZSJ9.c2lnbmF0dXJlLW9mLW5vdGhpbmctMTIz"
    for text in (f"token: {signed} end", f"see {signed} here"):
        assert found(text) == [("secret", signed)], text
    for word in ("hunter42x", "Tr0ub4dor&3", "abc1234", "long!with?marks&more%than$16"):
        assert found(f"the password: {word} ok") == [("secret", word)], word
    for text in ("password: required for all", "the passwd: see section12 now", "order number 123-45-6789 sent", "com.example.verylongpackage.anotherlongname12.Main", "invoice 987 total 12"):
        assert not [k for k, _ in found(text) if k in ("secret", "ssn")], text
    assert found("ssn 123-45-6789") == [("ssn", "123-45-6789")]
