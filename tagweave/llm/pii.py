"""op1: personal data by candidate gradient boosting.

Generators with high recall propose spans of each kind, which may overlap. Boosted trees (one model a kind) look at the
format of a candidate and at the words around it; a candidate is redacted where its calibrated probability reaches the
kind's threshold and it overlaps neither a base span nor a better candidate. Base spans, which fixed patterns and
checks define, always stay. The trees learn from sentences that this module makes up: every kind in several formats
with and without telling words, and look-alikes (order numbers, versions, times, sums, hashes of builds).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.boosting import Boosted, calibrate, fit
from tagweave.llm.common import map_rows, own_names, table

BASE = ("email", "ip", "card", "phone")
OTHERS = ("iban", "ssn", "secret")
KINDS = (*BASE, *OTHERS)
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")
_PREFIX = re.compile(r"[A-Za-z]{2,6}[_-](?:[a-z]{2,6}[_-])?[A-Za-z0-9]{12}")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their @: the part before it is the longest run that no earlier match holds."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and _LOCAL.match(text, begin - 1):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield "email", begin, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, m.end() if m else 0))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by start and then kind; matches that fail their check are dropped."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


#: High recall: what may be of a kind at all. Runs without a bound are possessive and begin where the run does, so that
#: nothing is read twice, however long. A secret must have a digit as well, which candidates() checks.
GENERATORS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]++ ?(?:@|\(at\)|\[at\]) ?[\w-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| \. )[\w-]++)++"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00 ?|0|\()[0-9]{1,5}\)?(?:[ ./-]?[0-9]{2,5}){2,4}(?![0-9])|(?<![0-9])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    # runs, also several that dots join (signed tokens), and short words after the name of a password and a sign
    "secret": re.compile(
        r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+(?:\.[A-Za-z0-9_/+-]{8,}+)*+={0,2}(?![A-Za-z0-9_/+=-])"
        r"|(?i:password|passwd|passphrase|pwd)[\"']? ?(?:[:=]|=>) ?[\"']?(?P<short>[^\s\"'<>;,]{6,64})(?![^\s\"'<>;,])"
    ),
}
#: What a text must have for these generators to find anything; for the others, a digit.
NEEDS = {"email": re.compile(r"@|\(at\)|\[at\]"), "ip": re.compile(":")}
#: Words that tell of a kind, and words that tell of other numbers.
TELLING = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "address", "server", "adresse", "client"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "appel", "llame", "anruf"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security", "tax id", "insurance"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "passphrase", "bearer", "auth", "api"),
}
OTHER = ("version", "order", "isbn", "invoice", "build", "commit", "page", "time", "serial", "part", "ref", "uuid", "sha", "checksum", "total")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(s.count(c) / n * math.log2(s.count(c) / n) for c in set(s))


def _iban(s: str) -> bool:
    t = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def candidate_features(kind: str, text: str, begin: int, end: int) -> list[float]:
    """Format of a candidate and what stands around it."""
    s, before, after = text[begin:end], text[max(0, begin - 40) : begin].lower(), text[end : end + 12].lower()
    digits = "".join(c for c in s if c.isdigit())
    n, short = len(s), digits[:32]
    return [
        n, len(digits), len(digits) / n, sum(c in " -./()" for c in s), len(set(s)) / n, _entropy(s),
        float(bool(short) and short.isascii() and luhn(short)), sum(c in "0123456789abcdefABCDEF" for c in s) / n, sum(c.isupper() for c in s) / n,
        float(kind == "iban" and _iban(s)), s.count(":"), s.count("."), float("@" in s),
        any(w in before for w in TELLING[kind]), any(w in before for w in OTHER), any(w in after for w in TELLING[kind]),
        before.rstrip()[-1:] in ('"', "'") and text[end : end + 1] in ('"', "'"), any(c in before[-4:] for c in "=:"),
        before[-1:].isalnum(), after[:1].isalnum(), len(set(re.findall("[0-9]+", s))) / max(1, len(re.findall("[0-9]+", s))),
        max(map(len, re.findall("[0-9]+", s)), default=0), float(s[:3] in ("000", "666") or s[:1] == "9"),
        sum(any(f(c) for c in s) for f in (str.isupper, str.islower, str.isdigit)), float(bool(_PREFIX.match(s))), s.count("-"), float(s.startswith("eyJ") and s.count(".") > 1),
    ]


def candidates(text: str) -> Iterator[Span]:
    """Every generator's spans; a position starts at most one of a kind."""
    digit = _DIGIT.search(text)
    for kind, pattern in GENERATORS.items():
        if NEEDS[kind].search(text) if kind in NEEDS else digit:
            for m in pattern.finditer(text):
                begin, end = m.span("short") if m.lastgroup else m.span()
                if kind != "secret" or _DIGIT.search(text, begin, end):
                    yield kind, begin, end


def _made_up(rng: random.Random) -> tuple[str, str, int, int, int]:
    """(text, kind, start, end, label) of one made-up sentence with one candidate."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n, a="0123456789abcdef": "".join(rng.choice(a) for _ in range(n))
    word = lambda: "".join(rng.choice(("ti", "on", "er", "an", "la", "re", "en", "that", "que", "sch", "ó", "é", "the")) for _ in range(rng.randint(1, 4)))
    kind, label = rng.choice(KINDS), rng.random() < 0.5

    def with_check(n: int) -> str:
        s = d(n - 1)
        return next(s + c for c in "0123456789" if luhn(s + c) == label)

    def iban() -> str:
        head, body = rng.choice(("DE", "FR", "ES", "GB", "NL")), d(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in head) + "00") % 97
        s = f"{head}{check if label else (check + 7) % 97:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."))) if label else rng.choice(((" @ ", " . "), ("@", " . ")))
        s = f"{word()}{rng.choice(('', '.' + word(), '.' + d(2), d(1)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'de'))}" if label else f"{d(1)}{at}{d(1)}{dot}{d(2)}"
    elif kind == "ip":
        s = ":".join(h(4) for _ in range(8)) if label else ":".join(d(2) for _ in range(rng.choice((3, 3, 4))))
    elif kind == "card":
        t = with_check(16)
        s = t if rng.random() < 0.4 else rng.choice("- ").join(t[i : i + 4] for i in range(0, 16, 4))
    elif kind == "phone":
        s = rng.choice((f"({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)}{d(4)}", f"0{d(2)}/{d(4)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}")) if label else rng.choice((f"0{d(15)}", f"00{d(14)}", f"0{d(12)}", f"0{d(9)}", f"0{d(3)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1)}-{d(2)}-{d(4)}"))
    elif kind == "iban":
        s = iban()
    elif kind == "ssn":
        numbered = not label and rng.random() < 0.4  # the same form, but after a word that tells of other numbers
        s = f"{rng.randint(1, 665):03d}-{d(2)}-{d(4)}" if label or numbered else f"{rng.choice(('000', '666', '9' + d(2)))} {d(2)} {d(4)}"
    else:
        mixed = string.ascii_letters + string.digits
        hexes = h(rng.choice((16, 24, 32, 40, 48, 64, 96)))
        random_ = h(rng.randint(20, 90), mixed + rng.choice(("", "_-", "+/"))) + d(1) + rng.choice(("", "", "="))
        upper = h(rng.randint(4, 20), string.ascii_uppercase) + h(rng.randint(8, 16), string.ascii_uppercase + string.digits) + d(1)
        named = rng.choice(("sk_live_", "pk-", "glpat-", "hf_", "SG-")) + random_
        parts = "-".join((h(8), h(4), h(4), h(4), h(12)))
        words_ = "-".join(word().strip("óé") or "a" for _ in range(rng.randint(2, 6))) + "-" + d(4) + "xxxxxx"
        signed = ".".join((f"eyJ{h(rng.randint(14, 40), mixed)}", h(rng.randint(20, 120), mixed + "_-"), h(rng.randint(20, 60), mixed + "_-") + d(1)))
        short = h(rng.randint(5, 12), mixed + "!#$%&*+?@_") + d(1) + h(rng.randint(0, 2), mixed)
        paths = ".".join(word().strip("óé") * 3 + word().strip("óé") + "aaaaaaaa" for _ in range(rng.randint(2, 3))) + d(2)
        s = rng.choice((hexes, random_, random_, upper, named, parts, signed, short)) if label else rng.choice((words_, words_.replace("-", "/"), paths, d(rng.randint(16, 24)), hexes, hexes, parts, random_))
    hint = rng.choice(TELLING[kind]) if rng.random() < (0.75 if label else 0.1) else word() if rng.random() < (0.9 if label else 0.3) else rng.choice(OTHER)
    if kind == "ssn" and numbered:
        hint = rng.choice(OTHER)
    s0 = f"{hint}{rng.choice((' ', ': ', ' = ', ' no. ', ' number '))}"
    if kind == "secret":  # without telling words a random run is none but where its own form tells
        plain = label and rng.random() < {named: 0.3, signed: 0.6}.get(s, 0)
        hint = word() if plain else rng.choice(TELLING[kind]) if label else rng.choice((word(), rng.choice(OTHER), rng.choice(OTHER)))
        hint = rng.choice(("password", "passwd", "pwd")) if label and s == short else hint
        s0 = f"{hint.upper() if rng.random() < 0.2 else hint}{rng.choice((' = ', ': ', '=', ' ', ' is ', ' => '))}{rng.choice(('', '', chr(34)))}"
    quote = '"' if s0.endswith('"') else ""
    head = " ".join(word() for _ in range(rng.randint(0, 6))) + " " + s0
    return head + s + quote + " " + " ".join(word() for _ in range(rng.randint(1, 5))), kind, len(head), len(head) + len(s), int(label)


@lru_cache(maxsize=1)
def models(rows: int = 14000, precision: float = 0.97, seed: int = 3) -> dict[str, Boosted]:
    """A calibrated model of each kind: two thirds of the made-up rows train it, the rest calibrate it."""
    rng = random.Random(seed)
    made = [_made_up(rng) for _ in range(rows)]
    out = {}
    for kind in KINDS:
        mine = [r for r in made if r[1] == kind]
        x = np.array([candidate_features(kind, t, a, b) for t, _, a, b, _ in mine], float)
        y = np.array([r[4] for r in mine], float)
        cut = 2 * len(mine) // 3
        out[kind] = calibrate(fit(x[:cut], y[:cut]), x[cut:], y[cut:], precision)
    return out


def find(text: str, trained: dict[str, Boosted]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    base = base_spans(text)
    scored = []
    by_kind: dict[str, list[Span]] = {}
    for c in candidates(text):
        by_kind.setdefault(c[0], []).append(c)
    for kind, spans in by_kind.items():
        m = trained[kind]
        p = m.probability(np.array([candidate_features(kind, text, a, b) for _, a, b in spans], float))
        scored += [(-x, a, KINDS.index(kind), b) for x, (_, a, b) in zip(p.tolist(), spans, strict=True) if x >= m.threshold]
    taken = np.zeros(len(text) if scored else 0, bool)
    if scored:
        for _, a, b in base:
            taken[a:b] = True
    extra = []
    for _, a, k, b in sorted(scored):
        if not taken[a:b].any():
            taken[a:b] = True
            extra.append((KINDS[k], a, b))
    return base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    """kind:start:end of each, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in its place; spans that overlap become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, redact: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of every whole text.

    Returns id_col, counts of the base kinds, base_sha256, spans (text form), n_spans, the numbers of all spans of the
    other kinds, found (array of structs) and, with redact, redacted (the text, null for null), and the columns in `keep`,
    which get an underscore at the end of their names where they are called like a result. Offsets count code points, ends
    are exclusive. Texts of any length are read whole. A null or empty text has no spans; null ids stay null; repeated rows
    give repeated results, an empty table none; of candidates that overlap the likelier stays, then the one that begins
    first; other columns are ignored. The models, a few kilobytes each, go to the workers with the function.
    """
    trained = models()
    extra = [c for c in keep if c not in (id_col, text_col)]
    types = dict(docs.dtypes)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    ddl = f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long{''.join(f', n_{k} long' for k in OTHERS)}, found array<struct<kind:string,start:bigint,end:bigint>>"
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", *(f"n_{k}" for k in OTHERS), "found", *(["redacted"] * redact)]
    kept = own_names(extra, names)
    ddl += ", redacted string" * redact + "".join(f", `{n}` {types[c]}" for n, c in zip(kept, extra, strict=True))
    names += kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(1).to_pylist()
            both = [find(t or "", trained) for t in rows]
            n = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in BASE]
            sha = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            told = pa.array([joined(spans) for _, spans in both], pa.string())
            more = [pa.array([sum(k is None or s[0] == k for s in spans) for _, spans in both], pa.int64()) for k in (None, *OTHERS)]
            found = pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in spans] for _, spans in both], item)
            text = [pa.array([t if t is None else redacted(t, spans) for t, (_, spans) in zip(rows, both, strict=True)], pa.string())] if redact else []
            yield pa.RecordBatch.from_arrays([b.column(0), *n, sha, told, *more, found, *text, *b.columns[2:]], names)

    return map_rows(docs.select(docs[id_col].cast("long").alias(id_col), text_col, *extra), run, ddl)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return detect(table(spark, sf_dir, "documents"), redact=False).drop("found")
