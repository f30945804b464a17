"""What style sheets say of whether elements are shown: rules of `display` and `visibility`, by the cascade.

Selectors are compounds of a tag, classes, ids, attributes and :not() of these, joined as descendants or children. Rules
with other selectors (states such as :hover, parts such as ::before, siblings) hold nowhere, so that what they would hide
is shown. An element is compared with the compounds that its own id, classes or tag name and whose ancestors are open
around it, not with all rules.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: (important, value) of a declaration: of display whether it takes the element out, of visibility whether text shows
#: (None: as the parent's).
Declared = dict[str, tuple[bool, bool | None]]

_DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*", re.I)
_ASIDE = re.compile(r"""/\*.*?(?:\*/|\Z)|("(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)""", re.S)
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?:print|speech)", re.I)
_NAME = r"(?:[\w-]|\\.)++"
_PIECE = re.compile(
    rf"""(?P<tag>\*|[A-Za-z][\w-]*+)|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})|:not\((?P<none>[^()]*+)\)"""
    rf"""|\[\s*+(?P<attr>[\w-]++)\s*+(?:(?P<op>[~|^$*]?=)\s*+(?P<value>"(?:[\w-]|\\.)*+"|{_NAME})\s*+)?\]""",
    re.S,
)
_STRING = re.compile(r'"(\d+)"')
_JOIN = re.compile(r"\s*+(>?)\s*+")
#: How an attribute's value is compared.
_TEST: dict[str, Callable[[str, str], bool]] = {
    "=": lambda has, v: has == v,
    "~=": lambda has, v: v in has.split(),
    "|=": lambda has, v: has == v or has.startswith(v + "-"),
    "^=": lambda has, v: v != "" and has.startswith(v),
    "$=": lambda has, v: v != "" and has.endswith(v),
    "*=": lambda has, v: v != "" and v in has,
}


class Compound(NamedTuple):
    """What a selector asks of one element."""

    tag: str
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attrs: tuple[tuple[str, str, str], ...]  # name, how it is compared, value
    nots: tuple[Compound, ...]

    @property
    def key(self) -> str:
        """The rarest name that the element must have."""
        return f"#{self.ids[0]}" if self.ids else f".{self.classes[0]}" if self.classes else self.tag or "*"

    def weight(self) -> tuple[int, int, int]:
        own = (len(self.ids), len(self.classes) + len(self.attrs), int(self.tag != ""))
        return tuple(map(sum, zip(own, *(n.weight() for n in self.nots), strict=True)))

    def holds(self, tags: tuple[str, ...], attrs: dict[str, str], classes: set[str]) -> bool:
        return (
            (not self.tag or self.tag in tags)
            and all(attrs.get("id") == i for i in self.ids)
            and classes.issuperset(self.classes)
            and all(n in attrs and (not op or _TEST[op](attrs[n], v)) for n, op, v in self.attrs)
            and not any(n.holds(tags, attrs, classes) for n in self.nots)
        )


def on_screens(media: str) -> bool:
    """Whether a media list holds on every screen."""
    return not media.strip() or any(_SCREEN.fullmatch(q.strip()) for q in media.split(","))


def declared(style: str) -> Declared:
    """What declarations say of display and visibility: the last of each, those that are important before others."""
    out: Declared = {}
    for m in filter(None, map(_DECLARED.fullmatch, style.split(";"))):
        name, value, important = m[1].lower(), m[2].lower(), m[3] is not None
        if important or not out.get(name, (False,))[0]:
            if name == "display":
                out[name] = important, value == "none"
            elif value in ("visible", "hidden", "collapse", "inherit", "unset", "initial"):
                out[name] = important, None if value in ("inherit", "unset") else value in ("visible", "initial")
    return out


def _split(selectors: str) -> list[str]:
    """A list of selectors, at commas outside of brackets."""
    if "(" not in selectors and "[" not in selectors:
        return selectors.split(",")
    out, at, depth = [], 0, 0
    for m in re.finditer(r"[(\[)\],]", selectors):
        if m[0] == ",":
            if depth == 0:
                out.append(selectors[at : m.start()])
                at = m.end()
        else:
            depth += 1 if m[0] in "([" else -1
    return [*out, selectors[at:]]


def rules(css: str) -> Iterator[tuple[str, Declared]]:
    """(selector, what it declares) of the rules of a style sheet that hold on every screen, in one pass.

    Rules count at the top and in @layer or @media blocks without conditions; those in other at-blocks (print, widths,
    @supports, @keyframes) and those nested in rules do not, nor do their declarations count for what is around them.
    Layers rank by order, as all else does.
    """
    strings: list[str] = []

    def aside(m: re.Match) -> str:
        if m[1] is None:
            return " "
        strings.append(re.sub(r"(?s)\\\\.|[^\w-]", lambda c: c[0] if len(c[0]) > 1 else f"\\{c[0]}", m[1][1:].removesuffix(m[1][0])))
        return f'"{len(strings) - 1}"'

    css = _ASIDE.sub(aside, css)
    css += "}" * css.count("{")  # the end closes what is open
    blocks: list[tuple[bool, str | None, list[str]]] = []  # what is open: whether it counts, selectors of a rule, declarations
    at = 0
    for m in re.finditer("[{};]", css):
        part, at = css[at : m.start()].strip(), m.end()
        if m[0] == "{":
            counts = not blocks or (blocks[-1][0] and blocks[-1][1] is None)
            if part.startswith("@"):
                name, rest = re.match(r"@([\w-]*)(.*)", part, re.S).groups()
                blocks.append((counts and (name.lower() == "layer" or (name.lower() == "media" and on_screens(rest))), None, []))
            else:
                blocks.append((counts, part, []))
        elif blocks:
            blocks[-1][2].append(part)
            if m[0] == "}":
                counts, selectors, body = blocks.pop()
                says = declared(";".join(body)) if counts and selectors else None
                if says:
                    yield from ((_STRING.sub(lambda m: f'"{strings[int(m[1])]}"', s.strip()), says) for s in _split(selectors))


def _plain(name: str | None) -> str:
    return re.sub(r"\\(.)", r"\1", name or "", flags=re.S)


def chain(selector: str) -> list[tuple[str, Compound]] | None:
    """The compounds of a selector, each with what joins it to the one before ('>' or nothing); None: not read here."""
    out, at, join = [], 0, ""
    while True:
        tag, ids, classes, attrs, nots, begin = "", [], [], [], [], at
        while m := _PIECE.match(selector, at):
            if m["tag"] and at > begin:
                return None
            at = m.end()
            if m["tag"]:
                tag = "" if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"]:
                classes.append(_plain(m["cls"]))
            elif m["id"]:
                ids.append(_plain(m["id"]))
            elif m["attr"]:
                attrs.append((m["attr"].lower(), m["op"] or "", _plain((m["value"] or "").removeprefix('"').removesuffix('"'))))
            else:
                inner = [chain(s.strip()) for s in _split(m["none"])]
                if any(c is None or len(c) > 1 for c in inner):
                    return None
                nots += [c[0][1] for c in inner]
        if at == begin:
            return None
        out.append((join, Compound(tag, tuple(ids), tuple(classes), tuple(attrs), tuple(nots))))
        m = _JOIN.match(selector, at)
        if at == len(selector):
            return out
        if not m[0]:
            return None
        join, at = m[1], m.end()


class Styles:
    """The rules of a page, and which of them can hold where the reader of its tree is."""

    def __init__(self) -> None:
        self.rules: list[tuple[list[tuple[str, Compound]], dict[str, tuple[tuple, bool | None]]]] = []
        self.known: dict[str, int | None] = {}
        self.first: defaultdict[str, list[tuple[int, int]]] = defaultdict(list)  # first compounds by key
        self.live: defaultdict[str, Counter[tuple[int, int]]] = defaultdict(Counter)  # by key, those that an open element leads to
        self.order = 0
        self.path: list[tuple[tuple[int, int], ...]] = []  # what each open element holds for, but for last compounds

    def add(self, selector: str, says: Declared) -> None:
        """Adds a rule; equal selectors are one."""
        if selector not in self.known:
            # the root stands for html and for body
            steps = chain(re.sub(r"^html\s*+>?\s*+(?=body\b)", "", selector))
            self.known[selector] = len(self.rules) if steps else None
            if steps:
                self.first[steps[0][1].key].append((len(self.rules), 0))
                self.rules.append((steps, {}))
        r = self.known[selector]
        if r is not None:
            steps, has = self.rules[r]
            weight = (0, *map(sum, zip(*(c.weight() for _, c in steps), strict=True)))
            self.order += 1
            for name, (important, value) in says.items():
                rank = important, weight, self.order
                if name not in has or has[name][0] < rank:
                    has[name] = rank, value

    def told(self, tag: str, attrs: dict[str, str]) -> tuple[dict[str, bool | None], tuple[tuple[int, int], ...]]:
        """What holds for an element of display and visibility; the compounds that it holds for, for enter()."""
        best: dict[str, tuple[tuple, bool | None]] = {}
        steps = []
        if self.rules:
            classes = set(attrs.get("class", "").split())
            tags = (tag,) if self.path else ("html", "body")
            keys = ["*", *tags, *(f".{c}" for c in classes), *([f"#{attrs['id']}"] if "id" in attrs else [])]
            above = self.path[-1] if self.path else ()
            for r, k in [x for key in keys for x in (*self.first.get(key, ()), *self.live.get(key, ()))]:
                chained, has = self.rules[r]
                join, c = chained[k]
                if (not k or join != ">" or (r, k - 1) in above) and c.holds(tags, attrs, classes):
                    if k + 1 < len(chained):
                        steps.append((r, k))
                    else:
                        for name, v in has.items():
                            best[name] = max(best.get(name, v), v, key=lambda x: x[0])
        if "style" in attrs:
            for name, (important, value) in declared(attrs["style"]).items():
                v = (important, (1, 0, 0, 0), 0), value
                best[name] = max(best.get(name, v), v, key=lambda x: x[0])
        return {name: value for name, (_, value) in best.items()}, tuple(steps)

    def enter(self, steps: tuple[tuple[int, int], ...]) -> None:
        """Goes into an element."""
        self.path.append(steps)
        for r, k in steps:
            self.live[self.rules[r][0][k + 1][1].key][r, k + 1] += 1

    def leave(self) -> None:
        """Goes out of the element entered last."""
        for r, k in self.path.pop():
            live = self.live[self.rules[r][0][k + 1][1].key]
            live[r, k + 1] -= 1
            if not live[r, k + 1]:
                del live[r, k + 1]
