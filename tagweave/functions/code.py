"""Program text cut into definitions: functions, classes and what lies between them, with offsets.

One pass over a text finds strings, comments, brackets and line ends; a definition begins at a line that says so and ends
where its braces close, or, where it has none, before the next line that isn't indented further. Rows of level 0 cover
their text; a definition inside another one has its number as parent. No language is parsed: what is told apart is what
brackets and indents show.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tagweave.plans.scratch import ship

#: Languages whose single quotes hold one character; elsewhere they are strings.
ONE_QUOTED = ("rs", "c", "h", "cc", "cpp", "hpp", "java", "go", "cs", "kt", "scala", "swift")
_STRINGS = r'"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?'''|" + r'"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`'
_REST = r"|//[^\n]*|/\*.*?\*/|\#(?![\[!])[^\n]*|[(){}\[\]\n]"
_TOKENS = {True: re.compile(_STRINGS + r"|'(?:[^'\\\n]|\\.[^'\n]{0,8})'" + _REST, re.S), False: re.compile(_STRINGS + r"|'(?:[^'\\\n]|\\.)*'" + _REST, re.S)}
_DEFINES = re.compile(
    r"[ \t]*(?:(?:pub(?:\([^)\n]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|unsafe|extern|override|inline|virtual|const)[ \t]+)*"
    r"(?P<kind>def|class|fn|func|function|fun|struct|enum|trait|impl|interface|module|namespace|object)\b[ \t]*(?:\([^)\n]*\)[ \t]*)?(?:<[^>\n]*>[ \t]*)?(?P<name>[\w$]*)"
)
#: Lines that belong to the definition below them.
_LEADS = re.compile(r"[ \t]*(?:\#|//|/\*|\*|@)")


@dataclass
class Atom:
    parent: int | None
    level: int
    kind: str
    name: str | None
    start: int
    end: int


def _lines(text: str, one_quoted: bool) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Begin of each line; the depth of brackets there, and the depth of braces alone; whether a line begins inside a string or comment."""
    starts, depths, braces, inside = [0], [0], [0], [False]
    depth = brace = 0
    for m in _TOKENS[one_quoted].finditer(text):
        sign = m.group()
        if sign in "([{":
            depth, brace = depth + 1, brace + (sign == "{")
        elif sign in ")]}":
            depth, brace = max(0, depth - 1), max(0, brace - (sign == "}"))
        elif sign == "\n":
            starts.append(m.end())
            depths.append(depth)
            braces.append(brace)
            inside.append(False)
        else:
            for n in re.finditer("\n", sign):
                starts.append(m.start() + n.end())
                depths.append(depth)
                braces.append(brace)
                inside.append(True)
    return starts, depths, braces, inside


def atoms(text: str, extension: str = "") -> list[Atom]:
    """The definitions of a text and, at level 0, what lies between them, in order of their begin."""
    if not text:
        return []
    starts, depths, braces, inside = _lines(text, extension in ONE_QUOTED)
    n = len(starts)
    line = [text[s:e] for s, e in zip(starts, [*starts[1:], len(text)], strict=True)]
    blank = [not x.strip() for x in line]
    indent = [len(x) - len(x.lstrip(" \t")) for x in line]
    found: list[Atom] = []
    open_: list[list] = []  # indent, depth of braces, number of the atom, whether its braces have opened
    low = 0  # the first line that no earlier definition has

    def close(k: int) -> None:
        """Ends the definitions that line k isn't part of."""
        nonlocal low
        while open_:
            at, brace, number, body = open_[-1]
            if body:
                if braces[k] > brace or inside[k]:
                    return
            elif blank[k] or inside[k] or depths[k] > braces[k] or indent[k] > at or line[k].lstrip()[:1] in ("{", ")", "]") or line[k].lstrip().startswith("where"):
                return
            found[number].end, low = starts[k], k
            open_.pop()

    for k in range(n):
        close(k)
        m = None if inside[k] or depths[k] > braces[k] else _DEFINES.match(line[k])
        if m and (m.group("name") or m.group("kind") in ("impl", "def", "func", "function", "fn")):
            first = k
            while first > low and not blank[first - 1] and not inside[first - 1] and indent[first - 1] == indent[k] and _LEADS.match(line[first - 1]):
                first -= 1
            found.append(Atom(open_[-1][2] if open_ else None, len(open_), m.group("kind"), m.group("name") or None, starts[first], -1))
            open_.append([indent[k], braces[k], len(found) - 1, False])
            low = k + 1
        after = braces[k + 1] if k + 1 < n else 0
        for one in reversed(open_):  # outer ones have opened before
            if one[3]:
                break
            one[3] = after > one[1]
        if open_ and not open_[-1][3] and "{" in line[k] and "}" in line[k] and after == open_[-1][1] and not line[k].rstrip().endswith((":", ",")):
            open_[-1][3] = True  # opened and closed in one line
    for _, _, number, _ in open_:
        found[number].end = len(text)
    return _covered(found, len(text))


def _covered(found: list[Atom], size: int) -> list[Atom]:
    """Adds what lies between the definitions of level 0; parents are counted anew."""
    out: list[Atom] = []
    number: dict[int, int] = {}
    at = 0
    for k, atom in enumerate(found):
        if atom.level == 0 and atom.start > at:
            out.append(Atom(None, 0, "text", None, at, atom.start))
        number[k] = len(out)
        atom.parent = None if atom.parent is None else number[atom.parent]
        out.append(atom)
        if atom.level == 0:
            at = atom.end
    if at < size:
        out.append(Atom(None, 0, "text", None, at, size))
    return out


SCHEMA = "seq int, parent int, level int, kind string, name string, char_start int, char_end int, content string"


def code_atoms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id_col, SCHEMA) of program texts: each definition, and at level 0 what lies between them.

    Rows of level 0 cover their text. path_col: a path, whose ending tells the language's quotes. Null and empty texts
    have no rows.
    """
    columns = [id_col, text_col, *([path_col] if path_col else [])]
    rows = docs.select(*columns)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                path = (b.column(2)[k].as_py() or "") if path_col else ""
                made = atoms(text, path.rpartition(".")[2].lower())
                if made:
                    columns = [[a.parent for a in made], [a.level for a in made], [a.kind for a in made], [a.name for a in made], [a.start for a in made], [a.end for a in made]]
                    types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                    arrays = [b.column(0).take(pa.array([k] * len(made))), pa.array(range(len(made)), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array([text[a.start : a.end] for a in made])]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "seq", "parent", "level", "kind", "name", "char_start", "char_end", "content"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
