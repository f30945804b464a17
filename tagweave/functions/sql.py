"""The functions of this package under names for SQL: temporary functions that are SQL themselves and run in the JVM, and
table functions whose rows come from Python in Arrow batches.

Table functions are called beside a table, `FROM docs, LATERAL tw_atoms(docs.text)`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagweave.functions.code import SCHEMA, atoms
from tagweave.functions.text import TOKEN, _transient_lines
from tagweave.plans.scratch import ship


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def definitions() -> dict[str, str]:
    """Name: signature, kind of result and body."""
    bits = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter(hs, h -> shiftrightunsigned(h, b) & 1L = 1L)) > size(hs), shiftleft(1L, b), 0L))"
    lines = f"regexp_count(text, {_quoted(_transient_lines())})"
    total = "(regexp_count(text, '\\n') + if(text = '' OR endswith(text, '\\n'), 0, 1))"
    return {
        "tw_tokenize": f"(text STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(text), {_quoted(TOKEN)}, 0)",
        "tw_simhash": f"(text STRING) RETURNS BIGINT RETURN (SELECT {bits} FROM (SELECT transform(regexp_extract_all(lower(text), {_quoted(TOKEN)}, 0), t -> xxhash64(t)) AS hs))",
        "tw_hamming": "(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
        "tw_similarity": "(a BIGINT, b BIGINT) RETURNS DOUBLE RETURN 1 - bit_count(a ^ b) / 64.0D",
        "tw_tag": "(term STRING) RETURNS STRING RETURN concat('#', lower(term))",
        "tw_is_transient": f"(text STRING) RETURNS BOOLEAN RETURN {total} >= 5 AND {lines} > 0.5D * {total}",
        "tw_gravity": "(shared DOUBLE, hours DOUBLE, distance INT, damping DOUBLE) RETURNS DOUBLE RETURN shared * exp(-0.00001D * abs(hours)) * (1 - distance / 64.0D) * damping",
        "tw_atomize": "(text STRING) RETURNS TABLE (seq INT, content STRING) RETURN SELECT pos, regexp_replace(col, r'\\n\\n+\\z', '') FROM posexplode(regexp_extract_all(text, r'(?s).+?(?:\\n\\n+|\\z)', 0)) AS t(pos, col) WHERE regexp_replace(col, r'\\n\\n+\\z', '') <> ''",
    }


class Atoms:
    """Paragraphs of a text with their offsets in characters, as text.atoms() has them."""

    def eval(self, text: str) -> Iterator[tuple]:
        for seq, m in enumerate(re.finditer(r"(?s)(.+?)(?:\n\n+|\Z)", text or "")):
            content = re.sub(r"\n\n+\Z", "", m.group())
            if content:
                yield seq, m.start(), m.start() + len(content), content


class Molecules:
    """Sections that a header of up to three # opens, as text.molecules() has them, with their offsets."""

    def eval(self, text: str) -> Iterator[tuple]:
        text = text or ""
        begins = [m.start() for m in re.finditer(r"(?m)^#{1,3} ", text)]
        cuts = [0, *(b for b in begins if b), len(text)]
        for seq, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                header = re.match(r"#{1,3} ([^\n]*)", text[a:b])
                yield seq, a, b, header.group(1) if header else None, text[a:b]


class CodeAtoms:
    """Definitions of a program text and what lies between them; the second argument is a file's ending."""

    def eval(self, text: str, extension: str) -> Iterator[tuple]:
        for seq, a in enumerate(atoms(text or "", extension or "")):
            yield seq, a.parent, a.level, a.kind, a.name, a.start, a.end, text[a.start : a.end]


#: Table functions: their classes and columns.
TABLES = {
    "tw_atoms": (Atoms, "seq int, char_start int, char_end int, content string"),
    "tw_molecules": (Molecules, "seq int, char_start int, char_end int, header string, content string"),
    "tw_code_atoms": (CodeAtoms, SCHEMA),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions of `definitions` and `TABLES` known to the session; returns their names."""
    ship(spark)
    found = definitions()
    for name, body in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, (made, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(made, returnType=schema, useArrow=True))
    return [*found, *TABLES]
