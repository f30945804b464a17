"""Text operators as column expressions and plans: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters and digits; underscores and all else separate.
TOKEN = r"[\p{L}\p{N}]+"
HASHTAG = r"#([\p{L}\p{N}_]+)"
#: Own list of frequent English words that make no keyword.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each "
    "few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our "
    "out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your".split()
)
#: Lines that tell of a passing state, by family; matched anywhere in a line, case ignored.
TRANSIENT = {
    "error": (r"^\s*error:", r"^\s*error\[e\d+\]", r"\bexception\b.*\bat\b", r"^traceback \(most recent call last\)", r"^\s*at \S+\(.*:\d+(?::\d+)?\)", r"\bfatal:", r"\bsegmentation fault\b"),
    "package": (r"^npm (?:err!|warn)", r"^added \d+ packages", r"^up to date\b", r"^collecting \S+", r"^requirement already satisfied", r"^successfully installed", r"^downloading \S+", r"^yarn (?:install|add)\b"),
    "build": (r"^\s*compiling \S+ v\d", r"^\s*finished (?:dev|release)\b", r"^build (?:succeeded|failed)", r"^\[\d+/\d+\] ", r"^make(?:\[\d+\])?: "),
    "noise": (r"^\s*\d{1,3}%", r"^[-=*#_]{10,}$", r"^\[\d{4}-\d\d-\d\d[t ]\d\d:\d\d"),
}
#: What cleaning removes, in order: name, pattern, what stands there instead.
CLEANING = (
    ("front_matter", r"(?s)\A---\n.*?\n---\n", ""),
    ("code_fences", r"(?s)```.*?```", ""),
    ("scripts", r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", ""),
    ("html_tags", r"<[^>]*>", " "),
    ("json_artifacts", r'\\[nt"]', " "),
    ("log_lines", r"(?m)^\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*\n?", ""),
)


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null: null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Number of runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def tag(term: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(term))


def hashtags(text: Column) -> Column:
    """Distinct hashtags that a text writes itself, with #, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(1)), tag))


def cleaned(text: Column) -> Column:
    """Text without front matter, code fences, tags, JSON remnants and log lines; trimmed."""
    for _, pattern, instead in CLEANING:
        text = F.regexp_replace(text, pattern, instead)
    return F.trim(text)


def cleaning_flags(text: Column) -> Column:
    """Which cleaning rules a text meets."""
    return F.struct(*(text.rlike(p).alias(n) for n, p, _ in CLEANING))


def squeezed(text: Column, ascii_only: bool = False) -> Column:
    """Control characters removed and white space made single blanks; ascii_only also drops all beyond ASCII."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    if ascii_only:
        out = F.regexp_replace(out, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def snippet(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count."""
    parts = F.split(text, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _transient_lines() -> str:
    """A pattern that matches once in each line of a whole text that one of the patterns of TRANSIENT meets.

    Patterns that are tied to a line's begin are tried there alone; the others anywhere in it. White space in them is
    that of one line, and a line ends before its \\r\\n.
    """
    every = [p.replace(r"\s", r"[^\S\n]").replace("$", r"(?=$|\r\n)") for family in TRANSIENT.values() for p in family]
    tied = "|".join(f"(?:{p[1:]})" for p in every if p.startswith("^"))
    free = "|".join(f"(?:{p})" for p in every if not p.startswith("^"))
    return rf"(?iumd)^(?:(?:{tied})|[^\n]*?(?:{free}))[^\n]*"


def transient(text: Column, least_lines: int = 5, most_ratio: float = 0.5) -> Column:
    """struct(total, transient, ratio, is_transient): lines that tell of passing states; null counts as empty.

    The text is read twice, for its line ends and by one pattern; no line becomes a value of its own.
    """
    whole = F.coalesce(text, F.lit(""))
    ended = whole.endswith("\n") | (whole == "")
    total = (F.regexp_count(whole, F.lit("\n")) + F.when(ended, 0).otherwise(1)).cast("long")
    hits = F.regexp_count(whole, F.lit(_transient_lines())).cast("long")
    part = F.when(total > 0, hits / total).otherwise(0.0)
    return F.struct(total.alias("total"), hits.alias("transient"), part.alias("ratio"), ((total >= least_lines) & (part > most_ratio)).alias("is_transient"))


def char_range(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), from 0."""
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))


def byte_range(text: Column, start: int, end: int) -> Column:
    """Bytes [start, end) of the UTF-8 form as text; what is left of a character that the range cuts becomes U+FFFD."""
    return F.make_valid_utf8(byte_slice(text, start, end).cast("string"))


def byte_slice(text: Column, start: int, end: int) -> Column:
    """The same bytes as binary."""
    return F.substring(F.encode(text, "UTF-8"), start + 1, max(0, end - start))


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines [start, end), from 0."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start + 1, max(0, end - start)), "\n")


def atoms(docs: DataFrame, id_col: str, text_col: str, separator: str = r"\n\n+") -> DataFrame:
    """One row per paragraph: id_col, seq, char_start, char_end, content; offsets count characters of the text.

    One shuffle by id serves the running sum of lengths; empty paragraphs are dropped, their room counts.
    """
    piece = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s).+?(?:{separator}|\z)"), F.lit(0))
    rows = docs.select(id_col, F.posexplode(piece).alias("seq", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy(id_col).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    content = F.regexp_replace("piece", rf"(?:{separator})\z", "")
    out = rows.select(id_col, F.col("seq").cast("long").alias("seq"), before.cast("long").alias("char_start"), content.alias("content"))
    return out.filter("content <> ''").select(id_col, "seq", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), "content")


def molecules(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per section that a header of up to three # opens: id_col, seq, header (null before the first), content."""
    rows = docs.select(id_col, F.posexplode(F.split(text_col, r"(?m)(?=^#{1,3} )", -1)).alias("seq", "content")).filter("content <> ''")
    header = F.regexp_extract("content", r"\A#{1,3} ([^\n]*)", 1)
    return rows.select(id_col, F.col("seq").cast("long").alias("seq"), F.when(F.col("content").rlike(r"\A#{1,3} "), header).alias("header"), "content")


def context(atoms_df: DataFrame, by: str, order: str, text_col: str) -> DataFrame:
    """Each atom with the text of its neighbours n-1 and n+1."""
    w = Window.partitionBy(by).orderBy(order)
    return atoms_df.withColumn("before", F.lag(text_col).over(w)).withColumn("after", F.lead(text_col).over(w))


def wrapped(atom_id: Column, relevance: Column, content: Column) -> Column:
    """An atom as XML for a model's context; the signs of markup in its content are escaped."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        content = F.replace(content, F.lit(sign), F.lit(name))
    return F.format_string('<atom id="%d" relevance="%.4f">%s</atom>', atom_id, relevance, content)
