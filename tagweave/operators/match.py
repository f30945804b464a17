"""What a boolean full-text query is made of, and its usual text form.

    word            that word
    "two words"     a phrase; a word with signs in it, as well as a + b, is one too
    pre*            words that begin so; also for the last word of a phrase, "two wor" *
    ^word           only at a text's begin
    NEAR(a "b c", 5)  all of them, with 5 tokens at most between the end of the first and the begin of the last; 10 unless given
    a b, a AND b    both
    a OR b, a NOT b, (a b)

NOT binds closest, then juxtaposition, AND and OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Match:
    """A node of a query."""

    def parts(self) -> tuple[Match, ...]:
        return ()

    def units(self) -> list[Match]:
        """The phrases and NEAR groups, each once."""
        return list(dict.fromkeys(u for p in self.parts() for u in p.units()))

    def scored(self) -> list[Match]:
        """Those of them that add to the score."""
        return list(dict.fromkeys(u for p in self.parts() for u in p.scored()))

    def words(self) -> tuple[list[str], list[str]]:
        """Words of the query, prefixes with *; and the prefixes, without."""
        words = list(dict.fromkeys(w for u in self.units() for w in u.slots()))
        return words, [w[:-1] for w in words if w.endswith("*")]

    def holds(self, names: dict[Match, str]) -> Column:
        """Whether it holds for an atom, given columns with the units' counts."""
        raise NotImplementedError


class Unit(Match):
    def units(self) -> list[Match]:
        return [self]

    def scored(self) -> list[Match]:
        return [self]

    def holds(self, names: dict[Match, str]) -> Column:
        return F.col(names[self]) > 0


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _marked(positions: Column, which: int) -> Column:
    return F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(which).alias("which")))


@dataclass(frozen=True)
class Phrase(Unit):
    """Tokens in a row; the last one may be a prefix, the first one may have to begin the text."""

    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False

    def slots(self) -> list[str]:
        return [*self.tokens[:-1], self.tokens[-1] + "*" * self.prefix]

    def starts(self, columns: dict[str, str]) -> Column:
        """Positions that the phrase begins at, in order, of columns with its words' positions."""
        first, *rest = (F.col(columns[s]) for s in self.slots())
        out = first
        for j, c in enumerate(rest, 1):
            out = F.array_intersect(out, _moved(c, j))
        return F.filter(out, lambda p: p == 0) if self.initial else out

    def count(self, columns: dict[str, str]) -> Column:
        return F.size(self.starts(columns)).cast("long")


@dataclass(frozen=True)
class Near(Unit):
    """Phrases with `distance` tokens at most between the end of the first and the begin of the last."""

    phrases: tuple[Phrase, ...]
    distance: int = 10

    def slots(self) -> list[str]:
        return [s for p in self.phrases for s in p.slots()]

    def count(self, columns: dict[str, str]) -> Column:
        """How many of the phrases' places close a group: the latest places of all before them are near enough.

        One pass over the places in order, which keeps the last place of each phrase.
        """
        k = len(self.phrases)
        places = F.array_sort(F.flatten(F.array(*(_marked(p.starts(columns), j) for j, p in enumerate(self.phrases)))))
        long = F.array(*(F.lit(len(p.tokens)) for p in self.phrases))
        start = F.struct(F.array_repeat(F.lit(-1), k).alias("last"), F.lit(0).cast("long").alias("n"), F.lit(-1).alias("at"))

        def seen(state: Column, place: Column) -> Column:
            last = F.transform(state["last"], lambda v, i: F.when(i == place["which"], place["at"]).otherwise(v))
            return F.struct(last.alias("last"), (state["n"] + closes(state, place)).alias("n"), place["at"].alias("at"))

        def closes(state: Column, place: Column) -> Column:
            last = F.transform(state["last"], lambda v, i: F.when(i == place["which"], place["at"]).otherwise(v))
            first = F.array_min(F.transform(last, lambda v, i: F.struct(v.alias("at"), (v + F.get(long, i)).alias("end"))))
            return F.when((first["at"] >= 0) & (place["at"] - first["end"] <= self.distance), 1).otherwise(0)

        return F.aggregate(places, start, seen, lambda s: s["n"])


@dataclass(frozen=True)
class And(Match):
    of: tuple[Match, ...]

    def parts(self) -> tuple[Match, ...]:
        return self.of

    def holds(self, names: dict[Match, str]) -> Column:
        return reduce(lambda x, y: x & y, (p.holds(names) for p in self.of))


@dataclass(frozen=True)
class Or(Match):
    of: tuple[Match, ...]

    def parts(self) -> tuple[Match, ...]:
        return self.of

    def holds(self, names: dict[Match, str]) -> Column:
        return reduce(lambda x, y: x | y, (p.holds(names) for p in self.of))


@dataclass(frozen=True)
class Not(Match):
    """`keep` where `drop` doesn't hold."""

    keep: Match
    drop: Match

    def parts(self) -> tuple[Match, ...]:
        return self.keep, self.drop

    def scored(self) -> list[Match]:
        return self.keep.scored()

    def holds(self, names: dict[Match, str]) -> Column:
        return self.keep.holds(names) & ~self.drop.holds(names)


_SIGNS = re.compile(r'\s*("(?:[^"]|"")*"|[()^*+,]|[^\s()^*+,"]+)')


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.left = text, _SIGNS.findall(text)
        if _SIGNS.sub("", text).strip():
            raise ValueError(f"a quote isn't closed: {text}")

    def next(self, *wanted: str) -> str | None:
        """Takes the next sign if it is one of these."""
        return self.left.pop(0) if self.left and self.left[0] in wanted else None

    def need(self, sign: str) -> None:
        if not self.next(sign):
            raise ValueError(f"{sign} is missing before {' '.join(self.left) or 'the end'}: {self.text}")

    def either(self) -> Match:
        found = [self.both()]
        while self.next("OR"):
            found.append(self.both())
        return Or(tuple(found)) if len(found) > 1 else found[0]

    def both(self) -> Match:
        found = [self.beside()]
        while self.next("AND"):
            found.append(self.beside())
        return And(tuple(found)) if len(found) > 1 else found[0]

    def beside(self) -> Match:
        found = [self.unless()]
        while self.left and self.left[0] not in (")", "AND", "OR", "NOT", ","):
            found.append(self.unless())
        return And(tuple(found)) if len(found) > 1 else found[0]

    def unless(self) -> Match:
        found = self.one()
        while self.next("NOT"):
            found = Not(found, self.one())
        return found

    def one(self) -> Match:
        if self.next("("):
            found = self.either()
            self.need(")")
            return found
        if self.left[:2] == ["NEAR", "("]:
            self.left, phrases, distance = self.left[2:], [], 10
            while self.left and self.left[0] not in (")", ","):
                phrases.append(self.phrase())
            if self.next(","):
                distance = int(self.left.pop(0))
            self.need(")")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = self.next("^") is not None
        tokens = self.word()
        while self.next("+"):
            tokens += self.word()
        return Phrase(tuple(tokens), self.next("*") is not None, initial)

    def word(self) -> list[str]:
        if not self.left or self.left[0] in ("(", ")", "^", "*", "+", ",", "AND", "OR", "NOT"):
            raise ValueError(f"a word is missing before {' '.join(self.left) or 'the end'}: {self.text}")
        found = re.findall(r"[^\W_]+", self.left.pop(0).lower())
        if not found:
            raise ValueError(f"a phrase has no word: {self.text}")
        return found


def parsed(text: str) -> Match:
    """The query that a text stands for; ValueError where it stands for none."""
    reader = _Reader(text)
    found = reader.either()
    if reader.left:
        raise ValueError(f"{reader.left[0]} stands where nothing may: {text}")
    return found
