"""Rule tables: conditions in SQL over a row's columns, each with a code, points and a second output.

A table is data; what is done with it is always one expression: the codes that hold, the first one, or the sum of points.
Conditions that are null don't hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    when: str
    points: int = 0
    also: str = ""

    @property
    def holds(self) -> Column:
        return F.coalesce(F.expr(self.when), F.lit(False))


def quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def holds_any(column: str, words: Iterable[str]) -> str:
    """The condition that a text column holds one of the words."""
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def one_of(column: str, values: Iterable[str]) -> str:
    return f"{column} IN ({', '.join(map(quoted, values))})"


def blank(column: str) -> str:
    return f"coalesce(trim({column}), '') = ''"


def flagged(column: str, code: str) -> str:
    return f"array_contains({column}, {quoted(code)})"


def all_codes(table: Sequence[Rule]) -> Column:
    """The codes of the rules that hold, in the table's order."""
    return F.array_compact(F.array(*[F.when(r.holds, F.lit(r.code)) for r in table]))


def all_reasons(table: Sequence[Rule]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(r.holds, F.lit(r.also)) for r in table])))


def _first(table: Sequence[Rule], pick, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for rule in reversed(table):
        out = F.when(rule.holds, F.lit(pick(rule))).otherwise(out)
    return out


def first_code(table: Sequence[Rule], otherwise: str) -> Column:
    return _first(table, lambda r: r.code, otherwise)


def first_also(table: Sequence[Rule], otherwise: str) -> Column:
    return _first(table, lambda r: r.also, otherwise)


def total(table: Sequence[Rule]) -> Column:
    """The sum of the points of the rules that hold."""
    out = F.lit(0)
    for rule in table:
        out = out + F.when(rule.holds, F.lit(rule.points)).otherwise(F.lit(0))
    return out


def weight_of(column: str, weights: dict[str, int], otherwise: int = 0) -> Column:
    """A category's weight."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(otherwise))


def pair_name(a: str, b: str, names: dict[tuple[str, str], str], same: str, otherwise: str) -> Column:
    """The name of a pair of labels: listed pairs first, ``*`` standing for any left label."""
    table = [Rule(name, (f"{a} = {quoted(x)} AND " if x != "*" else "") + f"{b} = {quoted(y)}") for (x, y), name in names.items()]
    return F.when(F.expr(f"{a} <=> {b}"), F.lit(same)).otherwise(first_code(table, otherwise))
