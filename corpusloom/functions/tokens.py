"""Words of a text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it:
    expressions in lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs between white space, as Python's ``split`` gives them."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_set(text: Column, drop: Sequence[str] = ()) -> Column:
    found = F.array_distinct(words(F.lower(text)))
    return F.array_except(found, F.array(*map(F.lit, drop))) if drop else found


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(text, F.lit(t))
    return hit


@cache
def _automaton(table: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[str], ahocorasick.Automaton | None]:
    """The names that hold an empty term, which every text contains, and an automaton from
    each other term to its names; one to a Python worker."""
    names: dict[str, set[str]] = {}
    for name, terms in table:
        for t in terms:
            names.setdefault(t, set()).add(name)
    always = sorted(names.pop("", ()))
    if not names:
        return always, None
    found = ahocorasick.Automaton()
    for t, some in names.items():
        found.add_word(t, tuple(some))
    found.make_automaton()
    return always, found


def names_found(text: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Sorted names of which any term stands in the text, terms within others too: one pass
    over a text, however many terms there are. A null text has none."""
    key = tuple((k, tuple(v)) for k, v in table.items())

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        always, automaton = _automaton(key)

        def of(t: str | None) -> list[str]:
            if t is None:
                return []
            found = set(always)
            for _, some in automaton.iter(t) if automaton is not None else ():
                found.update(some)
                if len(found) == len(table):
                    break
            return sorted(found)

        return texts.map(of)

    return find(text)
