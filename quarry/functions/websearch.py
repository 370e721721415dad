"""Web search queries, and cover density: how closely a text holds what a query asks for.

A query is a list of words; words in double quotes are a phrase, a - before a word or phrase excludes it, and `or` between operands
makes alternatives, each of which is all words around it. An alternative without operands is left out, so that `or` at an end means
nothing. An alternative that only excludes matches nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as T

UNIT = '-?"[^"]*"?|[^\\s"]+'
#: Fixed value: what a word without a weight of its own counts for.
WEIGHT = 0.1


def parse(query: Column) -> Column:
    """array of struct(alternative, excluded, terms): terms of a phrase in order, or one word."""
    found = F.regexp_extract_all(F.lower(query), F.lit(UNIT), 0)

    def unit(u: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(found, 1, i), lambda x: x == "or"))
        one = lambda terms: F.struct(before.alias("alternative"), u.startswith("-").alias("excluded"), terms.alias("terms"))
        terms = T.tokens(u)
        return F.when(u == "or", F.array().cast("array<struct<alternative:int,excluded:boolean,terms:array<string>>>")).when(u.contains('"'), F.array(one(terms))).otherwise(F.transform(terms, lambda t: one(F.array(t))))

    return F.filter(F.flatten(F.transform(found, unit)), lambda x: F.size(x["terms"]) > 0)


def places(terms: list, at: dict) -> np.ndarray:
    """First positions of every place of a phrase (or word), ascending."""
    none = np.zeros(0, np.int64)
    first = np.asarray(at.get(terms[0], none))
    for k, t in enumerate(terms[1:], 1):
        first = first[np.isin(first + k, np.asarray(at.get(t, none)))]
    return first


def cover_density(units: list[tuple[int, bool, list]], at: dict) -> float | None:
    """Of a text with these ascending positions of the query's terms: the sum over its covers, or None where it does not match.

    A cover is a stretch that holds what some alternative asks for and no shorter one with the same begin or end; it counts WEIGHT,
    divided by one more than the number of words in it that the query does not name. Exclusions decide on the match only.
    """
    asked: dict[int, list[tuple[np.ndarray, int]]] = {}
    ruled_out = set()
    for alternative, excluded, terms in units:
        found = places(terms, at)
        if not excluded:
            asked.setdefault(alternative, []).append((found, len(terms) - 1))
        elif len(found):
            ruled_out.add(alternative)
    live = {a: found for a, found in asked.items() if all(len(first) for first, _ in found)}
    if not set(live) - ruled_out:
        return None
    ends = np.unique(np.concatenate([first + more for found in live.values() for first, more in found]))
    begin = np.full(len(ends), -1)
    for found in live.values():
        latest = np.full(len(ends), np.iinfo(np.int64).max)
        for first, more in found:
            before = np.searchsorted(first + more, ends, "right")
            latest = np.minimum(latest, np.where(before > 0, first[before - 1], -1))
        begin = np.maximum(begin, latest)
    begin, first_end = np.unique(begin, return_index=True)
    begin, end = begin[begin >= 0], ends[first_end[begin >= 0]]
    entries = np.unique(np.concatenate([np.asarray(p) for p in at.values()]))
    named = np.searchsorted(entries, end, "right") - np.searchsorted(entries, begin, "left")
    return sum((WEIGHT / (1 + (end - begin) - (named - 1))).tolist())
