"""Full-text search: tokens with positions and weights, query strings, and ranks.

A document is an array of structs (token, pos, weight).  The ``simple`` configuration lower-cases
and splits at everything but ASCII letters and digits; ``english`` also drops stop words, which keep
their positions, and stems.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import text_or_empty
from .stemming import STOP_WORDS, stem, stem_tokens

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
REACH = 100  # fixed value: positions beyond which two words say nothing about each other
NORMALIZER = 1.64493406685  # of ranks: the sum of 1 / n^2


def words(text: Column, config: str = "simple") -> Column:
    """Tokens in order; under ``english`` null where a stop word stood."""
    plain = F.array_remove(F.split(F.lower(text_or_empty(text)), "[^a-z0-9]+"), "")
    return plain if config == "simple" else stem_tokens(plain)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def weighted_vector(fields: list[tuple[Column, str]], only: list[str] | None = None) -> Column:
    """Tokens of several fields (arrays of words) with weights A to D, or certain tokens alone;
    positions go on from field to field."""

    def placed(words: Column) -> Column:
        parts, before = [], F.lit(0)
        for k, (_, weight) in enumerate(fields):
            parts.append(_placed(words[k], before, WEIGHTS[weight], only))
            before = before + F.size(words[k])
        return F.concat(*parts)

    return once(F.array(*[tokens for tokens, _ in fields]), placed)


def with_vector(df: DataFrame, fields: list[tuple[str, str]], config: str = "simple", target: str = "vector", only: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, columns to keep, and the weighted vector of text columns, of certain tokens alone if they are
    given; stems come from a UDF, so words are columns first."""
    names = [f"__words_{i}" for i in range(len(fields))]
    made = df.select("id", *keep, *[words(F.col(c), config).alias(n) for (c, _), n in zip(fields, names)])
    return made.select("id", *keep, weighted_vector([(F.col(n), w) for (_, w), n in zip(fields, names)], only).alias(target))


def _placed(tokens: Column, shift: Column, weight: float, only: list[str] | None) -> Column:
    def one(w: Column, i: Column) -> Column:
        placed = F.struct(w.alias("token"), (i + 1 + shift).cast("int").alias("pos"), F.lit(weight).alias("weight"))
        return F.when(w.isNotNull() if only is None else w.isin(only), placed)

    return F.filter(F.transform(tokens, one), lambda t: t.isNotNull())


@dataclass(frozen=True)
class Term:
    tokens: tuple[str, ...]  # more than one: a phrase
    negated: bool = False


def parse_query(query: str, config: str = "simple") -> list[list[Term]]:
    """A web search string: alternatives (``or``) of terms that all must hold; quotes make phrases,
    a leading minus negates.  Never fails; terms without tokens (stop words) vanish."""
    groups: list[list[Term]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', query):
        if m[3] is not None and m[3].lower() == "or":
            groups.append([])
            continue
        raw, negated = (m[2], m[1] == "-") if m[3] is None else (m[3].lstrip("-"), m[3].startswith("-"))
        tokens = [t for t in re.split(r"[^a-z0-9]+", raw.lower()) if t]
        if config == "english":
            tokens = [stem(t) for t in tokens if t not in STOP_WORDS]
        if tokens:
            groups[-1].append(Term(tuple(tokens), negated))
    return [g for g in groups if g]


def query_tokens(query: list[list[Term]]) -> list[str]:
    """The tokens that count for the rank."""
    return list(dict.fromkeys(w for g in query for t in g if not t.negated for w in t.tokens))


def _all_of(query: list[list[Term]], holds: Callable[[Term], Column]) -> Column:
    if not query:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(holds, g)) for g in query])


def matches(vector: Column, query: list[list[Term]]) -> Column:
    """Whether a document's vector satisfies a parsed query; an empty query matches nothing."""

    def in_vector(v: Column) -> Column:
        def holds(term: Term) -> Column:
            first = F.exists(v, lambda t: t["token"] == term.tokens[0])
            if len(term.tokens) > 1:
                starts = _positions(v, term.tokens[0])
                for k, token in enumerate(term.tokens[1:], 1):
                    starts = F.array_intersect(starts, F.transform(_positions(v, token), _minus(k)))
                first = F.size(starts) > 0
            return ~first if term.negated else first

        return _all_of(query, holds)

    return once(vector, in_vector) if query else F.lit(False)


def text_matches(fields: list[Column], query: list[list[Term]]) -> Column:
    """The same for ``simple`` tokens, read off the text: no word is split or placed for it."""
    text = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in fields]))

    def in_text(t: Column) -> Column:
        def holds(term: Term) -> Column:
            # containment is cheap, and most texts fail it
            found = F.contains(t, F.lit(term.tokens[0])) & t.rlike("(?<![a-z0-9])" + "[^a-z0-9]++".join(term.tokens) + "(?![a-z0-9])")
            return ~found if term.negated else found

        return _all_of(query, holds)

    return once(text, in_text) if query else F.lit(False)


def _minus(k: int):
    return lambda p: p - k


def _positions(vector: Column, token: str) -> Column:
    return F.transform(F.filter(vector, lambda t: t["token"] == token), lambda t: t["pos"])


def _single(hits: Column) -> Column:
    """Rank of one term: its best weight counts fully, further occurrences by 1 / n^2."""
    best = F.array_max(F.transform(hits, lambda t: t["weight"]))
    at = F.array_position(F.transform(hits, lambda t: t["weight"]), best)
    total = F.aggregate(F.transform(hits, lambda t, j: t["weight"] / ((j + 1) * (j + 1))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(hits) > 0, (best + total - best / (at * at)) / NORMALIZER).otherwise(0.0)


def _close(hits: Column) -> Column:
    """1 minus the product of 1 - closeness over all pairs of different terms within reach.

    Hits stand in order, so of each only those that follow within reach are looked at: a text costs
    no more than its length, however often the terms occur."""

    def apart(x: Column, y: Column) -> Column:
        d = y["pos"] - x["pos"]
        near = (d <= REACH) & (d > 0) & (x["token"] != y["token"])
        return F.when(near, F.log(1 - F.sqrt(x["weight"] * y["weight"] * _near(d)))).otherwise(0.0)

    def behind(x: Column, i: Column) -> Column:
        return F.aggregate(F.slice(hits, i + 2, REACH), F.lit(0.0), lambda s, y: s + apart(x, y))

    return 1 - F.exp(F.aggregate(F.transform(hits, behind), F.lit(0.0), lambda s, x: s + x))


def _near(d: Column) -> Column:
    return 1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))


def rank(vector: Column, query: list[list[Term]]) -> Column:
    """The rank of a document: terms that all must hold count by closeness, others by occurrence."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(0.0)

    def of(v: Column) -> Column:
        if by_pairs(query):
            return once(F.filter(v, lambda t: t["token"].isin(tokens)), _close)
        return reduce(lambda a, b: a + b, [once(F.filter(v, _is(w)), _single) for w in tokens]) / len(tokens)

    return once(vector, of)


def _is(token: str) -> Callable[[Column], Column]:
    return lambda t: t["token"] == token


def by_pairs(query: list[list[Term]]) -> bool:
    """Whether the rank is that of terms that all must hold."""
    return len(query) == 1 and len(query_tokens(query)) > 1
