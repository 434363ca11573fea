"""Accent folding, keyword tokens and the keyword test that follows a vector search."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import bind


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Letters that decompose to one sign, and those that decompose to several."""
    one_from, one_to, many = [], [], []
    for point in (*range(0xA0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)):
        sign = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c)).lower()
        if plain != sign and plain != sign.lower():
            if len(plain) == 1:
                one_from.append(sign)
                one_to.append(plain)
            elif plain:
                many.append((sign, plain))
    return "".join(one_from), "".join(one_to), many


def fold(text: Column) -> Column:
    """Lower case without accents, by table: exact for Latin, Greek and Cyrillic letters with one base sign.

    Signs that become several (ligatures, fractions) need ``fold_exact``.
    """
    source, target, _ = _folding()
    return F.lower(F.translate(F.regexp_replace(text, r"\p{M}", ""), source, target))


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """Compatibility decomposition of any text; vectorised, but outside the JVM."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower())


@lru_cache(maxsize=1)
def _exact_folding() -> tuple[str, str, list[str], list[str]]:
    """All signs that ``fold_exact`` turns into ASCII letters or digits or drops: by one sign (dropped ones last), by several."""
    one_from, one_to, gone, many, several = [], [], [], [], []
    for point in (*range(0xA0, 0xD800), *range(0xE000, 0x110000)):
        sign = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c)).lower()
        if not plain:
            gone.append(sign)
        elif plain != sign and any(c.isascii() and c.isalnum() for c in plain):
            if len(plain) == 1:
                one_from.append(sign)
                one_to.append(plain)
            else:
                many.append(sign)
                several.append(plain)
    return "".join(one_from + gone), "".join(one_to), many, several


def _sign_class(signs: list[str]) -> str:
    """Class of signs in rising order, by ranges; ASCII fails at its first test. Signs stand as they are: a lookbehind
    of Java is wide enough for those beyond 16 bits only if it sees one."""
    ranges: list[list[int]] = []
    for point in map(ord, signs):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return r"[\x{80}-\x{10FFFF}&&[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]]"


def fold_for_tokens(text: Column) -> Column:
    """``fold_exact`` as far as tokens see it, inside the JVM: signs without ASCII letters or digits stay as they are."""
    source, target, many, several = _exact_folding()
    signs = _sign_class(many)
    # Each of the signs that become several is a piece of its own; its place among them is that of its letters.
    replaced = lambda p: F.coalesce(F.get(F.lit(several), F.instr(F.lit("".join(many)), p) - 1), p)
    pieces = lambda t: F.filter(F.split(t, f"(?<={signs})|(?={signs})"), lambda p: p != "")
    expanded = lambda t: F.when(t.rlike(signs), F.array_join(F.transform(pieces(t), replaced), "")).otherwise(t)
    return F.lower(bind(F.translate(text, source, target), expanded))


def tokens(text: Column, exact: bool = False) -> Column:
    """Distinct runs of at least four letters or digits of the folded text."""
    folded = fold_for_tokens(text) if exact else fold(text)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("([a-z0-9]{4,})"), F.lit(1)))


def prefixes(token_array: Column) -> Column:
    return F.array_distinct(F.transform(token_array, lambda t: F.substring(t, 1, 4)))


def matches(query_tokens: Column, text_tokens: Column) -> Column:
    """Does a text pass a query's keywords?

    A query without tokens passes all. Else a token must be shared, or as many four-letter
    prefixes as the query has, two at most.
    """
    wanted = prefixes(query_tokens)
    need = F.when(F.size(wanted) == 1, F.lit(1)).otherwise(F.lit(2))
    return (F.size(query_tokens) == 0) | F.arrays_overlap(query_tokens, text_tokens) | (F.size(F.array_intersect(wanted, prefixes(text_tokens))) >= need)
