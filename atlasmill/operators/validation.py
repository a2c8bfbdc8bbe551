"""Validation of nested records as column expressions: each gives true or false, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasmill.operators.retrieval import folded


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def squeezed(text: Column) -> Column:
    return folded(F.trim(F.regexp_replace(text, r"\s+", " ")))


def distinct_texts(texts: Column, least: int, most: int) -> Column:
    """Between least and most texts, none blank, none the same after squeezing."""
    plain = F.transform(texts, squeezed)
    return _sure(F.size(texts).between(least, most) & F.forall(plain, lambda x: x != "") & (F.size(F.array_distinct(plain)) == F.size(texts)))


def domains_fit(domains: Column, source: Column, universe: list[str], count: int) -> Column:
    """count - 1 different known domains, the source not among them."""
    known = F.array(*[F.lit(d) for d in universe])
    return _sure((F.size(domains) == count - 1) & (F.size(F.array_distinct(domains)) == F.size(domains)) & (F.size(F.array_except(domains, known)) == 0) & ~F.array_contains(domains, source))


def combinations_fit(combinations: Column, source: Column, universe: list[str], count: int) -> Column:
    """Array of structs (domains, confidence): each fits, no set of domains twice, confidence in [0, 1]."""
    each = F.forall(combinations, lambda c: domains_fit(c["domains"], source, universe, count) & _sure(~F.isnan(c["confidence"]) & c["confidence"].between(0, 1)))
    sets = F.transform(combinations, lambda c: F.array_sort(c["domains"]))
    return _sure(each & (F.size(F.array_distinct(sets)) == F.size(sets)))


def by_confidence(combinations: Column) -> Column:
    """Highest confidence first; ties keep their order."""
    numbered = F.transform(combinations, lambda c, i: F.struct((-c["confidence"]).alias("by"), i.alias("at"), c.alias("kept")))
    return F.transform(F.array_sort(numbered), lambda x: x["kept"])


def covers_domains(facts: Column, domains: Column, each: int) -> Column:
    """Map of domain to texts: exactly these domains, `each` different texts for every one."""
    return _sure((F.array_sort(F.map_keys(facts)) == F.array_sort(domains)) & F.forall(F.map_values(facts), lambda t: distinct_texts(t, each, each)))


def quote_inside(quote: Column, text: Column) -> Column:
    """A quote that is not blank and stands in the text, white space squeezed in both."""
    q = F.trim(F.regexp_replace(quote, r"\s+", " "))
    return _sure((q != "") & F.contains(F.regexp_replace(text, r"\s+", " "), q))


def decisions_cover(decided: Column, candidates: Column) -> Column:
    """Every candidate id exactly once, nothing else."""
    return _sure(F.array_sort(decided) == F.array_sort(candidates))


def in_order_of(rows: Column, field: str, order: list[str]) -> Column:
    """Structs sorted by where their field stands in order."""
    known = F.array(*[F.lit(x) for x in order])
    return F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(F.array_position(known, r[field]).alias("at"), r.alias("kept")))), lambda x: x["kept"])
