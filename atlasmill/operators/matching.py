"""Texts that hold other texts, and rules on what an item may say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.functions.shared import stash

#: So many key words at most are put into the plan; with more, they are joined.
INLINE_WORDS = 10_000
#: Items of so many letters at most in all are sent to the documents.
INLINE_CHARS = 8_000_000


def contained(items: DataFrame, docs: DataFrame, item_key: str, item_text: str, doc_key: str, doc_text: str) -> DataFrame:
    """(item, doc) for every document that holds an item's text as it is.

    An item's words other than the first and the last stand between the same spaces in any text that holds
    it. The rarest of them is the key of an equi-join, and the pairs it gives are checked. Only items of
    two words or fewer are compared with every document.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    inner = F.slice(F.split("t", " "), 2, F.greatest(F.size(F.split("t", " ")) - 2, F.lit(0)))
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).where("t is not null").withColumn("ws", F.array_distinct(F.filter(inner, lambda w: w != "")))
    held = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).where("text is not null")
    keys = asked.select(F.explode("ws").alias("word")).distinct()
    few = [r.word for r in keys.limit(INLINE_WORDS + 1).collect()]
    inline = len(few) <= INLINE_WORDS

    def holding(some: list[str] | None) -> DataFrame:
        """A row for each document and each of some of its words, or of all; outer, so that words are found once and not to see first whether there are any."""
        found = words(F.col("text")) if some is None else F.filter(words(F.col("text")), lambda w: w.isin(some)) if some else F.array().cast("array<string>")
        return held.select("doc", "text", F.explode_outer(F.array_distinct(found)).alias("word")).where("word is not null")

    each = holding(few if inline else None)
    if not inline:
        each = each.join(keys, "word", "left_semi")
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    options = asked.select("item", "t", F.explode("ws").alias("word")).join(often, "word")  # a word that no document holds rules its item out
    all_held = options.groupBy("item", "t").agg(F.min(F.struct("n", "word"))["word"].alias("word"), F.count(F.lit(1)).alias("present"))
    whole = all_held.join(asked.select("item", "t", F.size("ws").alias("size")), ["item", "t"]).where("present = size").select("item", "t", "word")
    sized = stash(whole, "contained")
    n, chars = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if inline and n <= INLINE_WORDS and chars <= INLINE_CHARS:  # the few items go to the documents, whose texts stay where they are
        rarest = [r.word for r in sized.select("word").distinct().collect()]
        pairs = holding(rarest).join(F.broadcast(sized), "word")
    else:
        pairs = sized.join(each, "word")
    pairs = pairs.where(F.contains("text", "t")).select("item", "doc")
    short = asked.where(F.size("ws") == 0).select("item", "t")
    if short.isEmpty():
        return pairs
    return pairs.union(held.join(short, F.contains("text", "t")).select("item", "doc"))


def names_an_option(text: Column) -> Column:
    """Whether a text points at an option by its letter."""
    return F.lower(text).rlike(r"option [abcd]([^a-z0-9_]|$)")
