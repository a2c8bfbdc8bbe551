"""Mixing sources to target weights by systematic sampling.

Every source gets a share of all words; a source's documents stand on a line on which each takes
the length of its expected copies; one offset per source is drawn, and a document is emitted once
for every integer boundary of that line inside its stretch. DataFrame operations only.

Nulls: a null text has size 0; a null source is a source of its own, last in order. Repeated rows
are rows of their own. An empty table gives an empty result. Sources whose sizes are all 0 have
target 0 and no copies. Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.common import SPACED_WORD, ranked, small, stash

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "systematic-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int], most: int) -> DataFrame:
    """One row per source: _src, source_size, target.

    Water filling in closed form: with sources by cap over weight, the level is the largest of
    (total - caps before) / (weights from here on); a target is the cap or level times weight.
    """
    per = sized.groupBy(F.col(source).alias("_src")).agg(F.sum(size).alias("source_size"))
    every = Window.orderBy(F.col("_src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(onward).cast("double"))
    level = F.max("_level").over(whole) * F.col("_w").cast("double")
    per = per.withColumn("_share", level)
    return per.select("_src", "source_size", F.least(F.col("_cap").cast("double"), F.col("_share")).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A number from 0 to 1 that depends on seed and source only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """Per input row: key, source, the columns in keep, size, source_size, target and copies."""
    cols = list(dict.fromkeys([key, source, *keep]))
    sized = docs.select(*[c for c in cols if c != "size"], word_count(F.col(text)).alias("size"))
    placed = ranked(sized, source, [F.col(source).asc_nulls_last(), F.col("size").asc(), F.col(key).asc_nulls_first()], "mix")
    # The rows may carry texts: the targets come to them.
    targets = small(stash(source_targets(placed.select(source, "size"), source, "size", weights, most), "targets"))
    out = placed.join(targets, placed[source].eqNullSafe(targets["_src"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col(source), seed)
    crossed = F.floor((F.col("_rank") + 1) * rate + u) - F.floor(F.col("_rank") * rate + u)
    return out.withColumn("copies", F.least(crossed, F.lit(most).cast("long"))).drop("_rank", "_src")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of docs, each row as often as it has copies."""
    # Stand-in names keep the operator's own columns clear of the input's.
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    picked = {k: at[options.pop(k, k2)] for k, k2 in (("text", "text"), ("source", "source"), ("key", "doc_id"))}
    out = mix(inner, keep=list(at.values()), **picked, **options)
    out = out.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(at[n]).alias(n) for n in names])


def op10_systematic_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 3 AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM per),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
    / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w::DOUBLE) AS target,
    ('0x' || substr(md5('systematic-1:' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rk
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least((floor(rk * rate + u) - floor((rk - 1) * rate + u))::BIGINT, 3) * size)::BIGINT AS taken FROM placed
"""
