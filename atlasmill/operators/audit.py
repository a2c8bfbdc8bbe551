"""Audits of fusion plans as DataFrame operators: combination entropy, coverage, conditional coverage, masking.

A plan record has source_domain, domain_count, fusion_domains, sample and, after retrieval, required_key_facts and
retrieved_samples. flatten() turns such records into three frames, on which the audits work:

* needs: plan_id, source_domain, domain_count, target_domain, query_index (from 1)
* candidates: plan_id, target_domain, candidate_id, position (from 1)
* hits: plan_id, target_domain, candidate_id, query_index, method (bm25 or embedding), score, rank

Means are taken need -> domain -> plan -> source -> all, so a domain with many needs weighs no more than
one with few. A macro mean is null unless every expected source has a value. Lists of domains, sizes, thresholds
and budgets are short parameters; everything else is distributed, keyed by plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.functions.text import atomic_id

PLAN = ["plan_id", "source_domain", "domain_count"]
NEED = [*PLAN, "target_domain", "query_index"]
MODES = ("cosine_observed", "hybrid_complete", "cosine_complete", "bm25_complete")
PAIRS_AT_ONCE = 100_000


def _listed(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def plan_issues(plans: DataFrame, domains: list[str], retrieved: bool = False) -> DataFrame:
    """Adds issues: what makes a record unfit for an audit, in a fixed order; empty for a fit one."""
    known = _listed(domains).cast("array<string>")
    added, size = F.col("fusion_domains"), F.size("fusion_domains")
    fits = lambda ok: ~F.coalesce(ok, F.lit(False))
    checks = [
        ("unknown_source", fits(F.array_contains(known, F.col("source_domain")))),
        ("bad_domain_count", fits(F.col("domain_count").between(2, len(domains)))),
        ("bad_fusion_domains", fits((size == F.col("domain_count") - 1) & (F.size(F.array_distinct(added)) == size) & (F.size(F.array_except(added, known)) == 0) & ~F.array_contains(added, F.col("source_domain")))),
        ("no_sample", fits(F.col("sample.prompt").isNotNull() & F.col("sample.completion").isNotNull())),
    ]
    if retrieved:
        covers = lambda c: (F.size(F.array_except(F.map_keys(c), added)) == 0) & (F.size(F.map_keys(c)) == F.size(added))
        needs, found = F.col("required_key_facts"), F.col("retrieved_samples")
        blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
        ids = lambda v: F.transform(v, lambda c: c.candidate_id)
        wrong = lambda h, n: (h.method == "embedding") & ~F.coalesce(h.query_index.between(1, n) & ~F.isnan(h.score) & h.score.between(-1.0, 1.0), F.lit(False))
        checks += [
            ("needs_do_not_cover_domains", fits(covers(needs))),
            ("retrieval_does_not_cover_domains", fits(covers(found))),
            ("empty_need", fits(F.forall(F.map_values(needs), lambda v: (F.size(v) > 0) & F.forall(v, lambda x: ~blank(x.key_fact) & ~blank(x.necessity))))),
            ("repeated_candidate", fits(F.forall(F.map_values(found), lambda v: (F.size(F.array_distinct(ids(v))) == F.size(v)) & F.forall(v, lambda c: ~blank(c.candidate_id))))),
            ("bad_hit", fits(F.forall(F.map_entries(found), lambda e: F.forall(e.value, lambda c: ~F.exists(c.hits, lambda h: wrong(h, F.size(F.element_at(needs, e.key)))))))),
        ]
    return plans.withColumn("issues", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])))


def identified(plans: DataFrame) -> DataFrame:
    """Adds atomic_id (of the sample as it is) and plan_id (of source, size and atomic_id)."""
    named = plans.withColumn("atomic_id", atomic_id(F.col("sample.prompt"), F.col("sample.completion")))
    return named.withColumn("plan_id", F.sha2(F.to_json(F.array(F.col("source_domain"), F.col("domain_count").cast("string"), F.col("atomic_id"))), 256))


def repeated_plans(plans: DataFrame) -> DataFrame:
    """plan_id and n of every source sample and size that several records hold."""
    return plans.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def flatten(plans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(needs, candidates, hits) of identified plan records."""
    per = plans.select(*PLAN, F.explode("fusion_domains").alias("target_domain"), "required_key_facts", "retrieved_samples")
    per = per.select(*PLAN, "target_domain", F.element_at("required_key_facts", F.col("target_domain")).alias("n"), F.element_at("retrieved_samples", F.col("target_domain")).alias("c"))
    needs = per.select(*PLAN, "target_domain", F.posexplode("n").alias("i", "x")).select(*PLAN, "target_domain", (F.col("i") + 1).alias("query_index"), "x.key_fact", "x.necessity")
    held = per.select("plan_id", "target_domain", F.posexplode("c").alias("i", "x"))
    candidates = held.select("plan_id", "target_domain", "x.candidate_id", (F.col("i") + 1).alias("position"))
    hits = held.select("plan_id", "target_domain", "x.candidate_id", F.explode("x.hits").alias("h")).select("plan_id", "target_domain", "candidate_id", "h.query_index", "h.method", "h.score", "h.rank")
    return needs, candidates, hits


def pairs(needs: DataFrame, candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each need and candidate of its domain; a need without candidates keeps one with a null candidate.

    The retrieval limit bounds the candidates of a domain, so the rows of a plan are few.
    """
    of = lambda method, what: F.max(F.when(F.col("method") == method, F.col(what)))
    on = ["plan_id", "target_domain", "candidate_id", "query_index"]
    scores = hits.groupBy(*on).agg(of("embedding", "score").alias("cosine"), of("embedding", "rank").alias("cosine_rank"), of("bm25", "score").alias("bm25"), of("bm25", "rank").alias("bm25_rank"))
    return needs.select(*NEED).join(candidates, ["plan_id", "target_domain"], "left").join(scores, on, "left")


def _by_budget(rows: DataFrame, budgets: list[int | None]) -> DataFrame:
    """Each row once a budget, with inside: whether its candidate is within it. null is no limit."""
    each = rows.withColumn("budget", F.explode(_listed(budgets).cast("array<int>")))
    return each.withColumn("inside", F.col("candidate_id").isNotNull() & (F.col("budget").isNull() | (F.col("position") <= F.col("budget"))))


def _first_best(score: Column, valid: Column) -> list[Column]:
    """The largest score of valid rows and the candidate that has it; of equals the first."""
    order = F.struct(score, -F.col("position"))
    return [F.max(F.when(valid, score)).alias("best"), F.max_by("candidate_id", F.when(valid, order)).alias("best_candidate")]


def coverage_needs(scored: DataFrame, budgets: list[int | None]) -> DataFrame:
    """Per need and budget: candidates, observed and missing pairs, best saved cosine, its candidate, status."""
    seen = F.col("inside") & F.col("cosine").isNotNull()
    out = _by_budget(scored, budgets).groupBy(*NEED, "budget").agg(F.count_if("inside").alias("candidates"), F.count_if(seen).alias("observed_pairs"), *_first_best(F.col("cosine"), seen))
    status = F.when(F.col("candidates") == 0, "empty_candidates").when(F.col("best").isNull(), "no_saved_score").otherwise("observed")
    return out.withColumn("missing_pairs", F.col("candidates") - F.col("observed_pairs")).withColumn("status", status)


def coverage_states(needs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per need, budget and threshold: covered, lower and upper bound, state. Unknown is a need that is not
    covered while any of its pairs has no saved score; without candidates nothing is unknown."""
    each = needs.withColumn("threshold", F.explode(_listed(thresholds).cast("array<double>")))
    covered = F.coalesce(F.col("best") >= F.col("threshold"), F.lit(False))
    unknown = ~covered & (F.col("missing_pairs") > 0)
    return each.select("*", covered.cast("double").alias("saved"), (covered | unknown).cast("double").alias("upper"), F.when(covered, "covered").when(unknown, "unknown").otherwise("uncovered").alias("state"), (F.col("observed_pairs") > 0).cast("double").alias("available"))


def coverage_plans(states: DataFrame) -> DataFrame:
    """Per plan, budget and threshold: the means of its domains' means."""
    at = [*PLAN, "budget", "threshold"]
    domain = states.groupBy(*at, "target_domain").agg(*[F.avg(c).alias(c) for c in ("saved", "upper", "available")], F.count(F.lit(1)).alias("needs"), F.sum("candidates").alias("pairs"), F.sum("observed_pairs").alias("observed"), F.count_if(F.col("state") == "unknown").alias("unknown"))
    out = domain.groupBy(*at).agg(*[F.avg(c).alias(c) for c in ("saved", "upper", "available")], F.min("saved").alias("weakest_domain"), *[F.sum(c).alias(c) for c in ("needs", "pairs", "observed", "unknown")])
    return out.withColumn("all_covered", (F.col("weakest_domain") == 1).cast("int")).withColumn("pair_availability", F.when(F.col("pairs") > 0, F.col("observed") / F.col("pairs")))


def macro(plan_level: DataFrame, values: list[str], by: list[str], domains: list[str]) -> tuple[DataFrame, DataFrame]:
    """(per source, over sources): equal weights of plans in a source and of sources; the macro is null unless
    all expected sources have a value, the mean of those seen stands beside it."""
    held = plan_level.where(F.col("source_domain").isin(domains))
    source = held.groupBy("source_domain", *by).agg(F.count(F.lit(1)).alias("plans"), *[F.avg(v).alias(v) for v in values])
    return source, over_sources(source, values, by, domains)


def over_sources(source: DataFrame, values: list[str], by: list[str], domains: list[str]) -> DataFrame:
    """The macro means of per-source means, as macro() says."""
    expected = _listed(sorted(domains))
    return source.groupBy(*by).agg(
        F.sum("plans").alias("plans"), *[F.avg(v).alias(f"observed_{v}") for v in values],
        *[F.when(F.count(v) == len(domains), F.avg(v)).alias(f"macro_{v}") for v in values],
        F.array_sort(F.array_except(expected, F.collect_set(F.when(F.col(values[0]).isNotNull(), F.col("source_domain"))))).alias("missing_sources"),
    )


def fit_ranges(hits: DataFrame) -> DataFrame:
    """Per target domain the range of reference BM25 scores, of hits with no embedding too. A range without width is unfit."""
    out = hits.where("method = 'bm25'").groupBy("target_domain").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count(F.lit(1)).alias("observed"))
    return out.withColumn("fit", F.col("high") > F.col("low"))


def satisfaction_pairs(scored: DataFrame, ranges: DataFrame, alpha: float = 0.5, rrf_k: int = 60) -> DataFrame:
    """Adds normalized scores, clipping, the mixed score and the normalized rank fusion of each pair.

    Only a pair with a saved cosine takes part; BM25 counts where both scores are saved. A domain whose
    range is unfit has no normalized BM25.
    """
    if not (math.isfinite(alpha) and 0 <= alpha <= 1):
        raise ValueError("alpha must lie in [0, 1]")
    both = F.col("cosine").isNotNull() & F.col("bm25").isNotNull()
    value = F.when(both & F.col("fit"), (F.col("bm25") - F.col("low")) / (F.col("high") - F.col("low")))
    rows = scored.join(F.broadcast(ranges.select("target_domain", "low", "high", "fit")), "target_domain", "left")
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    rows = rows.select(*scored.columns, both.alias("both"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "cosine")).alias("cosine_norm"), value.alias("v"))
    rows = rows.withColumn("cosine_norm", F.when(F.col("cosine").isNotNull(), F.col("cosine_norm"))).withColumn("bm25_norm", F.when(F.col("v").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "v"))))
    rows = rows.withColumn("clipped", F.when(F.col("v") < 0, "low").when(F.col("v") > 1, "high").when(F.col("v").isNotNull(), "none"))
    return rows.withColumn("hybrid", alpha * F.col("bm25_norm") + (1 - alpha) * F.col("cosine_norm")).withColumn("rrf_norm", (part("cosine_rank") + part("bm25_rank")) / (2 / (rrf_k + 1))).drop("v")


def satisfaction_needs(scored: DataFrame, budgets: list[int | None]) -> DataFrame:
    """Per need, budget and mode: pairs, eligible pairs, the best eligible score (weight) and its candidate."""
    field = {"cosine_observed": "cosine_norm", "hybrid_complete": "hybrid", "cosine_complete": "cosine_norm", "bm25_complete": "bm25_norm"}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(field[m]).alias("score"), (F.col("cosine").isNotNull() if m == "cosine_observed" else F.col("both")).alias("ok")) for m in MODES])
    rows = _by_budget(scored, budgets).withColumn("m", F.explode(modes)).withColumn("valid", F.col("inside") & F.col("m.ok") & F.col("m.score").isNotNull())
    out = rows.groupBy(*NEED, "budget", F.col("m.mode").alias("mode")).agg(F.count_if("inside").alias("pairs"), F.count_if("valid").alias("eligible"), *_first_best(F.col("m.score"), F.col("valid")))
    return out.withColumnRenamed("best", "weight").withColumn("status", F.when(F.col("weight").isNull(), "excluded_no_eligible_score").otherwise("evaluated"))


def satisfaction_plans(needs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per plan, budget, mode and threshold: conditional means over the needs and domains that have a score."""
    at = [*PLAN, "budget", "mode", "threshold"]
    each = needs.withColumn("threshold", F.explode(_listed(thresholds).cast("array<double>"))).withColumn("binary", (F.col("weight") >= F.col("threshold")).cast("double"))
    domain = each.groupBy(*at, "target_domain").agg(F.avg("binary").alias("binary"), F.avg("weight").alias("weighted"), F.count(F.lit(1)).alias("needs"), F.count("weight").alias("evaluated"), F.sum("pairs").alias("pairs"), F.sum("eligible").alias("eligible"))
    out = domain.groupBy(*at).agg(F.avg("binary").alias("binary"), F.avg("weighted").alias("weighted"), F.count("weighted").alias("evaluated_domains"), *[F.sum(c).alias(c) for c in ("needs", "evaluated", "pairs", "eligible")])
    return out.withColumn("excluded", F.col("needs") - F.col("evaluated"))


def whole_plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about PAIRS_AT_ONCE rows of rows that come by plan_id, cut between plans only."""
    held, n, most = [], 0, PAIRS_AT_ONCE
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        plans = table.column("plan_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(plans, plans[-1]))  # numbered as they come; the last plan may go on
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
        most = max(PAIRS_AT_ONCE, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


class _Means:
    """Sums over plans of what satisfaction_plans() says of each, by source and size; whole plans are given."""

    def __init__(self, budgets: list[int | None], thresholds: list[float]):
        self.budgets, self.thresholds = budgets, thresholds
        self.sums: dict[tuple, np.ndarray] = {}

    def add(self, rows: pa.Table) -> None:
        codes = [rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in NEED]
        keys = [c.indices.to_numpy(zero_copy_only=False) for c in codes]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]

        def heads(columns: list[np.ndarray]) -> np.ndarray:
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for k in columns:
                new[1:] |= k[1:] != k[:-1]
            return np.flatnonzero(new)

        plan, domain, need = heads(keys[:3]), heads(keys[:4]), heads(keys)
        domain_at, plan_at = np.searchsorted(need, domain), np.searchsorted(domain, plan)  # of the needs, of the domains

        def mean(total: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of each group that starts at `at`: the mean of total / n where n is not 0, and whether there is any."""
            some = n > 0
            each = np.add.reduceat(np.where(some, total / np.maximum(n, 1), 0.0), at)
            n = np.add.reduceat(some.astype(np.int64), at)
            return np.where(n > 0, each / np.maximum(n, 1), 0.0), n > 0

        source, size = (codes[i].dictionary.to_pylist() for i in (1, 2))
        groups, of = np.unique(keys[1][plan].astype(np.int64) * len(size) + keys[2][plan], return_inverse=True)
        count = lambda x: np.bincount(of, x, len(groups))
        plans = count(None)
        place = rows.column("place").to_numpy()[order]
        scores = [rows.column(m).to_numpy()[order] for m in MODES]
        for budget in self.budgets:
            inside = place > 0 if budget is None else (place > 0) & (place <= budget)
            for mode, score in zip(MODES, scores, strict=True):
                weight = np.maximum.reduceat(np.where(inside, score, -1.0), need)
                some = weight >= 0
                n = np.add.reduceat(some.astype(np.int64), domain_at)
                weighted, held = mean(np.add.reduceat(np.where(some, weight, 0.0), domain_at), n, plan_at)
                for threshold in self.thresholds:
                    hit = np.add.reduceat((some & (weight >= threshold)).astype(np.float64), domain_at)
                    binary, _ = mean(hit, n, plan_at)
                    new = np.stack([plans, count(held.astype(np.float64)), count(weighted), count(binary)], 1)
                    for g, x in zip(groups.tolist(), new, strict=True):
                        at = (source[g // len(size)], size[g % len(size)], budget, mode, threshold)
                        self.sums[at] = self.sums.get(at, 0.0) + x

    def batch(self) -> pa.RecordBatch:
        rows = [[*at, int(x[0]), int(x[1]), float(x[2]), float(x[3])] for at, x in self.sums.items()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["source_domain", "domain_count", "budget", "mode", "threshold", "plans", "held", "weighted", "binary"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def satisfaction_sources(scored: DataFrame, budgets: list[int | None], thresholds: list[float], by_plan: bool = False) -> DataFrame:
    """Per source, size, budget, mode and threshold: plans, weighted and binary, the means over plans of satisfaction_plans().

    Reads each pair once for all budgets, modes and thresholds. Pairs without a saved score may be left out of
    `scored` as long as each need keeps a row. by_plan says that a plan's rows lie together in one partition already.
    """
    field = {"cosine_observed": "cosine_norm", "hybrid_complete": "hybrid", "cosine_complete": "cosine_norm", "bm25_complete": "bm25_norm"}
    ok = lambda m: F.col("cosine").isNotNull() if m == "cosine_observed" else F.col("both")
    place = F.when(F.col("candidate_id").isNotNull(), F.col("position")).otherwise(0)
    # Scores lie in [0, 1]; -1 stands for none. A candidate without position is within no limit only.
    rows = scored.select(*NEED, F.coalesce(place, F.lit(2**31 - 1)).cast("int").alias("place"), *[F.coalesce(F.when(ok(m), F.col(field[m])), F.lit(-1.0)).alias(m) for m in MODES])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = _Means(budgets, thresholds)
        for table in whole_plans(batches):
            means.add(table)
        if means.sums:
            yield means.batch()

    names = "source_domain string, domain_count int, budget int, mode string, threshold double"
    rows = rows if by_plan else rows.repartition("plan_id").sortWithinPartitions("plan_id")
    sums = rows.mapInArrow(summed, f"{names}, plans long, held long, weighted double, binary double")
    by = ["source_domain", "domain_count", "budget", "mode", "threshold"]
    mean = lambda c: F.when(F.sum("held") > 0, F.sum(c) / F.sum("held")).alias(c)
    return sums.groupBy(*by).agg(F.sum("plans").alias("plans"), mean("weighted"), mean("binary"))


def rank_strength(scored: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Per plan: the mean over domains of the mean over needs of the strongest candidate's summed rank fusion,
    1 where both methods rank it first. A need without a hit counts 0."""
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    strength = (part("cosine_rank") + part("bm25_rank")) / (2 / (rrf_k + 1))
    need = scored.groupBy(*NEED).agg(F.max(strength).alias("strength"))
    domain = need.groupBy(*PLAN, "target_domain").agg(F.avg("strength").alias("strength"), F.count_if(F.col("strength") == 0).alias("without"), F.count(F.lit(1)).alias("needs"))
    return domain.groupBy(*PLAN).agg(F.avg("strength").alias("strength"), F.sum("without").alias("without"), F.sum("needs").alias("needs"))


def possible_combinations(spark: SparkSession, domains: list[str], sizes: list[int]) -> DataFrame:
    """source_domain, domain_count, combination (sorted) for all sources; the list of domains is short."""
    rows = [(s, k, list(c)) for k in sizes for s in domains for c in combinations(sorted(set(domains) - {s}), k - 1)]
    return spark.createDataFrame(rows, "source_domain string, domain_count int, combination array<string>")


def combination_counts(plans: DataFrame, domains: list[str], sizes: list[int]) -> DataFrame:
    """Every possible combination of each source and size with its count and share (null where there is no plan)."""
    at = ["source_domain", "domain_count"]
    counts = plans.groupBy(*at, F.array_sort("fusion_domains").alias("combination")).agg(F.count(F.lit(1)).alias("n"))
    every = possible_combinations(plans.sparkSession, domains, sizes).join(counts, [*at, "combination"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = every.groupBy(*at).agg(F.sum("n").alias("plans"))
    return every.join(total, at).withColumn("share", F.when(F.col("plans") > 0, F.col("n") / F.col("plans")))


def _entropy(n: Column, total: Column) -> Column:
    """-sum p ln p, from sum n ln n: no second pass over the groups."""
    return F.greatest(F.lit(0.0), F.ln(total) - F.sum(F.when(n > 0, n * F.ln(n)).otherwise(0.0)) / total)


def selection_rates(counts: DataFrame) -> DataFrame:
    """Per source, size and target: how many plans take it, of plans (inclusion) and of slots."""
    out = counts.withColumn("target_domain", F.explode("combination")).groupBy("source_domain", "domain_count", "plans", "target_domain").agg(F.sum("n").alias("n"))
    return out.withColumn("inclusion", F.when(F.col("plans") > 0, F.col("n") / F.col("plans"))).withColumn("slot", F.col("inclusion") / (F.col("domain_count") - 1))


def combination_entropy(counts: DataFrame, domains: list[str]) -> DataFrame:
    """Per source and size: entropy, dde (by the log of the possible), coverage, marginal dde, status."""
    at = ["source_domain", "domain_count"]
    out = counts.groupBy(*at, "plans").agg(F.count(F.lit(1)).alias("possible"), F.count_if(F.col("n") > 0).alias("observed"), _entropy(F.col("n"), F.first("plans")).alias("entropy"))
    targets = selection_rates(counts).groupBy(*at).agg(_entropy(F.col("n"), F.sum("n")).alias("marginal"))
    some = F.col("plans") > 0
    out = out.join(targets, at).select(
        *at, "plans", "possible", "observed", F.when(some, F.col("entropy")).alias("entropy"),
        F.when(some & (F.col("possible") > 1), F.col("entropy") / F.ln("possible")).alias("dde"),
        F.when(some, F.col("observed") / F.col("possible")).alias("coverage"),
        (F.when(some, F.col("marginal") / math.log(len(domains) - 1)) if len(domains) > 2 else F.lit(None).cast("double")).alias("marginal_dde"),
        F.when(~some, "missing").when(F.col("possible") == 1, "single_possible_combination").otherwise("ok").alias("status"),
    )
    return out


def entropy_macro(per_source: DataFrame, domains: list[str]) -> DataFrame:
    """Per size: the mean dde over sources, null unless all have plans; the mean of those seen beside it."""
    complete = F.count_if(F.col("plans") > 0) == len(domains)
    missing = F.array_sort(F.collect_set(F.when(F.col("plans") == 0, F.col("source_domain"))))
    return per_source.groupBy("domain_count").agg(F.sum("plans").alias("plans"), F.count_if(F.col("plans") > 0).alias("observed_sources"), F.when(complete, F.avg("dde")).alias("macro_dde"), F.avg("dde").alias("observed_dde"), F.when(complete, F.avg("coverage")).alias("macro_coverage"), missing.alias("missing_sources"))


def conditions(samples: DataFrame) -> DataFrame:
    """The requests of each sample: full, no_domain, and mask and only for each domain (2 k + 2 rows).

    samples: sample_id, domains, and whatever else; adds condition and domain.
    """
    one = lambda name: F.array(F.struct(F.lit(name).alias("condition"), F.lit(None).cast("string").alias("domain")))
    each = lambda name: F.transform("domains", lambda d: F.struct(F.lit(name).alias("condition"), d.alias("domain")))
    return samples.withColumn("_c", F.explode(F.concat(one("full"), one("no_domain"), each("mask"), each("only")))).select("*", "_c.condition", "_c.domain").drop("_c")


def outcomes(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adds correct (1, 0, or null where there is no valid answer) and abstained to each request.

    requests: sample_id, condition, domain, answer; predictions: the same key, status, answer.
    """
    told = predictions.select("sample_id", "condition", F.col("domain").alias("_domain"), "status", F.col("answer").alias("given"))
    on = (requests.sample_id == told.sample_id) & (requests.condition == told.condition) & requests.domain.eqNullSafe(told._domain)
    rows = requests.join(told, on, "left").drop(told.sample_id).drop(told.condition).drop("_domain")
    ok = F.col("status") == "ok"
    return rows.withColumn("correct", F.when(ok, (F.col("given") == F.col("answer")).cast("int"))).withColumn("abstained", F.coalesce(ok & (F.col("given") == "ABSTAIN"), F.lit(False)))


def masking_samples(rows: DataFrame) -> DataFrame:
    """Per sample: full, best masked answer, complete, cdns (right with all, wrong without any one domain), ig."""
    mask = F.col("condition") == "mask"
    out = rows.where("condition in ('full', 'mask')").groupBy("sample_id", "source_domain", "k", "difficulty").agg(F.max(F.when(F.col("condition") == "full", F.col("correct"))).alias("full"), F.max(F.when(mask, F.col("correct"))).alias("best_mask"), F.count_if(mask).alias("masks"), F.count_if(mask & F.col("correct").isNotNull()).alias("answered"))
    complete = F.col("full").isNotNull() & (F.col("answered") == F.col("masks")) & (F.col("masks") > 0)
    return out.withColumn("complete", complete).withColumn("cdns", F.when(complete, ((F.col("full") == 1) & (F.col("best_mask") == 0)).cast("int"))).withColumn("ig", F.when(complete, F.col("full") - F.col("best_mask")))


def masking_summary(samples: DataFrame) -> DataFrame:
    """The scores overall, by k, difficulty, source and k with difficulty, in one grouping-sets pass."""
    when = lambda c: F.avg(F.when(F.col("complete"), F.col(c)))
    keys = ["k", "difficulty", "source_domain"]
    out = samples.groupingSets([[], ["k"], ["difficulty"], ["source_domain"], ["k", "difficulty"]], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("samples"), F.count_if("complete").alias("complete"), when("cdns").alias("cdns"), when("ig").alias("ig"), when("full").alias("full_accuracy"), when("best_mask").alias("best_mask_accuracy"))
    name = F.when(F.col("g") == 7, "overall").when(F.col("g") == 3, "k").when(F.col("g") == 5, "difficulty").when(F.col("g") == 6, "source_domain").otherwise("k_difficulty")
    return out.withColumn("group_by", name).drop("g")


def domain_contributions(rows: DataFrame) -> DataFrame:
    """Per masked domain: the mean of full minus masked over samples that have both answers."""
    full = rows.where("condition = 'full'").select("sample_id", F.col("correct").alias("full"))
    paired = rows.where("condition = 'mask'").join(full, "sample_id", "left").withColumn("both", F.col("full").isNotNull() & F.col("correct").isNotNull())
    return paired.groupBy("domain").agg(F.count(F.lit(1)).alias("total"), F.count_if("both").alias("paired"), F.avg(F.when(F.col("both"), F.col("full") - F.col("correct"))).alias("dc"))


def condition_accuracy(rows: DataFrame) -> DataFrame:
    """Per condition and domain: requests, valid answers, abstentions, accuracy."""
    return rows.groupBy("condition", "domain").agg(F.count(F.lit(1)).alias("total"), F.count("correct").alias("valid"), F.count_if("abstained").alias("abstained"), F.avg("correct").alias("accuracy"))
