"""Statistics and routing of two independent judges and a reviewer, as DataFrame operators.

records: sample_id, judge_id (J1, J2, J3), stage, status (ok, error), output (a struct with dimensions,
flags, answer_check, domain_checks, necessity_audit and, of a review, dimension_resolutions, unresolved_issues,
human_review_required). samples: sample_id, source_domain, k, difficulty. A score is 0 to 4, or null where the
judge found the dimension unjudgeable. The judges' dimensions are five, so the rows of a sample are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Dimensions, stages, critical flags, and the dimension that a confirmed flag bears on.
DIMENSIONS = ["cross_domain_necessity", "fusion_dependency", "correctness_evaluability", "knowledge_grounding", "naturalness_clarity"]
INITIAL_STAGES = ["blind_structure", "evidence_scoring"]
CRITICAL_FLAGS = ["key_answer_error", "single_domain_shortcut", "subset_shortcut", "redundant_domain", "source_contradiction"]
FLAG_DIMENSIONS = {
    "key_answer_error": "correctness_evaluability",
    "single_domain_shortcut": "cross_domain_necessity",
    "subset_shortcut": "cross_domain_necessity",
    "redundant_domain": "cross_domain_necessity",
    "source_contradiction": "knowledge_grounding",
    "invalid_dependency": "fusion_dependency",
}
PASS = 3
OUTPUT = (
    "struct<dimensions:map<string,struct<status:string,score:int>>,flags:array<struct<type:string,status:string>>,answer_check:struct<status:string>,"
    "domain_checks:array<struct<domain:string,necessity:string>>,necessity_audit:struct<status:string>,"
    "dimension_resolutions:array<struct<dimension:string,recommended_status:string,recommended_score:int,basis:string>>,unresolved_issues:array<string>,human_review_required:boolean>"
)
RECORD = f"sample_id string, judge_id string, stage string, status string, output {OUTPUT}"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def record_issues(records: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds issue, the first of unknown_record, bad_stage, repeated_record, bad_status, bad_scores, or null."""
    known = samples.select(F.col("sample_id").alias("_id")).distinct()
    rows = records.join(known, records.sample_id == F.col("_id"), "left")
    again = F.count(F.lit(1)).over(Window.partitionBy("sample_id", "judge_id", "stage")) > 1
    stage = F.col("stage").isin(INITIAL_STAGES) | ((F.col("stage") == "adjudication") & (F.col("judge_id") == "J3"))
    of = lambda d: F.col("output.dimensions")[d]
    fit = F.size(F.map_keys("output.dimensions")) == len(DIMENSIONS)
    for d in DIMENSIONS:
        fit &= ((of(d).status == "unjudgeable") & of(d).score.isNull()) | ((of(d).status == "scored") & of(d).score.between(0, 4))
    scored = (F.col("status") == "ok") & (F.col("stage") == "evidence_scoring")
    issue = F.when(F.col("_id").isNull() | ~F.col("judge_id").isin("J1", "J2", "J3"), "unknown_record").when(~stage, "bad_stage").when(again, "repeated_record")
    issue = issue.when(~F.coalesce(F.col("status").isin("ok", "error"), F.lit(False)), "bad_status").when(scored & ~F.coalesce(fit, F.lit(False)), "bad_scores")
    return rows.withColumn("issue", issue).drop("_id")


def _confirmed(flag: str) -> Callable[[Column], Column]:
    return lambda f: (f.type == flag) & (f.status == "confirmed")


def _prefixed(values: Column, head: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.concat(F.lit(head), x))


def consistent() -> Column:
    """Whether an evidence output's scores agree with its necessity audit and its confirmed flags."""
    need = F.col("output.dimensions")["cross_domain_necessity"].score
    audit = F.coalesce(F.col("output.necessity_audit.status"), F.lit(""))
    ok = ~((audit == "verified_shortcut") & (F.coalesce(need, F.lit(PASS)) >= PASS)) & ~((audit == "unresolved") & need.isNotNull())
    for flag, d in FLAG_DIMENSIONS.items():
        told = F.coalesce(F.exists("output.flags", _confirmed(flag)), F.lit(False))
        ok &= ~(told & (F.coalesce(F.col("output.dimensions")[d].score, F.lit(0)) >= PASS))
    return ok


def critical() -> Column:
    """The critical findings of an output, flagged or found in its structured checks."""
    out = F.col("output")
    listed = F.transform(F.filter(F.coalesce(out.flags, F.array().cast("array<struct<type:string,status:string>>")), lambda f: f.type.isin(CRITICAL_FLAGS)), lambda f: F.concat_ws(":", f.type, f.status))
    checks = lambda value: F.coalesce(F.exists(out.domain_checks, lambda c: c.necessity == value), F.lit(False))
    audit = F.coalesce(out.necessity_audit.status, F.lit(""))
    more = F.array(
        F.when(out.answer_check.status.isin("incorrect", "ambiguous"), F.lit("key_answer_error:structured_answer_check")),
        F.when(checks("redundant"), F.lit("redundant_domain:structured_domain_check")),
        F.when(audit == "verified_shortcut", F.lit("subset_shortcut:verified_necessity_audit")),
        F.when((audit == "unresolved") | checks("uncertain"), F.lit("necessity_uncertain:unresolved_necessity_audit")),
    )
    return F.concat(listed, F.array_compact(more))


def judgments(records: DataFrame) -> DataFrame:
    """sample_id, judge_id, complete (both initial stages there and consistent), scores (a map, of the evidence stage), critical."""
    ok = F.col("status") == "ok"
    evidence = ok & (F.col("stage") == "evidence_scoring")
    rows = records.where("stage <> 'adjudication'").select("sample_id", "judge_id", "stage", ok.alias("ok"), F.when(evidence, consistent()).alias("fits"), F.when(evidence, F.transform_values("output.dimensions", lambda _, v: v.score)).alias("scores"), F.when(evidence, critical()).alias("critical"))
    out = rows.groupBy("sample_id", "judge_id").agg(F.count_if("ok").alias("n"), F.max("fits").alias("fits"), F.first("scores", ignorenulls=True).alias("scores"), F.first("critical", ignorenulls=True).alias("critical"))
    return out.select("sample_id", "judge_id", ((F.col("n") == len(INITIAL_STAGES)) & F.coalesce("fits", F.lit(False))).alias("complete"), "scores", "critical")


def _passes(scores: Column) -> Column:
    return F.forall(F.map_values(scores), lambda x: F.coalesce(x >= PASS, F.lit(False)))


def routes(samples: DataFrame, records: DataFrame, fraction: float = 0.1, seed: str = "20261005") -> DataFrame:
    """Per sample: reasons for a review, whether a rule or the audit chose it, the initial verdict, the final status.

    The audit takes ceil(fraction * n) of the samples that pass without a rule, in the order of a hash, for
    each source, size and difficulty. Its rank is a window over one stratum; strata split by the hash first,
    so no task holds more of a stratum than the fraction keeps plus one slice (see audit_sample).
    """
    told = judgments(records)
    side = lambda j: told.where(F.col("judge_id") == j).select("sample_id", F.struct("complete", "scores", "critical").alias(j))
    rows = samples
    for j in ("J1", "J2", "J3"):
        rows = rows.join(side(j), "sample_id", "left")
    both = F.coalesce(F.col("J1.complete") & F.col("J2.complete"), F.lit(False))
    found = []
    for d in DIMENSIONS:
        a, b = F.col("J1.scores")[d], F.col("J2.scores")[d]
        found += [F.when(a.isNull() | b.isNull(), F.lit(f"unjudgeable:{d}")), F.when(F.abs(a - b) >= 2, F.lit(f"numeric_gap:{d}")), F.when((a >= PASS) != (b >= PASS), F.lit(f"threshold_disagreement:{d}"))]
    flags = [_prefixed(F.col(f"{j}.critical"), f"critical_flag:{j}:") for j in ("J1", "J2")]
    rows = rows.withColumn("paired", both).withColumn("rules", F.when(both, F.concat(F.array_compact(F.array(*found)), *flags)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("initial_pass", F.when(both, _passes(F.col("J1.scores")) & _passes(F.col("J2.scores")))).withColumn("rule_triggered", F.size("rules") > 0)
    chosen = audit_sample(rows.where("paired and not rule_triggered and initial_pass"), ["source_domain", "k", "difficulty"], "sample_id", fraction, seed)
    rows = rows.join(chosen.select("sample_id", F.lit(True).alias("audit_selected")), "sample_id", "left").withColumn("audit_selected", F.coalesce("audit_selected", F.lit(False)))
    reviews = records.where("stage = 'adjudication' and status = 'ok'").select("sample_id", F.col("output").alias("review"))
    rows = rows.join(reviews, "sample_id", "left").withColumn("needs_review", F.col("rule_triggered") | F.col("audit_selected"))
    return _final(rows)


def _final(rows: DataFrame) -> DataFrame:
    """Adds the verdict after review, the reasons for a human, and the status."""
    empty = F.array().cast("array<string>")
    resolved = F.col("review.dimension_resolutions")
    covered = (F.size(resolved) == len(DIMENSIONS)) & (F.size(F.array_except(_strings(DIMENSIONS), F.transform(resolved, lambda r: r.dimension))) == 0)
    valid = F.forall(resolved, lambda r: ((r.recommended_status == "unjudgeable") & r.recommended_score.isNull()) | ((r.recommended_status == "scored") & r.recommended_score.between(0, 4)))
    reviewed = F.coalesce(F.col("J3.complete"), F.lit(False)) & F.col("review").isNotNull() & F.coalesce(covered & valid, F.lit(False))
    flags = [_prefixed(F.col(f"{j}.critical"), f"{j}:") for j in ("J1", "J2", "J3")]
    agreed = F.forall(resolved, lambda r: F.coalesce(r.recommended_score >= PASS, F.lit(False)))
    audit = F.col("review.necessity_audit.status")
    more = F.array_compact(F.array(
        F.when(F.exists(resolved, lambda r: F.coalesce(F.trim(r.basis) == "", F.lit(True))), F.lit("missing_resolution_basis")),
        F.when(audit.isin("verified_shortcut", "unresolved"), F.concat(F.lit("adjudication_necessity:"), audit)),
        F.when(F.exists(resolved, lambda r: r.recommended_score.isNull()), F.lit("unjudgeable_after_review")),
        F.when(F.size(F.coalesce(F.col("review.unresolved_issues"), empty)) > 0, F.lit("unresolved_issues")),
        F.when(F.col("review.human_review_required"), F.lit("reviewer_requested_human")),
        F.when(agreed != F.col("initial_pass"), F.lit("initial_joint_pass_changed")),
    ))
    rows = rows.withColumn("reviewed", reviewed).withColumn("recommended_pass", F.when(F.col("needs_review") & F.col("reviewed"), agreed))
    human = F.when(F.col("needs_review"), F.concat(*flags, F.when(F.col("reviewed"), more).otherwise(empty))).otherwise(empty)
    rows = rows.withColumn("human_reasons", human)
    status = (
        F.when(~F.col("paired"), "execution_incomplete")
        .when(~F.col("needs_review"), F.when(F.col("initial_pass"), "llm_consensus_pass").otherwise("llm_consensus_fail"))
        .when(F.size("human_reasons") > 0, "pending_human")
        .when(~F.col("reviewed"), "pending_review")
        .otherwise(F.when(F.col("recommended_pass"), "llm_resolved_pass").otherwise("llm_resolved_fail"))
    )
    reasons = F.concat(F.when(F.col("paired"), F.col("rules")).otherwise(_strings(["execution_incomplete"])), F.when(F.col("audit_selected"), _strings(["stratified_audit"])).otherwise(empty))
    return rows.select("sample_id", "source_domain", "k", "difficulty", "paired", reasons.alias("reasons"), "rule_triggered", "audit_selected", "needs_review", "initial_pass", "recommended_pass", "human_reasons", status.alias("status"))


def audit_sample(rows: DataFrame, strata: list[str], key: str, fraction: float, seed: str, slices: int = 64) -> DataFrame:
    """The first ceil(fraction * n) rows of each stratum by a hash of seed, stratum and id; independent of order.

    Counts by slice of the hash tell which slices are taken whole and which one is cut, so a rank is taken
    inside one slice of a stratum only.
    """
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie in [0, 1]")
    named = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata], F.col(key).cast("string"))
    rows = rows.withColumn("_h", F.sha2(named, 256))
    rows = rows.withColumn("_s", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("long") * slices / 65536).cast("int"))
    sizes = rows.groupBy(*strata, "_s").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*strata).orderBy("_s")  # at most `slices` rows a stratum
    sizes = sizes.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).withColumn("_want", F.ceil(F.sum("_n").over(Window.partitionBy(*strata)) * F.lit(fraction)))
    sizes = sizes.select(*[F.col(s).alias(f"_{s}") for s in strata], F.col("_s").alias("_slice"), "_before", "_want").where("_before < _want")
    same = F.col("_s") == F.col("_slice")
    for s in strata:
        same &= F.col(s).eqNullSafe(F.col(f"_{s}"))
    place = F.row_number().over(Window.partitionBy(*strata, "_s").orderBy("_h", key))
    out = rows.join(sizes, same).withColumn("_at", place + F.col("_before")).where("_at <= _want")
    return out.drop("_h", "_s", "_slice", "_before", "_want", "_at", *[f"_{s}" for s in strata])


def scores(records: DataFrame) -> DataFrame:
    """sample_id, judge_id, dimension, score of samples that both initial judges completed."""
    told = judgments(records).where("judge_id in ('J1', 'J2') and complete")
    paired = told.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("sample_id")
    return told.join(paired, "sample_id").select("sample_id", "judge_id", F.explode("scores").alias("dimension", "score"))


def _rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of)


def dimension_statistics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group, judge and dimension: mean, deviation, median, counts of each score, pass and unjudgeable rates."""
    at, s = [*(by or []), "judge_id", "dimension"], F.col("score")
    out = scored.groupBy(*at).agg(F.count(F.lit(1)).alias("denominator"), F.count(s).alias("numeric_n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("sample_sd"), F.percentile(s, 0.5).alias("median"), F.count_if(s >= PASS).alias("pass_count"), *[F.count_if(s == i).alias(f"score_{i}_count") for i in range(5)])
    n, every = F.col("numeric_n"), F.col("denominator")
    return out.withColumn("unjudgeable_count", every - n).withColumn("pass_rate", _rate(F.col("pass_count"), every)).withColumn("numeric_pass_rate", _rate(F.col("pass_count"), n)).withColumn("unjudgeable_rate", _rate(every - n, every))


def disagreement(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group and dimension: how often two judges differ at all, by two or more, or across the pass mark."""
    keys = [*(by or []), "dimension"]
    of = lambda j: F.max(F.when(F.col("judge_id") == j, F.col("score")))
    rows = scored.groupBy(*keys, "sample_id").agg(of("J1").alias("a"), of("J2").alias("b"))
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    counts = {"exact": both & (a != b), "large": both & (F.abs(a - b) >= 2), "threshold": both & ((a >= PASS) != (b >= PASS)), "u_status": a.isNull() != b.isNull(), "consensus": both & (a >= PASS) & (b >= PASS)}
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("paired"), F.count_if(both).alias("numeric_pairs"), *[F.count_if(c).alias(f"{n}_count") for n, c in counts.items()])
    for n in counts:
        out = out.withColumn(f"{n}_rate", _rate(F.col(f"{n}_count"), F.col("paired" if n in ("u_status", "consensus") else "numeric_pairs")))
    return out


def status_table(routed: DataFrame, by: list[str]) -> DataFrame:
    """Per group: planned and paired samples, completion, and the count and rate of each final status."""
    names = ["execution_incomplete", "pending_review", "pending_human", "llm_consensus_pass", "llm_consensus_fail", "llm_resolved_pass", "llm_resolved_fail"]
    out = routed.groupBy(*by).agg(F.count(F.lit(1)).alias("planned"), F.count_if("paired").alias("paired"), F.count_if("rule_triggered").alias("triggered"), F.count_if("audit_selected").alias("audited"), *[F.count_if(F.col("status") == n).alias(n) for n in names])
    return out.withColumn("completion", _rate(F.col("paired"), F.col("planned")))
