"""Checks of nested records of the generation stages: each adds issues, what is wrong with a row in a fixed order.

A row without issues is fit; accepted() and rejected() part the two. Texts are compared squeezed and case folded.
All checks are column expressions on structs, arrays and maps, so a row is judged where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.operators.retrieval import folded

# Option letters, kinds of wrong options, states of coverage, checks of an audit, word budgets.
LABELS = ["A", "B", "C", "D"]
ERROR_TYPES = ["missing_domain_knowledge", "parallel_knowledge", "incorrect_domain_relation"]
COVERAGE = ["sufficient", "partial", "none"]
AUDIT_CHECKS = ["single_target", "self_contained", "evidence_grounded", "no_knowledge_giveaway", "same_answer_form", "no_surface_shortcut"]
WORDS_AT_TWO, WORDS_A_DOMAIN, CHARS_A_WORD = 130, 30, 12


def listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal(c: Column) -> Column:
    return folded(squeezed(c))


def blank(c: Column) -> Column:
    return F.coalesce(squeezed(c) == "", F.lit(True))


def _not(ok: Column) -> Column:
    """True where ok is false or unknown."""
    return ~F.coalesce(ok, F.lit(False))


def _different(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def with_issues(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks])))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issues") == 0).drop("issues")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("issues") > 0)


def _sample_ok(s: Column) -> Column:
    return ~blank(s["prompt"]) & ~blank(s["completion"])


def base_record(rows: DataFrame) -> DataFrame:
    """The columns that every later stage carries along."""
    return rows.select("source_domain", "sample", "fusion_domains", "fusion_idea", "queries")


def query_issues(rows: DataFrame, domains: list[str], each: int = 3) -> DataFrame:
    """source_domain, sample, fusion_idea, fusion_domains, queries (map of lists)."""
    return with_issues(rows, query_checks(domains, each))


def query_checks(domains: list[str], each: int = 3) -> list[tuple[str, Column]]:
    known, added, asked = listed(domains), F.col("fusion_domains"), F.col("queries")
    lists = F.map_values(asked)
    return [
        ("unknown_source", _not(F.array_contains(known, F.col("source_domain")))),
        ("empty_sample", _not(_sample_ok(F.col("sample")))),
        ("empty_idea", blank(F.col("fusion_idea"))),
        ("bad_fusion_domains", _not((F.size(added) > 0) & _different(added) & (F.size(F.array_except(added, known)) == 0) & ~F.array_contains(added, F.col("source_domain")))),
        ("queries_do_not_cover_domains", _not(same_set(F.map_keys(asked), added))),
        ("bad_query_count", _not(F.forall(lists, lambda v: F.size(v) == each))),
        ("empty_query", _not(F.forall(lists, lambda v: F.forall(v, lambda q: ~blank(q))))),
        ("repeated_query", _not(F.forall(lists, lambda v: _different(F.transform(v, normal))))),
    ]


def proposal_issues(rows: DataFrame, domains: list[str]) -> DataFrame:
    """source_domain, sample, combinations (structs of domains, reason, fusion_confidence; null for none), reason."""
    known, c = listed(domains), F.col("combinations")
    key = F.transform(c, lambda p: F.array_join(F.array_sort(p.domains), "\u0000"))
    one = lambda p: (F.size(p.domains) > 0) & _different(p.domains) & (F.size(F.array_except(p.domains, known)) == 0) & ~F.array_contains(p.domains, F.col("source_domain"))
    return with_issues(rows, [
        ("unknown_source", _not(F.array_contains(known, F.col("source_domain")))),
        ("empty_sample", _not(_sample_ok(F.col("sample")))),
        ("none_without_reason", c.isNull() & blank(F.col("reason"))),
        ("no_proposal", F.size(c) == 0),
        ("bad_domains", c.isNotNull() & _not(F.forall(c, one))),
        ("repeated_proposal", c.isNotNull() & _not(_different(key))),
        ("empty_reason", F.exists(c, lambda p: blank(p.reason))),
        ("bad_confidence", F.exists(c, lambda p: _not(p.fusion_confidence.between(0.0, 1.0)))),
    ])


def idea_issues(rows: DataFrame) -> DataFrame:
    """source_domain, fusion_domains, status, reason, idea (struct of idea, correct_answer_plan, distractor_plans)."""
    domains = F.concat(F.array("source_domain"), F.col("fusion_domains"))
    idea, feasible = F.col("idea"), F.col("status") == "feasible"
    of = F.transform(idea["distractor_plans"], lambda d: d.missing_domain)
    plans = F.concat(F.array(idea["correct_answer_plan"]), F.transform(idea["distractor_plans"], lambda d: d.plan))
    return with_issues(rows, [
        ("bad_status", _not(F.col("status").isin("feasible", "not_feasible"))),
        ("infeasible_with_idea", (F.col("status") == "not_feasible") & idea.isNotNull()),
        ("infeasible_without_reason", (F.col("status") == "not_feasible") & blank(F.col("reason"))),
        ("empty_idea", feasible & blank(idea["idea"])),
        ("distractors_do_not_cover_domains", feasible & _not(same_set(of, domains) & _different(of) & (F.size(of) == F.size(domains)))),
        ("empty_plan", feasible & _not(F.forall(plans, lambda p: ~blank(p)))),
        ("equal_plans", feasible & _not(_different(F.transform(plans, normal)))),
    ])


def in_domain_order(plans: Column, domains: Column) -> Column:
    """Distractor plans in the order of the domains."""
    return F.transform(domains, lambda d: F.filter(plans, lambda p: p.missing_domain == d)[0])


def candidate_issues(rows: DataFrame, domains: list[str]) -> DataFrame:
    """A query row with candidates: a map of lists of (candidate_id, sample, source_file, source_line)."""
    c = F.col("candidates")
    every = F.flatten(F.map_values(c))
    prefixed = F.forall(F.map_entries(c), lambda e: F.forall(e.value, lambda x: F.startswith(x.candidate_id, F.concat(e.key, F.lit(":")))))
    return with_issues(rows, query_checks(domains) + [
        ("candidates_do_not_cover_domains", _not(same_set(F.map_keys(c), F.col("fusion_domains")))),
        ("wrong_candidate_domain", _not(prefixed)),
        ("repeated_candidate", _not(_different(F.transform(every, lambda x: x.candidate_id)))),
        ("empty_candidate_sample", _not(F.forall(every, lambda x: _sample_ok(x.sample)))),
        ("bad_candidate_source", _not(F.forall(every, lambda x: ~blank(x.source_file) & (x.source_line >= 1)))),
    ])


def _quotes_ok(evidence: Column, sample: Column) -> Column:
    field = lambda q: F.when(q.field == "prompt", sample["prompt"]).when(q.field == "completion", sample["completion"])
    return F.forall(evidence, lambda q: ~blank(q.quote) & F.coalesce(F.contains(field(q), q.quote), F.lit(False)))


def decision_issues(rows: DataFrame) -> DataFrame:
    """candidates (structs of candidate_id, sample) and decisions (candidate_id, keep, supported_knowledge, reason, evidence)."""
    c, d = F.col("candidates"), F.col("decisions")
    ids = F.transform(d, lambda x: x.candidate_id)
    of = lambda x: F.filter(c, lambda y: y.candidate_id == x.candidate_id)[0]["sample"]
    kept = lambda x: ~blank(x.supported_knowledge) & (F.size(x.evidence) > 0)
    return with_issues(rows, [
        ("decisions_do_not_cover_candidates", _not((F.size(d) == F.size(c)) & _different(ids) & same_set(ids, F.transform(c, lambda y: y.candidate_id)))),
        ("no_verdict", F.exists(d, lambda x: x.keep.isNull())),
        ("empty_reason", F.exists(d, lambda x: blank(x.reason))),
        ("kept_without_evidence", F.exists(d, lambda x: x.keep & ~F.coalesce(kept(x), F.lit(False)))),
        ("quote_not_in_sample", F.exists(d, lambda x: x.keep & ~F.coalesce(_quotes_ok(x.evidence, of(x)), F.lit(False)))),
        ("rejected_with_evidence", F.exists(d, lambda x: ~x.keep & ~F.coalesce((x.supported_knowledge == "") & (F.size(x.evidence) == 0), F.lit(False)))),
    ])


def _coverage_checks(status: Column, taken: Column, missing: Column) -> list[tuple[str, Column]]:
    """What a state of coverage asks of the materials taken and of the gap named."""
    return [
        ("bad_coverage_status", _not(status.isin(COVERAGE))),
        ("none_with_materials", (status == "none") & (taken > 0)),
        ("coverage_without_materials", status.isin("sufficient", "partial") & _not(taken > 0)),
        ("sufficient_with_gap", (status == "sufficient") & _not(missing == "")),
        ("gap_not_named", status.isin("partial", "none") & blank(missing)),
    ]


def coverage_issues(rows: DataFrame, most: int = 3) -> DataFrame:
    """candidates (structs of candidate_id), status, selected_ids, missing_knowledge."""
    ids = F.col("selected_ids")
    allowed = F.transform("candidates", lambda c: c.candidate_id)
    return with_issues(rows, [
        ("bad_selection", _not((F.size(ids) <= most) & _different(ids) & (F.size(F.array_except(ids, allowed)) == 0))),
        *_coverage_checks(F.col("status"), F.size(ids), F.col("missing_knowledge")),
    ])


def knowledge_issues(rows: DataFrame, domains: list[str]) -> DataFrame:
    """A query row with knowledge: a map of (status, materials, missing_knowledge)."""
    k = F.col("knowledge")
    every = F.flatten(F.transform(F.map_values(k), lambda v: v.materials))
    any_of = lambda i: F.exists(F.map_values(k), lambda v: F.coalesce(_coverage_checks(v.status, F.size(v.materials), v.missing_knowledge)[i][1], F.lit(False)))
    names = [n for n, _ in _coverage_checks(F.lit(""), F.lit(0), F.lit(""))]
    prefixed = F.forall(F.map_entries(k), lambda e: F.forall(e.value.materials, lambda x: F.startswith(x.candidate_id, F.concat(e.key, F.lit(":")))))
    return with_issues(rows, query_checks(domains) + [
        ("knowledge_does_not_cover_domains", _not(same_set(F.map_keys(k), F.col("fusion_domains")))),
        *[(n, any_of(i)) for i, n in enumerate(names)],
        ("wrong_material_domain", _not(prefixed)),
        ("repeated_material", _not(_different(F.transform(every, lambda x: x.candidate_id)))),
        ("bad_material_source", _not(F.forall(every, lambda x: _sample_ok(x.sample) & ~blank(x.source_file) & (x.source_line >= 1)))),
        ("material_without_evidence", _not(F.forall(every, lambda x: ~blank(x.supported_knowledge) & (F.size(x.evidence) > 0)))),
        ("quote_not_in_sample", _not(F.forall(every, lambda x: _quotes_ok(x.evidence, x.sample)))),
    ])


def item_issues(rows: DataFrame) -> DataFrame:
    """participating (domains, the source first), question, options (map), answer, explanation, distractor_analysis
    (option, type, missing_domain, reason), used_samples and available_samples (maps of lists of samples)."""
    o, a = F.col("options"), F.col("distractor_analysis")
    texts, wrong = F.map_values(o), F.array_except(listed(LABELS), F.array("answer"))
    kinds, marked = F.transform(a, lambda x: x.type), F.transform(a, lambda x: x.option)
    domain_ok = lambda x: F.when(x.type == "missing_domain_knowledge", F.array_contains(F.col("participating"), x.missing_domain)).otherwise(x.missing_domain.isNull())
    added = F.slice("participating", 2, F.size("participating"))
    used, there = F.col("used_samples"), F.col("available_samples")
    cited = F.forall(F.map_entries(used), lambda e: (F.size(e.value) > 0) & (F.size(F.array_except(e.value, F.coalesce(F.element_at(there, e.key), F.slice(e.value, 1, 0)))) == 0))
    return with_issues(rows, [
        ("empty_question", blank(F.col("question"))),
        ("bad_options", _not(same_set(F.map_keys(o), listed(LABELS)) & F.forall(texts, lambda t: ~blank(t)))),
        ("equal_options", _not(_different(F.transform(texts, normal)))),
        ("bad_answer", _not(F.col("answer").isin(LABELS))),
        ("empty_explanation", blank(F.col("explanation"))),
        ("bad_distractor_types", _not(same_set(kinds, listed(ERROR_TYPES)) & (F.size(kinds) == len(ERROR_TYPES)))),
        ("bad_distractor_options", _not(same_set(marked, wrong) & (F.size(marked) == 3))),
        ("bad_missing_domain", _not(F.forall(a, lambda x: F.coalesce(domain_ok(x), F.lit(False))))),
        ("empty_distractor_reason", F.exists(a, lambda x: blank(x.reason))),
        ("samples_do_not_cover_domains", _not(same_set(F.map_keys(used), added))),
        ("sample_not_supplied", _not(cited)),
    ])


def screening_issues(rows: DataFrame) -> DataFrame:
    """fusion_domains, feasible, reason, selected_samples and available_samples (maps), question_plan."""
    chosen, there = F.col("selected_samples"), F.col("available_samples")
    cited = F.forall(F.map_entries(chosen), lambda e: F.size(F.array_except(e.value, F.coalesce(F.element_at(there, e.key), F.slice(e.value, 1, 0)))) == 0)
    some = F.exists(F.map_values(chosen), lambda v: F.size(v) > 0)
    return with_issues(rows, [
        ("no_verdict", F.col("feasible").isNull()),
        ("empty_reason", blank(F.col("reason"))),
        ("selection_does_not_cover_domains", _not(same_set(F.map_keys(chosen), F.col("fusion_domains")))),
        ("sample_not_supplied", _not(cited)),
        ("feasible_without_samples", F.col("feasible") & _not(F.forall(F.map_values(chosen), lambda v: F.size(v) > 0))),
        ("infeasible_with_content", ~F.col("feasible") & (some | F.col("question_plan").isNotNull())),
    ])


def audit_record_issues(rows: DataFrame) -> DataFrame:
    """participating, correct_options, checks (map), domain_necessity (map of necessary, reason), findings, solution_summary."""
    right, checks, need = F.col("correct_options"), F.col("checks"), F.col("domain_necessity")
    return with_issues(rows, [
        ("bad_correct_options", _not(_different(right) & (F.size(F.array_except(right, listed(LABELS))) == 0))),
        ("bad_checks", _not(same_set(F.map_keys(checks), listed(AUDIT_CHECKS)) & F.forall(F.map_values(checks), lambda s: s.isin("pass", "fail", "uncertain")))),
        ("necessity_does_not_cover_domains", _not(same_set(F.map_keys(need), F.col("participating")))),
        ("empty_necessity_reason", _not(F.forall(F.map_values(need), lambda v: ~blank(v.reason)))),
        ("empty_finding", _not(F.forall("findings", lambda x: ~blank(x)))),
        ("empty_summary", blank(F.col("solution_summary"))),
    ])


def audit_findings(rows: DataFrame) -> DataFrame:
    """Adds expanded: what a fit audit found against the item (check, detail), in a fixed order; and clean."""
    entry = lambda check, detail: F.struct(F.lit(check).alias("check") if isinstance(check, str) else check.alias("check"), detail.alias("detail"))
    right = F.col("correct_options")
    conflict = F.when(_not((F.size(right) == 1) & (right[0] == F.col("answer"))), entry("answer_conflict", F.array_join(right, ",")))
    failed = F.transform(F.filter(listed(AUDIT_CHECKS), lambda c: F.element_at(F.col("checks"), c) != "pass"), lambda c: entry(c, F.element_at(F.col("checks"), c)))
    spare = F.transform(F.filter("participating", lambda d: _not(F.element_at(F.col("domain_necessity"), d)["necessary"])), lambda d: entry("domain_necessity", d))
    said = F.transform("findings", lambda x: entry("semantic_issue", x))
    out = rows.withColumn("expanded", F.concat(F.array_compact(F.array(conflict)), failed, spare, said))
    return out.withColumn("clean", F.size("expanded") == 0)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(squeezed(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))


def length_issues(rows: DataFrame) -> DataFrame:
    """participating, question, options: adds words, chars, budget_words, budget_chars and issues over budget."""
    k = F.size("participating")
    texts = F.concat(F.array("question"), F.map_values("options"))
    rows = rows.withColumn("words", F.aggregate(F.transform(texts, word_count), F.lit(0), lambda a, x: a + x)).withColumn("chars", F.aggregate(F.transform(texts, lambda t: F.length(F.coalesce(t, F.lit("")))), F.lit(0), lambda a, x: a + x))
    rows = rows.withColumn("budget_words", WORDS_AT_TWO + WORDS_A_DOMAIN * (k - 2)).withColumn("budget_chars", CHARS_A_WORD * F.col("budget_words"))
    return with_issues(rows, [("over_words", F.col("words") > F.col("budget_words")), ("over_chars", F.col("chars") > F.col("budget_chars"))])


def shuffled_options(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """Options dealt to other letters by a hash of seed, key and letter, the answer and the analysis with them; adds mapping."""
    order = F.array_sort(F.transform(listed(LABELS), lambda x: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), x), 256).alias("h"), x.alias("old"))))
    mapping = F.map_from_arrays(F.transform(order, lambda s: s.old), listed(LABELS))
    rows = rows.withColumn("mapping", mapping)
    to = lambda x: F.element_at(F.col("mapping"), x)
    dealt = F.map_from_entries(F.array_sort(F.transform(F.map_entries("options"), lambda e: F.struct(to(e.key).alias("key"), e.value.alias("value")))))
    return rows.withColumn("options", dealt).withColumn("answer", to(F.col("answer"))).withColumn("distractor_analysis", F.transform("distractor_analysis", lambda x: x.withField("option", to(x.option))))


def greedy_batches(rows: DataFrame, group: str, order: str, size: str, most: int, room: int, overhead: int = 0) -> DataFrame:
    """Adds batch (from 0): rows of a group in order, a batch closed when it holds `most` rows or the next would not fit in `room`.

    A row that is too large by itself has batch null: nothing is cut. A group is one request's candidates, so it is short.
    """
    each = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"), F.struct(*[c for c in rows.columns if c not in (group, order, size)]).alias("rest")))).alias("l"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        alone, opens = x.s + overhead > room, (a.n >= most) | ((a.n > 0) & (a.used + x.s + overhead > room))
        batch = F.when(opens, a.batch + 1).otherwise(a.batch)
        return F.struct(
            F.when(alone, a.batch).otherwise(batch).alias("batch"), F.when(alone, a.n).when(opens, 1).otherwise(a.n + 1).alias("n"), F.when(alone, a.used).when(opens, x.s).otherwise(a.used + x.s).alias("used"),
            F.concat(a.out, F.array(F.when(~alone, batch).cast("int"))).alias("out"),
        )

    placed = each.withColumn("b", F.aggregate("l", start, step, lambda a: a.out))
    flat = placed.select(group, F.explode(F.arrays_zip("l", "b")).alias("z"))
    rest = [c for c in rows.columns if c not in (group, order, size)]
    return flat.select(group, F.col("z.l.o").alias(order), F.col("z.l.s").alias(size), *[F.col(f"z.l.rest.{c}").alias(c) for c in rest], F.col("z.b").alias("batch"))
