"""Which records the checks reject, and for what."""

import pytest
from pyspark.sql import functions as F

from atlasmill.functions import text
from atlasmill.operators import items, judging, matching

DOMAINS = ["medical", "legal", "physics"]
SAMPLE = "struct<prompt:string,completion:string>"
QUERY = f"source_domain string, sample {SAMPLE}, fusion_idea string, fusion_domains array<string>, queries map<string,array<string>>"


def issues(spark, check, rows, schema):
    return [r.issues for r in check(spark.createDataFrame(rows, schema)).collect()]


def query(**change):
    row = dict(source_domain="medical", sample=("p", "c"), fusion_idea="i", fusion_domains=["legal"], queries={"legal": ["a", "b", "c"]})
    return row | change


def rows_of(names, dicts):
    return [tuple(d[n] for n in names) for d in dicts]


def test_query_rows(spark):
    names = ["source_domain", "sample", "fusion_idea", "fusion_domains", "queries"]
    rows = [query(), query(source_domain="art"), query(sample=("p", " ")), query(fusion_idea=None), query(fusion_domains=["medical"], queries={"medical": ["a", "b", "c"]}), query(queries={"physics": ["a", "b", "c"]}), query(queries={"legal": ["a", "b"]}), query(queries={"legal": ["a", "A  ", "Straße"]}), query(queries={"legal": ["a", "STRASSE", "Straße"]})]
    got = issues(spark, lambda d: items.query_issues(d, DOMAINS), rows_of(names, rows), QUERY)
    assert got[0] == [] and got[1] == ["unknown_source"] and got[2] == ["empty_sample"] and got[3] == ["empty_idea"] and "bad_fusion_domains" in got[4]
    assert got[5] == ["queries_do_not_cover_domains"] and got[6] == ["bad_query_count"] and got[7] == ["repeated_query"] and got[8] == ["repeated_query"]
    d = items.query_issues(spark.createDataFrame(rows_of(names, rows), QUERY), DOMAINS)
    assert items.accepted(d).count() == 1 and items.rejected(d).count() == len(rows) - 1
    assert items.base_record(d).columns == ["source_domain", "sample", "fusion_domains", "fusion_idea", "queries"]


def test_proposals_and_ideas(spark):
    schema = f"source_domain string, sample {SAMPLE}, combinations array<struct<domains:array<string>,reason:string,fusion_confidence:double>>, reason string"
    rows = [("medical", ("p", "c"), [(["legal"], "r", 0.5)], None), ("medical", ("p", "c"), None, "no"), ("medical", ("p", "c"), None, ""), ("medical", ("p", "c"), [(["legal", "physics"], "r", 0.5), (["physics", "legal"], "r", 1.5)], None), ("medical", ("p", "c"), [(["medical"], " ", float("nan"))], None)]
    got = issues(spark, lambda d: items.proposal_issues(d, DOMAINS), rows, schema)
    assert got == [[], [], ["none_without_reason"], ["repeated_proposal", "bad_confidence"], ["bad_domains", "empty_reason", "bad_confidence"]]
    schema = "source_domain string, fusion_domains array<string>, status string, reason string, idea struct<idea:string,correct_answer_plan:string,distractor_plans:array<struct<missing_domain:string,plan:string>>>"
    good = ("medical", ["legal"], "feasible", None, ("i", "right", [("legal", "x"), ("medical", "y")]))
    rows = [good, ("medical", ["legal"], "not_feasible", "r", None), ("medical", ["legal"], "not_feasible", "", good[4]), ("medical", ["legal"], "feasible", None, ("i", "right", [("legal", "Right "), ("legal", "y")])), ("medical", ["legal"], "maybe", None, None)]
    got = issues(spark, items.idea_issues, rows, schema)
    assert got == [[], [], ["infeasible_with_idea", "infeasible_without_reason"], ["distractors_do_not_cover_domains", "equal_plans"], ["bad_status"]]
    d = spark.createDataFrame([good], schema).select(items.in_domain_order(F.col("idea.distractor_plans"), F.array(F.lit("medical"), F.lit("legal"))).alias("p")).first()
    assert [x.missing_domain for x in d.p] == ["medical", "legal"]


def test_candidates_and_knowledge(spark):
    schema = QUERY + f", candidates map<string,array<struct<candidate_id:string,sample:{SAMPLE},source_file:string,source_line:int>>>"
    base = rows_of(["source_domain", "sample", "fusion_idea", "fusion_domains", "queries"], [query()])[0]
    one = ("legal:1", ("p", "c"), "f", 1)
    rows = [(*base, {"legal": [one]}), (*base, {"legal": []}), (*base, {}), (*base, {"legal": [one, one]}), (*base, {"legal": [("medical:1", ("p", ""), "", 0)]})]
    got = issues(spark, lambda d: items.candidate_issues(d, DOMAINS), rows, schema)
    assert got == [[], [], ["candidates_do_not_cover_domains"], ["repeated_candidate"], ["wrong_candidate_domain", "empty_candidate_sample", "bad_candidate_source"]]
    schema = QUERY + f", knowledge map<string,struct<status:string,materials:array<struct<candidate_id:string,sample:{SAMPLE},source_file:string,source_line:int,supported_knowledge:string,evidence:array<struct<field:string,quote:string>>>>,missing_knowledge:string>>"
    told = ("legal:1", ("some prompt", "c"), "f", 1, "k", [("prompt", "prompt")])
    rows = [(*base, {"legal": ("sufficient", [told], "")}), (*base, {"legal": ("partial", [told], " ")}), (*base, {"legal": ("none", [told], "gap")}), (*base, {"legal": ("sufficient", [(*told[:5], [("completion", "prompt")])], "")}), (*base, {"legal": ("sufficient", [], "gap")})]
    got = issues(spark, lambda d: items.knowledge_issues(d, DOMAINS), rows, schema)
    assert got == [[], ["gap_not_named"], ["none_with_materials"], ["quote_not_in_sample"], ["coverage_without_materials", "sufficient_with_gap"]]


def test_decisions(spark):
    schema = f"candidates array<struct<candidate_id:string,sample:{SAMPLE}>>, decisions array<struct<candidate_id:string,keep:boolean,supported_knowledge:string,reason:string,evidence:array<struct<field:string,quote:string>>>>"
    c = [("a", ("the prompt", "the answer"))]
    keep = lambda *e: [("a", True, "k", "r", list(e))]
    rows = [(c, keep(("prompt", "prompt"))), (c, []), (c, keep()), (c, keep(("completion", "prompt"))), (c, keep(("other", "the"))), (c, [("a", False, "k", "r", [])]), (c, [("a", None, "", "", [])]), (c, [("b", False, "", "r", [])])]
    got = issues(spark, items.decision_issues, rows, schema)
    assert got == [[], ["decisions_do_not_cover_candidates"], ["kept_without_evidence"], ["quote_not_in_sample"], ["quote_not_in_sample"], ["rejected_with_evidence"], ["no_verdict", "empty_reason"], ["decisions_do_not_cover_candidates"]]


@pytest.mark.parametrize("row, issue", [
    (("sufficient", [], ""), "coverage_without_materials"), (("sufficient", ["a"], "gap"), "sufficient_with_gap"), (("partial", [], "gap"), "coverage_without_materials"), (("partial", ["a"], ""), "gap_not_named"),
    (("none", ["a"], "gap"), "none_with_materials"), (("none", [], ""), "gap_not_named"), (("maybe", ["a"], ""), "bad_coverage_status"), (("partial", ["a", "a"], "g"), "bad_selection"), (("partial", ["z"], "g"), "bad_selection"),
])
def test_coverage_rules(spark, row, issue):
    schema = "candidates array<struct<candidate_id:string>>, status string, selected_ids array<string>, missing_knowledge string"
    ok = issues(spark, items.coverage_issues, [([("a",), ("b",)], "sufficient", ["a"], ""), ([("a",)], "none", [], "gap")], schema)
    assert ok == [[], []] and issue in issues(spark, items.coverage_issues, [([("a",), ("b",)], *row)], schema)[0]


ITEM = f"participating array<string>, question string, options map<string,string>, answer string, explanation string, distractor_analysis array<struct<option:string,type:string,missing_domain:string,reason:string>>, used_samples map<string,array<{SAMPLE}>>, available_samples map<string,array<{SAMPLE}>>"
GOOD = (["medical", "legal"], "q", {"A": "1", "B": "2", "C": "3", "D": "4"}, "B", "e", [("A", "missing_domain_knowledge", "legal", "r"), ("C", "parallel_knowledge", None, "r"), ("D", "incorrect_domain_relation", None, "r")], {"legal": [("p", "c")]}, {"legal": [("p", "c"), ("x", "y")]})


def changed(**c):
    names = ["participating", "question", "options", "answer", "explanation", "distractor_analysis", "used_samples", "available_samples"]
    return tuple((dict(zip(names, GOOD)) | c)[n] for n in names)


def test_items(spark):
    rows = [GOOD, changed(options={"A": "x", "B": "X ", "C": "3", "D": "4"}), changed(options={"A": "1", "B": "2", "C": "3"}), changed(answer="E"), changed(answer="A"), changed(distractor_analysis=[("A", "parallel_knowledge", "legal", "r"), ("C", "parallel_knowledge", None, "r"), ("D", "incorrect_domain_relation", None, " ")]), changed(used_samples={"legal": [("p", "other")]}), changed(used_samples={}), changed(question=" ", explanation="")]
    got = issues(spark, items.item_issues, rows, ITEM)
    assert got[:5] == [[], ["equal_options"], ["bad_options"], ["bad_answer", "bad_distractor_options"], ["bad_distractor_options"]]
    assert got[5:] == [["bad_distractor_types", "bad_missing_domain", "empty_distractor_reason"], ["sample_not_supplied"], ["samples_do_not_cover_domains"], ["empty_question", "empty_explanation"]]


def test_shuffled_options_keep_the_answer(spark):
    d = spark.createDataFrame([(i, *GOOD) for i in range(40)], "id long, " + ITEM)
    out = items.shuffled_options(d, "s", "id").collect()
    for r in out:
        assert r.options[r.answer] == "2" and sorted(r.options.values()) == ["1", "2", "3", "4"]
        assert {(r.options[x.option], x.type) for x in r.distractor_analysis} == {("1", "missing_domain_knowledge"), ("3", "parallel_knowledge"), ("4", "incorrect_domain_relation")}
    assert len({r.answer for r in out}) == 4
    again = {r.id: r.answer for r in items.shuffled_options(d.repartition(3), "s", "id").collect()}
    assert again == {r.id: r.answer for r in out}
    assert items.item_issues(items.shuffled_options(d, "s", "id")).where("size(issues) > 0").count() == 0


def test_screening_and_audits(spark):
    schema = f"fusion_domains array<string>, feasible boolean, reason string, selected_samples map<string,array<{SAMPLE}>>, available_samples map<string,array<{SAMPLE}>>, question_plan string"
    there = {"legal": [("p", "c")]}
    rows = [(["legal"], True, "r", {"legal": [("p", "c")]}, there, "plan"), (["legal"], False, "r", {"legal": []}, there, None), (["legal"], True, "r", {"legal": []}, there, "plan"), (["legal"], False, "", {"legal": [("p", "c")]}, there, None), (["legal"], None, "r", {"legal": [("z", "c")]}, there, None)]
    assert issues(spark, items.screening_issues, rows, schema) == [[], [], ["feasible_without_samples"], ["empty_reason", "infeasible_with_content"], ["no_verdict", "sample_not_supplied"]]
    schema = "participating array<string>, answer string, correct_options array<string>, checks map<string,string>, domain_necessity map<string,struct<necessary:boolean,reason:string>>, findings array<string>, solution_summary string"
    fine = dict.fromkeys(items.AUDIT_CHECKS, "pass")
    need = {"medical": (True, "r"), "legal": (True, "r")}
    both = ["medical", "legal"]
    rows = [(both, "A", ["A"], fine, need, [], "s"), (both, "A", ["B"], fine | {"single_target": "fail"}, need | {"legal": (None, "r")}, ["odd"], "s"), (both, "A", ["A", "A"], {}, {}, [" "], "")]
    d = items.audit_record_issues(spark.createDataFrame(rows, schema))
    assert [r.issues for r in d.collect()] == [[], [], ["bad_correct_options", "bad_checks", "necessity_does_not_cover_domains", "empty_finding", "empty_summary"]]
    out = items.audit_findings(items.accepted(d)).collect()
    assert out[0].clean and [(x.check, x.detail) for x in out[1].expanded] == [("answer_conflict", "B"), ("single_target", "fail"), ("domain_necessity", "legal"), ("semantic_issue", "odd")]


def test_lengths_and_batches(spark):
    d = spark.createDataFrame([(["a", "b"], "w " * 127, {"A": "x", "B": "y", "C": "z"}), (["a", "b"], "w " * 128, {"A": "x", "B": "y", "C": "z"})], "participating array<string>, question string, options map<string,string>")
    assert [(r.words, r.budget_words, r.issues) for r in items.length_issues(d).collect()] == [(130, 130, []), (131, 130, ["over_words"])]
    rows = spark.createDataFrame([("r", i, s, f"t{i}") for i, s in enumerate([4, 4, 4, 20, 1, 1, 1, 9])], "g string, i int, s long, t string")
    out = items.greedy_batches(rows, "g", "i", "s", most=3, room=10).orderBy("i").collect()
    assert [(r.t, r.batch) for r in out] == [("t0", 0), ("t1", 0), ("t2", 1), ("t3", None), ("t4", 1), ("t5", 1), ("t6", 2), ("t7", 2)]


def test_matching(spark):
    docs = [(1, "the quick brown fox jumps"), (2, "xthe quick brown foxes"), (3, "quick brown"), (4, None), (5, "the quick  brown fox"), (6, "a")]
    asked = [(10, "the quick brown fox"), (11, "brown"), (12, "quick brown"), (13, "no such words here"), (14, None), (15, "the quick  brown fox"), (16, "")]
    got = matching.contained(spark.createDataFrame(asked, "k int, t string"), spark.createDataFrame(docs, "d int, x string"), "k", "t", "d", "x")
    assert {(r.item, r.doc) for r in got.collect()} == {(k, d) for k, t in asked for d, x in docs if t is not None and x is not None and t in x}
    d = spark.createDataFrame([("Option A is right",), ("an option about it",), ("see option d.",)], "t string")
    assert [r[0] for r in d.select(matching.names_an_option(F.col("t"))).collect()] == [True, False, True]


def test_deep_redaction(spark):
    key = "sk-abcdef123456"
    d = spark.createDataFrame([(key, [("x " + key, {"k": "my-secret"})], 3)], "a string, b array<struct<c:string,m:map<string,string>>>, n int")
    out = d.select(*[text.redacted_deep(F.col(f.name), f.dataType, ["my-secret"]).alias(f.name) for f in d.schema]).first()
    assert out.a == "[REDACTED]" and out.b[0].c == "x [REDACTED]" and out.b[0].m == {"k": "[REDACTED]"} and out.n == 3
    one = spark.range(1).select(text.redacted(F.lit("risk-free sk-short")), text.redacted(F.lit(None).cast("string"))).first()
    assert one[0] == "risk-free sk-short" and one[1] is None


def told(sample, judge, values, status="ok", **more):
    dims = {d: (("unjudgeable", None) if v is None else ("scored", v)) for d, v in zip(judging.DIMENSIONS, values)}
    out = {"dimensions": dims, "flags": None, "answer_check": None, "domain_checks": None, "necessity_audit": None, "dimension_resolutions": None, "unresolved_issues": None, "human_review_required": None} | more
    output = tuple(out.values())
    return [(sample, judge, stage, status, output) for stage in judging.INITIAL_STAGES]


def records(spark, *rows):
    return spark.createDataFrame([x for r in rows for x in r], judging.RECORD)


def samples(spark, ids):
    return spark.createDataFrame([(i, "src", 2, "easy") for i in ids], "sample_id string, source_domain string, k int, difficulty string")


def test_judge_statistics(spark):
    r = records(spark, told("1", "J1", [3] * 5), told("1", "J2", [3] * 5), told("2", "J1", [None, 3, 3, 3, 3]), told("2", "J2", [3] * 5), told("3", "J1", [3] * 5))
    scored = judging.scores(r)
    row = judging.dimension_statistics(scored).where("judge_id = 'J1' and dimension = 'cross_domain_necessity'").first()
    assert (row.mean, row.numeric_n, row.denominator, row.pass_rate, row.numeric_pass_rate, row.unjudgeable_rate, row.sample_sd) == (3, 1, 2, 0.5, 1, 0.5, None)
    row = judging.disagreement(scored).where("dimension = 'cross_domain_necessity'").first()
    assert (row.consensus_rate, row.u_status_count, row.numeric_pairs, row.paired) == (0.5, 1, 1, 2)
    table = judging.status_table(judging.routes(samples(spark, "123"), r), ["source_domain"]).first()
    assert (table.planned, table.paired, table.execution_incomplete) == (3, 2, 1)


@pytest.mark.parametrize("a, b, gap, threshold", [(3, 4, False, False), (1, 3, True, True), (2, 3, False, True), (0, 2, True, False)])
def test_judge_triggers(spark, a, b, gap, threshold):
    r = judging.routes(samples(spark, "1"), records(spark, told("1", "J1", [a, 3, 3, 3, 3]), told("1", "J2", [b, 3, 3, 3, 3])), fraction=0.0).first()
    d = "cross_domain_necessity"
    assert ((f"numeric_gap:{d}" in r.reasons), (f"threshold_disagreement:{d}" in r.reasons)) == (gap, threshold)
    assert r.status == ("pending_review" if gap or threshold else "llm_consensus_pass")


def test_stratified_audit(spark):
    rows = spark.createDataFrame([(f"{k}-{i}", "src", k, "easy") for k in (2, 3, 4) for i in range(3)], "sample_id string, source_domain string, k int, difficulty string")
    pick = lambda d: sorted(r.sample_id for r in judging.audit_sample(d, ["source_domain", "k", "difficulty"], "sample_id", 0.1, "s").collect())
    first = pick(rows)
    assert [x[0] for x in first] == ["2", "3", "4"] and pick(rows.orderBy(F.rand(1)).repartition(4)) == first
    many = spark.createDataFrame([(str(i), "src", i % 2, None) for i in range(3000)], "sample_id string, source_domain string, k int, difficulty string")
    got = judging.audit_sample(many, ["source_domain", "k", "difficulty"], "sample_id", 0.25, "s")
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {0: 375, 1: 375}


def test_reviews_and_inconsistent_records(spark):
    low = [2, 3, 3, 3, 3]
    review = [("1", "J3", "adjudication", "ok", told("1", "J3", low, dimension_resolutions=[(d, "scored", v, "basis") for d, v in zip(judging.DIMENSIONS, low)])[0][4])]
    both = [told("1", "J1", [3] * 5), told("1", "J2", low), told("1", "J3", low), review]
    assert judging.routes(samples(spark, "1"), records(spark, *both)).first().status == "llm_resolved_fail"
    flagged = [told("1", "J1", [3] * 5, flags=[("subset_shortcut", "suspected")]), told("1", "J2", low), told("1", "J3", low), review]
    r = judging.routes(samples(spark, "1"), records(spark, *flagged)).first()
    assert r.status == "pending_human" and r.human_reasons == ["J1:subset_shortcut:suspected"]
    shortcut = [told("1", "J1", [3] * 5, necessity_audit=("verified_shortcut",)), told("1", "J2", [3] * 5)]
    assert judging.routes(samples(spark, "1"), records(spark, *shortcut)).first().status == "execution_incomplete"
    bad = records(spark, told("1", "J1", [5] * 5), told("9", "J1", [3] * 5), told("1", "J2", [3] * 5) * 2, [("1", "J1", "adjudication", "ok", None)], told("1", "J3", [3] * 5, status="odd"))
    found = [r.issue for r in judging.record_issues(bad, samples(spark, "1")).collect()]
    assert {x: found.count(x) for x in set(found)} == {"bad_scores": 1, None: 1, "unknown_record": 2, "repeated_record": 4, "bad_stage": 1, "bad_status": 2}
