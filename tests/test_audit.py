"""Hand-computed cases of the audits."""

import math

import pytest

from atlasmill.operators import audit

RECORD = (
    "source_domain string, domain_count int, fusion_domains array<string>, sample struct<prompt:string,completion:string>, "
    "required_key_facts map<string,array<struct<key_fact:string,necessity:string>>>, "
    "retrieved_samples map<string,array<struct<candidate_id:string,sample:struct<prompt:string,completion:string>,rrf_score:double,hits:array<struct<query_index:int,method:string,score:double,rank:int>>>>>"
)


def record(needs, candidates, source="a", prompt="p", domain="b"):
    """One plan with one added domain; candidates: id -> list of (need, method, score, rank)."""
    held = [(i, ("q", "c"), 0.0, hits) for i, hits in candidates.items()]
    return (source, 2, [domain], (prompt, "c"), {domain: [(f"fact {j}", "why") for j in range(needs)]}, {domain: held})


def scored(spark, *records):
    return audit.pairs(*audit.flatten(audit.identified(spark.createDataFrame(list(records), RECORD))))


def emb(need, score, rank=1):
    return (need, "embedding", score, rank)


def bm(need, score, rank=1):
    return (need, "bm25", score, rank)


def by_need(df):
    return [r for r in sorted(df.collect(), key=lambda r: r.query_index)]


def test_coverage_uses_embedding_only(spark):
    needs = by_need(audit.coverage_needs(scored(spark, record(2, {"x": [bm(1, 999.0), emb(2, 0.8)]})), [None]))
    assert [r.best for r in needs] == [None, 0.8]
    states = by_need(audit.coverage_states(audit.coverage_needs(scored(spark, record(2, {"x": [bm(1, 999.0), emb(2, 0.8)]})), [None]), [0.7]))
    assert [r.saved for r in states] == [0, 1]


def test_coverage_best_once_and_threshold(spark):
    rows = scored(spark, record(2, {"x": [emb(1, 0.71), emb(2, 0.2)], "y": [emb(1, 0.9), emb(2, 0.4)]}))
    needs = audit.coverage_needs(rows, [None])
    assert by_need(needs)[0].best_candidate == "y"
    assert audit.coverage_plans(audit.coverage_states(needs, [0.7])).first().saved == 0.5
    rows = scored(spark, record(3, {"x": [emb(1, 0.7), emb(2, 0.69999999999), emb(3, 0.70000000001)]}))
    assert [r.saved for r in by_need(audit.coverage_states(audit.coverage_needs(rows, [None]), [0.7]))] == [1, 0, 1]


def test_coverage_missing_zero_negative(spark):
    needs = audit.coverage_needs(scored(spark, record(3, {"x": [emb(1, 0.0), emb(2, -0.2)]})), [None])
    assert [r.status for r in by_need(needs)] == ["observed", "observed", "no_saved_score"]
    assert [r.saved for r in by_need(audit.coverage_states(needs, [-0.3]))] == [1, 1, 0]


def test_coverage_bounds_and_empty_candidates(spark):
    rows = scored(spark, record(3, {"x": [emb(1, 0.9), emb(3, 0.1)], "y": [emb(3, 0.2)]}))
    states = by_need(audit.coverage_states(audit.coverage_needs(rows, [None]), [0.7]))
    assert [(r.saved, r.upper, r.state) for r in states] == [(1, 1, "covered"), (0, 1, "unknown"), (0, 0, "uncovered")]
    plan = audit.coverage_plans(audit.coverage_states(audit.coverage_needs(scored(spark, record(1, {})), [None]), [0.7])).first()
    assert (plan.saved, plan.upper, plan.pair_availability) == (0, 0, None)


def test_coverage_budget_and_macro(spark):
    rows = scored(spark, record(1, {"x": [emb(1, 0.1)], "y": [emb(1, 0.9)]}), record(1, {"x": [emb(1, 0.9)]}, source="c", prompt="r"))
    plans = audit.coverage_plans(audit.coverage_states(audit.coverage_needs(rows, [1, None]), [0.5]))
    _, total = audit.macro(plans, ["saved"], ["budget"], ["a", "c"])
    assert {r.budget: r.macro_saved for r in total.collect()} == {1: 0.5, None: 1.0}
    _, total = audit.macro(plans, ["saved"], ["budget"], ["a", "c", "d"])
    assert {(r.budget, r.macro_saved, r.observed_saved, tuple(r.missing_sources)) for r in total.collect()} == {(1, None, 0.5, ("d",)), (None, None, 1.0, ("d",))}


def ranges(spark, low=0.0, high=10.0):
    return spark.createDataFrame([("b", low, high, 2, high > low)], "target_domain string, low double, high double, observed long, fit boolean")


def weights(spark, rec, low=0.0, high=10.0, budgets=(None,)):
    needs = audit.satisfaction_needs(audit.satisfaction_pairs(scored(spark, rec), ranges(spark, low, high)), list(budgets))
    return {(r["mode"], r.query_index, r.budget): r for r in needs.collect()}, needs


def test_satisfaction_modes(spark):
    got, _ = weights(spark, record(1, {"x": [emb(1, 0.1), bm(1, 10.0)], "y": [emb(1, 0.9), bm(1, 0.0)]}))
    best = got["hybrid_complete", 1, None]
    assert best.weight == pytest.approx(0.55) and best.best_candidate == "x"
    got, _ = weights(spark, record(1, {"x": [emb(1, 0.8)]}))
    assert {m: got[m, 1, None].weight for m in audit.MODES} == {"cosine_observed": 0.8, "hybrid_complete": None, "cosine_complete": None, "bm25_complete": None}
    for cosine in (0.0, -0.8):
        got, _ = weights(spark, record(1, {"x": [emb(1, cosine), bm(1, 5.0)]}))
        assert got["cosine_observed", 1, None].weight == 0 and got["hybrid_complete", 1, None].weight == 0.25
    got, _ = weights(spark, record(1, {"x": [emb(1, 0.7), bm(1, 5.0)], "y": [emb(1, 0.99)]}))
    assert [got[m, 1, None].eligible for m in audit.MODES] == [2, 1, 1, 1]
    assert got["hybrid_complete", 1, None].weight == pytest.approx(0.6)


def test_satisfaction_leaves_out_needs_without_score(spark):
    _, needs = weights(spark, record(3, {"x": [emb(1, 0.9), emb(2, 0.1)]}))
    plan = audit.satisfaction_plans(needs, [0.5]).where("mode = 'cosine_observed'").first()
    assert (plan.evaluated, plan.excluded, plan.pairs, plan.binary, plan.weighted) == (2, 1, 3, 0.5, 0.5)


def test_satisfaction_budget_need_not_grow(spark):
    _, needs = weights(spark, record(2, {"x": [emb(1, 0.9)], "y": [emb(2, 0.1)]}), budgets=(1, 2))
    plans = audit.satisfaction_plans(needs, [0.5]).where("mode = 'cosine_observed'").collect()
    assert {p.budget: p.binary for p in plans} == {1: 1.0, 2: 0.5}


def test_satisfaction_macro(spark):
    one = record(1, {"x": [emb(1, 0.9)]}, source="a", prompt="1")
    rows = scored(spark, one, record(1, {"x": [emb(1, 0.9)]}, source="a", prompt="2"), record(1, {"x": [emb(1, 0.1)]}, source="z", prompt="3"))
    needs = audit.satisfaction_needs(audit.satisfaction_pairs(rows, ranges(spark)), [None])
    plans = audit.satisfaction_plans(needs, [0.5]).where("mode = 'cosine_observed'")
    _, total = audit.macro(plans, ["binary"], ["threshold"], ["a", "z", "c", "d"])
    r = total.first()
    assert (r.observed_binary, r.macro_binary, r.missing_sources) == (0.5, None, ["c", "d"])


def test_min_max(spark):
    rec = record(3, {"x": [emb(1, 0.5), bm(1, 2.0)], "y": [emb(2, 0.5), bm(2, -1.0)], "z": [emb(3, 0.5), bm(3, 12.0)]})
    rows = audit.satisfaction_pairs(scored(spark, rec), ranges(spark)).where("both").orderBy("query_index").collect()
    assert [(r.bm25_norm, r.clipped) for r in rows] == [(0.2, "none"), (0, "low"), (1, "high")]
    _, _, hits = audit.flatten(audit.identified(spark.createDataFrame([record(1, {"x": [bm(1, 5.0)], "y": [bm(1, 15.0)]})], RECORD)))
    r = audit.fit_ranges(hits).first()
    assert (r.low, r.high, r.observed, r.fit) == (5, 15, 2, True)
    rows = audit.satisfaction_pairs(scored(spark, rec), ranges(spark, 3.0, 3.0)).where("both")
    assert {r.bm25_norm for r in rows.collect()} == {None}


def test_rank_strength_sums_hits(spark):
    r = audit.rank_strength(scored(spark, record(2, {"x": [emb(1, 0.5, 1), bm(1, 3.0, 1)], "y": [emb(1, 0.4, 2)]}))).first()
    assert (r.strength, r.without, r.needs) == (0.5, 1, 2)


def plans(spark, rows):
    return spark.createDataFrame([(s, len(c) + 1, c) for s, c in rows], "source_domain string, domain_count int, fusion_domains array<string>")


def entropies(spark, rows, domains, k):
    counts = audit.combination_counts(plans(spark, rows), domains, [k])
    per = audit.combination_entropy(counts, domains)
    return counts, {r.source_domain: r for r in per.collect()}, audit.entropy_macro(per, domains).first()


@pytest.mark.parametrize("k, n", [(2, 6), (3, 15), (4, 20)])
def test_entropy_uniform(spark, k, n):
    from itertools import combinations

    domains = list("ABCDEFG")
    rows = [(s, list(c)) for s in domains for c in combinations([d for d in domains if d != s], k - 1)]
    _, per, macro = entropies(spark, rows, domains, k)
    assert per["A"].dde == pytest.approx(1) and per["A"].entropy == pytest.approx(math.log(n)) and per["A"].coverage == 1 and macro.macro_dde == pytest.approx(1)


def test_entropy_by_hand(spark):
    _, per, _ = entropies(spark, [("A", ["B"])] * 10, list("ABCD"), 2)
    assert per["A"].dde == 0 and per["B"].status == "missing" and per["B"].dde is None
    counts, per, macro = entropies(spark, [("A", ["B"])] * 3 + [("A", ["C"])], list("ABCD"), 2)
    h = -0.75 * math.log(0.75) - 0.25 * math.log(0.25)
    assert per["A"].entropy == pytest.approx(h) and per["A"].dde == pytest.approx(h / math.log(3)) and per["A"].coverage == pytest.approx(2 / 3)
    assert counts.where("source_domain = 'A' and combination[0] = 'D'").first().n == 0
    assert macro.macro_dde is None and macro.observed_sources == 1 and macro.missing_sources == ["B", "C", "D"]
    _, per, macro = entropies(spark, [(s, sorted(set("ABCD") - {s})) for s in "ABCD"], list("ABCD"), 4)
    assert per["A"].dde is None and per["A"].entropy == 0 and per["A"].coverage == 1 and macro.macro_dde is None


def test_entropy_weighs_sources_alike(spark):
    rows = [("A", ["B"])] * 100 + [(s, [t]) for s in "BCD" for t in "ABCD" if t != s]
    _, _, macro = entropies(spark, rows, list("ABCD"), 2)
    assert macro.macro_dde == pytest.approx(0.75) and macro.plans == 109


def test_marginal_entropy_and_rates(spark):
    cycle = [("A", list(c)) for c in ("BC", "CD", "DE", "BE")]
    _, per, _ = entropies(spark, cycle, list("ABCDE"), 3)
    assert per["A"].marginal_dde == pytest.approx(1) and per["A"].dde == pytest.approx(math.log(4) / math.log(6))
    counts = audit.combination_counts(plans(spark, [("A", ["B", "C"])] * 3 + [("A", ["B", "D"])]), list("ABCD"), [3])
    rates = {r.target_domain: (r.inclusion, r.slot) for r in audit.selection_rates(counts).where("source_domain = 'A'").collect()}
    assert rates["B"] == (1, 0.5) and sum(x for x, _ in rates.values()) == 2 and sum(y for _, y in rates.values()) == 1


def test_plan_issues(spark):
    good = record(1, {"x": [emb(1, 0.5)]})
    bad = [record(1, {"x": [emb(2, 0.5)]}), record(1, {"x": [emb(1, 1.5)]}), ("a", 3, ["b"], ("p", None), None, None), record(1, {}, source="b"), record(0, {})]
    rows = audit.plan_issues(spark.createDataFrame([good, *bad], RECORD), ["a", "b"], retrieved=True).collect()
    assert [r.issues for r in rows][:3] == [[], ["bad_hit"], ["bad_hit"]]
    assert {"bad_domain_count", "bad_fusion_domains", "no_sample"} <= set(rows[3].issues)
    assert rows[4].issues == ["bad_fusion_domains"] and rows[5].issues == ["empty_need"]
    twice = audit.repeated_plans(audit.identified(spark.createDataFrame([good, good, record(1, {}, prompt="o")], RECORD))).collect()
    assert [r.n for r in twice] == [2]


def answered(spark, table):
    """table: sample -> (full, mask x, mask y), 1 right, 0 wrong, or the status of a failure; None is no prediction."""
    samples = spark.createDataFrame([(s, "src", 2, "easy", ["x", "y"], "A") for s in table], "sample_id string, source_domain string, k int, difficulty string, domains array<string>, answer string")
    told = []
    for s, values in table.items():
        for (c, d), v in zip((("full", None), ("mask", "x"), ("mask", "y")), values):
            if v is not None:
                told.append((s, c, d, "ok" if v in (0, 1, "ABSTAIN") else v, {1: "A", 0: "B"}.get(v, v)))
    given = spark.createDataFrame(told, "sample_id string, condition string, domain string, status string, answer string")
    return audit.outcomes(audit.conditions(samples), given)


def test_masking(spark):
    rows = answered(spark, {"1": (1, 0, 0), "2": (1, 1, 0), "3": (0, 0, 1), "4": (1, 0, 1)})
    assert rows.count() == 4 * 6
    per = audit.masking_samples(rows)
    assert [r.ig for r in per.orderBy("sample_id").collect()] == [1, 0, -1, 0]
    r = audit.masking_summary(per).where("group_by = 'overall'").first()
    assert (r.cdns, r.ig, r.full_accuracy, r.samples) == (0.25, 0, 0.75, 4)
    assert {r.group_by for r in audit.masking_summary(per).collect()} == {"overall", "k", "difficulty", "source_domain", "k_difficulty"}
    assert {r.domain: r.dc for r in audit.domain_contributions(rows).collect()} == {"x": 0.5, "y": 0.25}


def test_masking_failures(spark):
    rows = answered(spark, {"1": (1, 0, 0), "2": (1, "ABSTAIN", "error"), "3": ("invalid_format", 0, 0), "4": (0, None, 0)})
    r = audit.masking_summary(audit.masking_samples(rows)).where("group_by = 'overall'").first()
    assert (r.complete, r.cdns) == (1, 1)
    assert audit.condition_accuracy(rows).where("condition = 'mask' and domain = 'x'").first().abstained == 1
    none = audit.masking_summary(audit.masking_samples(answered(spark, {"1": (None,) * 3, "2": (1, None, None)}))).where("group_by = 'overall'").first()
    assert (none.complete, none.cdns, none.ig) == (0, None, None)


SUMMED = ["domain_count", "budget", "mode", "threshold"]


def rounded(df):
    return sorted(str([round(x, 12) if isinstance(x, float) else x for x in r]) for r in df.collect())


def test_satisfaction_sources_say_what_the_longer_way_says(spark):
    recs = [record(2, {"x": [emb(1, 0.9), bm(1, 4.0)], "y": [emb(1, 0.2), bm(1, 9.0), emb(2, 0.6)]}), record(3, {"x": [bm(2, 1.0)]}, prompt="q"), record(1, {}, prompt="r"), record(1, {"x": [emb(1, -0.5), bm(1, 20.0)]}, source="c", prompt="s")]
    pairs = audit.satisfaction_pairs(scored(spark, *recs), ranges(spark))
    want = audit.macro(audit.satisfaction_plans(audit.satisfaction_needs(pairs, [1, 2, None]), [0.5, 0.7]), ["weighted", "binary"], SUMMED, ["a", "c"])[1]
    source = audit.satisfaction_sources(pairs, [1, 2, None], [0.5, 0.7])
    assert rounded(audit.over_sources(source, ["weighted", "binary"], SUMMED, ["a", "c"])) == rounded(want)


def test_krc_summary_of_odd_lines_says_what_the_longer_way_says(spark, tmp_path, monkeypatch):
    from atlasmill.plans import audits

    monkeypatch.setattr(audit, "PAIRS_AT_ONCE", 40)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", " Middle East", None]
    tables = {
        "region": ([(i, n) for i, n in enumerate(names)], "r_regionkey int, r_name string"),
        "nation": ([(i, i) for i in range(6)], "n_nationkey int, n_regionkey int"),
        "customer": ([(i, i) for i in range(6)], "c_custkey long, c_nationkey int"),
        "supplier": ([(i, i % 6) for i in range(25)], "s_suppkey long, s_nationkey int"),
        "orders": ([(i, i % 7) for i in range(60)] + [(None, 1)], "o_orderkey long, o_custkey long"),
        "lineitem": (
            [(None if i % 97 == 0 else i * 7 % 63, None if i % 31 == 0 else i % 5 + 1, i * i % 26, i, 1.0 * i, None if i % 17 == 0 else i * 13 % 50 + 1.0, None if i % 19 == 0 else i % 11 / 100, None if i % 23 == 0 else i % 9 / 100) for i in range(700)],
            "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double",
        ),
    }
    for name, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    plans = audit.satisfaction_plans(audits._satisfaction(spark, str(tmp_path)), audits.THRESHOLDS)
    want = audits._rounded(audit.macro(plans, ["weighted", "binary"], SUMMED, audits.REGIONS)[1])
    assert rounded(audits.krc_summary(spark, str(tmp_path))) == rounded(want) and want.count() > 0
    spark.createDataFrame([], tables["lineitem"][1]).write.parquet(f"{tmp_path}/lineitem.parquet", mode="overwrite")
    assert audits.krc_summary(spark, str(tmp_path)).count() == 0
