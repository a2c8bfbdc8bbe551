import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasmill.operators import retrieval
from atlasmill.plans import catalog
from atlasmill.session import TABLES


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if not isinstance(v, (list, str)) and pd.isna(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("d", 0, "heart injury"), ("d", 1, "kidney injury"), ("d", 2, "kidney kidney")], "dom string, id int, text string")
    ask = lambda q: retrieval.bm25_scores(docs, spark.createDataFrame([(1, q)], "qid int, q string"), "dom", "id", "text", "qid", "q").collect()
    rows = ask("heart heart")
    assert [(r.doc, r.score) for r in rows] == [(0, pytest.approx(math.log(1 + 2.5 / 1.5)))]
    assert ask("unknown") == []


def test_fusion_by_hand(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 2, 1)], "g string, doc int, rank int")
    rows = retrieval.fuse(ranked, ["g"]).orderBy(F.desc("rrf_score")).collect()
    assert [(r.doc, r.hits) for r in rows] == [(2, 2), (1, 1)] and rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_cosine_of_every_row(spark, sf):
    """Every vector that shares its label gets its neighbours, in chunks or not, as brute force says."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.label, []).append((r.vec_id, np.array(r.embedding, float)))
    want = {}
    for group in by_label.values():
        for i, a in group:
            best = sorted((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), j) for j, b in group if j != i)[:10]
            if best:
                want[i] = [-x for x, _ in best]
    got = {}
    for r in catalog.queries()["cosine_topk_all"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert got.keys() == want.keys() and len(got) > len(by_label)
    assert all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_macros_are_all_replaced():
    for d in catalog.MACROS:
        for text in catalog.PLANS.values():
            assert not re.search(r"@[A-Z]", catalog.sql_for(d, text))


def test_best_documents_are_ranked_where_they_are(spark):
    """As bm25_scores ranks them, ties and terms in any order included, while only a task's best are dealt out."""
    r = np.random.default_rng(3)
    words = ["heart", "ſtraße", "kidney", "the", "ΣΑΣ", "漢字", "x1", "injury", "is"]
    docs = [(None if i % 50 == 49 else "ab"[i % 2], None if i % 97 == 5 else i, None if i % 41 == 0 else " ".join(r.choice(words, r.integers(0, 6)))) for i in range(400)]
    docs = spark.createDataFrame(docs, "dom string, id int, text string").repartition(3)
    asked = spark.createDataFrame([(j, " ".join(r.choice(words, 4))) for j in range(12)] + [(20, "unknown"), (21, None)], "qid int, q string")
    args = (docs, asked, "dom", "id", "text", "qid", "q")
    rows = lambda d: sorted(tuple(map(str, x)) for x in d.select("domain", "query", "doc", "score", "rank").collect())
    best = retrieval.bm25_top(*args, 4)
    assert rows(best) == rows(retrieval.top(retrieval.bm25_scores(*args), ["domain", "query"], 4)) and len(rows(best)) > 60
    assert retrieval.bm25_top(docs.where("false"), *args[1:], 4).count() == 0


def test_all_against_all_in_blocks(spark, tmp_path, monkeypatch, duck):
    """Copies, zero and missing vectors and repeated ids over several blocks, as the SQL has them; no row meets another alone."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 40)
    r = np.random.default_rng(5)
    rows = [(i if i % 60 else 7, None if i % 83 == 4 else [0.0] * 3 if i % 71 == 2 else ([1.0, 2.0, 3.0] if i % 3 else r.normal(size=3).tolist()), None if i % 90 == 1 else [1, 1, 2][i % 3]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    out = catalog.cosine_topk_all(spark, str(tmp_path))
    want, got = con.sql(catalog.oracle_sql()["cosine_topk_all"]).df(), out.toPandas()
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(want.columns)].itertuples(index=False))
    assert rows(got) == rows(want) and len(got) > 3000
    assert "Join" not in re.sub("Join.{0,40}domain", "", out._jdf.queryExecution().optimizedPlan().toString())


def test_texts_stay_where_they_are(spark, sf):
    """The documents' texts take part in no exchange: only words and their counts are dealt out."""
    plan = catalog.evidence_contains(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
