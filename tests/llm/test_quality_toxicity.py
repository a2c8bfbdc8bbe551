import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import quality, toxicity

BIG = "/root/testdata/sf0.01"


def held(out, labels, label):
    rows = out.join(labels.select("doc_id", label), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return [r for r in rows if r.held_out]


def test_quality_on_the_held_out_fold(spark):
    out = quality.op4_neighbour_quality(spark, BIG)
    rows = held(out, spark.read.parquet(f"{BIG}/labels.parquet"), "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "good words here", "x"), (None, "good words here", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(3)] + [(None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    for some in (none, labels):
        model = quality.fit(docs, some)
        rows = quality.classify(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
        assert quality.classify(docs.where("false"), model).count() == 0
        kept = quality.accepted(docs, some)
        assert kept.columns == docs.columns
        assert len(toxicity.classify(docs, toxicity.fit(docs, some)).collect()) == 4


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    x, y = np.abs(rng.standard_normal((300, quality.WIDTH))).astype(np.float32), rng.integers(0, 2, 300)
    model = quality.Model(x, y)
    asked = x[:7] + 0.3 * np.abs(rng.standard_normal((7, quality.WIDTH)).astype(np.float32))
    got = model.score(asked)
    # A row's score is the same to the last digit in any batch.
    assert all((model.score(np.concatenate([x[:n], asked]))[n:] == got).all() for n in (1, 2, 249, 255, 256, 257))
    for q, s in zip(asked, got):
        z = model.latent(q[None])[0].astype(float)
        cos = sorted(((float(z @ p), int(v)) for p, v in zip(model.points.astype(float), y)), reverse=True)[: quality.NEIGHBOURS]
        w = [max(c, 0) ** 4 + 1e-6 for c, _ in cos]
        assert s == pytest.approx((sum(a * v for a, (_, v) in zip(w, cos)) + model.prior / 2) / (sum(w) + 0.5), abs=1e-8)


def score(text, model=toxicity.Model(toxicity.DEFAULT)):
    return float(model.score(toxicity.clause_kinds(text)[None])[0])


@pytest.mark.parametrize("text", ["You are an idiot.", "What a pathetic clown you are!", "I will hurt you", "er stupid blet\nthat moron onth"])
def test_toxic_clauses(text):
    assert score(text) >= 0.5


@pytest.mark.parametrize("text", ["", "He is not an idiot.", "She said he was an idiot.", "Beat the eggs and burn the sugar.", "nobody was hurt", "Killing time."])
def test_clean_clauses(text):
    assert score(text) < 0.5


def test_parts_one_after_another():
    """The composed automaton puts out what the transducers do when each reads the one before."""
    r = np.random.default_rng(2)
    weights = np.array([0.3, 0.12, 0.08, 0.12, 0.1, 0.06, 0.08, 0.08, 0.06])
    for _ in range(300):
        symbols = [int(x) for x in r.choice(9, int(r.integers(1, 60)), p=weights / weights.sum())]
        out = symbols
        for part in toxicity.parts():
            out = part.run(out)
        assert toxicity.grammar().run(symbols) == out
    whole = toxicity.parts()[0]
    for part in toxicity.parts()[1:]:
        whole = whole.then(part)
    assert len(toxicity.grammar().arcs) < len(whole.arcs)


#: Sentences with words of the lists: 1 where they insult or threaten.
SENTENCES = [
    ("You are an idiot.", 1), ("What a pathetic clown you are!", 1), ("I will hurt you.", 1), ("We are going to kill them, they should die; I will destroy you", 1), ("Shut up, you moron", 1),
    ("You worthless scum.", 1), ("I'll punch him.", 1), ("That bastard!", 1), ("He is not an idiot.", 0), ("She said he was an idiot.", 0), ("Nobody called you stupid.", 0),
    ("The report claims they are liars and a coward was quoted.", 0), ("Never a dumb question.", 0), ("Beat the eggs.", 0), ("It isn't garbage.", 0), ("He wrote that the trash was out.", 0), ("The storm may destroy crops.", 0), ("You are kind.", 0),
]


def test_grammar_beats_the_bare_list():
    listed = lambda t: any(w in toxicity.INSULTS or w in toxicity.THREATS for w in re.findall("[a-z']+", t.lower()))
    grammar_right = sum((score(t) >= 0.5) == y for t, y in SENTENCES)
    list_right = sum(listed(t) == y for t, y in SENTENCES)
    assert grammar_right == len(SENTENCES) and list_right <= 10


def test_learned_stems(spark):
    rows = [(i, ("vor quaxel tum. quaxim sel. " if i % 4 == 0 else "vor tum sel. ") + "lo re mi", int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert any("quaxel".startswith(s) for s in model.stems)
    got = {r.doc_id: r.score for r in toxicity.classify(docs, model).collect()}
    assert min(got[i] for i, _, y in rows if y) > max(got[i] for i, _, y in rows if not y)


def test_toxicity_on_the_held_out_fold(spark):
    rows = held(toxicity.op9_clause_toxicity(spark, BIG), spark.read.parquet(f"{BIG}/labels.parquet"), "toxic")
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.93
    assert sum(r.predicted and not r.toxic for r in rows) <= 1
    assert toxicity.op9_clause_toxicity(spark, BIG).where(F.col("score").isNull()).count() == 0
