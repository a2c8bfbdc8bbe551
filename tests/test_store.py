"""The embedding store, providers and the stages on them, with a deterministic encoder and provider."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from atlasmill.functions.text import sample_hash
from atlasmill.operators import retrieval, stages
from atlasmill.sources import jsonl, providers
from atlasmill.sources.store import EmbeddingStore, last_token, token_windows

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test
CONFIG = {"format_version": 1, "model": "fixture", "dimension": 3}


class Encoder:
    def document_sequences(self, text):
        return token_windows([ord(c) for c in text], 24, 4)

    def query_sequence(self, domain, query):
        return [ord(c) for c in f"{domain}: {query}"]

    def encode_sequences(self, sequences):
        return np.array([[sum(s) % 17 + 1, len(s) + 1, 2] for s in sequences], float)


def corpus(spark, path, samples):
    path.mkdir(parents=True, exist_ok=True)
    (path / "train.jsonl").write_text("\n" + "\n".join(json.dumps({"prompt": p, "completion": c}) for p, c in samples) + "\n")
    rows = jsonl.read_rows(spark, str(path))
    return rows.select("source_file", "source_line", "value", F.get_json_object("value", "$.prompt").alias("prompt"), F.get_json_object("value", "$.completion").alias("completion"))


def test_windows_and_pooling():
    assert token_windows(list(range(5)), 3, 1) == [[0, 1, 2], [2, 3, 4]] and token_windows([1], 3, 1) == [[1]] and token_windows([], 3, 1) == []
    with pytest.raises(ValueError):
        token_windows([1], 3, 3)
    h = np.arange(12).reshape(2, 3, 2)
    assert last_token(h, np.array([[1, 1, 0], [0, 1, 1]])).tolist() == [[2, 3], [10, 11]]
    with pytest.raises(ValueError):
        last_token(h, np.zeros((2, 3), int))


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with pytest.raises(ValueError):
        EmbeddingStore(spark, root, readonly=True)
    store = EmbeddingStore(spark, root, CONFIG)
    rows = corpus(spark, tmp_path / "medical", [("heart", "beats"), ("heart ", "BEATS"), ("kidney", "x" * 60)])
    built = store.build_corpus("medical", rows, Encoder, batch_size=2)
    assert (built["status"], built["samples"], built["chunks"]) == ("built", 2, 1 + 4) and store.vectors().count() == built["new_vectors"]
    assert store.build_corpus("medical", rows, Encoder)["status"] == "cached"
    documents, chunks = store.corpus("medical", ["train"])
    assert sorted(r.source_line for r in documents.collect()) == [2, 4] and chunks.count() == 5
    with pytest.raises(ValueError):
        store.corpus("medical", ["test"])
    other = corpus(spark, tmp_path / "medical", [("lung", "air")])
    with pytest.raises(ValueError):
        store.build_corpus("medical", other, Encoder)
    assert store.build_corpus("medical", other, Encoder, replace=True)["samples"] == 1
    with pytest.raises(ValueError):
        EmbeddingStore(spark, root, CONFIG | {"model": "other"})
    pairs = spark.createDataFrame([("medical", "x"), ("medical", "x"), ("legal", "x")], "domain string, query string")
    assert store.build_queries(pairs, Encoder) == {"queries": 2, "new_queries": 2}
    assert store.build_queries(pairs, Encoder) == {"queries": 2, "new_queries": 0}
    got = store.query_vectors(pairs.distinct()).collect()
    assert all(np.linalg.norm(r.q) == pytest.approx(1, abs=1e-5) for r in got)
    with pytest.raises(Exception, match="no saved vector"):
        store.query_vectors(spark.createDataFrame([("medical", "unknown")], "domain string, query string")).collect()


def test_hybrid_retrieval(spark, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/store", CONFIG)
    rows = corpus(spark, tmp_path / "d", [("heart injury", "a"), ("kidney injury", "b"), ("kidney kidney", "c"), ("the own", "heart")])
    store.build_corpus("d", rows, Encoder)
    requests = spark.createDataFrame([(1, "d", 1, "heart"), (1, "d", 2, "the of")], "request_id int, domain string, query_index int, query string")
    store.build_queries(requests, Encoder)
    documents = store.corpus("d")[0].withColumn("domain", F.lit("d"))
    own = spark.createDataFrame([(1, "the  OWN", "Heart")], "request_id int, p string, c string").select("request_id", sample_hash("p", "c").alias("own_digest"))
    out = stages.retrieve(requests, documents, own, store, top_k=2, limit=3).orderBy("position").collect()
    texts = {r.candidate_id: r.prompt for r in documents.collect()}
    assert "the own" not in [texts[r.candidate_id] for r in out] and 1 <= len(out) <= 3
    for r in out:
        assert r.hits == len(r.hit_list) and r.rrf_score == pytest.approx(sum(1 / (60 + h["rank"]) for h in r.hit_list))
        assert all(1 <= h["rank"] <= 2 for h in r.hit_list)
    bm25 = [h for r in out for h in r.hit_list if h.method == "bm25"]
    assert [(h.query_index, h["rank"]) for h in bm25] == [(1, 1)]
    alone = stages.retrieve(requests, documents, own, None, top_k=2, limit=3).collect()
    assert [texts[r.candidate_id] for r in alone] == ["heart injury"]


def test_tokens(spark):
    d = spark.createDataFrame([("The Straße α-Ω 漢字 DNA2 of x",), (None,), ("ΣΟΦΟΣ ſun",)], "t string")
    assert [r[0] for r in d.select(retrieval.tokens(F.col("t"))).collect()] == [["strasse", "α", "ω", "漢", "字", "dna2", "x"], [], ["σ", "ο", "φ", "ο", "σ", "sun"]]
    every = "".join(chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c < 0xE000)
    import re

    want = [t for t in re.findall("[a-z0-9]+|[Ͱ-Ͽ]|[一-鿿]", every.casefold()) if t not in retrieval.STOPWORDS]
    got = spark.createDataFrame([(every,)], "t string").select(retrieval.tokens(F.col("t"))).first()[0]
    assert set(got) ^ set(want) <= {"i"}  # the dotted capital I has a lower case of two letters


class Judge:
    """Keeps candidates whose prompt holds the letter k; fails for a prompt 'boom', once for 'flaky'."""

    def __init__(self, log):
        self.log, self.seen = log, set()

    def chat(self, system, data, max_tokens):
        with open(self.log, "a") as f:
            f.write("x\n")
        if system == stages.COVERAGE_TASK:
            ids = [c["candidate_id"] for c in data["candidates"]][: data["max_materials"]]
            return {"status": "sufficient" if ids else "none", "selected_ids": ids, "missing_knowledge": "" if ids else "all"}
        out = []
        for c in data["candidates"]:
            if c["prompt"] == "boom" or (c["prompt"] == "k flaky" and not self.seen):
                self.seen.add(1)
                raise providers.ProviderError("HTTP 500" if "flaky" in c["prompt"] else "HTTP 400", "flaky" in c["prompt"])
            keep = "k" in c["prompt"]
            out.append({"candidate_id": c["candidate_id"], "keep": keep, "supported_knowledge": "s" if keep else "", "reason": "r", "evidence": [{"field": "prompt", "quote": "k"}] if keep else []})
        return {"decisions": out}


def test_filter_knowledge(spark, tmp_path):
    rows = [(1, "d", i, f"d:{i}", p, "c") for i, p in enumerate(["kidney", "heart", "k flaky", "kin", "knee"], 1)] + [(2, "d", 1, "d:9", "boom", "c"), (4, "d", 1, "d:8", "heart", "c"), (5, "d", 1, "d:7", "k" * 5000, "c")]
    candidates = spark.createDataFrame(rows, "request_id int, domain string, position int, candidate_id string, prompt string, completion string")
    contexts = spark.createDataFrame([(i, "d", '{"q": "é"}') for i in (1, 2, 3, 4, 5)], "request_id int, domain string, context string")
    log, cache = str(tmp_path / "log"), f"file://{tmp_path}/cache"
    run = lambda: {r.request_id: r for r in stages.filter_knowledge(candidates, contexts, lambda: Judge(log), cache, "fake", batch_size=2, max_materials=3, max_chars=3000, wait=lambda _: None).collect()}
    got = run()
    assert [m.candidate_id for m in got[1].materials] == ["d:1", "d:3", "d:4"] and got[1].status == "sufficient" and got[1].error is None
    assert got[2].error == "HTTP 400" and got[2].status is None
    assert (got[3].status, got[3].missing_knowledge) == ("none", "No candidates were retrieved.")
    assert (got[4].status, got[4].materials, got[4].missing_knowledge) == ("none", [], "all")
    assert got[5].error == "a candidate does not fit"
    before = len(open(log).read().splitlines())
    again = run()
    assert {k: (r.status, r.error) for k, r in again.items()} == {k: (r.status, r.error) for k, r in got.items()}
    assert len(open(log).read().splitlines()) == before + 1  # only the failed request is asked again


def test_annotations(spark):
    notes = spark.createDataFrame([("d", "1", ["a"], "f", 1), ("d", "1", ["a"], "f", 2), ("d", "2", ["a"], "f", 3), ("d", "2", ["b"], "f", 4)], "domain string, digest string, key_facts array<string>, source_file string, source_line int")
    one, conflicts = stages.annotations(notes)
    assert [(r.digest, r.source_line) for r in one.collect()] == [("1", 1)] and [r.digest for r in conflicts.collect()] == ["2"]
    told, skipped = stages.annotate(spark.createDataFrame([("d", "1"), ("d", "3")], "domain string, digest string"), one)
    assert [r.key_facts for r in told.collect()] == [["a"]] and [r.digest for r in skipped.collect()] == ["3"]


def test_http_provider_settings():
    for bad in (("http://x", "k", "m"), ("https://x", " ", "m"), ("ftp://x", "k", "m")):
        with pytest.raises(ValueError):
            providers.HttpProvider(*bad)
    with pytest.raises(ValueError):
        providers.HttpProvider("https://x", "k", "m", timeout=float("nan"))
    p = providers.HttpProvider("http://127.0.0.1:9", "secret-key", "m", timeout=1, plain_http=True)
    with pytest.raises(providers.ProviderError) as e:
        p.chat("s", {}, 5)
    assert e.value.again and "secret-key" not in str(e.value)


def test_checks_of_answers():
    data = {"candidates": [{"candidate_id": "a", "prompt": "p", "completion": "c"}], "max_materials": 1}
    ok = {"candidate_id": "a", "keep": True, "supported_knowledge": "k", "reason": "r", "evidence": [{"field": "prompt", "quote": "p"}]}
    assert stages.check_decisions({"decisions": [ok]}, data)["decisions"][0]["keep"]
    for bad in ([], [ok, ok], [ok | {"evidence": []}], [ok | {"evidence": [{"field": "prompt", "quote": "z"}]}], [ok | {"keep": False}], [ok | {"candidate_id": "b"}]):
        with pytest.raises((ValueError, KeyError)):
            stages.check_decisions({"decisions": bad}, data)
    for bad in (("sufficient", [], ""), ("sufficient", ["a"], "g"), ("partial", ["a"], " "), ("none", ["a"], "g"), ("partial", ["b"], "g"), ("partial", ["a", "a"], "g")):
        with pytest.raises(ValueError):
            stages.check_coverage(dict(zip(("status", "selected_ids", "missing_knowledge"), bad)), data)
