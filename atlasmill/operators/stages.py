"""Stages around retrieval: candidates of both methods, annotations, and a provider's judgement of candidates.

Requests are flat: request_id, domain, query_index, query; what a request carries along is joined back by its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.operators import items, retrieval
from atlasmill.sources import providers
from atlasmill.sources.store import EmbeddingStore

FILTER_TASK = "Decide for each candidate whether it supports the knowledge asked for. Keep one only with exact quotes from it. Answer with a JSON object {\"decisions\": [...]}, one for each candidate id."
COVERAGE_TASK = "Choose the candidates that together cover the knowledge asked for, and say whether they do. Answer with a JSON object with status, selected_ids and missing_knowledge."


def retrieve(requests: DataFrame, documents: DataFrame, own: DataFrame, store: EmbeddingStore | None = None, top_k: int = 10, limit: int = 20, rrf_k: int = retrieval.RRF_K) -> DataFrame:
    """request_id, domain, candidate_id, position, rrf_score, hits, hit_list: at most `limit` candidates a domain.

    documents: domain, candidate_id, prompt, completion; candidate_id ends with the sample's digest. own: request_id,
    own_digest. Without a store only BM25 ranks. A candidate with the request's own content is left out before the fusion.
    """
    text = documents.withColumn("_t", F.concat_ws("\n", "prompt", "completion"))
    asked = requests.withColumn("_q", F.struct("request_id", "query_index", F.col("domain").alias("at")))
    scored = retrieval.bm25_scores(text, asked, "domain", "candidate_id", "_t", "_q", "query").where("domain = query.at")
    scored = scored.select(F.col("query.request_id").alias("request_id"), "domain", F.col("query.query_index").alias("query_index"), "doc", "score")
    group = ["request_id", "domain"]
    lexical = retrieval.top(scored, [*group, "query_index"], top_k + 1)
    if store is None:
        semantic = lexical.where("false")
    else:
        frames = None
        for domain in sorted(r.domain for r in requests.select("domain").distinct().collect()):  # domains are few
            part = store.corpus(domain)[1].select(F.lit(domain).alias("domain"), F.col("candidate_id").alias("doc"), F.col("value").alias("d"))
            frames = part if frames is None else frames.union(part)
        vectors = store.query_vectors(requests.select("request_id", "domain", "query_index", "query"))
        semantic = retrieval.semantic_top(vectors.select("request_id", "domain", "query_index", "q"), frames, ["request_id", "query_index"], top_k + 1)
    digests = documents.select(F.col("candidate_id").alias("doc"), F.element_at(F.split("candidate_id", ":"), -1).alias("digest")).distinct()
    return retrieval.hybrid(lexical, semantic, group, digests, own, top_k, limit, rrf_k).withColumnRenamed("doc", "candidate_id")


def annotations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each domain and sample, the conflicts). rows: domain, digest, key_facts and more; of equal ones the
    first by file and line stays; a domain and sample with different key facts is a conflict and is in neither."""
    keys = ["domain", "digest"]
    kinds = rows.groupBy(*keys).agg(F.count_distinct(F.to_json("key_facts")).alias("_kinds"))
    first = Window.partitionBy(*keys).orderBy("source_file", "source_line")
    one = rows.join(kinds, keys).withColumn("_n", F.row_number().over(first))
    return one.where("_kinds = 1 and _n = 1").drop("_kinds", "_n"), kinds.where("_kinds > 1").select(*keys)


def annotate(candidates: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with key_facts, those without an annotation). candidates: domain, digest and more."""
    own = notes.select("domain", "digest", "key_facts")
    return candidates.join(own, ["domain", "digest"]), candidates.join(own, ["domain", "digest"], "left_anti")


def check_decisions(value: object, data: dict) -> dict:
    """A provider's decisions on the candidates of data: each once, kept ones with exact quotes."""
    texts = {c["candidate_id"]: c for c in data["candidates"]}
    told = {}
    for d in value["decisions"]:
        c = texts[d["candidate_id"]]
        if d["candidate_id"] in told or not isinstance(d["keep"], bool) or not str(d["reason"]).strip():
            raise ValueError("a decision is repeated or has no verdict or reason")
        quotes = [{"field": q["field"], "quote": q["quote"]} for q in d["evidence"]]
        if d["keep"] and not (quotes and str(d["supported_knowledge"]).strip() and all(q["field"] in ("prompt", "completion") and q["quote"].strip() and q["quote"] in c[q["field"]] for q in quotes)):
            raise ValueError("a kept candidate lacks knowledge or exact quotes")
        if not d["keep"] and (quotes or d["supported_knowledge"] != ""):
            raise ValueError("a rejected candidate has evidence")
        told[d["candidate_id"]] = {"candidate_id": d["candidate_id"], "keep": d["keep"], "supported_knowledge": d["supported_knowledge"], "reason": d["reason"].strip(), "evidence": quotes}
    if len(told) != len(texts):
        raise ValueError("not every candidate has a decision")
    return {"decisions": [told[i] for i in texts]}


def check_coverage(value: object, data: dict) -> dict:
    """A provider's choice among the candidates of data, and what is missing."""
    status, ids, missing = value["status"], value["selected_ids"], value["missing_knowledge"]
    allowed = {c["candidate_id"] for c in data["candidates"]}
    if status not in items.COVERAGE or len(set(ids)) != len(ids) or not set(ids) <= allowed or len(ids) > data["max_materials"] or not isinstance(missing, str):
        raise ValueError("bad status or selection")
    if (status == "none") == bool(ids) or (status == "sufficient") != (missing == "") or (status != "sufficient" and not missing.strip()):
        raise ValueError("status, selection and gap do not agree")
    return {"status": status, "selected_ids": ids, "missing_knowledge": missing}


def filter_knowledge(candidates: DataFrame, contexts: DataFrame, provider: Callable, cache: str, name: str, batch_size: int = 5, max_materials: int = 3, max_chars: int = 120_000, **options) -> DataFrame:
    """Per request and domain: status, materials (candidate_id, supported_knowledge, evidence), missing_knowledge, error.

    candidates: request_id, domain, position, candidate_id, prompt, completion. contexts: request_id, domain,
    context (JSON text). Candidates are judged in batches that fit; the kept ones are judged together. A domain
    without candidates is not asked about. A candidate too large for any request is an error, never cut.
    """
    key = ["request_id", "domain"]
    shown = F.to_json(F.struct("candidate_id", "prompt", "completion"))
    sized = candidates.join(contexts, key).withColumn("_text", shown)
    sized = sized.withColumn("_group", F.concat_ws("\u0000", *key)).withColumn("_size", F.length("_text") + 1)
    room = max_chars - len(FILTER_TASK) - 200
    flat = sized.select("_group", "position", "_size", *key, "context", "_text")
    batched = items.greedy_batches(flat.withColumn("_size", F.col("_size") + F.ceil(F.length("context") / batch_size).cast("int")), "_group", "position", "_size", batch_size, room)
    data = F.concat(F.lit('{"context":'), F.col("context"), F.lit(',"candidates":['), F.array_join("texts", ","), F.lit("]}"))
    requests = batched.where("batch is not null").groupBy(*key, "context", "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "_text"))), lambda x: x["_text"]).alias("texts")).select(*key, "context", data.alias("data"))
    told = providers.ask(requests, FILTER_TASK, "data", provider, check_decisions, cache, name, max_chars=max_chars, **options)
    answer = "decisions array<struct<candidate_id:string,keep:boolean,supported_knowledge:string,reason:string,evidence:array<struct<field:string,quote:string>>>>"
    failed = told.where("error is not null").select(*key, "error").union(batched.where("batch is null").select(*key, F.lit("a candidate does not fit").alias("error")))
    failed = failed.groupBy(*key).agg(F.min("error").alias("error"))
    kept = told.select(*key, F.explode(F.from_json("answer", answer)["decisions"]).alias("d")).where("d.keep").select(*key, "d.candidate_id", "d.supported_knowledge", "d.evidence")
    order = candidates.select(*key, "candidate_id", "position", "prompt", "completion")
    passed = kept.join(order, [*key, "candidate_id"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("position", "candidate_id", "prompt", "completion", "supported_knowledge", "evidence"))).alias("passed"))
    asked = contexts.join(candidates.select(*key).distinct(), key).join(failed.select(*key), key, "left_anti").join(passed, key, "left")
    listed = F.coalesce(F.to_json(F.transform("passed", lambda p: p.dropFields("position"))), F.lit("[]"))
    asked = asked.withColumn("data", F.concat(F.lit('{"context":'), F.col("context"), F.lit(f',"max_materials":{max_materials},"candidates":'), listed, F.lit("}")))
    judged = providers.ask(asked, COVERAGE_TASK, "data", provider, check_coverage, cache, name, max_chars=max_chars, **options)
    judged = judged.withColumn("a", F.from_json("answer", "status string, selected_ids array<string>, missing_knowledge string"))
    chosen = F.transform("a.selected_ids", lambda i: F.filter("passed", lambda p: p.candidate_id == i)[0])
    out = contexts.select(*key).join(judged.select(*key, "a.status", F.transform(chosen, lambda p: F.struct(p.candidate_id.alias("candidate_id"), p.supported_knowledge.alias("supported_knowledge"), p.evidence.alias("evidence"))).alias("materials"), "a.missing_knowledge", F.col("error").alias("_e")), key, "left").join(failed, key, "left")
    bare = out.join(candidates.select(*key).distinct().withColumn("_some", F.lit(True)), key, "left").withColumn("error", F.coalesce("error", "_e"))
    none = F.col("_some").isNull()
    return bare.select(*key, F.when(none, "none").otherwise(F.col("status")).alias("status"), "materials", F.when(none, "No candidates were retrieved.").otherwise(F.col("missing_knowledge")).alias("missing_knowledge"), "error")
