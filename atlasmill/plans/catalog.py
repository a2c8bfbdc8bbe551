"""The registered queries on the reference's operators, with the SQL that says the same.

Plans are written once with a few macros where Spark's and ANSI-style SQL differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.functions import text as texts
from atlasmill.functions.shared import cume_dist, ranked
from atlasmill.operators import judging, matching, retrieval
from atlasmill.plans import audits
from atlasmill.session import run_sql, table

MACROS = {
    "spark": {"TOKENS": "regexp_extract_all(lower({0}), '[a-z0-9]+', 0)", "EXPLODE": "explode({0})", "LEN": "size({0})", "SHA": "sha2({0}, 256)", "PCT": "percentile({0}, {1})", "COUNT_IF": "count_if({0})", "SORTED": "array_sort({0})", "COLLECT": "collect_set({0})", "JOINED": "array_join({0}, ',')", "SQUEEZE": "trim(regexp_replace(lower({0}), '\\\\s+', ' '))", "RANGE": "sequence(0, {0})", "SLICE": "slice({0}, {1} + 1, {2})", "CHARS": "length({0})", "DIV": "({0}) div ({1})", "REPLACED": "regexp_replace({0}, {1}, {2})", "SQUARES": "aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))", "WORDS": "size(regexp_extract_all({0}, '\\\\S+', 0))"},
    "duck": {"TOKENS": "regexp_extract_all(lower({0}), '[a-z0-9]+')", "EXPLODE": "unnest({0})", "LEN": "len({0})", "SHA": "sha256({0})", "PCT": "quantile_cont({0}, {1})", "COUNT_IF": "count_if({0})", "SORTED": "list_sort({0})", "COLLECT": "list(DISTINCT {0})", "JOINED": "array_to_string({0}, ',')", "SQUEEZE": "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))", "RANGE": "range(0, ({0}) + 1)", "SLICE": "{0}[{1} + 1:{1} + {2}]", "CHARS": "length({0})", "DIV": "({0}) // ({1})", "REPLACED": "regexp_replace({0}, {1}, {2}, 'g')", "SQUARES": "list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[]))", "WORDS": "len(regexp_extract_all({0}, '\\S+'))"},
}


def sql_for(dialect: str, text: str) -> str:
    """Replaces @NAME(a; b) by the dialect's form, the last (innermost) one first."""
    while (at := text.rfind("@")) >= 0:
        name = re.match(r"@([A-Z_]+)\(", text[at:])
        begin = end = at + name.end()
        depth = 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = text[:at] + MACROS[dialect][name[1]].format(*[x.strip() for x in text[begin : end - 1].split(";")]) + text[end:]
    return text


COMBOS = """
foreign_regions AS (
  SELECT DISTINCT o.o_orderkey AS plan, cn.n_regionkey AS source, sn.n_regionkey AS target
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  WHERE sn.n_regionkey <> cn.n_regionkey),
plans AS (
  SELECT plan, source, CAST(count(*) + 1 AS INT) AS k, CAST(sum(CAST(power(2, target) AS INT)) AS INT) AS combo
  FROM foreign_regions GROUP BY plan, source),
combos AS (SELECT source, k, combo, count(*) AS n FROM plans GROUP BY source, k, combo),
totals AS (SELECT source, k, CAST(sum(n) AS DOUBLE) AS total, count(*) AS observed FROM combos GROUP BY source, k),
sources AS (SELECT r_regionkey AS source FROM region),
ks AS (SELECT 2 AS k, 4 AS possible UNION ALL SELECT 3, 6 UNION ALL SELECT 4, 4 UNION ALL SELECT 5, 1),
entropies AS (
  SELECT s.source, ks.k, ks.possible, coalesce(t.total, 0.0) AS total, coalesce(t.observed, 0) AS observed,
    coalesce((SELECT abs(sum(c.n / t2.total * ln(c.n / t2.total))) FROM combos c JOIN totals t2 ON c.source = t2.source AND c.k = t2.k WHERE c.source = s.source AND c.k = ks.k), 0.0) AS entropy
  FROM sources s CROSS JOIN ks LEFT JOIN totals t ON t.source = s.source AND t.k = ks.k),
scored AS (
  SELECT source, k, possible, total, observed, entropy,
    CASE WHEN total = 0 OR possible <= 1 THEN NULL ELSE entropy / ln(possible) END AS dde FROM entropies)
"""

TURNS = """
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
pairs AS (SELECT conv_id, turn, text AS prompt, next_text AS completion FROM turns WHERE role = 'user' AND next_role = 'assistant')
"""

PLANS = {
    "scan_documents_by_lang": "SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "first_seen_dedup": "SELECT doc_id, doc_key FROM (SELECT doc_id, @SHA(@SQUEEZE(text)) AS doc_key, row_number() OVER (PARTITION BY lang, @SHA(@SQUEEZE(text)) ORDER BY source, doc_id) AS rn FROM documents) t WHERE rn = 1",
    "duplicate_rejection": "SELECT lang, doc_key, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT lang, doc_id, @SHA(text) AS doc_key FROM documents) t GROUP BY lang, doc_key HAVING count(*) > 1",
    "conv_qa_pairs": f"WITH {TURNS} SELECT conv_id, CAST(turn AS BIGINT) AS turn, @SHA(concat(prompt, chr(10), completion)) AS pair_key FROM pairs",
    "length_stats": f"WITH {TURNS} SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(@WORDS(prompt) AS BIGINT) AS prompt_words, CAST(@CHARS(prompt) AS BIGINT) AS prompt_chars, CAST(@WORDS(completion) AS BIGINT) AS completion_words FROM pairs",
    "budget_issues": "SELECT doc_id, CAST(CASE WHEN n_chars > 130 * 12 THEN 1 ELSE 0 END AS INT) AS over_chars, CAST(CASE WHEN @WORDS(text) > 130 THEN 1 ELSE 0 END AS INT) AS over_words FROM documents",
    "paired_sample": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY @SHA(concat('42', source, CAST(doc_id AS STRING))), doc_id) AS rn FROM documents) t WHERE rn <= 3",
    "running_first_n_matches": "SELECT user_id, max(processed) AS processed, max(matched) AS matched FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS processed, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS matched, event_type FROM events) t WHERE matched < 3 OR (matched = 3 AND event_type = 'purchase') GROUP BY user_id",
    "event_funnel_rollup": "SELECT event_type, CAST(user_id AS BIGINT) AS user_id, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id)",
    "last_errors": "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') t WHERE rn <= 3",
    "record_index_checks": "SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_sample' ELSE 'known' END AS status, count(*) AS records FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id GROUP BY l.doc_id, d.doc_id",
    "annotate_join": "SELECT d.doc_id, d.lang, l.quality AS annotation FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "skipped_unannotated": "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id",
    "plan_join_ambiguity": "SELECT o_custkey, count(DISTINCT o_orderpriority) AS plans, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'match' ELSE 'ambiguous' END AS reason FROM orders GROUP BY o_custkey",
    "old_new_match": "SELECT coalesce(a.k, b.k) AS match_key, coalesce(a.n, 0) AS old_items, coalesce(b.n, 0) AS new_items, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'unmatched' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k",
    "intersect_atoms": "SELECT c_nationkey AS atom FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "union_atoms": "SELECT c_nationkey AS atom FROM customer UNION SELECT s_nationkey FROM supplier",
    "lineage_preserved": "SELECT l.l_orderkey AS plan, CAST(@COUNT_IF(o.o_orderkey IS NULL) AS BIGINT) AS orphans, min(CASE WHEN o.o_orderdate <= l.l_shipdate THEN 1 ELSE 0 END) AS in_order FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY l.l_orderkey",
    "vector_norms": "SELECT vec_id, round(sqrt(@SQUARES(embedding)), 9) AS norm FROM embeddings",
    "duplicate_plans": "SELECT o_orderkey, CASE WHEN o_orderkey = first_key THEN 'first' WHEN o_orderpriority = first_content THEN 'duplicate' ELSE 'conflict' END AS status FROM (SELECT o_orderkey, o_orderpriority, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_key, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_content FROM orders) t",
    "acceptance_funnel": "SELECT user_id % 7 AS difficulty, CAST(@COUNT_IF(event_type = 'click') AS BIGINT) AS initial, CAST(@COUNT_IF(event_type = 'purchase') AS BIGINT) AS accepted, round(@COUNT_IF(event_type = 'purchase') / nullif(CAST(@COUNT_IF(event_type = 'click') AS DOUBLE), 0), 9) AS acceptance FROM events GROUP BY user_id % 7",
    "combination_masks": "SELECT CAST(k AS BIGINT) AS k, CAST(mask AS BIGINT) AS mask FROM (SELECT @EXPLODE(@RANGE(127)) AS mask) t CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4) u WHERE bit_count(mask) = k - 1",
    "length_budgets": "SELECT k, 75 + 20 * (k - 2) AS question_words, 18 + 2 * (k - 2) AS option_words, 130 + 30 * (k - 2) AS total_words, 12 * (130 + 30 * (k - 2)) AS total_chars FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS k FROM lineitem WHERE l_linenumber BETWEEN 2 AND 7) t",
    "position_histogram": "SELECT l_returnflag AS status, CAST(l_linenumber AS BIGINT) AS position, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linenumber",
    "route_reasons": "SELECT doc_id, concat_ws(',', CASE WHEN toxic = 1 THEN 'critical' END, CASE WHEN abs(quality - toxic) >= 1 THEN 'gap' END, CASE WHEN quality = 0 THEN 'below_threshold' END) AS reasons FROM labels",
    "selection_heatmap": f"WITH {COMBOS} SELECT CAST(p.source AS BIGINT) AS source, round(avg(CASE WHEN floor(combo / 1) % 2 = 1 THEN 1e0 ELSE 0e0 END), 9) AS target_0, round(avg(CASE WHEN floor(combo / 2) % 2 = 1 THEN 1e0 ELSE 0e0 END), 9) AS target_1, round(avg(CASE WHEN floor(combo / 4) % 2 = 1 THEN 1e0 ELSE 0e0 END), 9) AS target_2, round(avg(CASE WHEN floor(combo / 8) % 2 = 1 THEN 1e0 ELSE 0e0 END), 9) AS target_3, round(avg(CASE WHEN floor(combo / 16) % 2 = 1 THEN 1e0 ELSE 0e0 END), 9) AS target_4 FROM plans p GROUP BY p.source",
    "rate_triplets": "SELECT lang, CAST(@COUNT_IF(quality = 1) AS BIGINT) AS passed, count(quality) AS denominator, round(CAST(@COUNT_IF(quality = 1) AS DOUBLE) / nullif(count(quality), 0), 9) AS rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang",
    "disjoint_pools": "SELECT count(*) AS shared FROM (SELECT doc_id FROM documents WHERE n_chars % 2 = 0 INTERSECT SELECT doc_id FROM documents WHERE n_chars % 2 = 1) t",
    "mixed_config_check": "SELECT lang, count(DISTINCT source) AS configs, CASE WHEN count(DISTINCT source) = 1 THEN 'ok' ELSE 'mixed' END AS status FROM documents GROUP BY lang",
}


def _bm25(spark, folder: str) -> DataFrame:
    return retrieval.bm25_top(table(spark, folder, "documents"), table(spark, folder, "benchmark"), "lang", "doc_id", "text", "item_id", "text", 10)


def bm25_topk(spark, folder: str) -> DataFrame:
    out = _bm25(spark, folder)
    return out.select("domain", F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark, folder: str) -> DataFrame:
    best = _bm25(spark, folder).withColumnRenamed("query", "query_index")
    return retrieval.fuse(best, ["domain"]).select("domain", F.col("doc").alias("doc_id"), F.round("rrf_score", 9).alias("rrf_score"), "hits")


def _tokens(spark, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "lang", retrieval.tokens(F.col("text")).alias("ts"))


def tokenize_counts(spark, folder: str) -> DataFrame:
    return _tokens(spark, folder).select("doc_id", F.size("ts").cast("long").alias("n_tokens"))


def doc_freq(spark, folder: str) -> DataFrame:
    return _tokens(spark, folder).select("lang", F.explode(F.array_distinct("ts")).alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))


def avgdl_by_lang(spark, folder: str) -> DataFrame:
    return _tokens(spark, folder).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.round(F.avg(F.size("ts").cast("double")), 9), F.lit(1.0)).alias("avgdl"))


def token_windows(spark, folder: str) -> DataFrame:
    """Windows of 128 tokens that overlap by 32. Each is digested inside its document's row, so no row carries the tokens along."""
    n = F.size("ts")
    last = F.when(n <= 128, 0).otherwise(F.floor((n - 128 + 95) / 96)).cast("int")
    one = lambda w: F.slice("ts", w * 96 + 1, 128)
    each = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct((w * 96).cast("long").alias("start"), F.size(one(w)).cast("long").alias("n"), F.sha2(F.array_join(one(w), ","), 256).alias("window_key")))
    return _tokens(spark, folder).where(n > 0).select("doc_id", F.inline(each))


def length_p95(spark, folder: str) -> DataFrame:
    """From the histogram of lengths, so a group's buffer holds its different lengths only."""
    counts = table(spark, folder, "documents").where("n_chars is not null").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    at = lambda p: F.round(F.percentile(F.col("n_chars").cast("double"), p, F.col("c")), 9)
    return counts.groupBy("lang").agg(F.sum("c").alias("n"), F.round(F.sum(F.col("n_chars") * F.col("c")) / F.sum("c"), 9).alias("mean_chars"), at(0.5).alias("median_chars"), at(0.95).alias("p95_chars"))


def ecdf(spark, folder: str) -> DataFrame:
    return cume_dist(table(spark, folder, "events"), "event_type", "value").select("event_type", "event_id", F.round("share", 9).alias("share"))


def _hashed(spark, folder: str, salt: str, label: str) -> DataFrame:
    """Documents with their place in their source by a hash of salt, source and id."""
    rows = table(spark, folder, "documents").select("source", "doc_id", F.sha2(F.concat_ws("|", F.lit(salt), "source", F.col("doc_id").cast("string")), 256).alias("h"))
    return ranked(rows, "source", [F.col("source").asc_nulls_last(), F.col("h").asc(), F.col("doc_id").asc()], label)


def ref_eval_split(spark, folder: str) -> DataFrame:
    """A fifth of each source, one at least, is the reference; evaluation is the rest."""
    placed = _hashed(spark, folder, "ref", "split")
    sizes = placed.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    out = placed.join(sizes, placed.source.eqNullSafe(sizes.s))
    return out.select("source", "doc_id", F.when(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("n") * 0.2)), "reference").otherwise("evaluation").alias("pool"))


def alternation(spark, folder: str) -> DataFrame:
    return _hashed(spark, folder, "42", "sides").select("source", "doc_id", F.when(F.col("_rank") % 2 == 0, "P").otherwise("Q").alias("side"))


def stratified_audit(spark, folder: str) -> DataFrame:
    return judging.audit_sample(table(spark, folder, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 0.1, "42")


def evidence_contains(spark, folder: str) -> DataFrame:
    held = matching.contained(table(spark, folder, "benchmark"), table(spark, folder, "documents"), "item_id", "text", "doc_id", "text")
    return held.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("holders"))


def secrets_redacted(spark, folder: str) -> DataFrame:
    """Documents as they are and with a key put in, both redacted."""
    docs = table(spark, folder, "documents")
    with_key = F.concat(F.lit("risk-free sk-short "), "text", F.lit(" sk-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 20), F.lit("."))
    return docs.select("doc_id", F.sha2(texts.redacted(F.col("text")), 256).alias("redacted_key"), F.sha2(texts.redacted(with_key, ["risk-free"]), 256).alias("with_key"))


def option_reference_issues(spark, folder: str) -> DataFrame:
    """Assistant turns with an option letter put before them where the turn's number is odd."""
    rows = table(spark, folder, "conversations").where("role = 'assistant'")
    shown = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("As option "), F.substring(F.lit("abcd"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)), F.lit(" says, "), "text")).otherwise(F.col("text"))
    return rows.where(matching.names_an_option(shown)).select("conv_id", F.col("turn").cast("long").alias("turn"))


def cosine_topk(spark, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    first = vectors.groupBy("label").agg(F.min("vec_id").alias("first"))
    queries = vectors.join(F.broadcast(first.select(F.col("first").alias("vec_id"))), "vec_id", "left_semi")
    out = retrieval.cosine_top(queries, vectors, "label", "vec_id", "embedding", 10)
    return out.select(F.col("domain").alias("label"), F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def cosine_topk_all(spark, folder: str) -> DataFrame:
    """The neighbours of every row; cosine_topk asks for those of one row a label."""
    vectors = table(spark, folder, "embeddings")
    out = retrieval.cosine_top_all(vectors, "label", "vec_id", "embedding", 10)
    return out.select(F.col("domain").alias("label"), F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


_STOP = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
DUCK_TOKENS = f"list_filter(regexp_extract_all(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ς', 'σ'), '[a-z0-9]+|[\\x{{0370}}-\\x{{03ff}}]|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: NOT list_contains([{_STOP}], x))"
BM25_SQL = f"""
tokens AS (SELECT lang, doc_id, {DUCK_TOKENS} AS ts FROM documents),
stats AS (SELECT lang, count(*) AS n, greatest(avg(len(ts)::DOUBLE), 1.0) AS mean FROM tokens GROUP BY lang),
tf AS (SELECT lang, doc_id, dl, term, count(*) AS tf FROM (SELECT lang, doc_id, len(ts) AS dl, unnest(ts) AS term FROM tokens) GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({DUCK_TOKENS}) AS term FROM benchmark),
parts AS (
  SELECT tf.lang AS domain, item_id, doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS part
  FROM tf JOIN df USING (lang, term) JOIN stats USING (lang) JOIN asked USING (term)),
scored AS (SELECT domain, item_id, doc_id, list_sum(list(part ORDER BY term)) AS score FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
"""

FRAMES = {f.__name__: f for f in (bm25_topk, rrf_fusion, cosine_topk, cosine_topk_all, tokenize_counts, doc_freq, avgdl_by_lang, token_windows, length_p95, ecdf, ref_eval_split, alternation, stratified_audit, evidence_contains, secrets_redacted, option_reference_issues)}
FRAME_SQL = {
    "bm25_topk": f"WITH {BM25_SQL} SELECT domain, item_id, doc_id, round(score, 9) AS score, rank FROM ranked WHERE rank <= 10",
    "rrf_fusion": f"WITH {BM25_SQL} SELECT domain, doc_id, round(list_sum(list(1.0 / (60 + rank) ORDER BY item_id, rank)), 9) AS rrf_score, count(*) AS hits FROM ranked WHERE rank <= 10 GROUP BY domain, doc_id",
    "hybrid_fusion": f"""WITH {BM25_SQL},
unit AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
chunks AS (SELECT vec_id AS doc_id, e, n FROM unit UNION ALL SELECT vec_id + 7, e, n FROM unit),
near AS (SELECT b.item_id, d.lang AS domain, d.doc_id, max(list_dot_product(q.e, c.e) / (q.n * c.n)) AS score FROM benchmark b JOIN unit q ON q.vec_id = b.item_id CROSS JOIN documents d JOIN chunks c ON c.doc_id = d.doc_id GROUP BY ALL),
both_ AS (SELECT item_id, domain, doc_id, 'bm25' AS method, score FROM scored UNION ALL SELECT item_id, domain, doc_id, 'embedding', score FROM near),
deep AS (SELECT *, row_number() OVER (PARTITION BY item_id, domain, method ORDER BY score DESC, doc_id) AS r FROM both_),
own AS (SELECT DISTINCT doc_id, sha256(lower(trim(text))) AS g FROM documents),
kept AS (
  SELECT d.item_id, d.domain, d.doc_id, d.method, row_number() OVER (PARTITION BY d.item_id, d.domain, d.method ORDER BY d.score DESC, d.doc_id) AS rank
  FROM deep d JOIN own o ON o.doc_id = d.doc_id JOIN benchmark b ON b.item_id = d.item_id WHERE d.r <= 11 AND o.g IS DISTINCT FROM sha256(lower(trim(b.text)))),
fused AS (SELECT item_id, domain, doc_id, list_sum(list(1.0::DOUBLE / (60 + rank) ORDER BY method, rank)) AS s, count(*) AS hits, string_agg(method || ':' || rank, ',' ORDER BY method, rank) AS hit_list FROM kept WHERE rank <= 10 GROUP BY ALL)
SELECT item_id, domain, doc_id, position, round(s, 9) AS rrf_score, hits, hit_list FROM (SELECT *, row_number() OVER (PARTITION BY item_id, domain ORDER BY s DESC, doc_id) AS position FROM fused) WHERE position <= 12""",
    "tokenize_counts": f"SELECT doc_id, len({DUCK_TOKENS}) AS n_tokens FROM documents",
    "doc_freq": f"SELECT lang, term, count(*) AS df FROM (SELECT lang, unnest(list_distinct({DUCK_TOKENS})) AS term FROM documents) GROUP BY ALL",
    "avgdl_by_lang": f"SELECT lang, count(*) AS n_docs, greatest(round(avg(len({DUCK_TOKENS})::DOUBLE), 9), 1.0) AS avgdl FROM documents GROUP BY lang",
    "token_windows": f"""SELECT doc_id, (w * 96)::BIGINT AS start, len(ts[w * 96 + 1:w * 96 + 128])::BIGINT AS n, sha256(array_to_string(ts[w * 96 + 1:w * 96 + 128], ',')) AS window_key
FROM (SELECT doc_id, ts, unnest(range(0, CASE WHEN len(ts) <= 128 THEN 0 ELSE (len(ts) - 128 + 95) // 96 END + 1)) AS w FROM (SELECT doc_id, {DUCK_TOKENS} AS ts FROM documents) WHERE len(ts) > 0)""",
    "length_p95": "SELECT lang, count(*) AS n, round(avg(n_chars), 9) AS mean_chars, round(quantile_cont(n_chars::DOUBLE, 0.5), 9) AS median_chars, round(quantile_cont(n_chars::DOUBLE, 0.95), 9) AS p95_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY lang",
    "ecdf": "SELECT event_type, event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS share FROM events WHERE value IS NOT NULL",
    "ref_eval_split": "SELECT source, doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'reference' ELSE 'evaluation' END AS pool FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', 'ref', source, doc_id::VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)",
    "alternation": "SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', '42', source, doc_id::VARCHAR)), doc_id) % 2 = 1 THEN 'P' ELSE 'Q' END AS side FROM documents",
    "stratified_audit": "SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(concat_ws('|', '42', coalesce(lang, ''), coalesce(source, ''), doc_id::VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) WHERE rn <= ceil(n * 0.1::DOUBLE)",
    "evidence_contains": "SELECT b.item_id, count(*) AS holders FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id",
    "secrets_redacted": r"""SELECT doc_id, sha256(regexp_replace(text, '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g')) AS redacted_key,
  sha256(regexp_replace(replace('risk-free sk-short ' || text || ' sk-' || substr(sha256(doc_id::VARCHAR), 1, 20) || '.', 'risk-free', '[REDACTED]'), '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g')) AS with_key FROM documents""",
    "option_reference_issues": "SELECT conv_id, turn::BIGINT AS turn FROM conversations WHERE role = 'assistant' AND regexp_matches(lower(CASE WHEN turn % 2 = 1 THEN 'As option ' || substr('abcd', (turn % 4 + 1)::INT, 1) || ' says, ' || text ELSE text END), 'option [abcd]([^a-z0-9_]|$)')",
    "cosine_topk": """
WITH q AS (SELECT e.label, e.vec_id AS query_id, e.embedding::DOUBLE[] AS a FROM embeddings e WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
scored AS (SELECT q.label, query_id, vec_id, round(list_cosine_similarity(a, embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings e ON q.label = e.label AND vec_id <> query_id)
SELECT label, query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""",
    "cosine_topk_all": """
WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS a FROM embeddings),
scored AS (SELECT q.label, q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.a, d.a), 9) AS score FROM v q JOIN v d ON q.label = d.label AND d.vec_id <> q.vec_id)
SELECT label, query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10""",
}


def queries() -> dict:
    out = FRAMES | audits.QUERIES
    for name, text in PLANS.items():
        out[name] = lambda spark, folder, t=sql_for("spark", text): run_sql(spark, folder, t)
    return out


def oracle_sql() -> dict[str, str]:
    out = FRAME_SQL | audits.SQL
    for name, text in PLANS.items():
        out[name] = re.sub(r"LEFT ANTI JOIN", "ANTI JOIN", sql_for("duck", text))
    return out
