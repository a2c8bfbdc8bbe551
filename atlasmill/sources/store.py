"""A durable store of embeddings: vectors by content key, corpora published whole, queries.

Layout below the root: config.json; vectors/ (key, value); corpora/<domain>/<version>/ with documents, chunks and
manifest.json; corpora/<domain>/current, which names the published version and is put in place by a rename; queries/.
A run that stops early leaves vectors that the next run need not encode again, and no half-published corpus.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.functions.text import sample_hash
from atlasmill.operators.sinks import insert_missing

FORMAT_VERSION = 1


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def token_windows(ids: list, size: int, overlap: int) -> list[list]:
    """Windows of at most `size` that overlap; the last one ends with the text. No ids, no windows."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    starts = range(0, max(1, len(ids) - overlap), size - overlap)
    return [ids[s : s + size] for s in starts if s < len(ids)]


def last_token(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last token that the mask lets through, whichever side is padded."""
    if not mask.any(1).all():
        raise ValueError("an empty sequence has no last token")
    last = mask.shape[1] - 1 - (mask[:, ::-1] != 0).argmax(1)
    return hidden[np.arange(len(hidden)), last]


class EmbeddingStore:
    """One model and configuration per root. encoder: a function without arguments that makes an object with
    document_sequences(text), query_sequence(domain, query) and encode_sequences(list of lists of ids)."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        found = self._text("config.json")
        if found is None:
            if readonly or config is None:
                raise ValueError(f"no embedding store at {root}")
            self._put("config.json", json.dumps(config, sort_keys=True))
            found = json.dumps(config)
        self.config = json.loads(found)
        if config is not None and config != self.config:
            raise ValueError("the store was made with other settings; choose another root")
        if self.config.get("format_version") != FORMAT_VERSION:
            raise ValueError("unsupported version of the store")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        if not self._fs().exists(self._path(name)):
            return None
        return "".join(r.value for r in self.spark.read.text(f"{self.root}/{name}").collect())

    def _put(self, name: str, text: str) -> None:
        """A small file, in place at once: written beside and renamed."""
        fs, temp = self._fs(), self._path(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(self._path(name)):
            fs.delete(self._path(name), False)
        if not fs.rename(temp, self._path(name)):
            raise OSError(f"could not put {name} in place")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._fs().exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def vectors(self) -> DataFrame:
        return self._table("vectors", "key string, value array<float>")

    def queries(self) -> DataFrame:
        return self._table("queries", "domain string, query string, vector_key string, id string")

    def _encoded(self, sequences: DataFrame, encoder: Callable, batch_size: int) -> int:
        """sequences: key, ids. Encodes those whose key the store lacks; returns how many there were."""
        if self.readonly:
            raise ValueError("the store is open for reading only")
        dim = self.config["dimension"]
        new = sequences.dropDuplicates(["key"]).join(self.vectors().select("key"), "key", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = encoder()
            for b in batches:
                for at in range(0, b.num_rows, batch_size):
                    part = b.slice(at, batch_size)
                    m = np.asarray(model.encode_sequences(part.column(1).to_pylist()), np.float32)
                    if m.shape != (part.num_rows, dim) or not np.isfinite(m).all():
                        raise ValueError("the encoder gave vectors of wrong size or value")
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    if not ((norm > 0) & np.isfinite(norm)).all():
                        raise ValueError("the encoder gave a vector without length")
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(m / norm), pa.list_(pa.float32()))], names=["key", "value"])

        n = new.count()
        if n:
            insert_missing(new.select("key", "ids").mapInArrow(run, "key string, value array<float>"), f"{self.root}/vectors", "key")
        return n

    @staticmethod
    def sources(rows: DataFrame) -> list[dict]:
        """Per file: path, split, lines and a digest of its lines that is summed up where they lie."""
        line = F.xxhash64("source_line", "value").cast("decimal(38,0)")
        per = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"), F.sum(line).cast("string").alias("sum"))
        split = F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.[^.]*$", "")
        return [r.asDict() for r in per.select("source_file", split.alias("split"), "lines", F.sha2(F.concat_ws(":", F.col("lines").cast("string"), "sum"), 256).alias("digest")).orderBy("source_file").collect()]

    def build_corpus(self, domain: str, rows: DataFrame, encoder: Callable, batch_size: int = 8, replace: bool = False) -> dict:
        """rows of sources.jsonl.read_rows with prompt and completion; the first of equal samples, by file and line, stays."""
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        sources = self.sources(rows)
        found = self.manifest(domain)
        if found:
            if found["sources"] == sources:
                return {"domain": domain, "status": "cached", **found}
            if not replace:
                raise ValueError(f"{domain}: other sources than those of the published corpus")
        kept = rows.withColumn("sample_id", sample_hash("prompt", "completion"))
        first = Window.partitionBy("sample_id").orderBy("source_file", "source_line")
        kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1")
        version = f"corpora/{domain}/{uuid.uuid4().hex}"
        documents = kept.select(F.concat(F.lit(f"{domain}:"), "sample_id").alias("candidate_id"), "source_file", "source_line", "prompt", "completion")
        documents.write.parquet(f"{self.root}/{version}/documents")
        documents = self.spark.read.parquet(f"{self.root}/{version}/documents")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = encoder()
            for b in batches:
                out = [(i, at, digest(s), s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for at, s in enumerate(model.document_sequences(t))]
                ids, at, keys, seq = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(seq, pa.list_(pa.int64()))], names=["candidate_id", "chunk", "key", "ids"])

        text = F.concat_ws("\n", "prompt", "completion")
        documents.select("candidate_id", text).mapInArrow(cut, "candidate_id string, chunk int, key string, ids array<long>").write.parquet(f"{self.root}/{version}/chunks")
        chunks = self.spark.read.parquet(f"{self.root}/{version}/chunks")
        new = self._encoded(chunks.select("key", "ids"), encoder, batch_size)
        if self.sources(rows) != sources:
            raise ValueError("the corpus changed while it was read; run again")
        manifest = {"sources": sources, "samples": documents.count(), "chunks": chunks.count(), "config_hash": digest(self.config)}
        self._put(f"{version}/manifest.json", json.dumps(manifest))
        self._put(f"corpora/{domain}/current", version)
        return {"domain": domain, "status": "built", "new_vectors": new, **manifest}

    def manifest(self, domain: str) -> dict | None:
        version = self._text(f"corpora/{domain}/current")
        return json.loads(self._text(f"{version}/manifest.json")) if version else None

    def corpus(self, domain: str, splits: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks with their vectors) of the published corpus, after a check that both are whole."""
        version, manifest = self._text(f"corpora/{domain}/current"), self.manifest(domain)
        if manifest is None:
            raise ValueError(f"no published corpus for {domain}")
        if manifest["config_hash"] != digest(self.config):
            raise ValueError("the corpus was made with another configuration")
        held = sorted({s["split"] for s in manifest["sources"]})
        if splits is not None and sorted(set(splits)) != held:
            raise ValueError(f"the corpus holds the splits {held}")
        documents = self.spark.read.parquet(f"{self.root}/{version}/documents")
        chunks = self.spark.read.parquet(f"{self.root}/{version}/chunks").join(self.vectors(), "key").select("candidate_id", "chunk", "value")
        seen = chunks.agg(F.count(F.lit(1)).alias("n"), F.count_if(~self._sound(F.col("value"))).alias("bad")).first()
        if documents.count() != manifest["samples"] or seen.n != manifest["chunks"]:
            raise ValueError("the saved corpus is not whole; build it again")
        if seen.bad:
            raise ValueError("a saved vector is corrupt")
        return documents, chunks

    def _sound(self, v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return F.coalesce((F.size(v) == self.config["dimension"]) & (F.abs(norm - 1) < 1e-4), F.lit(False))

    def build_queries(self, pairs: DataFrame, encoder: Callable, batch_size: int = 8) -> dict:
        """pairs: domain, query; each pair once, only those that the store lacks."""
        if batch_size < 1:
            raise ValueError("batch_size must be positive")
        asked = pairs.select("domain", "query").distinct().withColumn("id", F.sha2(F.concat_ws("\u0000", "domain", "query"), 256))
        new = asked.join(self.queries().select("id"), "id", "left_anti")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = encoder()
            for b in batches:
                seq = [model.query_sequence(d, q) for d, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(map(digest, seq), pa.string()), pa.array(seq, pa.list_(pa.int64()))], names=["domain", "query", "id", "key", "ids"])

        cut_ = new.select("domain", "query", "id").mapInArrow(cut, "domain string, query string, id string, key string, ids array<long>")
        total, fresh = asked.count(), new.count()
        if fresh:
            self._encoded(cut_.select("key", "ids"), encoder, batch_size)
            insert_missing(cut_.select("domain", "query", F.col("key").alias("vector_key"), "id"), f"{self.root}/queries", "id")
        return {"queries": total, "new_queries": fresh}

    def query_vectors(self, pairs: DataFrame) -> DataFrame:
        """pairs with q, the vector of each; a pair without one stops the job."""
        held = self.queries().join(self.vectors(), F.col("vector_key") == F.col("key")).select("domain", "query", F.col("value").alias("q"))
        out = pairs.join(held, ["domain", "query"], "left")
        missing = F.raise_error(F.concat(F.lit("no saved vector for "), "domain", F.lit(": "), "query")).cast("array<float>")
        return out.withColumn("q", F.coalesce("q", missing))
