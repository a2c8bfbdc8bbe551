"""Quality by nearest-neighbour voting in a latent space.

Each text becomes square roots of relative frequencies: of pairs of character classes, of hashed
words, and a few shares. A truncated decomposition of a bounded labelled sample gives the latent
axes; the sample's latent vectors are broadcast (at most SAMPLE x AXES numbers), and each
document's cosines with all of them are computed in blocks. The nearest vote with their
similarity as weight.

Nulls: a null text is empty; texts without words get the prior. Very long texts are read whole.
Empty tables give empty results; without labels every score is the prior. Repeated rows and equal texts
score alike, to the last digit; of labelled rows equally near the earlier by id votes. Columns other than id and
text are ignored by classify and kept by accepted, also those whose names clash with the added ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import fold
from atlasmill.llm.fitting import labelled_sample, prior

#: The bound of the labelled sample.
SAMPLE = 4096
AXES = 40
NEIGHBOURS = 31
THRESHOLD = 0.3
WORD_BUCKETS = 256
SHARES = 5
ROWS_AT_ONCE = 1024
#: Character classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 full stop, 6 comma, 7 bar, 8 exclamation, 9 other mark, 10 other sign, 11 beyond ASCII.
CLASSES = 12
WIDTH = CLASSES * CLASSES + WORD_BUCKETS + SHARES


def _class_table() -> bytes:
    out = bytearray([10] * 128 + [11] * 128)
    for c in range(ord("a"), ord("z") + 1):
        out[c], out[c - 32] = 0, 1
    for c in b"0123456789":
        out[c] = 2
    for c, k in ((b" \t", 3), (b"\r\n", 4), (b".", 5), (b",", 6), (b"|", 7), (b"!", 8), (b"?;:'\"()-", 9)):
        for x in c:
            out[x] = k
    return bytes(out)


class Features:
    def __init__(self) -> None:
        self._table = _class_table()
        self._buckets: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        found = self._buckets.get(word)
        if found is None:
            if len(self._buckets) > 500_000:
                self._buckets.clear()
            found = self._buckets[word] = zlib.crc32(word) % WORD_BUCKETS
        return found

    def __call__(self, text: bytes) -> np.ndarray:
        out = np.zeros(WIDTH, np.float32)
        words = text.lower().split()
        if not words:
            return out
        kinds = np.frombuffer(text.translate(self._table), np.uint8)
        if len(kinds) > 1:
            pairs = np.bincount(kinds[:-1] * np.uint8(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
            out[: CLASSES * CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
        counts = Counter(words)
        n = len(words)
        buckets = np.fromiter(map(self._bucket, counts), np.int64, len(counts))
        out[CLASSES * CLASSES : CLASSES * CLASSES + WORD_BUCKETS] = 0.5 * np.sqrt(np.bincount(buckets, np.fromiter(counts.values(), np.float64, len(counts)), WORD_BUCKETS) / n)
        top = max(counts.values())
        out[-SHARES:] = (len(counts) / n, top / n if n > 8 else 0, min(1.0, n / 4000), min(1.0, len(text) / n / 20), 1 - len(set(lines := text.split(b"\n"))) / len(lines))
        return out


class Model:
    """Latent axes and the labelled latent vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = prior(y.tolist())
        self.mean = x.mean(0) if len(x) else np.zeros(WIDTH, np.float32)
        centred = (x - self.mean).astype(np.float64)
        values, vectors = np.linalg.eigh(centred.T @ centred) if len(x) else (np.zeros(WIDTH), np.eye(WIDTH))
        self.axes = vectors[:, np.argsort(-values, kind="stable")[:AXES]].astype(np.float64)
        self.points, self.y = self.latent(x) if len(x) else np.zeros((0, AXES)), y.astype(np.float64)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean).astype(np.float64) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """Blocks of one size, the last one filled up, cosines in steps of 1e-9, and ties to the earlier labelled
        row: so a document's score does not depend on what stands beside it."""
        out = np.full(len(x), self.prior)
        k = min(NEIGHBOURS, len(self.y))
        if not k:
            return out
        earlier = np.arange(len(self.y)) * 1e-14
        for at in range(0, len(x), block):
            own = np.zeros((block, WIDTH), x.dtype)
            n = len(x[at : at + block])
            own[:n] = x[at : at + block]
            cos = np.round(self.latent(own) @ self.points.T, 9) - earlier
            near = np.sort(np.argpartition(cos, len(self.y) - k, axis=1)[:, len(self.y) - k :], axis=1)
            weight = np.maximum(np.round(np.take_along_axis(cos, near, 1), 9), 0) ** 4 + 1e-6
            votes = (weight * self.y[near]).sum(1) + self.prior * 0.5
            out[at : at + n] = np.where(own.any(1), votes / (weight.sum(1) + 0.5), self.prior)[:n]
        return out


def _rows(batch: pa.RecordBatch, features: Features) -> np.ndarray:
    texts = batch.column(1)
    return np.stack([features(t.as_py() or b"") for t in texts]) if len(texts) else np.zeros((0, WIDTH), np.float32)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Only the sample's feature rows, at most `most`, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _rows(b, features)], pa.binary()), b.column(2)], names=["_id", "x", "y"])

    sample = labelled_sample(docs, labels, "quality", most).select("_id", F.col("text").cast("binary"), "y")
    got = sample.mapInArrow(run, f"_id {sample.schema['_id'].dataType.simpleString()}, x binary, y int").collect()
    got.sort(key=lambda r: (r._id, r.x))
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(-1, WIDTH)
    return Model(x, np.array([r.y for r in got], np.int64))


def _scored(docs: DataFrame, model: Model, text: str, head: list[str]) -> DataFrame:
    """The columns head as c0, c1, ... and score: stand-in names keep clear of the input's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(head)], F.col(text).cast("binary").alias("text"))
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in source.schema[:-1]], "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            texts = b.column(len(head))
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = texts.slice(at, ROWS_AT_ONCE)
                x = np.stack([features(t.as_py() or b"") for t in part])
                yield pa.RecordBatch.from_arrays([*[c.slice(at, ROWS_AT_ONCE) for c in b.columns[: len(head)]], pa.array(shared.value.score(x))], names=[*b.schema.names[: len(head)], "score"])

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score per row."""
    return _scored(docs, model, text, [key]).withColumnRenamed("c0", key)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns as they came, whatever their names."""
    out = _scored(docs, fit(docs, labels), text, docs.columns)
    return out.where(F.col("score") >= threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op4_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
