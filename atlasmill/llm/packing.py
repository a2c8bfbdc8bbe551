"""Best-fit packing of documents into fixed-length token sequences.

Large-item matching: items above a third of the capacity go at most two to a bin, paired greedily
with the largest partner that fits; smaller items then go, longest first, into the tightest gap.
Items of one length are interchangeable, so the plan is made on the histogram of lengths, which
has at most `capacity` rows whatever the corpus, and comes out as runs: "items of length L with
rank a..b go to bins c.. at offset o". Each document finds its bin by its rank among its length.

Nulls: a null text is empty and yields the end id alone. Repeated rows are rows of their own. An
empty table gives an empty result. Very long texts are cut: the first piece takes what is left
over, all others are full. Only the columns named are read; others are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import ranked, stash

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Chunks whose ids a worker remembers before it starts afresh.
REMEMBERED = 500_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to those of the tokenizer file.

    The pre-tokenizer never crosses from a non-space into a space, so a text whose single spaces
    stand between other characters is the concatenation of its " word" chunks, and chunks repeat.
    Other texts, and those that spell a special token, are encoded whole.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json_path = json_path
        self._full = None
        self._known: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        if SPECIAL in text:
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._json_path)
            ids = self._full.encode(text, add_special_tokens=False).ids
        else:
            ids = self._fast.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or SPECIAL in text:
            return self._whole(text)
        known = self._known
        try:
            return self._whole(first) + b"".join(map(known.__getitem__, rest))
        except (KeyError, TypeError):  # a chunk not met before, or one next to other white space
            pass
        if len(known) > REMEMBERED:
            known.clear()
        encode = self._fast.encode_ordinary
        for c in rest:
            if c not in known:
                known[c] = np.asarray(encode(" " + c), "<u4").tobytes() if c and not c[0].isspace() and not c[-1].isspace() else None
        ids = [known[c] for c in rest]
        return self._whole(text) if None in ids else self._whole(first) + b"".join(ids)


def pieces(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = Encoder(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"))
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            keys, nth, start, length, crc = [], [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(t.as_py() or "") + end
                n = len(ids) // 4
                at, i = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    keys.append(k)
                    nth.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, i = at + size, i + 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nth, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, items, first bin, offset) that place counts[length] items of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used_ranks = np.zeros(capacity + 1, np.int64)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_gaps = np.zeros(capacity + 1, bool)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def place(length: int, bin0: int, n: int, offset: int) -> None:
        runs.append((length, int(used_ranks[length]), n, bin0, offset))
        used_ranks[length] += n
        left[length] -= n

    def put_back(gap: int, bin0: int, n: int) -> None:
        if gap and n:
            gaps[gap].append((bin0, n))
            open_gaps[gap] = True

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            partners = np.flatnonzero(left[third + 1 : capacity - a + 1])
            b = int(partners[-1]) + third + 1 if len(partners) else 0
            if b == a:
                n, spare = int(left[a]) // 2, 0
                if n == 0:  # a single one is left: look below it
                    b = int(partners[-2]) + third + 1 if len(partners) > 1 else 0
            if b == 0:
                n = int(left[a])
            elif b != a:
                n = int(min(left[a], left[b]))
            place(a, bins, n, 0)
            if b:
                place(b, bins, n, a)
            put_back(capacity - a - b, bins, n)
            bins += n
    for s in range(third, 0, -1):
        while left[s]:
            fitting = open_gaps[s:]
            tight = int(fitting.argmax())
            if fitting[tight]:
                gap = s + tight
                bin0, n = gaps[gap].pop()
                open_gaps[gap] = bool(gaps[gap])
                m = int(min(n, left[s]))
                place(s, bin0, m, capacity - gap)
                put_back(gap - s, bin0, m)
                put_back(gap, bin0 + m, n - m)
            else:
                per = capacity // s
                n = int(left[s]) // per or 1
                fill = min(per, int(left[s]))
                for i in range(fill):
                    place(s, bins, n, i * s)
                put_back(capacity - fill * s, bins, n)
                bins += n
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, capacity, **options), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(counts, capacity))  # bounded by the capacity alone
    placed = ranked(cut, "length", [F.col("length").asc(), F.col("doc_id").asc_nulls_first(), F.col("piece").asc()], "ranks")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        starts = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            row = table[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*names, "sequence_id", "offset"])

    return placed.select(*names, "_rank").mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
