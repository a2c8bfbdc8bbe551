"""Suffix-array deduplication of byte strings that an earlier document holds too.

Each 50-byte window is filed under an anchor, the least hash of its 16-byte grams, so equal windows
share an anchor. Only anchors that two documents hold go on: the stretch of text whose windows an
anchor answers for is sent to the anchor's bucket, where the windows are sorted as suffixes of the
stretches, apart by where they hold the anchor. The sort takes the first 50 bytes of each suffix, eight at a time, and sorts again only
runs that are still apart; suffixes of one run are equal windows, byte for byte. A window whose least document is smaller than its
own is removed.

Equal texts are collapsed first: of copies the one with the smallest id stands for all. A null text
is empty; rows with a null id neither remove nor lose anything; rows of one id never remove from
each other. Very long texts are read whole; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import let_go, shuffle_parts, stash, unstash

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
HALF = SPAN // 2
ROWS_AT_ONCE = 50_000
TEXTS_AT_ONCE = 500
NAMES = ["key", "doc_id", "t", "first", "place", "size", "stretch"]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
POWERS = np.array([pow(int(BASE), i, 2**64) for i in range(LENGTH + 1)], np.uint64)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _sliding(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """The best of each `span` neighbours."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x, width = best(x[:-step], x[step:]), width + step
    return x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, place in the first window) of each run of windows with one anchor."""
    n = len(text)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    eight = np.empty(n - 7, np.uint64)
    for o in range(8):
        part = np.frombuffer(text, "<u8", (n - o) // 8, o)
        eight[o::8] = part
    h = eight[:-8] * M1 + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * M2
    h = (h ^ (h >> np.uint64(32))) * M2
    h ^= h >> np.uint64(29)
    least = _sliding(h, SPAN, np.minimum)
    # A gram is the anchor of some window if the largest of the minima of the windows that hold it is its own hash.
    pad = np.zeros(SPAN - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum) == h)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    if len(first) == len(place):  # one gram a run
        return h[place].view(np.int64), first, np.concatenate([first[1:] - 1, [len(least) - 1]]), place - first
    # The least hash stands more than once in a window: the leftmost counts.
    at, width = np.arange(len(h)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        a, b = at[:-step], at[step:]
        at, width = np.where(h[a] <= h[b], a, b), width + step
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return h[at[first]].view(np.int64), first, last, at[first] - first


class Suffixes:
    """Sorted order of suffixes within buckets of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data, self.n = data, n
        # Of the first i bytes: sum of byte j times BASE to the power i - 1 - j, modulo 2 ** 64. BASE is odd, so it has an inverse.
        falling = np.cumprod(np.full(n + 1, INVERSE, np.uint64))
        rising = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
        self.hashed = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * falling[:n], out=self.hashed[1:])
        self.hashed *= rising

    def digest(self, i: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """The polynomial hash of `length` bytes from i, wherever they stand."""
        return self.hashed[i + length] - self.hashed[i] * POWERS[length]

    def order(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order of the entries, as runs() sorts them."""
        return self.runs(start, bucket)[0]

    def runs(self, start: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorts the suffixes of all buckets at once by their first LENGTH bytes, eight at a time. bucket is sorted.

        Returns the order of the entries, and the run of each in this order: equal beginnings of one bucket are a run.
        Equal ones keep their order. Only runs that the next eight bytes tell apart are sorted again.
        """
        n = len(start)
        order = np.arange(n)
        if n == 0:
            return order, order
        words = np.empty(self.n, np.uint64)
        padded = self.data.tobytes() + bytes(8)
        for o in range(min(8, self.n)):
            at = words[o::8]
            at[:] = np.frombuffer(padded, ">u8", len(at), o)
        new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        run = np.cumsum(new) - 1
        for at in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
            word = words[start[order] + at]
            apart = np.flatnonzero(~new[1:] & (word[1:] != word[:-1]))
            if not len(apart):
                continue
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[apart]] = True
            live = np.flatnonzero(mixed[run])
            by = live[np.lexsort((word[live], run[live]))]
            order[live], word[live] = order[by], word[by]
            new[1:] |= word[1:] != word[:-1]
            run = np.cumsum(new) - 1
        return order, run


def least_documents(suffixes: Suffixes, heads: np.ndarray, sizes: np.ndarray, docs: np.ndarray, bucket: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least document that holds each window of each stretch within its bucket, and the windows before each stretch.

    Equal windows hold their anchor at the same place, so each place in the window is a bucket of its own.
    """
    windows = sizes - LENGTH + 1
    ends = np.cumsum(windows)
    window = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
    start = np.repeat(heads, windows) + window
    own, filed = np.repeat(docs, windows), np.repeat(bucket * LENGTH + places, windows) - window
    by = np.argsort(filed, kind="stable")
    order, run = suffixes.runs(start[by], filed[by])
    order = by[order]
    least = np.minimum.reduceat(own[order], np.flatnonzero(np.diff(run, prepend=-1)))[run]
    out = np.empty(len(order), np.int64)
    out[order] = least
    return out, ends - windows


def _meet(suffixes: Suffixes, heads: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a stretch can share a window with another one of its bucket.

    Every window of a stretch holds, around its anchor, the anchor with what follows or with what
    precedes; different stretches can share a window only if they share such a core.
    """
    out = np.zeros(len(heads), bool)
    size = HALF + GRAM
    after, before = np.flatnonzero(sizes >= places + size), np.flatnonzero(places >= HALF)
    for at, begin in ((after, heads + places), (before, heads + places - HALF)):
        value = suffixes.digest(begin[at], size) * M1 ^ bucket[at].astype(np.uint64) * M2
        _, back, count = np.unique(value, return_inverse=True, return_counts=True)
        out[at[count[back] > 1]] = True
    return out


def _firsts(keys: np.ndarray, docs: np.ndarray, stretch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of key, stretch and document; the group of each in this order; the first row of each group."""
    codes = stretch.dictionary_encode().indices.to_numpy()
    order = np.lexsort((docs, codes, keys))
    k, c = keys[order], codes[order]
    head = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
    return order, np.cumsum(head) - 1, order[head]


def covered(keys: np.ndarray, docs: np.ndarray, first: np.ndarray, places: np.ndarray, stretch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of removed stretches; whole buckets are given.

    Of equal stretches the least document's stands for all: the others go whole.
    """
    order, group, firsts = _firsts(keys, docs, stretch)
    sizes = pc.binary_length(stretch).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = order[docs[order] > docs[firsts][group]]
    out = [(whole, first[whole], first[whole] + sizes[whole])]
    key = keys[firsts]
    several = np.zeros(len(firsts), bool)
    alike = key[1:] == key[:-1]
    several[1:] |= alike
    several[:-1] |= alike
    at = np.flatnonzero(several)
    if len(at):
        rows = firsts[at]
        size = sizes[rows]
        suffixes = Suffixes(np.frombuffer(b"".join(stretch.take(pa.array(rows)).to_pylist()), np.uint8))
        heads = np.cumsum(size) - size
        bucket = np.cumsum(np.concatenate([[True], key[at][1:] != key[at][:-1]])).astype(np.int64)
        meet = np.flatnonzero(_meet(suffixes, heads, size, bucket, places[rows]))
        if len(meet):
            rows = rows[meet]
            least, start = least_documents(suffixes, heads[meet], size[meet], docs[rows], bucket[meet], places[rows])
            windows = size[meet] - LENGTH + 1
            of = np.repeat(np.arange(len(rows)), windows)
            hit = np.flatnonzero(least < docs[rows][of])
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit][1:] != of[hit][:-1])])[: len(hit)]
            last = np.concatenate([new[1:], [True]])[: len(hit)]
            u, a, b = of[hit[new]], hit[new] - start[of[hit[new]]], hit[last] - start[of[hit[new]]] + LENGTH
            out.append((rows[u], first[rows[u]] + a, first[rows[u]] + b))
            # The same document may hold the same stretch again.
            again = np.setdiff1d(order[docs[order] == docs[firsts][group]], firsts)
            if len(again):
                of_row = np.empty(len(keys), np.int64)
                of_row[order] = group
                runs: dict[int, list[int]] = {}
                for i, g in enumerate(of_row[rows[u]]):
                    runs.setdefault(int(g), []).append(i)
                more = [(r, first[r] + a[i], first[r] + b[i]) for r in again for i in runs.get(int(of_row[r]), ())]
                if more:
                    out.append(tuple(np.array(x) for x in zip(*more, strict=True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _thinned(held: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Splits the rows of buckets into those that must stay for comparison and those whose stretch goes whole."""
    docs, stretch = held.column("doc_id").to_numpy(), held.column("stretch").combine_chunks()
    order, group, firsts = _firsts(held.column("key").to_numpy(), docs, stretch)
    gone = np.zeros(len(docs), bool)
    gone[order] = docs[order] > docs[firsts][group]
    return held.filter(pa.array(~gone)), held.filter(pa.array(gone))


def _spans(rows: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), rows.column("t").combine_chunks(), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "t", "a", "b"])


def _whole(rows: pa.Table) -> pa.RecordBatch:
    a = rows.column("first").to_numpy()
    return _spans(rows, a, a + rows.column("size").to_numpy())


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    members = stash(rows.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "members")
    firsts = stash(members.where(f"doc_id is not null and n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "firsts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress(t.as_py()) for t in b.column(2)], pa.binary())], names=["doc_id", "sha", "packed"])

    packed = rows.select("doc_id", "sha", "text").mapInArrow(pack, "doc_id long, sha string, packed binary")
    texts = stash(packed.join(firsts, ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"]).select("doc_id", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("t"), "sha", "packed"), "texts")
    let_go(spark)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            keys = [np.unique(anchors(d.decompress(x.as_py()))[0]) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "keys"])

    anchored = stash(texts.select("doc_id", "t", "packed").mapInArrow(keys_of, "doc_id long, t long, keys array<long>"), "anchored")
    filed = anchored.select("doc_id", "t", F.explode("keys").alias("key"))
    shared = stash(filed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "shared-anchors")
    let_go(spark)
    lists = stash(filed.join(shared, "key").groupBy("doc_id", "t").agg(F.collect_list("key").alias("keys")), "anchors")
    unstash(anchored)
    let_go(spark)
    # Written once, so the shuffles of this join are gone before the stretches are dealt.
    held_texts = stash(texts.join(lists, ["doc_id", "t"]).select("doc_id", "t", "sha", "packed", "keys"), "held-texts")
    for table in (texts, lists, shared):
        unstash(table)
    let_go(spark)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, TEXTS_AT_ONCE):
                out: list[list] = [[] for _ in range(6)]
                texts: list[bytes] = []
                part = b.slice(at, TEXTS_AT_ONCE)
                for k, t, packed, keys in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    text = d.decompress(packed.as_py())
                    own, first, last, place = anchors(text)
                    hit = np.flatnonzero(np.isin(own, keys.values.to_numpy()))
                    end = last[hit] + LENGTH
                    for x, v in zip(out, (own[hit], np.full(len(hit), k), np.full(len(hit), t), first[hit], place[hit], end - first[hit]), strict=True):
                        x.append(v)
                    texts += [text[i:j] for i, j in zip(first[hit].tolist(), end.tolist(), strict=True)]
                columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
                table = pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip([*columns, texts], kinds, strict=True)], names=NAMES)
                # A stretch that an earlier document of these holds too goes whole: it need not travel.
                stay, gone = _thinned(table)
                yield from stay.to_batches()
                bare = pa.array([None] * len(gone), pa.binary())
                yield from gone.set_column(0, "key", gone.column("doc_id")).set_column(6, "stretch", bare).to_batches()

    sent = held_texts.select("doc_id", "t", "packed", "keys").mapInArrow(stretches, "key long, doc_id long, t long, first long, place long, size long, stretch binary")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, most = 0, ROWS_AT_ONCE

        def flush(table: pa.Table) -> pa.RecordBatch:
            column = lambda name: table.column(name).to_numpy()
            row, a, b = covered(column("key"), column("doc_id"), column("first"), column("place"), table.column("stretch").combine_chunks())
            return _spans(table.take(pa.array(row)), a, b)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            settled = table.filter(pc.is_null(table.column("stretch")))
            if len(settled):
                yield _whole(settled)
                table = table.filter(pc.is_valid(table.column("stretch")))
            held.append(table)
            rows += len(table)
            if rows < most:
                continue
            table = pa.concat_tables(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield flush(table.slice(0, cut))
            # Rows of a bucket come by document, so only the first of equal stretches need be kept.
            table, gone = _thinned(table.slice(cut))
            if len(gone):
                yield _whole(gone)
            held, rows, most = [table], len(table), max(ROWS_AT_ONCE, 2 * len(table))
        if held and sum(map(len, held)):
            yield flush(pa.concat_tables(held))

    spans = sent.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "doc_id").mapInArrow(settle, "doc_id long, t long, a long, b long")
    spans = stash(spans.groupBy("doc_id", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    let_go(spark)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            removed, n, kept = [], [], []
            for packed, s in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                text = d.decompress(packed.as_py())
                runs = _merge([(x["a"], x["b"]) for x in s])
                removed.append(sum(y - x for x, y in runs))
                n.append(len(runs))
                left = hashlib.sha256()
                at = 0
                for x, y in [*runs, (len(text), len(text))]:
                    left.update(text[at:x])
                    at = y
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "sha", "n_removed", "n_spans", "kept"])

    cut = held_texts.drop("keys").join(spans, ["doc_id", "t"]).select("doc_id", "sha", "packed", "spans").mapInArrow(finish, "doc_id long, sha string, n_removed long, n_spans long, kept string")
    result = stash(firsts.join(cut, ["doc_id", "sha"], "left").select("sha", F.col("doc_id").alias("_first"), "n_removed", "n_spans", "kept"), "results")
    out = members.join(result, "sha", "left")
    copy = F.col("_first").isNotNull() & (F.col("doc_id") != F.col("_first"))
    mine = F.col("_first").isNotNull() & (F.col("doc_id") == F.col("_first"))
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).when(mine, F.coalesce("n_spans", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(mine, F.coalesce("kept", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
