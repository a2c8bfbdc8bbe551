"""N-gram Jaccard join with parity sketches.

A set of word n-grams is sketched by dealing its members into groups and XOR-ing the hashes of each
group. Groups that differ between two sketches number at most the symmetric difference of the sets.
Sets of similarity t or more differ in at most D = (1 - t) / (1 + t) * (|A| + |B|) members, so of any
D + 1 groups one is equal (pigeonhole). Sizes fall into bands that overlap by the factor 1 / t, every
linkable pair shares one; in a band each set publishes its first D + 1 groups and some to spare.

Equal sets are one node from the start. Buckets of equal groups with few members give all their
pairs, and a pair is verified only if enough of its groups agree for the distance bound. A set with more
large buckets than it can spare is crowded: it might link through large buckets alone, and only with
another crowded set. These are joined among themselves by their members, rarest first, with prefix, size and
position filters: of a crowd of near copies only sets with few members of their own still meet. There each is
verified against the one with the fewest, and only who is then not of a bucket's main component meets the
others in it. So no link between components is lost, and neither a hot passage nor a huge group of near
copies makes all its pairs.

Members are 64-bit hashes of n-grams of 64-bit word hashes. Rows of one id are one document. A null
text or one without words has the empty set and no links; a null id has no component. Fewer words
than n make one n-gram. Very long texts are read whole; an empty table gives an empty result;
columns other than id and text are ignored by classes and kept by deduplicated, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from atlasmill.llm.common import let_go, stash, unstash
from atlasmill.llm.components import components

#: A bucket up to this size gives all its pairs.
SMALL = 8
#: The ratio of neighbouring classes of sizes.
SLOT = 1.04
#: So many ids of rows that do not stay are sent to all tasks at most; with more, the rows are joined with them.
IDS_SENT = 2_000_000
REMEMBERED = 500_000
TAG_BITS = 6
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The set of hashed word n-grams of a text, sorted."""

    def __init__(self, words: int):
        import xxhash

        self.words, self._hash, self._known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white spaces
        if not words:
            return np.zeros(0, np.uint64)
        known = self._known
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self._hash(w)
            h = [known[w] for w in words]
        h = np.array(h, np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * M1 + h[i : len(h) - n + 1 + i])
        return np.unique(out)


class Sketcher:
    """Which groups a set publishes, by band."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]
        while len(self.starts) < 1 << TAG_BITS:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 8 // 5))
        self.groups = [self._published(self._top(j), j)[0] for j in range(len(self.starts) - 1)]

    def _top(self, j: int) -> int:
        """The largest set of band j: the partner of the largest set at home there."""
        return (self.starts[j + 1] - 1) * 100 // self.percent

    def _published(self, n: int, j: int) -> tuple[int, int]:
        """How many groups a set of size n publishes in band j, and how many of them it can spare."""
        other = min(n * 100 // self.percent, self._top(j))  # the largest partner, at home or not
        differ = (100 - self.percent) * (n + other) // (100 + self.percent)
        spare = 1 + (differ + 1) // 6
        return differ + 1 + spare, spare

    def __call__(self, members: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
        """(band, spare, groups, keys) for the one or two bands of the set; groups without a member have no key."""
        n = len(members)
        home = bisect_right(self.starts, n) - 1
        out = []
        for j in (home, home - 1):
            if j < 0 or j >= len(self.groups) or n > self._top(j):
                continue
            if (100 - self.percent) * (n + min(n * 100 // self.percent, self._top(j))) < 100 + self.percent:
                continue  # nothing but an equal set is near enough
            want, spare = self._published(n, j)
            want = min(want, self.groups[j])
            spare = self._published(-(-n * self.percent // 100), j)[1]  # as the smallest partner has it
            group = ((mix(members ^ M1) >> np.uint64(32)) * np.uint64(self.groups[j])) >> np.uint64(32)
            own = group < want
            group, own = group[own].astype(np.int64), members[own]
            by = np.argsort(group, kind="stable")
            sums = np.zeros(want, np.uint64)
            at, first = np.unique(group[by], return_index=True)
            if len(at):
                sums = np.bitwise_xor.reduceat(mix(own[by] * M1), first)
            keys = mix(sums[: len(at)] + (at + 1).astype(np.uint64) * M2 + np.uint64((j + 1) * int(M3) & (1 << 64) - 1))
            out.append((j, spare, want, (keys & ~np.uint64((1 << TAG_BITS) - 1)) | np.uint64(j)))
        return out


def _sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row and band: doc_id, n, fp (of the set), band, spare, g (groups), empty (those without a key), keys; one row without keys where there is no band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, sketch = Shingler(words), Sketcher(percent)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py())
                fp = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                for i, (j, spare, g, keys) in enumerate(sketch(s) or [(None, 0, 0, np.zeros(0, np.uint64))]):
                    rows.append((k, len(s), fp, i == 0, j, spare, g, g - len(keys), keys.view(np.int64)))
            ids, n, fp, first, band, spare, g, empty, keys = zip(*rows, strict=True) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(first, pa.bool_()), pa.array(band, pa.int32()), pa.array(spare, pa.int32()), pa.array(g, pa.int32()), pa.array(empty, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "fp", "first", "band", "spare", "g", "empty", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, first boolean, band int, spare int, g int, empty int, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that link. texts: (doc_id, packed)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingles, unpack = Shingler(words), zstandard.ZstdDecompressor()
        sets: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(packed: bytes) -> np.ndarray:
            if packed in sets:
                sets.move_to_end(packed)
            else:
                sets[packed] = shingles(unpack.decompress(packed))
                if len(sets) > 512:
                    sets.popitem(last=False)
            return sets[packed]

        for b in batches:
            keep = []
            for x, y in zip(b.column("left"), b.column("right"), strict=True):
                s, t = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(s, t, assume_unique=True)) if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress(t.as_py() or b"") for t in b.column(1)], pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(run, "doc_id long, packed binary")


def _band() -> Column:
    return F.col("key").bitwiseAND(F.lit((1 << TAG_BITS) - 1)).cast("int").alias("band")


def _texts_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The packed texts of the documents in pairs."""
    asked = pairs.select("a").union(pairs.select("b")).toDF("doc_id").distinct()
    return stash(_packed(rows).join(asked, "doc_id", "left_semi"), "texts")


def _bucketed(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify from small buckets, and the crowded sets (doc_id): those with more large buckets than
    they can spare. Pairs of two crowded sets are left to _crowded, so no row is made for them here."""
    facts = own.select("doc_id", "band", "n", "g", "spare", "empty")
    keys = own.select("doc_id", F.explode("keys").alias("key"))
    shared = stash(keys.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("cnt > 1"), "shared")
    let_go(own.sparkSession)
    more = stash(keys.join(shared.where("cnt > 2").select("key", "cnt"), "key"), "buckets")
    let_go(own.sparkSession)
    n_hot = more.where(F.col("cnt") > SMALL).groupBy("doc_id", _band()).agg(F.count(F.lit(1)).alias("hot"))
    hot = F.coalesce("hot", F.lit(0)) + F.col("empty")
    level = stash(facts.join(n_hot, ["doc_id", "band"], "left").withColumn("hot", hot), "level")
    crowded = stash(level.where("hot > spare").select("doc_id").distinct(), "crowded")
    small = more.where(F.col("cnt") <= SMALL).join(crowded.withColumn("c", F.lit(True)), "doc_id", "left")
    lists = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.coalesce("c", F.lit(False)).alias("c")))).alias("ids")).where("exists(ids, x -> not x.c)")
    two = F.transform("ids", lambda x, i: F.transform(F.filter(F.slice("ids", i + 2, F.size("ids")), lambda y: ~(x.c & y.c)), lambda y: F.struct(x.doc_id.alias("a"), y.doc_id.alias("b"))))
    pairs = lists.select(_band(), F.explode(F.flatten(two)).alias("p")).select("p.a", "p.b", "band")
    counted = shared.where("cnt = 2 and a < b").select("a", "b", _band()).union(pairs).groupBy("a", "b", "band").agg(F.count(F.lit(1)).alias("shared"))
    known = level.join(crowded.withColumn("c", F.lit(True)), "doc_id", "left").withColumn("c", F.coalesce("c", F.lit(False)))
    one = known.select(F.col("doc_id").alias("a"), "band", F.col("n").alias("na"), F.col("g").alias("ga"), F.col("hot").alias("ha"), F.col("c").alias("ca"))
    other = known.select(F.col("doc_id").alias("b"), "band", F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("hot").alias("hb"), F.col("c").alias("cb"))
    # Of the groups that both publish no more differ than sets of these sizes may. Groups in large buckets
    # were not counted; both may share them all.
    differ = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    enough = F.col("shared") + F.least("ha", "hb") >= F.least("ga", "gb") - differ
    near = counted.join(one, ["a", "band"]).join(other, ["b", "band"], "inner").where(fits & enough & ~(F.col("ca") & F.col("cb")))
    out = stash(near.select("a", "b").distinct(), "pairs")
    for table in (shared, more, level):
        unstash(table)
    return out, crowded


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection of linked sets of sizes n and m."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent)).cast("long")


def _slot(n: Column) -> Column:
    """Narrow classes of sizes."""
    return F.floor(F.log(n.cast("double")) / math.log(SLOT)).cast("int")


def _prefixes(rows: DataFrame, crowded: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, rare, m, cnt, at: of each crowded set the members, rarest first, among which linked sets must meet.

    Members that no other crowded set holds come first and are not listed; at is the place from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingles, unpack = Shingler(words), zstandard.ZstdDecompressor()
        for b in batches:
            sets = [shingles(unpack.decompress(t.as_py())).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "members"])

    texts = _packed(rows).join(crowded, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stash(texts.mapInArrow(run, "doc_id long, members array<long>"), "crowded-sets")
    each = sets.select("doc_id", F.size("members").alias("n"), F.explode("members").alias("m"))
    often = stash(each.groupBy("m").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1"), "often")
    let_go(rows.sparkSession)
    listed = each.join(often, "m").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("cnt", "m"))).alias("l"))
    first = F.col("n") - F.size("l")
    last = F.col("n") - _needed(F.col("n"), F.ceil(F.col("n") * percent / 100.0), percent)
    # No place after `last` can be the first that two linked sets share.
    kept = listed.withColumn("rare", first).withColumn("l", F.slice("l", 1, F.greatest(F.lit(0), last - first + 1).cast("int")))
    out = stash(kept.select("doc_id", "n", "rare", F.posexplode("l").alias("i", "x")).select("doc_id", "n", "rare", "x.m", "x.cnt", (F.col("rare") + F.col("i")).alias("at")), "prefixes")
    unstash(sets)
    unstash(often)
    let_go(rows.sparkSession)
    return out


def _may_link(percent: int) -> Column:
    """Whether sets of n1 and n2 members whose first common ones are at at1 and at2 can have enough in common."""
    left = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    return left >= _needed(F.col("n1"), F.col("n2"), percent)


def _crowded(prefixes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of crowded sets to verify at once, and both sides of the buckets that settle by components.

    A member that few sets hold gives its pairs. One that many hold is a bucket for each class of
    sizes: the smaller set of a pair stands in the class of its own size, the larger asks there. How far
    down its list a set must publish shrinks as the sizes draw together, so of a crowd of near copies only
    those stand in a common bucket that have few members of their own. There everyone is verified
    against the member with the fewest of its own.
    """
    few = prefixes.where(F.col("cnt") <= SMALL).groupBy("m").agg(F.sort_array(F.collect_list(F.struct("doc_id", "n", "at"))).alias("l"))
    two = F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.doc_id.alias("a"), y.doc_id.alias("b"), x.n.alias("n1"), y.n.alias("n2"), x["at"].alias("at1"), y["at"].alias("at2"))))
    direct = few.select(F.explode(F.flatten(two)).alias("p")).select("p.*").where(_may_link(percent)).select("a", "b").distinct()
    many = prefixes.where(F.col("cnt") > SMALL)
    n, at = F.col("n"), F.col("at")
    stands = stash(many.where(at <= n - _needed(n, n, percent)).select("m", _slot(n).alias("slot"), F.col("doc_id").alias("b"), n.alias("n2"), at.alias("at2"), "rare"), "standing")
    least = F.ceil(n * percent / 100.0)
    low = F.greatest(least, F.floor(F.pow(F.lit(SLOT), F.col("slot"))) - 1)
    asks = many.withColumn("slot", F.explode(F.sequence(_slot(least), _slot(n)))).where(at <= n - _needed(n, low, percent))
    asks = asks.select("m", "slot", F.col("doc_id").alias("a"), n.alias("n1"), at.alias("at1"))
    leaders = stands.groupBy("m", "slot").agg(F.min(F.struct("rare", F.xxhash64("b"), "b", "n2", "at2")).alias("x")).select("m", "slot", "x.b", "x.n2", "x.at2")
    asks = stash(asks.join(leaders.select("m", "slot"), ["m", "slot"], "left_semi"), "asking")  # a written side lets a skewed bucket be split
    led = asks.join(leaders, ["m", "slot"]).where(F.col("a") != F.col("b")).where(_may_link(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stash(direct.union(led).distinct(), "crowded-pairs"), asks, stands


def _unsettled(asks: DataFrame, stands: DataFrame, roots: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket but no component yet: in each bucket, whoever is outside its main component, with all."""
    at = ["m", "slot"]
    placed = lambda side, who, root: side.join(roots, side[who] == roots.node, "left").withColumn(root, F.coalesce("root", who)).drop("node", "root")
    asks, stands = stash(placed(asks, "a", "ra"), "asking"), stash(placed(stands, "b", "rb"), "standing")
    per = asks.select(*at, F.col("ra").alias("r")).union(stands.select(*at, F.col("rb").alias("r"))).groupBy(*at, "r").agg(F.count(F.lit(1)).alias("k"))
    main = stash(per.groupBy(*at).agg(F.max(F.struct("k", "r"))["r"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select(*at, "main"), "main")
    asks, stands = asks.join(main, at), stands.join(main.withColumnRenamed("main", "_main"), at)
    able = (F.col("a") != F.col("b")) & (F.col("ra") != F.col("rb")) & (F.col("n2") <= F.col("n1")) & _may_link(percent)
    met = asks.where("ra != main").join(stands, at).where(able).select("a", "b")
    met = met.union(asks.where("ra = main").join(stands.where("rb != _main"), at).where(able).select("a", "b"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stash(met.join(pairs, ["a", "b"], "left_anti"), "rest")


def classes(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    every = stash(_sketches(rows, words, percent), "sketches")
    members = stash(every.where("first").select("doc_id", "n", "fp"), "members")
    nodes = stash(members.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # One row per set and band; the id in the join key spreads groups of copies.
    own = stash(every.where("g > 0").join(nodes, (every.fp == nodes.fp) & (every.doc_id == nodes.node), "left_semi").dropDuplicates(["doc_id", "fp", "band"]).select("doc_id", "band", "n", "g", "spare", "empty", "keys"), "own")
    unstash(every)
    let_go(spark)
    pairs, crowded = _bucketed(own, percent)
    unstash(own)
    asks = stands = None
    if not crowded.isEmpty():
        prefixes = _prefixes(rows, crowded, words, percent)
        more, asks, stands = _crowded(prefixes, percent)
        pairs = stash(pairs.union(more), "pairs")
    texts = _texts_of(rows, pairs)
    links = stash(_verified(pairs, texts, words, percent), "links")
    unstash(texts)
    let_go(spark)
    roots = components(links, "a", "b")
    if asks is not None:
        rest = _unsettled(asks, stands, roots, pairs, percent)
        if not rest.isEmpty():
            further = _verified(rest, _texts_of(rows, rest), words, percent)
            roots = components(stash(links.union(further), "links"), "a", "b")
    of_set = stash(nodes.join(roots, nodes.node == roots.node, "left").select("fp", F.coalesce(roots.root, nodes.node).alias("component_id")), "classes")
    own_set = members.join(of_set, "fp", "left")
    return own_set.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One document of each class: the one with the smallest id, once. Rows without an id stay.

    Of several rows with that id the one with the least text (null first) stays, and of equal texts
    the one whose columns have the least hash.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # stand-in names keep clear of the input's
    own_key, own_text = f"c{names.index(key)}", f"c{names.index(text)}"
    found = classes(inner, text=own_text, key=own_key, **options).where("doc_id is not null")
    kept = stash(found.groupBy(F.col("doc_id").alias("kept")).agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("rows")), "kept")
    let_go(docs.sparkSession)
    own = F.col(own_key).cast("long") == F.col("kept")
    other = kept.where("rows != 1").select("kept")
    if other.count() <= IDS_SENT:  # these ids come to the rows, whose texts stay where they are
        once = inner.where(F.col(own_key).isNotNull()).join(F.broadcast(other), own, "left_anti")
    else:
        once = inner.join(kept.where("rows = 1"), own, "left_semi")
    if not kept.where("rows > 1").isEmpty():
        hashed = [f"c{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString()]
        order = Window.partitionBy(F.col(own_key).cast("long")).orderBy(F.col(own_text).asc_nulls_first(), F.xxhash64(*hashed))
        several = inner.join(kept.where("rows > 1"), own, "left_semi")
        once = once.union(several.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place"))
    return once.union(inner.where(F.col(own_key).isNull())).toDF(*names)


def op1_parity_jaccard(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
