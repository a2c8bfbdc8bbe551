"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, futurity, learned stem, clause end,
other. Five small transducers rewrite the symbols one after another: negation turns what it reaches into
a denial; a threat needs futurity before it and a target behind it; a target near an insult aims
it; reported speech marks its clause; the last one reads the clause and, at its end, puts out its kind. Their
composition is one automaton, which reads a document once. Each kind of clause has a weight, fitted on a
bounded labelled sample; a document's score is a logistic function of the weights of its clauses. Insults that
the word lists lack are learned from that sample as word beginnings.

Nulls: a null or empty text has no clauses and gets the lowest score. Very long texts are read whole. Empty tables
give empty results; without labels the default weights hold. Repeated rows and equal texts score
alike; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import fold, stash, unstash
from atlasmill.llm.fitting import labelled_sample
from atlasmill.llm.transducers import Transducer, compose

#: The bound of the labelled sample.
SAMPLE = 8192
THRESHOLD = 0.5

# Word lists of the grammar.
INSULTS = "airhead bastard bitch bonehead bozo bum clown coward creep cretin crook degenerate dickhead dimwit dipshit disgusting douchebag dumb dumbass dunce fool freak garbage halfwit idiot idiotic imbecile jackass jerk lowlife loser lunatic maggot moron moronic nitwit numbskull parasite pathetic pig prick repulsive retard scum scumbag shithead simpleton slimeball stupid trash twat vermin weirdo whore wimp worthless wretch".split()
THREATS = "beat break burn crush destroy end hang harm hunt hurt kill murder punch shoot slap smash stab strangle".split()
TARGETS = "you your yours yourself u ur he him she her they them these those all everyone people".split()
DENIALS = "not no never neither nor cannot hardly without isn't aren't wasn't weren't don't doesn't didn't won't ain't isnt arent dont doesnt didnt wont".split()
REPORTS = "said says say called calls quoted quotes wrote writes reported reports alleged allegedly claimed claims according mentioned told".split()
FUTURE = "will gonna shall going must should i'll we'll".split()

#: The symbols of words, and those that the transducers put in their place.
OTHER, INSULT, THREAT, TARGET, DENIAL, REPORT, FUTURITY, END, STEM, DENIED, MENACE, AIMED, AIM = range(13)
SYMBOL_COUNT = 13
SYMBOLS = {w: s for s, ws in ((FUTURITY, FUTURE), (REPORT, REPORTS), (DENIAL, DENIALS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
for _w in INSULTS:
    SYMBOLS.setdefault(f"{_w}s", INSULT)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]+")
#: How many tokens a denial reaches, and how near a target must stand.
REACH = 4
#: Kinds of clauses, and their weights before fitting; the last is the intercept.
KINDS = ("aimed insult", "bare insult", "threat", "denied", "reported", "stem")
DEFAULT = np.array([3.2, 2.6, 3.0, -0.4, -0.2, 1.0, -2.0])
#: Stems that the word lists lack, mostly of other languages, are taken from the sample: beginnings
#: of words of these lengths, in so many toxic documents at least, so much more often than in
#: others, and so far from chance.
STEM_LENGTHS, STEM_SUPPORT, STEM_LIFT, STEM_Z = (4, 5, 6, 7), 5, 5.0, 6.0


def _negation(reach: int, x: int) -> tuple[int, int]:
    """An insult, stem or threat that a denial reaches is denied."""
    if x == END:
        return x, 0
    if x in (INSULT, STEM, THREAT) and reach:
        return DENIED, reach - 1
    return x, REACH if x == DENIAL else max(0, reach - 1)


def _threat(state: tuple[int, int], x: int) -> tuple[int, tuple[int, int]]:
    """Futurity, then a threat, then a target, each near the one before: the target becomes a menace."""
    future, waiting = state
    if x == END:
        return x, (0, 0)
    out = x
    if x == THREAT:
        out, waiting = OTHER, 4 if future else 0
    elif x == TARGET and waiting:
        out = MENACE
    return out, (REACH if x == FUTURITY else max(0, future - 1), max(0, waiting - 1))


def _aim(state: tuple[int, int], x: int) -> tuple[int, tuple[int, int]]:
    """An insult near a target is aimed; a target that follows one aims it."""
    target, insulted = state
    if x == END:
        return x, (0, 0)
    out = x
    if x == INSULT:
        out, insulted = AIMED if target else INSULT, 1
    elif x == TARGET and insulted and not target:
        out = AIM
    return out, (REACH + 2 if x in (TARGET, MENACE) else max(0, target - 1), insulted)


def _reported(told: int, x: int) -> tuple[int, int]:
    """Of the reports of a clause the first alone stays."""
    if x == END:
        return x, 0
    return (OTHER, 1) if x == REPORT and told else (x, told or int(x == REPORT))


NONE, STEMMED, BARE, DIRECT, MENACING = range(5)
_STRENGTH = {STEM: STEMMED, INSULT: BARE, AIMED: DIRECT, AIM: DIRECT, MENACE: MENACING}


def _clause(state: tuple[int, int, int], x: int) -> tuple[int, tuple[int, int, int]]:
    """Puts out 0 inside a clause; at its end 1 + its kind, or 0 for a clause without one."""
    hit, denied, told = state
    if x == END:
        if told and hit > STEMMED:
            return 1 + KINDS.index("reported"), (0, 0, 0)
        if hit and not told:
            return 1 + KINDS.index({STEMMED: "stem", BARE: "bare insult", DIRECT: "aimed insult", MENACING: "threat"}[hit]), (0, 0, 0)
        return 1 + KINDS.index("denied") if denied and not hit else 0, (0, 0, 0)
    return 0, (max(hit, _STRENGTH.get(x, NONE)), denied or int(x == DENIED), told or int(x == REPORT))


def parts() -> list[Transducer]:
    """The transducers in the order in which they read each other's symbols."""
    rules = ((0, _negation), ((0, 0), _threat), ((0, 0), _aim), (0, _reported), ((0, 0, 0), _clause))
    return [Transducer.from_rule(start, SYMBOL_COUNT, rule) for start, rule in rules]


@functools.cache
def grammar() -> Transducer:
    return compose(*parts())


def symbols_of(text: str, stems: frozenset[str] = frozenset()) -> list[int]:
    """The symbol of each word and mark; the text's end ends a clause."""
    out = []
    for word in TOKEN.findall(text.lower()):
        if word[0] in ".!?;\n":
            out.append(END)
            continue
        symbol = SYMBOLS.get(word.replace("’", "'"), OTHER)
        if symbol == OTHER and stems and any(word[:n] in stems for n in STEM_LENGTHS):
            symbol = STEM
        out.append(symbol)
    out.append(END)
    return out


def clause_kinds(text: str, stems: frozenset[str] = frozenset()) -> np.ndarray:
    """How many clauses of each kind the text holds."""
    arcs, state = grammar().arcs, 0
    out = [0] * (len(KINDS) + 1)
    for symbol in symbols_of(text, stems):
        kind, state = arcs[state][symbol]
        out[kind] += kind > 0
    return np.array(out[1:], float)


def measure(kinds: np.ndarray) -> np.ndarray:
    """Counts level off: the second clause of a kind says less than the first."""
    return np.log2(1 + kinds)


def hint(stems: frozenset[str]) -> str:
    """What a text must hold for any clause to match."""
    return "(?i)" + "|".join(sorted({*INSULTS, *THREATS, *map(re.escape, stems)}))


def _kinds(texts: pa.Array, stems: frozenset[str]) -> np.ndarray:
    out = np.zeros((len(texts), len(KINDS)))
    hit = pc.fill_null(pc.match_substring_regex(texts, hint(stems)), False).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(hit):
        out[i] = clause_kinds(texts[int(i)].as_py(), stems)
    return out


def find_stems(sample: DataFrame) -> frozenset[str]:
    """Beginnings of words that set the sample's toxic documents apart; the sample's bound bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(t.as_py().lower()) if len(w) >= STEM_LENGTHS[0] and w not in SYMBOLS}
                counts[y].update({w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n})
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts[y]), pa.string()), pa.array([y] * len(counts[y]), pa.int32()), pa.array(list(counts[y].values()), pa.int64())], names=["stem", "y", "n"])

    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return frozenset()
    found = sample.select("text", "y").mapInArrow(run, "stem string, y int, n long").groupBy("stem")
    a, b = F.col("a") / sizes[1], F.col("b") / sizes[0]
    p = (F.col("a") + F.col("b")) / (sizes[0] + sizes[1])
    z = (a - b) / F.sqrt(p * (1 - p) * (1 / sizes[0] + 1 / sizes[1]))
    rows = found.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    rows = rows.where((F.col("a") >= STEM_SUPPORT) & (a >= STEM_LIFT * b) & (p < 1)).withColumn("z", z).where(F.col("z") >= STEM_Z)
    best = rows.orderBy(F.desc("z"), F.desc(F.length("stem")), "stem").collect()
    kept: list[str] = []
    for r in best:
        if not any(r.stem.startswith(k) or k.startswith(r.stem) for k in kept):
            kept.append(r.stem)
    return frozenset(kept)


class Model:
    def __init__(self, weights: np.ndarray, stems: frozenset[str] = frozenset()):
        self.weights, self.stems = weights, stems

    def score(self, kinds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(measure(kinds) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Penalised logistic regression that keeps to the default weights where the sample says little."""
    if len(y) == 0 or y.min() == y.max():
        return DEFAULT
    a = np.column_stack([x, np.ones(len(x))])
    w, pull = DEFAULT.copy(), np.array([2.0] * len(KINDS) + [0.5])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + pull * (w - DEFAULT)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Only stems and clause counts of at most `most` rows come to the driver."""
    sample = stash(labelled_sample(docs, labels, "toxic", most).select(F.coalesce("text", F.lit("")).alias("text"), "y"), "toxic-sample")
    stems = find_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(_kinds(b.column(0), stems)), pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = sample.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    unstash(sample)
    got.sort()
    x = np.array([r.x for r in got for _ in range(r["count"])]).reshape(-1, len(KINDS))
    return Model(fit_weights(measure(x), np.array([r.y for r in got for _ in range(r["count"])], float)), stems)


def classify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score and the number of clauses of each kind."""
    names = [f"n_{k.replace(' ', '_')}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = _kinds(b.column(1), model.stems)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(kinds)), *[pa.array(kinds[:, i].astype(np.int32)) for i in range(len(KINDS))]], names=["doc_id", "score", *names])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, score double, " + ", ".join(f"{n} int" for n in names))


def op9_clause_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumn("held_out", fold(F.col("doc_id")) == 0).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
