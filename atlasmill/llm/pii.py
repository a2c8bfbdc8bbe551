r"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

Generators propose spans with high recall, overlaps included. Format and context features of each
candidate go through boosted trees, compiled to column expressions; a candidate stays when its log
odds pass the threshold calibrated for its kind, it meets no base span, and no better candidate
overlaps it. The trees are grown on a seeded set of made-up candidates of fixed size. DataFrame
operations only; offsets are code points.

Patterns are written so that a scan stays linear: a run is entered at its start only and never
given back, which leaves the matches of the plain patterns unchanged.

Nulls: a null text is empty. Very long texts are read whole. Repeated rows get equal results;
empty tables give empty ones; other columns are kept by `redacted` and ignored by `find`.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasmill.llm import boosting

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn")

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
FOUR_BYTES = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"

#: Candidate generators: kind, pattern, and what a text must match to be scanned.
CUE_NAMES = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key"
GENERATORS = (
    ("secret", rf"(?<=(?i:{CUE_NAMES})[\x20]{{0,3}}[=:][\x20]{{0,3}}[\x22\x27]?)(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{{8,}}+", r"(?i)(?:token|secret|passw|pwd|[_-]?key)[^\n=:]{0,6}[=:]"),
    ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{3}"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[\x20]?[A-Z0-9]{4}"),
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+[\x20]?[\[(][\x20]?(?i:at)[\x20]?[\])][\x20]?[A-Za-z0-9-]{2,}+[\x20]?(?:[\[(][\x20]?(?i:dot)[\x20]?[\])]|\.)[\x20]?[A-Za-z]{2,}+", r"(?i)[\[(][\x20]?at[\x20]?[\])]"),
)
GENERATED = tuple(k for k, _, _ in GENERATORS)

#: Words before a candidate that speak for and against it.
FOR = r"(?i)(?:phone|tel|call|mobile|fax|cell|ssn|social|security|iban|account|bank|mail|contact|write|reach)[a-z]{0,6}[\x20:.#-]{0,4}$"
AGAINST = r"(?i)(?:version|order|invoice|isbn|issn|page|ref|build|item|part|serial|no|nr|id|\$|#|=)[\x20:.#-]{0,3}$"
FEATURES = ("kind", "length", "digits", "letters", "separators", "cue", "against", "mixed", "distinct", "hex")


#: Matches whose lengths are added up together.
RUN = 64


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row and not again in every lambda that names it."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """All matches, left to right, as (kind, start, end, value).

    A start is the sum of the gaps and matches before it: whole runs of RUN first, then what is left, so a text
    with m matches costs m * (m / RUN + RUN) additions.
    """
    add = lambda a, b: a + b
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), gaps.alias("g"))
    steps = lambda f: F.struct(f["m"].alias("m"), f["g"].alias("g"), F.zip_with(f["g"], f["m"], lambda g, m: g + F.coalesce(F.length(m), F.lit(0))).alias("s"))
    runs = lambda f: F.struct(f["m"].alias("m"), f["g"].alias("g"), f["s"].alias("s"), F.transform(F.sequence(F.lit(0), F.floor(F.size(f["s"]) / RUN).cast("int")), lambda j: F.aggregate(F.slice(f["s"], j * RUN + 1, RUN), F.lit(0), add)).alias("r"))

    def at(f: Column, m: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        start = F.aggregate(F.slice(f["r"], 1, run), F.get(f["g"], i), add) + F.aggregate(F.slice(f["s"], run * RUN + 1, i - run * RUN), F.lit(0), add)
        return _once(start, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("start"), (a + F.length(m)).alias("end"), m.alias("value")))

    return _once(found, lambda f: _once(steps(f), lambda g: _once(runs(g), lambda h: F.transform(h["m"], lambda m, i: at(h, m, i)))))


NO_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _when(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(NO_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled."""

    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), term), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _base(t: Column) -> dict[str, Column]:
    phone_size = lambda s: F.length(_digits(s["value"]))
    card_size = lambda s: F.length(_digits(s["value"]))
    return {
        "email": _when(F.contains(t, F.lit("@")), _spans(t, EMAIL, "email")),
        "ip": F.filter(_when(t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _spans(t, IP, "ip")), lambda s: s["value"].rlike(FOUR_BYTES)),
        "card": F.filter(_when(t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _spans(t, CARD, "card")), lambda s: card_size(s).between(16, 19) & F.when(card_size(s).between(16, 19), _luhn(_digits(s["value"]))).otherwise(False)),
        "phone": F.filter(_when(F.contains(t, F.lit("+")), _spans(t, PHONE, "phone")), lambda s: phone_size(s).between(8, 15)),
    }


def _features(kind: Column, value: Column, before: Column) -> list[Column]:
    index = F.array_position(F.array(*[F.lit(k) for k in GENERATED]), kind)
    count = lambda p: F.length(F.regexp_replace(value, p, ""))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        index, F.length(value), count("[^0-9]"), count("[^A-Za-z]"), count(r"[^\x20().-]"), flag(before.rlike(FOR)), flag(before.rlike(AGAINST)),
        flag(value.rlike("[0-9]") & value.rlike("[A-Za-z]")), F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != ""))), flag(value.rlike("^[0-9a-f]+$")),
    ]


def features(kind: str, value: str, before: str) -> list[float]:
    """The same in Python, for growing the trees; tests hold both together."""
    n = lambda p: len(re.sub(p, "", value))
    return [
        GENERATED.index(kind) + 1, len(value), n("[^0-9]"), n("[^A-Za-z]"), n(r"[^\x20().-]"), bool(re.search(FOR, before)), bool(re.search(AGAINST, before)),
        bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value)), len(set(value)), bool(re.fullmatch("[0-9a-f]+", value)),
    ]


def made_up(seed: int = 11, n: int = 1500) -> list[tuple[str, str, str, int]]:
    """(kind, value, text before, 1 if personal): the fixed-size training set."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    any_of = lambda k, s: "".join(r.choice(s) for _ in range(k))
    low, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    out = []
    for _ in range(n):
        kind, good = r.choice(GENERATED), r.random() < 0.5
        word = any_of(r.randint(2, 8), low)
        if kind == "secret":
            value = any_of(r.randint(16, 64), r.choice([hexa, low + low.upper() + "0123456789"])) if good else r.choice([any_of(r.randint(8, 14), low), digits(r.randint(8, 10)), f"{word}.{word}-{word}", f"{word}/{word}/{word}"])
            before = f"{word} {r.choice(['token = ', 'password: ', 'api_key='])}"
        elif kind == "phone":
            sep = r.choice(" .-")
            value = r.choice([f"({digits(3)}) {digits(3)}{sep}{digits(4)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"]) if good else r.choice([f"{digits(4)}{sep}{digits(4)}{sep}{digits(4)}", f"{digits(2)}{sep}{digits(3)}{sep}{digits(3)}", f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"])
            before = f"{word} {r.choice(['call ', 'phone: ', 'tel ', 'at ', ''])}" if good else f"{word} {r.choice(['order ', 'invoice #', 'isbn ', 'ref ', 'no. '])}"
        elif kind == "ssn":
            value = f"{digits(3)}-{digits(2)}-{digits(4)}"
            before = f"{word} {r.choice(['ssn ', 'social security ', '', 'is '])}" if good else f"{word} {r.choice(['part ', 'serial ', 'order ', 'item #'])}"
        elif kind == "iban":
            value = any_of(2, "DFGEN") + digits(2) + (digits(r.randint(12, 24)) if good else any_of(r.randint(8, 16), low.upper()))
            before = f"{word} {r.choice(['iban ', 'account: ', '', 'to '])}" if good else f"{word} {r.choice(['', 'serial ', 'part ', 'id '])}"
        else:
            a, b = any_of(r.randint(2, 12), low), any_of(r.randint(2, 12), low)
            value = f"{a} [at] {b} [dot] {r.choice(['com', 'org', 'de'])}" if good else f"{a} (at) {b}. {any_of(r.randint(3, 9), low)}"
            before = f"{word} {r.choice(['mail ', 'write ', '', 'contact: '])}" if good else f"{word} "
        out.append((kind, value, before[-24:], int(good)))
    return out


@functools.cache
def model() -> tuple[list, dict[str, float]]:
    """The trees, and for each kind the least log odds at which a second made-up set is 98 % right."""
    rows = made_up()
    trees = boosting.grow(np.array([features(*r[:3]) for r in rows], float), np.array([r[3] for r in rows], float))
    second = [(r[0], boosting.margin(trees, features(*r[:3])), r[3]) for r in made_up(12)]
    least = {}
    for kind in GENERATED:
        scored = sorted(((m, y) for k, m, y in second if k == kind), reverse=True)
        right, cut = 0, 4.0
        for i, (m, y) in enumerate(scored, 1):
            right += y
            if right >= 0.98 * i and m > 0:
                cut = m
        least[kind] = cut - 1e-9
    return trees, least


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default), _text, and arrays of spans: _email, _ip, _card, _phone, _more.

    Spans are (kind, start, end, value); those in _more are the judged candidates. Columns of docs with the names
    of added ones give way to them.
    """
    added = {"_text", "_candidates", "_measured", "_scored", "_more", *(f"_{k}" for k in BASE)}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    t = F.col("_text")
    rows = docs.select(*names, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    base = _base(t)
    candidates = F.concat(*[_when(t.rlike(hint), _spans(t, p, k)) for k, p, hint in GENERATORS])
    rows = rows.select(*names, "_text", *[base[k].alias(f"_{k}") for k in BASE], candidates.alias("_candidates"))
    trees, least = model()

    def judged(s: Column) -> Column:
        before = t.substr(F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24)))
        fields = _features(s["kind"], s["value"], before)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *[f.cast("double").alias(f"f{i}") for i, f in enumerate(fields)])

    rows = rows.withColumn("_measured", F.when(F.size("_candidates") > 0, F.transform("_candidates", judged)))

    def scored(s: Column) -> Column:
        odds = boosting.expression(trees, [s[f"f{i}"] for i in range(len(FEATURES))])
        limit = F.lit(99.0)
        for k in GENERATED:
            limit = F.when(s["kind"] == k, F.lit(least[k])).otherwise(limit)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), odds.alias("odds"), (odds >= limit).alias("ok"))

    rows = rows.withColumn("_scored", F.filter(F.transform("_measured", scored), lambda s: s["ok"]))
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    taken = F.concat(*[F.col(f"_{k}") for k in BASE])
    better = lambda a, b: (a["odds"] > b["odds"]) | ((a["odds"] == b["odds"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"]))))
    free = F.filter("_scored", lambda s: ~F.exists(taken, lambda b: overlap(s, b)) & ~F.exists("_scored", lambda o: overlap(s, o) & better(o, s)))
    more = F.transform(free, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.select(*names, "_text", *[f"_{k}" for k in BASE], F.coalesce(F.when(F.size("_scored") > 0, more), F.array().cast(NO_SPANS)).alias("_more"))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start."""
    at = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(at, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("n"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["n"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; a null text stays null."""
    names = docs.columns
    inner = find(docs.toDF(*[f"c{i}" for i in range(len(names))]), text=f"c{names.index(text)}")
    spans = F.concat(*[F.col(f"_{k}") for k in (*BASE, "more")])
    t = F.col("_text")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], t.substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], -s["back"]).alias("at"), F.when(s["start"] >= a["at"], piece).otherwise(a["out"]).alias("out"))

    filled = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], t.substr(a["at"] + 1, F.length(t))))
    own = f"c{names.index(text)}"
    inner = inner.withColumn("_new", F.when(F.col(own).isNull(), F.lit(None).cast("string")).when(F.size(spans) > 0, filled).otherwise(F.col(own)))
    out = []
    for i, n in enumerate(names):
        c = F.col(f"c{i}")
        if n == text:
            c = F.col("_new")
        elif n == length:
            c = F.when(F.col("_new").isNull(), c).otherwise(F.length("_new")).cast(docs.schema[n].dataType)
        out.append(c.alias(n))
    return inner.select(*out)


def op8_boosted_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    return found.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(base, F.col("_more"))).alias("spans"), F.size(F.concat(base, F.col("_more"))).cast("long").alias("n_spans"))
