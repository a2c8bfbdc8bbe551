import hashlib
import random
import re
import string
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atlasmill.llm import boosting, licenses, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "a@b.co_x@d.com a@b.co.@d.com %@x.y. a@b a@@b.c x@a.b..c", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.0003.255 1.2.3 9.1.2.3.4", "4111 1111-1111 1111 5 4111111111111111 41111111111111112 4-4",
    "+1 (243) 555-5526 +12 +1--------2 ++49 30 1234567 +1234567890123456", "é😀 mail😀 x@y.zz 😀 +1 415 555 2671é", "token = \"908038b7daaf91e730d2f64001c52934d43d9336\" and password: hunter", "call 415-555-2671 or order 415-555-2671, ssn 123-45-6789, iban DE44500105175407324931",
    "bob [at] mail [dot] com", "a" * 60000 + "1" * 60000 + "." * 10 + "-" * 9000, "x.y" * 30000 + "@", "+1" + " " * 5000, "@".join(["a.b"] * 600),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "kept", 5) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "kept", 5)], "doc_id long, text string, _text string, n_chars long").withColumn("spans", F.lit(1))


def test_base_spans_against_plain_patterns(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for d in (docs.select("doc_id", "text"), big):
        texts = {r.doc_id: r.text or "" for r in d.collect()}
        for r in pii.find(d, keep=("doc_id",)).collect():
            got = [(s.kind, s.start, s.end) for k in pii.BASE for s in r[f"_{k}"]]
            assert got == plain(texts[r.doc_id])
            for s in r._more:
                assert texts[r.doc_id][s.start : s.end] == s.value
                assert not any(s.start < e and b < s.end for _, b, e in got)


def test_added_spans(spark, docs):
    got = {r.doc_id: [(s.kind, s.value) for s in r._more] for r in pii.find(docs, keep=("doc_id",)).collect()}
    assert got[7] == [("secret", "908038b7daaf91e730d2f64001c52934d43d9336")]
    assert ("phone", "415-555-2671") in got[8] and ("ssn", "123-45-6789") in got[8] and ("iban", "DE44500105175407324931") in got[8]
    assert sum(k == "phone" for k, _ in got[8]) == 1
    assert got[9] == [("email", "bob [at] mail [dot] com")]
    assert all(not got[i] for i in (0, 1, 2, 3, 10, 11, 12, 13))


def test_op8_columns(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op8_boosted_pii(spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert Counter(k for k, _, _ in want) == Counter({k: r[f"n_{k}"] for k in pii.BASE if r[f"n_{k}"]})
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(",")) | {""}
        assert r.n_spans == len([x for x in r.spans.split(",") if x])


def test_clashing_names(spark, docs):
    """Columns with the names of added ones give way in find and stay in redacted."""
    odd = docs.select("doc_id", "text", F.lit("x").alias("_email"), F.lit("y").alias("_scored"), F.lit("z").alias("_more"))
    rows = pii.find(odd).collect()
    assert len(rows) == odd.count() and all(not isinstance(r._email, str) for r in rows)
    assert {(r._email, r._scored, r._more) for r in pii.redacted(odd).collect()} == {("x", "y", "z")}


def test_many_matches(spark):
    """Places are right across runs of matches, and many matches in one text take no square of time."""
    text = " é ".join(f"a{i}@b.c" for i in range(3000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(s.start, s.end) for s in pii.find(d, keep=("doc_id",)).first()._email]
    assert got == [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+@b\.c", text)]


def test_redaction(spark, docs):
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text is None and got[1].text == "" and got[0]._text == "kept"
    assert got[6].text == "é😀 mail😀 [EMAIL] 😀 [PHONE]é" and got[6].n_chars == len(got[6].text)
    assert got[7].text == 'token = "[SECRET]" and password: hunter'
    assert out.count() == len(TEXTS) + 1 and pii.redacted(docs.where("false")).count() == 0


def test_long_values(spark):
    """A value is found and redacted to its end, however long."""
    r = random.Random(3)
    long = lambda n, extra="": "".join(r.choice(string.ascii_letters + string.digits + extra) for _ in range(n))
    jwt = f"eyJhbGciOiJSUzI1NiJ9.{long(400)}.{long(342, '_-')}"
    values = [("secret", long(n)) for n in (256, 257, 600, 5000)] + [("secret", jwt)]
    values += [("email", f"{'n' * n}ame [at] {'m' * n}ail [dot] {tail}") for n, tail in ((37, "com"), (38, "com"), (60, "org"), (300, "com"), (3, "international"))]
    d = spark.createDataFrame([(i, f"token = {v}, end" if k == "secret" else f"write {v}, end") for i, (k, v) in enumerate(values)], "doc_id long, text string")
    found = {x.doc_id: [(s.kind, s.value) for s in x._more] for x in pii.find(d, keep=("doc_id",)).collect()}
    texts = {x.doc_id: x.text for x in pii.redacted(d).collect()}
    for i, (kind, value) in enumerate(values):
        assert found[i] == [(kind, value)]
        assert texts[i] == ("token = [SECRET], end" if kind == "secret" else "write [EMAIL], end")


def test_features_in_both_forms(spark):
    rows = pii.made_up(5, 60)
    df = spark.createDataFrame([(i, k, v, b) for i, (k, v, b, _) in enumerate(rows)], "i int, kind string, value string, before string")
    for r in df.select("i", F.array(*[f.cast("double") for f in pii._features(F.col("kind"), F.col("value"), F.col("before"))]).alias("f")).collect():
        assert r.f == [float(x) for x in pii.features(*rows[r.i][:3])]


def test_trees_in_both_forms(spark):
    trees, _ = pii.model()
    rows = [[float(x) for x in pii.features(*r[:3])] for r in pii.made_up(6, 50)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, f array<double>")
    for r in df.select("i", boosting.expression(trees, [F.col("f")[i] for i in range(len(pii.FEATURES))]).alias("m")).collect():
        assert r.m == pytest.approx(boosting.margin(trees, rows[r.i]))


LICENSES = [
    (1, "x. Licensed under the Apache License, Version 2.0.\nUnder CC-BY now; cc BY!", 1), (2, None, 1), (3, "", 1), (4, "éMIT license mit\nlicense", 1), (5, "released  under THE mit-License", 1),
    (5, "plain", 1), (None, "Apache License", 1), (6, "GNU General Public Licenses GNU general public license\n" + "the " * 30000, 1),
    (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation.", 1), (8, "the of and\n" * 3000, 1),
]


def test_license_scan_by_hand(spark):
    d = spark.createDataFrame(LICENSES, "doc_id long, text string, label int").withColumn("places", F.lit("x"))
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r.doc_id, []).append(r)
    a = got[1][0]
    assert (a.n_words, a.n_base, a.first_word, a.last_word, a.base_labels, a.labels, a.score) == (15, 3, 4, 13, "apache,cc-by", "apache,cc-by", 1.0)
    assert [(r.n_words, r.n_base, r.first_word, r.base_labels, r.labels, r.score) for r in got[2] + got[3]] == [(0, 0, None, "", "", 0.0)] * 2
    assert got[4][0].n_base == 1 and got[4][0].first_word == 2 and got[4][0].base_labels == "mit"
    assert sorted((r.n_words, r.base_labels, r.labels) for r in got[5]) == [(1, "", "mit"), (5, "mit", "mit")]
    assert got[None][0].labels == "apache" and got[6][0].n_base == 1 and got[6][0].first_word == 4
    assert got[7][0].base_labels == "" and got[7][0].labels == "mit" and 0.9 <= got[7][0].score < 1
    assert got[8][0].labels == ""
    assert licenses.scan(d.where("false")).count() == 0


def held(text):
    """(label, containment) of every notice that a window of the words of the text holds."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    out = {}
    for notice, label in licenses.NOTICES:
        s, size, ws = set(notice.split()), licenses.window_size(notice), words(text)
        best = max(len(s & set(b)) for b in [ws[i : i + size] for i in range(len(ws) or 1)])
        if best >= licenses.needed(len(s)):
            out[label] = max(out.get(label, 0), best / len(s))
    return out


def test_wrapped_notices(spark):
    """Notices broken over lines, commented, cut, spread out and repeated in long texts, against every window in plain Python."""
    filler = "some other words that stand around it and say nothing of it at all ".split()
    texts, labels = [], []
    for i, (notice, label) in enumerate(licenses.NOTICES):
        ws = notice.split()
        for before in (9, 200 + 17 * i):
            lines = textwrap.wrap(" ".join((filler * 40)[:before] + ws + filler * 3), 72)
            for mark in ("", "# ", " * "):
                texts.append("\n".join(mark + x for x in lines))
                labels.append(label)
        texts.append("\n".join(ws))
        labels.append(label)
        texts += ["\n".join(textwrap.wrap(" ".join(ws[1:-1]), 30)), "\n".join(f"{w} one two three" for w in ws), "\n".join(ws[: len(ws) // 2] + ["filler"] * 60 + ws[len(ws) // 2 :])]
        labels += [None] * 3
    texts += ["unencumbered\n" * 20000, "\n", "\n\nreleased under\nthe MIT\n\nlicense", "\r\n".join(textwrap.wrap(licenses.NOTICES[11][0], 40))]
    labels += [None, None, "mit", "bsd"]
    # The few words of a notice scattered over one very long line are no notice; standing together in it they are.
    scattered = (["filler"] * 200).copy()
    for at, w in zip((3, 50, 90, 130, 180), "released under the mit license".split()):
        scattered[at] = w
    texts += [" ".join(scattered), " ".join(["filler"] * 500 + "released under the mit license".split() + ["filler"] * 500)]
    labels += [None, "mit"]
    assert held(texts[-2]) == {}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    for i, (text, label) in enumerate(zip(texts, labels)):
        want = held(text)
        assert label is None or label in want
        assert got[i].labels == ",".join(sorted({*filter(None, got[i].base_labels.split(",")), *want})), text
        assert got[i].score == pytest.approx(1.0 if got[i].n_base else max(want.values(), default=0.0))
