"""License scans: against SQL, a plain scan, and odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from breakweave.llm import license, queries
from breakweave.llm.license_texts import PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, templates=TEMPLATES, k=4, slack=3, coverage=0.75, density=0.6):
    """Number of words, places of phrases, verified spans and score of one text."""
    w = words(text)
    base = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    spans, best = [], 0.0
    for number, (label, t) in enumerate(templates):
        tw = words(t)
        lines = {}
        for i in range(len(w) - k + 1):
            for j in range(len(tw) - k + 1):
                if w[i : i + k] == tw[j : j + k]:
                    lines.setdefault(i - j, []).append(i)
        groups = []
        for d in sorted(lines):
            if groups and d - groups[-1][-1] <= slack:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            covered = sum(len({x for i in lines[d] for x in range(i, i + k)}) for d in g)
            a, b = min(min(lines[d]) for d in g), max(max(lines[d]) for d in g) + k
            covered = min(covered, len(tw), b - a)
            best = max(best, covered / len(tw))
            if covered / len(tw) >= coverage and covered / (b - a) >= density:
                spans.append((a, b, label, number, sum(len(lines[d]) for d in g), covered, covered / len(tw)))
    return len(w), base, sorted(spans), 1.0 if base else best


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, base, spans, score = brute(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.score) == (n, len(base), score), t
        assert [tuple(s) for s in r.spans] == spans, t
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.base_labels == sorted({b[1] for b in base})
        assert r.labels == sorted({b[1] for b in base} | {s[2] for s in spans})


def test_edited_licenses_match_a_plain_scan(spark):
    r = random.Random(7)
    texts = []
    for _ in range(120):
        out = []
        for _ in range(r.randrange(1, 4)):
            w = words(r.choice(TEMPLATES)[1])
            for _ in range(r.randrange(0, 1 + len(w) // 8)):
                i = r.randrange(len(w) + 1)
                w[i : i + r.randrange(3)] = [r.choice(["extra", "the", "ünder", "7"]) for _ in range(r.randrange(3))]
            out += [*w, *r.choices(["some", "other", "prose", "mit", "license"], k=r.randrange(6))]
        texts.append(r.choice([" ", "\n", ", "]).join(x.upper() if r.random() < 0.2 else x for x in out))
    check(spark, texts)


def test_what_counts_as_a_license(spark):
    whole = dict((label, t) for label, t in TEMPLATES)
    texts = [
        "Released under the MIT License.",
        "Licensed under CC BY-NC 4.0.",  # no phrase, and not CC BY
        "An MIT licensed tool; the mit-license; MIT\nLICENSE",
        "licensed under the terms of an agreement, version 2 0 of it",
        whole["isc"],
        whole["isc"].replace("any purpose", "every honest purpose"),
        "before " * 30 + whole["zlib"] + " after" * 30,
        "Released under the MIT License. " * 3,
    ]
    check(spark, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in license.scan_licenses(docs).collect()}
    assert labels == {0: ["mit"], 1: ["cc-by-nc"], 2: ["mit"], 3: [], 4: ["isc"], 5: ["isc"], 6: ["zlib"], 7: ["mit"]}


def test_odd_rows(spark):
    kind = "doc_id long, text string, template int, label string, pos int, w string, h long, base int, t int, labels string, copies int"
    extra = (1, "l", 2, "w", 3, 4, 5, "x", 6)
    long = "prose " * 30_000 + TEMPLATES[3][1]
    texts = [(None, None), (None, ""), (None, "MIT license"), (1, None), (2, "  \n"), (3, "mit"), (4, "the MIT License"), (4, "the MIT License"), (4, "apache license"), (5, long), (6, "x" * 40_000)]
    docs = spark.createDataFrame([(*t, *extra) for t in texts], kind)
    got = license.scan_licenses(docs)
    rows = sorted((str(r.doc_id), r.n_words, r.n_base, ",".join(r.labels), r.score) for r in got.collect())
    want = []
    for i, t in texts:
        n, base, spans, score = brute(t)
        want.append((str(i), n, len(base), ",".join(sorted({b[1] for b in base} | {s[2] for s in spans})), score))
    assert rows == sorted(want)
    empty = license.scan_licenses(docs.where("1 = 0"))
    assert empty.collect() == [] and empty.schema == got.schema
    none = license.scan_licenses(docs, templates=spark.createDataFrame([(1, None, "a b c d e"), (2, "short", "a b"), (3, "null", None)], "template int, label string, text string"), phrases={})
    assert {(r.n_base, tuple(r.labels), r.score) for r in none.collect()} == {(0, (), 0.0)}


def test_templates_beyond_broadcast_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEMPLATES)], "doc_id long, text string")
    near = sorted(map(str, license.scan_licenses(docs).collect()))
    monkeypatch.setattr(license, "small", lambda df: df)
    assert sorted(map(str, license.scan_licenses(docs).collect())) == near


def test_repeated_rows_meet_as_one_before_the_shuffle(spark):
    """A third of all rows may be one row: its hits are combined before rows move."""
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(TEMPLATES[3][1]).alias("text"))
    got = license.scan_licenses(docs)
    assert got.count() == 4000 and got.distinct().count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    found = duck.execute(queries.ORACLES["op12_license_scan"])
    names = [d[0] for d in found.description]
    df = queries.QUERIES["op12_license_scan"](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == sorted(map(str, found.fetchall()))
