"""Runs of positions in two levels, and seeding of large groups in tiles, against plain passes."""

import random

import numpy as np
import pandas as pd
import pytest

from breakweave.operators import ordered, seeding


@pytest.mark.parametrize("size", [1, 7, 100, ordered.SWEEP])
def test_runs_are_linked_across_buckets(spark, size):
    r = random.Random(size)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(-300, 300)])) for _ in range(120)] + [("c", 5)] * 40 + [("d", -1)]
    got = ordered._runs(spark.createDataFrame(rows, "k string, p long"), ["k"], "p", 9, "run", size)
    want = {}
    for key in {k for k, _ in rows if k}:
        n, last = 0, None
        for p in sorted({p for k, p in rows if k == key and p is not None}):
            n += last is not None and p - last > 9
            want[key, p], last = n, p
    assert {(x.k, x.p): x.run for x in got.collect()} == want and got.count() == len(want)


def test_runs_have_no_window_over_a_whole_key(spark):
    rows = spark.createDataFrame([("a", 1)], "k string, p long")
    plan = ordered._runs(rows, ["k"], "p", 9, "run")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__b" in w for w in windows)


def molecules(spark, types):
    rows = [(g, bool(s), side1, a, side2, b, q, 0, i) for i, (g, s, side1, a, side2, b, n, q) in enumerate(t for t in types for _ in range(t[6]))]
    return spark.createDataFrame(rows, "group_id long, is_split boolean, side1 string, pos1 int, side2 string, pos2 int, mapq1 int, mapq2 int, mol_id int")


def result(df):
    return sorted((x.mol_id, x.sv_n, x.is_ambiguous) for x in df.collect())


def random_types(r, group, n, span, ties):
    sides = r.choice("LR"), r.choice("LR")
    keys = {(r.random() < 0.4, r.randrange(span), r.randrange(span // 4)) for _ in range(n)}
    return [(group, s, sides[0], a, sides[1], b, 1 if ties else r.randrange(1, 4), 0 if ties else r.randrange(3)) for s, a, b in sorted(keys)]


@pytest.mark.parametrize("ties", [False, True])
def test_tiles_give_the_seeds_of_one_pass(spark, ties):
    """Many tiles, small groups beside large ones, and chains along positions where all types are equal in rank."""
    r = random.Random(11 + ties)
    types = random_types(r, 1, 400, 3000, ties) + random_types(r, 2, 60, 90, ties) + random_types(r, 3, 8, 300, ties) + [(4, True, "L", 5, "R", 5, 2, 1)]
    df = molecules(spark, types)
    whole = result(seeding.parse_continuity_groups(df, "group_id", 5, 150))
    assert whole == result(seeding.parse_continuity_groups(df, "group_id", 5, 150, most=20))
    assert {m for m, *_ in whole} == set(range(df.count()))


def test_a_tile_leaves_open_what_others_decide():
    # three gaps in a chain, equal in rank: the first covers the second, so the third is a seed
    t = pd.DataFrame({"is_split": False, "side1": "L", "pos1": [0, 100, 200], "side2": "R", "pos2": [0, 0, 0], "n": 1, "mapq": 0, "state": 0, "own": True})
    assert seeding.settle_tile(t, 5, 150).tolist() == [seeding.SEED, seeding.COVERED, seeding.SEED]
    # seen from the tile of the last two, the first may be covered by what lies before it
    t["own"] = [False, True, True]
    assert seeding.settle_tile(t, 5, 150).tolist() == [seeding.OPEN, seeding.OPEN, seeding.OPEN]
    t["state"] = [seeding.SEED, 0, 0]
    assert seeding.settle_tile(t, 5, 150).tolist() == [seeding.SEED, seeding.COVERED, seeding.SEED]


def test_a_hot_locus_is_spread_over_tasks(spark, monkeypatch):
    """One group has most types; no task takes more than a tile of it."""
    r = random.Random(5)
    types = random_types(r, 1, 3000, 40_000, True) + [(g, True, "L", 9, "R", 9, 1, 0) for g in range(2, 50)]
    log = spark.sparkContext.accumulator(0)
    real = seeding.settle_tile

    def counted(part, purge, tlen):
        log.add(1)
        assert len(part) < 1500
        return real(part, purge, tlen)

    monkeypatch.setattr(seeding, "settle_tile", counted)
    df = molecules(spark, types)
    got = result(seeding.parse_continuity_groups(df, "group_id", 5, 150, most=300))
    assert log.value > 20
    monkeypatch.setattr(seeding, "settle_tile", real)
    assert got == result(seeding.parse_continuity_groups(df, "group_id", 5, 150))


def test_no_rows(spark):
    assert seeding.parse_continuity_groups(molecules(spark, [(1, True, "L", 1, "R", 1, 1, 1)]).where("1 = 0"), "group_id").collect() == []
    assert np.array_equal(seeding.settle_tile(pd.DataFrame({"is_split": [True], "side1": ["L"], "pos1": [1], "side2": ["R"], "pos2": [1], "n": [1], "mapq": [1], "state": [0], "own": [True]}), 5, 762), [2])


def test_balanced_samples(spark):
    rows = [(i, k) for i, k in enumerate(["a"] * 50 + ["b"] * 7 + [None] * 20)]
    df = spark.createDataFrame(rows, "id int, k string")
    for like, most in ((None, 7), ("a", 50), ("b", 7)):
        got = ordered.balanced_sample(df, "k", "id", like).collect()
        assert {k: sum(r.k == k for r in got) for k in ("a", "b", None)} == {"a": min(50, most), "b": 7, None: min(20, most)}
        assert len({r.id for r in got}) == len(got)
    assert ordered.balanced_sample(df, "k", "id", "gone").collect() == [] and ordered.balanced_sample(df.limit(0), "k", "id").collect() == []
