"""Hand-worked cases, properties and plans of the core operators."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.functions import junctions as jx
from breakweave.functions import reads as rd
from breakweave.functions import sequences as sq
from breakweave.functions.analysis import lgamma
from breakweave.operators import graph, joins, models, ordered, seeding
from breakweave.operators.aggregates import fewest_alignments, independent_instances, shared_proper_endpoints
from breakweave.streaming import streams

c = F.col


def values(df, *columns):
    return sorted(tuple(r[k] for k in columns) for r in df.select(*columns).collect())


def test_gap_groups_chain_within_the_limit(spark):
    df = spark.createDataFrame([("k", 10, 1), ("k", 11, 2), ("k", 13, 3)], "k string, pos long, id long")
    assert values(ordered.gap_group(df, ["k"], "pos", 1, "g"), "pos", "g") == [(10, 0), (11, 0), (13, 1)]


def test_continuity_groups_at_fragment_size(spark):
    df = spark.createDataFrame([("k", 100, 5, 1), ("k", 800, 5, 2), ("k", 1600, 5, 3)], "k string, pos1 long, pos2 long, mol_id long")
    assert values(ordered.continuity_groups(df, ["k"], 762, 1), "mol_id", "group_id") == [(1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("pos2,node_class,want", [(101, 1, "P"), (102, 1, "L"), (100, 1, "D"), (1322, 0, "P"), (1323, 0, "L"), (-202, 0, "P"), (-203, 0, "D")])
def test_junction_types(spark, pos2, node_class, want):
    df = spark.createDataFrame([(1, "L", 100, 1, "R", pos2, node_class)], "a int, b string, c long, d int, e string, f long, g int")
    assert df.select(jx.junction_type(*[c(x) for x in "abcdefg"], 762, 151).alias("t")).first()["t"] == want


def test_coverage_breaks_skip_positions_without_net_change(spark):
    over = spark.createDataFrame([(1, 0, 10), (1, 5, 15)], "chrom int, start0 long, end1 long")
    assert values(ordered.coverage_breaks(over), "pos", "depth") == [(0, 1), (5, 2), (10, 1), (15, 0)]
    touch = spark.createDataFrame([(1, 0, 10), (1, 10, 20)], "chrom int, start0 long, end1 long")
    assert values(ordered.coverage_breaks(touch), "pos", "depth") == [(0, 1), (20, 0)]


def test_coverage_keeps_all_bases(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(1, 3)), int(a), int(a + rng.integers(1, 90_000))) for a in rng.integers(0, 400_000, 300)]
    steps = ordered.coverage_steps(spark.createDataFrame(rows, "chrom int, start0 long, end1 long"))
    assert steps.select(F.sum(c("depth") * (c("end1") - c("start0")))).first()[0] == sum(z - a for _, a, z in rows)


def test_junction_structure_and_alignment_ends(spark):
    one = spark.range(1)
    seq = "".join("ACGT"[i % 4] for i in range(100))
    r = one.select(*[v.alias(k) for k, v in jx.junction_structure(F.lit(seq), F.lit(100), F.lit(40), F.lit(55), F.lit(0)).items()]).first()
    assert (r["read_pos1"], r["read_pos2"], r["microhomology"], r["bases"]) == (60, 56, 5, seq[55:60])
    left, right = rd.clip_lengths(F.lit("5S10M3D20M"))
    r = one.select(rd.aln_end(F.lit(100), F.lit("5S10M3D20M")).alias("e"), left.alias("l"), right.alias("r")).first()
    assert (r["e"], r["l"], r["r"]) == (132, 5, 0)


def test_seed_matches(spark):
    schema = "k int, id long, is_split boolean, side1 string, pos1 long, side2 string, pos2 long"
    seeds = spark.createDataFrame([(1, 1, True, "L", 1000, "R", 9000), (2, 2, True, "R", 1000, "R", 9000)], schema)
    others = spark.createDataFrame(
        [(1, 11, True, "L", 1005, "R", 9000), (1, 12, True, "L", 1006, "R", 9000), (1, 13, False, "L", 990, "R", 9000), (1, 14, False, "L", 1006, "R", 9000), (2, 15, False, "R", 1010, "R", 9000)], schema
    )
    assert values(joins.seed_match(seeds, others, ["k"], 5, 762), "seed_id", "id") == [(1, 11), (1, 13), (2, 15)]


def test_independent_instances(spark):
    rows = [(1, "s", 1, 0, True)] * 2 + [(1, "s", 1, 0, False)] + [(1, "s", 2, 1, True)]
    df = spark.createDataFrame(rows, "k int, sample string, channel int, duplex int, is_canonical boolean")
    assert values(independent_instances(df, ["k"]), "k", "n_instances") == [(1, 3)]


def test_collapse_scales_the_tail(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "k int, i int, v long")
    assert values(ordered.collapse_bins(df, ["k"], "i", "v", 2), "window_n", "v") == [(0, 3.0), (1, 7.0), (2, 10.0)]


def test_shared_proper(spark):
    rows = [("e1", 1, "P"), ("e1", 2, "V"), ("e2", 2, "V"), ("e2", 3, "V"), ("e3", 4, "P"), ("e3", 2, "V")]
    assert values(shared_proper_endpoints(spark.createDataFrame(rows, "node string, mol_id int, mol_class string")), "mol_id", "shared_proper") == [(2, 2)]


def test_edge_types_with_insertion(spark):
    rows = [("D", 0, 30, "I"), ("D", 50, 30, "D"), ("I", 0, 30, "I"), ("T", 0, 30, "T")]
    df = spark.createDataFrame(rows, "k string, s int, i int, want string")
    assert df.where(jx.edge_type_with_insertion(c("k"), c("s"), c("i")) != c("want")).count() == 0


def test_canonical_form_is_stable(spark):
    df = spark.createDataFrame([(500, -300), (300, -500), (-7, 9), (4, 4)], "a long, b long")
    ok, x, y = jx.canonical_nodes(c("a"), c("b"))
    once = df.select(ok.alias("ok"), x.alias("a"), y.alias("b"))
    assert once.first()[:] == (False, 300, -500)
    ok, x, y = jx.canonical_nodes(c("a"), c("b"))
    assert once.where(~ok).count() == 0


def test_segments_break_at_unfusable_junctions(spark):
    rows = [(1, i, t, f) for i, (t, f) in enumerate([("A", None), ("J", True), ("A", None), ("J", False), ("A", None)])]
    df = spark.createDataFrame(rows, "read int, i int, edge_type string, fusable boolean")
    assert [r["segment_n"] for r in ordered.split_to_segments(df, "read", "i", "fusable").orderBy("i").collect()] == [1, 1, 1, None, 2]


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    assert values(graph.connected_components(pairs), "node", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(path).collect()} == {0}


def test_viterbi_single_row_is_null_and_ties_keep_the_lowest_state(spark):
    rows = [("a", 1, [0.0, -1.0]), ("b", 1, [-1.0, -1.0]), ("b", 2, [-1.0, -1.0]), ("c", 1, [-9.0, 0.0]), ("c", 2, None), ("c", 3, [-9.0, 0.0])]
    df = spark.createDataFrame(rows, "k string, i int, e array<double>")
    assert sorted(((r.k, r.i, r.state) for r in ordered.viterbi_cn(df, ["k"], "i", "e", 0.9).collect()), key=str) == [
        ("a", 1, None), ("b", 1, 0), ("b", 2, 0), ("c", 1, 1), ("c", 2, 1), ("c", 3, 1)]


def test_reverse_complement_is_an_involution(spark):
    df = spark.createDataFrame([("ACGTTGCA",), ("",), ("AAC",)], "s string")
    assert df.where(sq.reverse_complement(sq.reverse_complement(c("s"))) != c("s")).count() == 0


def test_lgamma_matches_python(spark):
    import math

    xs = [0.01, 0.5, 1.0, 2.5, 20.0, 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(c("x")).alias("g"))
    assert np.allclose([r["g"] for r in df.collect()], [math.lgamma(x) for x in xs], atol=1e-8)


def test_quadratic_fit_recovers_coefficients(spark):
    rows = [(1, float(x), 2.0 + 0.5 * x - 0.01 * x * x, 1.0 + x % 3) for x in range(30, 60)]
    r = models.quadratic_fit(spark.createDataFrame(rows, "k int, x double, y double, w double"), ["k"], "x", "y", "w").first()
    assert np.allclose([r["b0"], r["b1"], r["b2"]], [2.0, 0.5, -0.01], atol=1e-5)


def test_gap_groups_do_not_depend_on_row_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(p), i) for i, (k, p) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 5000, 200)))]
    schema = "k int, pos long, id long"
    one = values(ordered.gap_group(spark.createDataFrame(rows, schema), ["k"], "pos", 20, "g"), "id", "g")
    two = values(ordered.gap_group(spark.createDataFrame(rows[::-1], schema).repartition(7), ["k"], "pos", 20, "g"), "id", "g")
    assert one == two


def test_range_and_distance_joins_plan_no_nested_loop(spark):
    a = spark.range(100).selectExpr("cast(id % 3 as int) as chrom", "id * 10 as start0", "id * 10 + 15 as end1", "id")
    plans = [
        joins.interval_join(a, a.withColumnRenamed("id", "id2")),
        joins.distance_join(a, "id", ["chrom"], "start0", "end1", 20.0),
        joins.neighbours_within(a, "id", ["chrom"], "start0", 20),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    spans = spark.createDataFrame([], "chrom int, start0 long, end1 long")
    assert ordered.coverage_steps(spans).count() == 0
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# brute force


def brute_paths(log_p, persistence):
    """The best path of all, the first in order where several are best."""
    import itertools
    import math

    n, k = len(log_p), len(log_p[0])
    stay, move = math.log(persistence), math.log((1 - persistence) / max(1, k - 1))
    score = lambda p: sum(log_p[i][s] for i, s in enumerate(p)) + sum(stay if a == b else move for a, b in zip(p, p[1:]))
    return max(itertools.product(range(k), repeat=n), key=lambda p: (round(score(p), 9), [-x for x in reversed(p)]))


def test_viterbi_matches_all_paths():
    r = random.Random(1)
    for _ in range(150):
        n, k = r.randrange(2, 7), r.randrange(1, 5)
        log_p = [[math.log(r.uniform(0.01, 1)) for _ in range(k)] for _ in range(n)]
        p = r.choice([0.4, 0.7, 0.95])
        assert tuple(ordered.viterbi(np.array(log_p), p)) == brute_paths(log_p, p)


def test_viterbi_query_on_hand_cases(spark):
    likely = lambda s: [0.0 if i == s else -9.0 for i in range(3)]
    rows = [("a", i, likely(s), None) for i, s in enumerate([0, 0, 2, 2, 2])]
    rows += [("b", i, e, None) for i, e in enumerate([likely(1), None, likely(1)])]
    rows += [("c", 0, likely(1), None)]
    rows += [("d", i, likely(0), f) for i, f in enumerate([None, 2, None])]
    df = spark.createDataFrame(rows, "cell string, bin int, e array<double>, f int")
    found = {(x.cell, x.bin): x.state for x in ordered.viterbi_cn(df, ["cell"], "bin", "e", 0.9, "f").collect()}
    assert [found["a", i] for i in range(5)] == [0, 0, 2, 2, 2] and [found["b", i] for i in range(3)] == [1, 1, 1]
    assert found["c", 0] is None and [found["d", i] for i in range(3)] == [0, 2, 0]


def plain_seeds(types, purge, tlen):
    """Seeding by its definition, type by type."""

    def node(s, x, k):
        a, b, side = s[f"pos{k}"], x[f"pos{k}"], s[f"side{k}"]
        if s["is_split"] and x["is_split"]:
            return abs(a - b) <= purge
        if not s["is_split"] and not x["is_split"]:
            return abs(a - b) <= tlen
        d = a - b if s["is_split"] else b - a
        return -purge <= d <= tlen if side == "L" else -tlen <= d <= purge

    def match(s, x):
        total = abs(s["pos1"] - x["pos1"]) + abs(s["pos2"] - x["pos2"])
        return (s["is_split"] or not x["is_split"]) and node(s, x, 1) and node(s, x, 2) and total <= tlen

    order = sorted(range(len(types)), key=lambda i: (not types[i]["is_split"], -types[i]["n"], -types[i]["mapq"], types[i]["pos1"], types[i]["pos2"]))
    left, groups = set(order), []
    for s in order:
        if s in left:
            hit = {i for i in order if i == s or match(types[s], types[i])}
            left -= hit
            shared = [g for g in groups if any(types[i]["is_split"] for i in g & hit)]
            groups = [g for g in groups if g not in shared] + [hit.union(*shared)]
    return sorted((i, k) for k, g in enumerate(groups, 1) for i in g)


def test_seeding_matches_its_definition():
    import pandas as pd

    r = random.Random(2)
    for _ in range(200):
        span = r.choice([20, 200, 2000])
        sides = r.choice("LR"), r.choice("LR")
        keys = {(r.random() < 0.5, r.randrange(span), r.randrange(span)) for _ in range(r.randrange(1, 25))}
        types = [dict(is_split=s, side1=sides[0], pos1=a, side2=sides[1], pos2=b, n=r.randrange(1, 4), mapq=r.randrange(3)) for s, a, b in sorted(keys)]
        assert seeding.seed_group(pd.DataFrame(types), 5, 150) == plain_seeds(types, 5, 150)


def test_networks_match_their_definition(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(3)
    rows = [(k, q, r.randrange(1, 9)) for k in (1, 2) for q in {"".join(r.choices("AC", k=r.randrange(4, 8))) for _ in range(40)}]
    df = spark.createDataFrame(rows, "key int, seq string, n int")
    for limit, sensitivity, min_parent, add_rare in ((1, 0.0, 0, True), (2, 0.7, 0, True), (2, 0.5, 3, True), (1, 1.0, 4, False)):
        got = graph.parent_networks(df, "key", limit, sensitivity=sensitivity, min_parent=min_parent, add_rare=add_rare).collect()
        found = {(x.key, x.seq): (x.parent, x.distance) for x in got}
        assert len(found) == len(got) == len(rows)
        for key in (1, 2):
            mine = sorted(((n, len(q), q) for k, q, n in rows if k == key), reverse=True)
            parents = []
            for n, _, q in mine:
                near = [(edits(q, p), -m, -len(p), p) for m, p in parents if edits(q, p) <= limit]
                takes = [p for m, p in parents if edits(q, p) <= limit * (1 - sensitivity * n / m)]
                if n < min_parent:
                    assert found[key, q] == ((min(near)[3], min(near)[0]) if near and add_rare else (None, None)), q
                elif takes:
                    assert found[key, q] == (min(near)[3], min(near)[0]), q
                else:
                    parents.append((n, q))
                    assert found[key, q] == (q, 0)


@pytest.mark.parametrize("most", [1, 4, 36])
@pytest.mark.parametrize("limit", [1, 2, 3])
def test_pairs_of_sequences_by_deletions_and_by_pieces(spark, monkeypatch, most, limit):
    """Whatever lengths go by deletions, the pairs are those within ``limit`` edits, each once."""
    monkeypatch.setattr(graph, "MOST_DELETIONS", most)
    r = random.Random(limit)
    rows = [(k, q, r.randrange(1, 4)) for k in (1, 2) for q in {"".join(r.choices("ACG", k=r.randrange(1, 9))) for _ in range(60)}]
    x = spark.createDataFrame(rows, "key int, seq string, n int")
    got = [tuple(v) for v in graph._near_before(x, "key", limit).select("key", "seq", "n", "seq2", "n2", "distance").collect()]
    y = x.select("key", c("seq").alias("seq2"), c("n").alias("n2"))
    before = (c("n2") > c("n")) | (c("n2") == c("n")) & ((F.length("seq2") > F.length("seq")) | (F.length("seq2") == F.length("seq")) & (c("seq2") > c("seq")))
    want = x.join(y, "key").where(before).withColumn("distance", F.levenshtein("seq", "seq2")).where(c("distance") <= limit)
    want = want.select("key", "seq", "n", "seq2", "n2", "distance")
    assert len(got) == len(set(got)) and set(got) <= {tuple(v) for v in want.collect()}
    # sequences of at most ``limit`` letters have an empty piece, which finds none
    assert set(got) >= {tuple(v) for v in want.where(F.least(F.length("seq"), F.length("seq2")) > (limit if most == 1 else 0)).collect()}


def test_networks_broadcast_only_what_was_counted(spark):
    """Sequences are many times as large in memory as in the files by which Spark estimates them."""
    x = spark.createDataFrame([(1, "ACGT", 2), (1, "ACGA", 1)], "key int, seq string, n int")
    assert "Broadcast" not in graph._near_before(x, "key", 1)._jdf.queryExecution().executedPlan().toString()
    assert "merge" in joins.small(x, 1)._jdf.queryExecution().logical().toString()


def test_edges_of_crowded_places_are_as_many_as_rows(spark):
    """They connect what all pairs connect: copies, places within reach, nothing by nulls or across keys."""
    r = random.Random(4)
    rows = [(i, r.choice([1, 2, None]), r.choice([None, *range(0, 200, 9)]), r.choice([0, 4])) for i in range(300)] + [(1000 + i, 1, 5000, 7) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k int, x long, y long")
    edges = joins.near_edges(df, "id", ["k"], "x", "y", 20.0)
    pairs = joins.distance_join(df, "id", ["k"], "x", "y", 20.0).select(c("id1").alias("a"), c("id2").alias("b"))
    assert edges.where("a >= 1000").count() == 399 and pairs.where("a >= 1000").count() == 400 * 399 // 2
    assert values(graph.connected_components(edges), "node", "component") == values(graph.connected_components(pairs), "node", "component")


@pytest.mark.parametrize("size", [1, 10, joins.BUCKET])
def test_asof_forward_in_buckets(spark, size):
    r = random.Random(size)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, *range(-50, 90)])) for i in range(200)]
    right = [(k, p, v) for k in ("a", "c", None) for p, v in [(-20, 1), (-3, None), (0, 2), (7, 3), (40, 4)]]
    got = joins.asof_forward(spark.createDataFrame(left, "id int, k string, p long"), spark.createDataFrame(right, "k string, q long, v int"), ["k"], "p", "q", "v", size)
    want = {i: next((v for rk, q, v in right if rk == k == "a" and p is not None and q >= p), None) for i, k, p in left}
    assert {x.id: x.v for x in got.collect()} == want and got.columns == ["id", "k", "p", "v"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_fewest_alignments_by_a_given_order(spark):
    """Ids beyond a million weigh more than a base in the order of the query; nulls have no place in it."""
    df = spark.createDataFrame([(1, 1_500_000, 1), (1, 2, 2), (1, 1, None), (2, 9, None)], "k int, id long, n long")
    plain = fewest_alignments(df, ["k"], "id", "n")
    assert values(plain.where("k = 1"), "k", "id", "n") == [(1, 1_500_000, 1)]
    got = fewest_alignments(df, ["k"], "id", "n", c("n") * 1000000 + c("id"))
    assert {r.k: (r.id, r.n) for r in got.collect()} == {1: (2, 1), 2: (None, None)}


def test_seeds_meet_only_what_is_near_at_both_ends(spark):
    """The first ends are at one locus, the second ones far from each other: cells of both keep them apart."""
    df = spark.range(40).selectExpr("id", "id % 2 = 0 as is_split", "'k' as k", "'L' as side1", "id % 3 as pos1", "'R' as side2", "id * 10000 as pos2")
    found = joins.seed_match(df, df, ["k"], 5, 762)
    assert values(found, "seed_id", "id") == [(i, i) for i in range(40)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__c2" in next(line for line in plan.splitlines() if "Join" in line)


def test_adapters_match_a_plain_regression(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, float(y), r.gauss(2.0 * y, 1), r.gauss(-y, 1), r.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id int, label double, a double, b double, c double")
    model = models.adapter_classifier(df, ["a", "b", "c"], "label", max_iter=100)
    got = dict(model.transform(df).select("id", F.col("prediction").cast("int")).collect())
    x = np.array([r[2:] for r in rows])
    y = np.array([r[1] for r in rows])
    x = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(len(x))])
    w, ridge = np.zeros(4), 0.001 * len(y) * np.diag([1.0, 1, 1, 0])
    for _ in range(50):  # Newton steps of the same penalised likelihood
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    margin = x @ w
    assert all(got[i] == int(m > 0) for i, m in enumerate(margin) if abs(m) > 0.02)
    assert np.mean([got[i] == y[i] for i in range(len(y))]) > 0.8


def test_left_interval_join_keeps_rows(spark):
    left = [(1, 0, 40_000), (1, 5, 5), (1, 100, 200), (1, 100, 200), (2, 0, 10), (None, 0, 10), (1, None, 3)]
    right = [(1, 150, 160, "a"), (1, 39_999, 50_000, "b"), (1, 155, 155, "c")]
    a = spark.createDataFrame(left, "chrom int, start0 int, end1 int")
    b = spark.createDataFrame(right, "chrom int, start0 int, end1 int, name string")
    hits = lambda x: [r[3] for r in right if x[0] == r[0] and None not in x and x[1] < x[2] and r[1] < r[2] and x[1] < r[2] and x[2] > r[1]]
    rows = lambda how: sorted((tuple(r)[:3] + ((r.name,) if how == "left" else ()) for r in joins.interval_join(a, b, how=how).collect()), key=str)
    assert rows("left") == sorted((x + (n,) for x in left for n in hits(x) or [None]), key=str)
    assert rows("left_semi") == sorted((x for x in left if hits(x)), key=str)
    assert rows("left_anti") == sorted((x for x in left if not hits(x)), key=str)


def test_depth_integral_matches_positions(spark):
    r = random.Random(5)
    spans = [(c, a, a + r.randrange(1, 300)) for c in (1, 2) for a in (r.randrange(0, 2000) for _ in range(80))]
    points = [(c, p) for c in (1, 2, 3) for p in range(0, 2500, 37)]
    found = ordered.depth_integral(
        spark.createDataFrame(points, "chrom int, pos long"), spark.createDataFrame(spans, "chrom int, start0 long, end1 long"), size=256
    ).collect()
    assert {(x.chrom, x.pos): x.area for x in found} == {(c, p): sum(max(0, min(p, z) - a) for k, a, z in spans if k == c) for c, p in points}
    df = spark.createDataFrame([(1, 3), (1, 90), (1, 1000), (2, 5)], "chrom int, pos long")
    assert {(x.chrom, x.pos): x.n for x in ordered.next_position(df, "chrom", "pos", "n", 64).collect()} == {(1, 3): 90, (1, 90): 1000, (1, 1000): None, (2, 5): None}


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 600)] + [(1000, 1001 + i) for i in range(300)] + [(5000 + i, 5000 + r.randrange(200)) for i in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b int")).collect()}
    assert found == {x: find(x) for x in list(root)}


def test_upserts_are_compacted(spark, tmp_path):
    write = streams.upsert_counts(f"file://{tmp_path}/t", ["k"], every=3)
    for i in range(8):
        write(spark.createDataFrame([(i % 2, i), (7, 10 * i)], "k int, n long"), i)
    write(spark.createDataFrame([(1, 7), (7, 70)], "k int, n long"), 7)  # a batch that is repeated
    assert {r.k: r.n for r in streams.latest(spark, f"file://{tmp_path}/t", ["k"]).collect()} == {0: 6, 1: 7, 7: 70}
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["all-2", "all-5", "batch-0", "batch-1", "batch-3", "batch-4", "batch-6", "batch-7"]


def test_scratch_tables_go_with_their_scope(spark):
    from breakweave.plans.scratch import materialize, scratch_tables

    with scratch_tables(spark):
        with scratch_tables(spark):
            inner = materialize(spark.range(3), "test-inner").inputFiles()
            kept = materialize(spark.range(4), "test-kept", result=True)
        assert kept.count() == 4 and not any(os.path.exists(f.removeprefix("file://")) for f in inner)
        files = kept.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


@pytest.mark.parametrize("block, pairs", [(3, 10), (joins.BLOCK_ROWS, joins.PAIRS_A_TASK)])
@pytest.mark.parametrize("metric", ["euclid", "manhattan"])
def test_rows_are_paired_by_places(spark, monkeypatch, block, pairs, metric):
    """All pairs come out, as often as rows repeat; rows meet only those of places that were found near."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", block)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", pairs)
    r = random.Random(8)
    at = [None, math.nan, -0.0, 0.0, 12.5, -7.5, 19.9, 20.0, 33.0, -40.0]
    rows = [(r.choice([None, *range(120)]), r.choice([1, 2, None]), r.choice(at), r.choice(at)) for _ in range(250)]
    rows += [(1000 + i, 1, 500.5, -3.0) for i in range(20)] + [(2000 + i, 1, 515.5, 12.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k int, x double, y double")
    apart = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3]) if metric == "euclid" else abs(a[2] - b[2]) + abs(a[3] - b[3])
    whole = [v for v in rows if None not in v]
    want = [(a[1], a[0], b[0], round(apart(a, b), 6)) for a in whole for b in whole if a[1] == b[1] and a[0] < b[0] and apart(a, b) <= 20]
    got = joins.distance_join(df, "id", ["k"], "x", "y", 20.0, metric, digits=6)
    assert got.columns == ["k", "id1", "id2", "distance"] and values(got, *got.columns) == sorted(want)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    assert "__block" in last and "__p2" in last and "SQRT" not in last and "abs" not in last


@pytest.mark.parametrize("most", [0, 3])
def test_neighbours_are_paired_by_places(spark, monkeypatch, most):
    """Crowded positions are compared once, and their rows go in blocks; with no reach, rows of one position are left."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 3)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 10)
    r = random.Random(23)
    rows = [(r.choice([None, *range(200)]), r.choice(["a", "b", None]), r.choice([None, *range(-9, 9)])) for _ in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, pos long")
    whole = [v for v in rows if None not in v]
    want = [(a[1], a[0], b[0]) for a in whole for b in whole if a[1] == b[1] and a[0] < b[0] and abs(a[2] - b[2]) <= most]
    got = joins.neighbours_within(df, "id", ["k"], "pos", most)
    assert got.columns == ["k", "id1", "id2"] and values(got, *got.columns) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" in next(line for line in plan.splitlines() if "Join" in line)


def test_shuffle_files_go_when_a_table_is_written(spark):
    """They stayed until the driver collected its garbage, so the disk of a long query held all of them."""
    import time
    from pathlib import Path

    from breakweave.plans.scratch import FILE_CLEANUP, materialize

    def shuffled():
        return {p.name for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}

    before, setting = shuffled(), spark.conf.get(FILE_CLEANUP, "false")
    out = materialize(spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffles")
    for _ in range(40):
        if not shuffled() - before:
            break
        time.sleep(0.25)
    assert not shuffled() - before
    assert spark.conf.get(FILE_CLEANUP, "false") == setting
    assert out.count() == 7


def test_seeds_are_dealt_only_to_cells_that_hold_others(spark, monkeypatch):
    """Nine copies of every seed went through the shuffle. Here most cells around are empty, and a full one has blocks."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 7)
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 500)
    r = random.Random(3)
    schema = "id long, is_split boolean, k string, side1 string, pos1 long, side2 string, pos2 long"
    draw = lambda i: (i, r.random() < 0.4, "k", r.choice("LR"), 762 * 50 + r.randrange(40), r.choice("LR"), 762 * 90 + r.randrange(800))
    rows = [draw(i) for i in range(120)] + [(999, None, "k", None, 762 * 50, "L", 762 * 90), (1000, True, "k", "L", None, "L", 5)]
    df = spark.createDataFrame(rows, schema)
    found = joins.seed_match(df, df, ["k"], 5, 762)

    def half(split, o_split, side, a, b):
        if split and o_split:
            return abs(a - b) <= 5
        if not split and not o_split:
            return abs(a - b) <= 762
        e = a - b if split else b - a
        return -5 <= e <= 762 if side == "L" else -762 <= e <= 5

    full = rows[:120]
    want = [(s[0], o[0]) for s in full for o in full if (s[1] or not o[1]) and abs(s[4] - o[4]) + abs(s[6] - o[6]) <= 762 and half(s[1], o[1], s[3], s[4], o[4]) and half(s[1], o[1], s[5], s[6], o[6])]
    known = {x[0] for x in full}
    got = [tuple(x) for x in found.collect()]
    assert sorted(x for x in got if set(x) <= known) == sorted(want) and len(want) > 1000
    assert not any(1000 in x for x in got)
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array" not in plan  # rows are not multiplied by nine


def test_rows_of_a_place_are_joined_as_lists(spark, monkeypatch):
    """One row a block of a place meets those of near places, where every row did; blocks of a place meet once."""
    monkeypatch.setattr(joins, "BLOCK_ROWS", 5)
    counts, write = {}, joins.materialize

    def spy(df, name, **more):
        out = write(df, name, **more)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(joins, "materialize", spy)
    r = random.Random(9)
    rows = [(i, r.choice("ab"), float(r.randrange(3)), float(r.randrange(4)) * 2) for i in range(400)]
    df = spark.createDataFrame([*rows, rows[7], rows[7]], "id long, k string, x double, y double")
    got = sorted(tuple(x) for x in joins.distance_join(df, "id", ["k"], "x", "y", 2.0).select("id1", "id2", "distance").collect())
    both = [*rows, rows[7], rows[7]]
    want = [(a[0], b[0], math.dist(a[2:], b[2:])) for a in both for b in both if a[0] < b[0] and a[1] == b[1] and math.dist(a[2:], b[2:]) <= 2]
    assert got == sorted(want) and len(want) > 10_000
    assert counts["pair-places"] == 24 and counts["pair-rows"] <= 150
    got = sorted(tuple(x) for x in joins.neighbours_within(df, "id", ["k"], "x", 1).select("id1", "id2").collect())
    assert got == sorted((a[0], b[0]) for a in both for b in both if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 1)
