"""Interval, distance, as-of and list joins, each turned into an equality join on buckets or cells.

Spark plans a bare range predicate as a nested loop. Here one side is spread over the buckets it
covers, the join is on (key, bucket), and each pair is kept in one bucket only, so nothing needs a
later deduplication. Adaptive execution may split a crowded bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.scratch import materialize

#: Bases of a bucket; intervals of about this length fall into one or two.
BUCKET = 16_384
#: Sides of a tile of places, in steps.
TILE_STEPS = 64
#: Rows of a place that are held at once.
BLOCK_ROWS = 8_192
#: Pairs of rows of equal cells for which there is one task, and the most tasks.
PAIRS_A_TASK, MOST_TASKS = 2e7, 4_000
#: Tables are broadcast up to so many rows, counted before.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count finds it small, else for a merge join: Spark's own estimate is the
    size of files, and short strings and runs of numbers are many times as large on the driver."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def buckets(first: Column, last: Column, size: int = BUCKET) -> Column:
    return F.sequence(F.floor(first / size), F.floor(last / size))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str = "chrom",
    start: str = "start0",
    end: str = "end1",
    right_start: str = "start0",
    right_end: str = "end1",
    how: str = "inner",
    size: int = BUCKET,
    suffix: str = "_r",
) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap; right columns that clash get ``suffix``.

    ``how`` is inner, left, left_semi or left_anti. Both sides are spread over buckets; an inner pair
    counts in the bucket of its greater start only. Left rows are numbered, and one that no bucket has
    a partner for comes once, whether its interval is valid or not. Equal rows stay as many.
    """
    r = right.select(*[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns])
    name = lambda c: c + suffix if c in left.columns else c
    rk, rs, re_ = name(key), name(right_start), name(right_end)
    rb = r.where(F.col(rs) < F.col(re_)).withColumn("__rb", F.explode(buckets(F.col(rs), F.col(re_) - 1, size)))
    same = (F.col(key) == F.col(rk)) & (F.col("__b") == F.col("__rb")) & (F.col(start) < F.col(re_)) & (F.col(end) > F.col(rs))
    once = F.floor(F.greatest(F.col(start), F.col(rs)) / size) == F.col("__b")
    if how == "inner":
        lb = left.where(F.col(start) < F.col(end)).withColumn("__b", F.explode(buckets(F.col(start), F.col(end) - 1, size)))
        return lb.join(rb, same & once).drop("__b", "__rb")
    covered = F.when(F.col(start) < F.col(end), buckets(F.col(start), F.col(end) - 1, size)).otherwise(F.array(F.lit(None).cast("long")))
    lb = left.withColumns({"__id": F.monotonically_increasing_id(), "__n": F.size(covered)}).withColumn("__b", F.explode(covered))
    if how == "left_semi":
        return lb.join(rb, same, "left_semi").dropDuplicates(["__id"]).select(*left.columns)
    if how == "left_anti":
        return _in_no_bucket(lb.join(rb, same, "left_anti"), left.columns)
    found = materialize(lb.join(rb, same & once, "left"), "interval-join")
    lone = _in_no_bucket(found.where("__rb is null"), left.columns)
    return found.where("__rb is not null").drop("__id", "__n", "__b", "__rb").unionByName(lone, allowMissingColumns=True)


def _in_no_bucket(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (one a bucket, without a partner there) that are without one in all their buckets."""
    x = rows.groupBy("__id").agg(F.count("*").alias("__k"), F.first("__n").alias("__n"), F.first(F.struct(*columns)).alias("__row"))
    return x.where("__k = __n").select("__row.*")


def interval_flag(left: DataFrame, right: DataFrame, out: str, key: str = "chrom", start: str = "start0", end: str = "end1") -> DataFrame:
    """``left`` with a boolean: some right interval overlaps. ``left`` rows are unique by key, start and end."""
    hits = interval_join(left.select(key, start, end).distinct(), right.select(key, F.col("start0"), F.col("end1")), key, start, end, how="inner")
    hits = hits.select(key, start, end).distinct().withColumn(out, F.lit(True))
    return left.join(hits, [key, start, end], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def position_in_target(
    df: DataFrame, targets: DataFrame, chrom: str, pos: str, padding: int = 0, prefix: str = "", size: int = BUCKET
) -> DataFrame:
    """``df`` with the name of the region a 1-based position falls in, its index there, and whether it is in the padding only.

    Where regions overlap the one that starts first is taken: regions are cut to the bases that no
    earlier one covers, so each position matches one row at most. Null names mark positions outside.
    """
    w = Window.partitionBy("chrom").orderBy("from0", "name").rowsBetween(Window.unboundedPreceding, -1)
    t = targets.select("name", "chrom", "start0", "end1", (F.col("start0") - padding).alias("from0"), (F.col("end1") + padding).alias("to1"))
    t = t.withColumn("from0", F.greatest("from0", F.coalesce(F.max("to1").over(w), F.col("from0")))).where("from0 < to1")
    t = t.withColumn("__tb", F.explode(buckets(F.col("from0"), F.col("to1") - 1, size))).withColumnRenamed("chrom", "__tc")
    zero = F.col(pos) - 1
    cond = (F.col(chrom) == F.col("__tc")) & (F.floor(zero / size) == F.col("__tb")) & (zero >= F.col("from0")) & (zero < F.col("to1"))
    x = df.join(small(t), cond, "left")
    inside = (zero >= F.col("start0")) & (zero < F.col("end1"))
    return x.select(
        *[df[c] for c in df.columns],
        F.col("name").alias(prefix + "name"),
        F.when(F.col("name").isNotNull(), F.col(pos) - F.col("start0")).alias(prefix + "index"),
        F.when(F.col("name").isNotNull(), ~inside).otherwise(False).alias(prefix + "adjacent"),
    )


def place_pairs(df: DataFrame, id_col: str, keys: list[str], x: str, y: str, most: float) -> DataFrame:
    """``id1 < id2`` for places of equal keys that lie within ``most`` of each other: rows of which hardly any
    share a place, as nothing is collapsed here (:func:`distance_join`).

    Places are dealt to square cells of that side; each looks into its own cell and four of the eight around
    it, so that a pair of cells meets once.
    """
    cell = lambda v: F.floor(F.col(v) / most)
    side = lambda k: [F.col(id_col).alias(f"__i{k}"), F.col(x).alias(f"__x{k}"), F.col(y).alias(f"__y{k}")]
    near = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in _half_around(2)])
    a = df.select(*keys, *side(1), cell(x).alias("__cx"), cell(y).alias("__cy"), F.explode(near).alias("__d"))
    own = (F.col("__d.x") == 0) & (F.col("__d.y") == 0)
    a = a.select(*keys, "__i1", "__x1", "__y1", (F.col("__cx") + F.col("__d.x")).alias("__cx"), (F.col("__cy") + F.col("__d.y")).alias("__cy"), own.alias("__own"))
    b = df.select(*keys, *side(2), cell(x).alias("__cx"), cell(y).alias("__cy"))
    dx, dy = F.col("__x1") - F.col("__x2"), F.col("__y1") - F.col("__y2")
    differ = F.when(F.col("__own"), F.col("__i1") < F.col("__i2")).otherwise(F.col("__i1") != F.col("__i2"))
    pairs = a.join(b, [*keys, "__cx", "__cy"]).where(differ).where(F.sqrt(dx * dx + dy * dy) <= most)
    return pairs.select(*keys, F.least("__i1", "__i2").alias("id1"), F.greatest("__i1", "__i2").alias("id2"))


def _half_around(axes: int) -> list[tuple[int, ...]]:
    """A cell itself and half of the cells around it, as steps along the axes."""
    return [d for d in product((-1, 0, 1), repeat=axes) if d >= (0,) * axes]


def _row_pairs(df: DataFrame, id_col: str, keys: list[str], at: dict[str, str], most: float, distance: Column, digits: int | None = None) -> DataFrame:
    """``id1 < id2, distance`` of rows of equal keys whose ``distance`` is at most ``most``, where it is no less than
    the distance along any axis. ``at`` names the columns of a place; ``distance`` reads them with 1 and 2 behind.

    Places are compared, by cells: each looks into its own and half of those around it. Rows then meet the rows
    of places known to be near, so that every pair formed is a result, but for the halves of blocks that meet
    themselves. Rows of a place go as lists of about ``BLOCK_ROWS``, which bounds what a task holds at once, so
    that lists are joined and pairs only unfolded; tasks are as many as the pairs ask for.
    """
    axes, cells = list(at), [f"__c{k}" for k in range(len(at))]
    rows = df.select(*keys, *[F.col(c).alias(v) for v, c in at.items()], F.col(id_col).alias("__i"))
    rows = rows.where(reduce(and_, [F.col(c).isNotNull() for c in rows.columns]))
    places = rows.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", F.monotonically_increasing_id())
    places = materialize(places.withColumns({c: F.floor(F.col(v) / (most or 1)) for c, v in zip(cells, axes)}), "pair-places")
    crowd = places.groupBy(*keys, *cells).agg(F.sum(F.col("__n").cast("double")).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    tasks = math.ceil((crowd or 0) / PAIRS_A_TASK)
    tasks = [min(MOST_TASKS, max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))] if tasks > 1 else []

    steps = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cells, d)]) for d in _half_around(len(cells))])
    one = places.select(*keys, *[F.col(v).alias(f"{v}1") for v in axes], *cells, F.col("__p").alias("__p1"), F.explode(steps).alias("__d"))
    own = reduce(and_, [F.col(f"__d.{c}") == 0 for c in cells])
    one = one.withColumns({**{c: F.col(c) + F.col(f"__d.{c}") for c in cells}, "__own": own}).drop("__d")
    blocks = F.ceil(F.col("__n") / BLOCK_ROWS).cast("int").alias("__blocks")
    two = places.select(*keys, *[F.col(v).alias(f"{v}2") for v in axes], *cells, F.col("__p").alias("__p2"), blocks)
    near = one.join(two.hint("merge"), [*keys, *cells]).where(~F.col("__own") | (F.col("__p1") <= F.col("__p2")))
    near = near.withColumn("distance", distance).where(F.col("distance") <= most)
    kept = F.col("distance") if digits is None else F.round("distance", digits)
    near = near.select(*keys, "__p1", "__p2", "__blocks", kept.alias("distance"))

    held = rows.join(places.select(*keys, *axes, "__p", blocks).hint("merge"), [*keys, *axes])
    held = held.groupBy("__p", F.pmod(F.hash("__i"), "__blocks").alias("__block")).agg(F.collect_list("__i").alias("__l"))
    held = materialize(held, "pair-rows")
    left = held.select(F.col("__p").alias("__p1"), F.col("__block").alias("__block1"), F.col("__l").alias("__l1")).join(near.hint("merge"), "__p1")
    same = F.col("__p1") == F.col("__p2")
    # blocks of a place that meets itself: each two once
    first = F.when(same, F.col("__block1")).otherwise(0)
    to = F.explode(F.sequence(first, F.col("__blocks") - 1)).alias("__block")
    left = left.select(*keys, "__p2", to, "__l1", same.alias("__same"), "__block1", "distance")
    left = left.select(*keys, "__p2", "__block", "__l1", (F.col("__same") & (F.col("__block") == F.col("__block1"))).alias("__own"), "distance")
    right = held.select(F.col("__p").alias("__p2"), "__block", F.col("__l").alias("__l2"))
    on = ["__p2", "__block"]
    met = left.repartition(*tasks, *on).join(right.repartition(*tasks, *on).hint("merge"), on)
    met = met.select(*keys, F.explode("__l1").alias("__i1"), "__l2", "__own", "distance").select(*keys, "__i1", F.explode("__l2").alias("__i2"), "__own", "distance")
    differ = F.when(F.col("__own"), F.col("__i1") < F.col("__i2")).otherwise(F.col("__i1") != F.col("__i2"))
    return met.where(differ).select(*keys, F.least("__i1", "__i2").alias("id1"), F.greatest("__i1", "__i2").alias("id2"), "distance")


def distance_join(
    df: DataFrame, id_col: str, keys: list[str], x: str, y: str, most: float, metric: str = "euclid", digits: int | None = None
) -> DataFrame:
    """``id1 < id2, distance`` for rows of equal keys whose (x, y) lie within ``most`` of each other, all of them.
    Distances are rounded to ``digits``, if given, after they are compared."""
    dx, dy = F.col("__x1") - F.col("__x2"), F.col("__y1") - F.col("__y2")
    d = F.sqrt(dx * dx + dy * dy) if metric == "euclid" else F.abs(dx) + F.abs(dy)
    return _row_pairs(df, id_col, keys, {"__x": x, "__y": y}, most, d, digits)


def near_edges(df: DataFrame, id_col: str, keys: list[str], x: str, y: str, most: float) -> DataFrame:
    """``a, b``: edges that connect what the pairs of :func:`distance_join` connect, for components.

    Rows at one place are all linked to the least of them, and only these are paired: as many edges as rows
    and pairs of places, however many rows a place has.
    """
    known = df.select(F.col(id_col).alias("b"), *keys, x, y).where(" and ".join(f"`{v}` is not null" for v in ("b", *keys, x, y)))
    places = known.groupBy(*keys, x, y).agg(F.min("b").alias("a"))
    copies = known.join(places.hint("merge"), [*keys, x, y]).where(F.col("a") != F.col("b")).select("a", "b")
    pairs = place_pairs(places, "a", keys, x, y, most)
    return copies.unionByName(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")))


def _chained(tile: np.ndarray, x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """For each row the first row of its chain: rows of one tile, each step within ``most``. Null places are NaN."""
    order = np.lexsort((y, x, tile))
    t, px, py = tile[order], x[order], y[order]
    fresh = np.ones(len(t), bool)
    fresh[1:] = ~((t[1:] == t[:-1]) & (px[1:] == px[:-1]) & (py[1:] == py[:-1]))
    place, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    t, px, py = t[first], px[first], py[first]
    root, i, k = np.arange(len(first)), np.arange(len(first)), 0
    while len(i):
        k += 1
        i = i[i + k < len(first)]
        i = i[(t[i + k] == t[i]) & (px[i + k] - px[i] <= most)]
        dx, dy = px[i + k] - px[i], py[i + k] - py[i]
        a = i[np.sqrt(dx * dx + dy * dy) <= most]
        b = a + k
        while len(a):  # the greater root goes below the lesser, until all pairs are of one root
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            np.minimum.at(root, high, low)
            while not np.array_equal(root, root[root]):
                root = root[root]
            a, b = a[root[a] != root[b]], b[root[a] != root[b]]
    out = np.empty(len(tile), np.int64)
    out[order] = order[first[root[place]]]
    return out


def near_places(rows: DataFrame, keys: list[str], x: str, y: str, most: float, steps: int = TILE_STEPS) -> DataFrame:
    """``rows`` with ``__x, __y``: one place (x, y) for all that steps of at most ``most`` reach in the same keys.

    Rows are dealt to square tiles and chained within them, many tiles to a task; only chains that have places
    within a step of a tile's edge are then paired and contracted as a graph. A row with a null in its key or
    place stands for itself.
    """
    from .graph import connected_components

    size, tile = most * steps, [*keys, "__tx", "__ty"]
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([*rows.schema.fields, StructField("__x", kinds[x]), StructField("__y", kinds[y])])
    dealt = rows.withColumns({"__tx": F.floor(F.col(x) / size), "__ty": F.floor(F.col(y) / size)})
    own = rows.columns

    def chained(part: pa.Table, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = [part.column(c).cast(pa.float64()).to_numpy() for c in (x, y)]
        first = pa.array(_chained(number, *at, most))
        columns = [*(part.column(c) for c in own), *(part.column(c).take(first) for c in (x, y))]
        yield from pa.table(columns, names=[*own, "__x", "__y"]).combine_chunks().to_batches()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles come one after another; the last one of a batch may go on in the next."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            fresh = np.zeros(part.num_rows, bool)
            for c in tile:
                codes = part.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= codes[1:] != codes[:-1]
            number = np.cumsum(fresh)
            last = int(np.searchsorted(number, number[-1]))
            if last:
                yield from chained(part.slice(0, last).combine_chunks(), number[:last])
            held = part.slice(last)
        if held is not None:
            yield from chained(held.combine_chunks(), np.zeros(held.num_rows, np.int64))

    known = materialize(dealt.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(label, schema), "near-places")
    apart = lambda v: F.floor((F.col(v) - most) / size) != F.floor((F.col(v) + most) / size)
    edge = known.where(apart(x) | apart(y)).select(*keys, x, y, F.struct(*keys, "__x", "__y").alias("__node")).distinct()
    pairs = place_pairs(edge, "__node", keys, x, y, most).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    joined = connected_components(pairs).where("node <> component")
    to = joined.select(*[F.col("node")[c].alias(c) for c in (*keys, "__x", "__y")], F.col("component")["__x"].alias("__x2"), F.col("component")["__y"].alias("__y2"))
    out = known.join(small(to), [*keys, "__x", "__y"], "left")
    moved = F.col("__x2").isNotNull()
    return out.select(*own, F.when(moved, F.col("__x2")).otherwise(F.col("__x")).alias("__x"), F.when(moved, F.col("__y2")).otherwise(F.col("__y")).alias("__y"))


def neighbours_within(df: DataFrame, id_col: str, keys: list[str], pos: str, most: int) -> DataFrame:
    """``id1, id2``: ordered pairs of rows of equal keys whose positions lie within ``most``."""
    return _row_pairs(df, id_col, keys, {"__x": pos}, most, F.abs(F.col("__x1") - F.col("__x2"))).drop("distance")


def fill_shared_proper(molecules: DataFrame, counts: DataFrame, id_col: str = "mol_id") -> DataFrame:
    return molecules.join(counts, id_col, "left").withColumn("shared_proper", F.coalesce("shared_proper", F.lit(0)))


def outer_clip_evidence(clips: DataFrame, references: DataFrame) -> DataFrame:
    """Clips whose node is a clipped reference node: one-sided molecules with the other end inferred.

    clips: ``node, mol_id, sample, clip_len``; references: ``node, node_n, sv_id, other_node``.
    """
    x = clips.join(references, "node")
    first = F.col("node_n") == 1
    return x.select(
        "sv_id",
        "mol_id",
        "sample",
        F.when(first, F.col("node")).otherwise(F.col("other_node")).alias("node1"),
        F.when(first, F.col("other_node")).otherwise(F.col("node")).alias("node2"),
        F.when(first, F.col("clip_len")).otherwise(0).alias("clip_len1"),
        F.when(first, 0).otherwise(F.col("clip_len")).alias("clip_len2"),
    )


def seed_match(seeds: DataFrame, others: DataFrame, keys: list[str], purge: int, max_tlen: int) -> DataFrame:
    """``seed_id, id`` of the junction types that match a seed on both sides.

    Columns of both: ``id, is_split, side1, pos1, side2, pos2``. Two splits lie within ``purge``, two
    gaps within ``max_tlen``; a gap lies on the inner side of a split, within ``max_tlen``, or within
    ``purge`` beyond it. The two distances sum to ``max_tlen`` at most, and no split matches a gap
    seed. That sum bounds both positions, so rows meet in square cells of that width: a seed goes only to those cells
    around its own that hold others, once for each block of about ``BLOCK_ROWS`` of these, and tasks are as many as
    the pairs ask for. Rows of one form and place go as a list, and places are compared, not rows. A null id, as a
    null place, matches nothing.
    """
    cells = {f"__c{k}": F.floor(F.col(f"pos{k}") / max_tlen) for k in (1, 2)}
    at = [*keys, *cells]
    s = seeds.withColumns(cells).select(*at, *[F.col(c).alias("s_" + c) for c in ("id", "is_split", "pos1", "pos2")], *[(F.col(c) == "L").alias("s_" + c) for c in ("side1", "side2")])
    o = others.withColumns(cells).select(*at, "id", "is_split", "pos1", "pos2")
    blocks = F.ceil(F.col("__n") / BLOCK_ROWS).cast("int").alias("__blocks")
    held = materialize(o.groupBy(*at).agg(F.count(F.lit(1)).alias("__n")).select("*", blocks), "seed-cells")
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in product((-1, 0, 1), repeat=2)])
    many = s.withColumnsRenamed({"__c1": "__s1", "__c2": "__s2"}).groupBy(*keys, "__s1", "__s2").agg(F.count(F.lit(1)).alias("__m"))
    many = materialize(many, "seed-counts")
    asked = many.withColumn("__d", F.explode(around)).withColumns({f"__c{k}": F.col(f"__s{k}") + F.col(f"__d.{d}") for k, d in ((1, "x"), (2, "y"))})
    near = asked.join(small(held), at).select(*at, "__s1", "__s2", "__blocks", (F.col("__m") * F.col("__n")).alias("__pairs"))
    near = materialize(near, "seed-near")
    tasks = math.ceil((near.agg(F.sum(F.col("__pairs").cast("double"))).first()[0] or 0) / PAIRS_A_TASK)
    tasks = [min(MOST_TASKS, max(tasks, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))))] if tasks > 1 else []

    def node(k: str) -> Column:
        delta = F.when(F.col("s_is_split"), F.col(f"s_pos{k}") - F.col(f"pos{k}")).otherwise(F.col(f"pos{k}") - F.col(f"s_pos{k}"))
        half = F.when(F.col(f"s_side{k}"), delta.between(-purge, max_tlen)).otherwise(delta.between(-max_tlen, purge))
        apart = F.abs(F.col(f"s_pos{k}") - F.col(f"pos{k}"))
        return (
            F.when(F.col("s_is_split") & F.col("is_split"), apart <= purge).when(~F.col("s_is_split") & ~F.col("is_split"), apart <= max_tlen).otherwise(half)
        )

    total = F.abs(F.col("s_pos1") - F.col("pos1")) + F.abs(F.col("s_pos2") - F.col("pos2"))
    ok = (F.col("s_is_split") | ~F.col("is_split")) & node("1") & node("2") & (total <= max_tlen)
    on = [*at, "__block"]
    form = ["s_is_split", "s_side1", "s_side2", "s_pos1", "s_pos2"]
    lists = s.withColumnsRenamed({"__c1": "__s1", "__c2": "__s2"}).join(small(many), [*keys, "__s1", "__s2"])
    lists = lists.groupBy(*keys, "__s1", "__s2", *form, F.pmod(F.hash("s_id"), F.ceil(F.col("__m") / BLOCK_ROWS).cast("int")).alias("__part"))
    left = lists.agg(F.collect_list("s_id").alias("s_ids")).join(small(near), [*keys, "__s1", "__s2"])
    left = left.select(*at, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"), *form, "s_ids")
    right = o.join(small(held), at).groupBy(*at, F.pmod(F.hash("id"), "__blocks").alias("__block"), "is_split", "pos1", "pos2")
    right = right.agg(F.collect_list("id").alias("ids"))
    met = left.repartition(*tasks, *on).join(right.repartition(*tasks, *on).hint("merge"), on)
    return met.where(ok).select(F.explode("s_ids").alias("seed_id"), "ids").select("seed_id", F.explode("ids").alias("id"))


def shared_member_pairs(df: DataFrame, id_col: str, member: str) -> DataFrame:
    """``id1, id2``: a spanning set of pairs of ids that share a member: each with the member's smallest.

    It links the same ids as all pairs would, with one row an id and member.
    """
    first = df.groupBy(member).agg(F.min(id_col).alias("id1"))
    return df.join(first, member).where(F.col("id1") < F.col(id_col)).select("id1", F.col(id_col).alias("id2")).distinct()


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, value: str, size: int = BUCKET) -> DataFrame:
    """``left`` with the right value at the first ``right_on`` that is at least ``left_on`` in the same keys.

    In two levels: within buckets of positions from the last row to the first, each row takes what was last
    seen; a row with nothing after it in its bucket takes the first of the next bucket that has one. No
    window spans a key, and none looks forward, which Spark does from each row anew.
    """
    kind = dict(right.dtypes)[value]
    seen = F.struct(F.col(value).alias("v")).alias("__v")
    r = right.select(*keys, F.lit(1).alias("__o"), F.col(right_on).alias("__x"), seen).dropna(subset=[*keys, "__x"])
    both = left.select("*", F.lit(0).alias("__o"), F.col(left_on).alias("__x"), F.lit(None).cast(f"struct<v:{kind}>").alias("__v")).unionByName(r, allowMissingColumns=True)
    bucket = F.floor(F.col("__x") / size).alias("__b")
    w = Window.partitionBy(*keys, "__b").orderBy(F.desc("__x"), F.desc("__o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select("*", bucket).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__o = 0")
    # the first right value of each bucket, and which bucket with one comes next
    first = r.select("*", bucket).groupBy(*keys, "__b").agg(F.min_by("__v", "__x").alias("__first"))
    at = left.select(*keys, F.floor(F.col(left_on) / size).alias("__b")).where("__b is not null").distinct()
    all_ = at.join(first.hint("merge"), [*keys, "__b"], "full")
    after = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    later = all_.select(*keys, "__b", F.last("__first", ignorenulls=True).over(after).alias("__next")).where("__next is not null")
    out = found.join(small(later), [*keys, "__b"], "left")
    return out.select(*[F.col(c) for c in left.columns if c != value], F.coalesce("__v", "__next")["v"].alias(value))


def list_members(df: DataFrame, column: str, out: str, sep: str = ",") -> DataFrame:
    """One row an entry of a joined list, empty entries left out."""
    return df.withColumn(out, F.explode(F.filter(F.split(F.col(column), sep), lambda v: v != "")))


def complete_grid(df: DataFrame, axes: dict[str, DataFrame], values: list[str], fill: float = 0) -> DataFrame:
    """Every combination of the axes' rows (small tables of one column each), absent values filled."""
    grid = None
    for name, axis in axes.items():
        one = axis.select(name).distinct()
        grid = one if grid is None else grid.crossJoin(small(one))
    out = grid.join(df, list(axes), "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(fill)) for v in values})


def full_outer_reduce(frames: list[DataFrame], keys: list[str], fill: float = 0) -> DataFrame:
    """Full outer join of several tables on ``keys``, absent values filled."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, keys, "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in out.columns if c not in keys})


def overlap_fraction(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each ``a`` segment (id, keys, first, last inclusive) that ``b`` segments of the keys cover.

    ``keys`` holds the sign among others; ``b`` segments of one key do not overlap each other.
    """
    size = 256
    x = a.withColumn("__b", F.explode(buckets(F.col("first"), F.col("last"), size)))
    y = b.select(*keys, F.col("first").alias("__f"), F.col("last").alias("__l")).withColumn("__b", F.explode(buckets(F.col("__f"), F.col("__l"), size)))
    lo, hi = F.greatest("first", "__f"), F.least("last", "__l")
    found = x.join(y, [*keys, "__b"]).where((lo <= hi) & (F.floor(lo / size) == F.col("__b")))
    sums = found.groupBy("id").agg(F.sum(hi - lo + 1).alias("__n"))
    return a.join(sums, "id", "left").withColumn("overlap", F.coalesce("__n", F.lit(0)) / (F.col("last") - F.col("first") + 1)).drop("__n")


def cluster_members(df: DataFrame, read: str, cond: Column) -> DataFrame:
    """All rows of every read that has a row fulfilling ``cond``."""
    return df.join(df.where(cond).select(read).distinct(), read, "left_semi")


def duplex_parents(children: DataFrame, reads: DataFrame) -> DataFrame:
    """Parent reads of each duplex read, looked up and joined: children ``read, parents`` (``;``-joined), reads ``read, read_id``."""
    x = children.select("read", F.explode(F.split("parents", ";")).alias("parent"))
    y = x.join(reads.select(F.col("read").alias("parent"), "read_id"), "parent", "left")
    return y.groupBy("read").agg(F.array_join(F.array_sort(F.collect_list("read_id")), ";").alias("parent_ids"))
