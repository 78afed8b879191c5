"""Operators over ordered rows: coverage sweeps, gap groups, runs, segments, ranks and bins."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import ADVANCE_REF

#: Positions of one bucket of a prefix sum.
SWEEP = 65_536


def _listed(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def prefix_sum(df: DataFrame, key: str | list[str], pos: str, value: str, out: str, size: int = SWEEP) -> DataFrame:
    """Running sum of ``value`` over ``pos`` within ``key``, in two levels.

    Rows are summed within buckets of positions, and the buckets' totals among each other: a whole
    chromosome never is one task. ``pos`` is unique in its key.
    """
    keys = _listed(key)
    x = df.withColumn("__b", F.floor(F.col(pos) / size))
    totals = x.groupBy(*keys, "__b").agg(F.sum(value).alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(totals, [*keys, "__b"]).withColumn(out, F.col("__before") + F.sum(value).over(inside)).drop("__b", "__before")


def coverage_breaks(spans: DataFrame, key: str = "chrom", start: str = "start0", end: str = "end1", weight: str | None = None) -> DataFrame:
    """``chrom, pos, depth``: the depth from each position at which it changes."""
    w = F.col(weight) if weight else F.lit(1)
    events = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("pos"), w.alias("d")), F.struct(F.col(end).alias("pos"), (-w).alias("d")))).alias("e"))
    change = events.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("delta")).where("delta <> 0")
    return prefix_sum(change, key, "pos", "delta", "depth").select(key, "pos", "depth")


def coverage_steps(spans: DataFrame, key: str = "chrom", start: str = "start0", end: str = "end1") -> DataFrame:
    """``chrom, start0, end1, depth`` of every stretch of equal depth above 0."""
    breaks = next_position(coverage_breaks(spans, key, start, end), key, "pos", "end1")
    return breaks.select(key, F.col("pos").alias("start0"), "end1", "depth").where("depth > 0")


def next_position(df: DataFrame, key: str, pos: str, out: str, size: int = SWEEP) -> DataFrame:
    """``out``: the next greater position of the key, in two levels like :func:`prefix_sum`. ``pos`` is unique in its key."""
    x = df.withColumn("__b", F.floor(F.col(pos) / size))
    later = Window.partitionBy(key).orderBy("__b")
    firsts = x.groupBy(key, "__b").agg(F.min(pos).alias("__f")).select(key, "__b", F.lead("__f").over(later).alias("__next"))
    inside = F.lead(pos).over(Window.partitionBy(key, "__b").orderBy(pos))
    return x.join(firsts, [key, "__b"]).withColumn(out, F.coalesce(inside, "__next")).drop("__b", "__next")


def depth_integral(points: DataFrame, spans: DataFrame, key: str = "chrom", start: str = "start0", end: str = "end1", size: int = SWEEP) -> DataFrame:
    """``chrom, pos, area`` for distinct ``points`` (chrom, pos): the depth of the spans summed over all positions before ``pos``.

    Points take part in the sweep as changes of nothing. The area at a point is its position times the
    depth there, less the sum of all changes before it, each times its position: two running sums.
    """
    change = spans.select(key, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    change = change.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    asked = points.select(key, F.col("pos").cast("long").alias("pos"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("__asked")).distinct()
    both = change.withColumn("__asked", F.lit(False)).unionByName(asked)
    rows = both.groupBy(key, "pos").agg(F.sum("d").alias("d"), F.max("__asked").alias("__asked"))
    rows = rows.withColumn("dp", F.col("d") * F.col("pos"))
    summed = prefix_sum(prefix_sum(rows, key, "pos", "d", "depth", size), key, "pos", "dp", "moment", size)
    return summed.where("__asked").select(key, "pos", (F.col("pos") * F.col("depth") - F.col("moment")).alias("area"))


def step_bins(steps: DataFrame, size: int, key: str = "chrom") -> DataFrame:
    """A step function cut at bin borders: ``chrom, bin_n, depth, overlap``."""
    x = steps.withColumn("bin_n", F.explode(F.sequence(F.floor(F.col("start0") / size), F.floor((F.col("end1") - 1) / size))))
    overlap = F.least(F.col("end1"), (F.col("bin_n") + 1) * size) - F.greatest(F.col("start0"), F.col("bin_n") * size)
    return x.select(key, "bin_n", "depth", overlap.alias("overlap"))


def chunk_mean_coverage(steps: DataFrame, size: int = SWEEP, key: str = "chrom") -> DataFrame:
    """Mean depth of each chunk of positions, to a tenth (halves up)."""
    x = step_bins(steps, size, key).groupBy(key, "bin_n").agg(F.sum(F.col("depth") * F.col("overlap")).alias("s"))
    return x.select(key, F.col("bin_n").alias("chunk_n"), (F.floor(F.col("s") * 10 / size + 0.5) / 10).alias("mean_depth"))


def expand_spans(df: DataFrame) -> DataFrame:
    """One row a covered stretch: a proper molecule's whole span (its mapped span if clipped), each
    alignment of an SV molecule. Input: ``mol_id, mol_class, is_clipped, chrom, start0, end1, mapped0,
    mapped1, alns`` (array of start0, end1)."""
    whole = F.array(F.struct(F.col("start0").alias("start0"), F.col("end1").alias("end1")))
    mapped = F.array(F.struct(F.col("mapped0").alias("start0"), F.col("mapped1").alias("end1")))
    part = F.when(F.col("mol_class") != "P", F.col("alns")).when(F.col("is_clipped"), mapped).otherwise(whole)
    return df.select("mol_id", "chrom", F.explode(part).alias("s")).select("mol_id", "chrom", "s.start0", "s.end1")


def window_coverage(spans: DataFrame, size: int, windows: DataFrame, weight: str) -> DataFrame:
    """Depth of each fixed window by a weighted sweep over window indices; all given windows get a row.

    spans: ``chrom, start0, end1, weight`` (a duplex read weighs one less than its parents together).
    """
    x = spans.select("chrom", F.floor(F.col("start0") / size).alias("start0"), (F.floor((F.col("end1") - 1) / size) + 1).alias("end1"), F.col(weight).alias("w"))
    ev = x.select("chrom", F.explode(F.array(F.struct(F.col("start0").alias("p"), F.col("w").alias("d")), F.struct(F.col("end1").alias("p"), (-F.col("w")).alias("d")))).alias("e"))
    change = ev.groupBy("chrom", F.col("e.p").alias("window_n")).agg(F.sum("e.d").alias("delta"))
    grid = windows.select("chrom", "window_n").join(change, ["chrom", "window_n"], "full").withColumn("delta", F.coalesce("delta", F.lit(0)))
    return prefix_sum(grid, "chrom", "window_n", "delta", "depth", 4096).join(windows, ["chrom", "window_n"], "left_semi").select("chrom", "window_n", "depth")


def pair_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Two node rows of a junction (``node_n`` 1 and 2) as one row."""
    other = [c for c in nodes.columns if c not in keys and c != "node_n"]
    one = nodes.where("node_n = 1").select(*keys, *[F.col(c).alias(c + "1") for c in other])
    two = nodes.where("node_n = 2").select(*keys, *[F.col(c).alias(c + "2") for c in other])
    return one.join(two, keys)


def _runs(places: DataFrame, keys: list[str], pos: str, limit: int, out: str, size: int = SWEEP) -> DataFrame:
    """``keys, pos, out`` of distinct places: the number (from 0) of the run each is in, in two levels.

    Gaps are counted inside buckets of positions. A bucket hands on its first and last position and its
    gaps, and a scan over the buckets of a key adds those between them: no window spans more places than
    a bucket has, or more buckets than a key.
    """
    bucket = [*keys, "__b"]
    x = places.select(*keys, pos).dropna().distinct().withColumn("__b", F.floor(F.col(pos) / size))
    inside = Window.partitionBy(*bucket).orderBy(pos)
    gap = lambda after, before: F.coalesce((F.col(after) - before > limit).cast("int"), F.lit(0))
    x = x.withColumn("__gap", gap(pos, F.lag(pos).over(inside)))
    ends = x.groupBy(*bucket).agg(F.min(pos).alias("__first"), F.max(pos).alias("__last"), F.sum("__gap").alias("__n"))
    scan = Window.partitionBy(*keys).orderBy("__b")
    ends = ends.withColumn("__new", gap("__first", F.lag("__last").over(scan)))
    so_far = scan.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select(*bucket, (F.sum(F.col("__n") + F.col("__new")).over(so_far) - F.col("__n")).alias("__before"))
    number = F.col("__before") + F.sum("__gap").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return x.join(ends, bucket).select(*keys, pos, number.alias(out))


def gap_group(df: DataFrame, keys: list[str], pos: str, limit: int, out: str) -> DataFrame:
    """``out``: number (from 0) of the run of positions, within the keys, whose gaps are at most ``limit``.

    Rows at one place are in one run, so runs are numbered on distinct places, bucket by bucket (see
    :func:`_runs`), however many rows there are. A null key or position has no run.
    """
    return df.join(_runs(df, keys, pos, limit, out), [*keys, pos], "left").select(*df.columns, out)


def _runs_2d(places: DataFrame, keys: list[str], pos1: str, pos2: str, limit: int) -> DataFrame:
    """``places`` (distinct by keys and positions) with ``group1, group2``, as a table."""
    from ..plans.scratch import materialize

    placed = places.join(_runs(places, keys, pos1, limit, "group1"), [*keys, pos1])
    placed = materialize(placed, "runs")
    return materialize(placed.join(_runs(placed, [*keys, "group1"], pos2, limit, "group2"), [*keys, "group1", pos2]), "runs-2d")


def gap_group_2d(df: DataFrame, keys: list[str], pos1: str, pos2: str, limit: int) -> DataFrame:
    """``group1, group2``: runs by the first position, and by the second one inside them."""
    placed = _runs_2d(df.select(*keys, pos1, pos2).distinct(), keys, pos1, pos2, limit)
    return df.join(placed, [*keys, pos1, pos2], "left").select(*df.columns, "group1", "group2")


def continuity_groups(df: DataFrame, keys: list[str], limit: int, min_coverage: int) -> DataFrame:
    """Molecules of junctions whose two positions continue within ``limit``; ``group_id`` is dense over
    the groups of at least ``min_coverage`` molecules, in the order of keys and groups."""
    group = [*keys, "group1", "group2"]
    placed = _runs_2d(df.groupBy(*keys, "pos1", "pos2").agg(F.count("*").alias("__n")), keys, "pos1", "pos2", limit)
    ids = placed.groupBy(*group).agg(F.sum("__n").alias("__n")).where(F.col("__n") >= min_coverage)
    numbered = placed.drop("__n").join(dense_ids(ids.drop("__n"), group, "group_id"), group)
    return df.join(numbered, [*keys, "pos1", "pos2"]).select(*df.columns, "group1", "group2", "group_id")


def dense_ids(df: DataFrame, order: list, out: str) -> DataFrame:
    """Consecutive numbers from 1 over a whole table of distinct rows, without one task ordering it all.

    Rows are dealt by range, counted in each partition, and numbered from the counts before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = ranged.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    from ..plans.scratch import materialize

    x = materialize(x, "dense-ids")
    sizes = x.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__o"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
    return x.join(F.broadcast(offsets), "__p").withColumn(out, F.col("__o") + inside).drop("__p", "__i", "__o")


def adjacent_junctions(df: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """One row for each two consecutive alignments of a read: columns with 1 and 2 appended, and ``jxn_n``."""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.select(key, F.row_number().over(w).alias("jxn_n"), *[F.col(c).alias(c + "1") for c in columns], *[F.lead(c).over(w).alias(c + "2") for c in columns], F.lead(F.lit(1)).over(w).alias("__more"))
    return x.where("__more = 1").drop("__more")


def flank_min(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of junction rows, the least value of the rows before and after; other rows keep theirs."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({c: F.when(F.col("edge_type") == "A", F.col(c)).otherwise(F.least(F.lag(c).over(w), F.lead(c).over(w))) for c in columns})


def split_cigar_svs(df: DataFrame, keys: list[str], min_size: int) -> DataFrame:
    """Alignments cut at large indels: rows A (pieces) and J (junctions) in read order.

    Output: ``keys, edge_n, edge_type, ref_start, ref_end, size, insert_size``; coordinates are offsets from the
    alignment's start. Large operations that touch are one junction of their summed deletion and
    insertion. All of it happens inside one row's array.
    """
    from ..functions.reads import cigar_ops

    row = "struct<edge_type:string,ref_start:int,ref_end:int,size:int,insert_size:int>"
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("from"), F.array().cast(f"array<{row}>").alias("out"))

    def edge(kind: str, a: Column, b: Column, size: Column, ins: Column) -> Column:
        return F.struct(F.lit(kind).alias("edge_type"), a.alias("ref_start"), b.alias("ref_end"), size.alias("size"), ins.alias("insert_size"))

    def step(acc: Column, x: Column) -> Column:
        large = x["op"].isin("D", "I") & (x["size"] >= min_size)
        after = acc["r"] + F.when(x["op"].isin(*ADVANCE_REF), x["size"]).otherwise(0)
        d, i = F.when(x["op"] == "D", x["size"]).otherwise(0), F.when(x["op"] == "I", x["size"]).otherwise(0)
        touching = (F.size(acc["out"]) > 0) & (acc["from"] == acc["r"]) & (F.element_at(acc["out"], -1)["edge_type"] == "J")
        last = F.element_at(acc["out"], -1)
        joined = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(edge("J", last["ref_start"], after, last["size"] + d, last["insert_size"] + i)))
        fresh = F.concat(acc["out"], F.array(edge("A", acc["from"], acc["r"], acc["r"] - acc["from"], F.lit(0)), edge("J", acc["r"], after, d, i)))
        out = F.when(~large, acc["out"]).when(touching, joined).otherwise(fresh)
        return F.struct(after.alias("r"), F.when(large, after).otherwise(acc["from"]).alias("from"), out.alias("out"))

    done = F.aggregate(cigar_ops(F.col("cigar")), start, step, lambda acc: F.concat(acc["out"], F.array(edge("A", acc["from"], acc["r"], acc["r"] - acc["from"], F.lit(0)))))
    return df.select(*keys, F.posexplode(done).alias("n", "e")).select(*keys, (F.col("n") + 1).alias("edge_n"), "e.*")


def block_numbers(df: DataFrame, key: str, order: str, breaks: Column) -> DataFrame:
    """``block_n`` from 1, one more at each row that breaks and again after it."""
    w = Window.partitionBy(key).orderBy(order)
    b = breaks.cast("int")
    return df.withColumn("__b", b + F.coalesce(F.lag(b).over(w), F.lit(0))).withColumn("block_n", 1 + F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def split_to_segments(df: DataFrame, read: str, order: str, fusable: str) -> DataFrame:
    """``segment_n``: reads are broken at junctions that are not fusable; those junctions have none."""
    w = Window.partitionBy(read).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stop = (F.col("edge_type") != "A") & ~F.coalesce(F.col(fusable), F.lit(False))
    return df.withColumn("segment_n", F.when(~stop, 1 + F.sum(stop.cast("int")).over(w)))


def segments_with(df: DataFrame, read: str, cond: Column) -> DataFrame:
    """Segments that hold a row for which ``cond`` is true."""
    has = F.max(F.coalesce(cond, F.lit(False))).over(Window.partitionBy(read, "segment_n"))
    return df.where("segment_n is not null").withColumn("__h", has).where("__h").drop("__h")


def first_in_group(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group by a full order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def run_length_segments(df: DataFrame, keys: list[str], order: str, value: str, mean: str | None = None) -> DataFrame:
    """Stretches of equal consecutive values: ``keys, value, first, last, n`` and the mean of a column."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()
    x = df.withColumn("__c", changed.cast("int")).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")]
    if mean:
        aggs.append(F.avg(mean).alias(f"mean_{mean}"))
    return x.groupBy(*keys, "__run").agg(*aggs).drop("__run")


def collapse_bins(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Sums of n consecutive rows; an incomplete last window is scaled up to n."""
    i = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1) / n)
    return df.withColumn("window_n", i).groupBy(*keys, "window_n").agg((F.sum(value) * n / F.count("*")).alias(value))


def expand_windows(df: DataFrame, n: int) -> DataFrame:
    """Each window repeated for its n rows: adds ``bin_n``."""
    return df.withColumn("bin_n", F.explode(F.sequence(F.col("window_n") * n, F.col("window_n") * n + n - 1)))


def viterbi(log_p: np.ndarray, persistence: float) -> np.ndarray:
    """States of the best path through rows of log emissions; ties keep the lowest state."""
    n, k = log_p.shape
    stay, move = np.log(persistence), np.log((1 - persistence) / max(1, k - 1))
    t = np.full((k, k), move)
    np.fill_diagonal(t, stay)
    score, back = log_p[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        to = score[:, None] + t
        back[i] = to.argmax(axis=0)
        score = to[back[i], np.arange(k)] + log_p[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def viterbi_cn(df: DataFrame, keys: list[str], order: str, emissions: str, persistence: float = 1 - 1e-4, forced: str | None = None) -> DataFrame:
    """``keys, order, state``: the best copy-number path of each key's bins.

    ``emissions`` is an array of log densities by state; null masks a row; ``forced`` is a state that
    a row must take, or null. A key of one row gets null. Keys are decoded side by side; one key is
    a chromosome of one cell, some thousand rows.
    """

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        if len(part) < 2:
            return part[[*keys, order]].assign(state=pd.array([None] * len(part), dtype="Int32"))
        k = max((len(e) for e in part[emissions] if e is not None), default=1)
        p = np.array([e if e is not None else np.zeros(k) for e in part[emissions]], dtype=float).reshape(len(part), k)
        if forced:
            for i, s in enumerate(part[forced]):
                if s is not None and not pd.isna(s):
                    p[i, np.arange(k) != int(s)] = -1e100
        return part[[*keys, order]].assign(state=pd.array(viterbi(p, persistence), dtype="Int32"))

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, order]) + ", state int"
    columns = [*keys, order, emissions, *([forced] if forced else [])]
    return df.select(*columns).groupBy(*keys).applyInPandas(decode, schema)


def downsample_per_group(df: DataFrame, keys: list[str], n: int, tie: str, seed: str = "0") -> DataFrame:
    """At most n rows of each group, in an order hashed from the row's id and a seed."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(tie).cast("string")))
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(h, tie))).where(F.col("__k") <= n).drop("__k")


def rolling_bins(df: DataFrame, keys: list[str], order: str, half: int, sums: list[str], means: list[str]) -> DataFrame:
    """Centred rolling sums and means over 2 * half + 1 rows; windows are shorter at the ends."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumns({**{f"rolling_{c}": F.sum(c).over(w) for c in sums}, **{f"rolling_{c}": F.avg(c).over(w) for c in means}})


def alignment_loci(df: DataFrame, keys: list[str], padding: int) -> DataFrame:
    """``locus_n``: alignments of one key and chromosome chained while they start within ``padding`` of the
    furthest end so far: the order-free form of claiming neighbours one after another."""
    w = Window.partitionBy(*keys, "chrom").orderBy("start0", "end1")
    furthest = F.max("end1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start0") > furthest + padding).cast("int"), F.lit(0))
    return df.withColumn("__n", new).withColumn("locus_n", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def pileup_rows(df: DataFrame, keys: list[str], order: list, out: str = "row_n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def balanced_sample(df: DataFrame, kind: str, id_col: str, like: str | None = None, seed: str = "0") -> DataFrame:
    """At most as many rows of each kind as there are of ``like``, or of the rarest kind, in an order hashed from ids.

    Rows are ranked inside ranges of the hash, which are counted up (see :func:`dense_ids`), so a frequent kind is
    no task. A null kind is a kind; without rows of ``like`` there is no sample. Ids are distinct in a kind.
    """
    counts = df.groupBy(F.col(kind).alias("__kind")).agg(F.count("*").alias("__n"))
    most = counts.where(F.col("__kind") == like).select("__n") if like is not None else counts.agg(F.min("__n").alias("__n"))
    found = most.collect()  # one number
    if not found or found[0][0] is None:
        return df.limit(0)
    h = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))
    ranked = dense_ids(df.withColumn("__h", h), [kind, "__h", id_col], "__rank")
    first = ranked.groupBy(F.col(kind).alias("__kind")).agg(F.min("__rank").alias("__first"))  # one row a kind
    near = ranked.join(first, F.col(kind).eqNullSafe(F.col("__kind"))).where(F.col("__rank") - F.col("__first") < found[0][0])
    return near.select(*df.columns)
