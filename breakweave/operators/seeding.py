"""Junction types of continuity groups assigned to SVs by greedy seeding.

Seeds are taken one by one among the types that no seed has matched: splits before gaps, then by
molecules and MAPQ, then by position. Seeds that share a matched split are one SV; a gap may match several.

Groups of few types are seeded many to a task. A larger group is cut into tiles of positions: a type is
settled by the tile that owns it once no unsettled type before it can match it, and tiles hand on what they
have settled in rounds. The seeds are those of one pass over the whole group, so the size at which a group is
cut changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_tables
from .joins import small

TYPE_COLUMNS = ("is_split", "side1", "pos1", "side2", "pos2")
#: Types of a group, or of a tile of one, that a task takes at once.
MOST_TYPES = 50_000
#: What a tile knows of a type: nothing yet, matched by a seed, a seed.
OPEN, COVERED, SEED = 0, 1, 2


def _node_match(is_split: np.ndarray, pos: np.ndarray, side: np.ndarray, seed: int, rows: np.ndarray, purge: int, tlen: int) -> np.ndarray:
    """Which rows match a seed at one end: splits and gaps among themselves by distance, a gap on a split's inner side."""
    apart = pos[seed] - pos[rows] if is_split[seed] else pos[rows] - pos[seed]
    low, high = (-purge, tlen) if side[seed] == "L" else (-tlen, purge)
    alike = np.abs(apart) <= (purge if is_split[seed] else tlen)
    return np.where(is_split[rows] == is_split[seed], alike, (apart >= low) & (apart <= high))


class _Types:
    """Types in the order in which they become seeds, with what matches each."""

    def __init__(self, types: pd.DataFrame, purge: int, tlen: int):
        self.rank = np.lexsort((types["pos2"], types["pos1"], -types["mapq"], -types["n"], ~types["is_split"].to_numpy(bool)))
        self.is_split = types["is_split"].to_numpy(bool)[self.rank]
        self.pos1, self.pos2, self.side1, self.side2 = (types[c].to_numpy()[self.rank] for c in ("pos1", "pos2", "side1", "side2"))
        self.purge, self.tlen = purge, tlen
        self.by_pos = np.argsort(self.pos1, kind="stable")
        self.sorted_pos = self.pos1[self.by_pos]

    def matches(self, s: int) -> np.ndarray:
        """The types that seed ``s`` matches, itself not among them."""
        near = self.by_pos[np.searchsorted(self.sorted_pos, self.pos1[s] - self.tlen) : np.searchsorted(self.sorted_pos, self.pos1[s] + self.tlen, "right")]
        ok = _node_match(self.is_split, self.pos1, self.side1, s, near, self.purge, self.tlen)
        ok &= _node_match(self.is_split, self.pos2, self.side2, s, near, self.purge, self.tlen)
        ok &= np.abs(self.pos1[near] - self.pos1[s]) + np.abs(self.pos2[near] - self.pos2[s]) <= self.tlen
        if not self.is_split[s]:
            ok &= ~self.is_split[near]
        ok &= near != s
        return near[ok]


def seed_group(types: pd.DataFrame, purge: int, tlen: int) -> list[tuple[int, int]]:
    """(row of type, SV number) of one whole group. An SV is numbered by its last seed."""
    x = _Types(types, purge, tlen)
    left = np.ones(len(types), bool)
    seeds: list[np.ndarray] = []
    root: list[int] = []
    of_split: dict[int, int] = {}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for s in range(len(types)):
        if not left[s]:
            continue
        match = np.append(x.matches(s), s)
        left[match] = False
        k = len(seeds)
        seeds.append(match)
        root.append(k)
        for i in match[x.is_split[match]].tolist():
            root[find(of_split.setdefault(i, k))] = k  # the later seed names the SV
    number = {top: i for i, top in enumerate(sorted({find(k) for k in range(len(seeds))}), 1)}
    return sorted({(int(x.rank[i]), number[find(k)]) for k, m in enumerate(seeds) for i in m.tolist()})


def settle_tile(types: pd.DataFrame, purge: int, tlen: int) -> np.ndarray:
    """The new ``state`` of the types of one tile, which are its own (``own``) and those within ``tlen`` around it.

    A type becomes a seed if no seed matches it and no unsettled type before it does. Types around the
    tile may have matches out of sight, so those not known to be seeds stay unsettled here.
    """
    x = _Types(types, purge, tlen)
    state, own = types["state"].to_numpy()[x.rank], types["own"].to_numpy(bool)[x.rank]
    covered, unsure = state == COVERED, np.zeros(len(types), bool)
    for s in np.flatnonzero(state == SEED).tolist():
        covered[x.matches(s)] = True
    covered &= state != SEED
    for s in range(len(types)):
        if covered[s] or state[s] == SEED:
            continue
        later = x.matches(s)
        later = later[later > s]
        if own[s] and not unsure[s]:
            state[s] = SEED
            covered[later] = True
        else:
            unsure[later] = True
    out = np.empty_like(state)
    out[x.rank] = np.where(covered, COVERED, state)
    return out


def _matches(s: dict[str, Column], t: dict[str, Column], purge: int, tlen: int) -> Column:
    """Whether a seed matches a type of its group, as columns."""

    def node(k: int) -> Column:
        side, a, b = s[f"side{k}"], s[f"pos{k}"], t[f"pos{k}"]
        apart = F.when(s["is_split"], a - b).otherwise(b - a)
        left = side == "L"
        inner = (apart >= F.when(left, -purge).otherwise(-tlen)) & (apart <= F.when(left, tlen).otherwise(purge))
        alike = F.abs(apart) <= F.when(s["is_split"], purge).otherwise(tlen)
        return F.when(s["is_split"] == t["is_split"], alike).otherwise(inner)

    same = (s["is_split"] == t["is_split"]) & (s["pos1"] == t["pos1"]) & (s["pos2"] == t["pos2"])
    near = F.abs(s["pos1"] - t["pos1"]) + F.abs(s["pos2"] - t["pos2"]) <= tlen
    return same | ((s["is_split"] | ~t["is_split"]) & near & node(1) & node(2))


def _tiles(pos: str, size: int, reach: int) -> Column:
    return F.sequence(F.floor((F.col(pos) - reach) / size), F.floor((F.col(pos) + reach) / size))


def find_seeds(types: DataFrame, group: str, purge: int, tlen: int, most: int) -> DataFrame:
    """The seeds of groups that are cut into tiles: ``group``, the type's columns, ``n, mapq``.

    Tiles are halved until none has more than ``most`` types, or they are ``tlen`` wide: then positions bound
    them, to tlen^2 splits and gaps. Each round settles at least the first open type of every neighbourhood,
    and whole tiles where nothing open before them is near; rounds are as many as tiles in the longest chain
    of types, each before the next.
    """
    size = 64 * tlen
    while size > tlen:
        tile = types.groupBy(group, F.floor(F.col("pos1") / size), F.floor(F.col("pos2") / size)).count()
        if (tile.agg(F.max("count")).first()[0] or 0) <= most:
            break
        size = max(tlen, size // 2)
    columns = [group, *TYPE_COLUMNS, "n", "mapq", "state"]
    kinds = dict(types.dtypes) | {"state": "int"}

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(state=settle_tile(part, purge, tlen).astype("int32"))[part["own"]][columns]

    known = types.withColumn("state", F.lit(OPEN))
    seeds = None
    while True:
        around = known.select("*", F.explode(_tiles("pos1", size, tlen)).alias("t1")).select("*", F.explode(_tiles("pos2", size, tlen)).alias("t2"))
        around = around.withColumn("own", (F.col("t1") == F.floor(F.col("pos1") / size)) & (F.col("t2") == F.floor(F.col("pos2") / size)))
        done = around.groupBy(group, "t1", "t2").applyInPandas(settle, ", ".join(f"{c} {kinds[c]}" for c in columns))
        known = materialize(done.where(F.col("state") != COVERED), "seeding")
        seeds = known.where(F.col("state") == SEED).select(*columns[:-1])
        if not known.where(F.col("state") == OPEN).limit(1).count():
            return seeds


def _assign_tiled(types: DataFrame, group: str, purge: int, tlen: int, most: int) -> DataFrame:
    """``group``, the type's columns and ``sv_n`` of every SV that a type of a large group is in."""
    from .graph import connected_components
    from .ordered import dense_ids

    order = [group, F.desc("is_split"), F.desc("n"), F.desc("mapq"), "pos1", "pos2"]
    seeds = materialize(dense_ids(find_seeds(types, group, purge, tlen, most), order, "k"), "seeds")
    cell = lambda p: F.floor(F.col(p) / tlen)
    of_seed = seeds.select(group, "k", *[F.col(c).alias(f"s_{c}") for c in TYPE_COLUMNS], cell("pos1").alias("c1"), cell("pos2").alias("c2"))
    looked = types.select(group, *TYPE_COLUMNS, F.explode(_tiles("pos1", tlen, tlen)).alias("c1")).select("*", F.explode(_tiles("pos2", tlen, tlen)).alias("c2"))
    is_match = _matches({c: F.col(f"s_{c}") for c in TYPE_COLUMNS}, {c: F.col(c) for c in TYPE_COLUMNS}, purge, tlen)
    found = materialize(looked.join(of_seed, [group, "c1", "c2"]).where(is_match).select(group, *TYPE_COLUMNS, "k"), "seed-matches")
    # seeds that share a split are one SV, numbered by its last seed: components name their least node
    of_split = found.where("is_split").groupBy(group, *TYPE_COLUMNS).agg(F.min("k").alias("low"), F.collect_set("k").alias("ks")).where(F.size("ks") > 1)
    edges = of_split.select((-F.col("low")).alias("a"), F.explode("ks").alias("k")).select("a", (-F.col("k")).alias("b")).where("a <> b")
    tops = connected_components(edges).select((-F.col("node")).alias("k"), (-F.col("component")).alias("top"))
    named = materialize(seeds.select(group, "k").join(tops, "k", "left").select(group, "k", F.coalesce("top", "k").alias("top")), "seed-tops")
    numbers = dense_ids(named.select(group, "top").distinct(), [group, "top"], "nth")
    first = numbers.groupBy(group).agg(F.min("nth").alias("first"))
    numbers = numbers.join(first, group).select(group, "top", (F.col("nth") - F.col("first") + 1).cast("int").alias("sv_n"))
    svs = named.join(numbers, [group, "top"]).select(group, "k", "sv_n")
    return found.join(svs, [group, "k"]).select(group, *TYPE_COLUMNS, "sv_n").distinct()


def parse_continuity_groups(df: DataFrame, group: str, purge: int = 5, max_tlen: int = 762, most: int = MOST_TYPES) -> DataFrame:
    """``df`` with ``sv_n`` and ``is_ambiguous``: junction molecules of a group assigned to SVs.

    A molecule of several SVs has a row in each and is ambiguous. See :func:`assign_types`.
    """
    return df.join(assign_types(df, group, purge, max_tlen, most), [group, *TYPE_COLUMNS])


def assign_types(df: DataFrame, group: str, purge: int = 5, max_tlen: int = 762, most: int = MOST_TYPES) -> DataFrame:
    """``group``, the type's columns, ``sv_n`` and ``is_ambiguous``: a row for each SV that a junction type is in.

    Molecules are counted by junction type first. Groups of more than ``most`` types are seeded in tiles
    (see the module).
    """
    with scratch_tables(df.sparkSession):
        counted = df.groupBy(group, *TYPE_COLUMNS).agg(F.count("*").alias("n"), F.max(F.col("mapq1") + F.col("mapq2")).alias("mapq"))
        types = materialize(counted, "junction-types")
        sizes = types.groupBy(group).agg(F.count("*").alias("n_types"))
        large = materialize(sizes.where(F.col("n_types") > most).select(group), "large-groups")
        n_large = large.count()  # at most one in ``most`` types
        kinds = dict(types.dtypes)
        columns = [group, *TYPE_COLUMNS]

        def assigned(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, part in rows.groupby(group, sort=False):
                part = part.reset_index(drop=True)
                found = seed_group(part, purge, max_tlen)
                of = [i for i, _ in found]
                out.append(part.loc[of, columns].assign(sv_n=np.array([k for _, k in found], dtype="int32")))
            return pd.concat(out) if out else rows.head(0)[columns].assign(sv_n=pd.Series(dtype="int32"))

        def seed_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Groups come one after another; the last one of a frame may go on in the next."""
            held = None
            for frame in frames:
                rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
                if not len(rows):
                    continue
                last = rows[group] == rows[group].iloc[-1]
                held = rows[last]
                yield assigned(rows[~last])
            if held is not None:
                yield assigned(held)

        some = types.join(small(large), group, "left_anti") if n_large else types
        schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sv_n int"
        svs = some.repartition(group).sortWithinPartitions(group).mapInPandas(seed_all, schema)
        if n_large:
            svs = svs.unionByName(_assign_tiled(types.join(small(large), group, "left_semi"), group, purge, max_tlen, most))
        many = F.count("*").over(Window.partitionBy(*columns)) > 1
        svs = materialize(svs.withColumn("is_ambiguous", many), "junction-svs", result=True)
    return svs
