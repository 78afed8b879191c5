"""Graph and iterative operators: components, clusters, seeding, purging, networks."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize, scratch_tables
from .joins import BROADCAST_ROWS, near_places, small
from .ordered import dense_ids

#: Sequences are paired by what deletions leave of them where these are so many at most, else by pieces.
MOST_DELETIONS = 36
#: Rounds after which the tables of settled sequences become one.
MERGE_ROUNDS = 8


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for the ends of all edges ``(a, b)``: the smallest node of each component.

    The graph is contracted. Nodes have an order by hash; each round every node moves to its first
    neighbour's first neighbour, if these come before it, and edges follow their ends. The image of a
    connected graph stays connected, and a node that is not first among its neighbours moves, so few
    nodes are left after some rounds, whatever the ids along a path. Each round is written to the
    shared folder. Only joins and minima are used, so a node with very many edges needs no list of them.
    """
    with scratch_tables(edges.sparkSession):
        return materialize(_contracted(edges, max_rounds), "components", result=True)


def _contracted(edges: DataFrame, max_rounds: int) -> DataFrame:
    kind = edges.select("a").union(edges.select("b")).schema["a"].dataType
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    in_order = lambda df: df.where("a <> b").select(
        F.when(rank("a") < rank("b"), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(rank("a") < rank("b"), F.col("b")).otherwise(F.col("a")).alias("b"),
    )
    left = materialize(in_order(edges.select(F.col("a").cast(kind), F.col("b").cast(kind))).distinct(), "cc-edges")
    labels = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        n = left.limit(BROADCAST_ROWS + 1).count()
        if not n:
            break
        # tables of a round have no more rows than edges; Spark would judge them by the size of their files
        held = lambda df, n=n: df.hint("broadcast" if n <= BROADCAST_ROWS else "merge")
        up = left.groupBy("b").agg(F.min(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))).alias("up")).select("b", F.col("up.n").alias("up"))
        twice = up.join(held(up.select(F.col("b").alias("up"), F.col("up").alias("top"))), "up", "left")
        moved = materialize(twice.select(F.col("b").alias("was"), F.coalesce("top", "up").alias("now")), "cc-moved")
        labels = labels.join(held(moved.withColumnRenamed("was", "component")), "component", "left").select(
            "node", F.coalesce("now", "component").alias("component")
        )
        of_a = moved.select(F.col("was").alias("a"), F.col("now").alias("to_a"))
        of_b = moved.select(F.col("was").alias("b"), F.col("now").alias("to_b"))
        ends = left.join(held(of_a), "a", "left").join(held(of_b), "b").select(F.coalesce("to_a", "a").alias("a"), F.col("to_b").alias("b"))
        left = materialize(in_order(ends).distinct(), "cc-edges")
    else:
        raise RuntimeError("components did not settle")
    # a table of its own: the join on a component that very many nodes have can then be split
    low = materialize(labels.groupBy("component").agg(F.min("node").alias("low")), "cc-low")
    return labels.join(small(low), "component").select("node", F.col("low").alias("component"))


def finalize_clusters(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """``cluster_n`` for every row: dense numbers of the components of its keys; a key without a pair is
    a cluster of its own, numbered by the same order of smallest keys."""
    labels = connected_components(pairs)
    keys = rows.select(key).distinct().join(small(labels.withColumnRenamed("node", key)), key, "left")
    keys = keys.withColumn("component", F.coalesce("component", F.col(key)))
    ids = dense_ids(keys.select("component").distinct(), ["component"], "cluster_n")
    return rows.join(keys.join(ids.hint("merge"), "component").select(key, "cluster_n").hint("merge"), key)


def ranked(df: DataFrame, order: list[Column], id_col: str) -> DataFrame:
    """``df`` with ``__rank``, by the columns of ``order`` and then by id, and ``n_collapsed`` of 1, for :func:`combined`."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(id_col).alias("i"))
    return df.withColumns({"__rank": rank, "n_collapsed": F.lit(1).cast("long")})


def combined(df: DataFrame, group: list[str], counts: list[str]) -> DataFrame:
    """Of each group the row of least ``__rank``, with the counts and ``n_collapsed`` of all summed."""
    sums = [*counts, "n_collapsed"]
    kept = [c for c in df.columns if c not in sums and c not in group and c != "__rank"]
    x = df.groupBy(*group).agg(F.min_by(F.struct(*kept), "__rank").alias("__best"), F.min("__rank").alias("__rank"), *[F.sum(c).alias(c) for c in sums])
    return x.select(*group, "__best.*", "__rank", *sums)


def purge_ranked(df: DataFrame, keys: list[str], most: float, counts: list[str]) -> DataFrame:
    """:func:`purge_duplicates` of rows that have ``__rank`` and ``n_collapsed``, best with few rows a place."""
    columns = [c for c in df.columns if c not in ("__rank", "n_collapsed")]
    return combined(near_places(df, keys, "out_pos1", "out_pos2", most), [*keys, "__x", "__y"], counts).select(*columns, "n_collapsed")


def purge_duplicates(df: DataFrame, id_col: str, keys: list[str], most: float, order: list[Column], counts: list[str]) -> DataFrame:
    """One row of each set of colliding molecules (outer ends within ``most`` in the same keys, chained):
    the least by the columns of ``order``, then by id, with the counts of all summed and ``n_collapsed``.

    Molecules at one place are one row before places are chained, so a pile-up makes no pairs.
    """
    places = combined(ranked(df, order, id_col), [*keys, "out_pos1", "out_pos2"], counts)
    return purge_ranked(places, keys, most, counts).select(*df.columns, "n_collapsed")


def discover_amplicons(pairs: DataFrame, most: int, reject: int, keep: int) -> DataFrame:
    """The most frequent node pairs one after another, each absorbing its neighbourhood.

    Input: ``chrom1, pos1, chrom2, pos2, n``. Pairs within ``reject`` of a taken one are no candidates;
    those within ``keep`` count as its molecules. ``most`` bounds the rounds.
    """
    left = materialize(pairs, "node-pairs")
    taken = []
    same = lambda t: (F.col("chrom1") == t.chrom1) & (F.col("chrom2") == t.chrom2)
    for k in range(1, most + 1):
        top = left.orderBy(F.desc("n"), "chrom1", "pos1", "chrom2", "pos2").limit(1).collect()  # one row
        if not top:
            break
        t = top[0]
        near = lambda d, t=t: same(t) & (F.abs(F.col("pos1") - t.pos1) <= d) & (F.abs(F.col("pos2") - t.pos2) <= d)
        n = pairs.where(near(keep)).agg(F.sum("n")).first()[0]
        taken.append((k, t.chrom1, t.pos1, t.chrom2, t.pos2, t.n, n))
        left = left.where(~near(reject))
    kinds = dict(pairs.dtypes)
    schema = f"amplicon_n int, chrom1 {kinds['chrom1']}, pos1 {kinds['pos1']}, chrom2 {kinds['chrom2']}, pos2 {kinds['pos2']}, index_n long, n_molecules long"
    return pairs.sparkSession.createDataFrame(taken, schema)


def parent_networks(
    seqs: DataFrame, key: str, limit: int, sensitivity: float = 0.0, min_parent: int = 0, add_rare: bool = True
) -> DataFrame:
    """``seq, parent, distance``: sequences joined to the nearest more frequent parent within ``limit`` edits.

    Input: ``key, seq, n`` (distinct sequences). In falling order of count, then length, then sequence, a
    sequence joins the network of a parent before it whose distance is at most ``limit * (1 - sensitivity *
    n / n of the parent)``, or else is a parent itself: the closer two are in count, the fewer edits may lie
    between them. A sequence that joins goes to the nearest of all parents before it, ties to the more frequent, the longer, the lesser.

    Sequences of fewer than ``min_parent`` are rare: never parents, they join the nearest parent within
    ``limit`` whatever the counts, if ``add_rare``; without one they have a null parent and distance.

    Two sequences of at most ``limit`` edits share one of ``limit + 1`` pieces up to a shift, and short ones,
    whose pieces very many share, what ``limit`` deletions leave of them; so pairs are found by equality and
    then measured. Parents are settled in rounds from the most frequent on: a sequence is decided once all
    those before it that could take it in are, so each round decides some. Tables of rounds are broadcast
    only after a count.
    """
    with scratch_tables(seqs.sparkSession):
        x = materialize(seqs.select(key, "seq", "n"), "sequences")
        near = materialize(_near_before(x, key, limit), "near")
        common = x.where(F.col("n") >= min_parent)
        takes = F.col("distance") <= F.lit(limit) * (1 - F.lit(float(sensitivity)) * F.col("n") / F.col("n2"))
        strong = materialize(near.where((F.col("n") >= min_parent) & takes).select(key, "seq", "seq2"), "near-strong")
        state = common.join(strong.select(key, "seq").distinct().hint("merge"), [key, "seq"], "left_anti").select(key, "seq", F.lit(True).alias("is_parent"))
        state = materialize(state, "parents")
        open_ = materialize(strong.join(small(state), [key, "seq"], "left_anti"), "open")
        done = 0
        while open_.limit(1).count():
            known = open_.join(small(state.withColumnRenamed("seq", "seq2")), [key, "seq2"], "left")
            v = known.groupBy(key, "seq").agg(F.bool_or(F.coalesce("is_parent", F.lit(False))).alias("near_parent"), F.bool_and(F.col("is_parent").isNotNull()).alias("settled"))
            new = materialize(v.where("near_parent or settled").select(key, "seq", (~F.col("near_parent")).alias("is_parent")), "new-parents")
            state, done = state.unionByName(new), done + 1
            if done % MERGE_ROUNDS == 0:
                state = materialize(state, "parents")
            open_ = materialize(open_.join(small(new), [key, "seq"], "left_anti"), "open")
        parents = materialize(state.where("is_parent").select(key, F.col("seq").alias("seq2")), "all-parents")
        joins = near.join(small(parents), [key, "seq2"]).join(small(parents.select(key, F.col("seq2").alias("seq"))), [key, "seq"], "left_anti")
        if not add_rare:
            joins = joins.where(F.col("n") >= min_parent)
        rank = F.struct("distance", (-F.col("n2")).alias("m"), (-F.length("seq2")).alias("l"), "seq2")
        child = joins.groupBy(key, "seq").agg(F.min(rank).alias("b")).select(key, "seq", F.col("b.seq2").alias("parent"), F.col("b.distance").alias("distance"))
        own = parents.select(key, F.col("seq2").alias("seq"), F.col("seq2").alias("parent"), F.lit(0).alias("distance"))
        placed = child.unionByName(own)
        return materialize(x.select(key, "seq").join(placed.hint("merge"), [key, "seq"], "left"), "networks", result=True)


def _near_before(x: DataFrame, key: str, limit: int) -> DataFrame:
    """``key, seq, n, seq2, n2, distance``: each sequence with those before it within ``limit`` edits."""
    short = max((n for n in range(1, MOST_DELETIONS + 1) if comb(n, limit) <= MOST_DELETIONS), default=0)
    pairs = _deletion_pairs(x.where(F.length("seq") <= short), key, limit).unionByName(_piece_pairs(x, key, limit, short))
    near = pairs.withColumn("distance", F.levenshtein("seq", "seq2", limit)).where(F.col("distance").between(0, limit))
    order = lambda n, q: F.struct(F.col(n), F.length(q), F.col(q))
    up = order("n2", "seq2") > order("n", "seq")
    either = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b)).alias(a)
    return near.select(key, either("seq", "seq2"), either("n", "n2"), either("seq2", "seq"), either("n2", "n"), "distance").distinct()


def _deletions(seq: Column, k: int) -> Column:
    """What is left of a sequence without k of its letters (without any, of a shorter one)."""
    out = F.array(seq)
    for _ in range(k):
        one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        out = F.array_distinct(F.flatten(F.transform(out, lambda w: F.when(F.length(w) > 0, one(w)).otherwise(F.array(w)))))
    return out


def _deletion_pairs(x: DataFrame, key: str, limit: int) -> DataFrame:
    """Pairs of sequences that are equal after ``limit`` deletions in the longer, and as many fewer in the other as it is shorter."""
    length = F.length("seq")
    own = x.select(key, "seq", "n", F.explode(_deletions(F.col("seq"), limit)).alias("rest"), length.alias("len2"))
    probe = [x.select(key, F.col("seq").alias("seq2"), F.col("n").alias("n2"), F.explode(_deletions(F.col("seq"), m)).alias("rest"), (length + limit - m).alias("len2")) for m in range(limit + 1)]
    other = probe[0]
    for more in probe[1:]:
        other = other.unionByName(more)
    once = (F.length("seq") > F.length("seq2")) | (F.col("seq") < F.col("seq2"))
    return own.join(other.hint("merge"), [key, "len2", "rest"]).where(once).select(key, "seq", "n", "seq2", "n2")


def _piece_pairs(x: DataFrame, key: str, limit: int, short: int) -> DataFrame:
    """Pairs of sequences that share a piece up to a shift, the longer with more than ``short`` letters."""
    cut = limit + 1
    length = F.length("seq")
    at = F.sequence(F.lit(0), F.lit(limit))
    start = lambda i: F.floor(i * length / cut)
    x = x.where(length > short - limit)
    # pieces of the shorter partner's own cut, looked up at every offset up to the limit in the other
    own = x.select(key, "seq", "n", F.explode(at).alias("i")).select(key, "seq", "n", "i", length.alias("len"), F.substr("seq", (start(F.col("i")) + 1).cast("int"), (start(F.col("i") + 1) - start(F.col("i"))).cast("int")).alias("piece"))
    probe = x.select(key, F.col("seq").alias("seq2"), F.col("n").alias("n2"), F.explode(F.sequence(F.greatest(F.lit(0), length - limit), length + limit)).alias("len"), length.alias("len2"))
    probe = probe.where(F.greatest("len", "len2") > short)
    probe = probe.select("*", F.explode(at).alias("i")).select("*", F.explode(F.sequence(F.lit(-limit), F.lit(limit))).alias("d"))
    from_ = F.floor(F.col("i") * F.col("len") / cut)
    to = F.floor((F.col("i") + 1) * F.col("len") / cut)
    probe = probe.where((from_ + F.col("d") >= 0) & (to > from_)).select(key, "seq2", "n2", "len", "i", F.substr("seq2", (from_ + F.col("d") + 1).cast("int"), (to - from_).cast("int")).alias("piece"))
    pairs = own.where(F.length("piece") > 0).join(probe.hint("merge"), [key, "len", "i", "piece"]).where(F.col("seq") != F.col("seq2"))
    return pairs.select(key, "seq", "n", "seq2", "n2").distinct()


def discover_primers(nodes: DataFrame, apart: int = 100) -> DataFrame:
    """The two most frequent outer nodes of each amplicon at least ``apart`` bases from each other, in order of position.

    Input: ``amplicon, node, n``.
    """
    w = Window.partitionBy("amplicon").orderBy(F.desc("n"), "node")
    one = nodes.withColumn("k", F.row_number().over(w)).where("k = 1").select("amplicon", F.col("node").alias("p"), F.col("n").alias("np"))
    far = nodes.join(one, "amplicon").where(F.abs(F.abs("node") - F.abs("p")) >= apart)
    two = far.withColumn("k", F.row_number().over(w)).where("k = 1")
    first = F.abs("p") <= F.abs("node")
    return two.select("amplicon", F.when(first, F.col("p")).otherwise(F.col("node")).alias("primer1"), F.when(first, F.col("node")).otherwise(F.col("p")).alias("primer2"), F.when(first, F.col("np")).otherwise(F.col("n")).alias("n1"), F.when(first, F.col("n")).otherwise(F.col("np")).alias("n2"))
