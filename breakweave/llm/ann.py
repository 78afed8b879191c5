"""Approximate nearest neighbours: a forest of random-projection trees, searched through one queue.

Trees are fitted on a bounded sample; every vector is then dealt to one leaf of each tree by Spark.
A query opens the leaves of all trees in the order of one shared priority queue (the squared margins
by which it misses the branches, summed: about its distance from the leaf's cell), and the members
of the opened leaves are reranked exactly. How far the queue is drained follows from a measured recall,
and no leaf is opened whose cell lies beyond the neighbours found so far. Queries and vectors meet block
by block, in the order of the leaves of one tree, and only in blocks that an opened leaf reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import materialize

#: The forest is fitted on about so many vectors at most, chosen by a hash of the id.
MAX_FIT = 40_000
TREES, LEAF = 24, 6
#: The queue is drained as far as finds this share of the nearest neighbours of about so many fitted vectors.
RECALL, CALIBRATION = 0.95, 96
#: Queries and vectors of one block of the reranking, about.
QUERY_BLOCK, VECTOR_BLOCK = 1_024, 4_096
#: Queries whose margins are computed at once.
AT_ONCE = 16


class Tree:
    """A split plane per inner node; a child below 0 is leaf ``-child - 1``. ``members`` has the fitted
    points leaf by leaf, ``sizes`` of them in each."""

    def __init__(self, normals: np.ndarray, offsets: np.ndarray, children: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        self.normals, self.offsets, self.children, self.sizes, self.members = normals, offsets, children, sizes, members
        self.ends = np.cumsum(sizes)

    @classmethod
    def fit(cls, x: np.ndarray, seed: int, leaf: int = LEAF) -> Tree:
        """Split each node midway between two of its own points; a node of equal points is a leaf."""
        rng = np.random.default_rng(seed)
        normals, offsets, children, sizes, members = [], [], [], [], []
        short = lambda v: v.astype(np.float16).astype(np.float32)  # noqa: E731 -- as they are kept

        def plane(rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray] | None:
            for _ in range(8):
                i, j = rng.integers(len(rows)), rng.integers(len(rows) - 1)
                a, b = x[rows[i]], x[rows[j + (j >= i)]]
                normal = a - b
                length = np.linalg.norm(normal)
                if length == 0:
                    continue
                normal = short(normal / length)
                offset = float(normal @ (a + b) / 2)
                right = x[rows] @ normal > offset
                if 0.1 < right.mean() < 0.9:
                    return normal, offset, right
            normal = rng.standard_normal(x.shape[1]).astype(x.dtype)
            normal = short(normal / np.linalg.norm(normal))
            along = x[rows] @ normal
            offset = float(np.median(along))
            right = along > offset
            return (normal, offset, right) if right.any() and not right.all() else None

        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            split = plane(rows) if len(rows) > leaf else None
            if split is None:
                sizes.append(len(rows))
                members.append(rows)
                me = -len(sizes)
            else:
                me = len(normals)
                normals.append(split[0])
                offsets.append(split[1])
                children.append([0, 0])
                todo.append((rows[~split[2]], me, 0))
                todo.append((rows[split[2]], me, 1))
            if parent >= 0:
                children[parent][side] = me
        dim = x.shape[1] if x.ndim == 2 else 0
        return cls(
            np.array(normals, dtype=np.float32).reshape(-1, dim),
            np.array(offsets, dtype=np.float32),
            np.array(children, dtype=np.int32).reshape(-1, 2),
            np.array(sizes, dtype=np.int64),
            np.concatenate(members).astype(np.int32),
        )


class Forest:
    """All trees in one set of arrays: nodes and leaves are numbered through, and nodes come level by level."""

    def __init__(self, trees: list[Tree]):
        self.n_trees, self.fitted = len(trees), len(trees[0].members)
        n_nodes = np.cumsum([0, *[len(t.offsets) for t in trees]])
        n_leaves = np.cumsum([0, *[len(t.sizes) for t in trees]])
        self.normals = np.concatenate([t.normals for t in trees]).astype(np.float16)
        self.offsets = np.concatenate([t.offsets for t in trees])
        # children: a node's number, or below 0 that of a leaf
        placed = [np.where(t.children >= 0, t.children + a, t.children - b).astype(np.int32) for t, a, b in zip(trees, n_nodes, n_leaves)]
        self.children = np.concatenate(placed)
        self.roots = np.array([a if len(t.offsets) else -b - 1 for t, a, b in zip(trees, n_nodes, n_leaves)], dtype=np.int64)
        self.sizes = np.concatenate([t.sizes for t in trees]).astype(np.int32)
        self.members = np.concatenate([t.members for t in trees])
        self.ends = np.cumsum(self.sizes)
        self.first_leaves = len(trees[0].sizes)
        self.levels, level = [], self.roots[self.roots >= 0]
        while len(level):
            sides = []
            for side in (0, 1):
                to = self.children[level, side]
                inner = to >= 0
                sides.append((inner, to[inner], -to[~inner] - 1))
            self.levels.append((level, sides))
            below = self.children[level].ravel()
            level = below[below >= 0]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows x trees) leaves of the rows of ``x``."""
        node = np.tile(self.roots, (len(x), 1))
        while (inner := np.nonzero(node >= 0))[0].size:
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner[0]], self.normals[at].astype(np.float32)) > self.offsets[at]
            node[inner] = self.children[at, right.astype(np.int64)]
        return (-node - 1).astype(np.int32)

    def leaf_order(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the place of every leaf in the shared queue, and how near its cell can be.

        A leaf's place is the sum of the squared margins of the branches missed on the way. Each of these
        planes alone keeps the query from the cell, so the greatest margin bounds the distance from below.
        """
        for i in range(0, len(queries), AT_ONCE):
            q = queries[i : i + AT_ONCE].astype(np.float32)
            margins = np.empty((len(q), len(self.offsets)), np.float32)
            for j in range(0, len(self.offsets), 65_536):
                margins[:, j : j + 65_536] = q @ self.normals[j : j + 65_536].astype(np.float32).T - self.offsets[j : j + 65_536]
            for margin in margins:
                place, bound = np.zeros(len(self.offsets), np.float32), np.zeros(len(self.offsets), np.float32)
                leaf_place, leaf_bound = np.zeros(len(self.sizes), np.float32), np.zeros(len(self.sizes), np.float32)
                for level, sides in self.levels:
                    m = margin[level]
                    # the margin by which a branch is missed: of the left one above 0, of the right one below
                    for (inner, nodes, leaves), missed in zip(sides, (np.maximum(m, 0), np.maximum(-m, 0))):
                        p, b = place[level] + missed * missed, np.maximum(bound[level], missed)
                        place[nodes], bound[nodes] = p[inner], b[inner]
                        leaf_place[leaves], leaf_bound[leaves] = p[~inner], b[~inner]
                yield leaf_place, leaf_bound

    def points_of(self, leaves: np.ndarray) -> np.ndarray:
        """The fitted points of some leaves, leaf after leaf."""
        n = self.sizes[leaves]
        ends = np.cumsum(n)
        return self.members[np.arange(ends[-1] if len(n) else 0) + np.repeat(self.ends[leaves] - ends, n)]

    def point_places(self, leaf_place: np.ndarray) -> np.ndarray:
        """The place at which the queue reaches each fitted point: that of the first of its leaves."""
        out = np.full(self.fitted, np.inf, np.float32)
        np.minimum.at(out, self.members, np.repeat(leaf_place, self.sizes))
        return out

    def open(self, leaf_place: np.ndarray, leaf_bound: np.ndarray, search: int, query: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """The leaves that hold the first ``search`` different fitted points of the queue, less those whose cell
        lies beyond the ``k`` nearest of these."""
        if search >= self.fitted:
            leaves = np.arange(len(leaf_place))
        else:
            most = min(len(leaf_place) - 1, int(3 * search * len(leaf_place) / max(len(self.members), 1)) + 64)
            while True:
                leaves = np.argpartition(leaf_place, most)[:most] if most < len(leaf_place) - 1 else np.arange(len(leaf_place))
                leaves = leaves[np.argsort(leaf_place[leaves], kind="stable")]
                points = self.points_of(leaves)
                first = np.full(self.fitted, len(points), dtype=np.int64)
                first[points[::-1]] = np.arange(len(points))[::-1]
                nth = np.partition(first, search - 1)[search - 1]
                if nth < len(points):
                    break
                most = len(leaf_place) - 1
            leaves = leaves[: np.searchsorted(np.cumsum(self.sizes[leaves]), nth, "right") + 1]
        points = np.unique(self.points_of(leaves))
        if len(points) > k:
            apart = x[points] - query
            radius = np.sqrt(np.partition(np.einsum("ij,ij->i", apart, apart), k)[k])
            leaves = leaves[leaf_bound[leaves] <= radius * 1.002 + 1e-6]
        return leaves


def calibrate(forest: Forest, x: np.ndarray, at: np.ndarray, k: int) -> list[float]:
    """For some fitted points, the shares of all points that the queue has reached with each of the ``k`` nearest."""
    out = []
    for i, (leaf_place, _) in zip(at, forest.leaf_order(x[at])):
        apart = x - x[i]
        d = np.einsum("ij,ij->i", apart, apart)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:k]
        places = forest.point_places(leaf_place)
        out += (np.searchsorted(np.sort(places), places[near], "right") / len(x)).tolist()
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, which holds no nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector that is not null, empty or zero and has only finite
    components. Vectors of another length than the most frequent one take no part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def fit_forest(rows: DataFrame, trees: int = TREES, max_fit: int = MAX_FIT) -> tuple[Forest, np.ndarray] | None:
    """Trees fitted in parallel on a sample of at most about ``max_fit`` distinct vectors, and the sample."""
    n = rows.count()
    draw = F.pmod(F.xxhash64("vec_id", F.lit("forest")), F.lit(1 << 20))
    sample = rows.where(draw < int(np.ceil((1 << 20) * min(1.0, max_fit / max(n, 1))))).orderBy("vec_id").select("v")
    held = sample.toArrow().column("v").combine_chunks()  # max_fit vectors, as Arrow columns
    if not len(held):
        return None
    x = _matrix(held).astype(np.float32)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(x)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                t = Tree.fit(shared.value, seed=1000 + i)
                parts = [t.normals.astype(np.float16).tobytes(), t.offsets.tobytes(), t.children.tobytes(), t.sizes.tobytes(), t.members.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], ["i", "a", "b", "c", "d", "e"]
                )

    made = spark.range(0, trees, 1, trees).mapInArrow(fit, "i long, a binary, b binary, c binary, d binary, e binary")
    dim = x.shape[1]
    found = {
        r.i: Tree(
            np.frombuffer(r.a, np.float16).reshape(-1, dim),
            np.frombuffer(r.b, np.float32),
            np.frombuffer(r.c, np.int32).reshape(-1, 2),
            np.frombuffer(r.d, np.int64),
            np.frombuffer(r.e, np.int32),
        )
        for r in made.toLocalIterator()  # a tree at a time
    }
    return Forest([found[i] for i in sorted(found)]), x


def calibrated_share(spark: SparkSession, shared: Broadcast, k: int, recall: float, sample: int = CALIBRATION) -> float:
    """The share of the fitted vectors after which the queue has met ``recall`` of the ``k`` nearest of ``sample`` of them.

    In a table of more than the fitted vectors neighbours are nearer, and are met no later.
    """
    n = shared.value[0].fitted
    if n <= k + 1:
        return 1.0
    at = np.unique(np.linspace(0, n - 1, min(sample, n)).astype(np.int64))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, x = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(calibrate(forest, x, at[batch.column(0).to_numpy()], k), pa.float64())], ["share"])

    need = spark.range(0, len(at), 1, min(len(at), 12)).mapInArrow(measure, "share double").collect()  # k rows a sampled vector
    return float(np.quantile([r.share for r in need], recall))


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = TREES,
    recall: float = RECALL,
    search_share: float | None = None,
    max_fit: int = MAX_FIT,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query row.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id; a query never finds its own id. All candidates come if there are fewer than ``k``.
    Equal vectors are indexed once, with the ``k + 1`` smallest ids that carry them: no further id
    can be among the nearest. Null, empty, zero and non-finite vectors and null ids take no part;
    repeated rows count once; of rows that share an id but not a vector the nearest counts.

    ``search_share`` is the share of the vectors that a query's leaves may hold; by default it is the one
    at which ``recall`` of the neighbours of a bounded sample of fitted vectors is found by the same queue.
    """
    every = usable_vectors(vectors, id_col, vec_col)
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    classes = (
        every.withColumn("h", F.xxhash64("v"))
        .withColumn("nth", F.dense_rank().over(same))
        .where(F.col("nth") <= k + 1)
        .groupBy("h", "v")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("members"))
        .select(F.element_at("members", 1).alias("class_id"), "v", "members")
    )
    classes = materialize(classes, "ann-classes")
    fitted = fit_forest(classes.select(F.col("class_id").alias("vec_id"), "v"), trees, max_fit)
    spark = vectors.sparkSession
    if not fitted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(fitted)
    share = calibrated_share(spark, shared, k, recall) if search_share is None else search_share
    search = max(min(k + 2, fitted[0].fitted), int(np.ceil(share * fitted[0].fitted)))

    # an id with several vectors asks with each of them
    asked = usable_vectors(queries, id_col, vec_col).distinct().withColumn("q", F.xxhash64("vec_id", "v"))
    asked = materialize(asked, "ann-queries")
    # blocks are runs of the first tree's leaves, which hold about as many vectors each; where a block would be
    # a part of a leaf, a hash cuts it
    first_leaves = fitted[0].first_leaves
    n_vector, n_query = -(-classes.count() // VECTOR_BLOCK) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    runs, query_runs, cuts = min(n_vector, first_leaves), min(n_query, first_leaves), -(-n_vector // first_leaves)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = shared.value
        for batch in batches:
            leaves = forest.leaves(_matrix(batch.column(1)).astype(np.float32))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1]).cast(pa.list_(pa.int32()))
            block = leaves[:, 0].astype(np.int64) * runs // first_leaves
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(block)], ["class_id", "v", "leaves", "vb"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, x = shared.value
        block_of = np.empty(forest.fitted, np.int64)
        block_of[forest.members[: forest.fitted]] = np.repeat(np.arange(first_leaves), forest.sizes[:first_leaves]) * runs // first_leaves
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1)).astype(np.float32)
            opened = [forest.open(place, bound, search, v, x, k + 1) for v, (place, bound) in zip(q, forest.leaf_order(q))]
            blocks = [np.unique(block_of[forest.points_of(o)]) for o in opened]
            qb = forest.leaves(q)[:, 0].astype(np.int64) * query_runs // first_leaves
            columns = [pa.array(opened, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.int64())), pa.array(qb)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["q", "v", "opened", "blocks", "qb"])

    def rerank(queries_: pa.Table, vectors_: pa.Table) -> pa.Table:
        """The k + 1 nearest of one block's vectors for each query of one block, among its candidates."""
        forest, _ = shared.value
        out: list[tuple[int, int, float]] = []
        if queries_.num_rows and vectors_.num_rows:
            ids, x = vectors_.column("class_id").to_numpy(), _matrix(vectors_.column("v").combine_chunks())
            leaves = _matrix(vectors_.column("leaves").combine_chunks()).astype(np.int64)
            is_open = np.zeros(len(forest.sizes), bool)
            for q, v, opened in zip(queries_.column("q").to_pylist(), _matrix(queries_.column("v").combine_chunks()), queries_.column("opened")):
                at = opened.values.to_numpy()
                is_open[at] = True
                candidates = np.flatnonzero(is_open[leaves].any(axis=1))
                is_open[at] = False
                apart = x[candidates] - v
                score = np.sqrt((apart * apart).sum(axis=1))
                best = np.lexsort((ids[candidates], score))[: k + 1]
                out += [(q, int(ids[candidates[i]]), float(score[i])) for i in best]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "class_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    dealt = classes.select("class_id", "v").mapInArrow(lambda it: deal(_blocks(it)), "class_id long, v array<double>, leaves array<int>, vb long")
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("class_id", F.lit("cut")), F.lit(cuts)))
    spread = asked.select("q", "v").repartition(max(2, min(64, n_query * 8)), "q")
    opened = spread.mapInArrow(lambda it: probe(_blocks(it)), "q long, v array<double>, opened array<int>, blocks array<long>, qb long")
    opened = materialize(opened, "ann-opened")
    wanted = opened.select("q", "v", "opened", "qb", F.explode("blocks").alias("vb"))
    # a vector goes to the blocks of queries that open a leaf in its block
    reach = small(wanted.select(F.col("qb").alias("by"), F.col("vb").alias("in")).distinct())
    dealt = dealt.join(reach, F.col("vb") == F.col("in")).select("class_id", "v", "leaves", F.col("by").alias("qb"), F.col("in").alias("vb"), "cut")
    wanted = wanted.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cuts - 1).cast("long"))))
    pairs = wanted.groupBy("qb", "vb", "cut").cogroup(dealt.groupBy("qb", "vb", "cut")).applyInArrow(rerank, "q long, class_id long, score double")
    scored = pairs.join(classes.select("class_id", "members"), "class_id").select("q", "members", "score")
    near = Window.partitionBy("q").orderBy("score", "first")
    # the k + 1 nearest classes hold the k nearest ids, the query's own one aside
    top = scored.withColumn("first", F.element_at("members", 1)).withColumn("n", F.row_number().over(near))
    found = (
        top.where(F.col("n") <= k + 1)
        .join(asked.select("q", F.col("vec_id").alias("query_id")), "q")
        .select("query_id", F.explode("members").alias("vec_id"), "score")
        .where(F.col("vec_id") != F.col("query_id"))
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller blocks, which bound what one block of all trees holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            yield batch.slice(i, 512)
