"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, md5_long, md5_unit, whole_rows, with_free_names

#: Sources up to this many are broadcast; more are joined by a shuffle that adaptive execution may split.
BROADCAST_SOURCES = 10_000
#: A larger rate is drawn as a sum of independent Poisson parts, since exp(-rate) would underflow.
PART_RATE = 500.0


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    mean_repetition: float = 1.0,
    temperature: float = 0.5,
    source_col: str = "source",
) -> DataFrame:
    """One row per source: ``mix_source, n_docs, rate`` (mean copies of each of its documents).

    Target weights are the given ones (a source that is not named has weight 0) or, by default,
    proportional to ``n_docs ** temperature``. Rates keep the corpus at ``mean_repetition`` times
    its size. A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = materialize(counts.withColumn("weight", weight), "mix-sources")
    totals = counts.agg(F.sum("n_docs").alias("docs"), F.sum("weight").alias("weight")).first()
    copies_of_weight = float(mean_repetition) * totals["docs"] / totals["weight"] if totals["weight"] else 0.0
    rate = F.lit(copies_of_weight) * F.col("weight") / F.col("n_docs")
    return counts.select("mix_source", "n_docs", rate.alias("rate"))


def _with_cdf(rates: DataFrame) -> DataFrame:
    """Add ``parts`` and the cumulative Poisson probabilities of one part's rate."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    r = rates.withColumn("parts", parts).withColumn("part_rate", F.col("rate") / F.col("parts"))
    top = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 40).cast("int")
    first = F.exp(-F.col("part_rate"))
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("part_rate") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return r.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"]))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    mean_repetition: float = 1.0,
    temperature: float = 0.5,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Repeat each document a Poisson number of times and shuffle all copies globally.

    The number of copies inverts the Poisson distribution function at a uniform number hashed from
    (seed, id), so reruns and lost tasks give the same copies. Each copy is dealt to a partition by
    a hash of (seed, id, copy) and sorted by it: reading the partitions in order reads the corpus
    in a random order.

    Adds ``copy`` (from 1), ``rate`` and ``shuffle_key``; input columns with these names are
    replaced. Null sources form one source, a null id hashes as the word null, repeated rows get
    equal draws, and an empty table gives an empty result. Texts are only carried along.
    """
    docs = with_free_names(docs, "copy", "rate", "shuffle_key")
    rates = materialize(
        _with_cdf(source_rates(docs, weights, mean_repetition, temperature, source_col)), "mix-rates"
    ).select("mix_source", "rate", "parts", "cdf")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc")[id_col].cast("string"), F.lit("null"))

    def draw(part):
        u = md5_unit(F.lit(seed), key, part.cast("string"))
        return F.size(F.filter("cdf", lambda c: c < u))

    n = F.when(F.col("parts") == 1, draw(F.lit(0))).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda acc, p: acc + draw(p))
    )
    held = docs.select(whole_rows(docs))
    joined = held.join(rates, F.col("doc")[source_col].eqNullSafe(F.col("mix_source")))
    copies = joined.withColumn("n", n).where(F.col("n") > 0).select("doc", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", md5_long(F.lit(seed), F.lit("order"), key, F.col("copy").cast("string")))
    dealt = keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", F.col("doc")[id_col], "copy")
    return dealt.select("doc.*", "rate", "copy", "shuffle_key")
