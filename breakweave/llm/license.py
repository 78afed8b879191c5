"""License scans by diagonal voting, with DataFrame functions only.

All runs of ``k`` words of every text are joined by hash with the runs of the templates. A hit votes
for the diagonal ``position in the text - position in the template``; votes are summed by diagonal,
neighbouring diagonals (a few words inserted or left out) become one span, and a span counts if it
covers enough of its template and is covered densely enough itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import small
from .license_texts import PHRASES, TEMPLATES

#: Words of a run, and by how many words neighbouring diagonals may differ.
K, SLACK = 4, 3
#: Least share of a template's words that a span covers, and of the span's own words that are covered.
COVERAGE, DENSITY = 0.75, 0.6

_PLACES = "array<struct<start:int,label:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def default_templates(spark: SparkSession) -> DataFrame:
    """``template, label, text`` of the templates that come with the library."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, label string, text string")


def template_runs(templates: DataFrame, k: int = K) -> DataFrame:
    """``template, label, length, t_pos, run, h``: each run of ``k`` words of each template.

    Templates of fewer than ``k`` words, without text or without a label have none.
    """
    w = templates.where("label is not null").select("template", "label", words("text").alias("w"))
    w = w.select("*", F.size("w").alias("length")).where(F.col("length") >= k)
    runs = w.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("t_pos"))
    run = F.slice("w", F.col("t_pos") + 1, k)
    return runs.select("template", "label", "length", "t_pos", run.alias("run"), _run_hash(F.col("w"), F.col("t_pos"), k).alias("h"))


def _run_hash(w: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(w, at + i) for i in range(k)])


def _places(w: Column, phrases: Mapping[str, str]) -> Column:
    """(start, label) of every place where a phrase's words stand one after the other."""
    return F.concat(*[_places_of(w, p, label) for p, label in phrases.items()], F.array().cast(_PLACES))


def _places_of(w: Column, phrase: str, label: str) -> Column:
    first, *rest = phrase.split()

    def at(x: Column, i: Column) -> Column:
        here = x == first
        for j, r in enumerate(rest, 1):
            here = here & (F.get(w, i + j) == r)
        return F.when(here, F.struct(i.alias("start"), F.lit(label).alias("label")))

    # a text without the first word, which most are, is not walked through
    return F.when(F.array_contains(w, first), F.array_compact(F.transform(w, at))).otherwise(F.array().cast(_PLACES))


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | None = None,
    phrases: Mapping[str, str] = PHRASES,
    k: int = K,
    slack: int = SLACK,
    coverage: float = COVERAGE,
    density: float = DENSITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of every row.

    ``templates`` has ``template, label, text``; ``spans`` lists (start, end, label, template, votes,
    covered, coverage) of the verified spans by start, in words, end exclusive. ``base_labels`` and
    ``labels`` are sorted arrays: the labels of phrases, and those with the labels of spans. ``score`` is 1
    where a phrase stands, else the largest covered share of a template, 0 without any hit.

    A hit compares the words, not just the hashes. Words that two neighbouring diagonals cover both count
    twice, up to the lengths of template and span. One shuffle on (id, 64-bit hash of the text) carries
    hits and one small row a document, never texts; equal hits of equal rows are combined before it.
    Null and empty texts have no words, no labels and a score of 0; null ids are ids like others; equal rows
    come as many times as they were; an empty table gives an empty result; other columns are not read.
    The templates' runs are broadcast where a count finds at most ``joins.BROADCAST_ROWS``, else joined by shuffle.
    """
    runs = small(template_runs(default_templates(docs.sparkSession) if templates is None else templates, k))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), words(text_col).alias("w"))
    own = own.select("*", F.size("w").alias("n_words"), _places(F.col("w"), phrases).alias("base"))
    # position -1 carries the document itself, whether it has hits or not
    at = own.select("*", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - k, F.lit(-1)))).alias("pos"))
    at = at.withColumn("h", F.when(F.col("pos") >= 0, _run_hash(F.col("w"), F.col("pos"), k)))
    at = at.join(runs, "h", "left")
    is_doc = F.col("pos") < 0
    same_words = F.when(F.col("template").isNotNull(), F.slice("w", F.col("pos") + 1, k) == F.col("run"))
    at = at.where(is_doc | same_words).select(
        "doc_id", "t", "template", "label", "length", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"),
        F.when(is_doc, F.col("n_words")).alias("n_words"), F.when(is_doc, F.col("base")).alias("base"),
    )
    doc, of_doc = ["doc_id", "t"], ["copies", "n_words", "base"]
    hits = at.groupBy(*doc, "template", "label", "length", "diagonal", "pos", "n_words", "base").agg(F.count("*").alias("copies"))
    # votes of each diagonal, and the words that its runs cover
    line = [*doc, "template", "label", "length", "diagonal", *of_doc]
    before = F.lag("pos").over(Window.partitionBy(*line).orderBy("pos"))
    step = F.least(F.lit(k), F.coalesce(F.col("pos") - before, F.lit(k)))
    diagonals = (
        hits.repartition(*doc)
        .withColumn("step", step)
        .groupBy(*line)
        .agg(F.count("*").alias("votes"), F.sum("step").alias("covered"), F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
    )
    # neighbouring diagonals are one span
    order = Window.partitionBy(*doc, "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > slack, F.lit(True))
    numbered = diagonals.withColumn("far", far.cast("int")).withColumn("nth", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*doc, "template", "label", "length", "nth", *of_doc).agg(
        F.sum("votes").alias("votes"), F.sum("covered").alias("covered"), F.min("start").alias("start"), F.max("end").alias("end")
    )
    wide = F.col("end") - F.col("start")
    merged = merged.withColumn("covered", F.least("covered", "length", wide).cast("int"))
    share = F.col("covered") / F.col("length")
    holds = F.col("template").isNotNull() & (share >= coverage) & (F.col("covered") / wide >= density)
    span = F.struct("start", "end", "label", "template", F.col("votes").cast("int").alias("votes"), "covered", share.alias("coverage"))
    alone = F.col("template").isNull()
    found = merged.groupBy(*doc).agg(
        F.max(F.when(alone, F.col("copies"))).alias("copies"),
        F.max(F.when(alone, F.col("n_words"))).cast("long").alias("n_words"),
        F.first(F.when(alone, F.col("base")), ignorenulls=True).alias("base"),
        F.array_sort(F.collect_list(F.when(holds, span))).alias("spans"),
        F.max(F.when(~alone, share)).alias("share"),
    )
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("spans", lambda s: s["label"])))
    n_base = F.size("base").cast("long")
    return found.select(
        "doc_id", "n_words", n_base.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        base_labels.alias("base_labels"), labels.alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "spans",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")
