"""The registered query of each operator: whole tables in, the agreed columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, langid, license, quality
from .ann import nearest_neighbours
from .common import table
from .decontaminate import find_leaks
from .html_text import extract_text
from .jaccard import jaccard_components
from .license_texts import PHRASES, TEMPLATES
from .lines import dedup_lines
from .mixing import poisson_mix
from .pii import find_pii
from .tokens import read_token_shards, write_token_shards
from .whitening import whiten


def _mod(n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n

QUERIES = {}
ORACLES = {}


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of ``documents`` after mixing sources by the square root of their sizes."""
    return poisson_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "text", "copy", F.round("rate", 6).alias("rate"), "shuffle_key"
    )


QUERIES["op2_poisson_mix"] = op2_poisson_mix
ORACLES["op2_poisson_mix"] = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE * (SELECT sum(n) FROM counts) * w / (SELECT sum(w) FROM counts) / n AS rate FROM counts),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT *, (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null') || '|0'), 1, 13))::BIGINT::DOUBLE + 0.5)
  / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.lang, d.text, c.rate, count(*) FILTER (WHERE c.c < d.u) AS n
  FROM (SELECT *, row_number() OVER () AS row_n FROM u) d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY d.row_n, d.doc_id, d.source, d.lang, d.text, c.rate),
copies AS (SELECT doc_id, source, lang, text, rate, unnest(range(1, n + 1))::INTEGER AS copy FROM n)
SELECT doc_id, source, lang, text, copy, round(rate, 6) AS rate,
  ('0x' || substr(md5('mix|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy::VARCHAR), 1, 15))::BIGINT AS shuffle_key
FROM copies"""


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in binary shards, read back from them."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_shards(write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


QUERIES["op5_token_shards"] = op5_token_shards


def op6_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by prototypes learned where the id's remainder is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_mod(4) == 2).alias("held_out"))
    langs, prototypes = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), langs, prototypes).drop("text")


QUERIES["op6_hyperdimensional_language"] = op6_hyperdimensional_language


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by labels whose id's remainder is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_mod(3) == 1).alias("held_out"))
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(_mod(3) != 1))
    scored = quality.score(docs, weights).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES["op9_quality"] = op9_quality


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, with a digest of the base spans."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


QUERIES["op1_personal_data"] = op1_personal_data


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES["op4_main_text"] = op4_main_text


def op10_tree_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every row whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES["op10_tree_forest_search"] = op10_tree_forest_search


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word n-grams have a Jaccard similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, per_100=85)


QUERIES["op7_jaccard_join"] = op7_jaccard_join
ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n_both FROM grams a JOIN grams b
  ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM overlap WHERE 100 * n_both >= 85 * (na + nb - n_both)),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, edges.v FROM reach JOIN edges ON edges.u = reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM sets s
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = s.doc_id"""


def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ``benchmark`` that documents hold, whole or as paraphrases."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op8_latent_leaks"] = op8_latent_leaks


def op3_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that an earlier one has."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed", "text")


QUERIES["op3_line_alignment"] = op3_line_alignment


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every usable row of ``embeddings``."""
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES["op11_whitening"] = op11_whitening


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and spans of every document."""
    joined = {n: F.concat_ws(",", n).alias(n) for n in ("base_labels", "labels")}
    return license.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", *joined.values(), "score"
    )


QUERIES["op12_license_scan"] = op12_license_scan
_PHRASE_SQL = " UNION ALL ".join(
    f"SELECT rid, i AS place, '{label}' AS label FROM pos WHERE " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split(), 1))
    for phrase, label in PHRASES.items()
)
ORACLES["op12_license_scan"] = rf"""
WITH given(template, label, text) AS (VALUES {", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))}),
texts AS (SELECT row_number() OVER () AS rid, doc_id, NULL::INTEGER AS template, NULL::VARCHAR AS label, text FROM documents
  UNION ALL SELECT NULL, NULL, template, label, text FROM given),
split AS (SELECT rid, doc_id, template, label, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM texts),
docs AS (SELECT rid, doc_id, w, len(w) AS n FROM split WHERE template IS NULL),
pos AS (SELECT rid, w, unnest(range(0, n)) AS i FROM docs),
base AS ({_PHRASE_SQL}),
base_of AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS base_labels
  FROM base GROUP BY rid),
runs AS (SELECT template, label, len(w) AS length, i AS t_pos, array_to_string(w[i + 1:i + 4], ' ') AS run
  FROM (SELECT *, unnest(range(0, len(w) - 3)) AS i FROM split WHERE template IS NOT NULL)),
hits AS (SELECT rid, template, label, length, i, i - t_pos AS diagonal FROM pos JOIN runs
  ON i <= len(w) - 4 AND array_to_string(w[i + 1:i + 4], ' ') = run),
steps AS (SELECT *, least(4, coalesce(i - lag(i) OVER (PARTITION BY rid, template, diagonal ORDER BY i), 4)) AS step FROM hits),
diagonals AS (SELECT rid, template, label, length, diagonal, sum(step) AS covered, min(i) AS a, max(i) + 4 AS b FROM steps GROUP BY ALL),
far AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS is_far FROM diagonals),
nth AS (SELECT *, sum(is_far) OVER (PARTITION BY rid, template ORDER BY diagonal) AS nth FROM far),
spans AS (SELECT rid, label, length, max(b) - min(a) AS wide, least(sum(covered), length, max(b) - min(a)) AS covered FROM nth
  GROUP BY rid, template, label, length, nth),
span_of AS (SELECT rid, max(covered::DOUBLE / length) AS share, list(label) FILTER (WHERE covered::DOUBLE / length >= 0.75 AND covered::DOUBLE / wide >= 0.6) AS found
  FROM spans GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base_labels, found))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base_of USING (rid) LEFT JOIN span_of USING (rid)"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every usable row of ``embeddings``, with a digest of the codebooks."""
    coded, codebooks = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(codebooks)).alias("codebooks_sha256"))


QUERIES["op13_vector_codes"] = op13_vector_codes
