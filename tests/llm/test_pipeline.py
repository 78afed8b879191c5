"""The pipeline on a small corpus: each stage's decisions, and rows that follow from them."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == columns, name
        if name != "mixing":
            assert 0.5 * n < out.count() <= n and out.join(docs, "doc_id", "left_anti").count() == 0, name
            n = out.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(last.columns)


def odd_rows(spark, *, more: list[str] = ()):
    """Documents with nulls, empty and long texts and repeated rows; ``more`` extra columns, and one with maps."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27)]
    rows += [(4, "one two three four five six", "en", "b", 27), (5, "word " * 20000, "en", "b", 100000)]
    odd = spark.createDataFrame(rows, schema)
    if more:
        odd = odd.withColumns({c: F.lit(f"own {c}") for c in more}).withColumn("tags", F.create_map(F.lit("k"), F.array(F.create_map(F.lit(1), F.lit("v")))))
    return odd


#: Every column name that a stage uses inside.
INTERNAL = """copy rate shuffle_key mix_source n_docs parts part_rate cdf mix_n n weight doc id key u y train_id trainer quality_score score
 __t __row __id t component leak row f first a b h v start n_tokens ids_crc32 shard position""".split()


def test_each_stage_on_odd_rows(spark):
    """What nulls, empty and long texts and repeated rows give, stage by stage."""
    odd = odd_rows(spark)
    got = {name: stage(spark, odd, SF) for name, stage in corpus_pipeline.STAGES}
    ids = lambda name: sorted((r.doc_id for r in got[name].collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    # equal texts have equal scores, so a text's rows stay or go together
    kept = [r for r in got["quality"].collect()]
    for text in {t for _, t in rows}:
        assert sum(r.text == text for r in kept) in (0, sum(t == text for _, t in rows))
    empty = [r.doc_id for r in kept if not r.text]
    assert sorted(empty, key=str) in ([], [1, 2, None])
    assert ids("near_duplicates") == [1, 2, 3, 5, None]
    assert ids("decontamination") == sorted((i for i, _ in rows), key=str)
    # the copies are those of a plain Poisson draw by md5
    sources = {s: [r.source for r in odd.collect()].count(s) for s in (None, "a", "b")}
    total = sum(n**0.5 for n in sources.values())
    want = []
    for r in odd.collect():
        rate = len(rows) * sources[r.source] ** 0.5 / total / sources[r.source]
        draw = (int(hashlib.md5(f"mix|{'null' if r.doc_id is None else r.doc_id}|0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c < draw:
            n += 1
            p *= rate / n
            c += p
        want += [r.doc_id] * n
    assert ids("mixing") == sorted(want, key=str)
    shards = sorted(got["token_shards"].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in shards] == [None, 1, 2, 3, 3, 4, 5] and [r.n_tokens for r in shards][:3] == [1, 1, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(shards, shards[1:]))


def test_each_stage_on_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_rows(spark).limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_pass_through(spark, name):
    """Extra columns, of every name that is used inside and with maps, come out as they went in and change nothing."""
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, more = odd_rows(spark), odd_rows(spark, more=INTERNAL)
    want, got = stage(spark, plain, SF), stage(spark, more, SF)
    if name == "token_shards":
        columns = want.columns
    else:
        columns = plain.columns
        assert got.columns == more.columns
        for r in got.collect():
            assert all(r[c] == f"own {c}" for c in INTERNAL) and r.tags == {"k": [{1: "v"}]}
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert key(got) == key(want)


def test_other_texts_of_an_id_survive_and_copies_go(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = lambda k: " ".join(f"word{(7 * k + j) % 50} of {k * j}" for j in range(40))
    a, b = text(1), text(2)
    near = a.replace("word7 of 0", "other of 0", 1)
    rows = [(1, a), (4, a), (4, b), (None, a), (None, text(3)), (9, near), (10, text(3)), (11, text(4)), (11, text(4)), (None, text(5)), (None, text(5))]
    rows += [(12, None), (12, None), (None, " "), (13, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], schema)
    for df in (docs, docs.repartition(3), docs.union(docs.where("doc_id = 77"))):
        kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=str)
        want = [(1, a), (4, b), (10, text(3)), (11, text(4)), (None, text(5)), (12, None), (12, None), (None, " "), (13, "")]
        assert kept == sorted(want, key=str)


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == [i for i in ids if find(i) == i] and len(kept) < len(ids)


def test_leaks_go_with_or_without_an_id(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    clean = "a plain text that nobody has seen in any benchmark of any kind at all"
    rows = [(None, f"before {items[0]} after"), (1, clean), (1, f"x {items[1]}"), (2, f"x {items[2]} y"), (2, f"x {items[2]} y"), (None, clean), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], schema)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, clean), (None, clean), (3, None), (4, "")], key=str)


def test_tables_of_stages_go_once_the_next_is_written(spark):
    from pathlib import Path

    from breakweave.llm.common import shared_dir

    def tables():
        return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}

    before = tables()
    out = corpus_pipeline.run(spark, SF)
    left = {n.rsplit("-", 1)[0] for n in tables() - before}
    assert {n for n in left if n.startswith(("stage-", "near-", "jaccard-"))} == {"stage-mixing"}
    assert out.count() > 0
