"""Consensus of read families against a plain vote."""

import random
from collections import Counter

import pytest

from breakweave.operators import aggregates, consensus

SETS = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT", "-": ""}
OF = {frozenset(v): k for k, v in SETS.items() if v} | {frozenset(): "N"}


def code(bases):
    return OF[frozenset("".join(SETS[b] for b in bases))]


def plain_strand(reads, whole=0.7, each=0.667):
    counts = Counter(reads)
    top = min(counts, key=lambda s: (-counts[s], s))
    n = len(reads)
    if "-" not in top and (len(counts) == 1 or n > 2 and counts[top] >= whole * n):
        return top
    out = ""
    for column in zip(*reads):
        votes = Counter(b for b in column if b != "-")
        best = min(votes, key=lambda b: (-votes[b], b), default="N")
        out += best if n > 2 and votes and votes[best] >= each * sum(votes.values()) else code(votes)
    return out


def plain(strands):
    found = {k: plain_strand(v) for k, v in strands.items() if v}
    if len(found) < 2:
        (one,) = found.values()
        return one, "".join("G" if b in "ACGT" else "!" for b in one), False
    both = found[0] if found[0] == found[1] else "".join(code(p) for p in zip(found[0], found[1]))
    return both, "".join("I" if b in "ACGT" else "!" for b in both), True


@pytest.mark.parametrize("with_quality", [False, True])
def test_both_strands_match_a_plain_vote(spark, with_quality):
    r = random.Random(with_quality)
    rows, want = [], {}
    for mol in range(150):
        true = "".join(r.choices("ACGT", k=12))
        strands = {k: [] for k in range(2)}
        for k in range(2):
            for _ in range(r.choice([0, 1, 2, 2, 3, 5])):
                s = "".join(r.choice("ACGTN") if r.random() < 0.12 else b for b in true)
                q = "".join(chr(33 + r.choice([10, 30])) for _ in s)
                rows.append((mol, k, s, q))
                strands[k].append("".join(b if c >= chr(33 + 20) else "-" for b, c in zip(s, q)) if with_quality else s)
        if any(strands.values()):
            want[mol] = (*plain(strands), len(strands[0]), len(strands[1]))
    df = spark.createDataFrame(rows + [(999, 0, None, None), (998, 7, "A", "I")], "mol int, strand int, s string, q string")
    got = consensus.duplex_consensus(df, "mol", "strand", "s", "q" if with_quality else None, 20)
    assert {x.mol: tuple(x)[1:] for x in got.collect()} == want


def test_a_large_family_is_a_few_rows(spark):
    df = spark.range(5000).selectExpr("1 as mol", "0 as strand", "case when id % 4 = 0 then 'ACGA' when id % 4 = 1 then 'ACGC' else 'ACGT' end as s", "id")
    assert [tuple(x) for x in consensus.duplex_consensus(df, "mol", "strand", "s").collect()] == [(1, "ACGH", "GGG!", False, 5000, 0)]
    few = consensus.duplex_consensus(df, "mol", "strand", "s", most_reads=11, read_id="id").collect()[0]
    assert few.n_reads0 == 11 and few.consensus.startswith("ACG")
    assert consensus.duplex_consensus(df.where("1 = 0"), "mol", "strand", "s").collect() == []


def test_tasks_grow_with_the_reads(spark, monkeypatch):
    """Bases become rows in tasks of bounded reads, whatever the session's number of partitions; results stay."""
    df = spark.range(900).selectExpr("id % 90 as mol", "cast(id % 2 as int) as strand", "substr('ACGTTGCA', cast(id % 4 + 1 as int), 4) as s")
    calls = (lambda: aggregates.strand_consensus(df, ["mol"], "s"), lambda: consensus.duplex_consensus(df, "mol", "strand", "s"))
    whole = [sorted(map(tuple, f().collect())) for f in calls]
    monkeypatch.setattr(aggregates, "READS_A_TASK", 90)
    for f, want in zip(calls, whole):
        got = f()
        assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, got.collect())) == want
    assert aggregates.families(df, 900, ["mol"]).rdd.getNumPartitions() == 10
