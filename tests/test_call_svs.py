"""Chains of near places in tiles, and what the plan of calls leaves in the shared folder."""

import random
from pathlib import Path

import pytest

from breakweave.fixtures import Fixtures
from breakweave.operators.joins import near_places
from breakweave.plans.call_svs import sv_molecules
from breakweave.plans.scratch import shared_dir


@pytest.mark.parametrize("steps", [2, 64])
def test_near_places_chain_as_all_pairs_do(spark, steps):
    """Tiles of two steps, which most chains cross, and one tile; equal places, negative ones and nulls."""
    r = random.Random(steps)
    rows = [(r.choice("ab"), r.randrange(-60, 60), r.randrange(-60, 60), i) for i in range(500)] + [("a", 7, 7, 500 + i) for i in range(30)]
    rows += [(None, 1, 1, 600), (None, 1, 1, 601), ("a", None, 1, 602), ("a", 1, None, 603)]
    df = spark.createDataFrame(rows, "k string, x long, y long, id long")
    found = near_places(df.repartition(5), ["k"], "x", "y", 5.0, steps).collect()
    assert sorted(x.id for x in found) == sorted(i for *_, i in rows)
    root = {i: i for *_, i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [x for x in rows if None not in x]
    for n, (k, x, y, i) in enumerate(known):
        for k2, x2, y2, j in known[:n]:
            if k == k2 and (x - x2) ** 2 + (y - y2) ** 2 <= 25:
                root[find(i)] = find(j)
    want, got = {}, {}
    for x in found:
        if None not in (x.k, x.x, x.y):
            want.setdefault(find(x.id), set()).add(x.id)
            got.setdefault((x.k, x["__x"], x["__y"]), set()).add(x.id)
        else:
            assert (x["__x"], x["__y"]) == (x.x, x.y)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_calls_leave_only_their_molecules_in_the_shared_folder(spark):
    folder = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = sv_molecules(Fixtures(spark, "/root/testdata/sf0.001").molecules, 762, 151, 1000, 1, 20, 30, 5)
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before if p.is_dir()}
    assert found.count() > 0 and not left & {"sv-grouped", "sv-types", "runs", "runs-2d", "dense-ids", "near-places", "junction-svs"}
