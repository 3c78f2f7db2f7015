"""Partner counts against brute force over all pairs."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from probity.operators import collusion

SHAPE = "reviewer_id string, place_id long, stars double, text string"


def brute(rows, least=2):
    cells, own, shared = defaultdict(set), defaultdict(set), defaultdict(set)
    for r, p, s, _ in rows:
        if None not in (r, p, s):
            cells[p, s].add(r)
            own[r].add(p)
    for (p, _), members in cells.items():
        for a, b in combinations(sorted(members), 2):
            shared[a, b].add(p)
    partners = defaultdict(int)
    for (a, b), places in shared.items():
        if len(places) >= least:
            partners[a] += 1
            partners[b] += 1
    return {r: (partners[r], len(p)) for r, p in own.items()}


def rows_with(reviewers, places, n, hot, seed):
    """A third of the rows belong to one business when ``hot``, and one reviewer has been everywhere."""
    draw = random.Random(seed)
    rows = [(f"r{draw.randrange(reviewers)}", 0 if hot and i % 3 == 0 else draw.randrange(places), float(draw.choice([1, 5])), "x") for i in range(n)]
    rows += [("everywhere", p, 5.0, "x") for p in range(places)] * 2
    return rows + [(None, 1, 1.0, "x"), ("lonely", None, 1.0, "x"), ("lonely", 1, None, "x"), ("one place", 1, 1.0, None), ("one place", 1, 5.0, None)]


@pytest.mark.parametrize("reviewers, places, n, hot, block, tile", [(40, 12, 300, False, 4, 2), (200, 50, 900, True, 8, 2), (90, 9, 700, True, 1024, 32)])
@pytest.mark.parametrize("least", [2, 3])
def test_partners_equal_brute_force(spark, reviewers, places, n, hot, block, tile, least):
    rows = rows_with(reviewers, places, n, hot, n)
    df = spark.createDataFrame(rows, SHAPE)
    got = collusion.partner_counts(df, least=least, block=block, tile=tile).collect()
    assert {r.reviewer_id: (r.partners, r.businesses) for r in got} == brute(rows, least)
    assert all(r.collusion == r.partners / r.businesses for r in got)


def test_no_rows(spark):
    assert collusion.partner_counts(spark.createDataFrame([], SHAPE)).count() == 0


def test_hot_business_is_spread_over_tiles(spark):
    rows = [(f"r{i}", p, 5.0, "") for i in range(64) for p in (0, 1 + i % 2)]
    df = spark.createDataFrame(rows, SHAPE)
    found = collusion.partner_counts(df, block=2, tile=4)
    plan = found._jdf.queryExecution().toString()
    assert {r.partners for r in found.collect()} == {31} and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("least", [2, 3])
def test_businesses_with_many_different_stars(spark, least):
    draw = random.Random(least)
    rows = [(f"r{draw.randrange(30)}", draw.randrange(4), float(draw.randrange(20)), "") for _ in range(1200)]
    got = collusion.partner_counts(spark.createDataFrame(rows, SHAPE), least=least, block=8, tile=2).collect()
    assert {r.reviewer_id: (r.partners, r.businesses) for r in got} == brute(rows, least)


def test_a_block_is_one_row(spark):
    # Two blocks meet with two rows, not with one for each cell that they share.
    rows = [(i, cell // 2, cell, i) for i in range(40) for cell in range(50)]
    df = spark.createDataFrame(rows, "block long, place long, cell long, at int").withColumn("block", F.floor(F.col("block") / 8)).withColumn("at", F.col("at") % 8)
    packed = df.repartition("block").sortWithinPartitions("block", "cell", "at").mapInArrow(collusion._packed, collusion.PACKED).collect()
    assert sorted(r.block for r in packed) == list(range(5))
    for r in packed:
        m = collusion.Members(r.places, r.cells, r.sizes, r.members)
        assert m.cells.tolist() == list(range(50)) and set(m.sizes.tolist()) == {8} and m.members[:8].tolist() == list(range(8))


@pytest.mark.parametrize("size, share", [(64, 0.3), (64, 0.02), (300, 0.01)])
def test_block_pair_counts_dense_and_sparse_cells(size, share):
    draw = np.random.default_rng(size)
    cells, places = np.arange(90), np.arange(90) // 3

    def block():
        own = draw.random((90, size)) < share * draw.choice([0.2, 1, 3], 90)[:, None]
        at = np.nonzero(own)[1].astype(np.uint16)
        return own, collusion.Members(places.tobytes(), cells.tobytes(), own.sum(axis=1).tobytes(), at.tobytes())

    (a, left), (b, right) = block(), block()
    shared = np.zeros((size, size), int)
    for p in range(30):
        mine = places == p
        shared += (a[mine].T.astype(int) @ b[mine].astype(int)) > 0
    for least in (1, 2, 3):
        rows, columns = collusion.BlockPair(left, right, size, least, False).partners(16)
        assert rows.tolist() == (shared >= least).sum(axis=1).tolist() and columns.tolist() == (shared >= least).sum(axis=0).tolist()
