"""Reviewers who meet at several businesses: exact co-occurrence counts without a row per pair of reviewers.

Reviewers are numbered from few to many reviews and dealt into blocks of ``BLOCK`` numbers, so light reviewers share blocks with
light ones. A block is one row: its cells (business, stars) with the members in each. Every two blocks meet in one task, which counts
the shared cells of all their members in a matrix: cells that many members share by a matrix product, the others meeting by meeting.
Only counts per reviewer leave it. Work grows with the square of the reviewers, memory with a block, and a lost executor repeats
only its own block pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.operators.ordered import global_row_number
from probity.session import cut_lineage

BLOCK = 4096  # at most 65,536
TILE = 512  # rows of the matrix that are judged at a time
UNIT = 1 << 20  # what a shared cell counts in the matrix, besides the weight of its business
WEIGHT = 1 << 16
MEETINGS = 1 << 21  # meetings counted at a time
CELLS = 1024  # cells multiplied at a time
PAIR_TASKS = 20_000
PACKED = "block long, places binary, cells binary, sizes binary, members binary"


class Members:
    """The cells of a block, sorted by cell, with the members of each."""

    def __init__(self, places: bytes, cells: bytes, sizes: bytes, members: bytes):
        self.places, self.cells = np.frombuffer(places, np.int64), np.frombuffer(cells, np.int64)
        self.sizes, self.members = np.frombuffer(sizes, np.int64), np.frombuffer(members, np.uint16)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def only(self, at: np.ndarray) -> Members:
        out = object.__new__(Members)
        out.places, out.cells, out.sizes = self.places[at], self.cells[at], self.sizes[at]
        out.members, out.starts = self.members[_spans(self.starts[at], out.sizes)], np.cumsum(out.sizes) - out.sizes
        return out

    def dense(self, rows: int, values: np.ndarray | int = 1, dtype=np.float32) -> np.ndarray:
        out = np.zeros((rows, len(self.cells)), dtype)
        out[self.members, np.repeat(np.arange(len(self.cells)), self.sizes)] = np.repeat(np.broadcast_to(values, len(self.sizes)), self.sizes)
        return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans, one span behind the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _weights(places: np.ndarray) -> np.ndarray:
    """A number from 1 to below ``WEIGHT`` for each business."""
    h = places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % (WEIGHT - 1) + 1


class BlockPair:
    """Which members of one block share at least ``least`` businesses with which of another."""

    def __init__(self, left: Members, right: Members, size: int, least: int, same: bool):
        _, i, j = np.intersect1d(left.cells, right.cells, assume_unique=True, return_indices=True)
        order = np.argsort(left.places[i], kind="stable")
        self.left, self.right = left.only(i[order]), right.only(j[order])
        self.size, self.least, self.same = size, least, same
        self.places = self.left.places
        self.firsts = np.flatnonzero(np.append(True, self.places[1:] != self.places[:-1])) if len(self.places) else np.empty(0, np.int64)
        # So many cells lie in ``least`` businesses for certain, whatever their places.
        widest = int(np.diff(np.append(self.firsts, len(self.places))).max()) if len(self.places) else 0
        self.sure = (least - 1) * widest + 1
        # Sums below ``sure`` units are whole numbers that the type holds; larger ones need not be exact.
        self.exact = self.sure < 15

    def sums(self) -> np.ndarray:
        """For each two members the sum over shared cells of a unit and the weight of the cell's business."""
        out = np.zeros((self.size, self.size), np.float32)
        value = (UNIT + _weights(self.places)).astype(np.float32) if self.exact else np.full(len(self.places), UNIT, np.float32)
        meetings = self.left.sizes * self.right.sizes
        many = meetings * 300 > self.size * self.size
        dense = np.flatnonzero(many)
        for at in range(0, len(dense), CELLS):
            some = dense[at : at + CELLS]
            out += self.left.only(some).dense(self.size, value[some]) @ self.right.only(some).dense(self.size).T
        few = np.flatnonzero(~many)
        ends = np.cumsum(meetings[few])
        flat = out.reshape(-1)
        for a, b in _chunks(ends, MEETINGS):
            some = few[a:b]
            left, right, n = self.left.only(some), self.right.only(some), self.right.sizes[some]
            row = np.repeat(left.members, np.repeat(n, left.sizes)).astype(np.int64)
            column = right.members[_spans(np.repeat(right.starts, left.sizes), np.repeat(n, left.sizes))]
            np.add.at(flat, row * self.size + column, np.repeat(value[some], meetings[some]))
        return out

    def partners(self, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
        """How many partners each member of the left and of the right block has in the other."""
        if len(self.firsts) < self.least:
            return np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        sums = self.sums()
        if self.same:
            np.fill_diagonal(sums, 0)
        weights = np.zeros(WEIGHT, bool)
        weights[_weights(self.places)] = True
        rows, columns = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        for at in range(0, self.size, tile):
            part = sums[at : at + tile]
            close = part >= self.sure * UNIT
            i, j = np.nonzero((part >= self.least * UNIT) & ~close)
            if self.exact and self.least == 2:
                found = part[i, j].astype(np.int64)
                cells, weight = found // UNIT, found % UNIT
                # Where all cells are of one business, the weight is that of the business times the cells; the others need no look.
                open_ = (weight % cells == 0) & weights[np.minimum(weight // cells, WEIGHT - 1)]
                close[i[~open_], j[~open_]] = True
                i, j = i[open_], j[open_]
            if len(i):
                yes = self._shared_places(i + at, j) >= self.least
                close[i[yes], j[yes]] = True
            rows[at : at + tile] = close.sum(axis=1)
            columns += close.sum(axis=0)
        return rows, columns

    def _shared_places(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Businesses that the pairs share, looked up one by one."""
        out = np.zeros(len(i), np.int64)
        for a, b in _chunks(np.append(self.firsts[1:], len(self.places)), CELLS):
            cells = np.arange(self.firsts[a], self.firsts[b] if b < len(self.firsts) else len(self.places))
            left, right = self.left.only(cells).dense(self.size, 1, bool), self.right.only(cells).dense(self.size, 1, bool)
            step = max(1, (1 << 25) // len(cells))
            for at in range(0, len(i), step):
                both = left[i[at : at + step]] & right[j[at : at + step]]
                out[at : at + step] += np.logical_or.reduceat(both, self.firsts[a:b] - self.firsts[a], axis=1).sum(axis=1)
        return out


def _chunks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of positions whose sizes (given by their running sums) add up to ``most`` or little more."""
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, cell and member as one row per block."""
    block, held = None, []

    def out() -> pa.RecordBatch:
        place, cell, at = (np.concatenate(c) for c in zip(*held))
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(first, len(cell)))
        found = (place[first], cell[first], sizes.astype(np.int64), at.astype(np.uint16))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in found)], names=["block", "places", "cells", "sizes", "members"])

    for batch in batches:
        blocks, *columns = (c.to_numpy() for c in batch.columns)
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if blocks[a] != block and held:
                yield out()
                held = []
            block = int(blocks[a])
            held.append([c[a:b] for c in columns])
    if held:
        yield out()


def _counted(batches: Iterable[pa.RecordBatch], size: int, least: int, tile: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block pair; the two blocks of a pair follow each other, a block's meeting with itself is one row."""
    before = None
    for batch in batches:
        for r in range(batch.num_rows):
            bi, bj, own, *packed = (c[r].as_py() for c in batch.columns)
            if bi != bj and own == bi:
                before = bi, bj, packed
                continue
            if bi != bj and (before is None or before[:2] != (bi, bj)):
                continue  # the other block has no cells that others share
            right = Members(*packed)
            left = right if bi == bj else Members(*before[2])
            rows, columns = BlockPair(left, right, size, least, bi == bj).partners(tile)
            for b, found in [(bi, rows)] if bi == bj else [(bi, rows), (bj, columns)]:
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(b * size + at, pa.int64()), pa.array(found[at], pa.int64())], names=["number", "partners"])


def partner_counts(
    rows: DataFrame, reviewer: str = "reviewer_id", place: str = "place_id", stars: str = "stars", least: int = 2,
    block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """Per reviewer: ``partners`` (others who gave at least ``least`` of the same businesses the same stars), ``businesses`` and their ratio ``collusion``.

    Exact and without caps. Rows without reviewer, business or stars do not count; repeated rows count once. Reviewers with fewer
    than ``least`` businesses and cells with one reviewer cannot add a partner and go first.
    """
    own = rows.select(F.col(reviewer).alias("r"), F.col(place).alias("p"), F.col(stars).alias("s")).dropna()
    own = cut_lineage(own.distinct())
    per_reviewer = own.groupBy("r").agg(F.countDistinct("p").alias("businesses"), F.count(F.lit(1)).alias("cells"))
    per_reviewer = cut_lineage(per_reviewer)
    busy = per_reviewer.filter(F.col("businesses") >= least).select("r", "cells")
    numbered = global_row_number(busy, F.col("cells"), "r", "number", stored=True)
    numbered = cut_lineage(numbered.select("r", (F.col("number") - 1).alias("number")))
    common = own.groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("p", "s")
    places = cut_lineage(common.select("p").distinct().withColumn("place", F.monotonically_increasing_id()))
    cells = cut_lineage(common.join(places, "p").withColumn("cell", F.monotonically_increasing_id()))
    edges = own.join(cells, ["p", "s"]).join(numbered, "r")
    members = edges.select(F.floor(F.col("number") / block).alias("block"), "place", "cell", (F.col("number") % block).cast("int").alias("at"))
    members = members.repartition("block").sortWithinPartitions("block", "cell", "at")
    blocks = cut_lineage(members.mapInArrow(_packed, PACKED))
    most = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    pairs = most * (most + 1) // 2
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs, PAIR_TASKS))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    dealt = dealt.select(F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "places", "cells", "sizes", "members")
    dealt = dealt.repartition(tasks, "bi", "bj").sortWithinPartitions("bi", "bj", "block")
    counts = dealt.mapInArrow(lambda b: _counted(b, block, least, tile), "number long, partners long")
    counts = counts.groupBy("number").agg(F.sum("partners").alias("partners"))
    named = numbered.join(counts, "number").select("r", "partners")
    out = per_reviewer.join(named, "r", "left").select(
        F.col("r").alias(reviewer), F.coalesce("partners", F.lit(0)).cast("long").alias("partners"), "businesses"
    )
    return out.withColumn("collusion", F.col("partners") / F.col("businesses"))
