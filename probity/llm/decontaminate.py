"""Benchmark decontamination by Wu-Manber search over words.

Every window of benchmark words is a pattern. A table of two-word blocks says how far the search may jump: a block
that is in no pattern lets it pass by almost a whole pattern. Where the block can end a pattern, a bucket
of that suffix, cut further by the first word, names the patterns to compare word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import ready, slim, stored

WINDOW = 13
BLOCK_WORDS = 200_000
SHARE = 20

# Every byte that is no word byte becomes a space; ASCII capitals become small. Bytes of other characters stay.
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))

FOUND = ["n_words", "starts", "ends", "items"]


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text with ASCII capitals made small; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


class WuManber:
    """Occurrences of word patterns that have at least ``shortest`` words."""

    def __init__(self, patterns: dict[tuple, frozenset]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.jump = m - b + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict] = {}
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                key = pattern[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.jump), m - end)
            suffix = self.buckets.setdefault(pattern[m - b : m], {})
            suffix.setdefault(pattern[0], []).append((pattern, items))

    def search(self, words: list) -> Iterator[tuple[int, int, frozenset]]:
        """(start, end, items) of every occurrence; ``words`` are numbers, 0 for a word in no pattern."""
        m, b, n, jump, shift = self.least, self.block, len(words), self.jump, self.shift
        i = m
        while i <= n:
            block = tuple(words[i - b : i])
            step = shift.get(block, jump)
            if step:
                i += step
                continue
            start = i - m
            for pattern, items in self.buckets[block].get(words[start], ()):
                end = start + len(pattern)
                if end <= n and tuple(words[start:end]) == pattern:
                    yield start, end, items
            i += 1


class Patterns:
    """Windows of a block of benchmark items. Items shorter than a window are searched apart, so they don't shorten its jumps."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        groups: dict[bool, dict[tuple, set]] = {True: {}, False: {}}
        for item, text in items:
            words = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text))
            full = len(words) >= window
            for i in range(max(1, len(words) - window + 1) if words else 0):
                groups[full].setdefault(words[i : i + window], set()).add(item)
        self.machines = [WuManber({p: frozenset(x) for p, x in g.items()}) for g in groups.values() if g]

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [start, end) runs of hit words and the items with an occurrence."""
        numbers = [self.ids.get(w, 0) for w in words]
        hits, items = [], set()
        for machine in self.machines:
            for start, end, found in machine.search(numbers):
                hits.append((start, end))
                items |= found
        return merged(hits), items


def merged(runs: Iterable) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


_PATTERNS: dict[int, Patterns] = {}


def _search(batches: Iterable[pa.RecordBatch], items, window: int) -> Iterator[pa.RecordBatch]:
    if items.id not in _PATTERNS:
        _PATTERNS.clear()  # one block of patterns per worker at a time
        _PATTERNS[items.id] = Patterns(items.value, window)
    patterns = _PATTERNS[items.id]
    for batch in batches:
        c = batch.to_pydict()
        out: list[list] = [[], [], [], []]
        for text, starts, ends, known in zip(c["text"], c["starts"], c["ends"], c["items"]):
            words = words_of(text)
            runs, found = patterns.search(words)
            runs = merged([*runs, *map(list, zip(starts, ends))]) if starts else runs
            for col, v in zip(out, (len(words), [r[0] for r in runs], [r[1] for r in runs], sorted({*known, *(i for i in found if i is not None)}))):
                col.append(v)
        longs = pa.list_(pa.int64())
        types = [pa.int64(), longs, longs, pa.list_(pa.string())]
        before = [n for n in batch.schema.names if n not in FOUND]
        cols = [*(batch[n] for n in before), *(pa.array(c, t) for c, t in zip(out, types))]
        yield pa.RecordBatch.from_arrays(cols, names=[*before, *FOUND])


def _pieces(batches: Iterable[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """Items cut so that every window of words is whole in one piece; an item below a window is one piece."""
    for batch in batches:
        out: list[tuple] = []
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
            words = words_of(text)
            for at in range(0, max(1, len(words) - window + 1) if words else 0, size - window + 1):
                own = words[at : at + size]
                out.append((item, b" ".join(own).decode("utf-8"), len(own)))
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["item", "text", "n"])


def item_pieces(benchmark: DataFrame, id_column="item_id", text_column="text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """Pieces of the benchmark's items, each with the number of its ``block``, and the count of blocks of about ``block_words`` words."""
    items = slim(benchmark, item=benchmark[id_column].cast("string"), text=text_column).filter(F.col("text").isNotNull())
    size = max(2 * window, block_words // 16)
    pieces = stored(items.mapInArrow(lambda b: _pieces(b, window, size), "item string, text string, n long"))
    blocks = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / block_words))
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), blocks


def block_items(pieces: DataFrame, block: int) -> list[tuple]:
    """The pieces of one block, the bound of what the driver holds and every worker gets at a time."""
    return [(r.item, r.text) for r in pieces.filter(F.col("block") == block).select("item", "text").collect()]


def find(
    docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text_column="text", item_id="item_id", item_text="text", window: int = WINDOW,
    block_words: int = BLOCK_WORDS, keep=(),
) -> DataFrame:
    """Every document with ``n_words``, the hit word runs (``starts``, ``ends``) and the ``items`` that occur in it.

    Columns to ``keep`` come back as ``keep0``, ``keep1``, ...

    A benchmark larger than a block is searched block by block: a block is collected, sent and searched, and only what it finds is
    written (two hashes of the text, word runs, items), so the driver and a task hold one block only, and the documents are never written. What
    all blocks found joins the documents once at the end. Null and empty texts have no words; null item texts are no patterns; an item
    without id marks words but is not listed; repeated items count once, repeated documents each; empty tables give
    empty or unmarked results. Item ids are compared and sorted as strings by code point.
    """
    spark = ready(docs.sparkSession)
    empty = F.array().cast("array<long>")
    own = {f"keep{i}": c for i, c in enumerate(keep)}
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column, **own).withColumns(
        {"n_words": F.lit(0).cast("long"), "starts": empty, "ends": empty, "items": _no_items()}
    )
    pieces, blocks = item_pieces(benchmark, item_id, item_text, window, block_words)
    if blocks > 1:
        rows = rows.drop("starts", "ends", "items").join(found_by_block(rows, pieces, blocks, window), text_keys(F.col("text")), "left")
        rows = rows.select("doc_id", "text", *own, "n_words", *(F.coalesce(c, d).alias(c) for c, d in (("starts", empty), ("ends", empty), ("items", _no_items()))))
    sent = _Sent(spark.sparkContext.broadcast(block_items(pieces, 0) if blocks == 1 else []))
    return rows.mapInArrow(lambda b: _search(b, sent, window), rows.schema)


def _no_items() -> Column:
    return F.array().cast("array<string>")


def text_keys(text: Column) -> Column:
    """Equal texts have equal occurrences: what was found joins the rows by two hashes of the text."""
    return (F.xxhash64(text) == F.col("k1")) & (F.xxhash64(text, F.lit(1)) == F.col("k2"))


def found_by_block(rows: DataFrame, pieces: DataFrame, blocks: int, window: int) -> DataFrame:
    """``k1, k2, starts, ends, items`` of every text with an occurrence in any block."""
    spark, parts = rows.sparkSession, []
    empty = F.array().cast("array<long>")
    texts = rows.filter(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), "text", F.lit(0).cast("long").alias("n_words"), empty.alias("starts"),
        empty.alias("ends"), _no_items().alias("items"),
    )
    for i in range(blocks):
        sent = _Sent(spark.sparkContext.broadcast(block_items(pieces, i)))
        found = texts.mapInArrow(lambda b, s=sent: _search(b, s, window), texts.schema).filter(F.size("starts") > 0)
        parts.append(stored(found.select("k1", "k2", "starts", "ends", "items").dropDuplicates(["k1", "k2"])))
        sent.broadcast.unpersist()
    merged_parts = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2")
    return merged_parts.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))  # at most one list per block


class _Sent:
    """A broadcast with a number that workers can keep their tables by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def judged(found: DataFrame, share: int = SHARE, keep: int = 0) -> DataFrame:
    """Counts, digest of the items and the verdict: at least one ``share``-th of the words is hit. ``keep``: kept columns to hand on."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    own = [f"keep{i}" for i in range(keep)]
    rows = found.select("doc_id", *own, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return rows.select(
        "doc_id", *own, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), bad.alias("contaminated")
    )
