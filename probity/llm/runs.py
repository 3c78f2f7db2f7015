"""Runs of periodically repeated words, found with a suffix automaton and link-cut access, and texts with the repeats collapsed.

A run is a stretch of words with smallest period ``q`` and at least ``max(least, 2 q)`` words that cannot be made longer. The words of
a stretch are appended one by one. In the automaton's link tree the states of all suffixes of a prefix are the path from its
state to the root; access to that state makes the path one preferred path and recolours it with the new end position.
Each segment of old colour ``e`` that the access meets holds the suffixes with lengths in ``(low, high]`` whose last occurrence ended at
``e``. If the distance ``d`` from ``e`` to the new end lies in that range, the last ``2 d`` words are a square of a primitive word, and
every such square is met this way. Squares of the same period at consecutive ends are one run.

Words that belong to no window of ``least // 2`` words that occurs twice in the text cannot lie in a run (a run of period
``q`` repeats ``max(least - q, q)`` words or more), so only the stretches between them are given to the automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import SPACES, mix64, ready, slim

LEAST = 12
WORD = rf"[^{SPACES}]+"

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


class LinkTree:
    """The suffix links of a word sequence's automaton as a link-cut tree whose preferred paths carry one colour each.

    Node 0 stands for the root and for "none". Splay trees hold the preferred paths by depth; the root of a splay tree
    knows the colour of its path and, in ``up``, the node that the path hangs from.
    """

    def __init__(self, words: list):
        size, link, step, self.ends = [0], [-1], [{}], []
        last = 0
        for i, word in enumerate(words):
            state = len(size)
            size.append(i + 1)
            link.append(0)
            step.append({})
            p = last
            while p >= 0 and word not in step[p]:
                step[p][word] = state
                p = link[p]
            if p >= 0:
                q = step[p][word]
                if size[p] + 1 == size[q]:
                    link[state] = q
                else:
                    copy = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(word) == q:
                        step[p][word] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
            self.ends.append(state)
        link[0] = 0
        self.size, self.up = size, link
        self.left, self.right, self.colour = [0] * len(size), [0] * len(size), [-1] * len(size)

    def _splay(self, x: int) -> None:
        up, left, right, colour = self.up, self.left, self.right, self.colour
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner and (left[z] == y) == (left[y] == x):
                self._rotate(y)
            elif inner:
                self._rotate(x)
            self._rotate(x)
            y = up[x]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[y], up[x] = x, z
        self.colour[x] = self.colour[y]

    def access(self, end: int) -> Iterator[tuple[int, int, int]]:
        """Recolours the path of the prefix that ends at ``end``; yields its old segments as (colour, low, high)."""
        up, right, colour, size = self.up, self.right, self.colour, self.size
        x, below = self.ends[end], 0
        while x:
            self._splay(x)
            deeper, above = right[x], up[x]
            if deeper:
                colour[deeper] = colour[x]
            if colour[x] >= 0:
                yield colour[x], size[above], size[x]
            right[x] = below
            below, x = x, above
        colour[below] = end


def squares(words: list) -> Iterator[tuple[int, int]]:
    """(end, half length) of all squares of primitive words, ends ascending."""
    tree = LinkTree(words)
    for end in range(len(words)):
        for before, low, high in tree.access(end):
            if low < end - before <= high:
                yield end, end - before


def runs_in(words: list, least: int = LEAST, offset: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence."""
    found, last = [], {}
    for end, half in squares(words):
        run = last.get(half)
        if run is not None and run[1] == end - 1:
            run[1] = end
        else:
            last[half] = run = [end - 2 * half + 1, end, half]
            found.append(run)
    return sorted((s + offset, e - s + 1, q) for s, e, q in found if e - s + 1 >= least)


def stretches(words: list, least: int) -> list[tuple[int, int]]:
    """Word ranges outside which no run can reach: the words of windows that occur more than once."""
    width = max(1, least // 2)
    n = len(words) - width + 1
    if n < 2:
        return []
    codes = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    window = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            window = window * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n + 1, np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:n] += twice[:n]
    steps[width : width + n] -= twice[:n]
    covered = np.concatenate([[False], np.cumsum(steps) > 0])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


def runs_of(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    found = []
    for start, end in stretches(words, least):
        numbers: dict = {}
        found += runs_in([numbers.setdefault(w, len(numbers)) for w in words[start:end]], least, start)
    return sorted(found)


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def _found(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        sizes, runs, collapsed = [], [], []
        for text in texts:
            words = (text.as_py() or b"").split()
            found = runs_of(words, least)
            sizes.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            collapsed.append(collapse(words, found))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(collapsed, pa.binary())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: ``n_words``, ``runs`` by start and period, and ``collapsed``, the text without the repeats (UTF-8).

    Words are cut at the six ASCII white spaces. Null, empty and blank texts have no words, no runs and an empty collapsed text. A run ends at
    the text's end like anywhere else; runs may overlap or nest and are all given. Repeated rows and ids each give their row; an
    empty table gives none; extra columns of any name are ignored. There is no shuffle; memory is that of one text's repeated
    stretches, about 1 KB a word of the longest.
    """
    ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=docs[text_column].cast("binary"))
    return rows.mapInArrow(lambda b: _found(b, least), SCHEMA)


def with_periods(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the ids repeat a piece of their own text up to its end.

    With h the unsigned crc32 of the id and g = floor(h / 10), texts with h % 10 = 0 keep their words before a = g % n and go on
    with the p = 1 + floor((n - a) / (3 + g % 8)) words from there, over and over. A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(docs[id_column].cast("string"), F.lit("")))
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column, h=h)
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    a, p = F.col("a"), F.col("p")
    again = F.transform(F.sequence(F.lit(0), F.col("n") - a - 1), lambda i: F.get("words", a + i % p))
    planted = F.array_join(F.concat(F.slice("words", 1, a), again), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run and checksums of the rows of :func:`find`."""
    best = F.reduce(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
