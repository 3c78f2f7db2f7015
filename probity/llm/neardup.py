"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document is posted under each (coordinate, value) pair of its signature. A pair of documents with the wanted
similarity agrees on at least ``matches`` of the ``COORDINATES`` (but for a stated chance), so it shares one of the
``COORDINATES - matches + 1`` rarest pairs of either: only that prefix is posted. Inside a list a document that is
already reached is skipped; the others count their collisions on whole signatures. What hangs together by such
collisions is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import mix64, ready, shuffle_partitions, slim, stored
from probity.llm.graph import components

COORDINATES = 32
MISS = 1e-5
LIST_BLOCK = 4096
SET_BLOCK = 2048
SET_SHINGLES = 1_500_000
KEPT_WORDS = 300_000

_SMALL = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ROW_SCHEMA = "doc_id long, k1 long, k2 long, n_shingles long, digest binary, signature array<int>"


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; a shorter text is one shingle, a text without words none."""
    found = text.encode("utf-8", "surrogatepass").translate(_SMALL).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over the set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for i in range(COORDINATES):
            value = ((part * (_SEEDS[2 * i] | np.uint64(1)) + _SEEDS[2 * i + 1]) >> np.uint64(32)).min()
            out[i] = min(out[i], np.uint32(value))
    return out


def wanted_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most agreeing coordinates that a pair of the similarity reaches but for a chance of ``miss``."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def _signed(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, sigs = [], [], []
        for text in batch["text"].to_pylist():
            s = shingle_set(text, words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s))
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["k1"], batch["k2"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))],
            names=["doc_id", "k1", "k2", "n_shingles", "digest", "signature"],
        )


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by their keys, many at a time, with the positions where groups begin."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        starts = _starts(held, keys)
        last = int(starts[-1])
        if last:
            yield held.slice(0, last), starts[:-1]
            held = held.slice(last)
    if held is not None:
        yield held, _starts(held, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _spanning(n: int, alike: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges that span the components of ``n`` rows. Rows already reached are skipped by all later comparisons."""
    rest, queue = np.arange(n), []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        i = queue.pop()
        hit = alike(i, rest)
        for j in rest[hit].tolist():
            queue.append(j)
            yield i, j
        rest = rest[~hit]


def _collisions(batches: Iterable[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    for t, starts in _runs(batches, ["key", "ti", "tj"]):
        node = t["node"].to_numpy()
        sig = t["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        ends = np.append(starts[1:], t.num_rows)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        small = np.repeat(ends - starts <= 8, ends - starts)
        u, v = [], []
        for step in range(1, 8):  # all pairs of short lists at once
            i = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
            i = i[(sig[i] == sig[i + step]).sum(axis=1) >= matches]
            u.append(node[i])
            v.append(node[i + step])
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 8:
                own = sig[a:b]
                pairs = list(_spanning(b - a, lambda i, rest: (own[rest] == own[i]).sum(axis=1) >= matches))
                u.append(node[[a + i for i, _ in pairs]])
                v.append(node[[a + j for _, j in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).astype(np.int64)), pa.array(np.concatenate(v).astype(np.int64))], names=["u", "v"])


def _with_sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the texts whose set is the node's; other texts under the same id drop out."""
    for batch in batches:
        sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
        keep = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch["digest"].to_pylist())]
        idx = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays(
            [*(batch[c].take(idx) for c in ("node", "cluster", "_size")), pa.array([s.tobytes() for s, k in zip(sets, keep) if k], pa.binary())],
            names=["node", "cluster", "_size", "shingles"],
        )


def _confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for t, starts in _runs(batches, ["cluster", "ti", "tj"]):
        nodes, blobs = t["node"].to_numpy(), t["shingles"].to_pylist()
        u, v = [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            sets = [np.frombuffer(x, np.uint64) for x in blobs[a:b]]
            sizes = np.array([len(s) for s in sets])
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            begins, mark = ends - sizes, np.zeros(len(values), np.int64)

            def alike(i, rest, sets=sets, sizes=sizes, ids=ids, begins=begins, mark=mark):
                own = ids[begins[i] : begins[i] + sizes[i]]
                could = 100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])
                out = np.zeros(len(rest), bool)
                if not could.any():
                    return out
                mark[own] = 1
                some = rest[could]
                n = sizes[some]
                flat = np.repeat(begins[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                both = np.add.reduceat(mark[ids[flat]], np.append(0, np.cumsum(n)[:-1]))
                mark[own] = 0
                out[could] = 100 * both >= percent * (n + sizes[i] - both)
                return out

            for i, j in _spanning(b - a, alike):
                u.append(nodes[a + i])
                v.append(nodes[a + j])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(u, np.int64)), pa.array(np.array(v, np.int64))], names=["u", "v"])


def _tiles(rows: DataFrame, blocks) -> DataFrame:
    """Rows of a group cut into blocks, every two of which meet in a tile; one block is one tile."""
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))
    return (
        rows.withColumn("_blocks", blocks)
        .withColumns({"_own": own, "_other": other})
        .withColumns({"ti": F.least("_own", "_other"), "tj": F.greatest("_own", "_other")})
        .drop("_blocks", "_own", "_other")
    )


def _posted(nodes: DataFrame, matches: int, block: int) -> DataFrame:
    """The rarest coordinates of each signature, posted with the signature and tiled.

    Spark sizes an array as one element, before and after it is exploded: both joins would be broadcast, far above the threshold.
    """
    key = F.posexplode("signature").alias("at", "value")
    pairs = nodes.select("node", key).select("node", (F.col("at").cast("long") * (1 << 32) + F.col("value").cast("long") + (1 << 31)).alias("key"))
    shared = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = pairs.join(shared.hint("merge"), "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("found"))
    # A value that no other document has comes first in the order and takes up its place in the prefix.
    places = COORDINATES - matches + 1 - (COORDINATES - F.size("found"))
    found = found.filter(places > 0).select("node", F.slice("found", 1, places).alias("found"))
    post = stored(found.select("node", F.explode("found").alias("p")).select("node", "p.key", "p.n"))
    lists = post.filter(F.col("n") > block).groupBy("key").agg(F.count(F.lit(1)).alias("_length"))
    short = post.filter(F.col("n") <= block).select("node", "key", F.lit(1).alias("_length"))
    long = post.filter(F.col("n") > block).join(lists, "key").select("node", "key", "_length")
    tiled = _tiles(short.union(long), F.ceil(F.col("_length") / block))
    return tiled.join(nodes.select("node", "signature").hint("merge"), "node").select("key", "ti", "tj", "node", "signature")


def row_keys(docs: DataFrame, id_column="doc_id", text_column="text") -> tuple:
    """Two hashes that name a row by its id and text."""
    return F.xxhash64(docs[id_column], docs[text_column]), F.xxhash64(docs[text_column], F.lit(1), docs[id_column])


def groups(
    docs: DataFrame, id_column="doc_id", text_column="text", words: int = 5, percent: int = 80, list_block: int = LIST_BLOCK, set_block: int = SET_BLOCK,
) -> DataFrame:
    """``doc_id, k1, k2, n_shingles, first`` of every document: ``first`` is the first row (no_id, doc_id, k1, k2) of its group.

    ``k1`` and ``k2`` are :func:`row_keys`. See :func:`link` for what a group is.
    """
    ready(docs.sparkSession)
    n = shuffle_partitions(docs)
    k1, k2 = row_keys(docs, id_column, text_column)
    base = slim(docs, doc_id=docs[id_column].cast("long"), k1=k1, k2=k2, text=text_column)
    rows = stored(base.mapInArrow(lambda b: _signed(b, words), _ROW_SCHEMA))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    sets = rows.filter("n_shingles > 0").groupBy("digest").agg(
        F.min(own).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature")
    )
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()))
    matches = wanted_matches(percent / 100)
    order = ["key", "ti", "tj"]
    posted = _posted(nodes, matches, list_block).repartition(n, *order).sortWithinPartitions(*order, "node")
    near = posted.select(*order, "node", "signature").mapInArrow(lambda b: _collisions(b, matches), "u long, v long")
    clusters = stored(components(near).select("node", F.col("comp").alias("cluster")).join(nodes.drop("signature", "copies").hint("merge"), "node"))
    # Full sets are made again, for these documents only: keeping the sets of all would be larger than the texts.
    weight = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / set_block), F.ceil(F.sum("n_shingles") / SET_SHINGLES)).alias("_size")
    )
    wanted = clusters.join(weight.hint("merge"), "cluster")
    wanted = wanted.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "node", "cluster", "_size", "digest")
    texts = base.join(wanted.hint("merge"), ["k1", "k2"]).select("node", "cluster", "_size", "digest", "text")
    full = texts.mapInArrow(lambda b: _with_sets(b, words), "node long, cluster long, _size long, shingles binary")
    order = ["cluster", "ti", "tj"]
    tiles = _tiles(full, F.col("_size")).select(*order, "node", "shingles")
    tiles = tiles.repartition(n, *order).sortWithinPartitions(*order, "node")
    links = tiles.mapInArrow(lambda b: _confirmed(b, percent), "u long, v long")
    named = nodes.select("node", "digest", "first", "copies").join(components(links).hint("merge"), "node", "left")
    least = named.filter("comp is not null").groupBy("comp").agg(F.min("first").alias("least"))
    named = named.filter("copies > 1 or comp is not null").join(least.hint("merge"), "comp", "left")
    named = named.select(F.col("digest").alias("_digest"), F.coalesce("least", "first").alias("_first"))
    out = rows.drop("signature").join(named.hint("merge"), F.col("digest") == F.col("_digest"), "left")
    return out.select("doc_id", "k1", "k2", "n_shingles", F.coalesce("_first", own).alias("first"))


def link(docs: DataFrame, id_column="doc_id", text_column="text", words: int = 5, percent: int = 80, list_block: int = LIST_BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """Near-duplicate groups: ``doc_id, n_shingles, component_id, kept`` for every document.

    Documents whose sets meet ``100 * intersection >= percent * union`` are linked; a component is all that links
    reach, named by its smallest id. Texts with the same set are one node throughout, whatever their number, so copies
    are never paired. Null and empty texts have no shingles and are linked with nothing. Rows with a null id belong to
    components like others but never name one, unless no row of it has an id (then it is null, and ``kept``);
    repeated rows stay; rows with a repeated id are all marked. An empty table gives an empty result.
    """
    found = groups(docs, id_column, text_column, words, percent, list_block, set_block)
    name = F.col("first.doc_id")
    return found.select("doc_id", "n_shingles", name.alias("component_id"), name.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_column="doc_id", text_column="text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay: all columns of one row per group, the first by id. A row that repeats id and text stays once."""
    found = groups(docs, id_column, text_column, words, percent)
    stay = found.filter((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    k1, k2 = row_keys(docs, id_column, text_column)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), k1.alias("_k1"), k2.alias("_k2"))
    # The rows are dealt by these keys in any case, so nothing is gained by a broadcast.
    kept = rows.join(stay.hint("merge"), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return kept.select("_row.*")
