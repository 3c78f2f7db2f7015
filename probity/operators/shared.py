"""TF-IDF cosines within groups for rows that share texts: a text is split once, however many rows have it.

A row's text is a shared text with one of a few short endings. All sums are linear in the two parts, so they are made per text and group
and only the scores go back to the rows. The most frequent terms have a dense table of sums per group that each task adds up for itself; of
the other terms each meets its texts in a shuffle, with the groups of the text packed beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.session import cut_lineage

TERM = "[a-z0-9]+"
TOP_TERMS = 65_000  # terms with a dense table of sums, at most
CELLS = 6_500_000  # of that table: terms times groups
CHOICE = 20_000  # texts, about, among which these terms are chosen; any choice gives the same result
KEYS = 4_096  # groups, at most; more are joined (see operators.similarity)
CHUNK = 256  # terms of the table that travel in one row
PIECE = 512  # texts worked on at a time
KEPT_WORDS = 500_000
KEPT_SUMS = 6_000_000  # numbers that a task adds up before it passes them on
TEXTS = 100_000  # texts per task of the other terms

RECORDS = "id long, text binary, keys binary, tails binary, times binary, units binary, top binary, top_tf binary, terms binary, tf binary, size int"
PAIRS = "term long, id long, tf long, groups binary"
SUMS = "id long, first boolean, vv double, x binary, text binary, keys binary, tails binary, times binary, cross binary"
PRODUCTS = "text binary, tail int, times long, place int, vc double, vv double"


def text_id(text: Column) -> Column:
    """Name of a text: 16 bytes."""
    return F.unhex(F.md5(text))


class Codes(dict):
    """64-bit hashes of terms; two of 10 million terms share one at a chance of about 3 in a million."""

    def __missing__(self, term: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[term] = int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)
        return code


_CODES = Codes()


class Endings:
    """The terms of the endings (the first is none) as a table of counts: a row per ending, a column per term."""

    def __init__(self, endings: list[str]):
        each = [Counter(re.findall(TERM, e.lower())) for e in ["", *endings]]
        self.terms = np.array(sorted({_CODES[t] for c in each for t in c}), np.int64)
        self.column = None
        self.counts = np.zeros((len(each), len(self.terms)), np.int64)
        for j, c in enumerate(each):
            for t, n in c.items():
                self.counts[j, np.searchsorted(self.terms, _CODES[t])] += n

    def within(self, top: np.ndarray) -> Endings:
        """With the places of the terms among the top terms, which have them all."""
        self.at = np.searchsorted(top, self.terms)
        self.column = np.full(len(top), -1)
        self.column[self.at] = np.arange(len(self.at))
        return self

    def found(self, piece: Piece) -> np.ndarray:
        """How often each text of a piece has each of these terms."""
        out = np.zeros((piece.n, len(self.terms)), np.int64)
        column = self.column[piece.top]
        there = np.flatnonzero(column >= 0)
        out[piece.top_owner[there], column[there]] = piece.top_tf[there]
        return out


def places(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values stand in an ordered array, and whether they do."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


def packed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of binary rows one after the other, and their number in each row."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


class Piece:
    """Some texts with their top and other terms (``owner`` is the text) and uses, and their weight in each group that uses them."""

    def __init__(self, batch: pa.RecordBatch, keys: int):
        self.n, self.batch = batch.num_rows, batch
        self.ids = batch["id"].to_numpy()
        self.top, self.top_sizes = packed(batch["top"], np.uint16)
        self.top_tf = packed(batch["top_tf"], np.int32)[0].astype(np.int64)
        self.top_owner = np.repeat(np.arange(self.n), self.top_sizes)
        self.terms, sizes = packed(batch["terms"], np.int64)
        self.tf = packed(batch["tf"], np.int32)[0].astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), sizes)
        self.keys, self.uses = packed(batch["keys"], np.int32)
        self.tails, self.times, self.units = (packed(batch[c], k)[0] for c, k in (("tails", np.int32), ("times", np.int64), ("units", np.int64)))
        self.user = np.repeat(np.arange(self.n), self.uses)
        cells, at = np.unique(self.user * keys + self.keys, return_inverse=True)
        self.group_owner, self.group = np.divmod(cells, keys)
        self.weight = np.bincount(at, self.times * self.units, len(cells)).astype(np.int64)
        self.groups = np.bincount(self.group_owner, minlength=self.n)
        self.all_units = np.bincount(self.user, self.units, self.n).astype(np.int64)


def pieces(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[Piece]:
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            yield Piece(batch.slice(i, PIECE), keys)


def cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist()))


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=names)


def _split(batches: Iterable[pa.RecordBatch], top: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Terms and counts of every text, beside its uses; a top term is its place."""
    for batch in batches:
        for i in range(0, batch.num_rows, PIECE):
            part = batch.slice(i, PIECE)
            found = [Counter(re.findall(TERM, t)) for t in part["low"].to_pylist()]
            terms = []
            for c in found:
                codes, tf = np.fromiter(map(_CODES.__getitem__, c), np.int64, len(c)), np.fromiter(c.values(), np.int32, len(c))
                at, there = places(top, codes)
                terms.append((at[there].astype(np.uint16).tobytes(), tf[there].tobytes(), codes[~there].tobytes(), tf[~there].tobytes()))
            uses = part["uses"].to_pylist()
            kinds = (("place", np.int32), ("tail", np.int32), ("times", np.int64), ("units", np.int64))
            each = [[np.array([u[c] for u in row], k).tobytes() for row in uses] for c, k in kinds]
            yield batch_of(RECORDS, part["id"], part["text"], *each, *map(list, zip(*terms)), [len(c) for c in found])


def _tables(batches: Iterable[pa.RecordBatch], keys: int, endings: Endings, top: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts of the top terms in each group and, last, the units (rows with a group) that have them, as rows of ``CHUNK`` terms."""
    sums, ends = np.zeros((len(top), keys + 1), np.int64), np.zeros((len(endings.counts), keys), np.int64)
    for p in pieces(batches, keys):
        for (a, b), (c, d) in zip(cuts(p.top_sizes), cuts(p.groups)):
            sums[p.top[a:b][:, None], p.group[c:d]] += p.top_tf[a:b][:, None] * p.weight[c:d]
        sums[:, keys] += np.bincount(p.top, np.repeat(p.all_units, p.top_sizes), len(top)).astype(np.int64)
        np.add.at(ends, (p.tails, p.keys), p.times * p.units)
        # An ending adds a unit for those of its terms that the text has not.
        new = (endings.counts[p.tails] > 0) & (endings.found(p) == 0)[p.user]
        sums[endings.at, keys] += (new * p.units[:, None]).sum(axis=0)
    sums[endings.at, :keys] += endings.counts.T @ ends
    for i in range(0, len(top), CHUNK):
        part = sums[i : i + CHUNK]
        if part.any():
            yield batch_of("chunk long, sums binary", [i // CHUNK], [part.tobytes()])


def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk, which follow each other, added up."""
    chunk, total = None, None
    for batch in batches:
        for c, s in zip(batch["chunk"].to_pylist(), batch["sums"].to_pylist()):
            s = np.frombuffer(s, np.int64)
            if c == chunk:
                total = total + s
                continue
            if chunk is not None:
                yield batch_of("chunk long, sums binary", [chunk], [total.tobytes()])
            chunk, total = c, s
    if chunk is not None:
        yield batch_of("chunk long, sums binary", [chunk], [total.tobytes()])


GROUPS = np.dtype([("key", "<u2"), ("weight", "<i8")])


def _rare(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Every term outside the top with its text, and the units, groups and weights of the text."""
    for p in pieces(batches, keys):
        own = np.zeros(len(p.group), GROUPS)
        own["key"], own["weight"] = p.group, p.weight
        beside = pa.array([int(u).to_bytes(8, "little") + own[a:b].tobytes() for u, (a, b) in zip(p.all_units, cuts(p.groups))], pa.binary())
        yield batch_of(PAIRS, p.terms, p.ids[p.owner], p.tf, beside.take(pa.array(p.owner)))


def _rare_sums(batches: Iterable[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.RecordBatch]:
    """What the rare terms add to each text: squares, and products with the sums of its groups; terms come in order.

    The squares of the sums per group are a row without id.
    """
    squares, held = np.zeros(keys), []

    def worked(table: pa.Table) -> None:
        nonlocal squares
        term = table["term"].to_numpy()
        new = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1])
        group = np.repeat(np.arange(len(new)), np.diff(new, append=len(term)))
        raw = table["groups"].to_pylist()
        units = np.array([int.from_bytes(r[:8], "little") for r in raw], float)
        idf = np.log((rows + 1.0) / (np.add.reduceat(units, new) + 1.0))[group]
        beside = np.frombuffer(b"".join(r[8:] for r in raw), GROUPS)
        sizes = (np.array([len(r) for r in raw], np.int64) - 8) // GROUPS.itemsize
        at = np.repeat(np.arange(len(term)), sizes)
        v = table["tf"].to_numpy() * idf
        cells, where = np.unique(group[at] * keys + beside["key"], return_inverse=True)
        sums = np.bincount(where, v[at] * beside["weight"], len(cells))
        squares += np.bincount(cells % keys, sums * sums, keys)
        held.append((table["id"].to_numpy(), v * v, sizes, v[at] * sums[where]))

    def merged() -> int:
        """Rows of one text, which have the same groups, added up; how many numbers they are."""
        ids, vv, sizes, x = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(ids, kind="stable")
        new = np.flatnonzero(np.diff(ids[order], prepend=ids[order][0] - 1))
        lengths = sizes[order]
        first, width = np.cumsum(lengths) - lengths, lengths[new]
        number = np.repeat(np.arange(len(new)), np.diff(new, append=len(ids)))
        within = np.arange(len(x)) - np.repeat(first, lengths)
        read = within + np.repeat((np.cumsum(sizes) - sizes)[order], lengths)
        sums = np.bincount(within + np.repeat((np.cumsum(width) - width)[number], lengths), x[read], int(width.sum()))
        held[:] = [(ids[order][new], np.add.reduceat(vv[order], new), width, sums)]
        return len(sums)

    def told() -> Iterator[pa.RecordBatch]:
        ids, vv, sizes, x = held.pop()
        places = cuts(sizes)
        for i in range(0, len(ids), 20 * PIECE):
            part = slice(i, i + 20 * PIECE)
            out = [x[a:b].tobytes() for a, b in places[part]]
            none, n = [None] * len(out), len(out)
            yield batch_of(SUMS, ids[part], [False] * n, vv[part], out, none, none, none, none, none)

    rest, size = None, 0
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        term = table["term"].to_numpy()
        last = int(np.searchsorted(term, term[-1])) if len(term) else 0  # the last term may go on in the next batch
        rest = table.slice(last)
        if last:
            worked(table.slice(0, last))
            size += len(held[-1][3])
        if size > KEPT_SUMS // 3:
            size = 0
            if merged() > KEPT_SUMS:
                yield from told()
    if rest is not None and len(rest):
        worked(rest)
    if held:
        merged()
        yield from told()
    yield batch_of(SUMS, [None], [False], [None], [squares.tobytes()], [None], [None], [None], [None], [None])


class Weights:
    """Inverse frequencies and weighted sums per group of the top terms, and those of the endings."""

    def __init__(self, idf: np.ndarray, sums: np.ndarray, endings: Endings):
        self.idf, self.endings = idf, endings
        self.sums = sums * idf[:, None]
        ends = endings.counts * idf[endings.at]
        self.end_idf = ends * idf[endings.at]  # against plain counts of a text
        self.end_vv = (ends * ends).sum(axis=1)
        self.end_vc = ends @ self.sums[endings.at]
        self.squares = (self.sums * self.sums).sum(axis=0)


def _top_sums(batches: Iterable[pa.RecordBatch], keys: int, sent) -> Iterator[pa.RecordBatch]:
    """What the top terms add to each text, with its uses."""
    w = sent.value
    for p in pieces(batches, keys):
        cross = (w.endings.found(p)[p.user] * w.end_idf[p.tails]).sum(axis=1)
        vv, x, ends = [], [], []
        for (a, b), (c, d), (e, f) in zip(cuts(p.top_sizes), cuts(p.groups), cuts(p.uses)):
            top = p.top[a:b]
            v = p.top_tf[a:b] * w.idf[top]
            vv.append(float(v @ v))
            x.append((v @ w.sums[top[:, None], p.group[c:d]]).tobytes())
            ends.append(cross[e:f].tobytes())
        vv = [None if size == 0 else q for q, size in zip(vv, p.batch["size"].to_pylist())]  # null: a text without terms
        yield batch_of(SUMS, p.batch["id"], [True] * p.n, vv, x, p.batch["text"], p.batch["keys"], p.batch["tails"], p.batch["times"], ends)


def _products(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """For the uses of a text its product with the sum of the group and its square, from its rows of sums: the one with the uses first.

    Squares of groups, the rows without id, become rows without text.
    """
    w, own, out = sent.value, None, []

    def use() -> None:
        keys, tails, times = (np.frombuffer(own[c], k) for c, k in (("keys", np.int32), ("tails", np.int32), ("times", np.int64)))
        x = own["sum"][np.searchsorted(np.unique(keys), keys)]
        vc = times * (x + w.end_vc[tails, keys])
        vv = times * times * (own["squares"] + 2 * np.frombuffer(own["cross"]) + w.end_vv[tails])
        told = tails >= (1 if own["vv"] is None else 0)
        out.append(([own["text"]] * int(told.sum()), *(c[told] for c in (tails, times, keys, vc, vv))))

    def portion() -> pa.RecordBatch:
        texts = [t for o in out for t in o[0]]
        columns = [np.concatenate(c) for c in list(zip(*out))[1:]]
        out.clear()
        return batch_of(PRODUCTS, texts, *columns)

    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["x"])
            if row["id"] is None:
                n = len(x)
                yield batch_of(PRODUCTS, [None] * n, [None] * n, [None] * n, np.arange(n, dtype=np.int32), x, [None] * n)
            elif row["first"]:
                if own is not None:
                    use()
                own = row | {"sum": x, "squares": row["vv"] or 0.0}
            else:
                own["sum"], own["squares"] = own["sum"] + x, own["squares"] + row["vv"]
        if len(out) > 1000:
            yield portion()
    if own is not None:
        use()
    if out:
        yield portion()


def units_of(rows: DataFrame, texts: DataFrame, endings: list[str]) -> tuple[DataFrame, DataFrame]:
    """Units (_row, _key, _text, _tail, times) and the texts they need. Different texts of one unit are put together as a text of its own."""
    each = F.struct("_text", "_tail")
    units = rows.groupBy("_row", "_key").agg(F.count(F.lit(1)).alias("times"), F.min(each).alias("a"), F.max(each).alias("b"))
    units = cut_lineage(units.select("_row", "_key", "times", "a._text", "a._tail", (F.col("a") != F.col("b")).alias("mixed")))
    if units.filter("mixed").isEmpty():
        return units.drop("mixed"), texts
    end = F.get(F.array(*[F.lit(e) for e in ["", *endings]]), F.col("_tail"))
    mixed = rows.join(units.filter("mixed").select("_row", "_key"), ["_row", "_key"]).join(texts.dropDuplicates(["_text"]), "_text")
    mixed = mixed.groupBy("_row", "_key").agg(F.concat_ws(" ", F.sort_array(F.collect_list(F.concat("text", end)))).alias("text"))
    mixed = cut_lineage(mixed.withColumn("_text", text_id(F.col("text"))))
    own = mixed.select("_row", "_key", F.lit(1).cast("long").alias("times"), "_text", F.lit(0).alias("_tail"))
    return units.filter("NOT mixed").drop("mixed").unionByName(own), texts.unionByName(mixed.select("_text", "text"))


def with_uses(texts: DataFrame, units: DataFrame) -> DataFrame:
    """``id, text`` (its name), ``whole`` and ``uses``: each text once, with the different uses and how many units have each.

    ``units`` has ``_text``, ``place`` (number of the group), ``_tail`` and ``times``.
    """
    uses = units.groupBy("_text", "place", "_tail", "times").agg(F.count(F.lit(1)).alias("units"))
    uses = uses.groupBy("_text").agg(F.collect_list(F.struct("place", F.col("_tail").alias("tail"), "times", "units")).alias("uses"))
    used = texts.dropDuplicates(["_text"]).join(uses, "_text")
    return used.select(F.monotonically_increasing_id().alias("id"), F.col("_text").alias("text"), F.col("text").alias("whole"), "uses")


def group_cosines(rows: DataFrame, texts: DataFrame, endings: list[str] = ()) -> DataFrame | None:
    """``_row, _key, score``: TF-IDF cosine of a row's text with the summed texts of all other rows of its group.

    ``rows`` has ``_row``, ``_key`` (none null), ``_text`` and ``_tail`` (0, or the number of the ending from 1), ``texts`` has ``_text`` and
    ``text``, where a name may repeat with the same text. An ending begins with white space and has a term. Rows without any term
    are left out; None if there are more than ``KEYS`` groups.
    """
    endings = list(endings)
    table = Endings(endings)
    if any(not e[0].isspace() for e in endings) or not (table.counts[1:].sum(axis=1) > 0).all():
        raise ValueError("an ending begins with white space and has a term")
    spark = rows.sparkSession
    keys = [r[0] for r in rows.select("_key").distinct().sort("_key").limit(KEYS + 1).collect()]
    if len(keys) > KEYS:
        return None
    n_keys = max(len(keys), 1)
    numbered = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], rows.select("_key", F.lit(0).alias("place")).schema)
    units, texts = units_of(rows, texts, endings)
    units = units.join(F.broadcast(numbered), "_key")
    used = with_uses(texts, units).withColumn("low", F.lower("whole")).drop("whole")
    most = min(TOP_TERMS, CELLS // n_keys)
    n_texts = texts.count()
    some = texts.sample(min(1.0, CHOICE / max(n_texts, 1)), seed=1).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})")))).alias("term"))
    some = some.groupBy("term").count().orderBy(F.desc("count"), "term").limit(most)
    top = np.array(sorted({_CODES[r["term"]] for r in some.collect()} | set(table.terms.tolist())), np.int64)
    table = table.within(top)
    known = spark.sparkContext.broadcast((table, top))
    records = cut_lineage(used.mapInArrow(lambda b: _split(b, known.value[1]), RECORDS))
    bare = records.filter("size = 0").select(F.col("text").alias("_text"), F.lit(True).alias("bare"))
    n = units.join(bare, "_text", "left").filter("bare IS NULL OR _tail > 0").agg(F.count_distinct("_row")).first()[0]

    parts = records.mapInArrow(lambda b: _tables(b, n_keys, *known.value), "chunk long, sums binary")
    sums = np.zeros((len(top), n_keys + 1), np.int64)
    for r in parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk long, sums binary").toLocalIterator():
        at = slice(r["chunk"] * CHUNK, (r["chunk"] + 1) * CHUNK)
        sums[at] = np.frombuffer(r["sums"], np.int64).reshape(-1, n_keys + 1)
    weights = Weights(np.log((n + 1.0) / (sums[:, n_keys] + 1.0)), sums[:, :n_keys], table)
    sent = spark.sparkContext.broadcast(weights)

    tasks = max(spark.sparkContext.defaultParallelism, n_texts // TEXTS)
    pairs = records.mapInArrow(lambda b: _rare(b, n_keys), PAIRS).repartition(tasks, "term").sortWithinPartitions("term")
    rare = pairs.mapInArrow(lambda b: _rare_sums(b, n_keys, n), SUMS)
    own = records.mapInArrow(lambda b: _top_sums(b, n_keys, sent), SUMS)
    both = own.unionByName(rare).repartition("id").sortWithinPartitions("id", F.desc("first"))
    found = cut_lineage(both.mapInArrow(lambda b: _products(b, sent), PRODUCTS))

    # A row per task and group at most, a number each.
    squares = weights.squares + 0.0
    for r in found.filter("text IS NULL").groupBy("place").agg(F.sum("vc").alias("q")).collect():
        squares[r["place"]] += r["q"]
    total = spark.createDataFrame([(i, float(q)) for i, q in enumerate(squares)], "place int, cc double")
    found = found.filter("text IS NOT NULL").withColumnsRenamed({"text": "_text", "tail": "_tail"}).join(F.broadcast(total), "place")
    others = F.col("cc") - 2 * F.col("vc") + F.col("vv")
    # What is left of the sum after the text is taken out may be the rounding of the subtraction alone.
    some = (F.col("vv") > 0) & (others > 1e-9 * F.col("cc"))
    cosine = F.when(some, F.greatest(F.lit(0.0), F.col("vc") - F.col("vv")) / F.sqrt(F.col("vv") * others)).otherwise(0.0)
    found = found.select("_text", "_tail", "times", "place", F.least(F.lit(1.0), cosine).alias("score"))
    return units.join(found, ["_text", "_tail", "times", "place"]).select("_row", "_key", "score")
