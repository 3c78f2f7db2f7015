"""Token ids in wavelet-matrix shards.

A shard holds consecutive documents as one wavelet matrix: a bit plane per bit of the id, from the
highest, each followed by a stable split of the ids into zeros and ones. Rank directories over blocks of
512 bits answer access, counting and occurrence lookup without unpacking the shard.

File format: Parquet (zstd). One row per shard with ``part``, ``shard`` (order of the shards),
``n_tokens``, ``width``, ``zeros`` (per plane), ``planes`` and ``ranks`` (packed bits, running ones), and
the documents in it as ``doc_ids`` and ``lengths``. Spark's committer makes each file appear whole or not at
all, so a lost executor costs its own shards only.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import ready, shuffle_partitions, slim
from probity.session import checkpoint_dir

BLOCK = 512
END_ID = 2
SHARD_TOKENS = 1 << 20
CACHE_WORDS = 1_000_000
CACHE_RUNS = 100_000

# Byte-level vocabularies write a byte that is no visible Latin-1 character as the next character from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
LEADING_SPACE = chr(BYTE_LETTERS[0x20])


SHARD_SCHEMA = (
    "part int, shard int, n_tokens long, width int, zeros array<long>, planes array<binary>, "
    "ranks array<binary>, doc_ids array<long>, lengths array<long>"
)
DOC_SCHEMA = "doc_id long, part int, shard int, offset long, n_tokens long, ids_crc32 long, position int"


class WaveletMatrix:
    """A sequence of non-negative integers below ``2 ** width`` as rank-indexed bit planes."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.width, self.zeros = n, width, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        kind = np.uint16 if width <= 16 else np.uint32
        seq, zeros, planes, ranks = np.ascontiguousarray(ids, dtype=kind), [], [], []
        for bit in range(width - 1, -1, -1):
            ones = (seq & kind(1 << bit)) != 0
            packed = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-max(len(packed), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            per_block = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.uint32).tobytes())
            planes.append(packed.tobytes())
            low = seq.compress(~ones)  # several times faster than an index by truth values
            zeros.append(len(low))
            seq = np.concatenate([low, seq.compress(ones)])
        return cls(len(ids), width, zeros, planes, ranks)

    def parts(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return self.zeros, [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks]

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (i & 7) & 1

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, bits = i // BLOCK, self.planes[plane]
        inside = bits[block * (BLOCK // 8) : i >> 3]
        tail = int(bits[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(self.ranks[plane][block]) + int(np.bitwise_count(inside).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.width):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for plane in range(self.width):
            if symbol >> (self.width - 1 - plane) & 1:
                low, high = self.zeros[plane] + self._ones(plane, low), self.zeros[plane] + self._ones(plane, high)
            else:
                low, high = low - self._ones(plane, low), high - self._ones(plane, high)
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """How often ``symbol`` occurs among the first ``i`` ids."""
        if symbol < 0 or symbol >> self.width or i <= 0:
            return 0
        low, high = self._range(symbol, min(i, self.n))
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``symbol``, found by climbing back up the planes."""
        if k < 0 or k >= self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for plane in range(self.width - 1, -1, -1):
            one = symbol >> (self.width - 1 - plane) & 1
            i = self._find(plane, one, i - self.zeros[plane] if one else i)
        return i

    def _find(self, plane: int, one: int, k: int) -> int:
        """Position of the ``k``-th bit of a kind: binary search over the directory, then inside the block."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if one else np.arange(len(ranks), dtype=np.int64) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        bits = bits[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self) -> np.ndarray:
        """All ids in order: the stable splits undone from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for plane in range(self.width - 1, -1, -1):
            ones = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = values[: self.zeros[plane]]
            out[np.flatnonzero(ones)] = values[self.zeros[plane] :] | kind(1 << (self.width - 1 - plane))
            values = out
        return values


class Kept(dict):
    """Values by key, made when first asked for; at most two generations of ``most`` entries are held."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self[key] = self.older[key] if key in self.older else self.make(key)
        return value


class Unsure(Exception):
    """White space at the edge of a piece: the cut before or behind it may be wrong."""


class Encoder:
    """Ids of whole texts from the tokenizers library, with the ids of repeated words kept.

    With a byte-level pre-tokenizer, a single space between two non-space characters always begins a token and never
    continues one, so a text is cut there. A piece of common characters is cut further by the pre-tokenizer's
    rule, and the library's model gives the ids of each run; other pieces, texts that begin or end in white space or repeat it, and
    all texts of other tokenizers go through the library as they are.
    """

    SURE = re.compile(r"(?<=\S) (?=\S)")
    COMMON = re.compile(r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+(?:\n+[\x21-\x7EÀ-ÖØ-öø-ÿ]+)*")
    RUNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.width = max(1, (t.get_vocab_size(with_added_tokens=True) - 1).bit_length(), END_ID.bit_length())
        self.kind, self.code = (np.uint16, "H") if self.width <= 16 else (np.uint32, "I")
        self.added = re.compile("|".join(re.escape(a.content) for a in t.get_added_tokens_decoder().values()) or r"(?!)")
        self.model = t.model
        self.runs, self.pieces = Kept(self._run, CACHE_RUNS), Kept(self._piece, CACHE_WORDS)
        self.cuts = t.normalizer is None and type(t.pre_tokenizer).__name__ == "ByteLevel"
        tries = ["b", "ñé,.", "b.\nC's", "7%b  c"]
        self.cuts = self.cuts and all(self._piece(p) == self._encoded([" " + p])[0] for p in tries)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _run(self, run: str) -> bytes:
        """Ids of a run that the pre-tokenizer keeps together, by the library's model."""
        if run.isascii() and run.isalpha():
            shown = run
        elif run.isascii() and run[0] == " " and run[1:].isalpha():
            shown = LEADING_SPACE + run[1:]
        else:
            shown = run.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that follows a cut, its space included. Words are kept as pieces, other runs apart."""
        if piece.isalpha():
            return self._run(" " + piece)
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return self.pieces[piece[:-1]] + self.runs[piece[-1]]
        if self.COMMON.fullmatch(piece):
            runs = self.RUNS.findall(" " + piece)
            return b"".join([self.pieces[r[1:]] if r[0] == " " and r[1:].isalpha() else self.runs[r] for r in runs])
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Unsure
        return self._encoded([" " + piece])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without an end id."""
        if not self.cuts:
            return [np.frombuffer(b, dtype=self.kind) for b in self._encoded(texts)]
        heads, tails = zip(*map(self._parted, texts)) if texts else ((), ())
        # What opens a text has no space before it: the library encodes the openings of a batch in one call.
        return [np.frombuffer(a + b, dtype=self.kind) for a, b in zip(self._encoded(list(heads)), tails)]

    def _parted(self, text: str) -> tuple[str, bytes]:
        """What opens a text, up to its first cut, and the ids of all that follows."""
        if self.added.search(text):
            return text, b""
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise Unsure
            return first, b"".join(map(self.pieces.__getitem__, rest))
        except Unsure:
            first, *rest = self.SURE.split(text)
            return first, b"".join(self._encoded([" " + p for p in rest]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _shards(batches: Iterable[pa.RecordBatch], path: str, shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, shard, coder = TaskContext.get().partitionId(), 0, encoder(path)
    schema = pa.schema(
        [
            ("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("width", pa.int32()),
            ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary())),
            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ]
    )
    end = np.array([END_ID], coder.kind)
    ids, docs, lengths, size = [], [], [], 0

    def close() -> pa.RecordBatch:
        nonlocal ids, docs, lengths, size, shard
        zeros, planes, ranks = WaveletMatrix.build(np.concatenate(ids), coder.width).parts()
        row = [part, shard, size, coder.width, zeros, planes, ranks, docs, lengths]
        ids, docs, lengths, size, shard = [], [], [], 0, shard + 1
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in batches:
        rows = batch.to_pydict()
        for doc, found in zip(rows["doc_id"], coder.batch([t or "" for t in rows["text"]])):
            if size and size + len(found) + 1 > shard_tokens:
                yield close()
            ids += [found, end]
            docs.append(doc)
            lengths.append(len(found) + 1)
            size += len(found) + 1
    if size:
        yield close()


def write_shards(
    docs: DataFrame, tokenizer: str, path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> str:
    """Writes the ids of all texts, in ascending id order, and returns the folder.

    Texts are dealt into ranges of the id (rows with the same id are ordered by a hash of the text), so each task
    writes a run of the global order. A document never crosses a shard; one longer than
    ``shard_tokens`` gets a shard of its own. Null and empty texts are the end id alone; rows with a null id come
    first; repeated rows are all written; an empty table gives a folder without shards.
    """
    spark = ready(docs.sparkSession)
    path = path or f"{checkpoint_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(rows), *order).sortWithinPartitions(*order, "text")
    shards = dealt.mapInArrow(lambda b: _shards(b, tokenizer, shard_tokens), SHARD_SCHEMA)
    shards.write.option("compression", "zstd").parquet(path)
    return path


def shard_starts(shards: DataFrame) -> DataFrame:
    """Ids before each shard: running sums inside a part, on top of the parts before it."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select(  # one row per written part
        "part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base")
    )
    inside = F.expr(
        "coalesce(sum(n_tokens) over (partition by part order by shard rows between unbounded preceding and 1 preceding), 0)"
    )
    return sizes.join(F.broadcast(before), "part").select("part", "shard", (F.col("base") + inside).alias("shard_start"))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = WaveletMatrix(row["n_tokens"], row["width"], row["zeros"], row["planes"], row["ranks"]).decode()
            ids = np.ascontiguousarray(ids, dtype="<u4")
            lengths = np.array(row["lengths"], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            crcs = [zlib.crc32(ids[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist())]
            k = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * k, pa.int32()),
                    pa.array([row["shard"]] * k, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths),
                    pa.array(crcs, pa.int64()), pa.array(np.arange(k), pa.int32()),
                ],
                names=["doc_id", "part", "shard", "offset", "n_tokens", "ids_crc32", "position"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: its start among all ids, length and checksum, read from the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    found = shards.mapInArrow(_documents, DOC_SCHEMA)
    return found.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("offset")).cast("long").alias("start"), "n_tokens", "ids_crc32", "part", "shard",
        "position",
    )
