"""Fill-in-the-middle rearrangement of whole texts by in-place block rotation, and its exact inverse.

A text is cut at two token edges into prefix, middle and suffix. Its UTF-8 bytes lie in one bytearray with a sentinel before
each part, in reading order: ``<P>``prefix ``<M>``middle ``<S>``suffix. Two neighbouring blocks change places by a rotation made
of three reversals, so no second copy of the text is built: middle and suffix for the form ``psm``, then prefix and suffix for
``spm``. :func:`restore` reads the form, undoes the rotations in reverse order and takes the sentinels out.

Tokens are runs of A-Z and a-z, and every other code point by itself. Bytes that continue a code point are no token edges, so the
scan works on bytes and never splits a character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probity.llm.common import ready, slim

PREFIX, SUFFIX, MIDDLE = SENTINELS = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
PLAIN, PSM, SPM = "plain", "psm", "spm"

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
SCAN = 1 << 16


def token_starts(raw: np.ndarray) -> np.ndarray:
    """True at every byte that starts a token."""
    lower = raw | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A)
    start = (raw & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start


def cut_at(starts: np.ndarray, per_block: np.ndarray, token: int) -> int:
    """Byte position of the start of a token (the end of the text for the one after the last), by counts of blocks first."""
    ends = np.cumsum(per_block)
    if token >= ends[-1]:
        return len(starts)
    block = int(np.searchsorted(ends, token, side="right"))
    before = int(ends[block - 1]) if block else 0
    return block * SCAN + int(np.flatnonzero(starts[block * SCAN : (block + 1) * SCAN])[token - before])


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _reverse(view: np.ndarray) -> None:
    """Turns a piece of a buffer round in place; only half of it is ever held twice."""
    half = len(view) // 2
    left, right = view[:half], view[len(view) - half :]
    held = left.copy()
    left[:] = right[::-1]
    right[:] = held[::-1]


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the neighbouring blocks ``[start, middle)`` and ``[middle, end)`` by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view[start:middle])
    _reverse(view[middle:end])
    _reverse(view[start:end])


def rearrange(text: bytes, cut: int, cut2: int, form: str) -> bytearray:
    """The text with sentinels in the order of ``form``; ``cut`` and ``cut2`` are byte positions in reading order."""
    buffer = bytearray(text)
    for place, mark in ((cut2, SUFFIX), (cut, MIDDLE), (0, PREFIX)):
        buffer[place:place] = mark
    middle, suffix = cut + MARK, cut2 + 2 * MARK
    rotate(buffer, middle, suffix, len(buffer))  # prefix, suffix, middle
    if form == SPM:
        rotate(buffer, 0, middle, middle + len(buffer) - suffix)  # suffix, prefix, middle
    return buffer


def undo(output: bytes, form: str) -> bytes:
    """The text that :func:`rearrange` was given."""
    if form == PLAIN:
        return bytes(output)
    buffer = bytearray(output)
    prefix, suffix, middle = map(buffer.find, SENTINELS)
    if form == SPM:
        rotate(buffer, 0, prefix, middle)
        suffix = middle - prefix
    rotate(buffer, suffix, middle, len(buffer))
    cut2 = suffix + len(buffer) - middle
    for place in (cut2, suffix, 0):
        del buffer[place : place + MARK]
    return bytes(buffer)


def _one(text: bytes, draws: tuple[int, int, int, int], keep: int, turn: int) -> tuple:
    raw = np.frombuffer(text, np.uint8)
    starts = token_starts(raw)
    per_block = np.add.reduceat(starts, np.arange(0, len(raw), SCAN), dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
    n = int(per_block.sum())
    h1, h2, h3, h4 = draws
    if not n or h3 % 100 >= keep or any(s in text for s in SENTINELS):
        return n, PLAIN, None, None, text
    cut, cut2 = (cut_at(starts, per_block, c) for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = SPM if h4 % 100 < turn else PSM
    return n, form, code_points(raw[:cut]), code_points(raw[cut:cut2]), bytes(rearrange(text, cut, cut2, form))


def _transform(batches: Iterable[pa.RecordBatch], keep: int, turn: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    for batch in batches:
        columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        draws = zip(*(columns[h].to_pylist() for h in ("h1", "h2", "h3", "h4")))
        found = [_one(t.as_py(), d, keep, turn) for t, d in zip(columns["text"], draws)]
        parts = zip(*found) if found else [[]] * len(names)
        yield pa.RecordBatch.from_arrays(
            [columns["doc_id"], *(pa.array(list(v), k) for v, k in zip(parts, kinds))], names=["doc_id", *names]
        )


def _undone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = [undo(o.as_py(), f) for o, f in zip(batch.column(names.index("output")), batch.column(names.index("form")).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*names, "restored"])


def draws(doc_id: Column, seed: int = 1) -> dict[str, Column]:
    """Four unsigned 32-bit draws from the sha256 of the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return {f"h{i + 1}": F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)}


def transform(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, changed_percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """One row per row of ``docs``: ``n`` tokens, ``form``, ``prefix_chars``, ``middle_chars`` and the new text ``output`` (UTF-8 bytes).

    ``changed_percent`` of the ids are rearranged, ``spm_percent`` of those with the suffix first. Null and empty texts, and texts
    that hold a sentinel already, stay as they are (``plain``, no part sizes). Repeated rows and ids each give their row, with
    the same draws for the same id; an empty table gives no rows; extra columns of any name are ignored. There is no shuffle: every
    text is rearranged where it is read, in memory of a few times its size.
    """
    ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=F.coalesce(docs[text_column], F.lit("")).cast("binary"))
    return rows.withColumns(draws(F.col("doc_id"), seed)).mapInArrow(lambda b: _transform(b, changed_percent, spm_percent), SCHEMA)


def restore(changed: DataFrame) -> DataFrame:
    """Adds ``restored``: the exact text (UTF-8 bytes), rebuilt from ``output`` and ``form`` alone. Other columns stay."""
    return changed.mapInArrow(_undone, T.StructType([*changed.schema.fields, T.StructField("restored", T.BinaryType())]))
