"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. A letter's vector is rotated by its
place and the vectors of an n-gram are multiplied (bound); a text is the sum (bundle) of its n-grams, a language the sum
of its texts. A text gets the language of the nearest prototype by cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import code_points, fold_of, mix64, ready, slim

DIMENSIONS = 1024
GRAM = 3
SHARPNESS = 30.0
HELD_OUT_PARTS = 5
BATCH_CHARS = 400_000
KEPT_GRAMS = 20_000
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 per code point: bits of hashes of the code point."""
    words = points.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = np.unpackbits(mix64(mix64(words + np.uint64(1))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as packed code points, 21 bits each."""
    out = np.ones((len(keys), DIMENSIONS), np.int8)
    for place in range(GRAM):
        points = ((keys >> np.uint64(21 * (GRAM - 1 - place))) & np.uint64(0x1FFFFF)).astype(np.uint32)
        own, at = np.unique(points, return_inverse=True)
        out *= np.roll(letter_vectors(own), GRAM - 1 - place, axis=1)[at]
    return out


def grams(text: str | None) -> np.ndarray:
    """Packed n-grams of a whole text: small letters, all else one space between words. Empty if there is no letter."""
    p = code_points(text.lower()) if text else np.empty(0, np.uint32)
    letter = letters()[p]
    if not letter.any():
        return np.empty(0, np.uint64)
    p = np.concatenate([[32], np.where(letter, p, 32), [32]]).astype(np.uint64)
    space = p == 32
    p = p[~(space & np.append(False, space[:-1]))]
    key = np.zeros(len(p) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        key = key << np.uint64(21) | p[i : len(p) - GRAM + 1 + i]
    return key


class _Vectors:
    """Vectors of n-grams seen so far, up to a bound."""

    def __init__(self):
        self.keys, self.rows = np.empty(0, np.uint64), np.empty((0, DIMENSIONS), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Rows of sorted, distinct keys."""
        at = np.searchsorted(self.keys, keys)
        new = keys[(at >= len(self.keys)) | (np.append(self.keys, 0)[np.minimum(at, len(self.keys))] != keys)]
        if len(new):
            if len(self.keys) + len(new) > KEPT_GRAMS:
                return gram_vectors(keys)
            merged = np.concatenate([self.keys, new])
            order = np.argsort(merged)
            self.keys, self.rows = merged[order], np.concatenate([self.rows, gram_vectors(new)])[order]
            at = np.searchsorted(self.keys, keys)
        return self.rows[at]


_VECTORS = _Vectors()


def bundles(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The bundle of each text, a few texts at a time; zeros for a text without letters."""
    some, size = [], 0
    for text in texts:
        some.append(grams(text))
        size += len(some[-1])
        if size >= BATCH_CHARS or len(some) >= 256:
            yield _bundled(some)
            some, size = [], 0
    if some:
        yield _bundled(some)


def _bundled(some: list[np.ndarray]) -> np.ndarray:
    keys, at = np.unique(np.concatenate(some), return_inverse=True)
    doc = np.repeat(np.arange(len(some)), [len(g) for g in some])
    out = np.zeros((len(some), DIMENSIONS), np.float32)
    for low in range(0, len(keys), 8192):  # a bounded number of n-grams at a time
        own = keys[low : low + 8192]
        inside = (at >= low) & (at < low + len(own))
        counts = np.bincount(doc[inside] * len(own) + at[inside] - low, minlength=len(some) * len(own)).reshape(len(some), -1)
        out += counts.astype(np.float32) @ _VECTORS.of(own).astype(np.float32)
    return out


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].to_pylist()
        done = 0
        for rows in bundles(batch["text"].to_pylist()):
            for lang, row in zip(langs[done:], rows):
                sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
                sums[lang] += np.rint(row).astype(np.int64)
            done += len(rows)
    for lang, row in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([row.tolist()], pa.list_(pa.int64()))], names=["lang", "sums"])


def prototypes(docs: DataFrame, text_column="text", lang_column="lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes. Each task sends one vector per language; sums are exact integers."""
    ready(docs.sparkSession)
    rows = slim(docs, lang=docs[lang_column].cast("string"), text=text_column).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    each = rows.mapInArrow(_sums, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "value"))
    total = each.groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = total.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("sums"))
    found = [r for r in sorted(found.collect(), key=lambda r: r.lang) if any(r.sums)]  # one row per language
    vectors = np.array([r.sums for r in found], np.float64).reshape(len(found), DIMENSIONS)
    return [r.lang for r in found], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _predicted(batches: Iterable[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    langs, vectors = model.value
    names = pa.array([*langs, UNKNOWN], pa.string())
    for batch in batches:
        best, scores = [], []
        for rows in bundles(batch["text"].to_pylist()):
            norm = np.linalg.norm(rows, axis=1)
            if not langs:
                best.append(np.zeros(len(rows), np.int64))
                scores.append(np.zeros(len(rows)))
                continue
            cosine = rows @ vectors.T / np.maximum(norm, 1e-9)[:, None]
            weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
            best.append(np.where(norm > 0, cosine.argmax(axis=1), len(langs)))
            scores.append(np.where(norm > 0, weight.max(axis=1) / weight.sum(axis=1), 0.0))
        idx = pa.array(np.concatenate([*best, np.empty(0, np.int64)]))
        score = pa.array(np.concatenate([*scores, np.empty(0)]), pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), names.take(idx), score], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_column="doc_id", text_column="text", parts: int = HELD_OUT_PARTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    ``score`` is the softmax of the cosines. Null texts and texts without a letter are ``und`` with score 0, as are all if nothing was
    learned; equal cosines go to the first language in code point order; repeated rows are judged each; a null id counts as
    held out; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), held_out=fold_of(docs[id_column], parts) == 0, text=text_column)
    sent = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(lambda b: _predicted(b, sent), "doc_id long, held_out boolean, lang_pred string, score double")


def learned_rows(docs: DataFrame, id_column="doc_id", parts: int = HELD_OUT_PARTS) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(fold_of(docs[id_column], parts) != 0)
