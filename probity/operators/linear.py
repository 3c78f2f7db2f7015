"""A trained text model as a sparse linear scorer behind the batch interface of ``scoring.model_scores``."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDFModel
from pyspark.sql import DataFrame

from probity.constants import TEXT_CLASSES
from probity.operators import scoring, textmodel

WEIGHT_BYTES = 64 << 20  # documented bound of the weights sent to the workers
KEPT_WORDS = 1_000_000  # words whose slot a worker remembers; the memory starts anew beyond it

WORD = re.compile("[a-z0-9_]+")


def murmur3(data: bytes, seed: int = 42) -> int:
    """Signed 32-bit hash of the words, the published x86 variant (its multipliers are fixed values)."""
    mask = 0xFFFFFFFF

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return (k << 15 | k >> 17) * 0x1B873593 & mask

    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class SparseScorer:
    """Logits of hashed word counts: the inverse document frequencies are part of the weights, and only slots with a weight are kept.

    ``place[slot]`` is the row of ``weights`` for a slot, -1 for a slot without weight.
    """

    def __init__(self, coefficients: np.ndarray, intercept: np.ndarray, idf: np.ndarray):
        by_slot = (coefficients * idf).T
        used = np.flatnonzero(np.any(by_slot != 0, axis=1))
        self.slots = len(idf)
        self.place = np.full(self.slots, -1, dtype=np.int32)
        self.place[used] = np.arange(len(used), dtype=np.int32)
        self.weights = np.ascontiguousarray(by_slot[used])
        # Classes the model has not seen have probability 0.
        self.intercept = np.concatenate([intercept, np.full(len(TEXT_CLASSES) - len(intercept), -np.inf)])

    @classmethod
    def of(cls, model: PipelineModel) -> SparseScorer:
        """From a model of ``textmodel.train_text_model``."""
        stage = {type(s): s for s in model.stages}
        fitted, idf = stage[LogisticRegressionModel], stage[IDFModel].idf.toArray()
        if stage[HashingTF].getBinary():
            raise ValueError("the scorer counts words, the model was trained on their presence")
        return cls(fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray(), idf)

    @property
    def nbytes(self) -> int:
        return self.weights.nbytes + self.place.nbytes

    def logits(self, texts, memory: dict[str, int]) -> np.ndarray:
        """One row of seven logits per text; the counts of a batch are one sparse matrix."""
        places, counts, starts = [], [], [0]
        for text in texts:
            # Words of one slot are added up by the product; no slot needs to be merged before.
            for word, n in Counter(WORD.findall(str(text).lower())).items():
                at = memory.get(word)
                if at is None:
                    if len(memory) >= KEPT_WORDS:
                        memory.clear()
                    at = memory[word] = int(self.place[murmur3(word.encode()) % self.slots])
                if at >= 0:
                    places.append(at)
                    counts.append(n)
            starts.append(len(places))
        out = np.tile(self.intercept, (len(texts), 1))
        if places:
            parts = self.weights[places] * np.asarray(counts, dtype=np.float64)[:, None]
            starts = np.asarray(starts)
            full = np.flatnonzero(starts[1:] > starts[:-1])
            out[full, : self.weights.shape[1]] += np.add.reduceat(parts, starts[full], axis=0)
        return out


def sparse_scores(df: DataFrame, model: PipelineModel, batch_size: int = 64, text: str = "text") -> DataFrame:
    """The columns of ``scoring.model_scores`` from a trained text model, equal to ``textmodel.text_model_scores`` up to rounding.

    The weights are broadcast once if they are not above ``WEIGHT_BYTES``; a larger model is applied by the library, with the same results.
    Null and empty texts get the class of the intercepts; texts are read whole. An empty table gives an empty table.
    """
    scorer = SparseScorer.of(model)
    if scorer.nbytes > WEIGHT_BYTES:
        return textmodel.text_model_scores(df, model)
    sent = df.sparkSession.sparkContext.broadcast(scorer)

    def make_model():
        ready, memory = sent.value, {}
        return lambda texts: ready.logits(texts.reshape(-1), memory)

    return scoring.model_scores(df, make_model, batch_size, text)
