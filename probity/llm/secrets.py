"""Secret scans: patterns, and a character convolutional network over every candidate in its surroundings.

Candidates are runs of at least twelve characters that mix kinds. Those that a pattern finds are the labelled findings;
the others are taken as ordinary. The network reads the characters of a candidate and around it and is trained with numpy
on a bounded sample. All candidates are scored; the calibration and the threshold, the highest that keeps the wanted recall
of the labelled findings, are taken over all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probity.llm.common import ready, slim, stored
from probity.operators.ordered import smallest

KINDS = ("assign", "access", "hex")
ADDED = "model"
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MIXED = re.compile(r"[0-9+/_=]|[a-z].*[A-Z]|[A-Z].*[A-Z]", re.S)

AROUND = 24
PIECE = 64
WIDTH = AROUND * 2 + PIECE
SAMPLE_ROWS = 3000  # documented bound of the labelled findings of each class that the network is fitted on
RECALL = 0.95
BINS, MOST = 64, 32  # bins a unit of the histogram of the network's answers, and the answer at which it ends
EMBED, FILTERS, SPAN, EPOCHS, SEED = 8, 24, 5, 6, 11

PASS_SCHEMA = "doc_id long, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,label:int,windows:array<string>>>"
SCORED_SCHEMA = "doc_id long, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,label:int,z:double>>"
OUT_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind:string,start:long,end:long,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, leftmost without overlap per kind, in order. A run shorter than the limit is no match either way."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def windows(text: str, start: int, end: int) -> list[str]:
    """A candidate with its surroundings, cut into pieces if it is long, each as wide as the network's input."""
    out = []
    for at in range(start, end, PIECE):
        before, after = text[max(0, at - AROUND) : at], text[at : at + PIECE + AROUND]
        out.append(before.rjust(AROUND, "\0") + after.ljust(PIECE + AROUND, "\0"))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Every candidate of a text; label 1 if it meets a span of the patterns."""
    out, i = [], 0
    ends = np.maximum.accumulate([e for _, _, e in base]) if base else []
    for m in CANDIDATE.finditer(text):
        if not MIXED.search(m.group()):
            continue
        while i < len(base) and ends[i] <= m.start():
            i += 1
        label = int(i < len(base) and base[i][0] < m.end())
        out.append({"start": m.start(), "end": m.end(), "label": label, "windows": windows(text, m.start(), m.end())})
    return out


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("windows", pa.list_(pa.string()))]))
    for batch in batches:
        bases, founds = [], []
        for text in batch["text"].to_pylist():
            base = base_spans(text or "")
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            founds.append(candidates(text or "", base))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bases, span), pa.array(founds, cand)], names=["doc_id", "base", "found"])


def symbols(texts: list[str]) -> np.ndarray:
    """Windows as numbers: 0 for padding, 1 to 95 for visible ASCII, 96 for line ends and tabs, 97 for others."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), WIDTH)
    out = np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw >= 127, 97, 96))
    return np.where(raw == 0, 0, out).astype(np.int64)


class Network:
    """Embedding, one convolution, the largest answer of each filter inside and outside the candidate, and a logistic unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (98, EMBED)), "conv": rng.normal(0, 0.2, (SPAN * EMBED, FILTERS)), "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 2 * FILTERS), "off": np.zeros(1),
        }
        inside = np.zeros(WIDTH - SPAN + 1, bool)
        inside[AROUND - 2 : AROUND + PIECE - 2] = True
        self.inside = inside

    def forward(self, x: np.ndarray) -> tuple:
        e = self.p["embed"][x]
        patch = np.concatenate([e[:, k : WIDTH - SPAN + 1 + k] for k in range(SPAN)], axis=2)
        h = np.maximum(patch @ self.p["conv"] + self.p["bias"], 0)
        places = [np.flatnonzero(m) for m in (self.inside, ~self.inside)]
        top = [p[h[:, p].argmax(axis=1)] for p in places]
        pooled = np.concatenate([np.take_along_axis(h, t[:, None, :], axis=1)[:, 0] for t in top], axis=1)
        return pooled @ self.p["out"] + self.p["off"], pooled, top, patch

    def logits(self, texts: list[str]) -> np.ndarray:
        parts = [self.forward(symbols(texts[i : i + 256]))[0] for i in range(0, len(texts), 256)]
        return np.concatenate(parts) if parts else np.empty(0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, pooled, top, patch = self.forward(x)
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["off"][0] = pooled.T @ d, d.sum()
        dp = np.outer(d, self.p["out"]) * (pooled > 0)
        rows = np.arange(len(x))
        for half, t in enumerate(top):
            part = dp[:, half * FILTERS : (half + 1) * FILTERS]
            g["bias"] += part.sum(axis=0)
            for f in range(FILTERS):
                own = patch[rows, t[:, f]]
                g["conv"][:, f] += own.T @ part[:, f]
                back = part[:, f][:, None] * self.p["conv"][:, f]
                for k in range(SPAN):
                    np.add.at(g["embed"], x[rows, t[:, f] + k], back[:, k * EMBED : (k + 1) * EMBED])
        return g

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> Network:
        x, rng, step = symbols(texts), np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                g, step = self.gradients(x[order[i : i + 64]], y[order[i : i + 64]]), step + 1
                for k in self.p:  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


@dataclass
class Model:
    slope: float
    offset: float
    threshold: float  # least answer of the network for a finding that no pattern makes

    def probability(self, z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -30, 30))))


def calibrated(z: np.ndarray, y: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over counted answers of the network, with softened labels so that it stays finite."""
    good, bad = count[y > 0].sum(), count[y == 0].sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    loss = lambda w: count @ (np.logaddexp(0, x @ w) - t * (x @ w)) + 5e-4 * w @ w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (count * (t - p)) - 1e-3 * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
    return float(w[0]), float(w[1])


def train(scanned: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """A network from at most ``rows`` different windows of each class, of all pieces of all candidates, chosen by hash; None if a class is missing."""
    each = scanned.select(F.explode("found").alias("c")).select(F.col("c.label").alias("label"), F.explode("c.windows").alias("w"))
    each = stored(each.distinct())
    sample = [smallest(each.filter(F.col("label") == k), F.xxhash64("w"), rows, "w").collect() for k in (0, 1)]
    if not all(len(s) >= 8 for s in sample):
        return None
    return Network().fit([r.w for s in sample for r in s], np.array([float(r.label) for s in sample for r in s]))


def _scored(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Candidates with the network's answer for their likeliest piece in place of their windows."""
    network: Network | None = sent.value
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("z", pa.float64())]))
    for batch in batches:
        rows = batch["found"].to_pylist()
        z = network.logits([w for r in rows for c in r for w in c["windows"]]) if network else None
        out, at = [], 0
        for r in rows:
            out.append([])
            for c in r:
                n = len(c["windows"])
                out[-1].append({"start": c["start"], "end": c["end"], "label": c["label"], "z": float(z[at : at + n].max()) if network else None})
                at += n
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["base"], pa.array(out, cand)], names=["doc_id", "base", "found"])


def settled(scored: DataFrame, recall: float = RECALL) -> Model | None:
    """Calibration and threshold over all scored candidates, from a histogram of their answers; None without answers of both classes."""
    c = scored.select(F.explode("found").alias("c")).select("c.label", "c.z").filter("z IS NOT NULL")
    place = F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), "z")) * BINS)
    bins = c.groupBy("label", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("least")).orderBy("label", "bin").collect()
    good = [r for r in bins if r.label == 1]
    if not good or len(good) == len(bins):
        return None
    slope, offset = calibrated(np.array([(r.bin + 0.5) / BINS for r in bins]), np.array([r.label for r in bins]), np.array([float(r.n) for r in bins]))
    missed = np.cumsum([r.n for r in good])
    return Model(slope, offset, good[int(np.searchsorted(missed, (1 - recall) * missed[-1], side="right"))].least)


def _judged(batches: Iterable[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model: Model | None = sent.value
    finding = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        rows = batch.to_pylist()
        out: list[list] = [[] for _ in range(6)]
        for r in rows:
            base = [(s["start"], s["kind"], s["end"], 1.0) for s in r["base"]]
            more = []
            for c in r["found"]:
                if model and not c["label"] and c["z"] >= model.threshold:
                    more.append((c["start"], len(KINDS), c["end"], model.probability(c["z"])))
            names = (*KINDS, ADDED)
            told = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in spans)
            every = sorted([*base, *more])
            for k in range(3):
                out[k].append(sum(s[1] == k for s in base))
            out[3].append(hashlib.sha256(told(base).encode()).hexdigest())
            out[4].append(told(every))
            out[5].append([{"kind": names[k], "start": s, "end": e, "score": p} for s, k, e, p in every])
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [finding]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "findings"]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(out, types))], names=names)


def scan(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Pattern counts and digest, and all findings (kind, start, end, score) of every whole text.

    The texts are read once; spans and candidates are written, the network is fitted on a sample of them and scores every
    candidate once; the answers are written, and judged by the calibration and threshold over all of them. Spans of the patterns always stay. Places count code points, ends exclusive. Null and empty texts have no
    findings; without enough findings to learn from, the patterns stand alone; repeated rows and null ids are judged each;
    an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column)
    scanned = stored(rows.mapInArrow(_scanned, PASS_SCHEMA))
    network = spark.sparkContext.broadcast(train(scanned))
    scored = stored(scanned.mapInArrow(lambda b: _scored(b, network), SCORED_SCHEMA))
    sent = spark.sparkContext.broadcast(settled(scored))
    return scored.mapInArrow(lambda b: _judged(b, sent), OUT_SCHEMA)
