"""Document fingerprints by consistent weighted sampling.

A text's terms are its sequences of three words (the first two are filled up in front), each weighted by its count, so a text of
``n`` words has total weight ``n``. Each of the samples draws for every term, from a hash of term and sample alone, r and c from
Gamma(2, 1) and b from [0, 1). A term of weight S takes the step t = floor(ln S / r + b) and the rank c * exp(-r * (t - b + 1)); the
sample is the term of least rank with its step. Two texts agree in a sample with probability sum(min) / sum(max) of their weights,
the generalised Jaccard similarity. A fingerprint holds 16 bits of each sample, so samples that differ look equal once in 65,536.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import mix64, ready, shuffle_partitions, slim
from probity.operators.ordered import with_buckets

SAMPLES = 64
WORDS = 3
DIGITS = 4  # hex digits of a sample
TERMS = 1024  # terms drawn for at a time
KEPT_WORDS = 500_000

PAIR_SCHEMA = (
    "doc_id long, n_chars long, fingerprint string, edited string, edited_fingerprint string, next_id long, next_fingerprint string"
)


class Codes(dict):
    """64-bit hashes of the words seen, at most ``KEPT_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def gamma_points(width: int = 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``2 ** width`` equal shares, by Newton steps on its distribution."""
    share = (np.arange(1 << width) + 0.5) / (1 << width)
    x = np.sqrt(2 * share) * (1 + share)
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - share) / (x * np.exp(-x)), x / 8)
    return x.astype(np.float32)


class Sampler:
    """Fingerprints of word sequences. One per Python worker."""

    def __init__(self, samples: int = SAMPLES, words: int = WORDS):
        self.samples, self.words, self.codes, self.gamma = samples, words, Codes(), gamma_points()
        self.factors = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        seeds = mix64(np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.seeds = (seeds >> np.uint64(32)).astype(np.uint32).reshape(3, samples, 1)
        self.empty = "0" * (DIGITS * samples)

    def codes_of(self, text: str, like: np.ndarray | None = None, known: int = 0) -> np.ndarray:
        """Hashes of the words; the first ``known`` are those of ``like``."""
        words = text.encode("utf-8", "surrogatepass").split()
        rest = np.fromiter(map(self.codes.__getitem__, words[known:]), np.uint64, len(words) - known)
        return np.concatenate([like[:known], rest]) if known else rest

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct terms, ascending, and their counts, from the hashes of the words."""
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        codes = np.zeros(n + self.words - 1, np.uint64)
        codes[self.words - 1 :] = words
        with np.errstate(over="ignore"):
            term = codes[:n] * self.factors[0]
            for i in range(1, self.words):
                term += codes[i : i + n] * self.factors[i]
        term.sort()
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        return term[first], np.diff(first, append=n)

    def draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b of every (sample, term): a 32-bit hash for r and b, two for c."""
        low, high = terms.astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32)
        x, y, z = (_mix32(part ^ seed) for part, seed in zip((low, high, low ^ (high << np.uint32(1))), self.seeds))
        r = self.gamma.take((x >> np.uint32(16)).view(np.int32), mode="clip")
        x &= np.uint32(0xFFFF)
        b = _between(x, 16)
        y >>= np.uint32(9)
        z >>= np.uint32(9)
        ln_c = _between(y, 23)
        ln_c *= _between(z, 23)
        for step in (np.log, np.negative, np.log):
            step(ln_c, out=ln_c)
        return r, ln_c, b

    def sample(self, *weighted: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """16 bits a sample for every given set of (terms, counts). Terms that sets share are drawn for once."""
        union = weighted[0][0] if len(weighted) == 1 else merged([t for t, _ in weighted])
        best = [np.full(self.samples, np.inf, np.float32) for _ in weighted]
        chosen = [np.zeros((2, self.samples), np.uint64) for _ in weighted]
        rows, one = np.arange(self.samples), np.float32(1)
        for i in range(0, len(union), TERMS):
            part = union[i : i + TERMS]
            r, ln_c, b = self.draws(part)
            single = b - one  # the rank of a term of weight 1: its step is 0
            single *= r
            single += ln_c
            for k, (terms, counts) in enumerate(weighted):
                lo, hi = np.searchsorted(terms, part[0]), np.searchsorted(terms, part[-1], side="right")
                at, count = np.searchsorted(part, terms[lo:hi]), counts[lo:hi]
                rank = single
                if hi - lo < len(part):
                    absent = np.full(len(part), np.inf, np.float32)
                    absent[at] = 0
                    rank = single + absent
                many = at[count > 1]
                if len(many):
                    rank = rank.copy() if rank is single else rank
                    step = np.floor(np.log(count[count > 1]).astype(np.float32) / r[:, many] + b[:, many])
                    rank[:, many] = ln_c[:, many] - r[:, many] * (step - b[:, many] + one)
                won = rank.argmin(axis=1)  # ties: the term with the smaller hash
                least = rank[rows, won]
                better = np.flatnonzero(least < best[k])
                won = won[better]
                best[k][better] = least[better]
                chosen[k][0, better] = part[won]
                if len(many):
                    times = np.zeros(len(part), np.float32)
                    times[at] = np.log(count)
                    chosen[k][1, better] = np.floor(times[won] / r[better, won] + b[better, won]).astype(np.int64).view(np.uint64)
                else:
                    chosen[k][1, better] = 0
        with np.errstate(over="ignore"):
            return [(mix64(c[0] + c[1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype(">u2") for c in chosen]

    def fingerprints(self, *texts: str, same: int = 0) -> list[str]:
        """Those of some texts that begin with the same ``same`` characters, whose words are looked up once."""
        words = [self.codes_of(texts[0])]
        # The last word of what they share may go on in any of them.
        known = max(0, len(texts[0][:same].encode("utf-8", "surrogatepass").split()) - 1) if same else 0
        words += [self.codes_of(t, words[0], known) for t in texts[1:]]
        weighted = [self.terms(w) for w in words]
        found = iter(self.sample(*(w for w in weighted if len(w[0])))) if any(len(w[0]) for w in weighted) else iter(())
        return [next(found).tobytes().hex() if len(w[0]) else self.empty for w in weighted]


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """The distinct values of ascending arrays; the stable sort merges what is in order already."""
    every = np.concatenate(runs)
    every.sort(kind="stable")
    return every[np.concatenate([[True], every[1:] != every[:-1]])]


def _mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _between(bits: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits as fractions between 0 and 1, both ends left out, so that no logarithm is 0 or infinite."""
    out = bits.view(np.int32).astype(np.float32)
    out += np.float32(0.5)
    out *= np.float32(2.0**-width)
    return out


_SAMPLERS: dict[tuple[int, int], Sampler] = {}


def sampler(samples: int, words: int) -> Sampler:
    return _SAMPLERS.setdefault((samples, words), Sampler(samples, words))


def _signed(batches: Iterable[pa.RecordBatch], samples: int, words: int) -> Iterator[pa.RecordBatch]:
    make = sampler(samples, words).fingerprints
    for batch in batches:
        found = [make(t.as_py() or "")[0] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])


def sign(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES, words: int = WORDS
) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (``4 * samples`` hex digits) of every row, without a shuffle.

    Equal texts have equal fingerprints, and so have texts that differ in white space only. Null, empty and blank texts
    have the fingerprint of zeros. Repeated rows and ids each give their row; an empty table gives none; extra columns of any name
    are ignored. Long texts are drawn for in blocks of terms.
    """
    ready(docs.sparkSession)
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=text_column)
    return rows.mapInArrow(lambda b: _signed(b, samples, words), "doc_id long, fingerprint string")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints of the same length; null if either is null."""
    starts = F.sequence(F.lit(1), F.length(a), F.lit(DIGITS))
    same = F.size(F.filter(starts, lambda i: F.substr(a, i, F.lit(DIGITS)) == F.substr(b, i, F.lit(DIGITS))))
    return same * F.lit(float(DIGITS)) / F.length(a)


def edit(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much (or all) of the start of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def in_order(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows dealt into ranges of (id, hash of the text); the first row of each range also ends the range before it (``guard``).

    Ranges follow the quantiles of the id, an id that fills ranges by itself is cut further by the hash, and null ids come first.
    First rows are found among ids and hashes alone and marked where they are read, so each text moves once (a range's first
    one twice). The table of first rows has a row per range, a bound that does not grow with the rows.
    """
    rows = slim(docs, doc_id=docs[id_column].cast("long"), text=F.coalesce(docs[text_column], F.lit("")))
    rows = rows.withColumn("code", F.xxhash64("text"))
    rows = with_buckets(rows, F.col("doc_id"), "code", buckets=max(4, min(4 * shuffle_partitions(rows), 20_000)), out="part")
    # Ids order a range whatever the rounding of its bounds: a bound is a value, and equal values share a range.
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "code")
    first = rows.groupBy("part").agg(F.min(key).alias("key"))
    before = F.expr("coalesce(lag(part) over (order by part), max(part) over ())")
    first = first.select(F.col("part").alias("first_part"), F.col("key.code").alias("first_code"), "key.doc_id", before.alias("before"))
    first = F.broadcast(first.withColumnRenamed("doc_id", "first_id"))
    starts = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("code") == F.col("first_code")) & (F.col("part") == F.col("first_part"))
    places = F.filter(
        F.array(
            F.struct("part", F.lit(False).alias("guard")), F.struct(F.col("before").alias("part"), F.col("before").isNotNull().alias("guard"))
        ),
        lambda p: p["part"].isNotNull(),
    )
    dealt = rows.join(first, starts, "left").select("doc_id", "text", "code", F.explode(places).alias("place"))
    dealt = dealt.select("place.part", "place.guard", "doc_id", "text", "code").repartition("part")
    return dealt.sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_first(), "code", "text")


def _beside(batches: Iterable[pa.RecordBatch], samples: int, words: int) -> Iterator[pa.RecordBatch]:
    make = sampler(samples, words).fingerprints
    held = waiting = None  # the row before; the finished row before that, short of its follower's fingerprint
    names = ["doc_id", "n_chars", "fingerprint", "edited", "edited_fingerprint", "next_id", "next_fingerprint"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        out = []
        guards, ids, texts = (batch.column(i) for i in range(3))
        for guard, doc, text in zip(guards.to_pylist(), ids.to_pylist(), texts):
            if held is None and guard:
                continue  # a further copy of the row that ends the range
            text = text.as_py()
            if held is not None:
                edited = edit(held[1], text)
                own, other = make(held[1], edited, same=len(held[1]) - len(held[1]) // 4)
                if waiting is not None:
                    out.append((*waiting, own))
                waiting = held[0], len(held[1]), own, edited, other, doc
            held = doc, text
            if guard:
                out.append((*waiting, *make(text)))
                held = waiting = None
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def beside_next(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES, words: int = WORDS
) -> DataFrame:
    """Every row with its fingerprint, its edited text and the row after it in ascending id order (after the last: the first).

    ``edited`` is the text whose last quarter of code points is replaced by the start of the next row's text. Rows of one id are ordered by
    a hash of the text; null ids come first; null texts count as empty; repeated rows follow each other and all give their
    row; the only row of a table is followed by itself; an empty table gives no rows; extra columns of any name are ignored.
    """
    ready(docs.sparkSession)
    rows = in_order(docs, id_column, text_column)
    return rows.select("guard", "doc_id", "text").mapInArrow(lambda b: _beside(b, samples, words), PAIR_SCHEMA)


def digest(pairs: DataFrame) -> DataFrame:
    """Checksum and likenesses of the rows of :func:`beside_next`."""
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
