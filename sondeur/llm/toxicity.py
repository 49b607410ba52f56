"""Toxicity by compression distance: one zstandard dictionary trained on toxic
text, one on ordinary text; a window is toxic when the toxic dictionary makes
it clearly shorter.

The ordinary dictionary is trained on all windows of ordinary texts. Toxic
texts are ordinary for the most part, so a dictionary of their windows would
hold the same; zstandard trains the toxic one on the pieces of their words (the
words and starts of words) that are typical of them by likelihood ratio, once
for each occurrence. It stands in front of the ordinary dictionary's bytes, and
as many bytes that match nothing stand in front of them for the ordinary model,
so an ordinary window has (nearly) the same length under both. Windows are whole
words, follow each other without gaps and cover the whole text. Thresholds are
those of a logistic regression on windows' gains in texts that the dictionaries
were not trained on.

Defined results: a null or empty text, or one of white space alone, has no
window and scores the score of "no evidence" (all window gains zero). Repeated rows score alike. A document whose
id is null counts as held out of nothing: crc32 of null is null and the flag
is false. With no labelled row of either class every score is 0. Extra columns
are left out of the result; clashing names do no harm because only the id and
text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 12
LEVEL = 3
#: Bytes of the dictionaries; the toxic one stands in front of the ordinary one's bytes.
TOXIC_BYTES, ORDINARY_BYTES = 4_096, 12_288
#: Parameters of zstandard's training: length of segments, and of what is counted in them.
SEGMENT, COUNTED = 16, 6
#: Bound of the training sample: rows of either class, with whole texts.
TRAIN_ROWS = 1_500


def windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    """Lower-cased words in runs of `size`, each run between single spaces."""
    words = text.lower().split() if text else []
    return [f" {' '.join(words[i : i + size])} ".encode() for i in range(0, len(words), size)]


def _pieces(word: str) -> list[str]:
    """Starts of a word, and the whole of it."""
    return [f" {word[:n]}" for n in (4, 5, 6, 8) if len(word) > n] + ([f" {word} "] if 3 < len(word) < 24 else [])


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _counted(texts: list[str]) -> Counter:
    """Pieces, counted once for each word that comes before theirs, so that copies of a document count once."""
    out, seen = Counter(), set()
    for t in texts:
        before = ""
        for w in _words(t):
            for s in _pieces(w):
                pair = hash((s, before))  # 8 bytes instead of two strings
                if pair not in seen:
                    seen.add(pair)
                    out[s] += 1
            before = w
    return out


def typical(toxic: list[str], ordinary: list[str]) -> set[str]:
    """The shortest pieces whose counts differ beyond chance (likelihood ratio) and tenfold in rate, in toxic text's favour."""
    a, b = _counted(toxic), _counted(ordinary)
    n, m = max(1, sum(a.values())), max(1, sum(b.values()))
    least = 2.2 * math.log(len(a) + 10)
    rank = []
    for s, k in a.items():
        j = b[s]
        if k >= 3 and k / n > 10 * j / m:
            r = (k + j) / (n + m)
            g2 = 2 * (k * math.log(k / n / r) + (j * math.log(j / m / r) if j else 0))
            if g2 > least:
                rank.append((len(s), s))
    words = [s for _, s in rank if s.endswith(" ")]
    under = Counter(w[:i] for w in words for i in (5, 6, 7) if len(w) > i + 1)
    # A start that many typical words share stands for them: their tails are ordinary and would shorten ordinary windows too.
    starts = {s for _, s in rank if under[s] >= 4}
    chosen: set[str] = set()
    inside: set[str] = set()  # starts of pieces that are already taken
    for _, s in sorted(rank, key=lambda x: (-x[0], x[1])):
        if s in starts or s not in inside and not any(s[:i] in starts for i in (5, 6, 7) if i < len(s)):
            chosen.add(s)
            inside.update(s[:i] for i in range(4, len(s)))
    return chosen


def evidence(texts: list[str], pieces: set[str]) -> list[bytes]:
    """The longest typical piece of every word that has one, as a sample for training. First comes one of each piece, then another, for zstandard stops when a stretch of samples brings nothing new."""
    found = Counter(max((s for s in _pieces(w) if s in pieces), key=len, default="") for t in texts for w in _words(t))
    each = sorted((n, s) for s, n in found.items() if s)[::-1]
    return [s.encode().ljust(SEGMENT, b"\x01") for i in range(each[0][0] if each else 0) for n, s in each if n > i]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; zstandard puts what it finds most useful last. Too few samples to train on are the dictionary themselves."""
    fit_ = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, fit_, k=SEGMENT, d=COUNTED).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    #: Logistic weights on the gains' features; the last is the constant.
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, 0.0, -20.0])
    _pair: tuple | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def __setstate__(self, state):
        self.__dict__.update(state, _pair=None)

    def _compressors(self):
        if self._pair is None:
            made = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=17, min_match=5, strategy=zstandard.STRATEGY_LAZY2, hash_log=16, chain_log=16, search_log=5, write_content_size=False, write_dict_id=False)
                d.precompute_compress(compression_params=params)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
            self._pair = tuple(made)
        return self._pair

    def gains(self, pieces: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        a, b = (c.compress for c in self._compressors())
        return np.fromiter((len(a(p)) - len(b(p)) for p in pieces), dtype=np.int64, count=len(pieces))

    def features(self, text: str | None) -> np.ndarray:
        """Largest gain, mean gain over 1 byte, how far the gains' sum stands out, and the number of windows (more windows, more chance gains)."""
        g = self.gains(windows(text)) if self.toxic else np.zeros(0)
        if not len(g):
            return np.array([0, 0, 0, -math.log(2)])
        return np.array([min(g.max(), 12), np.clip(g - 1, 0, None).mean() * 4, np.clip(g - 1, 0, 6).sum() / math.sqrt(len(g) + 4), -math.log1p(len(g))])

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return 0.0
        z = float(self.features(text) @ np.array(self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02) -> list[float]:
    """Newton steps for a logistic regression with non-negative weights on evidence (a negative one is held at 0)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    free = np.ones(x1.shape[1], bool)
    w = np.zeros(x1.shape[1])
    for _ in range(x1.shape[1]):
        w[:] = 0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            reg = np.full(free.sum(), l2)
            if free[-1]:
                reg[-1] = 1e-6
            xf = x1[:, free]
            step = np.linalg.solve((xf * (p * (1 - p))[:, None]).T @ xf + np.diag(reg + 1e-9), xf.T @ (p - y) + reg * w[free])
            w[free] -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-6:
                break
        bad = (w < 0) & free
        bad[-1] = False
        if not bad.any():
            break
        free &= ~bad
    return w.tolist()


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from two thirds of either class, the threshold calibrated on the other third, then dictionaries from all."""
    toxic, ordinary = ([t for t in x if t and t.strip()] for x in (toxic, ordinary))
    if not toxic or not ordinary:
        return Model()

    def built(a: list[str], b: list[str]) -> Model:
        plain = trained([w for t in b for w in windows(t)], ORDINARY_BYTES)
        own = trained(evidence(a, typical(a, b)), TOXIC_BYTES)
        return Model(own.rjust(TOXIC_BYTES, b"\x01") + plain, b"\x01" * TOXIC_BYTES + plain)

    xs, ys = [], []
    split = lambda x, inside: [t for i, t in enumerate(x) if (i % 3 != 0) == inside]
    m = built(split(toxic, True) or toxic, split(ordinary, True) or ordinary)
    for label, x in ((1, toxic), (0, ordinary)):
        for t in split(x, False):
            xs.append(m.features(t))
            ys.append(label)
    m = built(toxic, ordinary)
    m.weights = _logistic(np.array(xs), np.array(ys, float))
    return m


def _bucket(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Train, in one task, on a bounded sample: at most `rows` labelled documents of either class, by hash order, with their whole texts.

    docs: doc_id, text. labels: doc_id, toxic. usable: a condition on doc_id."""
    common.ship(docs.sparkSession)
    picked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(F.lit(True) if usable is None else usable)
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"))
    each = [picked.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (1, 0)]
    sample = F.broadcast(each[0].unionByName(each[1]))  # at most 2 * rows ids
    got = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").where(F.length("text") > 0)
    got = got.groupBy("toxic", "text").agg(F.min(order).alias("o")).select("o", "toxic", "text")

    def learned(batches):
        found = sorted((o, t, y) for b in batches for o, y, t in zip(*(b.column(c).to_pylist() for c in ("o", "toxic", "text"))))
        m = train([t for _, t, y in found if y], [t for _, t, y in found if not y])
        del found
        yield pa.RecordBatch.from_arrays([pa.array([m.toxic], pa.binary()), pa.array([m.ordinary], pa.binary()), pa.array([m.weights], pa.list_(pa.float64()))], names=["toxic", "ordinary", "weights"])
        common.release()

    r = got.repartition(1).mapInArrow(learned, "toxic binary, ordinary binary, weights array<double>").first()  # 2 * rows texts at most
    return Model(bytes(r.toxic), bytes(r.ordinary), list(r.weights)) if r else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every whole text; score is 0 to 1, predicted 1 from 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 14 kB

    def scored(batches):
        m = shared.value
        for b in batches:
            s = np.array([m.score(t) for t in b.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, as they are, that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled rows that are not held out."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels, _bucket(F.col("doc_id"), 5) != 0)
    return score(docs, model).select("doc_id", F.coalesce(_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
