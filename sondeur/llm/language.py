"""Language identification of mixed texts.

Words are runs between spaces and line ends. The scripts (Unicode ranges) of a
word's letters narrow the candidate languages to those whose training text
uses them. Under each candidate a word scores the log-likelihood of its
letter n-grams. Viterbi over a text's words, with a penalty for each switch,
labels spans; the text's language is the one whose spans hold the most letters,
and the score is the share of letters that they hold.

Defined results: a null text, and one without a letter, is `und` with score 0.
A text whose letters are all in scripts of no learned language gets the most
frequent learned language with score 0. Ties go to the language with more
training text, then to the smaller name. Without any training row every text
is `und`. Repeated rows are labelled alike; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: First code point and name of each range; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]
SWITCH = 10.0
#: Bound of the training sample: documents of one language and documents in all, as expected numbers, with their whole texts.
TRAIN_ROWS, TRAIN_ALL = 600, 6_000
#: Least count of an n-gram in the sample.
LEAST = 4
CACHE = 200_000
#: Log-likelihood of a letter whose script the language does not use.
EXCLUDED = -60.0
_alpha: list[np.ndarray] = []


def script(letter: str) -> str:
    return SCRIPTS[bisect(_STARTS, ord(letter)) - 1][1]


def letter_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lower-cased text: its code points, the places of letters, and a number for each letter with its two neighbours (0 where that is no letter)."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = _alpha[0][codes]
    padded = np.concatenate(([0], np.where(is_letter, codes, 0), [0]))
    at = np.flatnonzero(is_letter)
    return codes, at, (padded[at] << 42) | (padded[at + 1] << 21) | padded[at + 2]


def scripts_of(codes: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STARTS, codes, side="right") - 1


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    #: Sorted n-grams; log-likelihoods by n-gram and language, the last row for the others.
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    #: By range of SCRIPTS: which languages use its script; all False where none does.
    ranges: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS), 0), bool))


def counted(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: its n-grams, their counts, and its letters by range of SCRIPTS."""
    codes, at, grams = letter_grams(text.lower())
    key, n = np.unique(grams, return_counts=True)
    return key, n, np.bincount(scripts_of(codes[at]), minlength=len(SCRIPTS))


def train(size: dict[str, int], totals: dict[str, int], letters: dict[str, np.ndarray], grams: dict[int, dict[str, int]]) -> Model:
    """By language: documents, n-grams in all and letters by range; by n-gram that occurs LEAST times: its count in each language."""
    langs = sorted(size, key=lambda x: (-size[x], x))
    if not langs:
        return Model()
    used = np.zeros((len(SCRIPTS), len(langs)), bool)
    for k, lang in enumerate(langs):
        share = Counter()
        for (_, name), v in zip(SCRIPTS, letters[lang].tolist()):
            share[name] += v
        used[:, k] = [share[name] >= max(1, 0.01 * letters[lang].sum()) for _, name in SCRIPTS]
    keys = np.array(sorted(grams), np.int64)
    logs = np.empty((len(keys) + 1, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        n = totals[lang] + 0.5 * (len(keys) + 1)
        logs[:-1, k] = np.log((np.fromiter((grams[g].get(lang, 0) for g in keys.tolist()), float, len(keys)) + 0.5) / n)
        logs[-1, k] = np.log(0.5 / n)
    return Model(langs, keys, logs - logs.mean(1, keepdims=True), used)


class Labeller:
    def __init__(self, model: Model):
        self.m = model
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.score = np.zeros((0, len(self.m.langs)), np.float32)
        self.letters = np.zeros(0, np.int32)
        self.known = np.zeros(0, bool)

    def _learn(self, chunks: list[str]) -> None:
        n, m = len(chunks), self.m
        lowered = [c.lower() for c in chunks]
        codes, at, grams = letter_grams("".join(lowered))
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, n))
        bounds = np.searchsorted(at, np.concatenate(([0], ends)))  # letters before each chunk
        # Chunks touch here, so a letter at an edge has its neighbour outside taken away.
        edge = np.zeros(len(codes) + 1, bool)
        edge[0] = True
        edge[ends] = True
        grams = np.where(edge[at], grams & ((1 << 42) - 1), grams)
        grams = np.where(edge[at + 1], grams & ~np.int64((1 << 21) - 1), grams)
        row = np.searchsorted(m.keys, grams) if len(m.keys) else np.zeros(len(grams), np.int64)
        if len(m.keys):
            row = np.where(m.keys[np.minimum(row, len(m.keys) - 1)] == grams, row, len(m.keys))
        ok = m.ranges[scripts_of(codes[at])]
        learned = ok.any(1)
        logs = np.where(ok, m.logs[row], EXCLUDED) * learned[:, None]
        sums = np.vstack([np.zeros((1, len(m.langs))), np.cumsum(logs, axis=0, dtype=np.float64)])
        score = np.diff(sums[bounds], axis=0)
        score = np.where(score < EXCLUDED / 2, EXCLUDED, np.clip(score, -12, 12))  # a word counts for a bounded amount
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + n)))
        self.score = np.vstack([self.score, score.astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.diff(bounds).astype(np.int32)])
        self.known = np.concatenate([self.known, np.diff(np.concatenate(([0], np.cumsum(learned)))[bounds]) > 0])

    def label(self, texts: pa.Array):
        """Per word: place of its text's language in langs, letters, whether it was scored; bounds of each text's words; the words' lists."""
        if len(self.place) > CACHE:
            self._clear()
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        words = pc.split_pattern(plain, " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.place]:
            self._learn(new)
        of = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[flat.indices.to_numpy(zero_copy_only=False)]
        return viterbi(self.score, of, bounds, SWITCH), self.letters[of], self.known[of], bounds, words


def viterbi(score: np.ndarray, of: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word; word i of all texts scores score[of[i]]. Texts run side by side, longest first, so that those still running are a prefix."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, size = bounds[:-1][order], size[order]
    label = np.zeros(len(of), np.int32)
    longest = int(size[0]) if len(size) else 0
    if not longest or not score.shape[1]:
        return label
    running = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than t words
    back = np.zeros((len(of), score.shape[1]), np.int32)
    best = score[of[first[: running[0]]]].astype(np.float64)
    stay = np.arange(score.shape[1], dtype=np.int32)
    ends = np.zeros(len(size), np.int32)
    for t in range(1, longest):
        n = running[t]
        if n < len(best):
            ends[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        at = first[:n] + t
        top = best.max(1)
        top -= switch
        moved = best < top[:, None]
        if moved.any():
            back[at] = np.where(moved, best.argmax(1).astype(np.int32)[:, None], stay)
            best = np.maximum(best, top[:, None])
        else:
            back[at] = stay
        best = best + score[of[at]]
    ends[: len(best)] = best.argmax(1)
    now = np.zeros(0, np.int32)
    for t in range(longest - 1, -1, -1):
        n = running[t]
        now = np.concatenate([now, ends[len(now) : n]])
        at = first[:n] + t
        label[at] = now
        if t:
            now = back[at, now]
    return label


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def fit(docs: DataFrame, usable: Column | None = None) -> Model:
    """Train on a bounded sample: about TRAIN_ROWS documents of each language, about TRAIN_ALL in all, by a hash that is under a language's share; equal rows count once.
    Texts are counted where they are; n-gram counts of the sample come to the driver."""
    common.ship(docs.sparkSession)
    rows = docs.where(F.lit(True) if usable is None else usable).where("lang is not null and length(trim(text)) > 0").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    known = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TRAIN_ALL).collect()
    each = min(TRAIN_ROWS, max(1, TRAIN_ALL // max(1, len(known))))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in known], "lang string, share double")  # TRAIN_ALL at most
    order = F.xxhash64("doc_id", "lang", "text")
    sample = rows.withColumn("o", order).join(F.broadcast(shares), "lang").where(F.pmod("o", F.lit(1 << 32)) < F.col("share") * (1 << 32))

    def made(batches):
        by: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(counted(text))
        for lang, found in by.items():
            key, at = np.unique(np.concatenate([k for k, _, _ in found]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n, _ in found]), minlength=len(key)).astype(np.int64)
            ranges = sum(r for _, _, r in found)
            # n-grams, then letters by range and the number of texts under numbers that no n-gram has
            key, n = np.concatenate([key, -1 - np.arange(len(SCRIPTS)), [-1 - len(SCRIPTS)]]), np.concatenate([n, ranges, [len(found)]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = sample.dropDuplicates(["lang", "o"]).select("lang", "text").mapInArrow(made, "lang string, gram long, n long")
    found = common.stored(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in found.where("gram >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    letters: dict[str, np.ndarray] = {}
    size: dict[str, int] = {}
    for r in found.where("gram < 0").collect():
        if -1 - r["gram"] == len(SCRIPTS):
            size[r["lang"]] = r["n"]
        else:
            letters.setdefault(r["lang"], np.zeros(len(SCRIPTS), np.int64))[-1 - r["gram"]] = r["n"]
    often = found.where("gram >= 0").groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("each")).where(F.col("all") >= LEAST)
    grams = {r["gram"]: {x["lang"]: x["n"] for x in r["each"]} for r in often.collect()}
    return train(size, {k: totals.get(k, 0) for k in size}, letters, grams)


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and, if asked for, spans: start and end in code points, language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: bounded by the training sample
    kind = "doc_id long, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans

    def labelled(batches):
        m = shared.value
        labeller = Labeller(m)
        for b in _slices(batches):
            lang, score, parts = _predicted(labeller, b.column("text"))
            out = [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)]
            if spans:
                out.append(pa.array(_spans(m, *parts), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])
        labeller._clear()
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(labelled, kind)


def keep(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, as they are, in a learned language that holds a share of `least` or more of the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        labeller = Labeller(shared.value)
        for b in _slices(batches):
            lang, score, _ = _predicted(labeller, b.column("text"))
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score)], pa.bool_()))
        labeller._clear()
        common.release()

    return docs.mapInArrow(kept, docs.schema)


def _slices(batches, rows: int = 2500):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _predicted(labeller: Labeller, texts: pa.Array):
    """Language and score of each text, and what _spans() needs."""
    label, letters, known, bounds, words = labeller.label(texts)
    langs = labeller.m.langs
    per = np.stack([_sums(np.where(known & (label == k), letters, 0), bounds) for k in range(len(langs))], 1) if langs else np.zeros((len(texts), 1))
    total = _sums(letters, bounds)
    lang = [langs[k] if n and langs else "und" for k, n in zip(per.argmax(1).tolist(), total.tolist())]
    return lang, per.max(1) / np.maximum(total, 1), (label, known, bounds, words)


def _spans(m: Model, label: np.ndarray, known: np.ndarray, bounds: np.ndarray, words: pa.Array) -> list[list[dict]]:
    size = pc.utf8_length(words.flatten()).to_numpy().astype(np.int64) + 1
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        starts = np.cumsum(size[lo:hi]) - size[lo:hi]
        own: list[dict] = []
        for i in np.flatnonzero(known[lo:hi]).tolist():
            end, lang = int(starts[i] + size[lo + i] - 1), m.langs[label[lo + i]]
            if own and own[-1]["lang"] == lang:
                own[-1]["end"] = end
            else:
                own.append({"start": int(starts[i]), "end": end, "lang": lang})
        out.append(own)
    return out


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, ~held & F.col("doc_id").isNotNull())
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
