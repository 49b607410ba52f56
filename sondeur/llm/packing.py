"""Sum-of-squares packing of token sequences.

Texts are tokenized word by word: the tokenizer drops white space and never
looks across it, so each distinct run of other characters is encoded once and
its ids are gathered. Marks after a letter are words of their own, and words of
plain lower-case letters go to the tokenizer's merges at once. Every piece goes into one of many groups of bounded size
at random; in a group pieces are placed longest first, each where the sum of
squared counts of open bins per residual gap becomes smallest (a full bin does
not count). A group leaves a few bins part filled, which is the price of
packing groups on different machines.

Defined results: a null text is an empty one, and an empty one is the end mark
alone. Repeated rows are packed each. Only documents longer than a sequence
are cut, into full pieces and a rest. An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END = 1
CAPACITY = 4096
#: Pieces in a group, on average.
GROUP = 20_000
#: Distinct words whose ids a worker keeps.
CACHE = 600_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that end a word after a letter, which the tokenizer always parts from it; letters that its steps may end in a combining mark, which would stay with them, are not among these.
MARKS = r"([A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{4E00}-\x{9FFF}])([,.!?;:*$%#&]+)( |$)"
#: Words that no step of the tokenizer before its merges would change or split.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker; a task leaves it without words."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of whole texts, as flat arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bytes_alone = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def _learn(self, words: list[str]) -> None:
        plain, other = [w for w in words if PLAIN(w)], [w for w in words if not PLAIN(w)]
        for steps, own in ((self.bytes_alone, plain), (self.steps, other)):
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
            for at in range(0, len(own), 20_000):
                some = own[at : at + 20_000]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                self.place.update(zip(some, range(len(self.place), len(self.place) + len(some))))
                self.lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                self.ids.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(self.lengths[-1].sum())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one place more than texts)."""
        if len(self.place) > CACHE:
            self._clear()
        plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        # Fewer words to learn: the tokenizer lowers case, but seeks special tokens before it does.
        plain = pc.if_else(pc.match_substring(plain, "<"), plain, pc.ascii_lower(plain))
        words = pc.split_pattern(pc.replace_substring_regex(plain, MARKS, r"\1 \2\3"), " ")
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.place]:
            self._learn(new)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, np.int64)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        self.lengths, self.ids = [lengths], [ids]
        starts = np.cumsum(lengths) - lengths
        of = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[flat.indices.to_numpy(zero_copy_only=False)]
        each = lengths[of]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts[of] - (ends - each), each) + np.arange(total)
        bounds = np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return ids[take], bounds


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: a row per piece; salt is any number, evenly spread."""

    def cut(batches):
        from pyspark import TaskContext

        encode, n = encoder(path).encode, 0
        task = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids, bounds = encode(b.column("text"))
                rows = []
                for doc, lo, hi in zip(b.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.append(ids[lo:hi], np.uint32(end)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
                out = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                salt = (np.arange(n, n + len(rows), dtype=np.uint64) + np.uint64(task << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
                n += len(rows)
                yield pa.RecordBatch.from_arrays([*out, pa.array(salt.astype(np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        encoder(path)._clear()
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, placed longest first. Bins of an equal gap are alike, so the last one opened is taken."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; those of gap 0 are full and stay 0
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        # The sum changes by 2 (after - before) + 2 when a bin moves from one gap to another, by 1 - 2 before when it fills up.
        gaps = count[s:]
        change = 2 * (count[: capacity + 1 - s] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = 1 << 40
        k = int(change.argmin())
        if change[k] >= (1 << 40):  # none fits; lengths fall, so a bin opened sooner could only stay emptier
            bins[i], offsets[i], gap = made, 0, capacity - s
            made += 1
        else:
            gap = k + s
            bins[i], offsets[i] = stacks[gap].pop(), capacity - gap
            count[gap] -= 1
            gap = k
        if gap:
            stacks[gap].append(int(bins[i]))
            count[gap] += 1
    return bins, offsets


def pack(found: DataFrame, n: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """sequence_id and offset for n stored rows with length and salt."""
    groups = max(1, -(-n // group))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "salt"], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=bins + (int(pdf["_group"].iloc[0]) << 32), offset=offsets)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return found.withColumn("_group", F.col("salt") % groups).groupBy("_group").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    found = common.stored(pieces(docs, path or tokenizer_path()), "pieces")
    return pack(found, found.count())


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packed(common.table(spark, sf_dir, "documents"))
