"""Stupid-backoff scores of documents against all other documents.

n-grams of words, up to three, are counted over all documents. A document is
scored by the counts less its own (leave one out), for with them it would find
every n-gram of its own in the tables and never back off. The score of word w
after u, v is c(uvw) / c(uv) if c(uvw) > 0, else ALPHA times that of w after v
alone, and in the end ALPHA times c(w) / N, where a word not seen elsewhere
counts UNSEEN.

Relations here are packed. A block is some documents as arrays of word numbers
with its words' hashes. Each block sends its distinct n-grams' 56-bit hashes
with its counts, cut by hash, to the partitions of the count table; a partition
adds up its part and answers each block, key by key; blocks join the answers to
their documents' n-grams and sum per document. A very frequent n-gram arrives
once a block, so there is no hot key, and a partition holds a bounded number of
keys because the number of partitions follows the number of words. Hashes of 56
bits take different n-grams for the same once in 7 * 10**16 pairs.

Defined results: a null or empty text has no word, score 0 and a null mean. So
have all where there is no other document with a word. Repeated rows are
documents of their own, each in the others' counts. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALPHA, UNSEEN = 0.4, 0.5
#: Bytes of text in a block, and n-grams in a partition of the count table, about.
BLOCK_BYTES, PART_KEYS = 8_000_000, 2_000_000


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _spread(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    """Byte by byte: high bytes of small numbers are nearly all zero."""
    return _squeeze(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _joined(b: bytes, kind) -> np.ndarray:
    planes = _spread(b, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_joined(b, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """block, doc_ids, sizes (words of each), words (hashes), codes (places in words)."""

    def made(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        hashed = lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        for whole in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES, prepend=0)).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, whole.num_rows]):
                if hi == lo:
                    continue
                b = whole.slice(lo, hi - lo)
                plain = pc.fill_null(b.column("text").cast(pa.large_string()), "")
                for white in "\n\t\r\x0b\x0c":
                    plain = pc.replace_substring(plain, white, " ")
                split = pc.split_pattern(plain, " ")
                flat, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                before = np.concatenate(([0], np.cumsum(word)))
                coded = flat.filter(pa.array(word)).dictionary_encode()
                vocabulary = np.fromiter(map(hashed, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
                # The most frequent words get the smallest numbers, which pack best.
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(-np.bincount(codes, minlength=len(vocabulary)), kind="stable")
                number = np.empty(len(order), np.int32)
                number[order] = np.arange(len(order), dtype=np.int32)
                sizes = np.diff(before[bounds])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + k]), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([_squeeze(vocabulary[order])], pa.binary()), pa.array([_planes(number[codes])], pa.binary())],
                    names=["block", "doc_ids", "sizes", "words", "codes"],
                )
                k += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "block long, doc_ids array<long>, sizes array<long>, words binary, codes binary")


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Grams:
    """n-grams of a block: `keys`, sorted and distinct for all orders; place[o][i]: key of the n-gram of o + 1 words that ends at word i, and own[o][i]: its count in its document. has[o]: whether there is one."""

    def __init__(self, words: bytes, codes: bytes, sizes: np.ndarray):
        w = _spread(words, np.uint64)[_joined(codes, np.int32)]
        n = len(w)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        two, three = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        two[1:] = _mix(w[:-1], 1) * np.uint64(3) + w[1:]
        three[2:] = _mix(two[1:-1], 2) * np.uint64(5) + w[2:]
        self.has = [at >= o for o in range(3)]
        # One order after another, which takes a third of the memory; then the orders' distinct keys are sorted together.
        keys, counts, self.place = [], [], []
        for o, x in enumerate((w, two, three)):
            own, inverse, k = np.unique(_mix(x, 11 + o)[self.has[o]] >> np.uint64(8), return_inverse=True, return_counts=True)
            p = np.zeros(n, np.int32)
            p[self.has[o]] = inverse
            keys.append(own)
            counts.append(k.astype(np.uint32))
            self.place.append(p)
        del w, two, three
        bounds = np.cumsum([0, *map(len, keys)])
        order = np.argsort(np.concatenate(keys), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.keys, self.counts = np.concatenate(keys)[order], np.concatenate(counts)[order]
        for o in range(3):
            if len(keys[o]):
                self.place[o] = rank[bounds[o] :][self.place[o]]

    def own(self, o: int) -> np.ndarray:
        n = len(self.doc)
        out = np.zeros(n, np.int64)
        i = np.flatnonzero(self.has[o])
        if len(i):
            i = i[np.argsort(self.place[o][i], kind="stable")]  # by key, then by document
            p, d = self.place[o][i], self.doc[i]
            new = np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
            run = np.cumsum(new) - 1
            out[i] = np.bincount(run)[run]
        return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_trigram, n_bigram, n_unigram (words scored at each order), log_score, mean_log_score."""
    words = docs.agg(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^ \n\t\r\x0B\f]+"))).alias("n")).first()["n"] or 0
    # Both uses below read one shuffle of the blocks, for which they must select the same columns.
    packed = blocks(docs).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    bits = max(0, int(np.ceil(np.log2(max(1.0, 1.7 * words / PART_KEYS)))))

    def asked(batches):
        for b in batches:
            for r in b.to_pylist():
                g = _Grams(r["words"], r["codes"], np.array(r["sizes"], np.int64))
                g.place = []
                parts = (g.keys >> np.uint64(56 - bits)).astype(np.int64) if bits else np.zeros(len(g.keys), np.int64)
                cuts = np.flatnonzero(np.diff(parts, prepend=-1)).tolist() + [len(g.keys)]  # of the parts that have n-grams of this block
                for k in range(0, len(cuts) - 1, 64):
                    own = list(zip(cuts[k : k + 64], cuts[k + 1 : k + 65]))
                    columns = [pa.array(parts[[lo for lo, _ in own]].astype(np.int32)), pa.array([r["block"]] * len(own)), pa.array([_pack_keys(g.keys[lo:hi]) for lo, hi in own], pa.binary()), pa.array([_planes(g.counts[lo:hi]) for lo, hi in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "keys", "counts"])

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        """One partition of the count table, and its answers."""
        keys = [_unpack_keys(k) for k in pdf["keys"]]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([_joined(c, np.uint32) for c in pdf["counts"]])).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "totals": [_planes(total[place[e - len(k) : e]]) for k, e in zip(keys, ends)]})
        del keys, place, total
        common.release()
        return out

    def summed(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in own.itertuples():
            sizes = np.array(r.sizes, np.int64)
            g = _Grams(r.words, r.codes, sizes)
            ordered = answers.sort_values("part")["totals"]
            totals = np.concatenate([_joined(t, np.int64) for t in ordered]) if len(ordered) else np.zeros(0, np.int64)
            others = (words - sizes)[g.doc].astype(float)
            c = [np.where(g.has[o], totals[g.place[o]] - g.own(o), 0) for o in range(3)] if len(totals) else [np.zeros(0, np.int64)] * 3
            before = lambda x: np.concatenate((np.zeros(1, x.dtype), x[:-1]))
            with np.errstate(divide="ignore", invalid="ignore"):
                level = np.where(c[2] > 0, 2, np.where(c[1] > 0, 1, 0))
                top = np.minimum(np.where(g.has[2], 2, np.where(g.has[1], 1, 0)), 2)
                logs = np.where(level == 2, np.log(c[2]) - np.log(before(c[1])), np.where(level == 1, np.log(c[1]) - np.log(before(c[0])), np.log(np.maximum(c[0], UNSEEN)) - np.log(others)))
            logs = np.where(others > 0, logs + (top - level) * np.log(ALPHA), 0.0)
            per = lambda x: np.bincount(g.doc, weights=x, minlength=len(sizes))
            sums = per(logs)
            out.append(pd.DataFrame({"doc_id": pd.array(r.doc_ids, "Int64"), "n_words": sizes, **{f"n_{name}": per(level == o).astype(np.int64) for o, name in ((2, "trigram"), (1, "bigram"), (0, "unigram"))}, "log_score": sums, "mean_log_score": np.where(sizes > 0, sums / np.maximum(sizes, 1), np.nan)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", "log_score", "mean_log_score"], dtype=object)

    table = packed.mapInArrow(asked, "part int, block long, keys binary, counts binary").groupBy("part").applyInPandas(counted, "block long, part int, totals binary")
    found = packed.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(summed, "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, log_score double, mean_log_score double")
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("mean_log_score")))


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, to 4 decimal places."""
    found = score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_trigram", "n_bigram", "n_unigram", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r\\x0B\\f]+'), lambda w: w <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i - 1] END AS w2, CASE WHEN i > 2 THEN ws[i - 2] END AS w1 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u1 AS (SELECT w3 AS a, count(*) AS n FROM t GROUP BY ALL), o1 AS (SELECT doc_id, w3 AS a, count(*) AS n FROM t GROUP BY ALL),
u2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM t WHERE i > 1 GROUP BY ALL), o2 AS (SELECT doc_id, w2 AS a, w3 AS b, count(*) AS n FROM t WHERE i > 1 GROUP BY ALL),
u3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM t WHERE i > 2 GROUP BY ALL), o3 AS (SELECT doc_id, w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM t WHERE i > 2 GROUP BY ALL),
c1 AS (SELECT doc_id, a, u1.n - o1.n AS n FROM o1 JOIN u1 USING (a)),
c2 AS (SELECT doc_id, a, b, u2.n - o2.n AS n FROM o2 JOIN u2 USING (a, b)),
c3 AS (SELECT doc_id, a, b, c, u3.n - o3.n AS n FROM o3 JOIN u3 USING (a, b, c)),
r AS (SELECT doc_id, len(ws) AS n_words, (SELECT count(*) FROM t) - len(ws) AS others FROM d),
x AS (
  SELECT t.doc_id, i, r.others, coalesce(k3.n, 0) AS n3, coalesce(k2.n, 0) AS n2, k1.n AS n1, coalesce(h2.n, 0) AS p2, coalesce(h1.n, 0) AS p1
  FROM t JOIN r ON r.doc_id = t.doc_id
  LEFT JOIN c3 k3 ON k3.doc_id = t.doc_id AND k3.a = w1 AND k3.b = w2 AND k3.c = w3
  LEFT JOIN c2 k2 ON k2.doc_id = t.doc_id AND k2.a = w2 AND k2.b = w3
  JOIN c1 k1 ON k1.doc_id = t.doc_id AND k1.a = w3
  LEFT JOIN c2 h2 ON h2.doc_id = t.doc_id AND h2.a = w1 AND h2.b = w2
  LEFT JOIN c1 h1 ON h1.doc_id = t.doc_id AND h1.a = w2),
s AS (
  SELECT doc_id, CASE WHEN n3 > 0 THEN 2 WHEN n2 > 0 THEN 1 ELSE 0 END AS level, least(i - 1, 2) AS top,
    CASE WHEN n3 > 0 THEN ln(n3) - ln(p2) WHEN n2 > 0 THEN ln(n2) - ln(p1) ELSE ln(greatest(n1, {UNSEEN})) - ln(others) END AS l
  FROM x),
g AS (SELECT doc_id, count(*) FILTER (level = 2) AS n3, count(*) FILTER (level = 1) AS n2, count(*) FILTER (level = 0) AS n1, sum(l + (top - level) * ln({ALPHA})) AS total FROM s GROUP BY doc_id)
SELECT r.doc_id, n_words::BIGINT AS n_words, coalesce(n3, 0)::BIGINT AS n_trigram, coalesce(n2, 0)::BIGINT AS n_bigram, coalesce(n1, 0)::BIGINT AS n_unigram,
  round(coalesce(total, 0), 4) AS log_score, CASE WHEN n_words > 0 THEN round(total / n_words, 4) END AS mean_log_score
FROM r LEFT JOIN g ON g.doc_id = r.doc_id
"""
