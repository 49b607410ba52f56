"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample; every vector is then put into a leaf of
each tree, as a code of one byte a component. A query walks all trees through
one priority queue: a side that is not the query's own costs the squared
distance to the split, added up along the path, and the cheapest side comes
next. Queries and vectors meet leaf by leaf, the codes rank them, and the best
few of each query are ranked again by exact cosines in double precision. Equal
vectors are one point of the index that carries its smallest ids, so a large
group of copies is one point.

How many vectors a query looks at is measured, not assumed: on the sample,
queries walk the forest until it has shown TARGET of their true neighbours, and
that share of each tree is searched. Vectors in groups need a small share;
vectors without structure need a large one at every size. Where the trees
together would show as many vectors as there are, one tree is walked to the end
instead, which costs as much as brute force in blocks and leaves nothing out.

Defined results: null and zero vectors, those with null or non-finite
components, and those whose length is not the commonest (of equally common, the
smallest) take no part. Rows that share a vec_id with the query are its own row. Repeated rows
count once. With fewer candidates all are returned; an empty table gives an
empty result. A null vec_id is no query; as a candidate it comes after others
of its score. Only vec_id and embedding are read. Vectors are told apart by 128
bits of hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import common

K = 5
TREES = 8
#: Share of true neighbours that the searched share of the trees has to show, and queries that it is measured with.
TARGET, PROBES = 0.96, 120
#: Vectors to a leaf on average, vectors that the trees are fitted on, and vectors that are searched in one task.
LEAF, SAMPLE, TOGETHER = 50, 20_000, 25_000
#: Candidates of each task and query, and of each query in all, that exact cosines rank: at least this many times the neighbours sought.
SHORTLIST = 3


@dataclass
class Tree:
    #: Split k sends a vector to 2k + 1 if its product with normals[k] is under cuts[k], else to 2k + 2; places from len(cuts) on are leaves.
    normals: np.ndarray
    cuts: np.ndarray
    #: Share of the sample in each leaf.
    shares: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(sample: np.ndarray, depth: int, trees: int, seed: int = 7) -> list[Tree]:
    """Balanced trees: each split is across the line between two random vectors, at the median."""
    out = []
    for t in range(trees):
        rng = np.random.default_rng(seed + t)
        splits = (1 << depth) - 1
        normals, cuts = np.zeros((splits, sample.shape[1])), np.zeros(splits)
        members: dict[int, np.ndarray] = {0: np.arange(len(sample))}
        for k in range(splits):
            own = members.pop(k)
            if len(own) >= 2:
                a, b = rng.choice(own, 2, replace=False)
                normal = sample[a] - sample[b]
            else:
                normal = rng.standard_normal(sample.shape[1])
            normal /= max(1e-12, float(np.sqrt(normal @ normal)))
            p = sample[own] @ normal
            normals[k], cuts[k] = normal, float(np.median(p)) if len(own) else 0.0
            members[2 * k + 1], members[2 * k + 2] = own[p < cuts[k]], own[p >= cuts[k]]
        out.append(Tree(normals, cuts, np.array([len(members[splits + i]) for i in range(splits + 1)]) / max(1, len(sample))))
    return out


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each vector."""
    at = np.zeros(len(x), np.int64)
    splits = len(tree.cuts)
    while splits and at[0:1].size and at.min() < splits:
        right = np.einsum("ij,ij->i", x, tree.normals[at]) >= tree.cuts[at]
        at = 2 * at + 1 + right
    return at - splits


def walk(forest: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of one queue for all trees: the least sum of squared distances to the splits that were crossed."""
    margins = [t.normals @ q - t.cuts for t in forest]
    heap = [(0.0, t, 0) for t in range(len(forest))]
    while heap:
        far, t, at = heapq.heappop(heap)
        m, splits = margins[t], len(forest[t].cuts)
        while at < splits:
            d = float(m[at])
            near, other = (2 * at + 2, 2 * at + 1) if d >= 0 else (2 * at + 1, 2 * at + 2)
            heapq.heappush(heap, (far + d * d, t, other))
            at = near
        yield t, at - splits


def visit(forest: list[Tree], q: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Leaves in the order of walk(), until their shares add up to `share` in each tree on average."""
    out, seen, enough = [], 0.0, share * len(forest) - 1e-9
    for t, at in walk(forest, q):
        if seen >= enough:
            break
        out.append((t, at))
        seen += float(forest[t].shares[at])
    return out


def searched(forest: list[Tree], sample: np.ndarray, k: int, target: float = TARGET, probes: int = PROBES) -> float | None:
    """The share of each tree that shows `target` of the true neighbours of some of the sample; None where the trees together would show as many vectors as there are."""
    asked = np.unique(np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype(int)) if len(sample) else []
    at = [leaves(t, sample) for t in forest]
    reached: list[float] = []
    for i in asked:
        s = sample @ sample[i]
        s[i] = -np.inf
        top = min(k, len(sample) - 1)
        near = np.argpartition(-s, top - 1)[:top] if top > 0 else np.zeros(0, np.int64)
        places: dict[tuple[int, int], list[int]] = {}
        for t in range(len(forest)):
            for j in near.tolist():
                places.setdefault((t, int(at[t][j])), []).append(j)
        left, seen = set(near.tolist()), 0.0
        for leaf in walk(forest, sample[i]):
            seen += float(forest[leaf[0]].shares[leaf[1]])
            if seen >= 1 or not left:
                break
            found = left.intersection(places.get(leaf, ()))
            reached += [seen] * len(found)
            left -= found
        reached += [np.inf] * len(left)
    cost = float(np.quantile(reached, target, method="higher")) if reached else np.inf
    return cost / len(forest) if cost < 1 else None


def valid(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (components as they are, or double) and its hashes a and b, of the rows that take part."""
    kind = rows.schema[vector_col].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.transform(F.col(vector_col).cast(f"array<{number}>"), lambda c: c + F.lit(0).cast(number))  # no -0.0
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & fine)
    return found.withColumns({"a": F.xxhash64("v"), "b": F.xxhash64(F.lit(1), "v")})


def _same_length(found: DataFrame) -> DataFrame:
    top = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("v") == (top["d"] if top else 0))


def points_of(found: DataFrame, is_query, k: int) -> DataFrame:
    """Stored: p (a number), v, its hashes, ids (the k + 1 smallest; enough, whichever of them the query is), whether a null id is one of those, and whether a query asks for the vector."""
    each = found.select("a", "b", "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("vec_id").asc_nulls_last()))  # the limit by rank works before the shuffle too
    ids = each.withColumn("n", rank).where(F.col("n") <= k + 1).groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.max(F.col("vec_id").isNull()).alias("has_null"))
    vectors = found.groupBy("a", "b").agg(F.first("v").alias("v"), F.coalesce(F.max(is_query(F.col("vec_id"))), F.lit(False)).alias("asked"))
    return common.stored(vectors.join(ids, ["a", "b"]).withColumn("p", F.monotonically_increasing_id()), "points")


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as a byte a component, and what a byte's unit stands for."""
    scale = np.abs(x).max(1, initial=1e-30) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _first(ids: pa.Array) -> np.ndarray:
    return np.array([i[0] if i else np.iinfo(np.int64).max for i in ids.to_pylist()], np.int64)


def nearest(rows: DataFrame, is_query, k: int = K, trees: int = TREES, share: float | None = None, leaf: int = LEAF, together: int = TOGETHER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row with a vec_id for which is_query (a condition on vec_id) holds.

    share: of each tree that a query searches; without it, what searched() finds."""
    spark = rows.sparkSession
    found = _same_length(valid(rows))
    points = points_of(found, is_query, k)
    n = points.count()
    got = points.orderBy("a", "b").limit(SAMPLE).select("v").toPandas()["v"]
    sample = unit(np.stack(got.to_list()).astype(float)) if len(got) else np.zeros((0, 1))
    depth = max(0, min(round(np.log2(max(1, n) / leaf)), int(np.log2(max(1, len(got)))) - 3))
    forest = fit(sample, depth, trees) if len(got) else []
    share = share or searched(forest, sample, k)
    if share is None:
        forest, share = forest[:1], 1.0
    shared = spark.sparkContext.broadcast(forest)  # trees * 2**depth normals, bounded by the sample
    low = max(0, min(depth, int(np.floor(np.log2(max(1.0, together / max(1.0, n / 2**depth)))))))
    chunks = max(1, -(-n // (together << (depth - low))))  # leaves that a sample cannot cut further are cut by number
    short = SHORTLIST * (k + 1)

    def placed(batches):
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("v")))
                code, scale = coded(x)
                code = pa.array([c.tobytes() for c in code], pa.binary())
                p, first = b.column("p"), pa.array(_first(b.column("ids")))
                chunk = pa.array((p.to_numpy() % chunks).astype(np.int32))
                for t, tree in enumerate(shared.value):
                    at = leaves(tree, x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((at >> low).astype(np.int32)), chunk, pa.array(at.astype(np.int32)), p, first, code, pa.array(scale)], names=["tree", "part", "chunk", "leaf", "p", "first", "code", "scale"])

    def asked(batches):
        for b in batches:
            x = unit(_matrix(b.column("v"))) if b.num_rows else ()
            for i, (q, v) in enumerate(zip(b.column("p").to_pylist(), x)):
                by: dict[tuple[int, int], list[int]] = {}
                for t, at in visit(shared.value, v, share):
                    by.setdefault((t, at >> low), []).append(at)
                out = [(t, p, c, np.array(at, np.int32).tobytes(), q, v.astype(np.float32).tobytes()) for (t, p), at in by.items() for c in range(chunks)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()))], names=["tree", "part", "chunk", "leaves", "q", "v"])

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best by code of one part of a tree, for each query that visits leaves of it."""
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "p": pd.Series(dtype="int64"), "first": pd.Series(dtype="int64"), "near": pd.Series(dtype="float32")})
        right = right.sort_values("leaf", kind="stable")
        x = np.frombuffer(b"".join(right["code"]), np.int8).reshape(len(right), -1).astype(np.float32) * right["scale"].to_numpy(np.float32)[:, None]
        at, p, first = right["leaf"].to_numpy(), right["p"].to_numpy(np.int64), right["first"].to_numpy(np.int64)
        out = []
        for i in range(0, len(left), 256):
            part = left.iloc[i : i + 256]
            q = np.frombuffer(b"".join(part["v"]), np.float32).reshape(len(part), -1)
            visits = [np.frombuffer(v, np.int32) for v in part["leaves"]]
            of, leaf_ = np.repeat(np.arange(len(part)), [len(v) for v in visits]), np.concatenate(visits)
            order = np.argsort(leaf_, kind="stable")
            of, leaf_ = of[order], leaf_[order]
            own, starts = np.unique(leaf_, return_index=True)
            s = np.full((len(part), len(x)), -np.inf, np.float32)
            for a, who, lo, hi in zip(own, np.split(of, starts[1:]), np.searchsorted(at, own), np.searchsorted(at, own, side="right")):
                s[who, lo:hi] = q[who] @ x[lo:hi].T
            top = min(short, s.shape[1])
            least = np.partition(s, -top, axis=1)[:, -top]
            r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            near = s[r, c]
            order = np.lexsort((first[c], -near, r))  # of equal ones those with the smallest ids
            r, c, near = r[order], c[order], near[order]
            k_ = np.arange(len(r)) - np.searchsorted(r, r) < short
            out.append(pd.DataFrame({"q": part["q"].to_numpy(np.int64)[r[k_]], "p": p[c[k_]], "first": first[c[k_]], "near": near[k_]}))
        return pd.concat(out)

    def exact(batches):
        for b in batches:
            s = cosine(_matrix(b.column("asks")), _matrix(b.column("v"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("ids"), b.column("has_null"), pa.array(s)], names=["q", "ids", "has_null", "score"])

    index = points.select("p", "v", "ids").mapInArrow(placed, "tree int, part int, chunk int, leaf int, p long, first long, code binary, scale float")
    queries = points.where("asked").select("p", "v").mapInArrow(asked, "tree int, part int, chunk int, leaves binary, q long, v binary")
    key = ["tree", "part", "chunk"]
    best = queries.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(met, "q long, p long, first long, near float")
    once = best.groupBy("q", "p").agg(F.max("near").alias("near"), F.first("first").alias("first"))
    listed = once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "first", "p"))).where(F.col("n") <= short).select("q", "p")
    both = listed.join(points.select("p", "v", "ids", "has_null"), "p").join(points.where("asked").select(F.col("p").alias("q"), F.col("v").alias("asks")), "q")
    scored = both.select("q", "asks", "v", "ids", "has_null").mapInArrow(exact, "q long, ids array<long>, has_null boolean, score double")
    each = scored.select("q", "score", F.explode(F.when(F.col("has_null"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids"))).alias("vec_id"))
    top = each.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    asking = found.where(F.col("vec_id").isNotNull() & is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "a", "b").distinct()
    asking = asking.join(points.where("asked").select("a", "b", F.col("p").alias("q")), ["a", "b"])
    pairs = asking.join(top, "q").where(~F.col("query_id").eqNullSafe(F.col("vec_id")))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows in pairs, in double precision. Components are divided by the largest power of two in their row, which is exact and keeps squares finite."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1]) for x in (a, b))
    return np.clip(dot(a, b) / np.sqrt(dot(a, a)) / np.sqrt(dot(b, b)), -1.0, 1.0)


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose vec_id is divisible by 50, among all vectors."""
    return nearest(common.table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
