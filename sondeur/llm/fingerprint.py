"""Homomorphic multiset fingerprints of documents, on DataFrame functions alone.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a
wide vector, and a text's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo powers of two: the order of paragraphs does not matter,
and a paragraph is added or taken away by adding or subtracting its vector
(`add`, `subtract`). 8 lanes modulo 2**32 hold hashes of the whole paragraph
and settle equality. 64 lanes modulo 2**16 count its runs of three words by
hash and give a likeness: the correlation of two texts' counts, none below 0.

Defined results: a null text is an empty one; it is one empty paragraph.
Repeated rows give repeated results. Order is by descending doc_id, null ids
last, ties by text; after the last row comes the first, so an only row is its
own next. Likeness of equal fingerprints is 1, else 0 where either has the same
count in all lanes. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DENSE, LANES = 8, 64
#: Rows that a bucket of neighbours should hold, and buckets at most.
BUCKET_ROWS, BUCKETS = 1_500, 2_000
_LOW = 0xFFFFFFFF


def vectors(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys and `vector`, an array of DENSE + LANES longs, of each row's text. keys must tell rows apart."""
    lines = rows.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("_line"))
    hashed = [F.xxhash64(F.lit(i), F.col("_line")).alias(f"_p{i}") for i in range(DENSE // 2)]
    lines = lines.select(*keys, *hashed, F.regexp_extract_all("_line", F.lit(r"\S+(?:\s+\S+){0,2}"), F.lit(0)).alias("_runs"))
    runs = lines.select(*keys, *[f"_p{i}" for i in range(DENSE // 2)], F.posexplode_outer("_runs").alias("_at", "_run"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    h = F.xxhash64("_run")
    # Two lanes share a long, 31 bits apart, so that no sum of one text's counts can overflow.
    runs = runs.select(
        *keys,
        *[F.when(first, F.col(f"_p{i}")).otherwise(F.lit(0)).alias(f"_p{i}") for i in range(DENSE // 2)],
        F.when(F.col("_run").isNull(), F.lit(-1)).otherwise(h.bitwiseAND(F.lit(LANES - 1)).cast("int")).alias("_lane"),
    )
    half = F.shiftright("_lane", 1)
    one = F.when(F.col("_lane") % 2 == 0, F.lit(1)).otherwise(F.lit(1 << 31)).cast("long")
    runs = runs.withColumn("_half", half).withColumn("_one", one)
    sums = []
    for i in range(DENSE // 2):
        sums += [F.sum(F.col(f"_p{i}").bitwiseAND(F.lit(_LOW))).alias(f"_d{2 * i}"), F.sum(F.shiftrightunsigned(f"_p{i}", 32)).alias(f"_d{2 * i + 1}")]
    sums += [F.sum(F.when(F.col("_half") == j, F.col("_one")).otherwise(F.lit(0))).alias(f"_s{j}") for j in range(LANES // 2)]
    total = runs.groupBy(*keys).agg(*sums)
    dense = [F.col(f"_d{i}").bitwiseAND(F.lit(_LOW)) for i in range(DENSE)]
    sketch = [x for j in range(LANES // 2) for x in (F.col(f"_s{j}").bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(f"_s{j}", 31).bitwiseAND(F.lit(0xFFFF)))]
    return total.select(*keys, F.array(*dense, *sketch).alias("vector"))


def _modulus(i: Column) -> Column:
    return F.when(i < DENSE, F.lit(_LOW)).otherwise(F.lit(0xFFFF)).cast("long")


def _each(a: Column, b: Column, sign: int) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: (x["a"] + sign * x["b"]).bitwiseAND(_modulus(i)))


def add(a: Column, b: Column) -> Column:
    """The vector of two multisets' union."""
    return _each(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    """The vector of a's multiset without b's."""
    return _each(a, b, -1)


def text_of(vector: Column) -> Column:
    """The vector as hex digits: 8 for each of the first lanes, 4 for each of the others."""
    return F.lower(F.array_join(F.transform(vector, lambda x, i: F.lpad(F.hex(x), F.when(i < DENSE, 8).otherwise(4), F.lit("0"))), ""))


def likeness(a: Column, b: Column) -> Column:
    sketch = lambda v: F.slice(v, DENSE + 1, LANES)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, p: s + p) / LANES
    x, y = sketch(a), sketch(b)
    cov = dot(x, y) - LANES * mean(x) * mean(y)
    vx, vy = dot(x, x) - LANES * mean(x) * mean(x), dot(y, y) - LANES * mean(y) * mean(y)
    return F.when(a == b, F.lit(1.0)).when((vx > 1e-9) & (vy > 1e-9), F.greatest(F.lit(0.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy)))).otherwise(F.lit(0.0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, with bucket and rank, which tell rows apart. Neighbours meet in buckets of doc_id, and each bucket gets the next one's first row as a sentinel, so no task sees all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    buckets = max(1, min(BUCKETS, n // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    # The number of cuts at or above the id grows as ids fall; null ids come last.
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c >= F.col("doc_id"))))
    placed = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())  # BUCKETS + 1 rows at most
    if firsts:
        into = [(firsts[k][0], firsts[(k + 1) % len(firsts)][1]) for k in range(len(firsts))]
        ends = docs.sparkSession.createDataFrame(into, "_into int, _top long")
        sentinels = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_top"))).groupBy("_into").agg(F.min("text").alias("text"))
        sentinels = sentinels.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_into").alias("bucket"), F.lit(1).alias("sentinel"))
    else:
        sentinels = placed.withColumn("sentinel", F.lit(1)).limit(0)
    both = placed.withColumn("sentinel", F.lit(0)).unionByName(sentinels)
    w = Window.partitionBy("bucket").orderBy("sentinel", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("rank", F.row_number().over(w)).where("sentinel = 0").drop("sentinel")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    near = with_next(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    sha = F.sha2(F.encode("edited", "UTF-8"), 256)
    keys = ["bucket", "rank", "doc_id", "n_chars", *[f"_sha{k}" for k in range(4)]]  # all of fixed width, for hash aggregation
    near = near.withColumn("_sha", sha).select("bucket", "rank", "doc_id", "n_chars", *[F.conv(F.substring("_sha", 16 * k + 1, 16), 16, -10).cast("long").alias(f"_sha{k}") for k in range(4)], F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(c).alias("t")) for v, c in enumerate(("text", "edited", "next_text"))])).alias("_v"))
    near = near.select(*keys, "_v.variant", "_v.t")
    found = vectors(near, "t", [*keys, "variant"])
    of = lambda v: F.first(F.when(F.col("variant") == v, F.col("vector")), ignorenulls=True)
    found = found.groupBy(*keys).agg(of(0).alias("own"), of(1).alias("edited"), of(2).alias("next"))
    return found.select(
        "doc_id", "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"_sha{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
