"""Consistent hashing with bounded loads, on DataFrame functions alone.

Each shard has virtual nodes on a ring of 2**60 places; a row's place is a hash
of its key. The arc that ends at a virtual node belongs to that node's shard.
A shard takes rows up to its capacity; the rest continue clockwise to the next
shard that has room. Rows are counted per arc first, and the few counts (one an
arc at most) give every shard's quota of every arc, so rows move once, to be
numbered within their arc: nothing is gathered per shard, and a full shard is
no hot spot. Capacities that add up to the number of rows make counts differ by
one at most; with slack (`epsilon`) fewer rows move when shards are added.

Defined results: a null text has size 1 (no byte, plus 1) and CRC32 0, the
CRC32 of the empty text. A null doc_id is a key like any other. Repeated rows
each get a slot of their own. An empty table gives an empty result. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
NODES = 64
_RING = 1 << 60


def ring(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise."""
    place = lambda s, v: int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:15], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def capacities(rows: int, points: list[tuple[int, int]], shards: int, epsilon: float = 0.0) -> list[int]:
    """With epsilon 0 the shares add up to `rows`: those first on the ring hold one more. Otherwise ceil((1 + epsilon) * rows / shards)."""
    if epsilon:
        return [-(-int(rows * (1 + epsilon) * 1_000_000) // (shards * 1_000_000)) + 1] * shards
    order = list(dict.fromkeys(s for _, s in points))
    more = set(order[: rows % shards])
    return [rows // shards + (s in more) for s in range(shards)]


def quotas(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank). First every arc fills its own shard, then overflow goes on clockwise, a step at a time."""
    n = len(points)
    room = list(room)
    left = {a: c for a, c in counts.items() if c}
    used = [0] * len(room)
    rank = dict.fromkeys(left, 0)
    out = []
    for step in range(n):
        for a in sorted(left):
            s = points[(a + step) % n][1]
            if take := min(left[a], room[s]):
                out.append((a, rank[a], rank[a] + take, s, used[s]))
                rank[a] += take
                used[s] += take
                room[s] -= take
                left[a] -= take
        left = {a: c for a, c in left.items() if c}
        if not left:
            break
    return out


def place_of(place: int, points: list[tuple[int, int]]) -> int:
    return bisect_left([p for p, _ in points], place) % len(points)


def shard(rows: DataFrame, key: list[str], shards: int = SHARDS, nodes: int = NODES, epsilon: float = 0.0) -> DataFrame:
    """rows with shard and slot (gapless from 0 in each shard), which take the place of columns of these names. key: the columns whose hash gives the place."""
    spark = rows.sparkSession
    rows = rows.select(*[F.col(f"`{c}`").alias(f"_own_{c}") for c in rows.columns])
    key = [f"_own_{c}" for c in key]
    points = ring(shards, nodes)
    place = F.xxhash64(*key).bitwiseAND(F.lit(_RING - 1))
    placed = rows.withColumn("_place", place).withColumn("_arc", _arc(F.col("_place"), points))
    placed = common.stored(placed, "placed")
    counts = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # an arc each at most
    total = sum(counts.values())
    plan = quotas(counts, points, capacities(total, points, shards, epsilon))
    table = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "_of int, _from long, _to long, shard int, _slot long")
    numbered = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc").orderBy("_place", *key)) - 1)
    found = numbered.join(F.broadcast(table), (F.col("_arc") == F.col("_of")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    own = [F.col(f"`{c}`").alias(c.removeprefix("_own_")) for c in rows.columns if c.lower() not in ("_own_shard", "_own_slot")]
    return found.select(*own, "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"))


def _arc(place: Column, points: list[tuple[int, int]]) -> Column:
    """Nodes before a place, modulo their number. Places are spread evenly, so one of 256 cells of the ring holds a few nodes, which are counted."""
    cells = 256
    width = _RING // cells
    before = [0] * cells
    inside: list[list[int]] = [[] for _ in range(cells)]
    for p, _ in points:
        inside[p // width].append(p)
    for c in range(1, cells):
        before[c] = before[c - 1] + len(inside[c - 1])
    most = max(map(len, inside))
    cell = F.shiftright(place, 52).cast("int")  # _RING / 256 = 2**52
    flat = F.array(*[F.lit(p) for c in inside for p in (*c, *[_RING] * (most - len(c)))])
    hit = sum(((F.element_at(flat, cell * most + k + 1) < place).cast("int") for k in range(most)), F.element_at(F.array(*[F.lit(b) for b in before]), cell + 1))
    return hit % len(points)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 whose counts differ by one at most."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = shard(docs, ["doc_id", "text_crc32", "size"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
