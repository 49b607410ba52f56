"""SimHash near-duplicates with a vantage-point tree over Hamming distance.

A document's fingerprint has bit i set when more than half of its word
shingles' XXH64 hashes have it. Distinct fingerprints are the tree's points.
Each level of the tree measures the Hamming distance to its vantage point
within one block of bits; the vantage point is the fingerprint of a bounded
sample whose distances to the others differ most. That is a pseudo-metric below the full distance, so
by the triangle inequality two fingerprints at distance d have vantage
distances that differ by at most d, and over disjoint blocks the differences
add up to at most d. The first levels make the shards: each fingerprint is a
member of its own shard, and a query in those shards (each pair of shards once)
that its bounds still allow. Within a shard further levels prune before the
exact comparison. Links found become a forest per shard at once, so a dense
group of k fingerprints gives k - 1 edges and never k * k pairs.

dedup() links texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 at least. Candidates are pairs whose fingerprints of these shingles the
tree links, and, as such texts lie up to some 14 bits apart, an exact way for
the rest: sets that are so alike share one of the rarest fifth of their shingles
(in any one order of all shingles). All sets that have such a shingle meet under
one of them, its centre; the shingles of a group of near copies have few
centres, so two sets meet a few times and not once a shingle. Candidates are
sifted by parities of counts of shingles, whose difference is never more than
that of the sets, and what is left is compared whole, by 32 bits a shingle: of
two sets of a thousand, one shingle in four thousand pairs is taken for another's.
Whole sets are made from the texts again, for those that are compared alone.

Defined results: a null text, an empty one and one of white space alone have
fingerprint zero, linked like any other. Repeated rows give repeated result
rows. A null doc_id is ignored when the smallest is sought; a component of
null ids alone has a null component_id. An empty table gives an empty result.
Only doc_id and text are read, so clashing or extra columns do no harm; dedup()
keeps all columns of the rows that stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Fingerprints that vantage points are chosen from, and by.
SAMPLE = 1_000
#: Members that a shard should hold on average, from which the number of levels that make shards follows.
SHARD_MEMBERS = 20_000
#: Similarity (a fraction) from which sets of shingles are near copies for dedup(), and buckets in which it counts shingles.
LIKE, SKETCH = (4, 5), 1 << 20
#: Bits for each text that is looked for, and at most, of the bitmap that finds most other texts not to be meant.
FILTER_BITS, FILTER_MOST = 16, 1 << 27
#: Words of 64 parities for a set of up to PARITY_SHINGLES; larger sets have twice as many for each doubling.
PARITY_WORDS, PARITY_SHINGLES = 8, 800


def hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every shingle of `width` words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(width, len(words)) - 1 :]
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(last))


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * counts > len(h)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the 64 bits as a signed long)."""

    def made(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash(F.col("text")).alias("text_hash")).mapInArrow(made, "doc_id long, text_hash long, fp long")


def _levels(n: int, members: int) -> int:
    """Blocks of bits whose vantage distances make the shards: a level divides a shard by 6 or 7. Eight make about two million, enough for 4e10 fingerprints."""
    k = 1
    while k < 8 and n / 6.5**k > members:
        k += 1
    return k


def _masks(levels: int) -> list[int]:
    """The blocks of bits."""
    cuts = [64 * k // levels for k in range(levels + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def vantage(sample: np.ndarray, masks: list[int]) -> int:
    """The vantage points of all levels as one number: from each block the bits of the point whose distances within it vary most."""
    out = 0
    for mask in masks:
        d = np.bitwise_count((sample[:64, None] ^ sample[None, :]) & np.uint64(mask))
        best = int(sample[int(d.var(axis=1).argmax())]) if len(sample) else 0
        out |= best & mask
    return out


def _shifts(levels: int, radius: int) -> list[tuple[int, ...]]:
    """Moves to the shards that a query visits: differences that add up to `radius` at most, each pair of shards once."""
    out: list[tuple[int, ...]] = [()]
    for _ in range(levels):
        out = [s + (d,) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in out if s > (0,) * levels]


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j in `label`, in place; each set's label is its smallest place."""
    while len(i):
        a, b = label[i], label[j]
        far = a != b
        if not far.any():
            return
        i, j, a, b = i[far], j[far], a[far], b[far]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _search(x: np.ndarray, q: np.ndarray, m: np.ndarray, radius: int, label: np.ndarray, point: int) -> None:
    """Link every pair of a place in q and one in m at a distance up to `radius`: descend both sides of the tree together."""
    block = np.uint64(0xFF)
    shells = np.stack([np.bitwise_count((x ^ np.uint64(point)) & (block << np.uint64(8 * k))) for k in range(8)])
    todo = [(q, m, 0, radius)]
    while todo:
        a, b, level, left = todo.pop()
        if len(a) * len(b) <= 1 << 18 or level == 8:
            step = max(1, (1 << 20) // max(1, len(b)))
            xb = x[b]
            for k in range(0, len(a), step):
                near = np.bitwise_count(x[a[k : k + step], None] ^ xb[None, :]) <= radius
                i, j = np.nonzero(near)
                _hook(label, a[k + i], b[j])
            continue
        sa, sb = shells[level][a], shells[level][b]
        of_b = {int(s): b[sb == s] for s in np.unique(sb)}
        for s in np.unique(sa):
            own = a[sa == s]
            for t, other in of_b.items():
                if (gap := abs(int(s) - t)) <= left:
                    todo.append((own, other, level + 1, left - gap))


def edges(distinct: DataFrame, n: int, radius: int = 3, members: int = SHARD_MEMBERS) -> DataFrame:
    """a, b: a forest over the fp of `distinct` whose trees hold all links within `radius` of each shard and its neighbours."""
    levels = _levels(n, members)
    masks = _masks(levels)
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    point = vantage(sample, masks)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    shell = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(point))).bitwiseAND(F.lit(signed(m)))).cast("long") for m in masks]
    code = lambda move: sum(((shell[k] + move[k] + 8) * 128**k for k in range(levels)), F.lit(0))
    moves = [(0,) * levels, *_shifts(levels, radius)]
    placed = F.explode(F.array(*[F.struct(code(m).cast("long").alias("shard"), F.lit(k > 0).alias("query")) for k, m in enumerate(moves)]))
    sent = distinct.select("fp", placed.alias("at")).select("fp", "at.shard", "at.query")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        query = pdf["query"].to_numpy(bool)
        m, q = np.flatnonzero(~query), np.flatnonzero(query)
        label = np.arange(len(x))
        if len(m):
            _search(x, m, m, radius, label, point)
            if len(q):
                _search(x, q, m, radius, label, point)
        k = np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame({"a": pdf["fp"].to_numpy()[k], "b": pdf["fp"].to_numpy()[label[k]]})

    return sent.groupBy("shard").applyInPandas(linked, "a long, b long")


def components(forest: DataFrame) -> DataFrame:
    """node, root for every node of a, b edges: smallest labels travel along edges, then labels jump to their labels' labels."""
    both = common.stored(forest.select("a", "b").union(forest.select("b", "a")).distinct(), "edges")
    label = common.stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        last = label
        heard = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("heard"))
        nearer = label.join(heard, label["node"] == heard["a"], "left").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        top = nearer.select(F.col("node").alias("r"), F.col("root").alias("above"))
        label = common.stored(nearer.join(top, nearer["root"] == top["r"], "left").select("node", "was", F.least("root", "above").alias("root")), "labels")
        changed = label.where(F.col("was") != F.col("root")).limit(1).count()
        common.freed(last)
        label = common.renamed(label, "node", "root")
        if not changed:
            common.freed(both)
            return label


def named(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Stored prints (doc_id, fp, ...) with component_id, the smallest doc_id that links reach, and root, a fingerprint that stands for the component."""
    distinct = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(edges(distinct.select("fp"), distinct.count(), radius))
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "root", "component_id"), "fp")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return named(common.stored(fingerprints(docs, width), "prints"), radius).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_hash(F.col("text")).alias("text_hash"))


def _commonness(docs: DataFrame, width: int) -> np.ndarray:
    """How often shingles occur, in SKETCH buckets of hashes. Only the order of a set's shingles hangs on it, never which pairs are found."""
    part = SKETCH // 16

    def counted(batches):
        c = np.zeros(SKETCH, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                np.add.at(c, np.unique(hashes(t, width)) & np.uint64(SKETCH - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([c[k * part : (k + 1) * part].tobytes() for k in range(16)], pa.binary())], names=["k", "counts"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.int64)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "counts": [total.tobytes()]})

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(counted, "k int, counts binary").groupBy("k").applyInPandas(added, "k int, counts binary").collect()
    out = np.zeros(SKETCH, np.int64)
    for r in got:
        out[r.k * part : (r.k + 1) * part] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def parities(h: np.ndarray) -> np.ndarray:
    """For each residue of the hashes of a set, whether an odd number have it. Two sets differ in at least as many hashes as bits."""
    bits, most = 64 * PARITY_WORDS, PARITY_SHINGLES
    while len(h) > most:
        bits, most = 2 * bits, 2 * most
    odd = np.bincount(((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _node(h: np.ndarray) -> int:
    """The hash of a set that is given as its shingles' sorted hashes."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def _lists(x: list[np.ndarray], kind: type) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint64), *x]).astype(kind, copy=False)))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set), n (shingles in it), fp (the fingerprint), parity and tokens (the rarest of its shingles, so many that two sets of LIKE share one).
    A task gives the tokens of a set once, so a large group of copies goes no further."""
    shared = docs.sparkSession.sparkContext.broadcast(_commonness(docs, width))  # SKETCH counts

    def made(batches):
        weight, seen = shared.value, set()
        none = np.zeros(0, np.uint64)
        for b in batches:
            node, size, prints, odd, tokens = [], [], [], [], []
            for t in b.column("text").to_pylist():
                every = hashes(t, width)
                h = np.unique(every)
                k, n = _node(h), len(h)
                node.append(k)
                size.append(n)
                if k in seen:
                    prints.append(None)
                    for x in (odd, tokens):
                        x.append(none)
                    continue
                seen.add(k)
                prints.append(majority(every))
                odd.append(parities(h))
                first = n - -(-LIKE[0] * n // LIKE[1]) + 1 if n else 0
                tokens.append(h[np.lexsort((h, weight[(h & np.uint64(SKETCH - 1)).astype(np.int64)]))[:first]])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("text_hash"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(size, np.int32)), pa.array(prints, pa.uint64()).view(pa.int64()),
                    _lists(odd, np.uint64).view(long), _lists(tokens, np.uint64).view(long),
                ],
                names=["doc_id", "text_hash", "node", "n", "fp", "parity", "tokens"],
            )

    return _texts(docs).mapInArrow(made, "doc_id long, text_hash long, node long, n int, fp long, parity array<long>, tokens array<long>")


def _bitmap(hashed: DataFrame) -> np.ndarray:
    """A power of two of bits, as bytes; set are those whose number is the lower part of a text_hash of stored `hashed`."""
    bits = 1 << 15
    while bits < min(FILTER_BITS * hashed.count(), FILTER_MOST):
        bits *= 2
    at = F.col("text_hash").bitwiseAND(F.lit(bits - 1)) + 1  # Spark counts from 1
    parts = hashed.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("set"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) << 12 : r.part << 12] = np.frombuffer(bytes(r.set), np.uint8)
    return out


def _whole_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """node, shingles (their hashes' lower 32 bits) for stored `needed` (node, text_hash of one text that has it), stored.

    Texts are read again, so that sets which are not compared need no place on disk and go nowhere: the bitmap keeps
    most of them from being made, and the join the rest from being kept."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(needed))

    def made(batches):
        flags, seen = shared.value, set()
        most = np.uint64(8 * len(flags) - 1)
        for b in batches:
            at = b.column("text_hash").to_numpy(zero_copy_only=False).view(np.uint64) & most
            meant = flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            node, sets = [], []
            for t in b.column("text").filter(pa.array(meant.astype(bool))).to_pylist():
                h = np.unique(hashes(t, width))
                if len(h) and (k := _node(h)) not in seen:
                    seen.add(k)
                    node.append(k)
                    sets.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), _lists(sets, np.uint32).view(pa.list_(pa.int32()))], names=["node", "shingles"])

    found = _texts(docs).select("text", "text_hash").mapInArrow(made, "node long, shingles array<int>")
    own = common.stored(found.join(needed, "node", "left_semi").dropDuplicates(["node"]), "compared")
    shared.unpersist()
    return own


def linked(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """a, b: pairs of stored nodes (node, fp) by the tree's forest over their fingerprints, each of which one node stands for."""
    stands = common.stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    forest = edges(stands.select("fp"), stands.count(), radius)
    of_a, of_b = (stands.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(k)) for k in "ab")
    apart = forest.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(of_a, "fp_a").join(of_b, "fp_b").select("a", "b")
    same = nodes.join(stands, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = common.stored(apart.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "linked")
    common.freed(stands)
    return found


def _centres(sets: DataFrame) -> DataFrame:
    """k, centre, node: for tokens that several sets have, two of those sets (by two orders, the same for all tokens) and all that have the token."""
    entries = sets.select("node", F.explode("tokens").alias("token")).repartition("token").distinct()  # one shuffle for all steps
    of_token = Window.partitionBy("token")
    first = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("c"))).over(of_token)["c"]
    met = entries.select("node", F.count(F.lit(1)).over(of_token).alias("sets"), F.array(first(0), first(1)).alias("centres")).where("sets > 1")
    return met.select("node", F.posexplode("centres").alias("k", "centre")).select("k", "centre", "node").distinct()


def _may_be_alike(n: Column, x: Column, m: Column, y: Column) -> Column:
    """Whether sets of n and m shingles with parities x and y can reach LIKE: they differ in (1 - LIKE) / (1 + LIKE) * (n + m) shingles at most."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = F.least(n, m).cast("long") * LIKE[1] >= F.greatest(n, m).cast("long") * LIKE[0]
    return near & F.when(F.size(x) == F.size(y), differ.cast("long") * (LIKE[0] + LIKE[1]) <= (n.cast("long") + m) * (LIKE[1] - LIKE[0])).otherwise(True)


def _sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs a, b that may be alike and are not of one root."""
    of_a = nodes.select(F.col("node").alias("a"), F.col("n"), F.col("parity").alias("x"), F.col("root").alias("near"))
    of_b = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"), F.col("root").alias("far"))
    return pairs.join(of_a, "a").join(of_b, "b").where((F.col("near") != F.col("far")) & _may_be_alike(F.col("n"), F.col("x"), F.col("m"), F.col("y"))).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The stored pairs a, b whose sets have Jaccard similarity LIKE at least, stored."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = common.stored(sets.select("node", "text_hash").join(ends, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "needed")
    own = _whole_sets(docs, needed, width)
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    found = common.stored(both.where(same * (LIKE[0] + LIKE[1]) >= (F.size("x") + F.size("y")) * LIKE[0]).select("a", "b"), "links")
    common.freed(own, needed, pairs)
    return found


def _rooted(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """nodes with the root of near (or the node itself), stored."""
    return common.stored(nodes.drop("root").join(near, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")


def alike(sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node, root for nodes of stored sets (of docs) that some chain of pairs of similarity LIKE joins to others; no pair is missed.

    The tree's links, and each set and its centres, are compared first. What that joins needs no more comparing, so a dense
    group of k sets takes some k comparisons; then all pairs under one centre that are still apart are compared."""
    nodes = common.stored(sets.where("fp is not null and n > 0").select("node", "n", "fp", "parity", F.col("node").alias("root")).dropDuplicates(["node"]), "nodes")
    tree, centres = linked(nodes), common.stored(_centres(sets), "centres")
    star = centres.where("centre != node").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    first = _alike(common.stored(_sifted(tree.union(star).distinct(), nodes), "pairs"), sets, docs, width)
    near = components(first)
    rooted = nodes.drop("root").join(near, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = common.stored(centres.where("k = 0").join(rooted, "node").select("centre", "node", "n", "parity", "root"), "placed")
    common.freed(tree, centres, nodes, near)
    other = placed.select("centre", F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("y"), F.col("root").alias("far"))
    apart = (F.col("node") < F.col("b")) & (F.col("root") != F.col("far")) & _may_be_alike(F.col("n"), F.col("parity"), F.col("m"), F.col("y"))
    rest = _alike(common.stored(placed.join(other, "centre").where(apart).select(F.col("node").alias("a"), "b").distinct(), "pairs"), sets, docs, width)
    near = components(first.union(rest))
    common.freed(placed, first, rest)
    return near


def dedup(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs, with all its columns, for each group that chains of pairs of similarity LIKE make: that of the smallest doc_id (null ids come last), then of the smallest hash of its text."""
    sets = common.stored(shingle_sets(docs, width), "shingles")
    near = alike(sets, docs, width)
    found = common.stored(sets.select("doc_id", "text_hash", "node").join(near, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), "found")
    common.freed(sets, near)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = common.stored(found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash")), "keep")
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    common.freed(found)
    own = common.unused(docs.columns, "_hash_of")
    hashed = docs.withColumn(own, _text_hash(docs["text"]))
    kept = hashed.join(keep, hashed["doc_id"].cast("long").eqNullSafe(keep["_id"]) & (hashed[own] == keep["_hash"]), "left_semi")
    # Rows that are repeated whole are of one fingerprint, and one of them stays.
    return (kept.dropDuplicates(["doc_id", own]) if repeated else kept).drop(own)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
