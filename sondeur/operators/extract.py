"""Candidate byte streams from samples, as plain expressions and windows.

Samples are (signal_id, ch, idx, raw). Bits are (signal_id, source, idx, bit),
bytes (signal_id, source, idx, byte). Windows are partitioned by signal and channel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.integers import gray_to_binary, mask, unsigned, wrap

def _by_time():
    return Window.partitionBy("signal_id", "ch").orderBy("idx")



def _source(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("source")


def pack(bits: DataFrame, msb: bool = True, least: int = 0) -> DataFrame:
    """Bytes from bits, eight at a time; a tail is dropped, and so are streams of fewer than `least` bytes."""
    place = F.col("idx") % 8
    weight = F.expr(f"shiftleft(1L, cast({'7 - ' if msb else ''}(idx % 8) as int))")
    out = bits.groupBy("signal_id", "source", F.expr("idx div 8").alias("at")).agg(F.sum(F.col("bit") * weight).cast("int").alias("byte"), F.count(place).alias("_n")).where("_n = 8")
    out = out.select("signal_id", F.concat("source", F.lit("_msb" if msb else "_lsb")).alias("source"), F.col("at").alias("idx"), "byte")
    if least > 1:
        long = out.groupBy("signal_id", "source").count().where(F.col("count") >= least).select("signal_id", "source")
        out = out.join(long, ["signal_id", "source"], "left_semi")
    return out


def to_binary(stream: DataFrame) -> DataFrame:
    """signal_id, source, data."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.lpad(F.hex("byte"), 2, "0").alias("h")))), lambda x: x["h"])
    return stream.groupBy("signal_id", "source").agg(F.unhex(F.array_join(pairs, "")).alias("data"))


def bitplanes(samples: DataFrame, bits: int, planes: Sequence[int] | None = None) -> DataFrame:
    planes = range(min(bits, 16)) if planes is None else planes
    each = samples.select("signal_id", "ch", "idx", "raw", F.explode(F.array(*map(F.lit, planes))).alias("b"))
    return each.select("signal_id", _source("multi_bitplane_ch", F.col("ch"), "_b", F.col("b")), "idx", F.expr(f"cast(shiftright(raw & {(1 << bits) - 1}L, b) & 1L as int)").alias("bit"))


def nibbles(samples: DataFrame, bits: int, low: int = 0, swapped: bool = False) -> DataFrame:
    """Two samples' four bits to a byte, the first sample's high unless swapped."""
    v = F.shiftright(unsigned(F.col("raw"), bits), low).bitwiseAND(F.lit(15))
    first = (F.col("idx") % 2 == 0) != F.lit(swapped)
    out = samples.groupBy("signal_id", "ch", F.expr("idx div 2").alias("at")).agg(F.sum(v * F.when(first, 16).otherwise(1)).cast("int").alias("byte"), F.count("raw").alias("_n")).where("_n = 2")
    return out.select("signal_id", _source("multi_nibble_ch", F.col("ch"), f"_b{low}_{low + 3}_p{2 if swapped else 1}"), F.col("at").alias("idx"), "byte")


def sample_bytes(samples: DataFrame, bits: int, shift: int = 0) -> DataFrame:
    return samples.select("signal_id", _source("multi_byte_ch", F.col("ch"), f"_b{shift}_{shift + 7}"), "idx", F.shiftright(unsigned(F.col("raw"), bits), shift).bitwiseAND(F.lit(255)).cast("int").alias("byte"))


def inverted(samples: DataFrame, bits: int) -> DataFrame:
    return samples.select("signal_id", _source("multi_inverted_byte_ch", F.col("ch")), "idx", F.bitwise_not("raw").bitwiseAND(mask(bits)).bitwiseAND(F.lit(255)).cast("int").alias("byte"))


def combined(samples: DataFrame, how: str) -> DataFrame:
    """Bits of planes 0 to 3 joined by or, xor."""
    low = F.col("raw").bitwiseAND(F.lit(15))
    bit = F.least(low, F.lit(1)) if how == "or" else F.bit_count(low) % 2
    return samples.select("signal_id", _source(f"multi_combined_{how}03_ch", F.col("ch")), "idx", bit.cast("int").alias("bit"))


def sign_bits(samples: DataFrame, bits: int) -> DataFrame:
    return samples.select("signal_id", _source("multi_sign_bit_ch", F.col("ch")), "idx", F.shiftright(unsigned(F.col("raw"), bits), bits - 1).bitwiseAND(F.lit(1)).cast("int").alias("bit"))


def parity(samples: DataFrame, bits: int) -> DataFrame:
    return samples.select("signal_id", _source("parity_ch", F.col("ch")), "idx", (F.bit_count(unsigned(F.col("raw"), bits)) % 2).cast("int").alias("bit"))


def polarity(samples: DataFrame, bits: int) -> DataFrame:
    return samples.select("signal_id", _source("signal_polarity_inv_ch", F.col("ch")), "idx", (-F.col("raw")).bitwiseAND(mask(bits)).bitwiseAND(F.lit(1)).cast("int").alias("bit"))


def value_bytes(values: DataFrame, bits: int, clip: bool = False) -> DataFrame:
    """Little-endian bytes of (signal_id, source, idx, value)."""
    v = F.col("value")
    if clip or bits == 24:
        v = F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), v))
    n = bits // 8
    each = values.select("signal_id", "source", "idx", v.alias("v"), F.explode(F.array(*map(F.lit, range(n)))).alias("k"))
    return each.select("signal_id", "source", (F.col("idx") * n + F.col("k")).alias("idx"), F.expr("cast(shiftright(v, 8 * k) & 255L as int)").alias("byte"))


def layout(samples: DataFrame, name: str) -> DataFrame:
    """(signal_id, source, idx, value) of two channels in one of six orders, or of one channel."""
    idx, ch = F.col("idx"), F.col("ch")
    pair = F.count("raw").over(Window.partitionBy("signal_id", F.expr("idx div 2")))  # both channels of both frames, or an odd tail
    at = {
        "llll": idx, "rrrr": idx, "mono_raw": idx, "lrlr": idx * 2 + ch, "rlrl": idx * 2 + 1 - ch,
        "llrr": F.expr("(idx div 2) * 4 + ch * 2 + idx % 2"), "rrll": F.expr("(idx div 2) * 4 + (1 - ch) * 2 + idx % 2"),
    }[name]
    rows = samples.where(ch == (1 if name == "rrrr" else 0)) if name in ("llll", "rrrr", "mono_raw") else samples.where(ch < 2)
    if name in ("llrr", "rrll"):
        rows = rows.withColumn("_n", pair).where("_n = 4")
    return rows.select("signal_id", F.lit(f"layout_{name}").alias("source"), at.alias("idx"), F.col("raw").alias("value"))


def channel_algebra(samples: DataFrame, bits: int, how: str) -> DataFrame:
    """xor, diff or sum of channels 0 and 1, wrapped to the width (clipped for 24 bits when packed)."""
    both = samples.where("ch < 2").groupBy("signal_id", "idx").agg(F.max(F.when(F.col("ch") == 0, F.col("raw"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("raw"))).alias("r")).where("l is not null and r is not null")
    v = {"xor": F.col("l").bitwiseXOR(F.col("r")), "diff": F.col("l") - F.col("r"), "sum": F.col("l") + F.col("r")}[how]
    return both.select("signal_id", F.lit(f"channel_{how}_0_1").alias("source"), "idx", (v if bits == 24 else wrap(v, bits)).alias("value"))


def consecutive_diff(samples: DataFrame, bits: int) -> DataFrame:
    d = F.col("raw") - F.lag("raw").over(_by_time())
    return samples.select("signal_id", _source("rel_consec_diff_ch", F.col("ch")), (F.col("idx") - 1).alias("idx"), wrap(d, bits).alias("value")).where("value is not null")


def parity_transitions(samples: DataFrame) -> DataFrame:
    bit = F.col("raw").bitwiseXOR(F.lag("raw").over(_by_time())).bitwiseAND(F.lit(1))
    return samples.select("signal_id", _source("rel_parity_trans_ch", F.col("ch")), (F.col("idx") - 1).alias("idx"), bit.cast("int").alias("bit")).where("bit is not null")


def zero_crossings(samples: DataFrame) -> DataFrame:
    bit = (F.col("raw") >= 0) != (F.lag("raw").over(_by_time()) >= 0)
    return samples.select("signal_id", _source("rel_zero_crossings_ch", F.col("ch")), (F.col("idx") - 1).alias("idx"), bit.cast("int").alias("bit")).where("bit is not null")


def centred(samples: DataFrame) -> DataFrame:
    """Samples less their channel's integer mean."""
    mean = samples.groupBy("signal_id", "ch").agg(F.floor(F.avg("raw")).alias("_m"))
    return samples.join(F.broadcast(mean), ["signal_id", "ch"]).withColumn("raw", F.col("raw") - F.col("_m")).drop("_m")


def strided(samples: DataFrame, stride: int, offset: int = 0) -> DataFrame:
    return samples.where((F.col("idx") >= offset) & ((F.col("idx") - offset) % stride == 0)).select("signal_id", _source("stride_samples_ch", F.col("ch"), f"_s{stride}_o{offset}"), F.expr(f"(idx - {offset}) div {stride}").alias("idx"), F.col("raw").alias("value"))


def stride_grid(exhaustive: bool = False) -> list[tuple[int, int]]:
    """(stride, offset): powers of two up to 256, all offsets up to stride 16 (of every stride if exhaustive)."""
    return [(s, o) for s in (1 << k for k in range(9)) for o in (range(s) if s <= 16 or exhaustive else (0,))]


def reversed_values(samples: DataFrame) -> DataFrame:
    last = F.max("idx").over(Window.partitionBy("signal_id", "ch"))
    return samples.select("signal_id", _source("reverse_samples_ch", F.col("ch")), (last - F.col("idx")).alias("idx"), F.col("raw").alias("value"))


def gray_values(samples: DataFrame, bits: int) -> DataFrame:
    return samples.select("signal_id", _source("gray_samples_ch", F.col("ch")), "idx", gray_to_binary(unsigned(F.col("raw"), bits), bits).alias("value"))


BLOCK = 65_536


def delta_values(samples: DataFrame, bits: int) -> DataFrame:
    """Running sums modulo the width: sums within blocks, plus the sum of earlier blocks, so a long signal is not one task's."""
    u = unsigned(F.col("raw"), bits)
    placed = samples.withColumn("_b", F.expr(f"idx div {BLOCK}")).withColumn("_u", u)
    inner = F.sum("_u").over(Window.partitionBy("signal_id", "ch", "_b").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    sums = placed.groupBy("signal_id", "ch", "_b").agg(F.sum("_u").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy("signal_id", "ch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("signal_id").alias("_i"), F.col("ch").alias("_c"), F.col("_b").alias("_k"), before.alias("_before"))
    rows = placed.withColumn("_run", inner)
    rows = rows.join(starts, (rows["signal_id"] == starts["_i"]) & (rows["ch"] == starts["_c"]) & (rows["_b"] == starts["_k"]))
    return rows.select("signal_id", _source("delta_samples_ch", F.col("ch")), "idx", (F.col("_run") + F.col("_before")).bitwiseAND(mask(bits)).alias("value"))


def value_lsb(values: DataFrame) -> DataFrame:
    return values.select("signal_id", "source", "idx", F.col("value").bitwiseAND(F.lit(1)).cast("int").alias("bit"))


# Seeds of the pseudo-noise sequences.
SEEDS = ("1234", "0", "42", "1337", "sparrows", "sparrow")


def noise(spark, seed: str, length: int, words: int = 1 << 20) -> DataFrame:
    """_at, _noise: what random.Random(seed).randint(0, 1) gives, `length` times. The driver walks the generator and keeps its state every `words` outputs; executors make the bits."""
    import random

    import numpy as np
    import pyarrow as pa

    def drawn(key: np.ndarray, pos: int):
        """Bits of the next outputs, and the generator: randint(0, 1) takes two high bits of an output until they are under 2."""
        g = np.random.MT19937()
        g.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
        high = g.random_raw(words) >> np.uint64(30)
        return high[high < 2].astype(np.int32), g.state["state"]

    *key, pos = random.Random(seed).getstate()[1]
    state, at, blocks = {"key": np.array(key, np.uint32), "pos": pos}, 0, []
    while at < length:
        blocks.append((at, bytearray(state["key"].tobytes()), int(state["pos"])))
        bits, state = drawn(state["key"], state["pos"])
        at += len(bits)

    def made(batches):
        for b in batches:
            for first, key, pos in zip(*(b.column(k).to_pylist() for k in ("first", "key", "pos"))):
                bits = drawn(np.frombuffer(key, np.uint32), pos)[0][: length - first]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(bits))), pa.array(bits)], names=["_at", "_noise"])

    return spark.createDataFrame(blocks, "first long, key binary, pos int").mapInArrow(made, "_at long, _noise int")


def despread(samples: DataFrame, seed: str) -> DataFrame:
    """Lowest bits xor a pseudo-noise bit from the seed for each sample of the whole signal."""
    length = (samples.agg(F.max("idx")).first()[0] or 0) + 1
    rows = samples.join(noise(samples.sparkSession, seed, length), F.col("idx") == F.col("_at"))
    return rows.select("signal_id", _source("dsss_ch", F.col("ch"), f"_{seed}"), "idx", F.col("raw").bitwiseAND(F.lit(1)).cast("int").bitwiseXOR(F.col("_noise")).alias("bit"))


def haar(samples: DataFrame, level: int) -> DataFrame:
    """(signal_id, source, idx, coefficient): details of levels 1 to `level` and the last approximation; an odd tail is doubled."""
    now = samples.select("signal_id", "ch", "idx", F.col("raw").cast("double").alias("x"))
    out, root = [], 2.0**0.5
    for k in range(1, level + 1):
        a, b = F.max(F.when(F.col("idx") % 2 == 0, F.col("x"))), F.max(F.when(F.col("idx") % 2 == 1, F.col("x")))
        step = now.groupBy("signal_id", "ch", F.expr("idx div 2").alias("at")).agg(a.alias("a"), F.coalesce(b, a).alias("b"))
        out.append(step.select("signal_id", _source("dwt_ch", F.col("ch"), f"_cD{k}"), F.col("at").alias("idx"), ((F.col("a") - F.col("b")) / root).alias("coefficient")))
        now = step.select("signal_id", "ch", F.col("at").alias("idx"), ((F.col("a") + F.col("b")) / root).alias("x"))
    out.append(now.select("signal_id", _source("dwt_ch", F.col("ch"), f"_cA{level}"), "idx", F.col("x").alias("coefficient")))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found
