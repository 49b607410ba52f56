"""Statistics of signals over rows, blocks and runs. Samples have norm (double) beside raw where amplitudes matter."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEY = ["signal_id", "ch"]


def normalised(samples: DataFrame, bits: int = 16) -> DataFrame:
    return samples.withColumn("norm", F.col("raw") / float(1 << (bits - 1)))


def _same(k: int):
    """Rows that a moving sum of length k of the same size covers."""
    return Window.partitionBy(*_KEY).orderBy("idx").rowsBetween(-(k // 2), k - 1 - k // 2)


def rms_envelope(samples: DataFrame, k: int = 100) -> DataFrame:
    """Root of the mean square over k samples, zeros outside; absolute values of signals shorter than k."""
    n = F.count("norm").over(Window.partitionBy(*_KEY))
    out = samples.withColumn("_n", n).withColumn("_s", F.sum(F.col("norm") * F.col("norm")).over(_same(k)))
    return out.select(*_KEY, "idx", F.when(F.col("_n") < k, F.abs("norm")).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_s")) / k)).alias("envelope"))


def rolling_variance(samples: DataFrame, k: int = 1000) -> DataFrame:
    """Mean square less squared mean over k samples, zeros outside, none below 0; zero of signals shorter than k."""
    n = F.count("norm").over(Window.partitionBy(*_KEY))
    s1, s2 = F.sum("norm").over(_same(k)) / k, F.sum(F.col("norm") * F.col("norm")).over(_same(k)) / k
    out = samples.withColumn("_n", n).withColumn("_v", F.greatest(F.lit(0.0), s2 - s1 * s1))
    return out.select(*_KEY, "idx", F.when(F.col("_n") < k, 0.0).otherwise(F.col("_v")).alias("variance"))


def islands(rows: DataFrame, gap: int, place: str = "idx") -> DataFrame:
    """rows with island, a number for each run whose places are at most `gap` apart."""
    w = Window.partitionBy(*_KEY).orderBy(place)
    new = F.when(F.col(place) - F.lag(place).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def variance_anomalies(samples: DataFrame, k: int = 2048, threshold: float = 2.5) -> DataFrame:
    """Runs of samples whose rolling variance lies more than threshold deviations off its mean: start, end (not in it), mean_variance. None in signals shorter than four windows."""
    v = rolling_variance(samples, k)
    stats = v.groupBy(*_KEY).agg(F.avg("variance").alias("_m"), F.stddev_pop("variance").alias("_d"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 4 * k)
    odd = v.join(F.broadcast(stats), _KEY).where((F.col("_d") > 0) & (F.abs(F.col("variance") - F.col("_m")) > threshold * F.col("_d")))
    runs = islands(odd, k).groupBy(*_KEY, "island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"))
    inside = v.join(runs.select("signal_id", "ch", "island", "start", "end"), _KEY).where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    return inside.groupBy(*_KEY, "start", "end").agg(F.avg("variance").alias("mean_variance"))


def levels(samples: DataFrame) -> DataFrame:
    """One row a channel: dc_offset, peak, rms, crest, dynamic_range_db, positive_ratio, n."""
    a = samples.groupBy(*_KEY).agg(F.avg("norm").alias("dc_offset"), F.max(F.abs("norm")).alias("peak"), F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("rms"), F.avg((F.col("norm") >= 0).cast("double")).alias("positive_ratio"), F.count(F.lit(1)).alias("n"))
    sound = (F.col("peak") > 0) & (F.col("rms") > 0)
    return a.select("*", F.when(sound, F.col("peak") / F.col("rms")).otherwise(0.0).alias("crest"), F.when(sound, 20 * F.log10(F.col("peak") / (F.col("rms") + 1e-10))).otherwise(0.0).alias("dynamic_range_db"))


def channel_correlation(samples: DataFrame) -> DataFrame:
    """signal_id, correlation of channels 0 and 1; 0 where one is missing or constant."""
    both = samples.where("ch < 2").groupBy("signal_id", "idx").agg(F.max(F.when(F.col("ch") == 0, F.col("norm"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("norm"))).alias("r"))
    return both.groupBy("signal_id").agg(F.corr("l", "r").alias("c"), F.stddev_pop("l").alias("sl"), F.stddev_pop("r").alias("sr")).select("signal_id", F.when((F.col("sl") > 0) & (F.col("sr") > 0) & ~F.isnan("c"), F.col("c")).otherwise(0.0).alias("correlation"))


def silence(samples: DataFrame, rate: int, threshold_db: float = -45.0, least_s: float = 0.1) -> DataFrame:
    """Runs of quiet 20 ms blocks of at least least_s seconds: start_s, end_s. A run open at the end ends with the signal."""
    size = max(1, int(rate * 0.02))
    n = F.count("norm").over(Window.partitionBy(*_KEY))
    whole = samples.withColumn("_n", n).withColumn("_b", F.expr(f"idx div {size}")).where(F.col("_b") < F.expr(f"_n div {size}"))
    blocks = whole.groupBy(*_KEY, "_b").agg(F.sqrt(F.avg(F.col("norm") * F.col("norm"))).alias("_r"), F.max("_n").alias("_n"))
    quiet = blocks.where(20 * F.log10(F.col("_r") + 1e-10) < threshold_db)
    runs = islands(quiet, 1, "_b").groupBy(*_KEY, "island").agg(F.min("_b").alias("a"), F.max("_b").alias("z"), F.max("_n").alias("_n"))
    end = F.when(F.col("z") + 1 == F.expr(f"_n div {size}"), F.col("_n")).otherwise((F.col("z") + 1) * size)
    out = runs.select(*_KEY, (F.col("a") * size / float(rate)).alias("start_s"), (end / float(rate)).alias("end_s"))
    return out.where(F.col("end_s") - F.col("start_s") >= least_s)


def autocorrelation(samples: DataFrame, lags: int = 512) -> DataFrame:
    """signal_id, ch, lag, r: of demeaned samples, divided by lag 0. Lags shrink to a quarter of signals shorter than twice `lags`."""
    m = samples.groupBy(*_KEY).agg(F.avg("norm").alias("_m"), F.count(F.lit(1)).alias("_n"))
    x = samples.join(F.broadcast(m), _KEY).select(*_KEY, "idx", (F.col("norm") - F.col("_m")).alias("x"), F.when(F.col("_n") < 2 * lags, F.expr("_n div 4")).otherwise(F.lit(lags)).alias("_l"))
    # Each sample meets its `lags` successors by an equi-join on the place they share, not by a range.
    moved = x.select(*_KEY, "x", F.explode(F.sequence(F.lit(0), F.col("_l").cast("int"))).alias("lag"), "idx").select(*_KEY, F.col("x").alias("y"), "lag", (F.col("idx") + F.col("lag")).alias("idx"))
    sums = moved.join(x.select(*_KEY, "idx", "x"), [*_KEY, "idx"]).groupBy(*_KEY, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    zero = sums.where("lag = 0").select(*_KEY, F.col("s").alias("_z"))
    return sums.join(F.broadcast(zero), _KEY).select(*_KEY, "lag", F.when(F.col("_z") > 0, F.col("s") / F.col("_z")).otherwise(0.0).alias("r"))


def crossing_intervals(samples: DataFrame) -> DataFrame:
    """signal_id, ch, at, interval: places where the sign changes and the distance to the one before."""
    w = Window.partitionBy(*_KEY).orderBy("idx")
    at = samples.withColumn("_p", F.lag("norm").over(w)).where(((F.col("norm") >= 0) != (F.col("_p") >= 0)))
    return at.select(*_KEY, F.col("idx").alias("at"), (F.col("idx") - F.lag("idx").over(w)).alias("interval")).where("interval is not null")


def nrz_score(samples: DataFrame) -> DataFrame:
    """Share of crossing intervals near a multiple of their tenth percentile; 0 unless it is over 0.7 of 15 or more crossings."""
    i = crossing_intervals(samples)
    base = i.groupBy(*_KEY).agg(F.expr("percentile(interval, 0.1)").alias("_b"), F.count(F.lit(1)).alias("_n"))
    r = F.col("interval") / F.col("_b")
    s = i.join(F.broadcast(base), _KEY).groupBy(*_KEY).agg(F.avg((F.abs(r - F.rint(r)) < 0.25).cast("double")).alias("share"), F.max("_n").alias("_n"))
    return s.select(*_KEY, "share", F.when((F.col("_n") + 1 >= 15) & (F.col("share") > 0.7), F.col("share")).otherwise(0.0).alias("score"))


def run_lengths(samples: DataFrame, condition) -> DataFrame:
    """signal_id, ch, start, length, on: runs of equal truth of a condition."""
    w = Window.partitionBy(*_KEY).orderBy("idx")
    rows = samples.withColumn("on", condition)
    rows = rows.withColumn("_new", F.when(F.col("on") == F.lag("on").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*_KEY, "_run").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("length"), F.first("on").alias("on")).drop("_run")


def goertzel(samples: DataFrame, rate: int, hz: float, block: int) -> DataFrame:
    """signal_id, ch, block, magnitude of the bin nearest hz in blocks of `block` samples."""
    k = int(0.5 + block * hz / rate)
    angle = F.lit(2 * math.pi * k / block) * (F.col("idx") % block)
    sums = samples.groupBy(*_KEY, F.expr(f"idx div {block}").alias("block")).agg(F.sum(F.col("norm") * F.cos(angle)).alias("c"), F.sum(F.col("norm") * F.sin(angle)).alias("s"), F.count(F.lit(1)).alias("_n"))
    return sums.where(F.col("_n") == block).select(*_KEY, "block", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("magnitude"))


def symbols(samples: DataFrame, rate: int, baud: float) -> DataFrame:
    """Samples with symbol and place in it (at). Symbol i covers [int(i T), int(int(i T) + T)) for T = rate / baud: with a fractional T a sample may be left out."""
    t = rate / baud
    i = F.floor(F.col("idx") / t)
    start = lambda k: F.floor(k * F.lit(t))
    sym = F.when(start(i + 1) <= F.col("idx"), i + 1).otherwise(i)
    n = F.count("norm").over(Window.partitionBy(*_KEY))
    rows = samples.withColumn("symbol", sym).withColumn("_a", start(F.col("symbol"))).withColumn("_n", n)
    return rows.where((F.col("idx") < F.floor(F.col("_a") + t)) & (F.floor(F.col("_a") + t) <= F.col("_n"))).withColumn("at", F.col("idx") - F.col("_a")).drop("_a", "_n")


def tone_energy(of_symbols: DataFrame, rate: int, hz: float):
    """Aggregate: magnitude at hz within each symbol."""
    angle = F.lit(2 * math.pi * hz / rate) * F.col("at")
    c, s = F.sum(F.col("norm") * F.cos(angle)), F.sum(F.col("norm") * F.sin(angle))
    return F.sqrt(c * c + s * s)


def fsk_symbols(samples: DataFrame, rate: int, baud: float, mark: float, space: float) -> DataFrame:
    """signal_id, ch, symbol, mark, space, bit."""
    rows = symbols(samples, rate, baud)
    e = rows.groupBy(*_KEY, "symbol").agg(tone_energy(rows, rate, mark).alias("mark"), tone_energy(rows, rate, space).alias("space"))
    return e.withColumn("bit", (F.col("mark") > F.col("space")).cast("int"))


def manchester_symbols(samples: DataFrame, rate: int, baud: float) -> DataFrame:
    """signal_id, ch, symbol, first, second (means of the halves), bit: 0 where the first half is higher."""
    rows = symbols(samples, rate, baud)
    half = int(rate / baud) // 2
    e = rows.groupBy(*_KEY, "symbol").agg(F.avg(F.when(F.col("at") < half, F.col("norm"))).alias("first"), F.avg(F.when(F.col("at") >= half, F.col("norm"))).alias("second"))
    return e.withColumn("bit", F.when(F.col("first") > F.col("second"), 0).otherwise(1))


def constellation(samples: DataFrame, rate: int, baud: float, carrier: float) -> DataFrame:
    """signal_id, ch, symbol, i, q: means of the samples times the carrier's cosine and negative sine."""
    rows = symbols(samples, rate, baud)
    angle = F.lit(2 * math.pi * carrier / rate) * F.col("idx")
    return rows.groupBy(*_KEY, "symbol").agg(F.avg(F.col("norm") * F.cos(angle)).alias("i"), F.avg(-F.col("norm") * F.sin(angle)).alias("q"))


def dbpsk_symbols(samples: DataFrame, rate: int, baud: float, carrier: float) -> DataFrame:
    """signal_id, ch, symbol, phase, bit: 1 where the phase moves by more than a quarter turn."""
    rows = symbols(samples, rate, baud)
    angle = F.lit(2 * math.pi * carrier / rate) * F.col("at")
    p = rows.groupBy(*_KEY, "symbol").agg(F.atan2(F.sum(-F.col("norm") * F.sin(angle)), F.sum(F.col("norm") * F.cos(angle))).alias("phase"))
    d = F.col("phase") - F.lag("phase").over(Window.partitionBy(*_KEY).orderBy("symbol"))
    turned = F.abs(F.atan2(F.sin(d), F.cos(d)))
    return p.withColumn("_d", turned).where("_d is not null").select(*_KEY, "symbol", "phase", (F.col("_d") > math.pi / 2).cast("int").alias("bit"))


def variations(samples: DataFrame) -> DataFrame:
    """(signal_id, variation, idx, value) of stereo signals: mid, side, diff, average, even, odd, decimated by 2 and 4, reversed."""
    both = samples.where("ch < 2").groupBy("signal_id", "idx").agg(F.max(F.when(F.col("ch") == 0, F.col("norm"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("norm"))).alias("r")).where("l is not null and r is not null")
    l, r, i, root = F.col("l"), F.col("r"), F.col("idx"), 2.0**0.5
    last = F.max("idx").over(Window.partitionBy("signal_id"))
    take = lambda name, at, v, keep=None: F.when(F.lit(True) if keep is None else keep, F.struct(F.lit(name).alias("variation"), at.cast("long").alias("idx"), v.alias("value")))
    mono = (l + r) / 2
    kinds = [take("mid", i, (l + r) / root), take("side", i, (l - r) / root), take("diff", i, l - r), take("average", i, mono), take("left", i, l), take("right", i, r), take("reverse_time", F.col("_last") - i, mono)]
    kinds += [take("even", F.expr("idx div 2"), mono, i % 2 == 0), take("odd", F.expr("idx div 2"), mono, i % 2 == 1), take("decimate_2", F.expr("idx div 2"), mono, i % 2 == 0), take("decimate_4", F.expr("idx div 4"), mono, i % 4 == 0)]
    kinds += [take(f"stride_3_o{o}", F.expr(f"(idx - {o}) div 3"), mono, (i >= o) & ((i - o) % 3 == 0)) for o in range(3)] + [take(f"stride_4_o{o}", F.expr(f"(idx - {o}) div 4"), mono, (i >= o) & ((i - o) % 4 == 0)) for o in range(4)]
    return both.withColumn("_last", last).select("signal_id", F.explode(F.filter(F.array(*kinds), lambda x: x.isNotNull())).alias("v")).select("signal_id", "v.*")
