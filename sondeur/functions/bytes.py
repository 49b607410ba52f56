"""Byte streams as columns: a Latin-1 view has one character a byte, so string functions work on bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters alone, as for byte patterns.
BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def ascii_words(pattern: str) -> str:
    return pattern.replace(r"\b", BOUND)


def printable_ratio(data: Column) -> Column:
    """Share of bytes from space to tilde; 0 of none."""
    n = F.octet_length(data)
    return F.when(n > 0, F.char_length(F.regexp_replace(latin1(data), r"[^ -~]", "")) / n).otherwise(F.lit(0.0))


def _histogram(data: bytes | None) -> np.ndarray:
    return np.bincount(np.frombuffer(data or b"", np.uint8), minlength=256)


def _entropies(counts: np.ndarray) -> np.ndarray:
    """Bits a byte of histograms (one a row); 0 of an empty one."""
    n = counts.sum(-1).astype(float)
    s = (counts * np.log2(np.maximum(counts, 1))).sum(-1)
    return np.where(n > 0, np.log2(np.maximum(n, 1)) - s / np.maximum(n, 1), 0.0) + 0.0


def _windowed(data: bytes | None, window: int, step: int) -> np.ndarray:
    """Entropies of windows wholly inside; data no longer than a window is one. Some windows at a time, so that a long stream takes no more memory than itself."""
    x = np.frombuffer(data or b"", np.uint8)
    if len(x) <= window:
        return _entropies(_histogram(data)[None]) if len(x) else np.zeros(0)
    views = np.lib.stride_tricks.sliding_window_view(x, window)[::step]
    out = []
    for i in range(0, len(views), 1024):
        part = views[i : i + 1024].astype(np.int32) + 256 * np.arange(len(views[i : i + 1024]), dtype=np.int32)[:, None]
        out.append(_entropies(np.bincount(part.ravel(), minlength=256 * len(part)).reshape(-1, 256)))
    return np.concatenate(out)


def entropy_of(data: Column) -> Column:
    """Entropy of a binary column in bits a byte, from a histogram per stream: no row per byte and no shuffle."""

    @F.pandas_udf("double")
    def each(data: pd.Series) -> pd.Series:
        return pd.Series([float(_entropies(_histogram(d))) for d in data], dtype=float)

    return each(data)


def byte_counts(streams: DataFrame, key: str = "id") -> DataFrame:
    """key, byte, n."""

    @F.pandas_udf("array<struct<byte:int,n:long>>")
    def each(data: pd.Series) -> pd.Series:
        found = [(c, np.flatnonzero(c)) for c in map(_histogram, data)]
        return pd.Series([[{"byte": int(b), "n": int(c[b])} for b in at] for c, at in found])

    return streams.select(key, F.explode(each("data")).alias("_c")).select(key, "_c.byte", "_c.n")


def entropy(streams: DataFrame, key: str = "id") -> DataFrame:
    """key, size, entropy in bits a byte (0 of an empty stream)."""
    return streams.select(key, F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"), entropy_of(F.col("data")).alias("entropy"))


def sliding_entropy(streams: DataFrame, window: int = 2048, step: int = 1024, key: str = "id") -> DataFrame:
    """key, win, entropy of windows wholly inside; a stream no longer than a window is one."""

    @F.pandas_udf("array<double>")
    def each(data: pd.Series) -> pd.Series:
        return pd.Series([_windowed(d, window, step) for d in data])

    return streams.select(key, F.posexplode(each("data")).alias("win", "entropy"))


def hex_preview(data: Column, n: int = 64) -> Column:
    return F.regexp_replace(F.lower(F.hex(F.substring(data, 1, n))), r"(..)(?!$)", "$1 ")


def ascii_preview(data: Column, n: int = 64) -> Column:
    return F.regexp_replace(latin1(F.substring(data, 1, n)), r"[^ -~]", ".")


def size_text(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(n >= 1 << k, F.concat(F.format_string("%.2f", F.bround(n / float(1 << k), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def hexdump(streams: DataFrame, limit: int = 128, key: str = "id") -> DataFrame:
    """key, at, hex, text: 16 bytes a row, of the first `limit`."""
    n = F.least(F.octet_length("data"), F.lit(limit))
    rows = streams.where(n > 0).select(key, F.explode(F.sequence(F.lit(0), n - 1, F.lit(16))).alias("at"), "data", n.alias("_n"))
    part = F.substring("data", F.col("at") + 1, F.least(F.lit(16), F.col("_n") - F.col("at")))
    return rows.select(key, "at", hex_preview(part, 16).alias("hex"), ascii_preview(part, 16).alias("text"))


def rotate(text: Column, shift: int) -> Column:
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    k = shift % 26
    return F.translate(text, low + up, low[k:] + low[:k] + up[k:] + up[:k])


def xor_ranks(streams: DataFrame, top: int = 3, key: str = "id") -> DataFrame:
    """key, rank, xor_key, ratio: single-byte keys by the share of printable bytes (with tab and line ends) that they would give. It needs the histogram alone, not the 256 decodings; an empty stream has no rows."""

    @F.pandas_udf("array<struct<rank:int,xor_key:int,ratio:double>>")
    def each(data: pd.Series) -> pd.Series:
        codes = np.arange(256)
        plain = codes[:, None] ^ codes[None, :]
        good = ((plain >= 32) & (plain <= 126) | np.isin(plain, (9, 10, 13))).astype(np.int64)
        out = []
        for d in data:
            ratio = (_histogram(d) @ good) / len(d) if d else np.zeros(0)
            best = np.argsort(-ratio, kind="stable")[:top]
            out.append([{"rank": i + 1, "xor_key": int(k), "ratio": float(ratio[k])} for i, k in enumerate(best)])
        return pd.Series(out)

    return streams.select(key, F.explode(each("data")).alias("_x")).select(key, "_x.rank", "_x.xor_key", "_x.ratio")


def gray_bytes(data: Column) -> Column:
    """Each byte Gray-decoded, by a table of 256 entries made from the rule."""
    table = []
    for b in range(256):
        v = b
        for k in (1, 2, 4):
            v ^= v >> k
        table.append(f"{v:02X}")
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.unhex(F.array_join(F.transform(pairs, lambda h: F.element_at(F.array(*map(F.lit, table)), F.conv(h, 16, 10).cast("int") + 1)), ""))
