"""Audio containers as rows: metadata, chunks, trailer, and samples by channel."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = (
    "file_size long, riff_size long, channels int, sample_rate int, bits_per_sample int, audio_format string, duration_s double, total_samples long, "
    "metadata map<string,string>, chunks array<struct<id:string,size:long,offset:long>>, trailer binary, raw_data binary, samples array<array<long>>, error string"
)


def parse(data: bytes) -> dict:
    """Raises ValueError for what is not a container with a format chunk. Chunks start at even places; one that is cut short reaches to the end."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    riff = struct.unpack("<I", data[4:8])[0]
    chunks, at, last = [], 12, 12
    fmt, body, tags = None, b"", {}
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        part = data[at + 8 : at + 8 + size]
        chunks.append({"id": name.decode("latin-1").strip(), "size": size, "offset": at + 8})
        if name == b"fmt " and len(part) < 16:
            raise ValueError("format chunk is too short")
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", part[:16])
        elif name == b"data":
            body = part
        elif name == b"LIST" and part[:4] == b"INFO":
            tags |= _tags(part)
        at += 8 + size + size % 2
        if at <= riff + 8 + 1:
            last = min(at, len(data))
    start = min(max(last, 12), riff + 8) if riff + 8 < len(data) else len(data)
    code, channels, rate, _, _, bits = fmt or (0, 0, 0, 0, 0, 0)
    samples = decode(body, code, channels, bits)
    n = samples.shape[0]
    return {
        "file_size": len(data), "riff_size": riff, "channels": channels, "sample_rate": rate, "bits_per_sample": bits,
        "audio_format": {1: "PCM", 3: "Float"}.get(code, f"Unknown ({code})"), "duration_s": n / rate if rate else 0.0, "total_samples": n,
        "metadata": tags, "chunks": chunks, "trailer": data[start:], "raw_data": body, "samples": samples,
    }


def _tags(part: bytes) -> dict[str, str]:
    out, at = {}, 4
    while at + 8 <= len(part):
        size = struct.unpack("<I", part[at + 4 : at + 8])[0]
        out[part[at : at + 4].decode("latin-1")] = part[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "ignore")
        at += 8 + size + size % 2
    return out


def decode(body: bytes, code: int, channels: int, bits: int) -> np.ndarray:
    """(frames, channels) longs; 8 bits unsigned, floats scaled to 32 bits. A ragged tail is dropped."""
    width = bits // 8
    if not channels or width not in (1, 2, 3, 4, 8) or code not in (1, 3) or (code == 3) != (code == 3 and width in (4, 8)):
        return np.zeros((0, max(1, channels)), np.int64)
    body = body[: len(body) // (width * channels) * width * channels]
    if code == 3:
        x = np.nan_to_num(np.frombuffer(body, f"<f{width}").astype(float))
        x = np.clip(x * 2.0**31, -(2**31), 2**31 - 1).astype(np.int64)
    elif width == 3:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        x = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = ((x + (1 << 23)) & 0xFFFFFF) - (1 << 23)
    elif width == 8:
        return np.zeros((0, channels), np.int64)
    else:
        x = np.frombuffer(body, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.int64)
    return x.reshape(-1, channels)


def normalised(samples: np.ndarray, bits: int, code: str = "PCM") -> np.ndarray:
    if code == "Float":
        return samples / 2.0**31
    return (samples - 128) / 128.0 if bits == 8 else samples / float(1 << (max(bits, 1) - 1))


def build(samples: np.ndarray, rate: int = 44_100, bits: int = 16, extra: bytes = b"", trailer: bytes = b"") -> bytes:
    """A PCM file of (frames, channels) integers, with further chunks and bytes after the end."""
    width = bits // 8
    flat = np.ascontiguousarray(samples).astype("<i8").ravel()
    body = flat.astype(np.uint8).tobytes() if bits == 8 else b"".join(int(v & ((1 << bits) - 1)).to_bytes(width, "little") for v in flat) if bits == 24 else flat.astype(f"<i{width}").tobytes()
    ch = samples.shape[1]
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, ch, rate, rate * ch * width, ch * width, bits)
    inner = b"WAVE" + fmt + extra + struct.pack("<4sI", b"data", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(inner)) + inner + trailer


def files(binary: DataFrame, key: str = "path", samples: bool = True) -> DataFrame:
    """key and META of (key, content). A file that can't be read has its error and nothing else. samples: whether to give raw_data and samples too, or nulls."""
    names = [f.split(" ")[0] for f in META.replace("struct<id:string,size:long,offset:long>", "x").split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for k, d in zip(pdf[key], pdf["content"]):
                try:
                    m = parse(bytes(d))
                    rows.append({key: k, **m, "samples": m["samples"].T.tolist() if samples else None, "error": None} | ({} if samples else {"raw_data": None}))
                except Exception as e:  # noqa: BLE001  one bad file is one bad row
                    rows.append(dict.fromkeys(names) | {key: k, "error": f"{type(e).__name__}: {e}"[:200]})
            frame = pd.DataFrame(rows, columns=[key, *names], dtype=object)
            yield frame.astype({c: "Int64" for c in ("file_size", "riff_size", "channels", "sample_rate", "bits_per_sample", "total_samples")})

    return binary.select(key, "content").mapInPandas(run, f"{key} string, {META}")


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return files(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path))


def samples(parsed: DataFrame, key: str = "path") -> DataFrame:
    """signal_id, ch, idx, raw, norm."""
    rows = parsed.where("error is null").select(F.col(key).alias("signal_id"), "bits_per_sample", "audio_format", F.posexplode("samples").alias("ch", "x"))
    rows = rows.select("signal_id", "ch", "bits_per_sample", "audio_format", F.posexplode("x").alias("idx", "raw"))
    norm = F.when(F.col("audio_format") == "Float", F.col("raw") / 2.0**31).when(F.col("bits_per_sample") == 8, (F.col("raw") - 128) / 128.0).otherwise(F.col("raw") / F.pow(F.lit(2.0), F.col("bits_per_sample") - 1))
    return rows.select("signal_id", "ch", F.col("idx").cast("long").alias("idx"), "raw", norm.alias("norm"))
