"""Embedded files: signatures, structural checks and compressed data in byte streams, and ratings of candidates."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame

from .decode import entropy, printable
from .scan import PATTERNS, SIGNATURES, custom_flag

#: Bytes that an inflated stream may have; beyond that it is cut, so that a small input cannot fill memory.
MOST = 64 << 20


def find_signatures(data: bytes) -> list[dict]:
    out = []
    for order, (name, head, foot, least) in enumerate(SIGNATURES):
        h, f = bytes.fromhex(head), bytes.fromhex(foot or "")
        for at in (m.start() for m in re.finditer(b"(?=" + re.escape(h) + b")", data)):
            if name == "WAV Audio" and data[at + 8 : at + 12] != b"WAVE":
                continue
            stop = data.find(f, at + len(h)) if f else -1
            end = stop + len(f) if stop >= 0 else None
            if end is None or end - at >= least:
                out.append({"type": name, "offset": at, "end": end, "size": None if end is None else end - at, "confidence": "high" if end else "medium", "order": order})
    return sorted(out, key=lambda s: (s["offset"], s["order"]))


def _zip(d):
    with zipfile.ZipFile(io.BytesIO(d)) as z:
        return bool(z.namelist()) and z.testzip() is None


def _jpeg(d):
    if d[:2] != b"\xff\xd8":
        return False
    at, frame = 2, False
    while at + 4 <= len(d):
        if d[at] != 0xFF:
            return False
        m = d[at + 1]
        if m == 0xD9:
            return frame
        if m in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        n = struct.unpack(">H", d[at + 2 : at + 4])[0]
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        if n < 2:
            return False
        if m == 0xDA:  # entropy-coded data runs to the end mark
            return frame and d.find(b"\xff\xd9", at) >= 0
        at += 2 + n
    return False


def _sqlite(d):
    n = struct.unpack(">H", d[16:18])[0]
    n = 65536 if n == 1 else n
    return len(d) >= 100 and d.startswith(b"SQLite format 3\0") and 512 <= n <= 65536 and n & (n - 1) == 0


def _pe(d):
    at = struct.unpack("<I", d[60:64])[0]
    return d[:2] == b"MZ" and d[at : at + 4] == b"PE\0\0"


def _mp3(d):
    if d[:3] == b"ID3":
        n = sum((b & 127) << (7 * (3 - i)) for i, b in enumerate(d[6:10]))
        return len(d) >= 10 and 10 + n <= len(d)
    return any(d[i] == 0xFF and d[i + 1] & 0xE0 == 0xE0 for i in range(min(4096, len(d)) - 1))


def _inflates(f):
    def check(d):
        return bool(d) and f(d) is not None

    return check


#: Checks by a word of a type's name that they apply to, in this order.
CHECKS = {
    "ZIP": _zip,
    "PNG": lambda d: d.startswith(b"\x89PNG\r\n\x1a\n") and b"IEND" in d and d[12:16] == b"IHDR" and struct.unpack(">I", d[8:12])[0] == 13,
    "JPEG": _jpeg,
    "GIF": lambda d: d[:6] in (b"GIF87a", b"GIF89a") and len(d) >= 13 and d[-1] == 0x3B,
    "PDF": lambda d: d.startswith(b"%PDF-") and b"%%EOF" in d,
    "GZIP": _inflates(gzip.decompress),
    "BZIP2": _inflates(bz2.decompress),
    "7-Zip": lambda d: d.startswith(bytes.fromhex("377ABCAF271C")) and len(d) >= 32,
    "ELF": lambda d: d.startswith(b"\x7fELF") and len(d) >= 52 and d[4] in (1, 2) and d[5] in (1, 2),
    "PE": _pe,
    "SQLite": _sqlite,
    "WAV": lambda d: d[:4] == b"RIFF" and d[8:12] == b"WAVE" and struct.unpack("<I", d[4:8])[0] <= len(d),
    "BMP": lambda d: d[:2] == b"BM" and len(d) >= 14 and struct.unpack("<I", d[2:6])[0] <= 2 * len(d),
    "MP3": _mp3,
    "OGG": lambda d: d[:4] == b"OggS" and len(d) >= 27,
    "RAR": lambda d: d[:7] in (bytes.fromhex("526172211A0700"), bytes.fromhex("526172211A0701")) and len(d) >= 20,
}


def valid(data: bytes, kind: str) -> tuple[bool, str]:
    words = kind.upper().split()
    for word, check in CHECKS.items():
        if word.upper() in words:
            try:
                return (True, f"{word} structure holds") if check(data) else (False, f"{word} structure is broken")
            except Exception as e:  # noqa: BLE001  any failure to parse is the answer
                return False, f"{word}: {type(e).__name__}"
    return False, "no check for this type"


def compressed(data: bytes, most: int = MOST) -> list[dict]:
    """zlib and gzip streams that give 4 bytes or more, cut short or not: offset, size, kind, inflated; the first of those that overlap."""
    found, free = [], 0
    for m in re.finditer(rb"(?=\x78[\x9c\xda\x01]|\x1f\x8b)", data):
        if m.start() < free:
            continue
        kind = "gzip" if data[m.start()] == 0x1F else "zlib"
        z = zlib.decompressobj(31 if kind == "gzip" else 15)
        try:
            out = z.decompress(data[m.start() :], most)
        except zlib.error:
            continue
        if len(out) >= 4:
            size = len(data) - m.start() - len(z.unused_data) - len(z.unconsumed_tail)
            found.append({"offset": m.start(), "size": size, "kind": kind, "inflated": out})
            free = m.start() + size
    return found


_COMPILED = {k: re.compile(p.encode()) for k, p in PATTERNS.items()}


def pattern_hits(data: bytes, flag: str | None = None) -> list[dict]:
    """type, offset, length, value of all patterns, and of flags of one's own name."""
    own = {k: re.compile(p.encode()) for k, p in custom_flag(flag).items()} if flag else {}
    hits = [{"type": k, "offset": m.start(), "length": len(m[0]), "value": m[0].decode("utf-8", "ignore").strip()} for k, p in (_COMPILED | own).items() for m in p.finditer(data)]
    return sorted(hits, key=lambda h: h["offset"])


def score(data: bytes, flag: str | None = None) -> dict:
    """Rating 1 to 5 of a candidate stream, with the reason and what was found. flag: a name of flags beside the known ones."""
    e, p = entropy(data), printable(data)
    base = {"size": len(data), "entropy": e, "printable_ratio": p, "preview_hex": data[:64].hex(" "), "preview_ascii": re.sub(r"[^ -~]", ".", data[:64].decode("latin-1"))}
    if len(data) < 4:
        return base | {"rating": 1, "reason": "too small", "findings": [], "magic_count": 0, "regex_count": 0, "ascii_count": 0, "comp_count": 0}
    hits, magic, packed = pattern_hits(data, flag), find_signatures(data), compressed(data)
    runs = [r.strip() for r in re.findall(rb"[ -~]{6,}", data) if r.strip()]
    counts = {"magic_count": len(magic), "regex_count": len(hits), "ascii_count": len(runs), "comp_count": len(packed)}
    flags = [h for h in hits if h["type"] in ("Flag", "Custom Flag")]
    if flags:
        rating, reason, findings = 5, "flag pattern", [h["value"] for h in flags]
    elif magic:
        first = magic[0]
        ok, why = valid(data[first["offset"] : first["end"]], first["type"])
        rating, reason, findings = ((5 if first["confidence"] == "high" else 4) if ok else 2), why, [f"{m['type']} at {m['offset']}" for m in magic]
    elif packed:
        rating = 5 if any(h["type"] in ("Flag", "Custom Flag") for c in packed for h in pattern_hits(c["inflated"], flag)) else 4
        reason, findings = "compressed data", [f"{c['kind']} at {c['offset']}" for c in packed]
    elif hits:
        rating, reason, findings = 3, "known pattern", [f"{h['type']}: {h['value']}" for h in hits]
    elif sum(map(len, runs)) >= 0.25 * len(data) and len(data) >= 32:
        rating, reason, findings = 3, "mostly text", [r.decode() for r in runs[:3]]
    elif p >= 0.15 and len(data) >= 64:
        rating, reason, findings = 3, "printable", []
    elif runs:
        rating, reason, findings = 2, "text run", [r.decode() for r in runs[:3]]
    elif e >= 7.95:
        rating, reason, findings = 2, "high entropy", []
    else:
        rating, reason, findings = 1, "noise", []
    return base | counts | {"rating": rating, "reason": reason, "findings": findings[:20]}


def passes(data: bytes, flag: str | None = None) -> bool:
    """The cheap test before scanners run."""
    e = entropy(data)
    if len(data) < 4 or e < 0.5:
        return False
    return e >= 7.95 or printable(data[:512]) >= 0.1 or bool(pattern_hits(data[:512], flag))


SCORED = "size long, entropy double, printable_ratio double, preview_hex string, preview_ascii string, magic_count int, regex_count int, ascii_count int, comp_count int, rating int, reason string, findings array<string>"


def scored(streams: DataFrame, keys: list[str], exhaustive: bool = False, flag: str | None = None) -> DataFrame:
    """keys and the fields of score(). Equal contents, which extractors give often, are scored once."""
    from pyspark.sql import functions as F

    hashed = streams.withColumn("_h", F.sha2("data", 256))
    once = hashed.groupBy("_h").agg(F.first("data").alias("data"), F.max(F.lower(F.col(keys[-1]).cast("string")).contains("trailer")).alias("keep"))

    def run(batches):
        for pdf in batches:
            rows = [{"_h": h, **score(bytes(d), flag)} for h, d, k in zip(pdf["_h"], pdf["data"], pdf["keep"]) if exhaustive or k or passes(bytes(d), flag)]
            yield pd.DataFrame(rows, columns=["_h", *[f.split(" ")[0] for f in SCORED.split(", ")]])

    found = once.mapInPandas(run, f"_h string, {SCORED}")
    return hashed.select(*keys, "_h").join(found, "_h").drop("_h")


def carved(streams: DataFrame, key: str = "id") -> DataFrame:
    """key, kind (signature, zlib, gzip), type, offset, size, ok, detail of embedded files."""

    def run(batches):
        for pdf in batches:
            rows = []
            for k, d in zip(pdf[key], pdf["data"]):
                d = bytes(d or b"")
                for s in find_signatures(d):
                    ok, why = valid(d[s["offset"] : s["end"]], s["type"])
                    rows.append((k, "signature", s["type"], s["offset"], s["size"], ok, why))
                rows += [(k, c["kind"], f"{c['kind']} stream", c["offset"], c["size"], True, f"{len(c['inflated'])} bytes") for c in compressed(d)]
            yield pd.DataFrame(rows, columns=[key, "kind", "type", "offset", "size", "ok", "detail"]).astype({"offset": "Int64", "size": "Int64"})

    return streams.select(key, "data").mapInPandas(run, f"{key} long, kind string, type string, offset long, size long, ok boolean, detail string")
