"""Scanners of byte streams (id, data), and ratings from what they find."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bytes as B

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
_INNER = r"[a-zA-Z0-9_\-\.\!\?\#\(\)\@\$\%\^\&\*\s]"
_URL = r"https?://[a-zA-Z0-9./\-_?=&%#@+]+"
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_MD5, _SHA256 = r"\b[a-fA-F0-9]{32}\b", r"\b[a-fA-F0-9]{64}\b"
# Names and patterns, in the order in which they are reported. They work on the Latin-1 view.
PATTERNS = {
    "Flag": rf"(?i)(?:(?:flag|ctf|key|secret|hunt|[a-zA-Z0-9_\-]{{3,15}})\s*\{{{_INNER}+\}}|(?:flag|ctf|key|secret|hunt)\s*[\=:\-]\s*[a-zA-Z0-9_\-\!\?\#\@\$]+)",
    "URL": _URL,
    "Email": _EMAIL,
    "IPv4 Address": _IPV4,
    "Base64 String": r"\b[A-Za-z0-9+/]{16,}={0,2}\b",
    "Hex Hash (MD5)": _MD5,
    "Hex Hash (SHA256)": _SHA256,
}
# Names, patterns and confidences.
INTELLIGENCE = {
    "Specific Flag (CTF/HTB/picoCTF)": (rf"(?i)(?:ctf|htb|picoctf|flag)\s*\{{{_INNER}+\}}", 1.0),
    "Generic Flag Pattern": (rf"\b[a-zA-Z0-9_\-]{{3,15}}\s*\{{{_INNER}{{4,60}}\}}\b", 0.85),
    "JWT Token": (r"\beyJhbGciOi[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*\b", 0.95),
    "RSA/SSH Private Key Block": (r"-----BEGIN [A-Z ]+ PRIVATE KEY-----", 1.0),
    "PEM Certificate Block": (r"-----BEGIN CERTIFICATE-----", 1.0),
    "API Key Candidate": (r'''\b(?:api_key|apikey|secret|token|password)\s*[:=]\s*["']?[A-Za-z0-9\-_]{16,64}["']?\b''', 0.8),
    "URL": (_URL, 0.9),
    "Email Address": (_EMAIL, 0.95),
    "IPv4 Address": (_IPV4, 0.9),
    "IPv6 Address": (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.9),
    "Hex Hash (MD5)": (_MD5, 0.65),
    "Hex Hash (SHA256)": (_SHA256, 0.75),
}
# Name, header, footer, least size. Order settles ties at equal offsets.
SIGNATURES = [
    ("ZIP Archive", "504B0304", "504B0506", 22), ("PNG Image", "89504E470D0A1A0A", "49454E44AE426082", 12), ("JPEG Image", "FFD8FF", "FFD9", 10),
    ("ELF Executable", "7F454C46", None, 64), ("Windows PE Executable", "4D5A", None, 64), ("PDF Document", "255044462D", "2525454F46", 20),
    ("GZIP Archive", "1F8B08", None, 18), ("BZIP2 Archive", "425A68", None, 14), ("7-Zip Archive", "377ABCAF271C", None, 32),
    ("GIF Image", "474946383961", "003B", 14), ("GIF Image (Alt)", "474946383761", "003B", 14), ("RAR Archive", "526172211A0700", None, 20),
    ("RAR Archive (v5)", "526172211A070100", None, 20), ("SQLite Database", "53514C69746520666F726D6174203300", None, 100), ("WAV Audio", "52494646", None, 44),
    ("BMP Image", "424D", None, 54), ("MP3 Audio (ID3)", "494433", None, 10), ("MP3 Audio (MPEG sync)", "FFFB", None, 4), ("OGG Audio", "4F676753", None, 27),
]


#: What a stream must hold for a pattern to match, as a cheap test before it: bytes, or a pattern without look-around.
NEEDED = {
    "Flag": (None, r"(?i)\{|(?:flag|ctf|key|secret|hunt)\s*[=:\-]"), "Specific Flag (CTF/HTB/picoCTF)": ("{", None), "Generic Flag Pattern": ("{", None), "Custom Flag": ("{", None), "URL": ("://", None), "Email": ("@", None), "Email Address": ("@", None),
    "IPv4 Address": (None, r"[0-9]\.[0-9]{1,3}\."), "IPv6 Address": (None, r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"), "JWT Token": ("eyJhbGciOi", None), "RSA/SSH Private Key Block": ("-----BEGIN ", None), "PEM Certificate Block": ("-----BEGIN ", None),
    "API Key Candidate": (None, r"(?i)(?:key|secret|token|password)\s*[:=]"),
}


def finder(patterns: dict[str, str]):
    """A function from bytes to the iterators of matches of each pattern; a pattern runs over streams alone that hold what it needs."""
    made = []
    for name, p in patterns.items():
        word, test = NEEDED.get(name, (None, None))
        made.append((re.compile(p.encode()), word.encode() if word else None, re.compile(test.encode()) if test else None))

    def find(data: bytes):
        return [p.finditer(data) if (word is None or word in data) and (test is None or test.search(data)) else iter(()) for p, word, test in made]

    return find


def matches(streams: DataFrame, patterns: dict[str, str], key: str = "id") -> DataFrame:
    """key, type, hit (from 0, in the stream's order), value (as Latin-1)."""
    names = list(patterns)

    @F.pandas_udf("array<struct<type:string,hit:int,value:string>>")
    def each(data: pd.Series) -> pd.Series:
        find = finder(patterns)
        return pd.Series([[{"type": n, "hit": i, "value": m[0].decode("latin-1")} for n, found in zip(names, find(d or b"")) for i, m in enumerate(found)] for d in data])

    return streams.select(key, F.explode(each("data")).alias("_m")).select(key, "_m.type", "_m.hit", "_m.value")


def match_counts(streams: DataFrame, patterns: dict[str, str], key: str = "id") -> DataFrame:
    return matches(streams, patterns, key).groupBy(key, "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct"))


def custom_flag(name: str) -> dict[str, str]:
    return {"Custom Flag": rf"(?i){re.escape(name)}\s*\{{{_INNER}+\}}"}


def intelligence(streams: DataFrame, key: str = "id", types: tuple[str, ...] | None = None) -> DataFrame:
    """key, type, hit, value, confidence, of all types or some; a hash of fewer than five different characters counts a tenth."""
    m = matches(streams, {k: p for k, (p, _) in INTELLIGENCE.items() if types is None or k in types}, key)
    base = F.element_at(F.create_map(*[x for k, (_, c) in INTELLIGENCE.items() for x in (F.lit(k), F.lit(c))]), F.col("type"))
    dull = F.col("type").isin("Hex Hash (MD5)", "Hex Hash (SHA256)") & (F.size(F.array_distinct(F.split("value", ""))) < 5)
    return m.withColumn("confidence", F.when(dull, base * 0.1).otherwise(base))


def base64_flags(streams: DataFrame, flag: str | None = None, key: str = "id") -> DataFrame:
    """key, value: what Base64 of 40 characters or more decodes to (as Latin-1), where that holds FLAG{ or a name of one's own in capitals."""
    found = F.regexp_extract_all(B.latin1(F.col("data")), F.lit(r"((?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)"), F.lit(1))
    values = streams.select(key, F.explode(found).alias("_b")).select(key, B.latin1(F.unbase64("_b")).alias("value"))
    wanted = F.contains("value", F.lit("FLAG{"))
    return values.where(wanted | F.contains("value", F.lit(flag.upper())) if flag else wanted)


def ascii_runs(streams: DataFrame, least: int = 4, key: str = "id") -> DataFrame:
    """key, hit, offset, text: runs of bytes from space to tilde, stripped, without blank ones; the offset is of the unstripped run."""
    text = B.latin1(F.col("data"))
    # What lies between runs, beside the runs, gives the offsets without a second look for positions.
    run = F.posexplode(F.regexp_extract_all(text, F.lit(rf"[ -~]{{{least},}}"), F.lit(0))).alias("hit", "_run")
    gap = F.split(text, rf"[ -~]{{{least},}}")
    rows = streams.select(key, gap.alias("_gaps"), run)
    lengths = F.aggregate(F.slice("_gaps", 1, F.col("hit") + 1), F.lit(0), lambda a, g: a + F.char_length(g))
    before = F.coalesce(F.sum(F.char_length("_run")).over(Window.partitionBy(key).orderBy("hit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(key, "hit", (lengths + before).cast("long").alias("offset"), F.trim("_run").alias("text")).where("text <> ''")


def printable_text(streams: DataFrame, least: int = 4, key: str = "id") -> DataFrame:
    """key, text: stripped runs one a line, of streams that have any."""
    runs = F.filter(F.transform(F.regexp_extract_all(B.latin1(F.col("data")), F.lit(rf"[ -~]{{{least},}}"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return streams.select(key, F.array_join(runs, "\n").alias("text")).where("text <> ''")


def signatures(streams: DataFrame, key: str = "id") -> DataFrame:
    """key, type, offset, end (null if unknown), size, confidence: file headers, each up to its nearest later footer. Hits whose known size is under the type's least are dropped."""
    text = B.latin1(F.col("data"))
    places = []
    for order, (name, head, foot, least) in enumerate(SIGNATURES):
        places.append(F.struct(F.lit(order).alias("order"), F.lit(name).alias("type"), F.lit(len(head) // 2).alias("head"), F.lit(len(foot or "") // 2).alias("foot"), F.lit(least).alias("least"), find_all(text, head).alias("at"), (find_all(text, foot) if foot else F.lit(None).cast("array<int>")).alias("ends")))
    rows = streams.select(key, "data", F.explode(F.array(*places)).alias("s")).select(key, "data", "s.*")
    rows = rows.select(key, "data", "order", "type", "head", "foot", "least", "ends", F.explode("at").alias("offset"))
    end = F.array_min(F.filter("ends", lambda e: e >= F.col("offset") + F.col("head"))) + F.col("foot")
    rows = rows.withColumn("end", end.cast("long")).withColumn("size", F.col("end") - F.col("offset"))
    rows = rows.where((F.col("type") != "WAV Audio") | (F.substring("data", F.col("offset") + 9, F.lit(4)) == F.encode(F.lit("WAVE"), "UTF-8")))
    rows = rows.where(F.col("size").isNull() | (F.col("size") >= F.col("least")))
    return rows.select(key, "order", "type", F.col("offset").cast("long").alias("offset"), "end", "size", F.when(F.col("end").isNotNull(), "high").otherwise("medium").alias("confidence"))


def find_all(text: Column, needle_hex: str) -> Column:
    """Places of a byte string in a Latin-1 view, overlaps included: lengths of the text before each hit, from a split by look-ahead."""
    pattern = "(?=" + "".join(f"\\x{needle_hex[i : i + 2]}" for i in range(0, len(needle_hex), 2)) + ")"
    parts = F.split(F.concat(F.lit("Ā"), text), pattern)  # a first character that no byte has, so that a hit at 0 splits too
    sizes = F.transform(parts, F.char_length)
    ends = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(n + F.when(F.size(a) > 0, F.get(a, F.size(a) - 1)).otherwise(F.lit(0)))))
    return F.transform(ends, lambda e: e - 1)


_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))


def statistics(d: bytes | None) -> dict:
    """What `profile` says of one stream."""
    d = d or b""
    whole, head = B._histogram(d), B._histogram(d[:65_536])
    n, m = max(1, len(d)), max(1, head.sum())
    chunks = np.frombuffer(d[: min(len(d), 4096) // 4 * 4], "<u4")
    unique = len(np.unique(chunks)) / len(chunks) if len(d) >= 8 else 1.0
    return {"size": len(d), "entropy": float(B._entropies(whole)), "printable_ratio": whole[32:127].sum() / n, "bit_bias": (head @ _ONES) / (8 * m), "peak_ratio": head.max() / m, "unique_ratio": unique}


def profile(streams: DataFrame, key: str = "id") -> DataFrame:
    """key, size, entropy, printable_ratio; bit_bias and peak_ratio of the first 64 KiB; unique_ratio of 4-byte chunks of the first 4 KiB (1 under 8 bytes)."""

    @F.pandas_udf("struct<entropy:double,printable_ratio:double,bit_bias:double,peak_ratio:double,unique_ratio:double>")
    def each(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(d) for d in data], columns=["entropy", "printable_ratio", "bit_bias", "peak_ratio", "unique_ratio"])

    return streams.select(key, F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"), each("data").alias("_p")).select(key, "size", "_p.*")


def rated(streams: DataFrame, key: str = "id", more: bool = False) -> DataFrame:
    """key, size, entropy, printable_ratio, passes (the cheap filter), rating 1 to 5 and reason, from patterns, text runs and entropy, and if asked for regex_count; magic and compression are rated by operators.files.
    One pass: every pattern runs once over a stream, and no rows are shuffled."""
    names = "entropy", "printable_ratio", "_head", "_head_hit", "_flags", "_others", "_runs", "_run_bytes"

    @F.pandas_udf("entropy double, printable_ratio double, _head double, _head_hit boolean, _flags long, _others long, _runs long, _run_bytes long")
    def each(data: pd.Series) -> pd.DataFrame:
        find, run, rows = finder(PATTERNS), re.compile(rb"[ -~]{6,}"), []
        for d in data:
            d = d or b""
            whole, head = B._histogram(d), B._histogram(d[:512])
            counts = [sum(1 for _ in m) for m in find(d)]
            texts = [n for n in (len(m[0].strip(b" ")) for m in run.finditer(d)) if n]
            first = head[32:127].sum() / max(1, head.sum())
            rows.append((float(B._entropies(whole)), whole[32:127].sum() / max(1, len(d)), first, first < 0.1 and any(next(m, None) for m in find(d[:512])), counts[0], sum(counts[1:]), len(texts), sum(texts)))
        return pd.DataFrame(rows, columns=names)

    # As a function that is not deterministic it runs once: else filters on its results would go below, with a second run of it.
    each = each.asNondeterministic()
    out = streams.select(key, F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("size"), each("data").alias("_p")).select(key, "size", "_p.*")
    out = out.withColumns({"_n": F.col("size"), "_flag": F.col("_flags") > 0, "_other": F.col("_others") > 0, "regex_count": F.col("_flags") + F.col("_others")})
    passes = F.when((F.col("_n") < 4) | (F.col("entropy") < 0.5), False).when(F.col("entropy") >= 7.95, True).otherwise((F.col("_head") >= 0.1) | F.col("_head_hit"))
    tiers = [
        (F.col("_n") < 4, 1, "too small"), (F.col("_flag"), 5, "flag pattern"), (F.col("_other"), 3, "known pattern"),
        ((F.col("_run_bytes") >= 0.25 * F.col("_n")) & (F.col("_n") >= 32), 3, "mostly text"), ((F.col("printable_ratio") >= 0.15) & (F.col("_n") >= 64), 3, "printable"),
        (F.col("_runs") > 0, 2, "text run"), (F.col("entropy") >= 7.95, 2, "high entropy"),
    ]
    rating, reason = F.lit(1), F.lit("noise")
    for c, r, why in reversed(tiers):
        rating, reason = F.when(c, r).otherwise(rating), F.when(c, F.lit(why)).otherwise(reason)
    return out.select(key, "size", "entropy", "printable_ratio", passes.alias("passes"), rating.cast("int").alias("rating"), reason.alias("reason"), *["regex_count"] * more)


def ranked(scored: DataFrame, key: str = "id", keep_all: bool = False) -> DataFrame:
    """Rows with a rating over 1 or entropy over 7.5, best first."""
    kept = scored if keep_all else scored.where("passes")
    return kept.where((F.col("rating") > 1) | (F.col("entropy") > 7.5)).orderBy(F.desc("rating"), F.desc(F.round("entropy", 9)), key)
