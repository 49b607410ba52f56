"""Operators over the driver's tables, and the same rows in SQL."""

from __future__ import annotations

import base64
import html
import math
import urllib.parse
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import decode, extract, files, scan, spectral, windows
from ..sources import tables, wav
from . import analyze

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BITS, RATE = 16, 8000
#: Frames to a file made from the events signal.
FRAMES = 65_536

# --- The adapters in SQL.
_WRAP = "((({0}) + 32768) & 65535) - 32768"
EVENTS = f"sig AS (SELECT 'events' AS signal_id, (event_id % 2)::INT AS ch, event_id // 2 AS idx, {_WRAP.format('round(value * 100)::BIGINT')} AS raw FROM events)"
ORDERS = f"sig AS (SELECT 'orders' AS signal_id, 0 AS ch, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, {_WRAP.format('round(o_totalprice * 100)::BIGINT')} AS raw FROM orders)"
USERS = f"sig AS (SELECT user_id::VARCHAR AS signal_id, 0 AS ch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, {_WRAP.format('round(value * 100)::BIGINT')} AS raw FROM events)"
CENTRED = "c AS (SELECT sig.signal_id, sig.ch, idx, raw - floor(m)::BIGINT AS raw FROM sig JOIN (SELECT signal_id, ch, avg(raw) AS m FROM sig GROUP BY ALL) k ON k.signal_id = sig.signal_id AND k.ch = sig.ch)"
NORM = "n AS (SELECT *, raw / 32768.0::DOUBLE AS norm FROM {0})"
_BYTES = "b AS (SELECT id, unnest(range(octet_length(data))) AS i, data FROM s), h AS (SELECT id, ('0x' || substr(hex(data), 2 * i + 1, 2))::INT AS byte, i FROM b)"


def stream_sql(table: str, key: str, text: str) -> str:
    return f"s AS (SELECT {key} AS id, encode({text}) AS data FROM {table})"


DOCUMENTS, PAGES = stream_sql("documents", "doc_id", "text"), stream_sql("pages", "page_id", "html")
CONVERSATIONS = "s AS (SELECT conv_id * 1000 + turn AS id, encode(text) AS data FROM conversations)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.streams(spark, d, "documents", "doc_id", "text")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return tables.streams(spark, d, "pages", "page_id", "html")


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = tables.spread(tables.read(spark, d, "conversations"))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.encode("text", "UTF-8").alias("data"))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def r4(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to four places, without negative zero."""
    return df.withColumns({c: F.round(F.col(c), 4) + 0.0 for c in cols})


# --- Byte streams.
_ENTROPY = "SELECT id, sum(n)::BIGINT AS size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) + 0.0, 4) + 0.0 AS entropy FROM (SELECT id, byte, count(*) AS n FROM h GROUP BY ALL) GROUP BY id"
for _n, _f, _s in (("documents", docs, DOCUMENTS), ("pages", pages, PAGES)):
    add(f"entropy_{_n}", lambda s, d, f=_f: r4(B.entropy(f(s, d)), "entropy"), f"WITH {_s}, {_BYTES} {_ENTROPY}")
    add(f"printable_ratio_{_n}", lambda s, d, f=_f: f(s, d).select("id", (F.round(B.printable_ratio(F.col("data")), 4) + 0.0).alias("ratio")), f"WITH {_s}, {_BYTES} SELECT id, round(avg((byte BETWEEN 32 AND 126)::INT::DOUBLE), 4) AS ratio FROM h GROUP BY id")
add("byte_histogram", lambda s, d: B.byte_counts(docs(s, d)), f"WITH {DOCUMENTS}, {_BYTES} SELECT id, byte, count(*)::BIGINT AS n FROM h GROUP BY ALL")
for _w, _st in ((2048, 1024), (64, 32)):
    add(f"sliding_entropy_{_w}", lambda s, d, w=_w, st=_st: r4(B.sliding_entropy(docs(s, d), w, st), "entropy"), f"""WITH {DOCUMENTS}, w AS (SELECT id, data, unnest(range(CASE WHEN octet_length(data) <= {_w} THEN 1 ELSE (octet_length(data) - {_w}) // {_st} + 1 END)) AS win FROM s),
        b AS (SELECT id, win, unnest(range(least({_w}, octet_length(data) - win * {_st}))) + win * {_st} AS i, hex(data) AS x FROM w), h AS (SELECT id, win, substr(x, 2 * i + 1, 2) AS byte FROM b)
        SELECT id, win::INT AS win, round(log2(sum(n)) - sum(n * log2(n)) / sum(n) + 0.0, 4) + 0.0 AS entropy FROM (SELECT id, win, byte, count(*) AS n FROM h GROUP BY ALL) GROUP BY ALL""")
add("stream_profile", lambda s, d: r4(scan.profile(docs(s, d)), "entropy", "printable_ratio", "bit_bias", "peak_ratio", "unique_ratio"), f"""WITH {DOCUMENTS}, {_BYTES},
    e AS (SELECT id, sum(n)::BIGINT AS size, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy, sum(n * (byte BETWEEN 32 AND 126)::INT) / sum(n) AS printable_ratio FROM (SELECT id, byte, count(*) AS n FROM h GROUP BY ALL) GROUP BY id),
    k AS (SELECT id, sum(n * bit_count(byte)) / (8 * sum(n)) AS bit_bias, max(n) / sum(n) AS peak_ratio FROM (SELECT id, byte, count(*) AS n FROM h WHERE i < 65536 GROUP BY ALL) GROUP BY id),
    u AS (SELECT id, CASE WHEN octet_length(data) >= 8 THEN len(list_distinct(regexp_extract_all(substr(hex(data), 1, 8192), '.{{8}}'))) / len(regexp_extract_all(substr(hex(data), 1, 8192), '.{{8}}')) ELSE 1.0 END AS unique_ratio FROM s)
    SELECT id, size, round(entropy, 4) + 0.0 AS entropy, round(printable_ratio, 4) AS printable_ratio, round(bit_bias, 4) AS bit_bias, round(peak_ratio, 4) AS peak_ratio, round(unique_ratio, 4) AS unique_ratio FROM e JOIN k USING (id) JOIN u USING (id)""")

# The text itself stands for the Latin-1 view where a pattern holds ASCII characters alone.
_TEXTS = {"documents": ("doc_id", "text", docs), "pages": ("page_id", "html", pages)}
for _t, (_k, _c, _f) in _TEXTS.items():
    for _p in ("Email", "IPv4 Address", "Base64 String"):
        _slug = _p.split()[0].lower()
        _sql = scan.PATTERNS[_p].replace("'", "''")
        add(f"regex_{_slug}_{_t}", lambda s, d, f=_f, p=_p: scan.match_counts(f(s, d), {p: scan.PATTERNS[p]}).select("id", "n", "n_distinct"), f"WITH m AS (SELECT {_k} AS id, unnest(regexp_extract_all({_c}, '{_sql}')) AS v FROM {_t}) SELECT id, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_distinct FROM m GROUP BY id")
_PLANTED = "CASE doc_id % 5 WHEN 0 THEN text || ' flag{planted_' || doc_id || '} ' WHEN 1 THEN text || ' d41d8cd98f00b204e9800998ecf8427e ' WHEN 2 THEN text || ' https://example.org/a?b=' || doc_id ELSE text END"
_planted = lambda s, d: tables.spread(tables.read(s, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.encode(F.expr(_PLANTED), "UTF-8").alias("data"))
for _p in ("Flag", "URL", "Hex Hash (MD5)"):
    _slug = "md5" if "MD5" in _p else _p.lower()
    _sql = scan.PATTERNS[_p].replace("'", "''")
    add(f"regex_{_slug}_planted", lambda s, d, p=_p: scan.match_counts(_planted(s, d), {p: scan.PATTERNS[p]}).select("id", "n", "n_distinct"), f"WITH m AS (SELECT doc_id AS id, unnest(regexp_extract_all({_PLANTED}, '{_sql}')) AS v FROM documents) SELECT id, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_distinct FROM m GROUP BY id")
add("custom_flag", lambda s, d: scan.matches(_planted(s, d), scan.custom_flag("flag")).select("id", "hit", "value"), f"SELECT doc_id AS id, 0 AS hit, 'flag{{planted_' || doc_id || '}}' AS value FROM documents WHERE doc_id % 5 = 0")
_API = scan.INTELLIGENCE["API Key Candidate"][0].replace("'", "''")


def _findings_sql(types) -> str:
    """Rows of type, value and confidence of documents."""
    one = "SELECT '{0}' AS type, {1}::DOUBLE AS c, unnest(regexp_extract_all(text, '{2}')) AS v FROM documents"
    parts = [one.format(k, c, p.replace("0-9-_", "0-9_\\-").replace("'", "''")) for k, (p, c) in scan.INTELLIGENCE.items() if k in types]
    return f"m AS ({' UNION ALL '.join(parts)}), f AS (SELECT type, v, CASE WHEN type LIKE 'Hex Hash%' AND len(list_distinct(string_split(v, ''))) < 5 THEN c * 0.1 ELSE c END AS c FROM m)"


_SOME = ("API Key Candidate", "Email Address", "IPv4 Address")
_COUNTED = "SELECT type, count(*)::BIGINT AS n, round(sum(c)::DOUBLE, 4) AS confidence FROM f GROUP BY type"
_counted = lambda m: m.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))
add("intelligence_counts", lambda s, d: _counted(scan.intelligence(docs(s, d), types=_SOME)), f"WITH {_findings_sql(_SOME)} {_COUNTED}")
add("intelligence_all", lambda s, d: _counted(scan.intelligence(docs(s, d))), f"WITH {_findings_sql(tuple(scan.INTELLIGENCE))} {_COUNTED}")
add("intelligence_planted_md5", lambda s, d: scan.intelligence(_planted(s, d)).where("type = 'Hex Hash (MD5)'").select("id", "value", F.round("confidence", 4).alias("confidence")), "SELECT doc_id AS id, 'd41d8cd98f00b204e9800998ecf8427e' AS value, 0.65::DOUBLE AS confidence FROM documents WHERE doc_id % 5 = 1")
add("ascii_runs", lambda s, d: scan.ascii_runs(docs(s, d), 6).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")), f"WITH {DOCUMENTS}, r AS (SELECT id, unnest(regexp_extract_all(decode(unhex(regexp_replace(hex(data), '([89A-F].)|(..)', '\\1\\2', 'g'))), '[ -~]{{6,}}')) AS t FROM s) SELECT id, count(*)::BIGINT AS n, sum(length(trim(t)))::BIGINT AS chars FROM r WHERE trim(t) <> '' GROUP BY id")
add("ascii_run_offsets", lambda s, d: scan.ascii_runs(pages(s, d), 8), f"""WITH {PAGES}, {_BYTES}, p AS (SELECT id, i, byte, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM h WHERE byte BETWEEN 32 AND 126),
    r AS (SELECT id, min(i) AS "offset", string_agg(chr(byte), '' ORDER BY i) AS t FROM p GROUP BY id, run HAVING count(*) >= 8), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "offset") - 1 AS hit FROM r)
    SELECT id, hit::INT AS hit, "offset"::BIGINT AS "offset", trim(t) AS text FROM k WHERE trim(t) <> ''""")
add("printable_join", lambda s, d: scan.printable_text(docs(s, d), 4).select("id", F.char_length("text").cast("long").alias("chars")), f"WITH {DOCUMENTS}, r AS (SELECT id, list_filter(list_transform(regexp_extract_all(decode(data), '[ -~]{{4,}}'), lambda t: trim(t)), lambda t: t <> '') AS l FROM s) SELECT id, length(array_to_string(l, chr(10)))::BIGINT AS chars FROM r WHERE len(l) > 0")
_HEADS = [(n, h) for n, h, f, _ in scan.SIGNATURES if f is None and len(h) >= 8 and n != "WAV Audio"]
_MAGIC = "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN unhex('{h}')" for i, (_, h) in enumerate(_HEADS[:3])) + " END"
add("magic_hits", lambda s, d: scan.signatures(tables.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.expr(_MAGIC), F.encode("text", "UTF-8")).alias("data"))).where(F.col("type").isin(*[n for n, _ in _HEADS[:3]])).select("id", "type", "offset", "confidence"), "SELECT doc_id AS id, CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_HEADS[:3])) + " END AS type, 0::BIGINT AS \"offset\", 'medium' AS confidence FROM documents")
_PDF = "encode('%PDF-') || encode(text) || encode('%%EOF') || encode(text) || encode('%%EOF')"
add("magic_footer_asof", lambda s, d: scan.signatures(tables.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.concat(F.lit("%PDF-"), "text", F.lit("%%EOF"), "text", F.lit("%%EOF")), "UTF-8").alias("data"))).where("type = 'PDF Document'").select("id", "offset", "end", "size", "confidence"), "SELECT doc_id AS id, 0::BIGINT AS \"offset\", (octet_length(encode(text)) + 10)::BIGINT AS \"end\", (octet_length(encode(text)) + 10)::BIGINT AS size, 'high' AS confidence FROM documents WHERE octet_length(encode(text)) + 10 >= 20")
_FLAG = scan.PATTERNS["Flag"].replace("'", "''")
_OTHERS = "|".join(f"(?:{p})" for k, p in scan.PATTERNS.items() if k != "Flag").replace("'", "''")
_ALL = "|".join(f"(?:{p})" for p in scan.PATTERNS.values()).replace("'", "''")
_RATED = f"""{DOCUMENTS}, {_BYTES}, e AS (SELECT id, sum(n)::BIGINT AS size, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy, sum(n * (byte BETWEEN 32 AND 126)::INT) / sum(n) AS p FROM (SELECT id, byte, count(*) AS n FROM h GROUP BY ALL) GROUP BY id),
    hd AS (SELECT id, avg((byte BETWEEN 32 AND 126)::INT::DOUBLE) AS hp FROM h WHERE i < 512 GROUP BY id),
    f AS (SELECT doc_id AS id, regexp_matches(text, '{_FLAG}') AS flag, regexp_matches(text, '{_OTHERS}') AS other, list_filter(list_transform(regexp_extract_all(text, '[ -~]{{6,}}'), lambda t: trim(t)), lambda t: t <> '') AS runs FROM documents),
    g AS (SELECT e.*, hp, flag, other, len(runs) AS runs, list_sum(list_transform(runs, lambda t: length(t))) AS rb FROM e JOIN hd USING (id) JOIN f USING (id)),
    r AS (SELECT id, size, entropy, p, CASE WHEN size < 4 OR entropy < 0.5 THEN false WHEN entropy >= 7.95 THEN true ELSE hp >= 0.1 END AS passes,
      CASE WHEN size < 4 THEN 1 WHEN flag THEN 5 WHEN other THEN 3 WHEN rb >= 0.25 * size AND size >= 32 THEN 3 WHEN p >= 0.15 AND size >= 64 THEN 3 WHEN runs > 0 THEN 2 WHEN entropy >= 7.95 THEN 2 ELSE 1 END AS rating FROM g)"""
_REASON = "CASE WHEN g.size < 4 THEN 'too small' WHEN flag THEN 'flag pattern' WHEN other THEN 'known pattern' WHEN rb >= 0.25 * g.size AND g.size >= 32 THEN 'mostly text' WHEN g.p >= 0.15 AND g.size >= 64 THEN 'printable' WHEN runs > 0 THEN 'text run' WHEN g.entropy >= 7.95 THEN 'high entropy' ELSE 'noise' END"
_regex_counts = "c AS (SELECT id, sum(n) AS regex_count FROM (" + " UNION ALL ".join("SELECT doc_id AS id, len(regexp_extract_all(text, '" + p.replace("'", "''") + "')) AS n FROM documents" for p in scan.PATTERNS.values()) + ") GROUP BY id)"
add("rating_simple", lambda s, d: scan.rated(docs(s, d)).select("id", "size", "passes", "rating"), f"WITH {_RATED} SELECT id, size, passes, rating::INT AS rating FROM r")
add("rank_kept", lambda s, d: scan.ranked(scan.rated(docs(s, d))).select("id", "rating", (F.round("entropy", 4) + 0.0).alias("entropy")), f"WITH {_RATED} SELECT id, rating::INT AS rating, round(entropy, 4) AS entropy FROM r WHERE passes AND (rating > 1 OR entropy > 7.5)")
add("rating_reasons", lambda s, d: scan.rated(docs(s, d)).groupBy("reason", "rating").agg(F.count(F.lit(1)).alias("n")), f"""WITH {_RATED}, w AS (SELECT rating, {_REASON} AS reason FROM r JOIN g USING (id))
    SELECT reason, rating::INT AS rating, count(*)::BIGINT AS n FROM w GROUP BY ALL""")
add("hex_preview", lambda s, d: docs(s, d).select("id", B.hex_preview(F.col("data"), 16).alias("preview"), B.size_text(F.octet_length("data")).alias("size")), f"WITH {DOCUMENTS} SELECT id, trim(regexp_replace(lower(substr(hex(data), 1, 32)), '(..)', '\\1 ', 'g')) AS preview, CASE WHEN octet_length(data) >= 1024 THEN printf('%.2f KB', octet_length(data) / 1024.0) ELSE octet_length(data) || ' B' END AS size FROM s")
add("ascii_preview", lambda s, d: docs(s, d).select("id", B.ascii_preview(F.col("data"), 64).alias("preview")), f"WITH {DOCUMENTS}, {_BYTES} SELECT id, string_agg(CASE WHEN byte BETWEEN 32 AND 126 THEN chr(byte) ELSE '.' END, '' ORDER BY i) AS preview FROM h WHERE i < 64 GROUP BY id")
add("hexdump", lambda s, d: B.hexdump(docs(s, d)).select("id", "at", "hex"), f"WITH {DOCUMENTS}, r AS (SELECT id, substr(hex(data), 1, 256) AS x FROM s), k AS (SELECT id, x, unnest(range(0, length(x) // 2, 16)) AS a FROM r) SELECT id, a::INT AS at, trim(regexp_replace(lower(substr(x, 2 * a + 1, 32)), '(..)', '\\1 ', 'g')) AS hex FROM k")

# --- Decoders.
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
add("rot13", lambda s, d: tables.read(s, d, "benchmark").select("item_id", B.rotate(F.col("text"), 13).alias("text")), f"SELECT item_id, translate(text, '{_LOW}{_UP}', '{_LOW[13:]}{_LOW[:13]}{_UP[13:]}{_UP[:13]}') AS text FROM benchmark")
add("caesar_all", lambda s, d: tables.read(s, d, "benchmark").select("item_id", F.posexplode(F.array(*[B.rotate(F.col("text"), k) for k in range(1, 26)])).alias("k", "text")).select("item_id", (F.col("k") + 1).alias("shift"), "text"), " UNION ALL ".join(f"SELECT item_id, {k}::INT AS shift, translate(text, '{_LOW}{_UP}', '{_LOW[k:]}{_LOW[:k]}{_UP[k:]}{_UP[:k]}') AS text FROM benchmark" for k in range(1, 26)))
add("xor_key_rank", lambda s, d: r4(B.xor_ranks(turns(s, d)), "ratio"), f"""WITH {CONVERSATIONS}, {_BYTES}, n AS (SELECT id, byte, count(*) AS n FROM h GROUP BY ALL), k AS (SELECT id, k.k AS xor_key, sum(CASE WHEN xor(byte, k.k) BETWEEN 32 AND 126 OR xor(byte, k.k) IN (9, 10, 13) THEN n ELSE 0 END) / sum(n) AS ratio FROM n, (SELECT unnest(range(256))::INT AS k) k GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, xor_key) AS rank FROM k) SELECT id, rank::INT AS rank, xor_key, round(ratio, 4) AS ratio FROM r WHERE rank <= 3""")
add("gray_bytes", lambda s, d: turns(s, d).select("id", F.hex(B.gray_bytes(F.col("data"))).alias("hex")), f"WITH {CONVERSATIONS}, {_BYTES}, g1 AS (SELECT id, i, xor(byte, byte >> 1) AS v FROM h), g2 AS (SELECT id, i, xor(v, v >> 2) AS v FROM g1), g3 AS (SELECT id, i, xor(v, v >> 4) AS v FROM g2) SELECT id, string_agg(lpad(hex(v), 2, '0'), '' ORDER BY i) AS hex FROM g3 GROUP BY id")
add("hex_roundtrip", lambda s, d: turns(s, d).select("id", F.decode(F.unhex(F.hex("data")), "UTF-8").alias("text")), f"WITH {CONVERSATIONS} SELECT id, decode(data) AS text FROM s")
add("base64_roundtrip", lambda s, d: turns(s, d).select("id", F.base64("data").alias("coded")).select("id", F.decode(F.unbase64("coded"), "UTF-8").alias("text")), f"WITH {CONVERSATIONS} SELECT id, decode(from_base64(to_base64(data))) AS text FROM s")


def _decoded(coded, back) -> Callable[[SparkSession, str], DataFrame]:
    """id, text of turns that are coded and decoded by this library's decoders, in one Arrow pass."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        @F.pandas_udf("binary")
        def both(data: pd.Series) -> pd.Series:
            return pd.Series([back(coded(bytes(x))) if x else b"" for x in data])

        return turns(spark, d).where("data is not null").select("id", F.decode(both("data"), "UTF-8").alias("text"))

    return run


def _base58(data: bytes) -> bytes:
    n, out = int.from_bytes(b"\1" + data, "big"), bytearray()
    while n:
        n, k = divmod(n, 58)
        out.append(decode._B58[k])
    return bytes(out[::-1])


_KEY = b"secret"
_CODED = {
    "base64": (base64.b64encode, decode.from_base64), "base32": (base64.b32encode, decode.from_base32), "hex": (lambda x: x.hex().encode(), decode.from_hex), "base85": (base64.b85encode, decode.from_base85),
    "base58": (_base58, lambda x: decode.from_base58(x)[1:]), "url": (lambda x: urllib.parse.quote_from_bytes(x).encode(), decode.from_url), "html": (lambda x: html.escape(x.decode()).encode(), decode.from_html),
    "xor": (lambda x: decode.xor(x, b"\x5a"), lambda x: decode.xor(x, b"\x5a")), "vigenere": (lambda x: bytes(b ^ _KEY[i % 6] for i, b in enumerate(x)), lambda x: decode.xor(x, _KEY)), "rc4": (lambda x: decode.rc4(x, _KEY), lambda x: decode.rc4(x, _KEY)),
    "gray": (lambda x: bytes(b ^ b >> 1 for b in x), decode.from_gray), "rot": (lambda x: decode.rotate(x, 7), lambda x: decode.rotate(x, 19)),
}
for _n, (_a, _b) in _CODED.items():
    add(f"decode_{_n}", _decoded(_a, _b), f"WITH {CONVERSATIONS} SELECT id, decode(data) AS text FROM s WHERE data IS NOT NULL")
add("decode_recursive", lambda s, d: decode.decoded(tables.streams(s, d, "benchmark", "item_id", "text"), 1).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth")))
add("embedded_files", lambda s, d: files.carved(tables.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.encode(F.concat(F.lit("%PDF-"), "text", F.lit("%%EOF")), "UTF-8").alias("data"))).groupBy("kind", "type", "ok").agg(F.count(F.lit(1)).alias("n")))
add("scored_candidates", lambda s, d: files.scored(docs(s, d).withColumn("source", F.concat(F.lit("documents:"), F.col("id").cast("string"))), ["id", "source"]).select("id", "source", "rating", "reason", "regex_count", "ascii_count"))

# --- Bits and values of signals.
_PACK = "SELECT signal_id, source || '_msb' AS source, idx // 8 AS idx, sum(bit * (128 >> (idx % 8)::INT))::INT AS byte FROM bits GROUP BY signal_id, source, idx // 8 HAVING count(*) = 8"
_ev, _or = tables.sig_events, tables.sig_orders


def _bits(name: str, spark_bits, sig: str, adapter, bit: str, source: str, where: str = "true", idx: str = "idx") -> None:
    add(name, lambda s, d: extract.pack(spark_bits(adapter(s, d))), f"WITH {sig}, bits AS (SELECT signal_id, {source} AS source, {idx} AS idx, ({bit})::INT AS bit FROM sig WHERE {where}) {_PACK}")


for _b in (0, 3, 9):
    _bits(f"bitplane_b{_b}", lambda x, b=_b: extract.bitplanes(x, BITS, [b]), EVENTS, _ev, f"((raw & 65535) >> {_b}) & 1", f"'multi_bitplane_ch' || ch || '_b{_b}'")
add("bitplanes_all", lambda s, d: extract.pack(extract.bitplanes(_or(s, d), BITS)), f"WITH {ORDERS}, bits AS (SELECT signal_id, 'multi_bitplane_ch0_b' || b AS source, idx, (((raw & 65535) >> b) & 1)::INT AS bit FROM sig, (SELECT unnest(range(16))::INT AS b)) {_PACK}")
add("bitplane_lsb_order", lambda s, d: extract.pack(extract.bitplanes(_or(s, d), BITS, [0]), msb=False), f"WITH {ORDERS} SELECT signal_id, 'multi_bitplane_ch0_b0_lsb' AS source, idx // 8 AS idx, sum((raw & 1) * (1 << (idx % 8)::INT))::INT AS byte FROM sig GROUP BY signal_id, idx // 8 HAVING count(*) = 8")
_bits("combine_or", lambda x: extract.combined(x, "or"), EVENTS, _ev, "(raw & 15) > 0", "'multi_combined_or03_ch' || ch")
_bits("combine_xor", lambda x: extract.combined(x, "xor"), EVENTS, _ev, "bit_count(raw & 15) % 2", "'multi_combined_xor03_ch' || ch")
_bits("sign_bit", lambda x: extract.sign_bits(x, BITS), EVENTS, _ev, "((raw & 65535) >> 15) & 1", "'multi_sign_bit_ch' || ch")
_bits("parity", lambda x: extract.parity(x, BITS), EVENTS, _ev, "bit_count(raw & 65535) % 2", "'parity_ch' || ch")
_bits("polarity_lsb", lambda x: extract.polarity(x, BITS), EVENTS, _ev, "(-raw) & 1", "'signal_polarity_inv_ch' || ch")
for _lo in (0, 4):
    for _sw in (False, True):
        _v = f"(((raw & 65535) >> {_lo}) & 15)"
        add(f"nibbles_b{_lo}_p{2 if _sw else 1}", lambda s, d, lo=_lo, sw=_sw: extract.nibbles(_ev(s, d), BITS, lo, sw), f"WITH {EVENTS} SELECT signal_id, 'multi_nibble_ch' || ch || '_b{_lo}_{_lo + 3}_p{2 if _sw else 1}' AS source, idx // 2 AS idx, sum({_v} * CASE WHEN idx % 2 = {1 if _sw else 0} THEN 16 ELSE 1 END)::INT AS byte FROM sig GROUP BY signal_id, ch, idx // 2 HAVING count(*) = 2")
for _sh, _nm in ((0, "lo"), (8, "hi")):
    add(f"bytes_{_nm}", lambda s, d, sh=_sh: extract.sample_bytes(_ev(s, d), BITS, sh), f"WITH {EVENTS} SELECT signal_id, 'multi_byte_ch' || ch || '_b{_sh}_{_sh + 7}' AS source, idx, (((raw & 65535) >> {_sh}) & 255)::INT AS byte FROM sig")
add("invert", lambda s, d: extract.inverted(_ev(s, d), BITS), f"WITH {EVENTS} SELECT signal_id, 'multi_inverted_byte_ch' || ch AS source, idx, ((~raw) & 255)::INT AS byte FROM sig")
_LAYOUTS = {"llll": ("idx", "ch = 0"), "rrrr": ("idx", "ch = 1"), "lrlr": ("idx * 2 + ch", "true"), "rlrl": ("idx * 2 + 1 - ch", "true"), "llrr": ("(idx // 2) * 4 + ch * 2 + idx % 2", "pair = 4"), "rrll": ("(idx // 2) * 4 + (1 - ch) * 2 + idx % 2", "pair = 4")}
for _l, (_at, _wh) in _LAYOUTS.items():
    add(f"layout_{_l}", lambda s, d, n=_l: extract.layout(_ev(s, d), n), f"WITH {EVENTS}, p AS (SELECT *, count(*) OVER (PARTITION BY idx // 2) AS pair FROM sig) SELECT signal_id, 'layout_{_l}' AS source, ({_at})::BIGINT AS idx, raw AS value FROM p WHERE {_wh}")
_LR = "lr AS (SELECT l.signal_id, l.idx, l.raw AS l, r.raw AS r FROM sig l JOIN sig r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1)"
for _h, _e in (("xor", "xor(l, r)"), ("diff", "l - r"), ("sum", "l + r")):
    add(f"channel_{_h}", lambda s, d, h=_h: extract.channel_algebra(_ev(s, d), BITS, h), f"WITH {EVENTS}, {_LR} SELECT signal_id, 'channel_{_h}_0_1' AS source, idx, {_WRAP.format(_e)} AS value FROM lr")
_LAG = "lag(raw) OVER (PARTITION BY signal_id, ch ORDER BY idx)"
add("consec_diff", lambda s, d: extract.consecutive_diff(_ev(s, d), BITS), f"WITH {EVENTS}, k AS (SELECT *, {_LAG} AS p FROM sig) SELECT signal_id, 'rel_consec_diff_ch' || ch AS source, idx - 1 AS idx, {_WRAP.format('raw - p')} AS value FROM k WHERE p IS NOT NULL")
add("parity_transitions", lambda s, d: extract.pack(extract.parity_transitions(_ev(s, d))), f"WITH {EVENTS}, k AS (SELECT *, {_LAG} AS p FROM sig), bits AS (SELECT signal_id, 'rel_parity_trans_ch' || ch AS source, idx - 1 AS idx, (xor(raw, p) & 1)::INT AS bit FROM k WHERE p IS NOT NULL) {_PACK}")
add("zero_crossings", lambda s, d: extract.pack(extract.zero_crossings(extract.centred(_ev(s, d)))), f"WITH {EVENTS}, {CENTRED}, k AS (SELECT *, {_LAG} AS p FROM c), bits AS (SELECT signal_id, 'rel_zero_crossings_ch' || ch AS source, idx - 1 AS idx, ((raw >= 0) <> (p >= 0))::INT AS bit FROM k WHERE p IS NOT NULL) {_PACK}")
for _st, _o in ((4, 1), (16, 5), (256, 0)):
    add(f"stride_s{_st}_o{_o}", lambda s, d, st=_st, o=_o: extract.strided(_or(s, d), st, o), f"WITH {ORDERS} SELECT signal_id, 'stride_samples_ch0_s{_st}_o{_o}' AS source, (idx - {_o}) // {_st} AS idx, raw AS value FROM sig WHERE idx >= {_o} AND (idx - {_o}) % {_st} = 0")
add("stride_bits", lambda s, d: extract.pack(extract.value_lsb(extract.strided(_or(s, d), 2, 1))), f"WITH {ORDERS}, bits AS (SELECT signal_id, 'stride_samples_ch0_s2_o1' AS source, (idx - 1) // 2 AS idx, (raw & 1)::INT AS bit FROM sig WHERE idx >= 1 AND (idx - 1) % 2 = 0) {_PACK}")
add("reverse_samples", lambda s, d: extract.reversed_values(_or(s, d)), f"WITH {ORDERS} SELECT signal_id, 'reverse_samples_ch0' AS source, (SELECT max(idx) FROM sig) - idx AS idx, raw AS value FROM sig")
add("reverse_lsb", lambda s, d: extract.pack(extract.value_lsb(extract.reversed_values(_or(s, d)))), f"WITH {ORDERS}, bits AS (SELECT signal_id, 'reverse_samples_ch0' AS source, (SELECT max(idx) FROM sig) - idx AS idx, (raw & 1)::INT AS bit FROM sig) {_PACK}")
_GRAY = "g1 AS (SELECT *, xor(raw & 65535, (raw & 65535) >> 1) AS v FROM sig), g2 AS (SELECT signal_id, ch, idx, xor(v, v >> 2) AS v FROM g1), g3 AS (SELECT signal_id, ch, idx, xor(v, v >> 4) AS v FROM g2), g AS (SELECT signal_id, ch, idx, xor(v, v >> 8) AS v FROM g3)"
add("gray_samples", lambda s, d: extract.gray_values(_or(s, d), BITS), f"WITH {ORDERS}, {_GRAY} SELECT signal_id, 'gray_samples_ch0' AS source, idx, v AS value FROM g")
add("gray_lsb", lambda s, d: extract.pack(extract.value_lsb(extract.gray_values(_or(s, d), BITS))), f"WITH {ORDERS}, {_GRAY}, bits AS (SELECT signal_id, 'gray_samples_ch0' AS source, idx, (v & 1)::INT AS bit FROM g) {_PACK}")
_DELTA = "dl AS (SELECT signal_id, idx, (sum(raw & 65535) OVER (ORDER BY idx))::BIGINT & 65535 AS v FROM sig)"
add("delta_samples", lambda s, d: extract.delta_values(_or(s, d), BITS), f"WITH {ORDERS}, {_DELTA} SELECT signal_id, 'delta_samples_ch0' AS source, idx, v AS value FROM dl")
add("delta_lsb", lambda s, d: extract.pack(extract.value_lsb(extract.delta_values(_or(s, d), BITS))), f"WITH {ORDERS}, {_DELTA}, bits AS (SELECT signal_id, 'delta_samples_ch0' AS source, idx, (v & 1)::INT AS bit FROM dl) {_PACK}")
add("sample_packing", lambda s, d: extract.value_bytes(extract.strided(_or(s, d), 1), BITS), f"WITH {ORDERS} SELECT signal_id, 'stride_samples_ch0_s1_o0' AS source, idx * 2 + k AS idx, (((raw & 65535) >> (8 * k)) & 255)::INT AS byte FROM sig, (SELECT unnest(range(2))::INT AS k)")
add("dsss_despread", lambda s, d: extract.pack(extract.despread(_or(s, d), "42")))
for _lv in (1, 3, 8):
    _h, _prev, _parts = [], "sig", []
    for _k in range(1, _lv + 1):
        _x = "raw::DOUBLE" if _k == 1 else "x"
        _h.append(f"p{_k} AS (SELECT idx // 2 AS idx, max(CASE WHEN idx % 2 = 0 THEN {_x} END) AS a, coalesce(max(CASE WHEN idx % 2 = 1 THEN {_x} END), max(CASE WHEN idx % 2 = 0 THEN {_x} END)) AS b FROM {_prev} GROUP BY idx // 2), a{_k} AS (SELECT idx, (a + b) / sqrt(2) AS x FROM p{_k})")
        _parts.append(f"SELECT 'orders' AS signal_id, 'dwt_ch0_cD{_k}' AS source, idx, round((a - b) / sqrt(2), 3) + 0.0 AS coefficient FROM p{_k}")
        _prev = f"a{_k}"
    _parts.append(f"SELECT 'orders', 'dwt_ch0_cA{_lv}', idx, round(x, 3) + 0.0 FROM a{_lv}")
    add(f"haar_dwt_l{_lv}", lambda s, d, n=_lv: extract.haar(_or(s, d), n).withColumn("coefficient", F.round("coefficient", 3) + 0.0), f"WITH {ORDERS}, {', '.join(_h)} {' UNION ALL '.join(_parts)}")

# --- Statistics and demodulation.
_nev = lambda s, d: windows.normalised(extract.centred(_ev(s, d)))
_nor = lambda s, d: windows.normalised(extract.centred(_or(s, d)))
_NEV, _NOR = f"{EVENTS}, {CENTRED}, {NORM.format('c')}", f"{ORDERS}, {CENTRED}, {NORM.format('c')}"
_FRAME = "OVER (PARTITION BY signal_id, ch ORDER BY idx ROWS BETWEEN {0} PRECEDING AND {1} FOLLOWING)"
add("rms_envelope", lambda s, d: r4(windows.rms_envelope(_nev(s, d), 100), "envelope"), f"WITH {_NEV} SELECT signal_id, ch, idx, round(sqrt(greatest(0.0, sum(norm * norm) {_FRAME.format(50, 49)}) / 100), 4) AS envelope FROM n")
_VAR = f"v AS (SELECT signal_id, ch, idx, greatest(0.0, sum(norm * norm) {_FRAME.format(500, 499)} / 1000 - pow(sum(norm) {_FRAME.format(500, 499)} / 1000, 2)) AS variance, count(*) OVER (PARTITION BY signal_id, ch) AS k FROM n)"
add("rolling_variance", lambda s, d: r4(windows.rolling_variance(_nev(s, d), 1000), "variance"), f"WITH {_NEV}, {_VAR} SELECT signal_id, ch, idx, CASE WHEN k < 1000 THEN 0.0 ELSE round(variance, 4) END AS variance FROM v")
add("variance_anomalies", lambda s, d: windows.variance_anomalies(_nev(s, d), 256, 2.0).select("signal_id", "ch", "start", "end", F.round("mean_variance", 4).alias("mean_variance")), f"""WITH {_NEV}, v AS (SELECT signal_id, ch, idx, greatest(0.0, sum(norm * norm) {_FRAME.format(128, 127)} / 256 - pow(sum(norm) {_FRAME.format(128, 127)} / 256, 2)) AS variance FROM n),
    t AS (SELECT signal_id, ch, avg(variance) AS m, stddev_pop(variance) AS sd, count(*) AS k FROM v GROUP BY ALL), o AS (SELECT v.* FROM v JOIN t ON t.signal_id = v.signal_id AND t.ch = v.ch WHERE k >= 1024 AND sd > 0 AND abs(variance - m) > 2.0 * sd),
    g AS (SELECT *, sum(CASE WHEN idx - p <= 256 THEN 0 ELSE 1 END) OVER (PARTITION BY signal_id, ch ORDER BY idx) AS island FROM (SELECT *, lag(idx) OVER (PARTITION BY signal_id, ch ORDER BY idx) AS p FROM o)),
    r AS (SELECT signal_id, ch, min(idx) AS "start", max(idx) AS "end" FROM g GROUP BY signal_id, ch, island) SELECT r.signal_id, r.ch, "start", "end", round(avg(variance), 4) AS mean_variance FROM r JOIN v ON v.signal_id = r.signal_id AND v.ch = r.ch AND v.idx >= "start" AND v.idx < "end" GROUP BY ALL""")
_LEVELS = "SELECT signal_id, ch, round(avg(norm), 6) + 0.0 AS dc_offset, round(max(abs(norm)), 6) AS peak, round(sqrt(avg(norm * norm)), 6) AS rms, round(avg((norm >= 0)::INT::DOUBLE), 6) AS positive_ratio, count(*)::BIGINT AS n, round(max(abs(norm)) / sqrt(avg(norm * norm)), 4) AS crest, round(20 * log10(max(abs(norm)) / (sqrt(avg(norm * norm)) + 1e-10)), 4) AS dynamic_range_db FROM n GROUP BY ALL"
_r6 = lambda x: x.withColumns({c: F.round(c, 6) + 0.0 for c in ("dc_offset", "peak", "rms", "positive_ratio")} | {c: F.round(c, 4) + 0.0 for c in ("crest", "dynamic_range_db")})
add("levels", lambda s, d: _r6(windows.levels(_nev(s, d))), f"WITH {_NEV} {_LEVELS}")
add("channel_corr", lambda s, d: r4(windows.channel_correlation(_nev(s, d)), "correlation"), f"WITH {_NEV}, lr AS (SELECT l.norm AS l, r.norm AS r FROM n l JOIN n r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1) SELECT 'events' AS signal_id, round(corr(l, r), 4) + 0.0 AS correlation FROM lr")
add("silence_segments", lambda s, d: windows.silence(windows.normalised(tables.sig_user(s, d)), 100, -20.0, 0.02).select("signal_id", "ch", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s")), f"""WITH {USERS}, {NORM.format('sig')}, k AS (SELECT *, count(*) OVER (PARTITION BY signal_id, ch) AS k FROM n), b AS (SELECT signal_id, ch, idx // 2 AS b, sqrt(avg(norm * norm)) AS r, max(k) AS k FROM k WHERE idx // 2 < k // 2 GROUP BY ALL),
    q AS (SELECT *, b - row_number() OVER (PARTITION BY signal_id, ch ORDER BY b) AS island FROM b WHERE 20 * log10(r + 1e-10) < -20.0), r AS (SELECT signal_id, ch, min(b) AS a, max(b) AS z, max(k) AS k FROM q GROUP BY signal_id, ch, island),
    e AS (SELECT signal_id, ch, a * 2 / 100.0::DOUBLE AS s, CASE WHEN z + 1 = k // 2 THEN k ELSE (z + 1) * 2 END / 100.0::DOUBLE AS e FROM r) SELECT signal_id, ch::INT AS ch, round(s, 4) AS start_s, round(e, 4) AS end_s FROM e WHERE e - s >= 0.02""")
add("autocorrelation", lambda s, d: r4(windows.autocorrelation(windows.normalised(tables.sig_user(s, d)), 16), "r"), f"""WITH {USERS}, {NORM.format('sig')}, m AS (SELECT signal_id, avg(norm) AS m, count(*) AS k FROM n GROUP BY signal_id), x AS (SELECT n.signal_id, idx, norm - m AS x, CASE WHEN k < 32 THEN k // 4 ELSE 16 END AS l FROM n JOIN m ON m.signal_id = n.signal_id),
    p AS (SELECT a.signal_id, b.idx - a.idx AS lag, sum(a.x * b.x) AS s FROM x a JOIN x b ON b.signal_id = a.signal_id AND b.idx BETWEEN a.idx AND a.idx + a.l GROUP BY ALL) SELECT p.signal_id, 0::INT AS ch, p.lag::INT AS lag, round(CASE WHEN z.s > 0 THEN p.s / z.s ELSE 0.0 END, 4) + 0.0 AS r FROM p JOIN p z ON z.signal_id = p.signal_id AND z.lag = 0""")
add("autocorrelation_512", lambda s, d: r4(windows.autocorrelation(windows.normalised(tables.sig_user(s, d))), "r"))
_CROSS = "k AS (SELECT *, lag(norm) OVER (PARTITION BY signal_id, ch ORDER BY idx) AS p FROM n), x AS (SELECT signal_id, ch, idx FROM k WHERE (norm >= 0) <> (p >= 0)), i AS (SELECT *, idx - lag(idx) OVER (PARTITION BY signal_id, ch ORDER BY idx) AS gap FROM x)"
add("crossing_intervals", lambda s, d: windows.crossing_intervals(_nev(s, d)), f"WITH {_NEV}, {_CROSS} SELECT signal_id, ch, idx AS at, gap AS \"interval\" FROM i WHERE gap IS NOT NULL")
add("nrz_score", lambda s, d: r4(windows.nrz_score(_nev(s, d)), "share", "score"), f"WITH {_NEV}, {_CROSS}, g AS (SELECT * FROM i WHERE gap IS NOT NULL), b AS (SELECT signal_id, ch, quantile_cont(gap, 0.1) AS base, count(*) AS k FROM g GROUP BY ALL), s AS (SELECT g.signal_id, g.ch, avg((abs(gap / base - round_even(gap / base, 0)) < 0.25)::INT::DOUBLE) AS share, max(k) AS k FROM g JOIN b ON b.signal_id = g.signal_id AND b.ch = g.ch GROUP BY ALL) SELECT signal_id, ch, round(share, 4) AS share, CASE WHEN k + 1 >= 15 AND share > 0.7 THEN round(share, 4) ELSE 0.0 END AS score FROM s")
add("run_lengths", lambda s, d: windows.run_lengths(_nev(s, d), F.col("norm") > 0), f"WITH {_NEV}, k AS (SELECT *, norm > 0 AS on_, CASE WHEN (norm > 0) = lag(norm > 0) OVER w THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY signal_id, ch ORDER BY idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY signal_id, ch ORDER BY idx) AS run FROM k) SELECT signal_id, ch, min(idx) AS start, count(*)::BIGINT AS length, any_value(on_) AS \"on\" FROM r GROUP BY signal_id, ch, run")
add("goertzel_power", lambda s, d: r4(windows.goertzel(_nor(s, d), RATE, 697, 400), "magnitude"), f"WITH {_NOR} SELECT signal_id, ch, idx // 400 AS block, round(sqrt(pow(sum(norm * cos(2 * pi() * 35 / 400 * (idx % 400))), 2) + pow(sum(norm * sin(2 * pi() * 35 / 400 * (idx % 400))), 2)), 4) AS magnitude FROM n GROUP BY ALL HAVING count(*) = 400")
_SYM = "y AS (SELECT *, CASE WHEN floor((floor(idx / {0}::DOUBLE) + 1) * {0}::DOUBLE) <= idx THEN floor(idx / {0}::DOUBLE) + 1 ELSE floor(idx / {0}::DOUBLE) END::BIGINT AS symbol, count(*) OVER (PARTITION BY signal_id, ch) AS k FROM n), z AS (SELECT *, idx - floor(symbol * {0}::DOUBLE)::BIGINT AS pos FROM y WHERE idx < floor(floor(symbol * {0}::DOUBLE) + {0}::DOUBLE) AND floor(floor(symbol * {0}::DOUBLE) + {0}::DOUBLE) <= k)"
_E = lambda hz: f"sqrt(pow(sum(norm * cos(2 * pi() * {hz} / 8000 * pos)), 2) + pow(sum(norm * sin(2 * pi() * {hz} / 8000 * pos)), 2))"
add("fsk_energies", lambda s, d: r4(windows.fsk_symbols(_nor(s, d), RATE, 300, 1200, 2200).drop("bit"), "mark", "space"), f"WITH {_NOR}, {_SYM.format(RATE / 300)} SELECT signal_id, ch, symbol, round({_E(1200)}, 4) AS mark, round({_E(2200)}, 4) AS space FROM z GROUP BY ALL")
add("manchester_halves", lambda s, d: r4(windows.manchester_symbols(_nor(s, d), RATE, 300).drop("bit"), "first", "second"), f"WITH {_NOR}, {_SYM.format(RATE / 300)} SELECT signal_id, ch, symbol, round(avg(CASE WHEN pos < 13 THEN norm END), 4) + 0.0 AS \"first\", round(avg(CASE WHEN pos >= 13 THEN norm END), 4) + 0.0 AS second FROM z GROUP BY ALL")
add("constellation_iq", lambda s, d: r4(windows.constellation(_nor(s, d), RATE, 250, 1000), "i", "q"), f"WITH {_NOR}, {_SYM.format(RATE / 250)} SELECT signal_id, ch, symbol, round(avg(norm * cos(2 * pi() * 1000 / 8000 * idx)), 4) + 0.0 AS i, round(avg(-norm * sin(2 * pi() * 1000 / 8000 * idx)), 4) + 0.0 AS q FROM z GROUP BY ALL")
add("bpsk_bits", lambda s, d: windows.dbpsk_symbols(_nor(s, d), RATE, 250, 1000).groupBy("bit").agg(F.count(F.lit(1)).alias("n")), f"WITH {_NOR}, {_SYM.format(RATE / 250)}, p AS (SELECT signal_id, ch, symbol, atan2(sum(-norm * sin(2 * pi() * 1000 / 8000 * pos)), sum(norm * cos(2 * pi() * 1000 / 8000 * pos))) AS phase FROM z GROUP BY ALL), e AS (SELECT phase - lag(phase) OVER (PARTITION BY signal_id, ch ORDER BY symbol) AS e FROM p) SELECT (abs(atan2(sin(e), cos(e))) > pi() / 2)::INT AS bit, count(*)::BIGINT AS n FROM e WHERE e IS NOT NULL GROUP BY ALL")
_VARS = "mono AS (SELECT l.idx, l.norm AS l, r.norm AS r, max(l.idx) OVER () AS last FROM n l JOIN n r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1)"
_V = [("mid", "idx", "(l + r) / sqrt(2)", "true"), ("side", "idx", "(l - r) / sqrt(2)", "true"), ("diff", "idx", "l - r", "true"), ("average", "idx", "(l + r) / 2", "true"), ("left", "idx", "l", "true"), ("right", "idx", "r", "true"), ("reverse_time", "last - idx", "(l + r) / 2", "true"), ("even", "idx // 2", "(l + r) / 2", "idx % 2 = 0"), ("odd", "idx // 2", "(l + r) / 2", "idx % 2 = 1"), ("decimate_2", "idx // 2", "(l + r) / 2", "idx % 2 = 0"), ("decimate_4", "idx // 4", "(l + r) / 2", "idx % 4 = 0")]
_V += [(f"stride_{st}_o{o}", f"(idx - {o}) // {st}", "(l + r) / 2", f"idx >= {o} AND (idx - {o}) % {st} = 0") for st in (3, 4) for o in range(st)]
add("signal_variations", lambda s, d: r4(windows.variations(_nev(s, d)), "value"), f"WITH {_NEV}, {_VARS} " + " UNION ALL ".join(f"SELECT 'events' AS signal_id, '{a}' AS variation, {b} AS idx, round({c}, 4) + 0.0 AS value FROM mono WHERE {w}" for a, b, c, w in _V))


# --- Kernels on arrays.
def _per(name: str, adapter, fn, schema: str) -> None:
    add(name, lambda s, d: spectral.per_signal(adapter(s, d), fn, schema, RATE))


_vec = lambda s, d: windows.normalised(tables.sig_vec(s, d))
_per("spectral_features", _vec, spectral.spectral_profile, "centroid double, bandwidth double, roll_off double, skewness double, kurtosis double, peak_hz double")
# The signal of orders has no carriers: tones and a sweep are laid over it.
_tones = lambda s, d: _nor(s, d).withColumn("norm", 0.1 * F.col("norm") + sum((F.sin(F.col("idx") * (2 * math.pi * hz / RATE)) for hz in (500, 1000, 1500, 3100)), F.lit(0.0)) / 4)
_swept = lambda s, d: _nor(s, d).withColumn("norm", 0.1 * F.col("norm") + F.sin((F.col("idx") % 32_000) * (2 * math.pi / RATE) * (400 + 300 * (F.col("idx") % 32_000) / RATE)))
_per("carriers", _tones, spectral.carriers, "hz double, power double, stability double")
_per("harmonics", _tones, lambda x, r: [(g[0], len(g)) for g in spectral.harmonics([c[0] for c in spectral.carriers(x, r)])], "fundamental_hz double, carriers int")
_per("sweeps", _swept, spectral.sweeps, "start_s double, end_s double, start_hz double, end_hz double, slope double, linearity double")
_per("modem_scan", _nev, lambda x, r: spectral.detected(x, r, spectral.MODEMS), "detector string, score double")
_per("modulation_scan", _nev, lambda x, r: spectral.detected(x, r, spectral.MODULATIONS), "detector string, score double")
_per("detector_scores", _nor, lambda x, r: [(n, float(f(x, r))) for n, f in {**spectral.MODEMS, **spectral.MODULATIONS}.items()], "detector string, score double")
_per("phase_bits", _nor, lambda x, r: [(i, b) for i, b in enumerate(spectral.packed(spectral.phase_bits(x)))], "idx int, byte int")
_per("stft_peaks", _nor, lambda x, r: [(i, float(k)) for i, k in enumerate(spectral.stft(x, r)[0][spectral.stft(x, r)[2].argmax(1)])], "frame int, hz double")
_per("symbol_rate", _nor, lambda x, r: [(spectral.symbol_rate(x, r),)], "baud double")
_per("symbol_sync", _nor, lambda x, r: [(int(i), float(v)) for v, i in zip(*spectral.synchronise(x, r, 300))], "at long, value double")
_per("demodulated", _nor, lambda x, r: [(k, spectral.demodulate(k, x, r, 300)) for k in ("FSK", "BPSK", "Manchester", "ASK", "NRZ", "Morse", "DTMF")], "kind string, data binary")


def _wavs(spark: SparkSession, d: str) -> DataFrame:
    """Files made from the whole events signal, one for each FRAMES frames, with a payload after the end of each."""
    def built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("idx")[["l", "r"]].to_numpy().astype(np.int64)
        return pd.DataFrame({"path": [f"events_{key[0]}.wav"], "content": [wav.build(x, RATE, 16, trailer=b"PAYLOAD flag{after_the_end}")]})

    e = tables.sig_events(spark, d)
    l, r = (e.where(F.col("ch") == c).select("idx", F.col("raw").alias(n)) for c, n in ((0, "l"), (1, "r")))
    return l.join(r, "idx").groupBy(F.expr(f"idx div {FRAMES}").alias("block")).applyInPandas(built, "path string, content binary")


add("wav_roundtrip", lambda s, d: wav.samples(wav.files(_wavs(s, d))).groupBy("signal_id", "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("total")), f"WITH {EVENTS}, f AS (SELECT l.idx, l.raw AS l, r.raw AS r FROM sig l JOIN sig r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1), g AS (SELECT idx, 0 AS ch, l AS raw FROM f UNION ALL SELECT idx, 1, r FROM f) SELECT 'events_' || idx // {FRAMES} || '.wav' AS signal_id, ch::INT AS ch, count(*)::BIGINT AS n, sum(raw)::BIGINT AS total FROM g GROUP BY ALL")
add("analyze_e2e", lambda s, d: analyze.analyze(_wavs(s, d)).ranked.select("path", "rank", "source", "rating", "reason", "size"))
add("flag_search", lambda s, d: analyze.flag_search(_wavs(s, d)), f"WITH {EVENTS}, f AS (SELECT DISTINCT 'events_' || l.idx // {FRAMES} || '.wav' AS path FROM sig l JOIN sig r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1) SELECT path, unnest(['file', 'trailer']) AS place, 'flag{{after_the_end}}' AS value FROM f")


# --- Fields of the analysis of these files.
_LEFT = f"{EVENTS}, f AS (SELECT 'events_' || l.idx // {FRAMES} || '.wav' AS path, l.idx, l.raw AS l, r.raw AS r FROM sig l JOIN sig r ON l.idx = r.idx AND l.ch = 0 AND r.ch = 1)"
_HEX = "printf('%02X%02X', {0} & 255, ({0} >> 8) & 255)"
_RAW = "d AS (SELECT path, unhex(string_agg(" + _HEX.format("l") + " || " + _HEX.format("r") + ", '' ORDER BY idx)) AS data FROM f GROUP BY path)"
# The walk over chunks goes to the end of the file, so what follows the container counts as one.
add("wav_meta", lambda s, d: wav.files(_wavs(s, d), samples=False).select("path", "file_size", "riff_size", "channels", "sample_rate", "bits_per_sample", "audio_format", "duration_s", "total_samples", F.size("chunks").alias("chunks"), F.octet_length("trailer").alias("trailer_size"), "error"), f"WITH {_LEFT} SELECT path, (44 + 4 * count(*) + 27)::BIGINT AS file_size, (36 + 4 * count(*))::BIGINT AS riff_size, 2 AS channels, {RATE} AS sample_rate, 16 AS bits_per_sample, 'PCM' AS audio_format, count(*) / {RATE}::DOUBLE AS duration_s, count(*)::BIGINT AS total_samples, 3 AS chunks, 27 AS trailer_size, NULL::VARCHAR AS error FROM f GROUP BY path")
add("extracted_channel", lambda s, d: analyze.extracted(_wavs(s, d), "channel_1_raw").select("path", F.md5("data").alias("md5"), F.octet_length("data").cast("long").alias("size")), f"WITH {_LEFT} SELECT path, md5(unhex(string_agg({_HEX.format('r')}, '' ORDER BY idx))) AS md5, (2 * count(*))::BIGINT AS size FROM f GROUP BY path")
add("extracted_lsb", lambda s, d: analyze.extracted(_wavs(s, d), "multi_bitplane_ch0_b0_msb").select("path", F.md5("data").alias("md5")), f"WITH {_LEFT}, o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) - 1 AS k FROM f), b AS (SELECT path, k // 8 AS place, sum((l & 1) << (7 - k % 8)::INT)::INT AS byte FROM o GROUP BY ALL HAVING count(*) = 8) SELECT path, md5(unhex(string_agg(printf('%02X', byte), '' ORDER BY place))) AS md5 FROM b GROUP BY path HAVING count(*) >= 8")
add("analysis_summary", lambda s, d: analyze.analyze(_wavs(s, d)).summary.select("path", "duration_s", F.round("rms", 4).alias("rms"), "peak", F.round("positive_ratio", 6).alias("positive_ratio")), f"WITH {_LEFT} SELECT path, count(*) / {RATE}::DOUBLE AS duration_s, round(sqrt(avg(l::DOUBLE * l)), 4) AS rms, max(abs(l))::DOUBLE AS peak, round(avg((l >= 0)::INT::DOUBLE), 6) AS positive_ratio FROM f GROUP BY path")
_FLAGS = "SELECT path, unnest([0, 1]) AS ch, unnest([round(avg(l / 32768.0::DOUBLE), 6), round(avg(r / 32768.0::DOUBLE), 6)]) AS dc_offset, unnest([abs(avg(l / 32768.0::DOUBLE)) > 0.01, abs(avg(r / 32768.0::DOUBLE)) > 0.01]) AS offset_is_odd, unnest([max(abs(l)) / sqrt(avg(l::DOUBLE * l)) > 15, max(abs(r)) / sqrt(avg(r::DOUBLE * r)) > 15]) AS crest_is_odd FROM f GROUP BY path"
add("analysis_fingerprint", lambda s, d: analyze.analyze(_wavs(s, d)).fingerprint.select("path", "reasons", F.explode("levels").alias("v")).select("path", "v.ch", F.round("v.dc_offset", 6).alias("dc_offset"), F.exists("reasons", lambda r: F.startswith(r, F.concat(F.lit("DC offset of channel "), F.col("v.ch"), F.lit(":")))).alias("offset_is_odd"), F.exists("reasons", lambda r: F.startswith(r, F.concat(F.lit("crest factor of channel "), F.col("v.ch"), F.lit(":")))).alias("crest_is_odd")), f"WITH {_LEFT} {_FLAGS}")
add("analysis_entropy", lambda s, d: r4(analyze.analyze(_wavs(s, d)).entropy, "entropy"), f"WITH {_LEFT}, b AS (SELECT path, unnest([l & 255, (l >> 8) & 255, r & 255, (r >> 8) & 255]) AS byte, unnest([0, 1, 2, 3]) + 4 * (row_number() OVER (PARTITION BY path ORDER BY idx) - 1) AS i, 4 * count(*) OVER (PARTITION BY path) AS size FROM f), w AS (SELECT path, byte, unnest(CASE WHEN size <= 2048 THEN [0] WHEN i >= 1024 THEN [i // 1024, i // 1024 - 1] ELSE [i // 1024] END) AS win, size FROM b), h AS (SELECT path, win, byte, count(*) AS n FROM w WHERE size <= 2048 OR win * 1024 + 2048 <= size GROUP BY ALL) SELECT path, win::INT AS win, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) + 0.0 AS entropy FROM h GROUP BY ALL")
add("analysis_log", lambda s, d: analyze.analyze(_wavs(s, d)).log.where("extractor in ('multibit_bitplanes', 'channels', 'relationships', 'sign_bits', 'sample_parity', 'trailer')"), f"WITH {_LEFT}, k AS (SELECT path, count(*) AS n FROM f GROUP BY path) SELECT path, unnest(['multibit_bitplanes', 'channels', 'relationships', 'sign_bits', 'sample_parity', 'trailer']) AS extractor, unnest([CASE WHEN n >= 64 THEN 64 ELSE 0 END, 5, CASE WHEN n > 64 THEN 12 ELSE 4 END, CASE WHEN n >= 8 THEN 4 ELSE 0 END, CASE WHEN n >= 64 THEN 4 ELSE 0 END, 1])::BIGINT AS n FROM k")
for _t in ("stats", "anomalies", "findings", "harmonics", "recommendations"):
    add(f"analysis_{_t}", lambda s, d, t=_t: getattr(analyze.analyze(_wavs(s, d)), t))
add("base64_flags", lambda s, d: scan.base64_flags(tables.read(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.encode("text", "UTF-8"), F.encode(F.concat(F.lit(" "), F.base64(F.encode(F.concat(F.lit("FLAG{of document "), "doc_id", F.lit(", behind Base64}")), "UTF-8")), F.lit(" ")), "UTF-8")).alias("data"))), f"SELECT doc_id AS id, 'FLAG{{of document ' || doc_id || ', behind Base64}}' AS value FROM documents")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return analyze.scan_streams(docs(spark, d)).select("id", "size", "entropy", "printable_ratio", "rating", "reason", "regex_count")


add("byte_scan", flagship, f"WITH {_RATED}, {_regex_counts}, w AS (SELECT r.*, {_REASON} AS reason FROM r JOIN g USING (id)) SELECT w.id, w.size, w.entropy, w.p AS printable_ratio, rating::INT AS rating, reason, coalesce(regex_count, 0)::BIGINT AS regex_count FROM w LEFT JOIN c ON c.id = w.id WHERE passes AND (rating > 1 OR w.entropy > 7.5)")
