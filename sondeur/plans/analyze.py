"""The full analysis of files: parse, extract, score, rank, detect, demodulate, decode, and files within files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zipfile
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..operators import decode, files, scan, signals, spectral, sweep
from ..sources import wav

#: Sources whose streams go through the keyed decoders: the planes where payloads are least often noise.
DECODED = ("_b9_", "s256", "dwt")


# Extractors, in the order in which they are logged, by what the names of their streams begin with.
EXTRACTORS = {
    "multi_bitplane_": "multibit_bitplanes", "rel_": "relationships", "channel_": "channels", "layout_": "interleaved", "stride_": "strided", "reverse_": "reversed",
    "multi_nibble_": "nibbles", "multi_byte_": "reconstructed_bytes", "multi_inverted_": "bit_inverted", "multi_combined_": "combined_bitplanes", "multi_sign_bit_": "sign_bits",
    "multi_gray_": "multibit_transforms", "multi_delta_": "multibit_transforms", "gray_": "graycode", "delta_": "delta", "phase_fft_": "phase_fft", "ascii_strings_": "printable",
    "dwt_": "dwt_lsb", "parity_": "sample_parity", "dsss_": "dsss", "signal_polarity_": "signal_polarity", "signal_phase_": "signal_phase_diff", "trailer": "trailer",
}
#: Of each file, the best candidates with statistics, and those that are opened.
PROFILED, OPENED = 20, 5

_STATS = "size long, entropy double, printable_ratio double, bit_bias double, peak_ratio double, unique_ratio double"
_RANKED = f"rank int, source string, stream_order int, {files.SCORED}"
_struct = lambda fields: "struct<" + ", ".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"
STREAMS = (
    f"path string, log array<struct<extractor:string,n:long>>, ranked array<{_struct(_RANKED)}>, stats array<{_struct('rank int, source string, ' + _STATS)}>, "
    "nested array<struct<path:string,content:binary>>, left_out array<struct<path:string,size:long>>, base64 array<struct<place:string,value:binary>>, "
    "plugin array<struct<plugin:string,source:string,type:string,offset:long,value:string>>"
)
_SUMMARY = "duration_s double, dominant_hz double, rms double, peak double, positive_ratio double, repeat_lag int, repeat_hz double"
_LEVELS = "array<struct<ch:int,peak:double,rms:double,crest:double,dc_offset:double,dynamic_range_db:double>>"
_PRINT = "duration_s double, sample_rate int, channels int, correlation double, silence_ratio double, centroid double, bandwidth double, roll_off double, skewness double, kurtosis double, dominant_hz double"
SIGNALS = (
    f"path string, summary {_struct(_SUMMARY)}, fingerprint {_struct(_PRINT)[:-1]}, levels:{_LEVELS}, anomalous:boolean, reasons:array<string>>, "
    "anomalies array<struct<ch:int,start:long,end:long,length:long,mean_variance:double,ratio:double>>, entropy array<double>, recommendations array<string>, harmonics array<struct<fundamental_hz:double,carriers:int>>, "
    "found array<struct<ch:int,kind:string,name:string,value:string,confidence:double>>, findings array<struct<source:string,path:array<string>,type:string,offset:long,value:string,confidence:double>>"
)


@dataclass
class Analysis:
    """Tables with path in each.

    meta: a row a file, with its error if it can't be read; log: candidates of each extractor; ranked: candidates; stats: statistics of the best PROFILED;
    nested: path and content of files inside the trailer and the best OPENED; left_out: members too large to open; base64: flags behind Base64 there;
    summary, fingerprint: a row a file; anomalies: stretches of unusual variance; entropy: of windows of the raw data;
    signals: modems by channel; sigint: carriers, sweeps, modulations and findings; harmonics; findings: with path and confidence; recommendations;
    plugin: what registered scanners and decoders gave. A file without samples has rows in meta and in the tables of streams alone."""

    meta: DataFrame
    log: DataFrame
    ranked: DataFrame
    stats: DataFrame
    nested: DataFrame
    left_out: DataFrame
    base64: DataFrame
    summary: DataFrame
    fingerprint: DataFrame
    anomalies: DataFrame
    entropy: DataFrame
    signals: DataFrame
    sigint: DataFrame
    harmonics: DataFrame
    findings: DataFrame
    recommendations: DataFrame
    plugin: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _channels(m: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = [np.ascontiguousarray(m["samples"][:, c]) for c in range(m["samples"].shape[1])]
    return raw, [wav.normalised(x, m["bits_per_sample"], m["audio_format"]) for x in raw]


def _streams(m: dict, exhaustive: bool = False, flag: str | None = None) -> list[tuple[str, bytes]]:
    """Streams of every extractor, then keyed decodings of some."""
    if m["bits_per_sample"] < 8:
        return []
    words = [b"flag", b"ctf", *([flag.lower().encode()] if flag else [])]
    rows = list(sweep.streams(*_channels(m), m["bits_per_sample"], m["trailer"], exhaustive))
    more = []
    for source, data in rows:
        if any(k in source for k in DECODED):
            for d in decode.decode_all(data, 1, keyed_only=True, flag=flag):
                if d["printable_ratio"] > 0.7 or any(w in d["data"].lower() for w in words):
                    more.append((f"{source}_{'_'.join(d['path'])}", d["data"]))
    return rows + more


def _parsed(batches):
    """(path, parsed) of files that can be read; the others' errors are in meta."""
    for pdf in batches:
        for p, d in zip(pdf["path"], pdf["content"]):
            try:
                yield p, wav.parse(bytes(d or b""))
            except Exception:  # noqa: BLE001
                continue


def candidates(binary: DataFrame, exhaustive: bool = False, flag: str | None = None) -> DataFrame:
    """path, source, data, stream_order of every extractor and of keyed decodings of some."""

    def run(batches):
        for path, m in _parsed(batches):
            rows = _streams(m, exhaustive, flag)
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                yield pd.DataFrame({"path": path, "source": [s for s, _ in part], "data": [d for _, d in part], "stream_order": range(at, at + len(part))})

    return binary.select("path", "content").mapInPandas(run, "path string, source string, data binary, stream_order int")


def extracted(binary: DataFrame, source: str, exhaustive: bool = False) -> DataFrame:
    """path, data of one extractor's stream, by its name. Files that don't have it give no row."""
    return candidates(binary, exhaustive).where(F.col("source") == source).select("path", "data")


def _is_wav(d: bytes) -> bool:
    return d[:4] == b"RIFF" and b"WAVE" in d[:20]


def _opened(place: str, d: bytes, most: int) -> tuple[list[tuple[str, bytes]], list[tuple[str, int]]]:
    """(path, content) of WAV files in a payload: itself, an archive's members, unpacked gzip; and (path, size) of what is over `most` bytes."""
    kept, left = [], []
    try:
        if _is_wav(d):
            kept.append((f"{place}!appended", d))
        elif d[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(d)) as z:
                for i in z.infolist():
                    if i.file_size > most:
                        left.append((f"{place}!{i.filename}", i.file_size))
                    elif _is_wav(content := z.read(i)):
                        kept.append((f"{place}!{i.filename}", content))
        elif d[:2] == b"\x1f\x8b":
            with gzip.GzipFile(fileobj=io.BytesIO(d)) as g:
                content = g.read(most + 1)
            if len(content) > most:
                left.append((f"{place}!gzip", len(content)))
            elif _is_wav(content):
                kept.append((f"{place}!gzip", content))
    except Exception:  # noqa: BLE001  what can't be unpacked has nothing nested
        pass
    return kept, left


_BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?")


def _base64(d: bytes, flag: str | None) -> list[bytes]:
    """What Base64 of 40 characters or more decodes to, where that has a flag."""
    words = [b"FLAG{", *([flag.upper().encode()] if flag else [])]
    return [v for m in _BASE64.finditer(d) if any(w in (v := base64.b64decode(m[0])) for w in words)]


def _examined(m: dict, exhaustive: bool, flag: str | None, most: int, decoders: dict, scanners: dict) -> dict:
    rows = _streams(m, exhaustive, flag)
    counts = dict.fromkeys(EXTRACTORS.values(), 0)
    known: dict[bytes, dict] = {}
    ranked = []
    for order, (source, data) in enumerate(rows):
        name = next((e for k, e in EXTRACTORS.items() if source.startswith(k)), "other")
        counts["decoded" if "_raw_" in source else name] = counts.get("decoded" if "_raw_" in source else name, 0) + 1
        if not (exhaustive or source.startswith("trailer") or files.passes(data, flag)):
            continue
        mark = hashlib.sha256(data).digest()
        if mark not in known:  # extractors often give equal contents
            known[mark] = files.score(data, flag)
        found = known[mark]
        if found["rating"] > 1 or found["entropy"] > 7.5 or "trailer" in source:
            ranked.append({"source": source, "stream_order": order, **found})
    ranked.sort(key=lambda r: (-r["rating"], -r["entropy"], r["stream_order"]))
    best = [(r["source"], rows[r["stream_order"]][1]) for r in ranked[:PROFILED]]
    payloads = [("trailer", m["trailer"])] * bool(m["trailer"]) + [b for b in best[:OPENED] if b[0] != "trailer"]
    opened = [_opened(s, d, most) for s, d in payloads]
    plugin = [(n, s, *f) for s, d in best for n, p in scanners.items() for f in p.scan(d)]
    plugin += [(n, s, h["type"], h["offset"], h["value"]) for s, d in best for n, p in decoders.items() for h in signals.intelligence(p.decode(d) or b"", flag)]
    return {
        "log": list(counts.items()), "ranked": [{"rank": i + 1, **r} for i, r in enumerate(ranked)],
        "stats": [{"rank": i + 1, "source": s, **scan.statistics(d)} for i, (s, d) in enumerate(best)],
        "nested": [x for kept, _ in opened for x in kept], "left_out": [x for _, left in opened for x in left],
        "base64": [(s, v) for s, d in payloads for v in _base64(d, flag)], "plugin": plugin,
    }


def sigint(x: np.ndarray, rate: int, flag: str | None = None, depth: int = 2) -> list[tuple]:
    """(kind, name, value, confidence): carriers, sweeps, modulations, and findings in what demodulates and decodes."""
    return _told(signals.coordinate([x], rate, flag, depth))


def _told(r: dict) -> list[tuple]:
    out = [("carrier", f"{hz:.1f} Hz", f"stability {s:.2f}", s) for hz, _, s in r["carriers"]]
    out += [("sweep", f"{a:.0f} to {b:.0f} Hz", f"{slope:.1f} Hz/s", s) for _, _, a, b, slope, s in r["sweeps"]]
    out += [("modulation", name, "demodulated" if score >= 0.4 else "weak", score) for name, score in r["modulations"]]
    return out + [("finding", f"{f['source']}: {f['type']}", f"{f['value']} ({' > '.join(f['path'])})", f["confidence"]) for f in r["findings"]]


def _heard(m: dict, flag: str | None, detectors: dict, demodulators: dict) -> dict | None:
    raw, norm = _channels(m)
    rate = m["sample_rate"]
    if not raw or not len(raw[0]) or not rate:
        return None
    told = signals.coordinate(norm, rate, flag, demodulators={n: p.demodulate for n, p in demodulators.items()})
    found = [(c, "modem", n, "", s) for c, x in enumerate(norm) for n, s in spectral.detected(x, rate, spectral.MODEMS)]
    found += [(0, *t) for t in _told(told)] + [(0, "plugin", n, "", float(p.detect(norm[0], rate))) for n, p in detectors.items()]
    return {
        "summary": signals.summary(raw[0], rate), "fingerprint": told["fingerprint"], "anomalies": [{"ch": c, **a} for c, x in enumerate(raw[:2]) for a in signals.anomalies(x)],
        "entropy": B._windowed(m["raw_data"], 2048, 1024).tolist(), "recommendations": told["recommendations"],
        "harmonics": [{"fundamental_hz": g[0], "carriers": len(g)} for g in told["harmonics"]], "found": found, "findings": told["findings"],
    }


def analyze(binary: DataFrame, exhaustive: bool = False, flag: str | None = None, store: str | None = None, most: int = files.MOST, plugins=None) -> Analysis:
    """binary: path, content. A file is one task's: its streams are extracted, scored, ranked and opened in one pass, its channels heard in another, and nothing is shuffled.
    store: a folder that all machines share, where the two passes are written once; without it each table that is read runs its pass again.
    most: members of archives over so many bytes are listed in left_out instead of being opened. plugins: a plugins.Registry."""
    own = {k: dict(getattr(plugins, k)) if plugins else {} for k in ("detectors", "demodulators", "decoders", "scanners")}

    def streams(batches):
        for path, m in _parsed(batches):
            yield pd.DataFrame([{"path": path, **_examined(m, exhaustive, flag, most, own["decoders"], own["scanners"])}])

    def heard(batches):
        for path, m in _parsed(batches):
            if r := _heard(m, flag, own["detectors"], own["demodulators"]):
                yield pd.DataFrame([{"path": path, **r}], columns=["path", "summary", "fingerprint", "anomalies", "entropy", "recommendations", "harmonics", "found", "findings"])

    binary = binary.select("path", "content")
    s, h = binary.mapInPandas(streams, STREAMS), binary.mapInPandas(heard, SIGNALS)
    if store:
        place = f"{store.rstrip('/')}/analysis-{uuid.uuid4().hex}"
        kept = []
        for name, t in (("streams", s), ("signals", h)):
            t.write.parquet(f"{place}/{name}")
            kept.append(binary.sparkSession.read.schema(t.schema).parquet(f"{place}/{name}"))
        s, h = kept
    rows = lambda t, c: t.select("path", F.explode(c).alias("_x")).select("path", "_x.*")
    found = rows(h, "found")
    return Analysis(
        meta=wav.files(binary, samples=False).drop("samples", "raw_data"), log=rows(s, "log"), ranked=rows(s, "ranked"), stats=rows(s, "stats"),
        nested=s.select(F.col("path").alias("_p"), F.explode("nested").alias("_x")).select(F.concat("_p", F.lit("!"), "_x.path").alias("path"), "_x.content"),
        left_out=s.select(F.col("path").alias("_p"), F.explode("left_out").alias("_x")).select(F.concat("_p", F.lit("!"), "_x.path").alias("path"), "_x.size"),
        base64=rows(s, "base64"), summary=h.select("path", "summary.*"), fingerprint=h.select("path", "fingerprint.*"), anomalies=rows(h, "anomalies"),
        entropy=h.select("path", F.posexplode("entropy").alias("win", "entropy")), signals=found.where("kind = 'modem'"), sigint=found.where("kind <> 'modem'"), harmonics=rows(h, "harmonics"),
        findings=h.select(F.col("path").alias("_p"), F.explode("findings").alias("_x")).select(F.col("_p").alias("path"), "_x.source", F.col("_x.path").alias("steps"), "_x.type", "_x.offset", "_x.value", "_x.confidence"),
        recommendations=h.select("path", F.posexplode("recommendations").alias("place", "text")), plugin=rows(s, "plugin"),
    )


def nested(parsed: DataFrame, most: int = files.MOST) -> DataFrame:
    """path and content of WAV files inside trailers alone: appended whole, members of archives, unpacked gzip. `Analysis.nested` opens the best candidates too."""

    def run(batches):
        for pdf in batches:
            rows = [x for p, d in zip(pdf["path"], pdf["trailer"]) for x in _opened(p, bytes(d or b""), most)[0]]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return parsed.where("error is null and trailer is not null").select("path", "trailer").mapInPandas(run, "path string, content binary")


def analyze_deep(binary: DataFrame, levels: int = 2, **how) -> list[Analysis]:
    """The analysis of files, of files nested in them, and so on, `levels` deep. With `store`, a level is written before the next one reads it."""
    out = []
    for _ in range(levels + 1):
        out.append(analyze(binary, **how))
        binary = out[-1].nested
    return out


def flag_search(binary: DataFrame, flag: str | None = None) -> DataFrame:
    """path, place, value: flags (of a name of one's own too) in files' bytes, their trailers and lowest bit planes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, d in zip(pdf["path"], pdf["content"]):
                places = {"file": bytes(d)}
                try:
                    m = wav.parse(bytes(d))
                    places["trailer"] = m["trailer"]
                    for c in range(m["samples"].shape[1]):
                        places[f"lsb_ch{c}"] = spectral.packed(m["samples"][:, c] & 1)
                except ValueError:
                    pass
                rows += [(p, k, h["value"]) for k, v in places.items() for h in files.pattern_hits(v, flag) if h["type"] in ("Flag", "Custom Flag")]
            yield pd.DataFrame(rows, columns=["path", "place", "value"])

    return binary.select("path", "content").mapInPandas(run, "path string, place string, value string")


def scan_streams(streams: DataFrame) -> DataFrame:
    """The byte scan: rating, entropy, printable share and pattern counts of each stream, best first."""
    return scan.ranked(scan.rated(streams, more=True))


def registered(spark: SparkSession, a: Analysis, prefix: str = "analysis") -> None:
    """Every table of an analysis as a view, for SQL."""
    for name, table in a.tables().items():
        table.createOrReplaceTempView(f"{prefix}_{name}")
