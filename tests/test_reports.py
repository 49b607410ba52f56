"""Every field of an analysis, reports of it, nested files, raw bytes in and out, and plugins."""

import base64
import gzip
import io
import json
import zipfile

import numpy as np
import pytest

from sondeur.functions import bytes as B
from sondeur.operators import signals, spectral
from sondeur.plans import analyze, plugins, report
from sondeur.sources import raw, wav

RATE = 8000


def _zip(name, content):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(name, content)
    return z.getvalue()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    t = np.arange(20_000) / RATE
    x = np.stack([8000 * np.sin(2 * np.pi * f * t) for f in (440, 660)], 1).astype(np.int64)
    x[9_000:12_000, 0] += r.integers(-20_000, 20_000, 3_000)
    inner = wav.build(r.integers(-99, 99, (400, 1)), RATE, 16, trailer=gzip.compress(wav.build(r.integers(-9, 9, (50, 1)), RATE)))
    hidden = b"flag{in_the_lowest_bits} " + base64.b64encode(b"and FLAG{behind_base64_of_some_length} it ends")
    bits = np.unpackbits(np.frombuffer(hidden, np.uint8))
    x[: len(bits), 1] = x[: len(bits), 1] & ~1 | bits
    rows = [("a.wav", wav.build(x, RATE, 16, trailer=_zip("inner.wav", inner))), ("bad", b"no"), ("empty.wav", wav.build(np.zeros((0, 1), np.int64), RATE)), ("null", None)]
    binary = spark.createDataFrame(rows, "path string, content binary")
    return x, rows, analyze.analyze(binary, store=str(tmp_path_factory.mktemp("analysis"))), binary


def test_fields(made):
    x, rows, a, _ = made
    of = lambda t: t.where("path = 'a.wav'").collect()
    assert {r.path for r in a.meta.where("error is not null").collect()} == {"bad", "null"}
    log = {r.extractor: r.n for r in of(a.log)}
    assert len(log) > 10 and log["trailer"] == 1 and log["multibit_bitplanes"] == 64
    s = of(a.summary)[0]
    assert s.duration_s == 2.5 and abs(s.dominant_hz - 440) < 5 and s.peak == np.abs(x[:, 0]).max() and s.rms == pytest.approx(np.sqrt((x[:, 0] ** 2).mean()))
    odd = of(a.anomalies.where("ch = 0"))  # a pure tone varies at its ends alone, where the window has zeros
    assert len(odd) == 1 and 9_000 <= odd[0].start < 10_000 and 11_000 < odd[0].end <= 12_000 and odd[0].ratio > 2
    m = wav.parse(rows[0][1])
    assert [r.entropy for r in sorted(of(a.entropy), key=lambda r: r.win)] == B._windowed(m["raw_data"], 2048, 1024).tolist()
    f = of(a.fingerprint)[0]
    assert f.channels == 2 and len(f.levels) == 2 and not f.silence_ratio and f.anomalous == bool(f.reasons)
    stats = of(a.stats)
    assert [r.rank for r in sorted(stats, key=lambda r: r.rank)] == list(range(1, len(stats) + 1)) and len(stats) <= analyze.PROFILED
    top = of(a.ranked.where("source = 'multi_bitplane_ch1_b0_msb'"))[0]
    assert top.rating == 5 and top.findings[0] == "flag{in_the_lowest_bits}"
    assert not a.summary.where("path = 'empty.wav'").count() and a.log.where("path = 'empty.wav'").count()
    assert any(b"FLAG{behind_base64_of_some_length}" in bytes(r.value) for r in of(a.base64))


def test_anomalies_against_convolution():
    """By the definition: a moving window of the same length, zeros outside."""
    x = np.random.default_rng(1).normal(0, 100, 9_000)
    x[4_000:5_000] *= 9
    k = 512
    w = np.ones(k) / k
    v = np.clip(np.convolve(x * x, w, "same") - np.convolve(x, w, "same") ** 2, 0, None)
    at = np.flatnonzero(np.abs(v - v.mean()) > 2.5 * v.std())
    got = signals.anomalies(x, k)
    assert len(got) == 1 and (got[0]["start"], got[0]["end"]) == (at[0], at[-1]) and got[0]["mean_variance"] == pytest.approx(v[at[0] : at[-1]].mean(), rel=1e-4)
    assert signals.anomalies(x[: 4 * k - 1], k) == [] and signals.anomalies(np.zeros(9_000), k) == []


def test_summary_repeats():
    t = np.arange(RATE * 2) / RATE
    s = signals.summary(1000 * np.sin(2 * np.pi * 1500 * t) * (1 + np.sin(2 * np.pi * 20 * t)), RATE)
    assert s["repeat_hz"] == pytest.approx(20, rel=0.02) and abs(s["dominant_hz"] - 1500) < 25
    assert signals.summary(np.zeros(0), RATE)["duration_s"] == 0 and signals.summary(np.ones(5), RATE)["repeat_lag"] is None


def test_nested_files(made, spark, tmp_path):
    _, rows, a, binary = made
    assert sorted(r.path for r in a.nested.select("path").collect()) == ["a.wav!trailer!inner.wav"]
    levels = analyze.analyze_deep(binary.where("path = 'a.wav'"), 2, store=str(tmp_path))
    assert [r.path for r in levels[2].meta.collect()] == ["a.wav!trailer!inner.wav!trailer!gzip"]
    small = analyze.analyze(binary, most=100)
    assert small.nested.count() == 0 and [(r.path, r.size) for r in small.left_out.collect()] == [("a.wav!trailer!inner.wav", len(zipfile.ZipFile(io.BytesIO(wav.parse(rows[0][1])["trailer"])).read("inner.wav")))]


def test_findings_have_weights(monkeypatch):
    monkeypatch.setattr(spectral, "detected", lambda *a: [("ASK", 0.9)])
    monkeypatch.setattr(spectral, "demodulate", lambda *a: b"acme{own} http://a.b/c " + b"0" * 32)
    r = signals.coordinate([np.sin(np.arange(4_000))], RATE, "acme")
    raw_ = {f["type"]: f["confidence"] for f in r["findings"] if f["path"] == ["demod_raw"]}
    assert raw_["Specific Flag (ACME)"] == 0.9 and raw_["URL"] == pytest.approx(0.81) and raw_["Hex Hash (MD5)"] == pytest.approx(0.0585)
    assert [f["confidence"] for f in r["findings"]] == sorted((f["confidence"] for f in r["findings"]), reverse=True)
    assert any("ASK is likely" in x for x in r["recommendations"]) and any("recovered by demod_raw" in x or "recovered by raw" in x for x in r["recommendations"])


def test_fingerprint_flags():
    x = np.zeros(4_000)
    x[100] = 0.9
    f = signals.fingerprint([x, np.full(4_000, 0.2)], RATE)
    assert f["anomalous"] and any("crest" in r for r in f["reasons"]) and any("DC offset of channel 1" in r for r in f["reasons"]) and f["silence_ratio"] > 0.9
    assert signals.fingerprint([np.zeros(0)], RATE) == {}


def test_reports(made, spark, tmp_path):
    _, _, a, _ = made
    text, page, shown = report.text(a, "a.wav"), report.page(a, "a.wav"), report.console(a, "a.wav")
    for part in ("multi_bitplane_ch1_b0_msb", "Signal", "Unusual variance", "Nested files", "Extraction"):
        assert part in text and part in page
    assert "<polyline" in page and "Candidates" in shown and "dominant_hz" in shown
    assert report.text(a, "not there").count("none that stands out") == 1
    d = json.loads(report.document(a, "a.wav"))
    assert d["nested"] == ["a.wav!trailer!inner.wav"] and len(d["candidates"]) == a.ranked.where("path = 'a.wav'").count() and d["stats"] and d["entropy"]
    (tmp_path / "r.json").write_text(json.dumps(d))
    assert sorted(r.source for r in report.listed(spark, str(tmp_path / "r.json")).collect()) == sorted(c["source"] for c in d["candidates"])
    report.write_json(a, str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "log")).count() == a.log.count()
    analyze.registered(spark, a)
    assert spark.sql("select count(*) as n from analysis_ranked where rating = 5").first().n > 0


def test_bytes_in_and_out(made, spark, tmp_path):
    x, _, _, binary = made
    streams = analyze.extracted(binary, "channel_1_raw").selectExpr("concat(path, '.bin') as name", "data")
    rows = streams.unionByName(spark.createDataFrame([("../out", b"x"), ("none", None), ("sub/b.bin", b"flag{x}")], "name string, data binary"))
    got = {r.name: (r.size, r.error) for r in raw.write(rows, str(tmp_path)).collect()}
    assert got["a.wav.bin"] == (40_000, None) and got["../out"][1] and got["none"][1] and got["sub/b.bin"] == (7, None)
    back = {r.path.rsplit("/", 1)[1]: bytes(r.data) for r in raw.read(spark, str(tmp_path)).collect()}
    assert back == {"a.wav.bin": x[:, 1].astype("<i2").tobytes()}


def test_plugins_run(made, spark, tmp_path):
    (tmp_path / "own.py").write_text(
        "from sondeur.plans.plugins import *\n"
        "loud = DetectorPlugin('Loud', detect=lambda x, rate: float(abs(x).max()))\n"
        "told = DemodulatorPlugin('Told', demodulate=lambda x, rate, p: b'flag{by_plugin}')\n"
        "back = DecoderPlugin('Back', decode=lambda d: d[::-1])\n"
        "size = ScannerPlugin('Size', scan=lambda d: [('size', 0, str(len(d)))])\n"
    )
    (tmp_path / "wrong.py").write_text("1 / 0")
    r = plugins.Registry()
    assert [f for f, _ in r.discover(str(tmp_path))] == ["wrong.py"] and {s["name"] for s in r.summary()} == {"Loud", "Told", "Back", "Size"}
    _, _, _, binary = made
    a = analyze.analyze(binary, plugins=r)
    assert a.sigint.where("kind = 'plugin' and name = 'loud'").first().confidence > 0.2
    assert a.findings.where("source = 'told'").first().value == "flag{by_plugin}"
    assert a.plugin.where("plugin = 'size'").count() > 0
    assert [(x.ch, x.detector) for x in r.detected(binary).orderBy("ch").collect() if x.path == "a.wav"] == [(0, "loud"), (1, "loud")]
    assert {bytes(x.data) for x in r.demodulated(binary.where("path = 'a.wav'")).collect()} == {b"flag{by_plugin}"}
    assert [bytes(x.data) for x in r.decoded(spark.createDataFrame([(1, b"abc"), (2, None)], "id long, data binary")).collect()] == [b"cba"]
