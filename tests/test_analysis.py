"""Flags of one's own name through the whole analysis, and detectors on signals that were made."""

import numpy as np
import pytest

from sondeur.operators import files, scan, spectral
from sondeur.plans import analyze
from sondeur.sources import wav

RATE = 8000
T = np.arange(RATE * 4) / RATE


def test_custom_flags():
    long = "x" * 300
    text = f"noise acme {{{long}}} and ACME{{two words}}".encode()
    got = [h["value"] for h in files.pattern_hits(text, "acme") if h["type"] == "Custom Flag"]
    assert got == [f"acme {{{long}}}", "ACME{two words}"]
    name = b"some odd!! {x y}"
    assert files.score(name)["rating"] < 5 and files.score(name, "odd!!")["reason"] == "flag pattern"


def test_custom_flag_in_an_analysis(spark):
    r = np.random.default_rng(2)
    x = r.integers(-9000, 9000, (3000, 1))
    rows = [("a.wav", wav.build(x, RATE, 16, trailer=b"the end: odd name!! {hidden away}"))]
    binary = spark.createDataFrame(rows, "path string, content binary")
    best = {flag: analyze.analyze(binary, flag=flag).ranked.where("source like '%trailer%'").orderBy("rank").first() for flag in (None, "odd name!!")}
    assert best["odd name!!"].rating == 5 and best["odd name!!"].findings == ["odd name!! {hidden away}"] and (best[None] is None or best[None].rating < 5)
    assert [(h.place, h.value) for h in analyze.flag_search(binary, "odd name!!").where("place = 'trailer'").collect()] == [("trailer", "odd name!! {hidden away}")]


def test_carriers_and_harmonics(spark):
    x = sum(np.sin(2 * np.pi * hz * T) for hz in (500, 1000, 1500, 3100))
    found = spectral.carriers(x, RATE)
    assert all(any(abs(hz - f) < 10 for f, _, _ in found) for hz in (500, 1000, 1500, 3100)) and all(s > 0.9 for _, _, s in found)
    groups = spectral.harmonics([500.0, 1000.0, 1500.0, 3100.0])
    assert groups == [[500.0, 1000.0, 1500.0], [3100.0]]
    rows = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x[:RATE])], "signal_id string, ch int, idx long, norm double")
    got = spectral.per_signal(rows, spectral.carriers, "hz double, power double, stability double", RATE).collect()
    assert len(got) >= 4 and all(g.error is None for g in got)


def test_sweeps():
    x = np.sin(2 * np.pi * (400 * T + 300 * T * T))  # from 400 Hz, 600 Hz more each second
    (start, end, a, b, slope, linear), *more = spectral.sweeps(x, RATE)
    assert not more and start < 0.2 and end > 3.4 and a < 500 and b > 2400 and slope == pytest.approx(600, rel=0.05) and linear > 0.95
    assert spectral.sweeps(np.sin(2 * np.pi * 900 * T), RATE) == []


def test_patterns_run_where_they_are_needed():
    """The cheap tests before patterns lose no match."""
    text = b"key : v flag{a} CTF {b} https://a.b/c x@y.zz 1.2.3.4 00:11:22:33:44:55:66:77 eyJhbGciOiJI.e30.x -----BEGIN RSA PRIVATE KEY----- -----BEGIN CERTIFICATE----- Password= 'abcdefghijklmnopqrst' d41d8cd98f00b204e9800998ecf8427e " + b"ab" * 32
    import re

    for table in (scan.PATTERNS, {k: p for k, (p, _) in scan.INTELLIGENCE.items()}):
        got = [[m[0] for m in found] for found in scan.finder(table)(text)]
        assert got == [[m[0] for m in re.finditer(p.encode(), text)] for p in table.values()] and all(got[i] for i, k in enumerate(table) if k not in ("Base64 String", "Generic Flag Pattern", "JWT Token", "API Key Candidate"))
