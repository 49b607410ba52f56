"""Queries without SQL run over all of their input."""

import os
import re

import numpy as np
import pytest

from sondeur.operators import decode, scan, sweep
from sondeur.plans import queries
from sondeur.sources import tables

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_caesar_of_whole_texts(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert any(len(t) > 200 for t in texts.values())
    want = {(i, k): decode.rotate(t.encode(), k).decode() for i, t in texts.items() for k in range(1, 26)}
    assert {(r.item_id, r.shift): r.text for r in queries.QUERIES["caesar_all"](spark, SF).collect()} == want


def test_all_levels_of_haar(spark):
    x = np.array([r.raw for r in tables.sig_orders(spark, SF).orderBy("idx").collect()])
    want = {(f"dwt_ch0_{n}", i): c for n, v in sweep.haar(x, 8) for i, c in enumerate(v)}
    got = {(r.source, r.idx): r.coefficient for r in queries.QUERIES["haar_dwt_l8"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(c, abs=2e-3) for k, c in want.items())


def test_all_lags(spark):
    signals = {}
    for r in tables.sig_user(spark, SF).orderBy("idx").collect():
        signals.setdefault(r.signal_id, []).append(r.raw / 32768)
    want = {}
    for u, v in signals.items():
        x = np.array(v) - np.mean(v)
        for lag in range((len(x) // 4 if len(x) < 1024 else 512) + 1):
            want[u, lag] = x[: len(x) - lag] @ x[lag:] / (x @ x) if x @ x > 0 else 0.0
    got = {(r.signal_id, r.lag): r.r for r in queries.QUERIES["autocorrelation_512"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(c, abs=1e-3) for k, c in want.items())


def test_all_types_of_findings(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.type: r.n for r in queries.QUERIES["intelligence_all"](spark, SF).collect()}
    want = {k: sum(1 for t in texts for _ in re.finditer(p, t.encode().decode("latin-1"), re.ASCII)) for k, (p, _) in scan.INTELLIGENCE.items()}
    assert got == {k: n for k, n in want.items() if n}
