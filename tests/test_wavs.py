"""Files made from the events signal hold all of it."""

import os

import pytest

from sondeur.plans import queries
from sondeur.sources import tables

SF = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("frames", [1_500, queries.FRAMES])
def test_whole_signal(spark, monkeypatch, frames):
    monkeypatch.setattr(queries, "FRAMES", frames)
    e = tables.sig_events(spark, SF).select("ch", "idx", "raw").collect()
    both = {x.idx for x in e if x.ch == 0} & {x.idx for x in e if x.ch == 1}
    want = {c: (len(v), sum(v)) for c in (0, 1) for v in [[x.raw for x in e if x.ch == c and x.idx in both]]}
    got = {}
    for r in queries.QUERIES["wav_roundtrip"](spark, SF).collect():
        n, total = got.get(r.ch, (0, 0))
        got[r.ch] = (n + r.n, total + r.total)
    assert len(both) > 4_000 and got == want
    assert queries.QUERIES["flag_search"](spark, SF).where("place = 'trailer'").count() == -(-(max(both) + 1) // frames)
