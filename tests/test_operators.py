import gzip
import io
import zipfile

import numpy as np
import pytest

from sondeur.functions import bytes as B
from sondeur.functions.integers import gray_to_binary, wrap
from sondeur.operators import decode, extract, files, scan, spectral, sweep
from sondeur.plans import analyze, plugins, report
from sondeur.sources import wav


def streams(spark, *data):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id long, data binary")


def signal(spark, values, ch=0):
    return spark.createDataFrame([("s", ch, i, int(v)) for i, v in enumerate(values)], "signal_id string, ch int, idx long, raw long")


def test_entropy(spark):
    got = {r.id: r.entropy for r in B.entropy(streams(spark, bytes(range(256)), bytes(100), b"")).collect()}
    assert got == {0: 8.0, 1: 0.0, 2: 0.0}
    assert [r.entropy for r in B.sliding_entropy(streams(spark, bytes(100)), 64, 32).collect()] == [0.0, 0.0]


def test_pack_and_sizes(spark):
    bits = spark.createDataFrame([("s", "x", i, b) for i, b in enumerate([1, 1, 0, 0, 0, 0, 0, 0, 1])], "signal_id string, source string, idx long, bit int")
    assert [r.byte for r in extract.pack(bits).collect()] == [0xC0]
    assert [r.byte for r in extract.pack(bits, msb=False).collect()] == [0x03]
    assert spectral.packed(np.array([1, 1, 0, 0, 0, 0, 0, 0, 1])) == b"\xc0"
    assert spark.range(1).select(B.size_text(__import__("pyspark").sql.functions.lit(1024))).first()[0] == "1.00 KB"


def test_gray_and_delta(spark):
    x = signal(spark, [0, 1, 3, 2])
    assert [r.value for r in extract.gray_values(x, 16).orderBy("idx").collect()] == [0, 1, 2, 3]
    x = signal(spark, [10, 2, 3, 65532])
    assert [r.value for r in extract.delta_values(x, 16).orderBy("idx").collect()] == [10, 12, 15, 11]


def test_scanners(spark):
    s = streams(spark, b"xx flag{a_b_c} yy", b"\x01\x02Hello World\x03", b"myctf{custom_1}")
    hits = {(r.id, r.type): r.value for r in scan.matches(s, scan.PATTERNS | scan.custom_flag("myctf")).collect()}
    assert hits[0, "Flag"] == "flag{a_b_c}" and hits[2, "Custom Flag"] == "myctf{custom_1}"
    assert [(r.offset, r.text) for r in scan.ascii_runs(s, 6).where("id = 1").collect()] == [(2, "Hello World")]


def test_boundaries_are_of_bytes(spark):
    s = streams(spark, b"\xe9" + b"a" * 32 + b"\xe9")
    assert [r.value for r in scan.matches(s, {"m": scan.PATTERNS["Hex Hash (MD5)"]}).collect()] == ["a" * 32]


def test_signatures_agree(spark):
    data = [b"%PDF-1.4 text text text %%EOF x %%EOF", b"..BMxx" + b"\x7fELF" * 2 + b"PK\x03\x04" + bytes(30) + b"PK\x05\x06", b"", b"RIFFxxxxWAVE" + bytes(40)]
    rows = {(r.id, r.type, r.offset, r.end) for r in scan.signatures(streams(spark, *data)).collect()}
    assert rows == {(i, s["type"], s["offset"], s["end"]) for i, d in enumerate(data) for s in files.find_signatures(d)}


def test_validation():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "text")
    assert files.valid(z.getvalue(), "ZIP Archive")[0] and not files.valid(z.getvalue()[:-5], "ZIP Archive")[0]
    assert files.valid(gzip.compress(b"a sentence"), "GZIP Archive")[0]
    assert not files.valid(b"\xff\xd8\xff" + bytes(50), "JPEG Image")[0]
    assert not any(files.valid(b"", k)[0] for k in files.CHECKS)
    assert [c["inflated"] for c in files.compressed(b"zz" + gzip.compress(b"payload") + b"rest")] == [b"payload"]


@pytest.mark.parametrize("step, coded", [("base64", b"aGVsbG8gd29ybGQ="), ("hex", b"68656c6c6f20776f726c64"), ("caesar_s13", b"uryyb jbeyq")])
def test_decoders(step, coded):
    assert dict(decode.children(coded))[step] == b"hello world"


def test_nested_decoding():
    import base64

    inner = decode.rotate(b"flag{nested_value}", 13)
    assert any(r["path"] == ["raw", "base64", "caesar_s13"] and r["data"] == b"flag{nested_value}" for r in decode.decode_all(base64.b64encode(inner), 2))
    assert decode.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"
    assert decode.from_base58(b"JxF12TrwUP45BMd") == b"Hello World"


def test_xor_ranks(spark):
    data = decode.xor(b"some readable text here", bytes([77]))
    got = [(r.xor_key, round(r.ratio, 9)) for r in B.xor_ranks(streams(spark, data)).orderBy("rank").collect()]
    assert got == [(k, round(r, 9)) for k, r in decode.xor_keys(data)]


def test_spectral():
    t = np.arange(8000) / 8000
    assert abs(spectral.carriers(np.sin(2 * np.pi * 1000 * t), 8000)[0][0] - 1000) < 10
    chirp = np.sin(2 * np.pi * (500 * t + 500 * t * t))
    assert spectral.sweeps(chirp, 8000)[0][4] == pytest.approx(1000, rel=0.1)
    assert next(iter(spectral.spectral_profile(np.sin(2 * np.pi * 440 * t), 8000)))[5] == pytest.approx(440, abs=10)
    assert spectral.harmonics([100.0, 200.0, 250.0, 301.0]) == [[100.0, 200.0, 301.0], [250.0]]


def test_fsk_bits():
    bits, n, rate = [1, 0, 1, 0, 1, 1, 0, 0], 160, 8000
    x = np.concatenate([np.sin(2 * np.pi * (1200 if b else 2200) * np.arange(n) / rate) for b in bits])
    assert spectral.demodulate("FSK", x, rate, 50) == b"\xac"


def test_dtmf_and_morse():
    rate, t = 8000, np.arange(800) / 8000
    tone = lambda a, b: np.sin(2 * np.pi * a * t) + np.sin(2 * np.pi * b * t)
    x = np.concatenate([tone(697, 1209), np.zeros(800), tone(770, 1336)])
    assert spectral.dtmf_text(x, rate) == "15"
    unit, on = 480, lambda k: np.sin(2 * np.pi * 600 * np.arange(480 * k) / 8000)
    parts = [on(1), np.zeros(unit), on(1), np.zeros(unit), on(1), np.zeros(3 * unit), on(3), np.zeros(unit), on(3), np.zeros(unit), on(3)]
    assert spectral.morse_text(np.concatenate([np.zeros(unit), *parts, np.zeros(unit)]), rate) == "SO"


@pytest.mark.parametrize("words", [1_000, 1 << 20])
def test_noise_is_as_long_as_the_signal(spark, words):
    import random

    own = random.Random("42")
    want = [own.randint(0, 1) for _ in range(10_000)]
    assert [r._noise for r in extract.noise(spark, "42", 10_000, words).orderBy("_at").collect()] == want
    if words > 1_000:
        payload = bytes(range(256)) * 4
        bits = [int(b) ^ n for b, n in zip(np.unpackbits(np.frombuffer(payload, np.uint8)), want)]
        got = extract.pack(extract.despread(signal(spark, bits), "42")).orderBy("idx").collect()
        assert bytes(r.byte for r in got) == payload


def test_haar_agrees(spark):
    x = np.array([3, 5, -1, 7, 2])
    rows = {(r.source, r.idx): r.coefficient for r in extract.haar(signal(spark, x), 2).collect()}
    for name, v in sweep.haar(x, 2):
        for i, c in enumerate(v):
            assert rows[f"dwt_ch0_{name}", i] == pytest.approx(c)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_roundtrip(bits):
    x = np.array([[1, 2], [3, 100], [7, 0]]) if bits == 8 else np.array([[1, -2], [30, -100], [7, 0]])
    m = wav.parse(wav.build(x, 8000, bits, trailer=b"abc"))
    assert m["samples"].tolist() == x.tolist() and m["trailer"] == b"abc" and m["sample_rate"] == 8000


def test_analysis(spark, tmp_path):
    n = 4096
    t = np.arange(n) / 8000
    x = np.stack([16384 * np.sin(2 * np.pi * f * t) for f in (440, 660)], 1).astype(np.int64)
    bits = np.unpackbits(np.frombuffer(b"flag{hidden_in_the_lowest_bits}", np.uint8))
    x[: len(bits), 0] = x[: len(bits), 0] & ~1 | bits
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("inner.wav", wav.build(x[:100], 8000))
    binary = spark.createDataFrame([("a.wav", bytearray(wav.build(x, 8000, 16, trailer=z.getvalue()))), ("bad", bytearray(b"no"))], "path string, content binary")
    a = analyze.analyze(binary)
    top = a.ranked.where("source = 'multi_bitplane_ch0_b0_msb'").first()
    assert top.rating == 5 and "flag{hidden_in_the_lowest_bits}" in top.findings
    assert a.ranked.where("source = 'trailer'").count() == 1
    assert a.meta.where("path = 'bad'").first().error
    assert [r.path for r in analyze.nested(wav.files(binary)).collect()] == ["a.wav!inner.wav"]
    assert "multi_bitplane_ch0_b0_msb" in report.text(a, "a.wav") + str(a.ranked.count())
    assert {r.place for r in analyze.flag_search(binary).collect()} >= {"lsb_ch0"}


def test_demodulated_data_is_decoded_three_times(monkeypatch):
    import base64

    coded = b"flag{three_layers_deep}"
    for _ in range(3):
        coded = base64.b64encode(coded)
    monkeypatch.setattr(spectral, "detected", lambda *a: [("ASK", 0.9)])
    monkeypatch.setattr(spectral, "demodulate", lambda *a: coded)
    found = analyze.sigint(np.sin(np.arange(4_000)), 8000)
    assert any(k == "finding" and "flag{three_layers_deep}" in v and "base64 > base64 > base64" in v for k, _, v, _ in found)


def test_plugins(spark):
    r = plugins.Registry()
    r.register(plugins.ScannerPlugin("Marks", scan=lambda d: [("mark", d.index(b"!"), "!")] if b"!" in d else []))
    assert r.summary()[0]["name"] == "Marks"
    assert [(x.id, x.offset) for x in r.scanned(streams(spark, b"ab!", b"none")).collect()] == [(0, 2)]
    with pytest.raises(TypeError):
        r.register(plugins.Plugin("nothing"))


def test_streaming(spark, tmp_path):
    from sondeur.streaming import watch

    (tmp_path / "a.bin").write_bytes(b"xx flag{streamed_in} yy")
    q = watch.hits(watch.arriving(spark, str(tmp_path)), {"Flag": scan.PATTERNS["Flag"]}).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.value for r in spark.sql("select value from hits").collect()] == ["flag{streamed_in}"]


def test_wrap(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(70000,), (-1,), (32768,)], "x long").select(wrap(F.col("x"), 16).alias("w"), gray_to_binary(F.lit(3), 16).alias("g")).collect()
    assert [r.w for r in got] == [4464, -1, -32768] and got[0].g == 2
