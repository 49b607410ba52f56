"""Spectra, detectors and synchronisation of one channel, on arrays; `per_signal` runs them over a DataFrame, a signal to a call."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_signal(samples: DataFrame, fn, schema: str, rate: int) -> DataFrame:
    """fn(norm, rate) -> list of rows, on each (signal_id, ch) in the order of idx. An error in a signal costs its rows alone."""
    fields = schema.split(", ")
    names = ["signal_id", "ch", *[f.split(" ")[0] for f in fields], "error"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        key = (pdf["signal_id"].iloc[0], int(pdf["ch"].iloc[0]))
        try:
            rows = [(*key, *r, None) for r in fn(pdf["norm"].to_numpy(float), rate)]
        except Exception as e:  # noqa: BLE001
            rows = [(*key, *[None] * len(fields), f"{type(e).__name__}: {e}"[:200])]
        return pd.DataFrame(rows, columns=names)

    return samples.select("signal_id", "ch", "idx", "norm").groupBy("signal_id", "ch").applyInPandas(run, f"signal_id string, ch int, {schema}, error string")


def frames(x: np.ndarray, size: int = 1024, hop: int = 512, pad: bool = False) -> np.ndarray:
    if pad and len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    n = (len(x) - (size - hop)) // hop
    if n <= 0:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n]


def stft(x: np.ndarray, rate: int, size: int = 1024, hop: int = 512, pad: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies in Hz, frame centres in s, magnitudes (frame, bin) under a Hann window."""
    f = frames(x, size, hop, pad)
    mags = np.abs(np.fft.rfft(f * np.hanning(size), axis=1)).astype(np.float32)
    return np.fft.rfftfreq(size, 1 / rate), (np.arange(len(f)) * hop + size / 2) / rate, mags


def features(freqs: np.ndarray, mags: np.ndarray, roll: float = 0.85) -> tuple[float, float, float, float, float]:
    """Centroid, bandwidth, roll-off, skewness, kurtosis."""
    total = float(mags.sum())
    if not len(mags) or total <= 0:
        return (0.0,) * 5
    w = mags / total
    c = float(freqs @ w)
    d = freqs - c
    b = float(np.sqrt(d * d @ w))
    k = min(int(np.searchsorted(np.cumsum(mags), roll * total)), len(freqs) - 1)
    return c, b, float(freqs[k]), float(d**3 @ w / b**3) if b > 0 else 0.0, float(d**4 @ w / b**4) if b > 0 else 0.0


def spectral_profile(x: np.ndarray, rate: int):
    freqs, mags = np.fft.rfftfreq(len(x), 1 / rate), np.abs(np.fft.rfft(x))
    yield (*features(freqs, mags), float(freqs[int(mags.argmax())]) if len(mags) else 0.0)


def phase_bits(x: np.ndarray, size: int = 1024) -> np.ndarray:
    """Whether the phase of bins 1 to 8 is over 0, in frames that do not overlap."""
    return (np.angle(np.fft.rfft(frames(x, size, size), axis=1)[:, 1:9]) > 0).astype(np.uint8).ravel()


def stereo_phase(left: np.ndarray, right: np.ndarray, size: int = 1024, hop: int = 512) -> np.ndarray:
    """Mean phase difference of each frame."""
    w = np.hanning(size)
    a, b = (np.angle(np.fft.rfft(frames(x, size, hop) * w, axis=1)[:, 1:]) for x in (left, right))
    d = a - b
    return np.arctan2(np.sin(d), np.cos(d)).mean(1)


def envelope(x: np.ndarray, k: int) -> np.ndarray:
    if len(x) < k:
        return np.abs(x)
    total = np.concatenate(([0.0], np.cumsum(x * x)))
    i = np.arange(len(x)) - k // 2
    return np.sqrt(np.maximum(0, total[np.clip(i + k, 0, len(x))] - total[np.clip(i, 0, len(x))]) / k)


def crossings(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(x >= 0))


def _peaks(values: np.ndarray, bins: int) -> list[tuple[float, int]]:
    """Centres and counts of a histogram's strict inner peaks over 15 % of its highest."""
    h, e = np.histogram(values, bins=bins)
    inner = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:]) & (h[1:-1] > 0.15 * h.max())) + 1
    return [(float(e[i] + e[i + 1]) / 2, int(h[i])) for i in inner]


def carriers(x: np.ndarray, rate: int, factor: float = 4.0) -> list[tuple[float, float, float]]:
    """(Hz, power, stability), strongest first."""
    freqs, _, s = stft(x, rate, pad=True)
    if not s.size:
        return []
    m = s.mean(0)
    inner = np.flatnonzero((m[1:-1] > m[:-2]) & (m[1:-1] > m[2:]) & (m[1:-1] > factor * np.median(m))) + 1
    steady = (s[:, inner] > 2 * np.median(s)).mean(0)
    return sorted(((float(freqs[i]), float(m[i]), float(t)) for i, t in zip(inner, steady)), key=lambda c: -c[1])


def harmonics(hz: list[float], tolerance: float = 0.02) -> list[list[float]]:
    """Groups of a fundamental and its multiples, lowest first; each carrier is in one."""
    left, out = sorted(hz), []
    while left:
        base = left.pop(0)
        of = [f for f in left if base > 0 and (n := round(f / base)) > 1 and abs(f / base - n) / n <= tolerance]
        left = [f for f in left if f not in of]
        out.append([base, *of])
    return out


def sweeps(x: np.ndarray, rate: int, least: float = 50.0) -> list[tuple[float, float, float, float, float, float]]:
    """(start s, end s, start Hz, end Hz, slope, linearity) of straight runs of the peak frequency, near ones of like slope joined."""
    freqs, times, s = stft(x, rate, pad=True)
    size = min(20, len(times) // 2)
    if len(times) < 5 or size < 3:
        return []
    peak = freqs[s.argmax(1)]
    out: list[list[float]] = []
    for a in range(0, len(times) - size, size // 2):
        t, f = times[a : a + size], peak[a : a + size]
        dt, df = t - t.mean(), f - f.mean()
        if not (df @ df):
            continue
        slope, r = float(dt @ df / (dt @ dt)), float(dt @ df / np.sqrt((dt @ dt) * (df @ df)))
        if abs(r) <= 0.85 or abs(slope) < least:
            continue
        now = [float(t[0]), float(t[-1]), float(f[0]), float(f[-1]), slope, abs(r)]
        last = out[-1] if out else None
        if last and now[0] - last[1] < 0.2 and abs(slope - last[4]) / (abs(last[4]) + 1e-10) < 0.25:
            last[1], last[3], last[5] = now[1], now[3], (last[5] + now[5]) / 2
            if last[1] > last[0]:
                last[4] = (last[3] - last[2]) / (last[1] - last[0])
        else:
            out.append(now)
    return [tuple(o) for o in out]


def fsk(x: np.ndarray, rate: int) -> tuple[float, list[float]]:
    freqs, _, s = stft(x, rate)
    if not len(s):
        return 0.0, []
    found = sorted(_peaks(freqs[s.argmax(1)], 30), key=lambda p: -p[1])
    return (min(1.0, (found[0][1] + found[1][1]) / len(s)) if len(found) > 1 else 0.0), [f for f, _ in found[:4]]


def bfsk(x, rate):
    score, peaks = fsk(x, rate)
    return min(1.0, score * 1.1) if score > 0.4 and len(peaks) > 1 else 0.0


def afsk(x, rate):
    score, peaks = fsk(x, rate)
    return score * 0.95 if score > 0.4 and peaks and all(300 <= p <= 3000 for p in peaks) else 0.0


def ask(x, rate):
    e = envelope(x, int(rate * 0.005) or 20)
    if not len(e) or not e.mean():
        return 0.0
    spread = float(e.std() / e.mean())
    return min(0.9, spread) if len(_peaks(e, 30)) > 1 and spread > 0.3 else 0.0


def psk(x, rate):
    if len(x) < 4096:
        return 0.0
    n = (len(x) - 512) // 256
    if n < 8:
        return 0.0
    f = np.lib.stride_tricks.sliding_window_view(x, 512)[::256][:n]
    p = np.diff(np.angle(np.fft.rfft(f * np.hanning(512), axis=1)[:, 1:32]).mean(1))
    jump = np.abs(np.arctan2(np.sin(p), np.cos(p)))
    score = min(1.0, float((jump < 0.5).mean() + (jump > 2.5).mean()))
    return score if score > 0.5 else 0.0


def rtty(x, rate):
    freqs, _, s = stft(x, rate, 2048, 1024)
    band = (freqs > 300) & (freqs < 3000)
    if len(s) < 10 or not band.any():
        return 0.0
    power = s[:, band].sum(1)
    per_s = np.abs(np.diff((power > 1.1 * power.mean()).astype(int))).sum() / (len(x) / rate)
    return min(1.0, float(per_s) / 100) if 5 <= per_s <= 200 else 0.0


def sstv(x, rate):
    freqs, _, s = stft(x, rate, 4096, 2048)
    if len(s) < 20:
        return 0.0
    peak = freqs[s.argmax(1)]
    inside = peak[(peak > 1200) & (peak < 2500)]
    share = len(inside) / len(peak)
    return share if share > 0.6 and np.ptp(inside) > 200 else 0.0


def morse(x, rate):
    e = envelope(x, 200)
    on = np.diff((e > 1.2 * e.mean()).astype(np.int8)) if len(e) else np.zeros(0)
    starts, ends = np.flatnonzero(on == 1), np.flatnonzero(on == -1)
    if not len(starts) or not len(ends):
        return 0.0
    ends = ends[1:] if ends[0] < starts[0] else ends
    n = min(len(starts), len(ends))
    if n < 6:
        return 0.0
    p = sorted(c for c, _ in _peaks((ends[:n] - starts[:n]) / rate, 20))
    return 0.85 if len(p) > 1 and 2.2 <= p[1] / (p[0] + 1e-10) <= 3.8 else 0.0


def manchester(x, rate):
    c = crossings(x)
    if len(c) < 30:
        return 0.0
    i = np.diff(c)
    h, e = np.histogram(i, bins=50)
    t = (e[h.argmax()] + e[h.argmax() + 1]) / 2
    share = float((((i >= 0.8 * t) & (i <= 1.2 * t)) | ((i >= 1.6 * t) & (i <= 2.4 * t))).mean())
    return share if share > 0.65 else 0.0


def nrz(x, rate):
    c = crossings(x)
    if len(c) < 15:
        return 0.0
    i = np.diff(c)
    base = np.percentile(i, 10)
    r = i / base if base else np.zeros(1)
    share = float((np.abs(r - np.round(r)) < 0.25).mean()) if base else 0.0
    return share if share > 0.7 else 0.0


# The rows and columns of the telephone keypad and its keys.
DTMF_LOW, DTMF_HIGH = (697, 770, 852, 941), (1209, 1336, 1477, 1633)
DTMF_KEYS = ("123A", "456B", "789C", "*0#D")


def dtmf(x, rate):
    freqs, _, s = stft(x, rate)
    if not len(s):
        return 0.0
    m = s.mean(0)
    there = lambda f: m[np.abs(freqs - f).argmin()] > 4 * np.median(m)
    return 0.9 if any(map(there, DTMF_LOW)) and any(map(there, DTMF_HIGH)) else 0.0


#: Detectors by name, in the order in which equal scores are reported.
MODEMS = {"FSK": lambda x, r: fsk(x, r)[0], "BFSK": bfsk, "PSK": psk, "RTTY": rtty, "SSTV": sstv, "Morse": morse, "Manchester": manchester}
MODULATIONS = {"FSK": lambda x, r: fsk(x, r)[0], "AFSK": afsk, "ASK": ask, "BPSK": psk, "DTMF": dtmf, "Morse": morse, "Manchester": manchester, "NRZ": nrz}
REPORTED = 0.3


def detected(x: np.ndarray, rate: int, detectors: dict) -> list[tuple[str, float]]:
    found = [(name, float(f(x, rate))) for name, f in detectors.items()]
    return sorted((f for f in found if f[1] > REPORTED), key=lambda f: -f[1])


def symbol_rate(x: np.ndarray, rate: int) -> float:
    if len(x) < 100:
        return 1.0
    d = np.abs(np.diff(x))
    mags, freqs = np.abs(np.fft.rfft(d - d.mean())), np.fft.rfftfreq(len(d), 1 / rate)
    band = (freqs > 5) & (freqs < 5000)
    if not band.any():
        return 100.0
    k = int(np.where(band, mags, -1).argmax())
    if mags[k] > 3 * np.median(mags):
        return float(freqs[k])
    c = crossings(x)
    base = np.percentile(np.diff(c), 10) if len(c) >= 5 else 0
    return float(rate / base) if base > 0 else 300.0


def synchronise(x: np.ndarray, rate: int, baud: float) -> tuple[np.ndarray, np.ndarray]:
    """Values and places of symbols' middles, where the clock follows the difference of the samples before and after."""
    t = rate / baud
    if t <= 1:
        return x, np.arange(len(x))
    at, shift = [], 0.0
    for i in range(int(len(x) / t) - 1):
        middle = shift + (i + 0.5) * t
        if round(middle) >= len(x):
            break
        at.append(round(middle))
        early, late = round(middle - 0.15 * t), round(middle + 0.15 * t)
        if early >= 0 and late < len(x):
            shift += min(0.2 * t, max(-0.2 * t, 0.05 * (abs(x[early]) - abs(x[late]))))
    at = np.array(at, np.int64)
    return x[at], at


def packed(bits: np.ndarray, msb: bool = True) -> bytes:
    bits = np.asarray(bits, np.uint8)
    return np.packbits(bits[: len(bits) // 8 * 8], bitorder="big" if msb else "little").tobytes()


def _symbols(x: np.ndarray, rate: int, baud: float) -> list[np.ndarray]:
    t = rate / baud
    return [x[int(i * t) : int(int(i * t) + t)] for i in range(int(len(x) / t))]


def _tone(x: np.ndarray, hz: float, rate: int) -> complex:
    return complex(np.exp(-2j * np.pi * hz / rate * np.arange(len(x))) @ x)


def demodulate(kind: str, x: np.ndarray, rate: int, baud: float, carrier: float = 1000.0, mark: float = 1200.0, space: float = 2200.0) -> bytes:
    if kind in ("FSK", "AFSK", "BFSK"):
        return packed([abs(_tone(s, mark, rate)) > abs(_tone(s, space, rate)) for s in _symbols(x, rate, baud)])
    if kind in ("PSK", "BPSK"):
        p = np.diff([np.angle(_tone(s, carrier, rate)) for s in _symbols(x, rate, baud)])
        return packed(np.abs(np.arctan2(np.sin(p), np.cos(p))) > np.pi / 2)
    if kind == "Manchester":
        return packed([s[: len(s) // 2].mean() <= s[len(s) // 2 :].mean() for s in _symbols(x, rate, baud) if len(s) > 1])
    if kind in ("ASK", "NRZ"):
        v, _ = synchronise(envelope(x, int(rate * 0.005) or 20) if kind == "ASK" else x, rate, baud)
        return packed(v > v.mean()) if len(v) else b""
    if kind == "Morse":
        return morse_text(x, rate).encode()
    if kind == "DTMF":
        return dtmf_text(x, rate).encode()
    return b""


# The Morse code.
MORSE = {
    ".-": "A", "-...": "B", "-.-.": "C", "-..": "D", ".": "E", "..-.": "F", "--.": "G", "....": "H", "..": "I", ".---": "J", "-.-": "K", ".-..": "L", "--": "M",
    "-.": "N", "---": "O", ".--.": "P", "--.-": "Q", ".-.": "R", "...": "S", "-": "T", "..-": "U", "...-": "V", ".--": "W", "-..-": "X", "-.--": "Y", "--..": "Z",
    "-----": "0", ".----": "1", "..---": "2", "...--": "3", "....-": "4", ".....": "5", "-....": "6", "--...": "7", "---..": "8", "----.": "9",
    ".-.-.-": ".", "--..--": ",", "..--..": "?", ".----.": "'", "-..-.": "/", "-....-": "-", "-...-": "=", "---...": ":", ".-.-.": "+", "-.-.--": "!",
}


def morse_text(x: np.ndarray, rate: int) -> str:
    e = envelope(x, max(1, int(rate * 0.01)))
    if not len(e):
        return ""
    on = e > e.mean()
    cut = np.flatnonzero(np.diff(on)) + 1
    runs = [(bool(r[0]), len(r)) for r in np.split(on, cut) if len(r) > 0.01 * rate]
    lengths = [n for o, n in runs if o]
    if not lengths:
        return ""
    dit = np.percentile(lengths, 15)
    out, code = [], ""
    for o, n in [*runs, (False, 10 * dit)]:
        if o:
            code += "." if n < 2 * dit else "-"
        elif n >= 2.5 * dit:
            out.append(MORSE.get(code, "") + (" " if n >= 5 * dit else ""))
            code = ""
    return "".join(out).strip()


def dtmf_text(x: np.ndarray, rate: int) -> str:
    size, out, last = int(rate * 0.05), "", None
    for b in (x[i : i + size] for i in range(0, len(x) - size + 1, size)) if size else ():
        near = lambda f: abs(_tone(b, int(0.5 + size * f / rate) * rate / size, rate))  # noqa: E731, B023
        low, high = [near(f) for f in DTMF_LOW], [near(f) for f in DTMF_HIGH]
        floor = 5 * float(np.median(low + high))
        key = DTMF_KEYS[int(np.argmax(low))][int(np.argmax(high))] if max(low) > floor and max(high) > floor else None
        if key and key != last:
            out += key
        last = key
    return out
