"""What an analysis says of one file's channels as a whole, on arrays: summary, odd stretches, fingerprint, and what its modulations carry."""

from __future__ import annotations

import re

import numpy as np

from . import decode, spectral
from .scan import INTELLIGENCE, _INNER, finder


def summary(x: np.ndarray, rate: int) -> dict:
    """Of raw samples: duration, dominant frequency (0 of under 2,048 samples), levels, share of samples from 0 up, and the lag and rate at which the envelope repeats (None if it doesn't)."""
    out = {"duration_s": len(x) / rate if rate else 0.0, "dominant_hz": 0.0, "rms": 0.0, "peak": 0.0, "positive_ratio": 0.0, "repeat_lag": None, "repeat_hz": None}
    if not len(x) or not rate:
        return out
    x = x.astype(float)
    freqs, _, mags = spectral.stft(x, rate, 2048, 1024)
    if len(mags):
        out["dominant_hz"] = float(freqs[mags.mean(0).argmax()])
    out |= {"rms": float(np.sqrt(np.mean(x * x))), "peak": float(np.abs(x).max()), "positive_ratio": float((x >= 0).mean())}
    e = spectral.envelope(x, int(rate * 0.01) or 100)
    e = e - e.mean()
    size = 1 << (2 * len(e) - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(e, size)) ** 2, size)[: min(5000, len(e))]
    if len(r) > 10 and r[0] > 0:
        r = r / r[0]
        k = np.arange(10, len(r) - 1)
        at = k[(r[k] > r[k - 1]) & (r[k] > r[k + 1]) & (r[k] > 0.3)]
        if len(at):
            out |= {"repeat_lag": int(at[0]), "repeat_hz": float(rate / at[0])}
    return out


def anomalies(x: np.ndarray, k: int = 2048, threshold: float = 2.5) -> list[dict]:
    """Stretches whose rolling variance lies more than threshold deviations off its mean; places at most k apart are one. None of under 4 k samples."""
    n = len(x)
    if n < 4 * k:
        return []
    x = x.astype(float)
    lo = np.clip(np.arange(n) - k // 2, 0, n)
    hi = np.clip(np.arange(n) - k // 2 + k, 0, n)
    moving = lambda v: (t := np.concatenate(([0.0], np.cumsum(v))))[hi] / k - t[lo] / k
    v = np.maximum(0, moving(x * x) - moving(x) ** 2).astype(np.float32).astype(float)
    mean, sd = v.mean(), v.std()
    at = np.flatnonzero(np.abs(v - mean) > threshold * sd) if sd else np.zeros(0, int)
    if not len(at):
        return []
    runs = np.split(at, np.flatnonzero(np.diff(at) > k) + 1)
    out = []
    for r in runs:
        inside = v[r[0] : r[-1]]
        m = float(inside.mean()) if len(inside) else float(v[r[0]])
        out.append({"start": int(r[0]), "end": int(r[-1]), "length": int(r[-1] - r[0]), "mean_variance": m, "ratio": m / (mean + 1e-10)})
    return out


def silence(x: np.ndarray, rate: int, threshold_db: float = -45.0, least_s: float = 0.1) -> list[tuple[float, float]]:
    """(start, end) in s of runs of quiet 20 ms blocks."""
    size = int(rate * 0.02) or 100
    n = len(x) // size
    if not n or not rate:
        return []
    quiet = 20 * np.log10(np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(1)) + 1e-10) < threshold_db
    edges = np.flatnonzero(np.diff(np.concatenate(([0], quiet.astype(np.int8), [0]))))
    return [(a * size / rate, len(x) / rate if z == n else z * size / rate) for a, z in edges.reshape(-1, 2).tolist() if (z - a) * size / rate >= least_s]


def fingerprint(channels: list[np.ndarray], rate: int) -> dict:
    """Levels of each channel, correlation of the first two, silence and spectrum of the first, and reasons to look closer. Channels are normalised."""
    if not channels or not len(channels[0]):
        return {}
    levels = []
    for c, x in enumerate(channels):
        peak, rms = float(np.abs(x).max()), float(np.sqrt(np.mean(x * x)))
        levels.append({"ch": c, "peak": peak, "rms": rms, "crest": peak / (rms + 1e-10), "dc_offset": float(x.mean()), "dynamic_range_db": float(20 * np.log10(peak / (rms + 1e-10))) if peak and rms else 0.0})
    x, duration = channels[0], len(channels[0]) / rate if rate else 0.0
    both = len(channels) > 1 and channels[0].std() > 0 and channels[1].std() > 0
    quiet = silence(x, rate)
    centroid, bandwidth, roll_off, skewness, kurtosis, peak_hz = next(iter(spectral.spectral_profile(x, rate)))
    reasons = []
    for v in levels:  # Fixed values: the limits.
        if abs(v["dc_offset"]) > 0.01:
            reasons.append(f"DC offset of channel {v['ch']}: {v['dc_offset']:.4f}")
        if v["crest"] > 15.0:
            reasons.append(f"crest factor of channel {v['ch']}: {v['crest']:.2f}")
    if kurtosis > 10.0:
        reasons.append(f"spectral kurtosis: {kurtosis:.2f}")
    return {
        "duration_s": duration, "sample_rate": rate, "channels": len(channels), "correlation": float(np.corrcoef(channels[0], channels[1])[0, 1]) if both else 0.0,
        "silence_ratio": sum(z - a for a, z in quiet) / duration if duration else 0.0, "centroid": centroid, "bandwidth": bandwidth, "roll_off": roll_off,
        "skewness": skewness, "kurtosis": kurtosis, "dominant_hz": peak_hz, "levels": levels, "anomalous": bool(reasons), "reasons": reasons,
    }


def intelligence(data: bytes, flag: str | None = None) -> list[dict]:
    """type, offset, value, confidence of the weighted patterns and of flags of one's own name; a hash of fewer than five different characters counts a tenth."""
    table = {k: p for k, (p, _) in INTELLIGENCE.items()}
    weights = {k: c for k, (_, c) in INTELLIGENCE.items()}
    if flag:
        own = f"Specific Flag ({flag.upper()})"
        table[own], weights[own] = rf"(?i){re.escape(flag)}\s*\{{{_INNER}+\}}", 1.0
    out = []
    for name, found in zip(table, finder(table)(data)):
        for m in found:
            value = m[0].decode("utf-8", "ignore").strip()
            if value:
                dull = name.startswith("Hex Hash") and len(set(value)) < 5
                out.append({"type": name, "offset": m.start(), "value": value, "confidence": weights[name] * (0.1 if dull else 1.0)})
    return sorted(out, key=lambda h: (h["offset"], -h["confidence"]))


def coordinate(channels: list[np.ndarray], rate: int, flag: str | None = None, depth: int = 2, demodulators: dict | None = None) -> dict:
    """Fingerprint, carriers, harmonics, sweeps, modulations, findings in what demodulates and decodes, best first, and recommendations. Rates over 22,050 Hz are halved first, for demodulators too.
    demodulators: name -> (samples, rate, parameters) -> bytes, tried beside those of the detected modulations."""
    if rate > 22_050:
        channels, rate = [x[::2] for x in channels], rate // 2
    x = channels[0]
    prints, found = fingerprint(channels, rate), spectral.carriers(x, rate)
    modulations = spectral.detected(x, rate, spectral.MODULATIONS)
    demodulated = []
    for name, score in modulations:
        if score < 0.4:
            continue
        # The stronger tone is the mark; AFSK has the usual tones of modems.
        peaks = spectral.fsk(x, rate)[1] if name == "FSK" else []
        mark, space = peaks[:2] if len(peaks) > 1 else (1200.0, 2200.0)
        data = spectral.demodulate(name, x, rate, spectral.symbol_rate(x, rate), prints.get("dominant_hz", 1000.0), mark, space)
        if len(data) >= 4:
            demodulated.append((name, score, data))
    for name, run in (demodulators or {}).items():
        data = run(x, rate, {"baud": spectral.symbol_rate(x, rate), "carrier": prints.get("dominant_hz", 1000.0)})
        if len(data) >= 4:
            demodulated.append((name, 1.0, data))
    findings = [{"source": name, "path": ["demod_raw"], **h, "confidence": h["confidence"] * score} for name, score, data in demodulated for h in intelligence(data, flag)]
    seen: set[bytes] = set()
    for name, _, data in demodulated:
        for r in decode.decode_all(data, depth, flag=flag):
            if r["data"] not in seen:
                seen.add(r["data"])
                findings += [{"source": name, "path": r["path"], **h, "confidence": min(1.0, max(0.0, h["confidence"] * (1 - 0.1 * r["entropy"] / 8)))} for h in intelligence(r["data"], flag)]
    findings.sort(key=lambda f: -f["confidence"])
    advice = []
    if modulations and modulations[0][1] > 0.6:
        advice.append(f"{modulations[0][0]} is likely ({modulations[0][1]:.1%}): demodulate it with settings of your own")
    if modulations and not findings:
        advice.append("a modulated carrier, but nothing readable in it: try another band or frequency shift")
    if findings:
        advice.append(f"{findings[0]['type']} recovered by {' > '.join(findings[0]['path'])}: {findings[0]['value']}")
    return {
        "fingerprint": prints, "carriers": found, "harmonics": spectral.harmonics([c[0] for c in found]), "sweeps": spectral.sweeps(x, rate),
        "modulations": modulations, "decoded": len(seen), "findings": findings, "recommendations": advice,
    }
