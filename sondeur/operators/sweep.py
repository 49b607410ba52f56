"""All candidate streams of a signal at once, on arrays: for sweeps over so many parameters that a row per bit can't be afforded.
The single streams are also in operators.extract, as expressions over rows."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np

from . import spectral
from .extract import SEEDS, stride_grid


def sample_bytes(x: np.ndarray, bits: int) -> bytes:
    """Little-endian samples of their width; 24-bit ones are clipped to it, others wrap."""
    if bits == 24:
        x = np.clip(x, -(1 << 23), (1 << 23) - 1)
    u = np.asarray(x, np.int64) & ((1 << bits) - 1)
    return (u[..., None] >> (8 * np.arange(bits // 8)) & 255).astype(np.uint8).tobytes()


def _bits(name: str, bits: np.ndarray, least: int = 8) -> Iterator[tuple[str, bytes]]:
    if len(bits) // 8 >= least:
        for order in ("msb", "lsb"):
            yield f"{name}_{order}", spectral.packed(bits, order == "msb")


def gray(u: np.ndarray, bits: int) -> np.ndarray:
    k = 1
    while k < bits:
        u = u ^ (u >> k)
        k *= 2
    return u


def haar(x: np.ndarray, levels: int = 8) -> list[tuple[str, np.ndarray]]:
    details, a = [], x.astype(float)
    for k in range(1, levels + 1):
        if len(a) % 2:
            a = np.append(a, a[-1])
        details.append((f"cD{k}", (a[::2] - a[1::2]) / np.sqrt(2)))
        a = (a[::2] + a[1::2]) / np.sqrt(2)
    return [(f"cA{levels}", a), *details[::-1]]


def channel(x: np.ndarray, norm: np.ndarray, c: int, bits: int, exhaustive: bool = False) -> Iterator[tuple[str, bytes]]:
    """(source, data) of one channel."""
    u = x & ((1 << bits) - 1)
    n, low = len(x), min(bits, 16)
    as_bytes = lambda v: (v & 255).astype(np.uint8).tobytes()
    for b in range(low):
        yield from _bits(f"multi_bitplane_ch{c}_b{b}", u >> b & 1)
    for at in (0, 4)[: 2 if bits >= 8 else 1]:
        v = u[: n // 2 * 2] >> at & 15
        yield f"multi_nibble_ch{c}_b{at}_{at + 3}_p1", as_bytes(v[::2] << 4 | v[1::2])
        yield f"multi_nibble_ch{c}_b{at}_{at + 3}_p2", as_bytes(v[1::2] << 4 | v[::2])
    yield f"multi_byte_ch{c}_b0_7", as_bytes(u)
    if bits >= 16:
        yield f"multi_byte_ch{c}_b8_15", as_bytes(u >> 8)
    g, d = gray(u, bits), np.cumsum(u) & ((1 << bits) - 1)
    yield f"multi_gray_byte_ch{c}", as_bytes(g)
    yield f"multi_delta_byte_ch{c}", as_bytes(d)
    inv = ~x & ((1 << bits) - 1)
    yield f"multi_inverted_byte_ch{c}", as_bytes(inv)
    yield from _bits(f"multi_inverted_b0_ch{c}", inv & 1)
    yield from _bits(f"multi_combined_or03_ch{c}", ((u & 15) > 0).astype(np.uint8), 1)
    yield from _bits(f"multi_combined_xor03_ch{c}", np.bitwise_count(u & 15) & 1, 1)
    yield from _bits(f"multi_sign_bit_ch{c}", u >> (bits - 1) & 1, 1)
    yield f"channel_{c}_raw", sample_bytes(x, bits)
    if n > 1:
        yield f"rel_consec_diff_ch{c}", sample_bytes(np.diff(x), bits)
        yield from _bits(f"rel_parity_trans_ch{c}", (x[1:] ^ x[:-1]) & 1)
        yield from _bits(f"rel_zero_crossings_ch{c}", ((x[1:] >= 0) != (x[:-1] >= 0)).astype(np.uint8))
    for s, o in stride_grid(exhaustive):
        part = x[o::s]
        if len(part) >= 8:
            yield f"stride_samples_ch{c}_s{s}_o{o}", sample_bytes(part, bits)
        if len(part) >= 64:
            for b in range(low):
                yield from _bits(f"stride_bit_ch{c}_s{s}_o{o}_b{b}", u[o::s] >> b & 1)
    yield f"reverse_samples_ch{c}", sample_bytes(x[::-1], bits)
    yield from _bits(f"reverse_lsb_ch{c}", u[::-1] & 1)
    yield f"gray_samples_ch{c}", sample_bytes(g, bits)
    yield from _bits(f"gray_lsb_ch{c}", g & 1)
    yield f"delta_samples_ch{c}", sample_bytes(d, bits)
    yield from _bits(f"delta_lsb_ch{c}", d & 1)
    yield from _bits(f"phase_fft_ch{c}", spectral.phase_bits(norm))
    runs = [r.strip() for r in re.findall(rb"[ -~]{4,}", sample_bytes(x, bits)) if r.strip()]
    if runs:
        yield f"ascii_strings_ch{c}", b"\n".join(runs)
    if n:
        for layer, v in haar(x):
            v = np.rint(v).astype(np.int64)
            for b in range(16):
                yield from _bits(f"dwt_ch{c}_{layer}_b{b}", v >> b & 1)
    yield from _bits(f"parity_ch{c}", np.bitwise_count(u) & 1)
    for seed in SEEDS:
        own = random.Random(seed)
        yield from _bits(f"dsss_ch{c}_{seed}", (u & 1) ^ np.fromiter((own.randint(0, 1) for _ in range(n)), np.int64, n))
    yield from _bits(f"signal_polarity_inv_ch{c}", -x & 1)


def stereo(left: np.ndarray, right: np.ndarray, norm_l: np.ndarray, norm_r: np.ndarray, bits: int) -> Iterator[tuple[str, bytes]]:
    yield "layout_llll", sample_bytes(left, bits)
    yield "layout_rrrr", sample_bytes(right, bits)
    both = np.stack([left, right], 1)
    yield "layout_lrlr", sample_bytes(both.ravel(), bits)
    yield "layout_rlrl", sample_bytes(both[:, ::-1].ravel(), bits)
    pairs = both[: len(both) // 2 * 2].reshape(-1, 2, 2)
    yield "layout_llrr", sample_bytes(pairs.transpose(0, 2, 1).ravel(), bits)
    yield "layout_rrll", sample_bytes(pairs.transpose(0, 2, 1)[:, ::-1].ravel(), bits)
    for name, v in (("xor", left ^ right), ("diff", left - right), ("sum", left + right)):
        yield f"channel_{name}_0_1", sample_bytes(v, bits)
    yield "rel_ch_xor", sample_bytes(left ^ right, bits)
    yield "rel_ch_diff", sample_bytes(left - right, bits)
    phase = spectral.stereo_phase(norm_l, norm_r)
    if len(phase) > 8:
        yield from _bits("signal_phase_diff", (phase > 0).astype(np.uint8), 1)


def streams(raw: list[np.ndarray], norm: list[np.ndarray], bits: int, trailer: bytes = b"", exhaustive: bool = False) -> Iterator[tuple[str, bytes]]:
    for c, (x, y) in enumerate(zip(raw, norm)):
        yield from channel(x, y, c, bits, exhaustive)
    if len(raw) > 1:
        yield from stereo(raw[0], raw[1], norm[0], norm[1], bits)
    elif raw:
        yield "layout_mono_raw", sample_bytes(raw[0], bits)
    if trailer:
        yield "trailer", trailer
