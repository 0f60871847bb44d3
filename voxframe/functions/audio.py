"""Clip lengths, context sizes, and the numpy kernels of the feature job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.text import seeded_key

# Fixed values of the feature definition
SAMPLE_RATE = 16_000
WINDOW = 400
HOP = 160
FRAMES = 3_000
FRAMES_PER_SECOND = 50.0
MAX_CONTEXT = 1_500
MAX_JITTER = 64
MAX_CLIP_SECONDS = 29.0


def clip_duration(samples: Column) -> Column:
    """Seconds of a 16 kHz sample array."""
    return F.size(samples) / F.lit(float(SAMPLE_RATE))


def _clamp(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.lit(MAX_CONTEXT)))


def context_frames(
    duration: Column, jitter_key: Column | None = None, seed: int = 0
) -> Column:
    """Context frames of a clip: 50 a second, halves to even, within 1..1500.

    With a `jitter_key` a seeded offset of at most min(64, n div 3) is added.
    """
    n = _clamp(F.bround(duration.cast("double") * FRAMES_PER_SECOND, 0).cast("int"))
    if jitter_key is None:
        return n
    reach = F.least(F.lit(MAX_JITTER), F.floor(n / 3).cast("int"))
    draw = F.conv(F.substring(seeded_key(seed, jitter_key), 1, 8), 16, 10).cast("long")
    return _clamp((n + F.pmod(draw, 2 * reach + 1) - reach).cast("int"))


def mel_filters(n_mels: int) -> np.ndarray:
    """Triangular filters on the area-normalised mel scale, (n_mels, 201)."""
    step = 200.0 / 3.0  # linear below 1 kHz, logarithmic above
    knee, growth = 1000.0 / step, np.log(6.4) / 27.0

    def to_hz(mel: np.ndarray) -> np.ndarray:
        return np.where(mel < knee, mel * step, 1000.0 * np.exp(growth * (mel - knee)))

    top = knee + np.log(SAMPLE_RATE / 2 / 1000.0) / growth
    edges = to_hz(np.linspace(0.0, top, n_mels + 2))
    bins = np.linspace(0.0, SAMPLE_RATE / 2, WINDOW // 2 + 1)
    rise = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    area = 2.0 / (edges[2:] - edges[:-2])
    return np.maximum(0.0, np.minimum(rise, fall)) * area[:, None]


def log_mel(samples: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-mel frames that touch the clip, and the value of every later frame.

    The clip counts as padded with silence to 30 s; silent frames are all
    equal, so they are returned as one number, not 3,000 columns.
    """
    limit = FRAMES * HOP
    x = np.asarray(samples, dtype=np.float64)[:limit]
    used = min(FRAMES, (len(x) + WINDOW // 2 + HOP - 1) // HOP)
    half = WINDOW // 2
    padded = np.zeros(max(used * HOP + WINDOW, half + 1))
    padded[: len(x)] = x
    head = padded[1 : half + 1][::-1]
    if used == FRAMES:  # the 30 s edge is mirrored too
        whole = np.zeros(limit)
        whole[: len(x)] = x
        track = np.concatenate([head, whole, whole[-half - 1 : -1][::-1]])
    else:
        track = np.concatenate([head, padded])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    frames = np.lib.stride_tricks.sliding_window_view(track, WINDOW)[::HOP][:used]
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    logs = np.log10(np.maximum(filters @ power.T, 1e-10))
    peak = logs.max() if logs.size else -10.0
    if used < FRAMES:
        peak = max(peak, -10.0)
    scaled = (np.maximum(logs, peak - 8.0) + 4.0) / 4.0
    return scaled, (max(-10.0, peak - 8.0) + 4.0) / 4.0


def sinc_phases(rate: int, target: int = SAMPLE_RATE, taps: int = 32) -> np.ndarray:
    """Hann-windowed sinc, one row for each place an output can take between samples."""
    common = int(np.gcd(rate, target))
    step, phases = rate // common, target // common
    cut = min(1.0, phases / step)
    reach = int(np.ceil(taps / cut))
    gap = np.arange(phases)[:, None] / phases - np.arange(-reach + 1, reach + 1)[None, :]
    kernel = cut * np.sinc(cut * gap) * (0.5 + 0.5 * np.cos(np.pi * gap / reach))
    kernel[np.abs(gap) > reach] = 0.0
    return kernel


def resample(samples: np.ndarray, rate: int, kernel: np.ndarray, target: int = SAMPLE_RATE) -> np.ndarray:
    """Band-limited resampling with the kernels of `sinc_phases(rate, target)`."""
    x = np.asarray(samples, dtype=np.float64)
    if rate == target or len(x) == 0:
        return x
    phases, width = kernel.shape
    step = rate * phases // target
    padded = np.zeros(len(x) + 2 * width)
    padded[width // 2 - 1 : width // 2 - 1 + len(x)] = x
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(-(-len(x) * target // rate))
    for first in range(min(phases, len(out))):  # outputs of one phase share a kernel
        at = np.arange(first, len(out), phases) * step // phases
        out[first::phases] = views[at] @ kernel[first * step % phases]
    return out
