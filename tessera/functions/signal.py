"""Waveforms, one row at a time in NumPy: resampling, filters, spectrograms, cepstra, segmentation; Arrow UDFs over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(y: np.ndarray, rate: int, to: int) -> np.ndarray:
    """By the discrete Fourier transform: the spectrum is cut or filled up with zeros."""
    n, m = len(y), int(round(len(y) * to / rate))
    if n == 0 or m == 0 or n == m:
        return np.asarray(y, float)[:m]
    spec, keep = np.fft.rfft(y), min(n, m) // 2 + 1
    out = np.zeros(m // 2 + 1, complex)
    out[:keep] = spec[:keep]
    if min(n, m) % 2 == 0:  # the shared middle bin
        out[keep - 1] *= 0.5 if m > n else 2.0
    return np.fft.irfft(out, m) * (m / n)


def band_pass(y: np.ndarray, rate: int, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero phase, with the squared magnitude that a Butterworth band-pass run forwards and backwards has."""
    if not len(y):
        return np.asarray(y, float)
    f = np.fft.rfftfreq(len(y), 1 / rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (f**2 - low * high) / (f * (high - low))
        gain = 1 / (1 + w ** (2 * order))
    gain[0] = 0.0
    return np.fft.irfft(np.fft.rfft(y) * gain, len(y))


def frames(y: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Windows (Hann) around each hop, the ends mirrored."""
    half = width // 2
    y = np.pad(np.asarray(y, float), half, mode="reflect" if len(y) > half else "edge") if len(y) else np.zeros(width)
    count = 1 + max(0, len(y) - width) // hop
    at = np.arange(width)[None] + hop * np.arange(count)[:, None]
    return y[np.minimum(at, len(y) - 1)] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width))


def mel_bank(rate: int, width: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(low), mel(high or rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(width, 1 / rate)
    up, down = (f[None] - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f[None]) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(y: np.ndarray, rate: int, bands: int = 32, width: int = 512, hop: int = 128, floor_db: float = 120.0) -> np.ndarray:
    """frames x bands in decibels below the loudest, no lower than the floor."""
    power = (np.abs(np.fft.rfft(frames(y, width, hop))) ** 2) @ mel_bank(rate, width, bands).T
    top = max(power.max(initial=0.0), 1e-20)
    return np.maximum(10 * np.log10(np.maximum(power, 1e-20) / top), -floor_db)


def squashed(m: np.ndarray, steps: int, bands: int) -> np.ndarray:
    """To between 0 and 1, then to steps x bands by linear interpolation."""
    m = (m - m.min()) / max(m.max() - m.min(), 1e-9)
    for axis, size in ((0, steps), (1, bands)):
        at = np.linspace(0, m.shape[axis] - 1, size)
        lo = np.floor(at).astype(int)
        hi, w = np.minimum(lo + 1, m.shape[axis] - 1), at - lo
        w = w[:, None] if axis == 0 else w[None]
        m = m.take(lo, axis) * (1 - w) + m.take(hi, axis) * w
    return m


def mfcc(y: np.ndarray, rate: int, count: int = 13, normalise: bool = True, **how) -> np.ndarray:
    """frames x count: cosine transform (type 2, orthonormal) of the log mel bands."""
    m = log_mel(y, rate, **how)
    n = m.shape[1]
    basis = np.cos(np.pi / n * (np.arange(n)[:, None] + 0.5) * np.arange(count)[None]) * np.sqrt(2 / n)
    basis[:, 0] /= np.sqrt(2)
    c = m @ basis
    return (c - c.mean(0)) / (c.std(0) + 1e-6) if normalise else c


def segments(y: np.ndarray, rate: int, threshold_db: float = -40.0, least: int = 50, gap: int = 256) -> list[tuple[int, int]]:
    """[start, end) of stretches above the threshold below the loudest; gaps shorter than "gap" are bridged; all of y if none."""
    if not len(y):
        return []
    width = min(64, len(y))
    level = np.sqrt(np.convolve(np.asarray(y, float) ** 2, np.ones(width) / width, "same"))
    on = level > level.max() * 10 ** (threshold_db / 20)
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(int)))
    out: list[list[int]] = []
    for a, b in zip(edge[::2], edge[1::2]):
        if out and a - out[-1][1] < gap:
            out[-1][1] = int(b)
        else:
            out.append([int(a), int(b)])
    return [(a, b) for a, b in out if b - a >= least] or [(0, len(y))]


def spectral_features(rows: DataFrame, y: str, rate: int, steps: int = 6, bands: int = 32) -> DataFrame:
    """rows with mel: the squashed log-mel spectrogram, flat."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda a: squashed(log_mel(np.asarray(a, float), rate, bands, 64, 16), steps, bands).ravel())

    return rows.withColumn("mel", run(F.col(y)))


def cepstral_features(rows: DataFrame, y: str, rate: int, count: int = 13) -> DataFrame:
    """rows with mfcc: the mean and deviation of each coefficient."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        def one(a):
            m = mfcc(np.asarray(a, float), rate, count, False, width=64, hop=16, bands=20)
            return np.r_[m.mean(0), m.std(0)]

        return s.map(one)

    return rows.withColumn("mfcc", run(F.col(y)))


def segmented(rows: DataFrame, y: str, rate: int, **how) -> DataFrame:
    """A row for each segment, with seg, start, end and its samples; what cannot be segmented stays one segment."""
    others = [f for f in rows.schema.fields if f.name != y]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"{y} array<double>", "seg int", "start int", "end int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for _, r in b.iterrows():
                a = np.asarray(r[y], float)
                out += [{**{f.name: r[f.name] for f in others}, y: a[i:j], "seg": k, "start": i, "end": j} for k, (i, j) in enumerate(segments(a, rate, **how))]
            if out:
                yield pd.DataFrame(out)[[*[f.name for f in others], y, "seg", "start", "end"]]

    return rows.select(*[f.name for f in others], F.col(y).cast("array<double>").alias(y)).mapInPandas(run, schema)


def segmented_by(rows: DataFrame, y: str, rate: int, by: str, overrides: dict[str, dict], **how) -> DataFrame:
    """segmented, with other parameters for the contexts (values of by) that overrides names; null contexts have the common ones."""
    out = segmented(rows.where(F.col(by).isNull() | ~F.col(by).isin(list(overrides))) if overrides else rows, y, rate, **how)
    for name, own in overrides.items():
        out = out.unionByName(segmented(rows.where(F.col(by) == name), y, rate, **(how | own)))
    return out


def embedded(rows: DataFrame, y: str, model, size: int) -> DataFrame:
    """rows with embedding: what a user's callable (list of arrays -> matrix) makes of each batch."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        m = np.asarray(model([np.asarray(a, float) for a in s]), float)
        assert m.shape == (len(s), size), m.shape
        return pd.Series(list(m), index=s.index)

    return rows.withColumn("embedding", run(F.col(y)))


def frames_within(frames_: DataFrame, spans: DataFrame, at: Column, start: Column, end: Column, on: str) -> DataFrame:
    """Frames whose time lies in [start, end) of a span of the same recording: an equi-join on the recording, then the range."""
    return frames_.join(spans, on).where((at >= start) & (at < end))
