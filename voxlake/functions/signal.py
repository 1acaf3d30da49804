"""Signal kernels on arrays of samples (D1-D11, D20): SQL where an expression can say it, Arrow batches where a recurrence can't.

The recurrences run over a batch of arrays at once: one step per sample, vectorised over the rows of equal length.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the rate that the decoder hears.
SPEECH_RATE = 16000.0


def rms(samples: Column) -> Column:
    """0 for no samples."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def normalize(samples: Column, target_db: float = -1.0, knee: float = 0.98) -> Column:
    """The peak at target_db, what exceeds the knee bent softly below 1; a peak under 1e-6 is left alone."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))

    def scaled(p: Column) -> Column:
        def bend(x: Column) -> Column:
            y = x.cast("double") * (F.lit(10 ** (target_db / 20)) / p)
            over = knee + (1 - knee) * F.tanh((F.abs(y) - knee) / (1 - knee))
            return F.when(F.abs(y) > knee, F.signum(y) * over).otherwise(y)

        return F.when(p < 1e-6, F.transform(samples, lambda x: x.cast("double"))).otherwise(F.transform(samples, bend))

    return F.when(F.size(samples) > 0, F.transform(F.array(peak), scaled)[0]).otherwise(F.array().cast("array<double>"))


def mono(left: Column, right: Column) -> Column:
    """D20."""
    return F.zip_with(left, right, lambda x, y: (x + y) / 2)


def low_pass(cutoff: float, rate: float, taps: int = 63) -> np.ndarray:
    """D3: a windowed sinc (four-term Blackman-Harris) of unity gain at zero."""
    if taps < 3:
        raise ValueError("a low pass needs three taps or more")
    n = np.arange(taps)
    # The window's cosine terms.
    window = sum(c * np.cos(2 * math.pi * k * n / (taps - 1)) for k, c in enumerate((0.35875, -0.48829, 0.14128, -0.01168)))
    h = 2 * cutoff / rate * np.sinc(2 * cutoff / rate * (n - (taps - 1) / 2)) * window
    return h / h.sum()


def filtered(x: np.ndarray, b: tuple[float, ...], a: tuple[float, ...]) -> np.ndarray:
    """y[n] = sum b[k] x[n-k] - sum a[k] y[n-k], rows at rest before they begin. x: (rows, samples); a starts at y[n-1]."""
    drive = sum(c * np.pad(x, ((0, 0), (k, 0)))[:, : x.shape[1]] for k, c in enumerate(b))
    y = np.zeros_like(drive)
    for n in range(x.shape[1]):
        y[:, n] = drive[:, n] - sum(c * y[:, n - k] for k, c in enumerate(a, 1) if n >= k)
    return y


def dc_block(x: np.ndarray, r: float = 0.995) -> np.ndarray:
    """D1."""
    return filtered(x, (1.0, -1.0), (-r,))


def high_pass(x: np.ndarray, rate: float, cutoff: float = 150.0, q: float = 0.7071) -> np.ndarray:
    """A biquad of the audio equaliser cookbook."""
    w = 2 * math.pi * cutoff / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return filtered(x, tuple(v / (1 + alpha) for v in ((1 + c) / 2, -1 - c, (1 + c) / 2)), (-2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)))


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Centred, zero outside. Rows at once, as a product with the windows of each row."""
    centre = len(h) // 2
    padded = np.pad(x, ((0, 0), (len(h) - 1 - centre, centre)))
    return np.lib.stride_tricks.sliding_window_view(padded, len(h), axis=1)[:, : x.shape[1]] @ h[::-1]


def resample(x: np.ndarray, source: float, target: float) -> np.ndarray:
    """Unchanged if the rates agree, else low-passed, then every k-th sample or interpolated from end to end."""
    if not x.shape[1] or abs(source - target) < 1:
        return x
    smooth = convolve(x, low_pass(min(source, target) / 2 * 0.9, source))
    ratio = source / target
    if ratio >= 1 and abs(ratio - round(ratio)) < 1e-6:
        return smooth[:, :: round(ratio)][:, : x.shape[1] // round(ratio)]
    size = int(x.shape[1] * target / source)
    at = np.arange(size) * ((x.shape[1] - 1) / max(1, size - 1))
    low = at.astype(int)
    high = np.minimum(low + 1, x.shape[1] - 1)
    return smooth[:, low] + (at - low) * (smooth[:, high] - smooth[:, low])


def by_rows(samples: Column, kernel: Callable[[np.ndarray], np.ndarray]) -> Column:
    """kernel, from (rows, samples) to (rows, samples), on a column of arrays: arrays of one length in a batch run together."""
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        out: list = [None] * len(batch)
        lengths = batch.map(lambda x: -1 if x is None else len(x))
        for length, rows in batch.groupby(lengths):
            places = [batch.index.get_loc(i) for i in rows.index]
            if length == 0:
                for p in places:
                    out[p] = []
            elif length > 0:
                for p, y in zip(places, kernel(np.stack(rows.to_numpy()).astype(float)), strict=True):
                    out[p] = y
        return pd.Series(out)

    return run(samples)


def conditioned(rows: DataFrame, samples: str, rate: float) -> DataFrame:
    """DC block, high pass, resample to the decoder's rate, normalise; each array from rest. The column is replaced."""
    shaped = rows.withColumn(samples, by_rows(F.col(samples), lambda x: resample(high_pass(dc_block(x), rate), rate, SPEECH_RATE)))
    return shaped.withColumn(samples, normalize(F.col(samples)))


def demodulated(iq_re: np.ndarray, iq_im: np.ndarray, rate: float, offset: float, deviation: float = 5000.0) -> np.ndarray:
    """D11's core: mix the carrier to zero and take the phase steps, in units of the deviation."""
    z = (iq_re + 1j * iq_im) * np.exp(-2j * np.pi * offset / rate * np.arange(len(iq_re)))
    return np.angle(z[1:] * np.conj(z[:-1])) * rate / (2 * np.pi * deviation)
