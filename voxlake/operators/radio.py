"""Narrow-band FM receivers over recordings in blocks (D11), and arms of a replay as one job from a recording to WAV files.

Every filter of the receiver is linear, so a recording is demodulated block by block in parallel and comes out as if it were one array:

* the oscillator's phase follows from a sample's absolute number;
* the channel filter is a convolution of a block with the samples just before it (overlap-save);
* de-emphasis, y[n] = a x[n] + c y[n-1], is an affine map of the state over a block; maps of blocks compose, and what lies so far back that c**n vanishes adds nothing;
* the resampler takes output q from input around q * down / up, so a block whose size is a multiple of ``down`` yields a whole number of outputs.

A block needs some samples of its neighbours. They are cut from those as short arrays and joined by block, so that a recording's blocks may lie on any
executor. Blocks are (capture, block, re, im), all of ``size`` samples but the last of a capture, as baseband_blocks reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.signal import SPEECH_RATE, low_pass
from ..scratch import written
from . import audio, signal

#: Taps of the channel filter, the resampler's window (Kaiser) and half length per step, milliseconds of a power frame, least power in decibels.
TAPS, KAISER, HALF, FRAME_MS, LEAST_DB = 511, 5.0, 10, 1.0, -300.0
#: A state that has shrunk by this much adds nothing.
FORGOTTEN = 1e-20


@dataclass(frozen=True)
class Receiver:
    """Settings of an arm: width of the channel and offset of its centre in hertz, rate of the audio, time constant of the de-emphasis (None: without)."""

    bandwidth: float
    offset: float = 0.0
    audio_rate: float = 37_500.0
    deemphasis_us: float | None = 750.0

    def steps(self, rate: float) -> tuple[int, int]:
        """up, down: the audio's rate over the recording's in lowest terms."""
        g = math.gcd(int(self.audio_rate), int(rate))
        return int(self.audio_rate) // g, int(rate) // g

    def decay(self, rate: float) -> float:
        return 1 - 1 / (1 + rate * self.deemphasis_us * 1e-6) if self.deemphasis_us else 0.0

    def channel(self, rate: float) -> np.ndarray:
        if self.bandwidth >= rate:
            raise ValueError(f"a channel of {self.bandwidth} Hz is wider than the recording")
        return low_pass(self.bandwidth / 2, rate, TAPS)


def resampler(up: int, down: int) -> np.ndarray:
    """A windowed sinc below both rates, of gain `up` for the zeros between samples."""
    most = max(up, down)
    n = np.arange(-HALF * most, HALF * most + 1)
    h = np.sinc(n / most) / most * np.kaiser(len(n), KAISER)
    return up * h / h.sum()


def resampled(x: np.ndarray, first: int, start: int, count: int, up: int, down: int) -> np.ndarray:
    """Outputs start to start + count; x[0] is input number `first`, and inputs outside of x are zero."""
    h = resampler(up, down)
    half = len(h) // 2
    q = np.arange(start, start + count, dtype=np.int64)
    newest, phase = np.divmod(q * down + half, up)
    n_taps = -(-len(h) // up)
    padded = np.concatenate([np.zeros(n_taps), x, np.zeros(n_taps + 1)])
    views = np.lib.stride_tricks.sliding_window_view(padded, n_taps)
    out = np.zeros(count)
    for p in np.unique(phase):
        rows = np.flatnonzero(phase == p)
        taps = np.zeros(n_taps)
        own = h[p::up]
        taps[: len(own)] = own
        at = newest[rows] - first + 1  # where the window that ends with the newest input begins in padded
        inside = (at >= 0) & (at < len(views))
        out[rows[inside]] = views[at[inside]] @ taps[::-1]
    return out


def decayed(x: np.ndarray, c: float, span: int = 256) -> np.ndarray:
    """y[n] = (1 - c) x[n] + c y[n-1] from rest: within spans as a product with the powers of c, over spans one step each."""
    if c == 0:
        return x.copy()
    n = -(-len(x) // span)
    lag = np.subtract.outer(np.arange(span), np.arange(span))
    powers = np.where(lag >= 0, c ** np.maximum(lag, 0), 0.0)
    y = (1 - c) * np.pad(x, (0, n * span - len(x))).reshape(n, span) @ powers.T
    tail, state = c ** np.arange(1, span + 1), 0.0
    for row in y:
        row += tail * state
        state = row[-1]
    return y.ravel()[: len(x)]


def mixed(x: np.ndarray, start: int, offset: float, rate: float) -> np.ndarray:
    """The carrier at zero. Whole hertz are reduced in integers, so that the phase is as exact after an hour as at first."""
    n = np.arange(start, start + len(x), dtype=np.int64)
    turns = (n * int(offset) % int(rate)) / rate if float(offset).is_integer() and float(rate).is_integer() else np.mod(n * (offset / rate), 1.0)
    return x * np.exp(-2j * math.pi * turns) if offset else x


def with_edges(blocks: DataFrame, columns: list[str], before: int, after: int) -> DataFrame:
    """blocks with <column>_before and <column>_after: the last samples of the block before and the first of the one after, as many as are asked for."""
    shifted = lambda step, name, cut: blocks.select("capture", (F.col("block") + step).alias("block"), *[cut(F.col(c)).alias(f"{c}_{name}") for c in columns])
    last = shifted(1, "before", lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - before + 1), F.lit(before)))
    first = shifted(-1, "after", lambda c: F.slice(c, F.lit(1), F.lit(after)))
    return blocks.join(last, ["capture", "block"], "left").join(first, ["capture", "block"], "left")


def _reach(receiver: Receiver, rate: float) -> int:
    """Audio samples on either side that the resampler needs."""
    up, down = receiver.steps(rate)
    return HALF * max(up, down) // up + 2


def _received(receiver: Receiver, rate: float, size: int):
    """Per block: audio from `reach` samples before it to as many after it, de-emphasised from rest, and sums of power per frame."""
    taps, reach, c = receiver.channel(rate), _reach(receiver, rate), receiver.decay(rate)
    per_frame = max(1, round(rate * FRAME_MS / 1000))
    side = lambda row, name: np.zeros(0) if row[f"re_{name}"] is None else np.asarray(row[f"re_{name}"], float) + 1j * np.asarray(row[f"im_{name}"], float)

    def one(row: dict) -> dict:
        start, own = row["block"] * size, np.asarray(row["re"], float) + 1j * np.asarray(row["im"], float)
        left, right = side(row, "before"), side(row, "after")
        x = np.concatenate([np.zeros(reach + TAPS - len(left), complex), left, own, right])
        x = mixed(x, start - reach - TAPS, receiver.offset, rate)
        # Summed directly: a transform would leave rounding of the loudest sample where the channel is silent, and an angle there.
        z = np.convolve(x.real, taps)[: len(x)] + 1j * np.convolve(x.imag, taps)[: len(x)]
        # Sample n of the audio is the step from sample n to n + 1 of the channel.
        steps = np.angle(z[TAPS + 1 :] * np.conj(z[TAPS:-1]))[: size + 2 * reach]
        if not row["block"]:
            steps[:reach] = 0  # before the recording
        heard = decayed(steps, c)
        level = np.abs(z[reach + TAPS : reach + TAPS + len(own)]) ** 2
        frame = (start + np.arange(len(own))) // per_frame
        cuts = np.flatnonzero(np.diff(frame, prepend=-1)) if len(own) else np.zeros(0, int)
        return {
            "capture": row["capture"], "block": row["block"], "audio": heard, "state": float(heard[min(size, len(heard)) - 1]) if len(heard) else 0.0,
            "frame": frame[cuts], "level": np.add.reduceat(level, cuts) if len(cuts) else level, "samples": np.diff(np.append(cuts, len(own))),
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame([one(row)])

    return run


def _settled(receiver: Receiver, rate: float, size: int):
    """Per block: the state that came in fades over its audio, which then is resampled."""
    reach, c, (up, down) = _reach(receiver, rate), receiver.decay(rate), receiver.steps(rate)

    def one(row: dict) -> np.ndarray:
        y = np.array(row["audio"], float)
        if row["came"]:
            y += row["came"] * c ** np.arange(1, len(y) + 1)
        start = row["block"] * size
        # The audio has one sample less than the recording; in the last block the outputs end with it.
        ends = start - reach + len(y) if row["is_last"] else None
        first, last = start // down * up, (start + size) // down * up
        if ends is not None:
            last = min(last, -(-ends * up // down))
        return resampled(y, start - reach, first, max(0, last - first), up, down)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame({"capture": [row["capture"]], "block": [row["block"]], "samples": [one(row)]})

    return run


def block_size(receiver: Receiver, rate: float, size: int) -> int:
    """Samples of audio that a block of a recording becomes."""
    up, down = receiver.steps(rate)
    if size % down:
        raise ValueError(f"blocks of {size} samples don't become whole samples of audio: take a multiple of {down}")
    if size < TAPS + _reach(receiver, rate):
        raise ValueError(f"blocks of {size} samples are shorter than the filters reach")
    return size // down * up


def demodulated(blocks: DataFrame, rate: float, size: int, receiver: Receiver) -> tuple[DataFrame, DataFrame]:
    """Audio (capture, block, samples) at the receiver's rate, in blocks of block_size samples, and power (capture, frame, power) of the channel in
    frames of a millisecond, the last one shorter. A capture of one sample has no audio, one of none has no block."""
    block_size(receiver, rate, size)
    reach, c = _reach(receiver, rate), receiver.decay(rate)
    edged = with_edges(blocks.select("capture", "block", "re", "im").filter(F.size("re") > 0), ["re", "im"], reach + TAPS, reach + 1)
    kind = blocks.schema["capture"].dataType.simpleString()
    schema = f"capture {kind}, block long, audio array<double>, state double, frame array<long>, level array<double>, samples array<long>"
    received = written(edged.mapInPandas(_received(receiver, rate, size), schema), "received")
    frames = received.select("capture", F.inline(F.arrays_zip("frame", "level", "samples"))).groupBy("capture", "frame").agg((F.sum("level") / F.sum("samples")).alias("mean"))
    power = frames.select("capture", "frame", (10 * F.log10(F.greatest("mean", F.lit(10 ** (LEAST_DB / 10))))).alias("power"))
    # State at a block's start: that of the block before, plus what is left of the ones before it.
    back = 1 if c == 0 else max(1, math.ceil(math.log(FORGOTTEN) / (size * math.log(c))))
    order = Window.partitionBy("capture").orderBy("block")
    earlier = F.collect_list("state").over(order.rowsBetween(-back, -1))
    came = F.aggregate(earlier, F.lit(0.0), lambda s, x: x + s * c**size)
    states = received.select("capture", "block", came.alias("came"), F.lead("block").over(order).isNull().alias("is_last"))
    settled = received.select("capture", "block", "audio").join(states, ["capture", "block"])
    return settled.mapInPandas(_settled(receiver, rate, size), f"capture {kind}, block long, samples array<double>"), power


def cut_lists(levels: dict[str, DataFrame], arms: dict[str, Receiver], **options) -> DataFrame:
    """Segments (capture, segment, start_s, end_s), numbered in time, of the widest arm; all arms are cut along them."""
    widest = max(sorted(arms), key=lambda a: arms[a].bandwidth)
    found = signal.segments(levels[widest], "capture", "frame", "power", 1000 / FRAME_MS, **options)
    return found.withColumn("segment", F.row_number().over(Window.partitionBy("capture").orderBy("start_s")) - 1)


def replay(blocks: DataFrame, rate: float, size: int, arms: dict[str, Receiver], squelch_db: dict[str, float] | None = None, segments: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Clips (arm, capture, segment, samples at the decoder's rate), and the cut list that all arms share (given or planned).

    Every arm has a clip for every segment, if an empty one, so that numbers name the same transmission in all arms. Cuts come from the channel's power, never
    from the audio. An arm with squelch_db is gated where its followed power lies below its own noise floor plus so much. Power frames are whole milliseconds,
    so the recording's rate is a multiple of 1,000.
    """
    if rate % 1000:
        raise ValueError("power frames need a rate in whole kilohertz")
    heard = {name: tuple(written(x, name) for x in demodulated(blocks, rate, size, r)) for name, r in arms.items()}
    if segments is None:
        segments = written(cut_lists({name: power for name, (_, power) in heard.items()}, arms, **options), "cut-list")
    clips = None
    for name, receiver in arms.items():
        sound, power = heard[name]
        frames, over = None, (squelch_db or {}).get(name)
        if over is not None:
            followed = signal.squelch(power, "capture", "frame", "power", 0.0, 1000 / FRAME_MS)
            frames = followed.join(signal.noise_floor(power, "capture", "power"), "capture").withColumn("open", F.col("level") >= F.col("floor") + over)
        scale = receiver.audio_rate * FRAME_MS / 1000
        own = audio.arm_clips(sound, frames, segments, receiver.audio_rate, scale, block_size(receiver, rate, size)).select(F.lit(name).alias("arm"), "capture", "segment", "samples")
        clips = own if clips is None else clips.unionByName(own)
    return clips, segments


def clip_name(capture: Column, segment: Column) -> Column:
    """capture/NNNN_sent.wav"""
    return F.concat(F.regexp_replace(capture, r"\.\w+$", ""), F.lit("/"), F.lpad(segment.cast("string"), F.greatest(F.lit(4), F.length(segment.cast("string"))), "0"), F.lit("_sent.wav"))


def write_arms(clips: DataFrame, folder: str) -> None:
    """folder/arm/capture/NNNN_sent.wav."""
    from ..sources.files import write_wavs

    named = clips.select(F.concat("arm", F.lit("/"), clip_name(F.col("capture"), F.col("segment"))).alias("name"), "samples")
    write_wavs(written(named, "clips"), "name", "samples", int(SPEECH_RATE), folder)
