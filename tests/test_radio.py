"""The receiver in blocks against whole arrays, and a replay from recordings to WAV files."""

import math
import struct
import wave

import numpy as np
import pytest

from voxlake.functions import signal as S
from voxlake.operators import radio
from voxlake.plans import signal as plans
from voxlake.sources import files


def whole(x, rate, r):
    """Audio and power of a whole recording, filter by filter, in plain steps."""
    x = np.asarray(x, complex) * np.exp(-2j * np.pi * r.offset / rate * np.arange(len(x)))
    z = np.convolve(x, S.low_pass(r.bandwidth / 2, rate, 511))[: len(x)]
    frame = round(rate / 1000)
    power = [10 * math.log10(max(np.mean(np.abs(z[i : i + frame]) ** 2), 1e-30)) for i in range(0, len(z), frame)]
    steps, y, state = np.angle(z[1:] * np.conj(z[:-1])), [], 0.0
    a = 1 / (1 + rate * r.deemphasis_us * 1e-6) if r.deemphasis_us else 1.0
    for s in steps:
        state = a * s + (1 - a) * state
        y.append(state)
    g = math.gcd(int(rate), int(r.audio_rate))
    up, down = int(r.audio_rate) // g, int(rate) // g
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.kaiser(len(n), 5.0)
    spread = np.zeros(len(y) * up + 1)
    spread[: len(y) * up : up] = y
    return np.convolve(spread, up * h / h.sum())[half:][: len(y) * up : down], np.array(power)


def recording(rate, n, seed=0, bursts=((0.1, 0.3), (0.5, 0.8)), offset=3000.0):
    """Noise with two modulated carriers, and a stretch of digital silence."""
    r = np.random.default_rng(seed)
    t = np.arange(n) / rate
    x = 0.01 * (r.normal(size=n) + 1j * r.normal(size=n))
    for k, (a, b) in enumerate(bursts):
        own = slice(int(a * n), int(b * n))
        x[own] += 0.5 * np.exp(2j * np.pi * (offset * t[own] + 2.0 * np.sin(2 * np.pi * (400 + 300 * k) * t[own])))
    x[int(0.9 * n) : int(0.93 * n)] = 0
    return x


def in_blocks(spark, captures, size):
    rows = [(c, k // size, [float(v) for v in x[k : k + size].real], [float(v) for v in x[k : k + size].imag]) for c, x in captures.items() for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, "capture string, block long, re array<double>, im array<double>").repartition(5)


def joined(audio):
    out = {}
    for r in sorted(audio.collect(), key=lambda r: (r.capture, r.block)):
        out[r.capture] = np.concatenate([out.get(r.capture, np.zeros(0)), r.samples])
    return out


@pytest.mark.parametrize(("rate", "size", "r"), [
    (250_000, 1000, radio.Receiver(25_000, 3000.0)), (250_000, 4500, radio.Receiver(12_500, -1250.5)), (40_000, 640, radio.Receiver(8000, 0.0, 37_500.0, None)), (48_000, 600, radio.Receiver(9000, 500.0, 16_000.0, 75.0)),
])
def test_blocks_give_the_whole_signals_audio_and_power(spark, rate, size, r):
    captures = {"a": recording(rate, 9001, 1), "b": recording(rate, 4 * size, 2), "c": recording(rate, 2 * size + 1, 3), "d": recording(rate, 300, 4), "e": recording(rate, 1, 5)}
    audio, power = radio.demodulated(in_blocks(spark, captures, size), rate, size, r)
    got, levels = joined(audio), {}
    for row in sorted(power.collect(), key=lambda p: (p.capture, p.frame)):
        levels.setdefault(row.capture, []).append(row.power)
    for name, x in captures.items():
        sound, track = whole(x, rate, r)
        assert len(got[name]) == len(sound) and np.allclose(got[name], sound, rtol=0, atol=1e-9), name
        assert len(levels[name]) == len(track) and np.allclose(levels[name], track, rtol=0, atol=1e-6), name
    sizes = {(a.capture, a.block): len(a.samples) for a in audio.collect()}
    assert {n for (c, b), n in sizes.items() if (c, b + 1) in sizes} == {radio.block_size(r, rate, size)}


def test_a_mistuned_receiver_hears_less(spark):
    rate, size = 250_000, 5000
    n = np.arange(50_000)
    tone = np.exp(1j * (2 * np.pi * 20_000 / rate * n + 2.0 * np.sin(2 * np.pi * 1000 / rate * n)))
    blocks = in_blocks(spark, {"x": tone}, size)

    def heard(offset):
        y = joined(radio.demodulated(blocks, rate, size, radio.Receiver(16_000, offset))[0])["x"][500:]
        spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y)))) ** 2
        at = np.abs(np.fft.rfftfreq(len(y), 1 / 37_500) - 1000) < 60
        return spectrum[at].sum() / spectrum[1:].sum()

    assert heard(20_000.0) > 0.5 > 0.2 > heard(-40_000.0)


def test_block_sizes_that_do_not_fit_are_named():
    with pytest.raises(ValueError, match="multiple of 20"):
        radio.block_size(radio.Receiver(25_000), 250_000, 1010)
    with pytest.raises(ValueError, match="reach"):
        radio.block_size(radio.Receiver(25_000), 250_000, 500)
    with pytest.raises(ValueError, match="wider"):
        radio.Receiver(300_000).channel(250_000)


def write_recording(path, x, rate):
    values = np.clip(np.round(np.stack([x.real, x.imag], axis=1) * 32768), -32768, 32767).astype("<i2").tobytes()
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + len(values)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, 4 * rate, 4, 16) + b"data" + struct.pack("<I", len(values)) + values)


def test_arms_of_a_recording_become_files_with_equal_numbers(spark, tmp_path):
    rate, size = 40_000, 4000
    folder = tmp_path / "in"
    folder.mkdir()
    for name, seed in (("one_160650000Hz.wav", 1), ("two.wav", 2)):
        write_recording(folder / name, recording(rate, 3 * rate, seed, ((0.1, 0.35), (0.6, 0.85)), 0.0), rate)
    blocks = files.baseband_blocks(spark, str(folder), block_frames=size)
    arms = {"wide": radio.Receiver(16_000), "narrow": radio.Receiver(6000), "gated": radio.Receiver(6000)}
    clips, cuts = radio.replay(blocks, rate, size, arms, {"gated": 10.0})
    radio.write_arms(clips, str(tmp_path / "out"))
    lists = {}
    for r in sorted(cuts.collect(), key=lambda r: (r.capture, r.segment)):
        lists.setdefault(r.capture, []).append((r.start_s, r.end_s))
    assert {c: len(x) for c, x in lists.items()} == {"one_160650000Hz.wav": 2, "two.wav": 2}
    for (a, b), (start, end) in zip([(0.3, 1.05), (1.8, 2.55)], lists["two.wav"], strict=True):
        assert abs(start - (a - 0.3)) < 0.05 and abs(end - (b + 0.3)) < 0.05
    kept = {(r.arm, r.capture, r.segment): np.asarray(r.samples) for r in clips.collect()}
    assert {k[1:] for k in kept if k[0] == "wide"} == {k[1:] for k in kept if k[0] == "narrow"} == {(c, i) for c, x in lists.items() for i in range(len(x))}
    for (arm, capture, segment), samples in kept.items():
        with wave.open(str(tmp_path / "out" / arm / capture.removesuffix(".wav") / f"{segment:04d}_sent.wav")) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16_000, 1, 2)
            read = np.frombuffer(w.readframes(w.getnframes()), "<i2")
        assert np.array_equal(read, np.clip(np.round(samples * 32767), -32768, 32767))
        assert np.abs(samples).max() > 0.5
    # The gate silences what lies around a transmission, and nothing else.
    open_, gated = kept["narrow", "two.wav", 0], kept["gated", "two.wav", 0]
    assert len(open_) == len(gated) and np.abs(gated[:2000]).max() < 0.2 * np.abs(open_[:2000]).max()


def test_a_given_cut_list_holds_for_all_arms_and_ends_are_clipped(spark):
    rate, size = 40_000, 4000
    blocks = in_blocks(spark, {"x": recording(rate, 20_000, 3)}, size)
    cuts = spark.createDataFrame([("x", 0, 0.1, 0.2), ("x", 1, 0.45, 9.0), ("x", 2, 5.0, 6.0)], "capture string, segment int, start_s double, end_s double")
    clips, _ = radio.replay(blocks, rate, size, {"a": radio.Receiver(16_000), "b": radio.Receiver(8000)}, segments=cuts)
    sizes = {(r.arm, r.segment): len(r.samples) for r in clips.collect()}
    assert {k for k, n in sizes.items() if n == 0} == {("a", 2), ("b", 2)} and sizes["a", 0] == sizes["b", 0] == 1600


def held_recordings(spark, sf_dir):
    held = {}
    for r in plans.embedding_blocks(spark, sf_dir).collect():
        held.setdefault(r.capture, {})[r.block] = np.asarray(r.re, float) + 1j * np.asarray(r.im, float)
    return {c: np.concatenate([b[k] for k in sorted(b)]) for c, b in held.items()}


def test_the_query_of_frames_has_the_whole_signals_power(spark, sf_dir):
    got = {(r.capture, r.frame): r.power for r in plans.q_channel_frames(spark, sf_dir).collect()}
    want = {(c, i): p for c, x in held_recordings(spark, sf_dir).items() for i, p in enumerate(whole(x, plans.RATE, plans.RECEIVER)[1])}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_the_query_of_arms_has_the_same_clips_for_each(spark, sf_dir):
    rows = plans.q_replay_arms(spark, sf_dir).collect()
    sizes = {arm: {(r.capture, r.segment): r.n for r in rows if r.arm == arm} for arm in ("wide", "gated")}
    assert sizes["wide"] == sizes["gated"] and len(sizes["wide"]) > 10 and sum(sizes["wide"].values()) > 0


def test_the_query_hears_what_a_plain_receiver_hears(spark, sf_dir):
    want = {c: whole(x, plans.RATE, plans.RECEIVER)[0] for c, x in held_recordings(spark, sf_dir).items()}
    got = {}
    for r in plans.q_demodulated(spark, sf_dir).collect():
        got.setdefault(r.capture, []).append((r.block, r.n, r.total))
    assert set(got) == set(want)
    for c, rows in got.items():
        at = 0
        for _, n, total in sorted(rows):
            assert total == pytest.approx(want[c][at : at + n].sum(), abs=1e-6)
            at += n
        assert at == len(want[c])
