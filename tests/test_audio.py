"""Filters that reach across chunks, and channel matrices, against brute force."""
import math
import random

import numpy as np
import pytest

from reelspark.functions.mixing import downmix_weights, routing
from reelspark.functions.tables import LAYOUT_SPEAKERS
from reelspark.operators.audio import (
    _REJECTED, CEILING, ReconcileFold, apply_effect, filter_table, limit_peaks, reconcile_timeline, release, resample, run_effect,
)

SCHEMA = "stream int, start long, channels array<array<float>>"


def chunked(samples, sizes, stream=0):
    rows, at = [], 0
    while at < samples.shape[1]:
        n = random.choice(sizes)
        rows.append((stream, at, [[float(x) for x in channel[at:at + n]] for channel in samples]))
        at += n
    return rows


def joined(rows, start):
    rows = sorted(rows, key=lambda row: row[start])
    return np.concatenate([np.array(row["channels"]) for row in rows], axis=1)


@pytest.mark.parametrize("source, target", [(48_000, 44_100), (44_100, 48_000), (96_000, 16_000), (48_000, 48_000)])
def test_resample(spark, source, target):
    random.seed(1)
    samples = np.random.default_rng(1).uniform(-1, 1, (2, 700)).astype(np.float32)
    df = spark.createDataFrame(chunked(samples, [3, 17, 90]), SCHEMA)
    got = joined(resample(df, "stream", "start", source, target, block=128).collect(), "out_start")
    radius, taps = filter_table(source, target)
    want = []
    for j in range(math.ceil(700 * target / source)):
        frame = j * source // target
        phase = math.floor((j * source - frame * target) * 2048 / target + 0.5)
        index = np.clip(np.arange(frame - radius + 1, frame + radius + 1), 0, 699)
        want.append(samples[:, frame] if source == target else (samples[:, index] * taps[phase]).sum(axis=1))
    assert got.shape == (2, len(want)) and np.allclose(got, np.array(want).T, atol=1e-6)


def test_limiter_is_the_sequential_recurrence(spark):
    random.seed(2)
    rng = np.random.default_rng(2)
    rate, n = 2_000, 3_000
    samples = rng.uniform(-0.8, 0.8, (2, n))
    samples[:, rng.integers(0, n, 40)] *= 2.5
    samples = samples.astype(np.float32)
    df = spark.createDataFrame(chunked(samples, [5, 60, 300]), SCHEMA)
    rows = limit_peaks(df, "stream", "start", rate, block=256).collect()
    got = joined(rows, "start_frame")
    peaks = np.abs(samples.astype(float)).max(axis=0)
    allowed = np.ones(n)
    low, high = math.ceil(3 * rate / 1000), math.ceil(10 * rate / 1000)
    for p in range(n):
        if peaks[p] > CEILING:
            need = CEILING / peaks[p]
            length = math.floor(low + (high - low) * min(1, -20 * math.log10(need) / 12) + 0.5)
            for f in range(max(0, p - length), p + 1):
                t = 1 - (p - f) / length
                allowed[f] = min(allowed[f], 1 - (1 - need) * t ** 3 * (t * (6 * t - 15) + 10))
    gain, gains = 1.0, []
    decay = math.exp(-1 / (0.1 * rate))
    for f in range(n):
        gain = min(1.0, CEILING / peaks[f] if peaks[f] > CEILING else 1.0, allowed[f], 1 - (1 - gain) * decay)
        gains.append(gain)
    assert np.allclose(got, samples * np.array(gains), atol=1e-5)
    assert np.abs(got).max() <= CEILING + 1e-6
    assert sum(row["limited_frames"] for row in rows) == sum(g < 1 - 1e-7 for g in gains)


def test_release_over_long_spans():
    drops = np.zeros(200_000)
    drops[10] = 0.5
    found = release(drops, math.exp(-1 / 4800), 0.25)
    assert np.isclose(found[0], 0.25 * math.exp(-1 / 4800)) and np.isclose(found[4810], 0.5 * math.exp(-1)) and found[-1] < 1e-12


def test_downmix_weights():
    half = math.sqrt(0.5)
    assert downmix_weights("5.1-side", "standard-loro") == [
        (1.0, 0.0, "none"), (0.0, 1.0, "none"), (half, half, "center"), (0.0, 0.0, "none"), (half, 0.0, "surround"), (0.0, half, "surround")]
    # A normalised mix never exceeds full scale
    beds = [(layout, "peak-normalized-loro") for layout in ("2.1", "3.0", "3.0-back", "5.1-side", "7.1", "6.1")]
    for layout, algorithm in [*beds, ("2.1", "rfc7845"), ("3.0", "rfc7845"), ("3.0-back", "rfc7845")]:
        for side in (0, 1):
            assert math.isclose(sum(w[side] for w in downmix_weights(layout, algorithm)), 1, abs_tol=1e-9)
    assert downmix_weights("3.0-back", "ac4")[2] == (half * half, half * half, "surround")
    assert downmix_weights("5.1.4", "ac4")[8][2] == "surround"


def test_routing():
    half = math.sqrt(0.5)
    weights, sums = routing("7.1", "5.1")
    assert sums and weights[4][4] == half and weights[4][6] == half
    weights, sums = routing("4.1", "5.1")
    assert weights[4][4] == weights[5][4] == half and not sums
    weights, sums = routing("5.1.4", "5.1")
    assert [round(w, 6) for w in weights[4]] == [0, 0, 0, 0, round(half, 6), 0, 0, 0, round(half, 6), 0] and sums
    for layout in LAYOUT_SPEAKERS:
        rows, _ = routing(layout, "7.1.4")
        power = [sum(row[c] ** 2 for row in rows) for c in range(len(LAYOUT_SPEAKERS[layout]))]
        assert all(value > 0.3 for value in power)


def drifting(rng, size, rejects=False):
    """Chunks with jitter, gaps, overlaps, times that go back and, if asked for, one far off."""
    at, rows = 0, []
    for n in range(size):
        frames = rng.choice([1024, 1024, 960, 3])
        rows.append((n, None if rng.random() < 0.02 else at + rng.randint(-900, 900), frames, rng.choice([48_000, 44_100]) if rejects else 48_000))
        at += frames * 1_000_000 // 48_000 + rng.choice([0] * 12 + [30_000, -25_000, 300_000, -90_000, 7])
        if rejects and n == size * 3 // 4:
            at += 9_000_000
    return rows


def one_by_one(rule, rows):
    state, out = rule.initial(), []
    for n, *row in rows:
        state, found = rule.step(state, tuple(row))
        out.append((n, *found))
    return out


@pytest.mark.parametrize("run_chunks", [7, 4_096])
def test_reconcile_in_runs(spark, run_chunks):
    rng = random.Random(11)
    streams = {None: drifting(rng, 150), "a": drifting(rng, 147, rejects=True), "b": drifting(rng, 1), "c": drifting(rng, 7), "d": drifting(rng, 8)}
    df = spark.createDataFrame([(key, *row) for key, rows in streams.items() for row in rows], "k string, n long, ts long, frames int, rate int").repartition(4)
    got = reconcile_timeline(df, "k", "n", "ts", "frames", "rate", run_chunks=run_chunks).collect()
    rule = ReconcileFold("ts", "frames", "rate", 1_000, 2_000_000)
    want = [(key, *row) for key, rows in streams.items() for row in one_by_one(rule, rows)]
    assert sorted(map(str, (tuple(row) for row in got))) == sorted(map(str, want))
    decided = {row["decision"] for row in got}
    assert {"anchor", "absorb", "fill", "trim", "drop", "reject", "ended"} <= decided


def test_effects_of_runs_compose():
    rng = random.Random(12)
    rule = ReconcileFold("ts", "frames", "rate", 1_000, 2_000_000)
    before, rows = 0, []
    for n, ts, frames, rate in drifting(rng, 60):
        rows.append((ts or 0, ts is not None and rng.random() < 0.9, frames, rate, before))
        before += frames
    parts = [run_effect(rule, rows[i:i + 20]) for i in range(0, 60, 20)]
    for offset in [*range(-3_000, 3_000, 37), -500_000, 500_000, _REJECTED]:
        plain = np.array([offset])
        for row in rows:
            plain = rule.shifted(plain, row)
        for part in parts:
            offset = apply_effect(part, offset)
        assert offset == plain[0]
