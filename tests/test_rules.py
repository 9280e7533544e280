"""Order-dependent rules and byte splitting against hand-made sequences."""
import random
import time
from fractions import Fraction

import pytest

from reelspark.operators.audio import ReconcileFold
from reelspark.operators.frames import PeakFold, crop_timeline
from reelspark.operators.metadata import PairFold, pair_layers
from reelspark.operators.packets import split_units, unit_inventory
from reelspark.operators.timing import FrameIntervalFold, RefreshIntervalFold
from reelspark.operators.verdicts import QuarantineFold
from reelspark.plans.fold import fold_rows


def run(rule, rows):
    return fold_rows(rule, rule.initial(), [list(column) for column in zip(*rows)])[1]


def test_annex_b():
    data = b"\x00\x00\x00\x01\x40\x01ab\x00\x00\x01\x26\x0acd"
    rows = split_units(data, "annex-b")
    assert [(r[1], r[2], r[3], r[4], r[5]) for r in rows] == [(4, 4, 32, 0, 0), (11, 4, 19, 1, 1)]
    assert split_units(b"x\x00\x00\x01\x40\x01", "annex-b")[0][-1] == "data-before-start-code"
    assert split_units(b"abc", "annex-b")[0][-1] == "no-start-code"


def test_length_prefixed():
    assert [r[2] for r in split_units(b"\x00\x02\x40\x01\x00\x03\x26\x01z", "length-2")] == [2, 3]
    assert split_units(b"\x00\x00", "length-2")[0][-1] == "invalid-length"
    assert split_units(b"\x05\x01", "length-1")[0][-1] == "invalid-length"
    assert split_units(b"\x00", "length-4")[0][-1] == "truncated-length"


def test_av1_and_vp9():
    # A temporal delimiter with size 0, then a frame OBU without a size field
    assert [r[3] for r in split_units(b"\x12\x00\x30abc", "av1")] == [2, 6]
    assert split_units(b"\x12\x85", "av1")[0][-1] == "truncated-size"
    assert split_units(b"\x80", "av1")[0][-1] == "forbidden-bit"
    hidden, shown = b"\x80\x00", b"\x82\x00\x00"
    index = bytes([0xC1, 2, 3, 0xC1])
    assert [(r[2], r[6]) for r in split_units(hidden + shown + index, "vp9")] == [(2, True), (3, False)]
    assert len(split_units(hidden + shown + bytes([0xC1, 9, 9, 0xC1]), "vp9")) == 1


@pytest.mark.parametrize("framing", ["annex-b", "length-1", "length-4", "av1", "vp9"])
def test_many_packets_give_the_units_of_each(spark, framing):
    """Packets of known units, malformed and null ones among them, in slices of several packets and of one."""
    draw, packets, want = random.Random(framing), [], []
    for number in range(300):
        units = [bytes(draw.randrange(2, 128) for _ in range(draw.randrange(2, 40))) for _ in range(draw.randrange(1, 6))]
        lead = {"annex-b": lambda u: b"\x00\x00\x01", "av1": lambda u: bytes([0x32, len(u)]), "vp9": lambda u: b""}.get(
            framing, lambda u: len(u).to_bytes(int(framing[-1]), "big"))
        data = b"".join(lead(unit) + unit for unit in units)
        sizes = [len(unit) + (2 if framing == "av1" else 0) for unit in units]
        if framing == "vp9":
            marker = bytes([0xC0 + len(units) - 1])
            data += marker + bytes(map(len, units)) + marker
        if number % 17 == 0:
            data, sizes = None, {"annex-b": [None], "av1": [None], "vp9": [0]}.get(framing, [])
        elif number % 13 == 0 and framing != "vp9":
            data, sizes = {"annex-b": b"\x07" + data, "av1": b"\xff" + data}.get(framing, data + b"\x09"), [None]
        packets.append((number, data))
        want += [(number, size) for size in sizes]
    rows = spark.createDataFrame(packets, "n int, payload binary").coalesce(1)
    got = unit_inventory(rows, ["n"], "payload", framing).collect()
    assert sorted(((row["n"], row["size"]) for row in got), key=str) == sorted(want, key=str)
    assert all((row["status"] == "ok") == (row["size"] is not None) for row in got)


def test_frame_interval_of_24_fps_in_milliseconds():
    rows = [(round(n * 1000 / 24) * 1000, 42_000) for n in range(60)]
    found = [value for value, in run(FrameIntervalFold("t", "d"), rows)]
    exact = 1e6 / 24
    assert found[0] == 42_000 and abs(found[8] / exact - 1) < 0.001 and abs(found[-1] / exact - 1) < 0.0002


def test_frame_interval_restarts():
    rows = [(n * 40_000, None) for n in range(30)] + [(29 * 40_000 + (n + 1) * 20_000, None) for n in range(30)]
    found = [value for value, in run(FrameIntervalFold("t", "d"), rows)]
    assert found[0] == 0 and abs(found[29] - 40_000) < 1e-6 and abs(found[30] - 20_000) < 1e-6
    # A time that does not advance starts over, timed by its own duration
    assert run(FrameIntervalFold("t", "d"), [(0, 40_000), (40_000, 40_000), (40_000, 33_000)])[-1] == (33_000.0,)
    # A skipped frame counts twice by the last duration
    assert abs(run(FrameIntervalFold("t", "d"), [(0, 40_000), (40_000, 40_000), (120_000, 40_000)])[-1][0] - 40_000) < 1e-6


def test_refresh_interval():
    rows = [(n * 1000 / 60 + (0.1 if n % 2 else 0),) for n in range(200) if n % 17]
    found = [value for value, in run(RefreshIntervalFold("t"), rows)]
    assert found[20] is None and abs(found[-1] - 1000 / 60) < 0.01
    rows += [(rows[-1][0] + 2000 + n * 8.333,) for n in range(200)]
    found = [value for value, in run(RefreshIntervalFold("t"), rows)]
    assert abs(found[-1] - 8.333) < 0.01


def frame(ts, shot, rows, columns=(1920, 0, 1919, 64, 64)):
    return (ts, shot, *rows, *columns)


def crops(spark, rows):
    names = [f"{axis}_{part}" for axis in ("row", "column") for part in ("lines", "first_line", "last_line", "start_lit", "end_lit")]
    schema = "stream int, n int, ts long, shot int, " + ", ".join(f"{name} int" for name in names)
    frames = spark.createDataFrame([(1, n, *row) for n, row in enumerate(rows)], schema)
    return [tuple(row)[2:] for row in crop_timeline(frames, "stream", "n", "ts", "shot").orderBy("n").collect()]


def test_crop_letterbox_at_once_and_subtitle_in_bar(spark):
    letterbox, subtitle = (1080, 140, 939, 64, 64), (1080, 140, 1000, 64, 64)
    found = crops(spark, [
        frame(0, 1, letterbox), frame(40_000, 1, subtitle), frame(80_000, 1, letterbox), frame(120_000, 2, letterbox)])
    assert [row[0] for row in found] == [140, 79, 79, 79]
    assert [row[2] for row in found] == [True, True, False, False]


def test_crop_needs_two_shots_without_symmetry_and_holds_before_cropping_again(spark):
    lopsided = (1080, 140, 979, 64, 10)
    found = crops(spark, [frame(0, 1, lopsided), frame(40_000, 1, lopsided), frame(80_000, 2, lopsided)])
    assert [row[0] for row in found] == [0, 0, 0]
    lopsided = (1080, 100, 979, 64, 10)
    found = crops(spark, [frame(0, 1, lopsided), frame(40_000, 1, lopsided), frame(80_000, 2, lopsided)])
    assert [row[0] for row in found] == [0, 0, 100]
    box, full = (1080, 140, 939, 64, 64), (1080, 0, 1079, 64, 64)
    rows = [frame(0, 1, box), frame(40_000, 1, full)] + [frame(80_000 + n * 200_000, 2 + n // 20, box) for n in range(200)]
    found = [row[0] for row in crops(spark, rows)]
    first = found.index(140, 1)
    assert found[1] == 0 and rows[first][0] - rows[2][0] >= 30_000_000 and rows[first][1] != rows[first - 1][1]
    # Another size starts over, and a black frame changes nothing
    black = (1080, None, None, None, None)
    found = crops(spark, [frame(0, 1, box), frame(40_000, None, black), frame(80_000, 1, (720, 0, 719, 64, 64))])
    assert [row[0] for row in found] == [140, 140, 0]


def test_peak_smoothing():
    rows = [(10, 10, 0.3, 0.6)] + [(10, 10, 0.3, 0.6)] * 3 + [(10, 10, 0.305, 0.6), (0, 0, None, None), (10, 10, 0.5, 0.75)]
    found = run(PeakFold(203.0), rows)
    assert found[3][:2] == (0.3, 0.6) and 0.3 < found[4][0] < 0.305 and found[5] == found[4]
    # A change of scene is taken over at once
    assert abs(found[6][0] - 0.5) < 1e-9 and found[6][3] <= found[6][2]


def test_reconcile_timeline():
    step = 1024 * 1_000_000 / 48_000
    rows = [(round(n * step), 1024, 48_000) for n in range(4)]
    rows += [(round(4 * step) + 900, 1024, 48_000), (round(5 * step) + 50_000, 1024, 48_000), (round(6 * step) + 40_000, 1024, 48_000),
             (round(7 * step) + 50_000, 1024, 48_000), (round(7 * step) + 50_000, 1024, 48_000), (9_000_000, 1024, 48_000), (9_100_000, 1024, 48_000)]
    found = run(ReconcileFold("t", "n", "r", 1_000, 2_000_000), rows)
    assert [row[0] for row in found] == ["anchor", "contiguous", "contiguous", "contiguous", "absorb", "fill", "trim", "fill", "absorb", "reject", "ended"]
    assert found[5][1] == 2400 and found[6][2] == 480 and found[7][1] == 480
    position = 0
    for decision, silence, discarded, accepted, start, _ in found[:9]:
        assert start == position + silence and accepted == 1024 - discarded
        position = start + accepted


def test_quarantine():
    rows = [("crash", ["a", "b"], 100, 2), ("resolved", ["a"], 0, 0), ("resolved", ["b"], 0, 0), ("crash", ["c"], 5, 1),
            ("crash", ["a", "d"], 50, 0), ("crash", ["d"], 1, 1), ("resolved", ["a"], 0, 0), ("crash", ["c", "d"], 9, 9)]
    found = run(QuarantineFold(), rows)
    assert found[0][:3] == ([], ["a", "b"], True)
    assert found[2] == ([], [], False, 99, 1)
    assert found[3][0] == ["c"]
    assert found[5][:2] == (["c", "d"], ["a"])
    # The culprit was found, so the ceiling stays; blocked steps become no suspects again
    assert found[6] == (["c", "d"], [], False, 99, 1) == found[7]


def greedy(base, enh, tolerance):
    """Pairs in time order, one frame at a time."""
    pairs, at = [], 0
    for b in base:
        while at < len(enh) and enh[at] < b - tolerance:
            at += 1
        if at < len(enh) and abs(enh[at] - b) <= tolerance:
            pairs.append((b, enh[at]))
            at += 1
        else:
            pairs.append((b, None))
    return pairs


def test_layer_pairs_match_the_greedy_walk(spark):
    random.seed(5)
    base, enh, want = [], [], {}
    for key in range(40):
        spread = random.choice([30, 120, 900])
        b, e = (sorted(random.sample(range(spread), random.randint(0, 20))) for _ in range(2))
        want[key] = greedy(b, e, 4)
        base += [(key, n, t) for n, t in enumerate(b)]
        enh += [(key, n, t) for n, t in enumerate(e)]
    schema = "key int, n long, t long"
    found = pair_layers(spark.createDataFrame(base, schema), spark.createDataFrame(enh, schema).toDF("key", "m", "u"),
                        "key", "n", "t", "m", "u", tolerance=4).collect()
    for key in want:
        own = [row for row in found if row["key"] == key]
        assert sorted((r["base_us"], r["enh_us"]) for r in own if r["base_us"] is not None) == sorted(want[key], key=lambda p: p[0])
        used = {e for _, e in want[key] if e is not None}
        assert {r["enh_us"] for r in own if r["base_us"] is None} == {t for k, _, t in enh if k == key} - used


def test_pair_fold_keeps_only_frames_within_reach():
    rule = PairFold(2)
    state = rule.initial()
    for n in range(1000):
        state, _ = rule.step(state, (n * 10, 0, n, False))
    assert len(state[1]) == 1


def test_refresh_interval_takes_constant_time_a_tick():
    random.seed(11)
    times = [n * 16.666 + random.random() for n in range(4000)]
    rule = RefreshIntervalFold("t")
    state, found = rule.initial(), []
    began = time.process_time()
    for at in times:
        state, (refresh,) = rule.step(state, (at,))
        found.append(refresh)
    # A line summed anew for each tick takes over a second
    assert time.process_time() - began < 0.4
    marks = [(n, Fraction(at)) for n, at in enumerate(times)][-241:]
    n_mean, t_mean = sum(n for n, _ in marks) / Fraction(241), sum(t for _, t in marks) / 241
    slope = sum((n - n_mean) * (t - t_mean) for n, t in marks) / sum((n - n_mean) ** 2 for n, _ in marks)
    assert abs(found[-1] - float(slope)) < 1e-12
