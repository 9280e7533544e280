"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the test tables, BENCH_CPUS the local cores, BENCH_QUERIES a comma-separated choice
(``all`` for every registered query).
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reelspark.bindings import QUERIES  # noqa: E402
from reelspark.session import local_session  # noqa: E402

HEADLINE = [
    "presentation_order", "presented_frame_counts", "seek_key_packet", "rebase_timeline", "field_timeline", "unreferenced_pictures",
    "frame_interval", "frame_interval_rolling", "project_clock", "select_frames", "missing_frame_waits", "refresh_overlap",
    "pair_layers", "carry_metadata", "static_metadata_scan", "line_stats", "shots", "crop_timeline", "peak_measure", "yuv_to_rgb",
    "tone_map_spline", "apply_lut", "fit_levels", "reconcile_timeline", "downmix_ac4", "resample", "limit_peaks", "signal_stats",
    "content_identity", "upsert_verdicts", "in_flight", "quarantine", "event_summary_sliding", "play_sessions", "stage_latency",
    "counter_deltas", "container_support", "sidecar_join", "eligibility_reason_counts", "read_probe_reports", "read_trace_exports",
    "unit_inventory",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    # Start the JVM's and the Python workers' code paths before the clock runs
    for name in ("presented_frame_counts", "frame_interval"):
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
