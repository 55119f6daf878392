"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

Each query is forced with a no-op sink, so results are fully computed but never collected. One pass over the smallest
data set comes first (``BENCH_WARMUP=0`` skips it), so the times show the work on the data rather than JVM start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "mom_01_rps_table", "win_01_cross_section_rank", "mom_05_self_rps_history", "sig_01_standard_launch", "win_07_moving_average",
    "win_18_cumulative_vwap", "hea_01_industry_heatmap", "agg_03_concept_members", "agg_08_window_sums", "jon_09_asof_close",
    "fin_04_score_snapshot", "fin_08_score_card", "val_05_temperature_history", "val_07_relative_valuation", "scr_01_stock_screener",
    "scr_02_tail_session", "whs_02_detect_updates", "stm_02_vwap_state", "stm_03_bars_15m", "dq_01_quality_grades",
]


def main() -> None:
    from marketloom import catalog
    from marketloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(small):  # start the JVM and compile the plans once
        for name in names:
            catalog.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
