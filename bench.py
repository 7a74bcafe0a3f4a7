"""Times the headline queries on one JVM and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 2: a cold and a warm run; the better
one counts and both are listed).
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from catalog import REGISTRY  # noqa: E402

HEADLINE = [
    "flagship_alarm_intervals", "src_09_index_one_series", "win_04_rolling_mean", "win_04_rolling_mean_one_series", "win_05_rolling_std_var", "win_07_rolling_quantiles", "win_07_long_rolling_quantiles",
    "win_08_rolling_skew_kurtosis", "win_10_ewm_mean", "win_15_rolling_mad", "win_19_rank_in_window", "win_20_cusum_unbounded", "win_24_rolling_slope", "win_34_rolling_entropy", "win_35_spectral",
    "win_42_sequences", "win_43_sliding_windows", "jn_01_sig_17_bin_normalise", "jn_04_interval_context", "agg_05_describe", "agg_09_percentile_curve", "agg_13_empirical_cdf", "agg_15_autocorrelation",
    "sig_01_02_savgol_51", "sig_04_kalman", "sig_06_causal_decomposition", "sig_09_10_db4_features", "sig_12_welch", "pp_01_08_run_intervals", "pp_02_gap_fill", "det_09_tail_fit_moments", "det_12_drift_report",
    "ev_04_roc_auc", "ev_05_average_precision", "ml_01_stratified_split", "ml_05_boosted_trees", "ml_09_isolation_forest", "st_03_stream_features", "preset_baseline", "preset_spectral"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").count()
    queries, cold = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats):
            t0 = time.time()
            REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(round(time.time() - t0, 3))
        queries[name], cold[name] = min(times), times[0]
    print(json.dumps({"metric": "total seconds over the headline queries", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "first_run": cold, "sf": sf}))
    spark.stop()


main()
