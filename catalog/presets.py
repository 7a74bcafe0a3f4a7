"""Feature-set presets."""

from pyspark.sql import functions as F

from tidemark.operators import signals as G
from tidemark.operators import windows as W
from tidemark.plans import presets as P

from .base import BY_TYPE, EV, ORD, at_least, events, over, query, r, rounded

o = f"({ORD})"
SPEED = BY_TYPE.__class__(("s",), "ts", ("event_id",), "speed", "label")


def complete(name, **options):
    """The whole preset with its null policy, every feature rounded."""
    def run(spark, sf):
        df = events(spark, sf).withColumn("speed", 20000 + (F.col("x") - 0.01) * 140)
        spec = SPEED if name in ("binned", "spectral") else BY_TYPE
        out, names = P.build(df, spec, name, **options)
        return rounded(out, ["event_id"], names)

    return run


def some(name, columns, **options):
    """Selected features of the preset before filling, for comparison with SQL."""
    def run(spark, sf):
        out, _ = P.build(events(spark, sf), BY_TYPE, name, causal=False, fill=False, **options)
        return rounded(out, ["event_id"], columns)

    return run


for _name in ("baseline", "enhanced", "robust", "causal", "binned", "spectral", "residual", "pattern"):
    query(f"preset_{_name}")(complete(_name, **({"period": 60} if _name == "residual" else {})))


def z(w, m):
    return at_least(m, f"w{w}", f"(x - avg(x) OVER w{w}) / (CASE WHEN count(x) OVER w{w} >= 2 THEN stddev_samp(x) OVER w{w} END + 1e-9)")


BASE = {"std_60": at_least(2, "w60", "stddev_samp(x) OVER w60"), "z_60": z(60, 1), "z_300": z(300, 60), "z_900": z(900, 180), "median_300": at_least(60, "w300", "quantile_cont(x, 0.5) OVER w300"),
        "q25_60": "quantile_cont(x, 0.25) OVER w60", "max_300": at_least(60, "w300", "max(x) OVER w300"), "diff_5": f"x - lag(x, 5) OVER {o}", "lag_60": f"lag(x, 60) OVER {o}",
        "acceleration": f"x - 2 * lag(x, 1) OVER {o} + lag(x, 2) OVER {o}"}
query("preset_baseline_columns", f"WITH {EV} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in BASE.items()) + f" FROM ev WINDOW {over(60)}, {over(300)}, {over(900)}")(some("baseline", list(BASE)))

ENH = {"std_30": at_least(3, "w30", "stddev_samp(x) OVER w30"), "kurt_60": at_least(6, "w60", "kurtosis(x) OVER w60"), "q90_300": at_least(30, "w300", "quantile_cont(x, 0.9) OVER w300"),
       "range_1800": at_least(180, "w1800", "max(x) OVER w1800 - min(x) OVER w1800"), "z_900": z(900, 90), "pct_120": f"x / nullif(lag(x, 120) OVER {o}, 0) - 1",
       "hour_cos": "cos(2 * pi() * hour(ts) / 24)", "jerk": f"x - 3 * lag(x, 1) OVER {o} + 3 * lag(x, 2) OVER {o} - lag(x, 3) OVER {o}"}
query("preset_enhanced_columns", f"WITH {EV} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in ENH.items()) + f" FROM ev WINDOW {over(30)}, {over(60)}, {over(300)}, {over(900)}, {over(1800)}")(some("enhanced", list(ENH)))

ROB = {"median_60": "quantile_cont(x, 0.5) OVER w60", "iqr_600": at_least(12, "w600", "quantile_cont(x, 0.75) OVER w600 - quantile_cont(x, 0.25) OVER w600"),
       "local_max": f"CASE WHEN x > lag(x) OVER {o} AND x > lead(x) OVER {o} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "pct_30": f"x / nullif(lag(x, 30) OVER {o}, 0) - 1", "minute_sin": "sin(2 * pi() * minute(ts) / 60)",
       "time_position": "epoch(ts - min(ts) OVER ()) / epoch(max(ts) OVER () - min(ts) OVER ())"}
query("preset_robust_columns", f"WITH {EV} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in ROB.items()) + f" FROM ev WINDOW {over(60)}, {over(600)}")(some("robust", list(ROB)))

CAU = {"q75_300": "quantile_cont(x, 0.75) OVER w300", "abs_10": f"abs(x - lag(x, 10) OVER {o})", "rate_30": f"(x - lag(x, 30) OVER {o}) / 30", "cumulative_change": f"x - first_value(x) OVER ({ORD} ROWS UNBOUNDED PRECEDING)",
       "position_60": "least(greatest((x - min(x) OVER w60) / (max(x) OVER w60 - min(x) OVER w60 + 1e-9), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE))", "is_max_30": "CASE WHEN x = max(x) OVER w30 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
       "var_60": at_least(2, "w60", "var_samp(x) OVER w60")}
query("preset_causal_columns", f"WITH {EV} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in CAU.items()) + f" FROM ev WINDOW {over(30)}, {over(60)}, {over(300)}")(some("causal", list(CAU)))

PAT = {"diff": f"coalesce(x - lag(x) OVER {o}, 0)", "mean_10": f"coalesce({at_least(10, 'w10', 'avg(x) OVER w10')}, x)", "std_50": f"coalesce({at_least(50, 'w50', 'stddev_samp(x) OVER w50')}, 0)"}


@query("preset_pattern_columns", f"WITH {EV} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in PAT.items()) + f" FROM ev WINDOW {over(10)}, {over(50)}")
def pattern(spark, sf):
    out, _ = P.build(events(spark, sf), BY_TYPE, "pattern")
    return rounded(out, ["event_id"], list(PAT))


STEP = f"{EV}, st AS (SELECT *, coalesce(x - lag(x) OVER {o}, 0) AS d FROM ev)"
EXP = {"ma_5": "coalesce(" + at_least(5, "w5", "avg(x) OVER w5") + ", 0)", "z_30": "coalesce(" + at_least(30, "w30", "(x - avg(x) OVER w30) / nullif(stddev_samp(x) OVER w30, 0)") + ", 0)",
       "momentum": f"coalesce(x - lag(x, 10) OVER {o}, 0)", "rsi": "coalesce(" + at_least(14, "w14", "100 - 100 / (1 + avg(greatest(d, 0)) OVER w14 / avg(greatest(-d, 0)) OVER w14)") + ", 0)", "minute": "CAST(minute(ts) AS DOUBLE)"}


@query("preset_exploration", f"WITH {STEP} SELECT event_id, " + ", ".join(f"{r(e)} AS {n}" for n, e in EXP.items()) + f" FROM st WINDOW {over(5)}, {over(14)}, {over(30)}")
def exploration(spark, sf):
    out, _ = P.build(events(spark, sf), BY_TYPE, "exploration")
    return rounded(out, ["event_id"], list(EXP))


@query("preset_wavelet")
def wavelet(spark, sf):
    w = W.sliding_windows(events(spark, sf), BY_TYPE, 100, 20)
    return rounded(G.wavelet_features(w, 100, "db4", keep=["s", "win"]), ["s", "win"], G.feature_names())
