"""EV rows."""

from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import profile as P

from .base import EV, events, query, r, rounded

CONF = f"{EV}, c AS (SELECT s, count(*) FILTER (WHERE x > 80 AND label = 1) * 1.0 AS tp, count(*) FILTER (WHERE x > 80 AND label = 0) * 1.0 AS fp, count(*) FILTER (WHERE x <= 80 AND label = 1) * 1.0 AS fn, count(*) FILTER (WHERE x <= 80 AND label = 0) * 1.0 AS tn FROM ev GROUP BY s)"


def predicted(spark, sf):
    return events(spark, sf).withColumn("p", (F.col("x") > 80).cast("int"))


@query("ev_01_confusion", f"WITH {CONF} SELECT s, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM c")
def confusion(spark, sf):
    return E.confusion(predicted(spark, sf), "label", "p", ["s"])


M = {"accuracy": "(tp + tn) / (tp + tn + fp + fn)", "precision": "tp / (tp + fp)", "recall": "tp / (tp + fn)", "specificity": "tn / (tn + fp)", "false_positive_rate": "fp / (fp + tn)",
     "f1": "2 * tp / (2 * tp + fp + fn)", "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2"}


@query("ev_02_scores", f"WITH {CONF} SELECT s, " + ", ".join(f"{r(e)} AS {n}" for n, e in M.items()) + " FROM c")
def scores(spark, sf):
    return rounded(E.scores(E.confusion(predicted(spark, sf), "label", "p", ["s"])), ["s"], list(M))


ONE = f"{EV}, c AS (SELECT count(*) FILTER (WHERE x > 80 AND label = 1) * 1.0 AS tp, count(*) FILTER (WHERE x > 80 AND label = 0) * 1.0 AS fp, count(*) FILTER (WHERE x <= 80 AND label = 1) * 1.0 AS fn, count(*) FILTER (WHERE x <= 80 AND label = 0) * 1.0 AS tn FROM ev)"
REPORT = (f"{ONE}, l AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS n FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c), "
          "e AS (SELECT * FROM l UNION ALL SELECT 'macro', avg(p), avg(r), avg(f), sum(n) FROM l UNION ALL SELECT 'weighted', sum(p * n) / sum(n), sum(r * n) / sum(n), sum(f * n) / sum(n), sum(n) FROM l)")


@query("ev_02_class_report", f"WITH {REPORT} SELECT class, {r('p')} AS precision, {r('r')} AS recall, {r('f')} AS f1, CAST(n AS BIGINT) AS support FROM e")
def report(spark, sf):
    return rounded(E.class_report(E.confusion(predicted(spark, sf), "label", "p")), ["class"], ["precision", "recall", "f1"], ["support"])


@query("ev_03_combined_scores", f"WITH {CONF} SELECT s, {r('0.7 * (' + M['f1'] + ') + 0.3 * (' + M['balanced_accuracy'] + ')')} AS anomaly_aware, "
       f"{r('0.4 * (' + M['recall'] + ') + 0.3 * (' + M['precision'] + ') + 0.3 * (' + M['specificity'] + ')')} AS balanced_anomaly FROM c")
def combined(spark, sf):
    return rounded(E.combined_scores(E.scores(E.confusion(predicted(spark, sf), "label", "p", ["s"]))), ["s"], ["anomaly_aware", "balanced_anomaly"])


OPS = (f"{EV}, o AS (SELECT x AS t, sum(label) * 1.0 AS pos, sum(1 - label) * 1.0 AS neg FROM ev GROUP BY x), cum AS (SELECT *, sum(pos) OVER (ORDER BY t DESC) AS tp, sum(neg) OVER (ORDER BY t DESC) AS fp, "
       "sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM o)")


@query("ev_04_roc_curve", f"WITH {OPS} SELECT t AS threshold, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM cum")
def roc_curve(spark, sf):
    return rounded(E.roc_curve(events(spark, sf), "label", "x"), ["threshold"], ["fpr", "tpr"])


@query("ev_04_roc_auc", f"WITH {EV}, k AS (SELECT label, count(*) OVER (ORDER BY x) - (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM ev) SELECT "
       f"{r('(sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0))')} AS roc_auc FROM k")
def roc_auc(spark, sf):
    return rounded(E.roc_auc(events(spark, sf), "label", "x"), [], ["roc_auc"])


@query("ev_05_precision_recall_curve", f"WITH {OPS} SELECT t AS threshold, {r('tp / (tp + fp)')} AS precision, {r('tp / p')} AS recall FROM cum")
def pr_curve(spark, sf):
    return rounded(E.precision_recall_curve(events(spark, sf), "label", "x"), ["threshold"], ["precision", "recall"])


PR = f"{OPS}, l AS (SELECT tp / p AS rec, tp / (tp + fp) AS prec, coalesce(lag(tp / p) OVER (ORDER BY t DESC), 0) AS rec0, coalesce(lag(tp / (tp + fp)) OVER (ORDER BY t DESC), 1) AS prec0 FROM cum)"


@query("ev_05_average_precision", f"WITH {PR} SELECT {r('sum((rec - rec0) * prec)')} AS average_precision, {r('sum((rec - rec0) * (prec + prec0) / 2)')} AS pr_auc FROM l")
def average_precision(spark, sf):
    return rounded(E.average_precision(events(spark, sf), "label", "x"), [], ["average_precision", "pr_auc"])


BEST = f"{OPS}, l AS (SELECT t, tp / (tp + fp) AS prec, CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p) END AS f1 FROM cum)"


@query("ev_06_best_thresholds", f"WITH {BEST} SELECT (SELECT t FROM l ORDER BY f1 DESC, t LIMIT 1) AS f1_threshold, {r('max(f1)')} AS best_f1, (SELECT t FROM l ORDER BY prec DESC, t LIMIT 1) AS precision_threshold, {r('max(prec)')} AS best_precision FROM l")
def best(spark, sf):
    return rounded(E.best_thresholds(events(spark, sf), "label", "x"), ["f1_threshold", "precision_threshold"], ["best_f1", "best_precision"])


@query("ev_07_calibration", f"WITH {EV} SELECT CAST(floor(x / 300 * 10) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, {r('avg(label)')} AS observed, {r('avg(x / 300)')} AS mean_score FROM ev WHERE x / 300 < 1 GROUP BY 1")
def calibration(spark, sf):
    return rounded(E.calibration(events(spark, sf).withColumn("p", F.col("x") / 300), "label", "p"), [], ["observed", "mean_score"], ["bin", "n"])


@query("ev_08_score_histogram_by_class", f"WITH {EV}, q AS (SELECT label, x / 600 AS p FROM ev), b AS (SELECT min(p) AS lo, max(p) AS hi FROM q), c AS (SELECT label, least(29, CAST(floor((p - lo) / (hi - lo) * 30) AS BIGINT)) AS bin, count(*) AS n, any_value(hi - lo) AS w FROM q, b GROUP BY 1, 2) "
       f"SELECT CAST(label AS BIGINT) AS label, bin, {r('n / sum(n) OVER (PARTITION BY label) / (w / 30)')} AS density FROM c")
def score_histogram(spark, sf):
    df = events(spark, sf).withColumn("p", F.col("x") / 600)
    return rounded(P.histogram(df, "p", 30, ["label"]), [], ["density"], ["label", "bin"])
