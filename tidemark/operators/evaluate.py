"""Evaluation of alarms and scores against labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stats import SMALL_GROUP, ordered_prefix


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def scores(c: DataFrame) -> DataFrame:
    """Metrics of a confusion table; divisions by zero give 0."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    out = c.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp),
                         "false_positive_rate": _ratio(fp, fp + tn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def combined_scores(s: DataFrame) -> DataFrame:
    """The two weighted selection scores: 0.7 F1 + 0.3 balanced accuracy, and 0.4 recall + 0.3 precision + 0.3 specificity."""
    return s.withColumns({"anomaly_aware": 0.7 * F.col("f1") + 0.3 * F.col("balanced_accuracy"),
                          "balanced_anomaly": 0.4 * F.col("recall") + 0.3 * F.col("precision") + 0.3 * F.col("specificity")})


def class_report(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and support-weighted means."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))

    def line(name, hit, wrong, missed):
        return F.struct(F.lit(name).alias("class"), _ratio(hit, hit + wrong).alias("precision"), _ratio(hit, hit + missed).alias("recall"),
                        _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"), (hit + missed).alias("support"))

    both = c.select(line("0", tn, fn, fp).alias("a"), line("1", tp, fp, fn).alias("b"))
    total = F.col("a.support") + F.col("b.support")

    def mean(name, wa, wb):
        return F.struct(F.lit(name).alias("class"), *[(F.col(f"a.{m}") * wa + F.col(f"b.{m}") * wb).alias(m) for m in ("precision", "recall", "f1")], total.alias("support"))

    wa, wb = _ratio(F.col("a.support"), total), _ratio(F.col("b.support"), total)
    return both.select(F.explode(F.array(F.col("a"), F.col("b"), mean("macro", F.lit(0.5), F.lit(0.5)), mean("weighted", wa, wb))).alias("r")).select("r.*")


def operating_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), bucket_rows: int = SMALL_GROUP) -> DataFrame:
    """Per distinct score, from the highest down: true and false positives when alarms are ``score >= threshold``."""
    y = F.col(label)
    per = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("threshold")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    t = ordered_prefix(per, "threshold", ["pos", "neg"], keys, descending=True, bucket_rows=bucket_rows)
    return t.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_all": "positives", "neg_all": "negatives"})


def roc_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return operating_points(df, label, score, keys).select(*keys, "threshold", _ratio(F.col("fp"), F.col("negatives")).alias("fpr"), _ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids; each step needs only its own counts, so no second scan."""
    t = operating_points(df, label, score, keys)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return t.groupBy(*keys).agg(F.try_divide(area, F.max("positives") * F.max("negatives")).alias("roc_auc"))


def precision_recall_curve(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    t = operating_points(df, label, score, keys)
    return t.select(*keys, "threshold", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("positives")).alias("recall"))


def average_precision(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise average precision and the trapezoid area under the precision-recall curve.

    The point before each threshold follows from the counts at it; before the first one, precision is 1.
    """
    t = operating_points(df, label, score, keys)
    before = F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    here = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    earlier = F.when(before == 0, 1.0).otherwise(F.try_divide(F.col("tp") - F.col("pos"), before))
    gain = F.try_divide(F.col("pos"), F.col("positives"))
    return t.groupBy(*keys).agg(F.sum(gain * here).alias("average_precision"), F.sum(gain * (here + earlier) / 2).alias("pr_auc"))


def best_thresholds(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Thresholds with the best F1 and the best precision; the lowest threshold wins ties."""
    c = precision_recall_curve(df, label, score, keys)
    c = c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    low = -F.col("threshold")
    return c.groupBy(*keys).agg(F.max_by("threshold", F.struct(F.col("f1"), low)).alias("f1_threshold"), F.max("f1").alias("best_f1"),
                                F.max_by("threshold", F.struct(F.col("precision"), low)).alias("precision_threshold"), F.max("precision").alias("best_precision"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Observed rate per score bin ``[i/bins, (i+1)/bins)``; a score of exactly 1 is in no bin."""
    s = F.col(score)
    return df.filter((s >= 0) & (s < 1)).groupBy(F.floor(s * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("observed"), F.avg(score).alias("mean_score"))


def metric_table(s: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A one-row metric frame as ``(metric, value)`` rows."""
    return s.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("r")).select("r.*")
