"""Splits, Spark ML models, isolation forest, scoring with saved artefacts."""

from __future__ import annotations

import functools
import itertools
import json
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rolling import lag
from ..plans.features import with_features
from ..plans.lineage import cut_lineage
from ..plans.series import IDX, SeriesSpec, index_rows, null_safe_join
from ..plans.stats import SMALL_GROUP, attach_group_stats, one_row, quantiles
from . import evaluate as E
from .detect import apply_threshold, percentile_threshold
from .signals import feature_names, standardise, wavelet_features
from .windows import sequences, sliding_windows

# ---- splits ---------------------------------------------------------------------------------------------

def hash_order(key: Column, seed: int = 0) -> Column:
    """Pseudo-random order of keys: 52 bits of a digest of key and seed, so the orders of two seeds have nothing in common."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")


def stratified_split(df: DataFrame, key: str, label: str, fractions: Mapping[str, float], seed: int = 0, small: int = SMALL_GROUP) -> DataFrame:
    """Assigns each row to a part so that every label keeps the fractions.

    Rows are ordered by a hash; the cut points are exact quantiles of the hash per label, so no label is sorted in one task.
    """
    rows = df.withColumn("_h", hash_order(F.col(key), seed))
    cuts, total = {}, 0.0
    for name in list(fractions)[:-1]:
        total += fractions[name]
        cuts[name] = total
    bounds = quantiles(rows, "_h", {f"_cut_{n}": q for n, q in cuts.items()}, [label], small)
    rows = null_safe_join(rows, bounds, [label])
    part = F.lit(list(fractions)[-1])
    for name in reversed(list(cuts)):
        part = F.when(F.col("_h") <= F.col(f"_cut_{name}"), name).otherwise(part)
    return rows.withColumn("part", part).drop("_h", *[f"_cut_{n}" for n in cuts])


def temporal_split(df: DataFrame, spec: SeriesSpec, fractions: Mapping[str, float]) -> DataFrame:
    """Consecutive parts of each series by position; boundaries are ``int(fraction * n)``."""
    rows = attach_group_stats(index_rows(df, spec), spec.keys, [F.count(F.lit(1)).alias("_n")])
    part, total = F.lit(list(fractions)[-1]), 1.0
    for name in reversed(list(fractions)[:-1]):
        total = sum(list(fractions.values())[: list(fractions).index(name) + 1])
        part = F.when(F.col(IDX) < F.floor(F.col("_n") * F.lit(round(total, 12))), name).otherwise(part)
    return rows.withColumn("part", part).drop("_n")


def temporal_folds(df: DataFrame, spec: SeriesSpec, bounds: Sequence[tuple[float, float]] = ((0.6, 0.7), (0.7, 0.8), (0.8, 0.9))) -> DataFrame:
    """Repeats rows per fold with role train (before the fold) or validate (inside it)."""
    rows = attach_group_stats(index_rows(df, spec), spec.keys, [F.count(F.lit(1)).alias("_n")])
    roles = []
    for i, (lo, hi) in enumerate(bounds):
        a, b = F.floor(F.col("_n") * F.lit(lo)), F.floor(F.col("_n") * F.lit(hi))
        role = F.when(F.col(IDX) < a, "train").when(F.col(IDX) < b, "validate")
        roles.append(F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role"))))
    return rows.withColumn("_f", F.explode(F.array_compact(F.array(*roles)))).select(*df.columns, IDX, "_f.fold", "_f.role")


def even_folds(splits: int) -> list[tuple[float, float]]:
    """Expanding folds of equal size, as fractions of the series."""
    return [((i + 1) / (splits + 1), (i + 2) / (splits + 1)) for i in range(splits)]


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight of flagged rows = normal rows / flagged rows, of normal rows = 1."""
    ratio = df.agg(F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1)).alias("_ratio"))
    return one_row(df, ratio).withColumn(out, F.when(F.col(label) == 1, F.col("_ratio")).otherwise(1.0)).drop("_ratio")


# ---- tree models -------------------------------------------------------------------------------------------

def train_boosted(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, **params) -> PipelineModel:
    settings = {"maxIter": 20, "maxDepth": 4, "seed": 42, **params}
    return _fit(df, features, GBTClassifier(featuresCol="_features", labelCol=label, **({"weightCol": weight} if weight else {}), **settings))


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, **params) -> PipelineModel:
    return _fit(df, features, RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees, seed=params.pop("seed", 42), **params))


def _fit(df: DataFrame, features: Sequence[str], model) -> PipelineModel:
    """Trains on the rows that have all features; the saved pipeline keeps the others (``score`` gives them NULL)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, model]).fit(df.na.drop(subset=list(features)))


def score(df: DataFrame, model: PipelineModel, out: str = "probability_1") -> DataFrame:
    """Adds the probability of the anomaly class; NULL where a feature is missing."""
    known = F.lit(True)
    for name in model.stages[0].getInputCols():
        known = known & F.col(name).isNotNull()
    scored = model.transform(df).withColumn("_p", F.when(known, vector_to_array("probability")[1]))
    return scored.drop("_features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", out)


def importance(spark: SparkSession, model: PipelineModel, top: int = 20) -> DataFrame:
    """Features by falling importance."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def random_search(df: DataFrame, spec: SeriesSpec, features: Sequence[str], grid: Mapping[str, Sequence], tries: int = 10, seed: int = 42,
                  folds: Sequence[tuple[float, float]] | None = None, metric: str = "balanced_anomaly", weighted: bool = True) -> tuple[dict, DataFrame]:
    """Random parameter sets scored by the mean metric over expanding time folds; returns the best set and all results."""
    folds = folds or even_folds(3)
    rows = temporal_folds(df, spec, folds).persist()
    every = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    results = []
    for params in random.Random(seed).sample(every, min(tries, len(every))):
        values = []
        for fold in range(len(folds)):
            part = rows.filter(F.col("fold") == fold)
            train = part.filter("role = 'train'")
            train = class_weights(train, spec.label) if weighted else train
            model = train_boosted(train, features, spec.label, "weight" if weighted else None, **params)
            held = score(part.filter("role = 'validate'"), model).withColumn("_pred", (F.col("probability_1") > 0.5).cast("int"))
            values.append(E.combined_scores(E.scores(E.confusion(held, spec.label, "_pred"))).first()[metric])
        results.append((json.dumps(params, sort_keys=True), float(np.mean(values))))
    rows.unpersist()
    table = df.sparkSession.createDataFrame(results, "params string, score double").orderBy(F.desc("score"), "params")
    return json.loads(max(results, key=lambda r: (r[1], r[0]))[0]), table


# ---- isolation forest ---------------------------------------------------------------------------------------

NODE = "tree int, node int, feature int, threshold double, left int, right int, size double"


def _harmonic_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, rng: np.random.Generator, limit: int) -> pd.DataFrame:
    """One isolation tree as a node table."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while todo:
        node, members, depth = todo.pop()
        part = x[members]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) > 1 else np.array([], dtype=int)
        if depth >= limit or len(spread) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, float(len(members))))
            continue
        f = int(rng.choice(spread))
        cut = rng.uniform(part[:, f].min(), part[:, f].max())
        nodes.append((tree, node, f, float(cut), made, made + 1, float(len(members))))
        low = part[:, f] <= cut
        todo += [(made, members[low], depth + 1), (made + 1, members[~low], depth + 1)]
        made += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> list[np.ndarray]:
    """Grows each tree on its own random subsample of at most ``sample`` rows, one task per tree.

    The forest (at most ``trees * 2 * sample`` nodes) is returned as arrays for broadcasting.
    """
    # one array: a null check on each of many renamed columns takes the optimiser very long
    rows = df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x")).filter(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    # every row is dealt to one bucket a round, a bucket is a tree's draw: one hash per row as soon as there are as many buckets as trees
    buckets = max(1, int(rows.count() / (1.3 * sample)))
    rounds = -(-trees // buckets)
    draw = F.array(*[F.lit(r * buckets) + F.pmod(F.xxhash64(F.col(key), F.lit(r), F.lit(seed)), F.lit(buckets)) for r in range(rounds)])
    drawn = rows.withColumn("tree", F.explode(F.transform(draw, lambda t: t.cast("int")))).filter(F.col("tree") < trees).withColumn("_order", F.xxhash64(F.col(key), F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.nsmallest(sample, "_order")
        t = int(pdf["tree"].iloc[0])
        return _grow(t, np.stack(pdf["_x"].to_numpy()), np.random.default_rng(seed * 100_003 + t), int(np.ceil(np.log2(max(2, len(pdf))))))

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE).toPandas().sort_values(["tree", "node"])
    return [g[["feature", "threshold", "left", "right", "size"]].to_numpy() for _, g in nodes.groupby("tree")]


def isolation_scores(df: DataFrame, forest: list[np.ndarray], features: Sequence[str], sample: int = 256, out: str = "isolation") -> DataFrame:
    """Score in (0, 1): 2 to the minus mean path length over the expected one; higher is more isolated."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(T.DoubleType())
    def depth_score(batch: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        expected = float(_harmonic_depth(np.array([min(sample, t[0, 4]) for t in trees])).mean())
        for columns in batch:
            columns = columns if isinstance(columns, tuple) else (columns,)
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            total, at = np.zeros(len(x)), np.arange(len(x))
            for t in trees:
                node, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                while True:
                    f = t[node, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    low = x[at, np.maximum(f, 0)] <= t[node, 1]
                    node = np.where(inner, np.where(low, t[node, 2], t[node, 3]).astype(int), node)
                    depth += inner
                total += depth + _harmonic_depth(t[node, 4])
            yield pd.Series(2.0 ** (-total / len(trees) / max(expected, 1e-9)))

    return df.withColumn(out, depth_score(*[F.col(f).cast("double") for f in features]))


def isolation_outliers(df: DataFrame, features: Sequence[str], key: str, contamination: float = 0.1, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Scores every row and flags the ``contamination`` share with the highest scores."""
    forest = fit_isolation_forest(df, features, key, trees, sample, seed)
    scored = cut_lineage(isolation_scores(df, forest, features, sample))  # read three times below
    return apply_threshold(scored, "isolation", percentile_threshold(scored, "isolation", (1 - contamination) * 100), "outlier")


# ---- experts, projections, reconstruction and forecast errors ---------------------------------------------------

def dual_expert(df: DataFrame, anomaly: str, normality: str, weight: float = 0.5, out: str = "combined") -> DataFrame:
    """Weighted mean of the anomaly expert's probability and the normality expert's deviation score."""
    return df.withColumn(out, F.lit(weight) * F.col(anomaly) + F.lit(1 - weight) * F.col(normality))


def normality_score(z: Column, scale: float = 3.0) -> Column:
    """Deviation from normal mapped to 0..1: 0 at the mean, 0.5 at ``scale / 2`` deviations, 1 from ``scale`` on."""
    return F.least(F.abs(z) / scale, F.lit(1.0))


def _all_known(names: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in names])


def project(df: DataFrame, features: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """First ``k`` principal components of the standardised features (columns ``pc1`` ..) and their variance shares.

    Rows with a missing feature are not learned from; they are kept and get NULL."""
    known = _all_known(features)
    scaled = standardise(df.withColumns({f"_s_{f}": F.col(f).cast("double") for f in features}), [f"_s_{f}" for f in features], train=known)
    vectors = VectorAssembler(inputCols=[f"_s_{f}" for f in features], outputCol="_features", handleInvalid="keep").transform(scaled)
    model = PCA(k=k, inputCol="_features", outputCol="_pcs").fit(vectors.filter(known))
    out = model.transform(vectors).withColumn("_a", vector_to_array("_pcs"))
    out = out.select(*df.columns, *[F.when(known, F.col("_a")[i]).alias(f"pc{i + 1}") for i in range(k)])
    return out, model.explainedVariance.toArray().tolist()


def reconstruction_error(df: DataFrame, spec: SeriesSpec, size: int = 100, k: int = 5, train: Column | None = None) -> DataFrame:
    """Mean squared error of each sequence after projection to ``k`` principal components fitted on the training sequences."""
    seq = sequences(df, spec, size, [spec.value]).withColumn("_v", array_to_vector(f"{spec.value}_seq"))
    known = seq if train is None else seq.filter(train)
    mean = known.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    axes = PCA(k=k, inputCol="_v", outputCol="_pcs").fit(known).pc.toArray()
    centre = mean

    @F.pandas_udf(T.DoubleType())
    def error(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy()) - centre
        return pd.Series(((x - x @ axes @ axes.T) ** 2).mean(axis=1))

    return seq.withColumn("error", error(f"{spec.value}_seq")).drop("_v", f"{spec.value}_seq")


def forecast_error(df: DataFrame, spec: SeriesSpec, lags: int = 60, train: Column | None = None) -> DataFrame:
    """Absolute error of a linear forecast of the next value from the last ``lags`` values, in original units.

    Rows before the first full look-back are left out. A row with a missing value among its lags is not learned from; it is kept with a NULL
    forecast, as is a missing value with a NULL error."""
    names = [f"lag{i}_f" for i in range(1, lags + 1)]
    rows = with_features(df, spec, {n: lag(spec.value, i) for i, n in enumerate(names, 1)}, index=True).filter(F.col(IDX) >= lags)
    rows = rows.withColumn("_known", F.coalesce(_all_known(names), F.lit(False)))
    rows = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(rows).drop(*names)
    learned = rows.filter(F.col("_known") & F.col(spec.value).isNotNull())
    model = LinearRegression(featuresCol="_features", labelCol=spec.value, predictionCol="forecast").fit(learned if train is None else learned.filter(train))
    out = model.transform(rows).withColumn("forecast", F.when(F.col("_known"), F.col("forecast")))
    return out.withColumn("error", F.abs(F.col(spec.value) - F.col("forecast"))).drop("_features", "_known", *([] if IDX in df.columns else [IDX]))


def compare_wavelets(df: DataFrame, spec: SeriesSpec, wavelets: Sequence[str], size: int = 100, step: int = 10, train: float = 0.7) -> DataFrame:
    """Area under the ROC curve of an isolation forest on wavelet features, fitted on the first share of each series."""
    windows = sliding_windows(df, spec, size, step).select(*spec.keys, "win", "values", "start_idx")
    labels = index_rows(df.select(*spec.keys, *spec.order, spec.label), spec).select(*spec.keys, F.col(IDX).alias("centre"), F.col(spec.label).alias("label"))
    windows = null_safe_join(windows.withColumn("centre", F.col("start_idx") + size // 2), labels, [*spec.keys, "centre"])
    windows = attach_group_stats(windows, spec.keys, [F.max("centre").alias("_last")])
    windows = windows.withColumn("is_train", F.col("centre") < train * F.col("_last")).withColumn("wid", F.xxhash64(*spec.keys, "win")).drop("_last")
    windows, names = cut_lineage(windows), feature_names()
    every = [wavelet_features(windows, size, name, keep=["wid", "label", "is_train"]).withColumn("wavelet", F.lit(name)) for name in wavelets]
    table = cut_lineage(standardise(functools.reduce(DataFrame.unionByName, every).fillna(0.0, names), names, ["wavelet"], train=F.col("is_train")))

    def held_out(name: str) -> DataFrame:
        mine = table.filter(F.col("wavelet") == name)
        return isolation_scores(mine.filter("not is_train"), fit_isolation_forest(mine.filter("is_train"), names, "wid"), names)

    with ThreadPoolExecutor(max(1, len(wavelets))) as pool:  # small forests: their jobs share the cluster
        scored = list(pool.map(held_out, wavelets))
    return functools.reduce(DataFrame.unionByName, [E.roc_auc(s, "label", "isolation").select(F.lit(n).alias("wavelet"), "roc_auc") for n, s in zip(wavelets, scored)])


# ---- artefacts and batch scoring ----------------------------------------------------------------------------------

def save_artifacts(path: str, model: PipelineModel, params: DataFrame) -> None:
    """Writes the model and the one-row parameter table (feature names, medians, thresholds, bins ...)."""
    model.write().overwrite().save(f"{path}/model")
    params.write.mode("overwrite").parquet(f"{path}/params")


def load_artifacts(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/params")


def score_batch(df: DataFrame, spec: SeriesSpec, model: PipelineModel, features: Sequence[str], threshold: float = 0.5, gap: int = 120) -> DataFrame:
    """Aligned features -> probability -> alarm -> alarm with gaps filled; rows the model cannot score get 0."""
    from ..sources.tables import align_features
    from .runs import fill_gaps

    keep = [c for c in df.columns if c not in features]
    scored = score(align_features(df, features, keep).fillna(0.0, list(features)), model, "anomaly_probability")
    flagged = scored.withColumn("anomaly_prediction", (F.col("anomaly_probability") > threshold).cast("int"))
    return fill_gaps(flagged, spec, "anomaly_prediction", gap, "anomaly_prediction_filled")


def score_sequences(df: DataFrame, columns: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    """Applies a user model to ``[batch, steps, features]`` blocks stacked from ``<column>_seq`` arrays.

    ``predict`` is shipped once per worker process; arrays exist only inside the scoring stage.
    """
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            parts = parts if isinstance(parts, tuple) else (parts,)
            block = np.stack([np.stack(p.to_numpy()) for p in parts], axis=-1)
            yield pd.Series(np.asarray(predict(block), dtype=float).reshape(len(block)))

    return df.withColumn(out, run(*[F.col(f"{c}_seq") for c in columns]))


