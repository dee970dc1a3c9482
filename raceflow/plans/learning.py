"""Model inputs and MLlib models: encoding, folds, estimators, assembled predictions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.operators import ingroup
from raceflow.operators.stats import context_values
from raceflow.session import cut_lineage

BINS = 32  # as MLlib's maxBins
BITS = 5
CODES = 12  # bins in a long
SUM_BYTES = 32 << 20  # of the sums of all groups of a task, if each had one row


def one_hot(df: DataFrame, column: str, prefix: str, values: Sequence | None = None,
            null_dummy: bool = False) -> DataFrame:
    """0/1 column per value; a NULL row is all zeros unless ``null_dummy``. A column with more values than
    can be columns raises an error (``one_hot_rows`` has no such bound)."""
    values = context_values(df, column) if values is None else values
    flags = {f"{prefix}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in values}
    if null_dummy:
        flags[f"{prefix}_nan"] = F.col(column).isNull().cast("int")
    return df.withColumns(flags)


def one_hot_rows(df: DataFrame, key: Sequence[str], columns: Mapping[str, str], null_dummy: bool = False) -> DataFrame:
    """The long form (key, feature, value) of the dummies of ``columns`` (name → prefix) that are 1, for any number
    of values: without a shuffle or a look at the data; every other dummy of a key is 0."""
    each = F.explode(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}_"), F.col(c).cast("string"))).otherwise(
            F.lit(f"{prefix}_nan") if null_dummy else F.lit(None).cast("string")) for c, prefix in columns.items()])))
    return df.select(*key, each.alias("feature")).withColumn("value", F.lit(1))


def fill_values(df: DataFrame, columns: Sequence[str], strategy: str = "median", default: float = 0.0) -> dict:
    """Replacement per column: its median, mean, or zero; ``default`` when all NULL."""
    if strategy == "zero":
        return {c: 0.0 for c in columns}
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        found = {c: row[c] for c in columns}
    else:
        found = skew.exact_medians(df, columns)
    return {c: default if v is None else v for c, v in found.items()}


def impute(df: DataFrame, values: Mapping[str, float], indicators: bool = False) -> DataFrame:
    """Fill NULLs; with ``indicators`` also add 0/1 ``c_missing`` columns."""
    added = {f"{c}_missing": F.col(c).isNull().cast("int") for c in values} if indicators else {}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in values.items()}
    return df.withColumns(added).withColumns(filled) if added else df.withColumns(filled)


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to doubles; unreadable text and NaN become NULL."""
    def number(c):
        x = F.col(c).try_cast("double")
        return F.when(~F.isnan(x), x)

    return df.withColumns({c: number(c) for c in columns})


def feature_vector(df: DataFrame, columns: Sequence[str], out: str = "features",
                   fills: Mapping[str, float] | None = None) -> DataFrame:
    """Numbers, imputation, missing indicators and one vector (trees reject NaN)."""
    df = as_numbers(df, columns)
    fills = fill_values(df, columns, "mean") if fills is None else fills
    df = impute(df, {c: fills[c] for c in columns}, indicators=True)
    inputs = [*columns, *[f"{c}_missing" for c in columns]]
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(df)


def bin_edges(df: DataFrame, features: str) -> list[list[float]]:
    """For every entry of the vector the lower ends of its bins but the first: each value found among a thousand
    quantiles of all rows if these are few, else the quantiles that part the rows evenly."""
    width = df.select(F.size(vector_to_array(features))).first()[0]
    wide = df.select(vector_to_array(features).alias("x")).select(*[F.col("x")[i].alias(f"x{i}") for i in range(width)])
    steps = [i / 1000 for i in range(1001)]
    found = wide.agg(*[F.percentile_approx(c, steps, 10_000) for c in wide.columns]).first()
    edges = []
    for values in found:
        few = sorted(set(values))
        edges.append(few[1:] if len(few) <= BINS else sorted({values[1000 * j // BINS] for j in range(1, BINS)} - {few[0]}))
    return edges


def with_bins(df: DataFrame, features: str, edges: Sequence[Sequence[float]]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns for the bins of the vector, and a bin for every entry (0 where there is one only)."""
    split = [i for i, e in enumerate(edges) if e]
    df = df.withColumn("_entries", vector_to_array(features)).withColumns({f"_entry{i}": F.col("_entries")[i] for i in split})
    if split:
        ends = [[-math.inf, *edges[i], math.inf] for i in split]
        df = Bucketizer(splitsArray=ends, inputCols=[f"_entry{i}" for i in split], outputCols=[f"_bin{i}" for i in split]).transform(df)
    bins = [F.col(f"_bin{i}") if i in split else F.lit(0.0) for i in range(len(edges))]
    return df.drop("_entries", *[f"_entry{i}" for i in split]), bins


class BoostedTrees(GBTRegressor):
    """MLlib's boosted trees, fitted on the combinations of bins that occur instead of on every row.

    MLlib's trees see an entry by its bin only, so rows in the same bins share every prediction: their number and
    mean label give the same splits, leaves and gains as the rows do. The rows are read once to find the bins and
    once to sum them up; the passes of the trees then grow with the combinations, which are never more than the rows.
    """

    def summed(self, df: DataFrame, edges: Sequence[Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
        """Stored: ``by``, the bins (``_code0``, …), ``_rows`` (or their weight) and the mean label of every combination."""
        y = F.col(self.getLabelCol()).cast("double")
        y = F.when(y.isNull() | F.isnan(y), F.raise_error(F.lit("Labels MUST NOT be Null or NaN")).cast("double")).otherwise(y)
        w = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        rows, bins = with_bins(df, self.getFeaturesCol(), edges)
        codes = [sum((F.shiftleft(b.cast("long"), BITS * i) for i, b in enumerate(bins[at:at + CODES])), F.lit(0).cast("long"))
                 for at in range(0, len(bins), CODES)]
        rows = rows.select(*by, *[c.alias(f"_code{i}") for i, c in enumerate(codes)], y.alias("_y"), w.alias("_w"))
        sums = rows.groupBy(*by, *[f"_code{i}" for i in range(len(codes))]).agg(
            F.sum("_w").alias("_rows"), F.sum(F.col("_w") * F.col("_y")).alias("_sum")).filter("_rows > 0")
        return cut_lineage(sums.withColumn("_label", F.col("_sum") / F.col("_rows")).drop("_sum"))

    def fit_sums(self, sums: DataFrame, edges: Sequence[Sequence[float]]) -> BinnedModel:
        bins = [F.shiftright(f"_code{i // CODES}", BITS * (i % CODES)).bitwiseAND(F.lit(BINS - 1)).cast("double") for i in range(len(edges))]
        rows = sums.select(array_to_vector(F.array(*bins)).alias("_bins"), "_rows", "_label")
        own = self.copy({self.featuresCol: "_bins", self.labelCol: "_label", self.weightCol: "_rows"})
        return BinnedModel(GBTRegressor._fit(own, rows), self.getFeaturesCol(), edges)

    def fitter(self, df: DataFrame, by: Sequence[str]) -> Callable[[Column], BinnedModel]:
        """fit(condition on ``by``): the rows are summed up once for all conditions."""
        edges = bin_edges(df, self.getFeaturesCol())
        sums = self.summed(df, edges, by)
        return lambda condition: self.fit_sums(sums.filter(condition), edges)

    def _fit(self, dataset: DataFrame) -> BinnedModel:
        if dataset.isEmpty():
            return super()._fit(dataset)  # MLlib's own error
        return self.fitter(dataset, [])(F.lit(True))


class BinnedModel:
    """Boosted trees that bin the rows they are given as those they were fitted on."""

    def __init__(self, model, features: str, edges: Sequence[Sequence[float]]):
        self.model, self.features, self.edges = model, features, edges

    @property
    def trees(self):
        return self.model.trees

    @property
    def featureImportances(self):
        return self.model.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        rows, bins = with_bins(df, self.features, self.edges)
        rows = self.model.transform(rows.withColumn("_bins", array_to_vector(F.array(*bins))))
        return rows.select(*df.columns, self.model.getPredictionCol())


def time_regressor(train: DataFrame, target: str, features: str = "features", prediction: str = "predicted_time",
                   trees: int = 1000, depth: int = 4):
    """Boosted trees on the finish time; the default number of trees is that of a full training run."""
    return BoostedTrees(featuresCol=features, labelCol=target, predictionCol=prediction, maxIter=trees,
                        maxDepth=depth, seed=42).fit(train)


def two_stage(train: DataFrame, columns: Sequence[str], target: str, relevance: str, **kw):
    """Score trained on relevance, then a regressor that also sees that score."""
    scorer = time_regressor(train, relevance, prediction="rank_score", **kw)
    scored = scorer.transform(train)
    vector = VectorAssembler(inputCols=["features", "rank_score"], outputCol="augmented")
    regressor = time_regressor(vector.transform(scored), target, "augmented", **kw)
    return scorer, vector, regressor


def two_stage_predict(models, df: DataFrame) -> DataFrame:
    scorer, vector, regressor = models
    return regressor.transform(vector.transform(scorer.transform(df)))


def ensemble_score(df: DataFrame, group: str, predicted_time: str, rank_score: str, w_time: float = 0.5,
                   w_rank: float = 0.5, out: str = "mu", hot=None) -> DataFrame:
    """Weighted sum of in-group z-scores, larger is better; an undefined z counts as 0."""
    df = df.withColumns({"_t": -F.col(predicted_time), "_k": F.col(rank_score).cast("double")})
    df = ingroup.z_score(df, group, ["_t", "_k"], hot)
    score = F.coalesce("_t_zscore", F.lit(0.0)) * w_time + F.coalesce("_k_zscore", F.lit(0.0)) * w_rank
    return df.withColumn(out, score).drop("_t", "_k", "_t_zscore", "_k_zscore")


def date_folds(df: DataFrame, day: str, splits: int) -> DataFrame:
    """(fold, date, role): expanding training dates, the next slice for validation.

    Only the distinct dates are ranked — at most one row per calendar day.
    """
    days = df.select(day).distinct()
    total = days.agg(F.count(F.lit(1))).scalar()
    placed = days.withColumn("_i", F.row_number().over(Window.orderBy(day)) - 1).withColumn("_n", total)
    fold = F.explode(F.sequence(F.lit(1), F.lit(splits))).alias("fold")
    cut = F.floor(F.col("_n") * (F.col("fold") + 1) / (splits + 2))
    end = F.floor(F.col("_n") * (F.col("fold") + 2) / (splits + 2))
    role = F.when(F.col("_i") < cut, "train").when(F.col("_i") < end, "validate")
    return placed.select(day, "_i", "_n", fold).withColumn("role", role).filter(
        F.col("role").isNotNull()).select("fold", day, "role")


def with_folds(df: DataFrame, day: str, splits: int) -> DataFrame:
    """Rows repeated per fold they take part in, with their role. The fold table has at
    most ``splits`` rows per calendar day and is broadcast."""
    return df.join(F.broadcast(date_folds(df, day, splits)), day)


def row_folds(df: DataFrame, order: Sequence[str], splits: int) -> DataFrame:
    """Rows repeated per fold they take part in: ``splits`` consecutive slices of n // (splits + 1) rows at the end
    of ``order`` (unique) are validated in turn by all rows before them. Positions come from range chunks."""
    total = df.agg(F.count(F.lit(1))).scalar()
    placed = skew.history(df, [], order, totals={"_i": F.lit(1)}, hot=skew.EVERYTHING).withColumn("_n", total)
    slice_rows = F.floor(F.col("_n") / (splits + 1))
    start = F.col("_n") - (splits + 1 - F.col("fold")) * slice_rows
    role = F.when(F.col("_i") < start, "train").when(F.col("_i") < start + slice_rows, "validate")
    folds = placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("role", role)
    return folds.filter(F.col("role").isNotNull()).drop("_i", "_n")


def group_holdout(df: DataFrame, group: str, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """(group, is_train): the earliest groups up to the first boundary at or beyond
    ``share`` of the rows. Running sizes over all groups are computed in chunks."""
    sizes = df.groupBy(group, *[c for c in order if c != group]).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    running = skew.history(sizes, [], order, totals={"_before": F.col("_n")}, hot=skew.EVERYTHING)
    return running.withColumn("is_train", F.col("_before") < F.floor(total * share)).drop("_before", "_n")


def contiguous_folds(df: DataFrame, order: Sequence[str], folds: int, out: str = "fold") -> DataFrame:
    """Folds of equal size that are consecutive in ``order`` (earlier folds one row larger)."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = skew.history(df, [], order, totals={"_i": F.lit(1)}, hot=skew.EVERYTHING).withColumn("_n", total)
    size, extra = F.floor(F.col("_n") / folds), F.col("_n") % folds
    in_large = extra * (size + 1)
    fold = F.when(F.col("_i") < in_large, F.floor(F.col("_i") / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("_i") - in_large, size)))
    return placed.withColumn(out, fold.cast("int")).drop("_i", "_n")


def stacked(df: DataFrame, target: str, learners: Mapping[str, object], folds: int = 5):
    """Out-of-fold predictions of each learner, a ridge model on them, and the learners
    refitted on all rows. ``df`` needs ``fold`` and ``features``; returns
    (out-of-fold frame, meta model, refitted learners)."""
    df = cut_lineage(df)

    def fitter(learner):
        return learner.fitter(df, ["fold"]) if isinstance(learner, BoostedTrees) else lambda rows: learner.fit(df.filter(rows))

    fits = {n: fitter(m.copy({m.predictionCol: n})) for n, m in learners.items()}
    parts = []
    for k in range(folds):
        valid = df.filter(F.col("fold") == k)
        for fit in fits.values():
            valid = fit(F.col("fold") != k).transform(valid)
        parts.append(valid)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    oof = VectorAssembler(inputCols=list(learners), outputCol="_meta").transform(oof)
    meta = LinearRegression(featuresCol="_meta", labelCol=target, predictionCol="stacked", regParam=1.0,
                            elasticNetParam=0.0).fit(oof)
    refitted = {n: fit(F.lit(True)) for n, fit in fits.items()}
    return meta.transform(oof), meta, refitted


def log_residual(y: Column, mu: Column) -> Column:
    """Target of the uncertainty model; ``exp`` undoes it."""
    return F.ln(F.abs(y - mu) + F.lit(1e-6))


def sigma_from_variance(variance: Column, fallback: Column) -> Column:
    """Square root of a predicted variance; negative, NULL or zero → the fallback."""
    sigma = F.sqrt(F.greatest(variance, F.lit(0.0)))
    return F.when(sigma > 0, sigma).otherwise(fallback)


def student_t_df(residuals: DataFrame, group: str, z: str, low: float = 2.1, high: float = 30.0,
                 step: float = 0.25, default: float = 5.0, hot=None) -> DataFrame:
    """Degrees of freedom with the highest Student-t likelihood per group, on a grid.

    The log-likelihood needs only n and Σ ln(1 + z²/ν) per grid point; groups under 3 rows get ``default``. These
    sums are far wider than a row, so the rows are dealt by group and summed up where they meet, in tasks
    of at most SUM_BYTES of sums; only hot groups are summed before they are shuffled.
    """
    grid = [round(low + i * step, 6) for i in range(int((high - low) / step + 1e-9) + 1)]
    x = F.col(z)

    def summed(rows: DataFrame, hot) -> DataFrame:
        rows = skew.dealt(rows, [group], total, max(SUM_BYTES // (8 * len(grid) + 32), 1)) if hot == [] else rows
        return rows.groupBy(group).agg(F.count(x).alias("n"), *[F.sum(F.log1p(x * x / nu)).alias(f"_s{i}") for i, nu in enumerate(grid)])

    total = residuals.count()
    sums = skew.by_part(residuals.select(group, z).filter(x.isNotNull()), [group], hot, summed)
    options = []
    for i, nu in enumerate(grid):
        constant = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
        options.append(F.struct((F.col("n") * constant - (nu + 1) / 2 * F.col(f"_s{i}")).alias("ll"),
                                F.lit(-nu).alias("neg")))
    best = -F.array_max(F.array(*options))["neg"]
    return sums.select(group, "n", F.when(F.col("n") < 3, F.lit(default)).otherwise(best).alias("nu"))


def assemble_predictions(entries: DataFrame, group: str, mu: str | None, sigma: str | None,
                         nu: DataFrame | None, keep: Sequence[str], hot=None) -> DataFrame:
    """mu, sigma and nu per entrant; a missing model counts as 1.0, nu is never negative."""
    out = entries
    if nu is not None:
        out = skew.lookup(out, nu.select(group, F.col("nu").alias("_nu")), [group], hot)
    else:
        out = out.withColumn("_nu", F.lit(None).cast("double"))

    def value(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c else F.lit(1.0)

    return out.select(*keep, value(mu).alias("mu"), value(sigma).alias("sigma"),
                      F.greatest(F.coalesce("_nu", F.lit(1.0)), F.lit(0.0)).alias("nu"))


def importance_table(model, names: Sequence[str]) -> DataFrame:
    """Feature importances and split counts of a tree ensemble, one row per feature."""
    splits = [0] * len(names)
    for tree in model.trees:
        for word in tree.toDebugString.split("If (feature ")[1:]:
            splits[int(word.split(" ")[0])] += 1
    gains = model.featureImportances.toArray()
    rows = [(n, int(s), float(g)) for n, s, g in zip(names, splits, gains)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, split int, gain double").orderBy(F.desc("gain"), "feature")
