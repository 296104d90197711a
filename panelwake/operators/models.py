"""Forward-chaining folds, baseline models, inverse-propensity weighting, design matrix."""

from __future__ import annotations

import functools
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.functions import numeric
from panelwake.operators import ranking
from panelwake.operators.order import quantiles
from panelwake.session import durable

# The search space of the propensity and the risk model.
PROPENSITY_DIMS = [
    ("num_leaves", [31, 63, 127]),
    ("max_depth", [-1, 6, 10]),
    ("learning_rate", [0.02, 0.05, 0.1]),
    ("n_estimators", [400, 800, 1500]),
    ("min_child_samples", [20, 50, 100]),
    ("subsample", [0.7, 0.9, 1.0]),
    ("colsample_bytree", [0.6, 0.8, 1.0]),
    ("reg_lambda", [0.0, 1.0, 5.0]),
]
RISK_DIMS = [
    *PROPENSITY_DIMS,
    ("scale_pos_weight", ["1", "sqrt", "full"]),
    ("clip_floor", [0.02, 0.05, 0.10]),
]
# The search space of the two-head model.
TWO_HEAD_DIMS = [
    ("width", [64, 128, 256]),
    ("depth", [2, 3]),
    ("dropout", [0.0, 0.15]),
    ("lam", [0.1, 0.3, 1.0, 3.0]),
    ("ustar", [25, 50, 100]),
    ("lr", [3e-4, 1e-3]),
    ("mu1", [0.0, 0.01, 0.1]),
    ("mu2", [0.0, 0.1, 1.0]),
]
SAMPLED_CONFIGS = 60
FITS_AT_A_TIME = 4
MOST_LEVELS = 1000
#: Training rows of trees one task holds; each round reads them from its cache.
TREE_ROWS = 100_000


def train_rows(df: DataFrame, fold: int, first: int, period: str = "season") -> DataFrame:
    return df.where((F.col(period) >= first) & (F.col(period) < fold))


def validation_rows(df: DataFrame, fold: int, period: str = "season") -> DataFrame:
    return df.where(F.col(period) == fold)


def fold_totals(per_period: DataFrame, folds: list[int], groups: list[str], sums: list[str]) -> DataFrame:
    """Training and validation totals of every fold from one row per period.

    Training totals are running sums over periods, so no row is copied per fold.
    """
    fold = F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")
    rows = per_period.select("*", fold)
    split = F.when(F.col("season") < F.col("fold"), "train").when(
        F.col("season") == F.col("fold"), "validation"
    )
    return (
        rows.withColumn("split", split)
        .where(F.col("split").isNotNull())
        .groupBy("fold", "split", *groups)
        .agg(*[F.sum(s).alias(s) for s in sums])
    )


def fold_moments(df: DataFrame, columns: list[str], folds: list[int], period: str = "season") -> DataFrame:
    """Mean and population deviation per fold and column over training rows, NULLs left out.

    A column without values gets mean 0; one without spread gets deviation 1. Each period is reduced
    to (n, mean, squared deviations) first; folds combine those.
    """
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("m"),
                (F.var_pop(x) * F.count(x)).alias("ss"),
            )
        )
    per_period = (
        df.groupBy(F.col(period).alias("season"))
        .agg(F.array(*stats).alias("stats"))
        .select("season", F.explode("stats").alias("s"))
        .select("season", "s.*")
    )
    fold = F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold")
    rows = per_period.select("*", fold).where(F.col("season") < F.col("fold"))
    total = F.sum("n")
    means = rows.groupBy("fold", "column").agg(
        total.alias("n"),
        F.try_divide(F.sum(F.col("n") * F.coalesce("m", F.lit(0.0))), total).alias("mean"),
        F.sum("ss").alias("_within"),
        F.collect_list(F.struct("n", "m")).alias("_parts"),  # one entry per period
    )
    between = F.aggregate(
        F.filter("_parts", lambda p: p["n"] > 0),
        F.lit(0.0),
        lambda acc, p: acc + p["n"] * F.pow(p["m"] - F.col("mean"), 2),
    )
    std = F.sqrt(F.try_divide(F.coalesce("_within", F.lit(0.0)) + between, F.col("n")))
    return means.select(
        "fold",
        "column",
        "n",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(std > 1e-12, std).otherwise(1.0).alias("std"),
    )


def pooled_rates(df: DataFrame, k: str, u: str, eligible: Column, folds: list[int], caps: list[float]) -> DataFrame:
    """Sum of capped events over sum of capped units on eligible training rows, per fold and cap."""
    cap = F.explode(F.array(*[F.lit(float(c)) for c in caps])).alias("cap")
    rows = df.where(eligible).select("season", F.col(k).alias("k"), F.col(u).alias("u"), cap)
    u_c, k_c = numeric.cap_units(F.col("u"), F.col("k").cast("double"), F.col("cap"))
    per_period = rows.groupBy("season", "cap").agg(F.sum(k_c).alias("k"), F.sum(u_c).alias("u"))
    totals = fold_totals(per_period, folds, ["cap"], ["k", "u"])
    return totals.where(F.col("split") == "train").select(
        "fold", "cap", F.try_divide("k", "u").alias("pooled_rate")
    )


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: only 0/1 values? any NULL? One pass."""
    facts = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.bool_and(F.col(c).isin(0, 1) | F.col(c).isNull()), F.lit(True)).alias("is_binary"),
            F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias("has_null"),
        )
        for c in columns
    ]
    return df.agg(F.array(*facts).alias("f")).select(F.explode("f").alias("x")).select("x.*")


def design_columns(
    standard: dict[str, tuple[float, float]],
    binary: list[str],
    nullable: list[str],
    one_hot: dict[str, list[str]],
) -> dict[str, Column]:
    """Standardised, passed-through, missing-flag and one-hot columns; NULL becomes 0 after scaling."""
    out: dict[str, Column] = {}
    for c, (mean, std) in standard.items():
        out[c] = F.coalesce((F.col(c) - mean) / std, F.lit(0.0))
    for c in binary:
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    for c in nullable:
        out[f"{c}__isna"] = F.col(c).isNull().cast("double")
    for c, levels in one_hot.items():
        for level in levels:
            hit = F.coalesce(F.col(c) == level, F.lit(False))
            out[f"{c}=={level}"] = hit.cast("double")
    return out


def persistence_score(lag1: Column, total: Column) -> Column:
    return lag1 * 1e6 + total


def duplicate_target(n: Column) -> Column:
    return (F.coalesce(n, F.lit(0)) >= 2).cast("int")


def propensity_weight(label: Column, rhat: Column, floor: float | Column) -> Column:
    cap = floor if isinstance(floor, Column) else F.lit(floor)
    return F.when(label == 1, 1.0 / F.greatest(rhat, cap)).otherwise(1.0)


def positive_weight(choice: str, ratio: float) -> float:
    return {"1": 1.0, "sqrt": ratio**0.5, "full": ratio}[choice]


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives over positives, and the three choices of a positive-class weight."""
    neg = F.count_if(F.col(label) == 0)
    pos = F.count_if(F.col(label) == 1)
    return df.agg((neg / F.greatest(pos, F.lit(1))).alias("full")).select(
        F.lit(1.0).alias("one"), F.sqrt("full").alias("sqrt"), "full"
    )


# -- logistic baseline ---------------------------------------------------------------------------


def logistic_facts(train: DataFrame, numbers: list[str], category: str) -> dict:
    """Training medians, category levels, means and deviations; all are small results.

    Medians come from prefix sums over distinct values, so no task holds a column. A category has at
    most MOST_LEVELS levels; more are refused before they are collected.
    """
    medians = {
        c: quantiles(train.select(F.col(c).cast("double").alias(c)), [], c, [0.5]).first() for c in numbers
    }
    levels = train.select(F.coalesce(category, F.lit("MISSING")).alias("v")).distinct()
    found = [r["v"] for r in levels.limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ValueError(f"{category} has more than {MOST_LEVELS} levels")
    return {"medians": {c: r["q0"] if r else None for c, r in medians.items()}, "levels": sorted(found)}


def logistic_inputs(df: DataFrame, lag: str, category: str, facts: dict) -> DataFrame:
    """Imputed numbers with missing flags, and one-hot levels."""
    cols = {"x_lag": F.col(lag).cast("double")}
    for c, m in facts["medians"].items():
        cols[f"x_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(m))
        cols[f"x_{c}_missing"] = F.col(c).isNull().cast("double")
    flags = {
        f"h_{i}": (F.coalesce(category, F.lit("MISSING")) == level).cast("double")
        for i, level in enumerate(facts["levels"])
    }
    return df.withColumns(cols | flags)


def standardised(df: DataFrame, facts: dict) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in facts["scale"].items()})


def fit_logistic(
    train: DataFrame, lag: str, numbers: list[str], category: str, label: str
) -> tuple[PipelineModel, dict]:
    """L2 logistic regression on standardised numbers and one-hot categories.

    The summed-loss objective with unit penalty is Spark's mean-loss one with penalty 1 / rows.
    """
    facts = logistic_facts(train, numbers, category)
    ready = logistic_inputs(train, lag, category, facts)
    numeric_cols = ["x_lag"] + [f"x_{c}{s}" for c in numbers for s in ("", "_missing")]
    row = ready.agg(
        F.count("*").alias("rows"),
        *[F.avg(c).alias(f"m_{c}") for c in numeric_cols],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric_cols],
    ).first()
    facts["scale"] = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in numeric_cols}
    inputs = [*numeric_cols, *[f"h_{i}" for i in range(len(facts["levels"]))]]
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=inputs, outputCol="_x"),
            LogisticRegression(
                featuresCol="_x",
                labelCol=label,
                probabilityCol="_prob",
                rawPredictionCol="_raw",
                predictionCol="_pred",
                regParam=1.0 / row["rows"],
                elasticNetParam=0.0,
                standardization=False,
                maxIter=200,
                tol=1e-6,
            ),
        ]
    )
    return pipeline.fit(standardised(ready, facts)), facts


def score_logistic(
    model: PipelineModel, df: DataFrame, lag: str, category: str, facts: dict, name: str
) -> DataFrame:
    return probability(
        model.transform(standardised(logistic_inputs(df, lag, category, facts), facts)), name
    )


def logistic_gradient(
    model: PipelineModel, train: DataFrame, lag: str, category: str, facts: dict, label: str
) -> DataFrame:
    """One row: rows, positives, and the largest slope of the penalised loss per row at the fit.

    The summed loss plus half the squared weights is flat at its minimum; the intercept is not penalised.
    """
    inputs, fitted = model.stages[0].getInputCols(), model.stages[-1]
    ready = model.transform(standardised(logistic_inputs(train, lag, category, facts), facts))
    error = vector_to_array(F.col("_prob"))[1] - F.col(label)
    slopes = [
        F.abs(F.sum(error * F.col(c)) + F.lit(float(w))) for c, w in zip(inputs, fitted.coefficients.toArray())
    ]
    return ready.agg(
        F.count("*").alias("rows"),
        F.sum(F.col(label).cast("long")).alias("positives"),
        (F.greatest(*slopes, F.abs(F.sum(error))) / F.count("*")).alias("slope"),
    )


def probability(df: DataFrame, name: str) -> DataFrame:
    """Positive-class probability as a plain column."""
    helper = [c for c in df.columns if c.startswith(("_", "x_", "h_"))]
    return df.withColumn(name, vector_to_array(F.col("_prob"))[1]).drop(*helper)


# -- boosted trees -------------------------------------------------------------------------------


def nominal(name: str, levels: list[str]) -> dict:
    """Column metadata that tells trees a number is a category; level 0 is any other value or none."""
    return {"ml_attr": {"type": "nominal", "name": name, "vals": ["(other)", *levels]}}


def tree_columns(features: list[str], categories: dict[str, list[str]]) -> list[str]:
    """Inputs of the trees: a number and a flag for NULL per number, one category per category."""
    return [t for c in features for t in ([f"t_{c}"] if c in categories else [f"t_{c}", f"t_{c}_null"])]


def tree_inputs(df: DataFrame, features: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """Numbers with -1 for NULL and a flag for it; categories as unordered levels."""
    cols = {}
    for c in features:
        if c in categories:
            vocab = F.array(*[F.lit(v) for v in categories[c]])
            level = F.coalesce(F.array_position(vocab, F.col(c)), F.lit(0)).cast("double")
            cols[f"t_{c}"] = level.alias(f"t_{c}", metadata=nominal(c, categories[c]))
        else:
            cols[f"t_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
            cols[f"t_{c}_null"] = F.col(c).isNull().cast("double")
    return df.select("*", *[v if k in [f"t_{c}" for c in categories] else v.alias(k) for k, v in cols.items()])


def fit_trees(
    train: DataFrame,
    features: list[str],
    categories: dict[str, list[str]],
    label: str,
    weight: str | None = None,
    rounds: int = 20,
    depth: int = 4,
    rate: float = 0.1,
    subsample: float = 1.0,
    min_rows: int = 1,
    columns: str = "all",
    stop_on: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees; a weight column turns the plain model into the weighted one.

    `stop_on` names a boolean column of validation rows: boosting ends when their loss stops falling.
    """
    trees = GBTClassifier(
        featuresCol="_t",
        labelCol=label,
        predictionCol="_pred",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        minInstancesPerNode=min_rows,
        featureSubsetStrategy=columns,
        maxBins=max([32, *[len(v) + 1 for v in categories.values()]]),
        seed=seed,
    )
    trees = trees.setProbabilityCol("_prob").setRawPredictionCol("_raw")
    if weight:
        trees = trees.setWeightCol(weight)
    if stop_on:
        trees = trees.setValidationIndicatorCol(stop_on)
    pipeline = Pipeline(
        stages=[VectorAssembler(inputCols=tree_columns(features, categories), outputCol="_t"), trees]
    )
    return pipeline.fit(tree_inputs(spread_rows(train), features, categories))


def spread_rows(train: DataFrame) -> DataFrame:
    """Training rows in tasks of TREE_ROWS at most; a table that lies in as many parts stays as it is."""
    parts = math.ceil(train.count() / TREE_ROWS)
    return train.repartition(parts) if parts > train.rdd.getNumPartitions() else train


def score_trees(
    model: PipelineModel, df: DataFrame, features: list[str], categories: dict[str, list[str]], name: str
) -> DataFrame:
    out = model.transform(tree_inputs(df, features, categories))
    return out.withColumn(name, vector_to_array(F.col("_prob"))[1]).drop(
        "_t", "_prob", "_raw", "_pred", *tree_columns(features, categories)
    )


def require_trees(model: PipelineModel, expected: int) -> None:
    got = model.stages[-1].getNumTrees
    if got != expected:
        raise ValueError(f"model has {got} trees, expected {expected}")


def reload_difference(a: DataFrame, b: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Largest score difference between two scorings of the same rows, and rows without partner."""
    left = a.select(*keys, F.col(score).alias("_a"))
    right = b.select(*keys, F.col(score).alias("_b"))
    return left.join(right, keys, "full_outer").agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unpaired"),
    )


# -- search --------------------------------------------------------------------------------------


ROUNDS = 4


def permuted(index: Column, sizes: list[int], seed: int) -> Column:
    """The place of an index in a keyed permutation of [0, product of the sizes).

    The index is split in two digits; each round adds a hash of one digit to the other, which can be
    undone, so every index has its own place and the n-th draw needs no sort of the space.
    """
    cut = max(1, len(sizes) // 2)
    high, low = math.prod(sizes[:cut]), math.prod(sizes[cut:])

    def mixed(digit: Column, turn: int) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(turn)), digit.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    a, b = F.floor(index.cast("long") / F.lit(low)), index.cast("long") % low
    for turn in range(ROUNDS):
        if turn % 2 == 0:
            a = (a + mixed(b, turn)) % high
        else:
            b = (b + mixed(a, turn)) % low
    return a * F.lit(low) + b


def sampled_configs(spark: SparkSession, dims: list[tuple[str, list]], n: int, seed: int) -> DataFrame:
    """Seeded sample of a configuration space without repeats, decoded, in index order."""
    sizes = [len(values) for _, values in dims]
    chosen = spark.range(min(n, math.prod(sizes))).select(permuted(F.col("id"), sizes, seed).alias("config"))
    decoded = numeric.mixed_radix(F.col("config"), dims)
    return chosen.select("config", *[c.alias(name) for name, c in decoded.items()]).orderBy("config")


def repeated_projections(configs: DataFrame, without: list[str]) -> DataFrame:
    """Configurations that become equal once some dimensions are dropped."""
    others = [c for c in configs.columns if c not in ("config", *without)]
    return configs.groupBy(*others).agg(
        F.count("*").alias("n"), F.min("config").alias("first_config")
    ).where(F.col("n") > 1)


def work_list(configs: DataFrame, folds: list[int], seeds: list[int]) -> DataFrame:
    """Every configuration with every fold and seed, unrolled from literal lists."""
    return configs.select(
        "*",
        F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold"),
    ).select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))


def tree_settings(config: dict) -> dict:
    """A configuration of the search space in Spark's terms.

    Leaves become the depth that can hold them. There is no counterpart of the leaf-weight penalty.
    """
    leaves = math.ceil(math.log2(config["num_leaves"]))
    depth = leaves if config["max_depth"] < 0 else min(leaves, config["max_depth"])
    share = config["colsample_bytree"]
    return {
        "depth": depth,
        "rate": config["learning_rate"],
        "rounds": config["n_estimators"],
        "min_rows": config["min_child_samples"],
        "subsample": config["subsample"],
        "columns": "all" if share >= 1.0 else str(share),
    }


def search_trees(
    frame: DataFrame,
    configs: list[dict],
    folds: list[int],
    first: int,
    features: list[str],
    categories: dict[str, list[str]],
    label: str,
    weight: str | None = None,
    overrides: dict | None = None,
) -> DataFrame:
    """Fit every configuration on every fold and measure it on the fold's validation rows.

    `frame` is durable and has `season`, `zero_history` and `_tie`, and `rhat` where configurations have
    a `clip_floor`: positives then weigh the inverse of the clipped propensity. `scale_pos_weight`
    weighs positives by the class ratio of the fold's training rows or its root. Fits do not depend on
    each other, so a few run at a time; all scores are measured in one grouped report. Result: config,
    fold, best_round, pr_auc and the precision at 250 of the zero-history stratum.
    """

    def fit(job: tuple[dict, int]) -> tuple[DataFrame, int]:
        config, fold = job
        settings = tree_settings(config) | (overrides or {})
        both = frame.where((F.col("season") >= first) & (F.col("season") <= fold)).withColumn(
            "_watch", F.col("season") == fold
        )
        own = F.col(weight) if weight else F.lit(1.0)
        if "clip_floor" in config:
            own = own * propensity_weight(F.col(label), F.col("rhat"), config["clip_floor"])
        if "scale_pos_weight" in config:
            ratio = class_ratio(both.where(~F.col("_watch")), label).first()["full"]
            positive = F.lit(positive_weight(config["scale_pos_weight"], ratio))
            own = own * F.when(F.col(label) == 1, positive).otherwise(1.0)
        both = both.withColumn("_weight", own)
        fitted = fit_trees(both, features, categories, label, "_weight", stop_on="_watch", **settings)
        valid = score_trees(fitted, validation_rows(frame, fold), features, categories, "_score")
        named = valid.select(
            F.lit(config["config"]).cast("long").alias("config"),
            F.lit(fold).cast("int").alias("fold"),
            label,
            "zero_history",
            "_tie",
            "_score",
        )
        return named, fitted.stages[-1].getNumTrees

    jobs = [(config, fold) for config in configs for fold in folds]
    with ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        done = list(pool.map(fit, jobs))
    scored = durable(functools.reduce(DataFrame.unionByName, [rows for rows, _ in done]))
    groups = ["config", "fold", "stratum"]
    strata = ranking.by_stratum(scored, "zero_history")
    found = ranking.report(strata, groups, "_score", label, F.col("_tie"), [250])
    pick = lambda stratum, c: F.max(F.when(F.col("stratum") == stratum, F.col(c)))
    metrics = found.groupBy("config", "fold").agg(
        pick("all", "pr_auc").alias("pr_auc"), pick("zero", "p_at_250").alias("zero_p250")
    )
    rounds = frame.sparkSession.createDataFrame(
        [(c["config"], fold, n) for (c, fold), (_, n) in zip(jobs, done)], "config long, fold int, best_round int"
    )
    return rounds.join(metrics, ["config", "fold"], "left").select("config", "fold", "best_round", "pr_auc", "zero_p250")


def search_winner(metrics: DataFrame) -> DataFrame:
    """Mean metrics per configuration: best mean precision first, then the stratum, then the number."""
    means = metrics.groupBy("config").agg(
        F.avg("pr_auc").alias("mean_ap"), F.avg("zero_p250").alias("mean_zero_p250")
    )
    order = [F.desc("mean_ap"), F.desc_nulls_last("mean_zero_p250"), F.asc("config")]
    return ranking.lexicographic_best(means, order, "mean_ap").join(refit_rounds(metrics), "config")


def refit_rounds(best_rounds: DataFrame) -> DataFrame:
    """Rounds of the final fit: the mean best round over folds, rounded half to even."""
    return best_rounds.groupBy("config").agg(F.bround(F.avg("best_round"), 0).cast("int").alias("rounds"))
