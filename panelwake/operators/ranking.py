"""Ranking quality: precision at k, average precision, ROC area, rank percentiles, sign test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwake.functions.numeric import log_choose
from panelwake.operators.order import join_groups, join_small, prefix_sums, quantiles, split_points
from panelwake.session import durable

# Cut-offs of the report.
TOP_K = [100, 250, 500, 1000, 2500]
SALTS = 64
TERMS = 1024  # of a binomial tail, summed as one piece


def tie_key(seed: int, *keys: str) -> Column:
    """Tie breaker that depends on the row's own key and a seed only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def score_groups(scored: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Rows and positives per distinct score; what every rank statistic needs."""
    return scored.groupBy(*groups, score).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("tp")
    )


def curve(
    scored: DataFrame, groups: list[str], score: str, label: str, splits: list[float] | None = None
) -> DataFrame:
    """Running true positives and rows over descending distinct scores."""
    if splits is None:
        splits = split_points(scored, score)
    counts = score_groups(scored, groups, score, label)
    return prefix_sums(counts, groups, score, ["n", "tp"], splits, descending=True)


def areas(points: DataFrame, groups: list[str], edge_k: int | None = None) -> DataFrame:
    """n, positives, prevalence, average precision (step sum) and ROC area (ties half).

    Both areas are NULL when only one class is present. With edge_k, column _edge holds the score at
    which the first edge_k rows end; NULL when the group is shorter.
    """
    score = [c for c in points.columns if c not in groups][0]
    tp, n, ctp, cn = (F.col(c) for c in ("tp", "n", "cum_tp", "cum_n"))
    fp = n - tp
    pos, rows = F.max("all_tp"), F.max("all_n")
    two = (pos > 0) & (pos < rows)
    ap = F.try_divide(F.sum(tp * ctp / cn), pos)
    auc = F.try_divide(F.sum(fp * (ctp - tp / 2.0)), pos.cast("double") * (rows - pos))
    edge = [F.max(F.when(cn >= edge_k, F.col(score))).alias("_edge")] if edge_k else []
    return points.groupBy(*groups).agg(
        rows.alias("n"),
        pos.alias("pos"),
        (pos / rows).alias("prevalence"),
        F.when(two, ap).alias("pr_auc"),
        F.when(two, auc).alias("roc_auc"),
        *edge,
    )


def top_k(
    scored: DataFrame,
    groups: list[str],
    score: str,
    label: str,
    tie: Column,
    edges: DataFrame,
    ks: list[int] = TOP_K,
) -> DataFrame:
    """Precision in the first k rows of each group for every k in one pass.

    `edges` is durable and has one row per group with the score the first max(ks) rows end at, so only
    rows from there up are looked at. Rows tied at the edge may be many: they are cut to max(ks) inside salted
    sub-groups first, and what is left is at most salts x max(ks) rows per group.
    """
    most = max(ks)
    candidates = (
        join_small(
            scored.select(*groups, score, label, tie.alias("_tie")), edges.select(*groups, "_edge"), groups
        )
        .where(F.col("_edge").isNull() | (F.col(score) >= F.col("_edge")))
        .withColumn("_salt", F.pmod(F.xxhash64("_tie"), F.lit(SALTS)))
    )
    best_first = [F.desc(score), F.col("_tie")]
    for parts in ([*groups, "_salt"], groups):
        at = F.row_number().over(W.partitionBy(*parts).orderBy(*best_first))
        candidates = candidates.withColumn("_rn", at).where(F.col("_rn") <= most)
    size = F.max("_rn")
    hit = lambda k: F.sum(F.when(F.col("_rn") <= k, F.col(label)).otherwise(0))
    return candidates.groupBy(*groups).agg(
        *[F.when(size >= k, hit(k).cast("double") / k).alias(f"p_at_{k}") for k in ks]
    )


def report(
    scored: DataFrame,
    groups: list[str],
    score: str,
    label: str,
    tie: Column,
    ks: list[int] = TOP_K,
    splits: list[float] | None = None,
) -> DataFrame:
    """One row per group with all ranking metrics.

    NULL is a group like any other. Rows without a score are in no rank and in no metric;
    `without_score` counts them.
    """
    scored = scored.where(F.col(score).isNotNull())
    whole = durable(areas(curve(scored, groups, score, label, splits), groups, max(ks)))
    return join_groups(whole, top_k(scored, groups, score, label, tie, whole, ks), groups).drop("_edge")


def without_score(scored: DataFrame, groups: list[str], score: str) -> DataFrame:
    """Rows per group, and those of them that no ranking can place."""
    return scored.groupBy(*groups).agg(
        F.count("*").alias("rows"), F.count_if(F.col(score).isNull()).alias("unscored")
    )


def by_stratum(scored: DataFrame, zero_flag: str, stratum: str = "stratum") -> DataFrame:
    """Every row under 'all' and under its own stratum."""
    own = F.when(F.col(zero_flag), "zero").otherwise("any")
    return scored.withColumn(stratum, F.explode(F.array(F.lit("all"), own)))


def rank_percentiles(
    scored: DataFrame, groups: list[str], score: str, splits: list[float] | None = None
) -> DataFrame:
    """Per distinct score: average rank (1 = highest, ties share it) and 1 - (rank - 1) / (N - 1)."""
    if splits is None:
        splits = split_points(scored, score)
    counts = scored.groupBy(*groups, score).agg(F.count("*").alias("n"))
    ranked = prefix_sums(counts, groups, score, ["n"], splits, descending=True)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    return ranked.select(
        *groups,
        score,
        "n",
        "all_n",
        rank.alias("avg_rank"),
        (1.0 - F.try_divide(rank - 1.0, F.col("all_n") - 1.0)).alias("pct"),
    )


def sign_test(deltas: DataFrame, groups: list[str], delta: str, alpha: float = 0.05) -> DataFrame:
    """One-sided exact sign test of 'median delta <= 0' per group; zero deltas are dropped and counted.

    The binomial tail is summed in pieces of its terms that count, the median comes from prefix sums.
    """
    d = F.col(delta)
    facts = deltas.groupBy(*groups).agg(
        F.count(d).alias("realized_n"),
        F.count_if(d == 0).alias("n_dropped_zero"),
        F.count_if(d != 0).alias("n_signtest"),
        F.count_if(d > 0).alias("n_positive"),
    )
    median = quantiles(deltas, groups, delta, [0.5]).select(*groups, F.col("q0").alias("median_delta"))
    n, k = F.col("n_signtest"), F.col("n_positive")
    # past the centre the short tail is summed, before it the complement; terms further than 20
    # standard deviations from the centre add less than 1e-85
    upper = k * 2 > n
    reach = F.ceil(10 * F.sqrt(n.cast("double"))).cast("long") + TERMS
    middle = F.floor(n / 2).cast("long")
    first = F.when(upper, k).otherwise(F.greatest(middle - reach, F.lit(0)))
    last = F.when(upper, F.least(n, F.greatest(middle, k) + reach)).otherwise(k - 1)
    parts = facts.where((n > 0) & (last >= first)).select(
        *groups,
        "n_signtest",
        last.alias("_last"),
        F.explode(F.sequence(first, last, F.lit(TERMS).cast("long"))).alias("_from"),
    )
    terms = parts.select(
        *groups,
        "n_signtest",
        F.explode(F.sequence("_from", F.least(F.col("_from") + TERMS - 1, F.col("_last")))).alias("i"),
    )
    log_p = log_choose(F.col("n_signtest").cast("double"), F.col("i").cast("double")) - F.col(
        "n_signtest"
    ) * math.log(2.0)
    tail = terms.groupBy(*groups).agg(F.sum(F.exp(log_p)).alias("_tail"))
    t = F.coalesce("_tail", F.lit(0.0))
    p = F.when(n > 0, F.when(upper, t).otherwise(1.0 - t))
    return (
        join_groups(join_groups(facts, median, groups, "left"), tail, groups, "left")
        .withColumn("p_one_sided", p)
        .withColumn("reject", F.col("p_one_sided") < alpha)
        .drop("_tail")
    )


def lexicographic_best(metrics: DataFrame, order: list[Column], margin_of: str, n: int = 2) -> DataFrame:
    """Winner, runner-up and the winner's margin over it."""
    w = W.partitionBy(F.lit(0)).orderBy(*order)
    top = metrics.orderBy(*order).limit(n)  # n rows
    return top.withColumn("place", F.row_number().over(w)).withColumn(
        "margin", F.col(margin_of) - F.lead(margin_of).over(w)
    )


def spread(metrics: DataFrame, groups: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return metrics.groupBy(*groups).agg(
        F.count(v).alias("runs"),
        F.avg(v).alias("mean"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.stddev_pop(v).alias("std"),
        (F.max(v) - F.min(v)).alias("range"),
    )


def zero_history(entities: DataFrame, first_event: DataFrame, entity: str, cutoff: Column) -> DataFrame:
    """Flag entities without any event before the cutoff; first_event has one row per entity."""
    out = entities.join(first_event, entity, "left")
    return out.withColumn("zero_history", F.col("first_ts").isNull() | (F.col("first_ts") >= cutoff))


def audit_sample(df: DataFrame, eligible: Column, key: list[str], n: int) -> DataFrame:
    """First n rows and first n eligible rows in key order, each once."""
    order = [F.col(k) for k in key]
    first = df.orderBy(*order).limit(n)
    chosen = df.where(eligible).orderBy(*order).limit(n)
    return first.unionByName(chosen).dropDuplicates(key)
