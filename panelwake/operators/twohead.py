"""Two-head model of failure F and per-unit reporting p, seen through q = F * (1 - (1 - p)^u)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwake.functions import numeric
from panelwake.functions.numeric import CLAMP_EPS, TRUNC_EPS
from panelwake.session import durable

# -- the loss over a scored table, as column expressions -----------------------------------------


def loss_columns(y: Column, f: Column, p: Column, u: Column, k: Column, eligible: Column, pbar: Column) -> dict[str, Column]:
    """Per-row terms; u and k are capped already."""
    p_c = numeric.clamp(p, CLAMP_EPS, 1 - CLAMP_EPS)
    r = numeric.detection(p_c, u)
    q = numeric.clamp(f * r, CLAMP_EPS, 1 - CLAMP_EPS)
    bce = -(y * F.log(q) + (1.0 - y) * F.log(1.0 - q))
    comb = numeric.log_choose(u, k)
    log_r = F.log(F.greatest(1.0 - F.pow(1.0 - p_c, u), F.lit(TRUNC_EPS)))
    return {
        "bce": bce,
        "comb": F.when(eligible, comb),
        "klogp": F.when(eligible, k * F.log(p_c)),
        "uklog1mp": F.when(eligible, (u - k) * F.log(1.0 - p_c)),
        "log_r": F.when(eligible, log_r),
        "omega1": F.pow(numeric.logit(p_c) - numeric.logit(pbar), 2),
        "r": r,
        "q": q,
    }


def loss_terms(scored: DataFrame, groups: list[str], lam: float, mu1: float, mu2: float) -> DataFrame:
    """Loss terms over a scored table.

    Columns used: y, f, p, u, k, eligible, pbar, f_shifted (f with one input raised).
    """
    c = {n: F.col(n) for n in ("y", "f", "p", "u", "k", "eligible", "pbar", "f_shifted")}
    terms = loss_columns(c["y"], c["f"], c["p"], c["u"], c["k"], c["eligible"], c["pbar"])
    rows = scored.withColumns(
        {f"_{n}": t for n, t in terms.items()} | {"_hinge": hinge(c["f"], c["f_shifted"])}
    )
    nll = -(F.avg("_comb") + F.avg("_klogp") + F.avg("_uklog1mp") - F.avg("_log_r"))
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.count_if("eligible").alias("n_eligible"),
        F.avg("_bce").alias("bce"),
        F.avg("_comb").alias("nll_comb"),
        F.avg("_klogp").alias("nll_klogp"),
        F.avg("_uklog1mp").alias("nll_uklog1mp"),
        F.avg("_log_r").alias("nll_log_r"),
        F.coalesce(nll, F.lit(0.0)).alias("nll"),
        F.avg("_omega1").alias("omega1"),
        F.avg("_hinge").alias("omega2"),
    )
    total = F.col("bce") + lam * F.col("nll") + mu1 * F.col("omega1") + mu2 * F.col("omega2")
    return out.withColumn("total", total)


def hinge(base: Column, shifted: Column) -> Column:
    """Squared drop of a score when an input that should raise it is raised."""
    return F.pow(F.greatest(F.lit(0.0), base - shifted), 2)


def clamp_counts(scored: DataFrame) -> DataFrame:
    """How often the numeric guards bind."""
    p_c = numeric.clamp(F.col("p"), CLAMP_EPS, 1 - CLAMP_EPS)
    q = F.col("f") * numeric.detection(p_c, F.col("u"))
    return scored.agg(
        F.count_if(F.col("p") != p_c).alias("p_clamped"),
        F.count_if((q < CLAMP_EPS) | (q > 1 - CLAMP_EPS)).alias("q_clamped"),
    )


# -- fitting: gradients per batch in the tasks, summed by Spark ----------------------------------


@dataclass(frozen=True)
class Settings:
    width: int = 16  # hidden units; 0 gives two linear heads
    lam: float = 0.3
    mu1: float = 0.01
    mu2: float = 0.1
    rate: float = 0.03
    decay: float = 1e-5
    epochs: int = 40
    patience: int = 8
    shift_index: int = -1  # design column the hinge raises by half a deviation
    pbar: float = 0.1
    seed: int = 42


def shapes(d: int, s: Settings) -> list[tuple[str, tuple[int, ...]]]:
    if s.width == 0:
        return [("wf", (d,)), ("bf", (1,)), ("wp", (d,)), ("bp", (1,))]
    return [("w1", (d, s.width)), ("b1", (s.width,)), ("wf", (s.width,)), ("bf", (1,)), ("wp", (s.width,)), ("bp", (1,))]


def unpack(theta: np.ndarray, d: int, s: Settings) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(d, s):
        size = int(np.prod(shape))
        out[name] = theta[at : at + size].reshape(shape)
        at += size
    return out


def initial(d: int, s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    parts = []
    for _, shape in shapes(d, s):
        bound = 1.0 / math.sqrt(shape[0] if len(shape) > 1 else max(shape[0], 1))
        parts.append(rng.uniform(-bound, bound, int(np.prod(shape))))
    theta = np.concatenate(parts)
    theta[-1] = math.log(s.pbar / (1 - s.pbar))
    return theta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def heads(theta: np.ndarray, x: np.ndarray, s: Settings):
    w = unpack(theta, x.shape[1], s)
    h = np.maximum(x @ w["w1"] + w["b1"], 0.0) if s.width else x
    return _sigmoid(h @ w["wf"] + w["bf"]), _sigmoid(h @ w["wp"] + w["bp"]), h


def batch_sums(theta: np.ndarray, x, y, u, k, el, s: Settings, weight=None) -> np.ndarray:
    """Sums over a batch: rows, eligible rows, four loss sums, and the gradient of each sum.

    A row counts `weight` times, once without weights.
    """
    d = x.shape[1]
    n = np.ones(len(y)) if weight is None else weight
    w = unpack(theta, d, s)
    f, p_raw, h = heads(theta, x, s)
    p = np.clip(p_raw, CLAMP_EPS, 1 - CLAMP_EPS)
    miss = (1 - p) ** u
    r = 1 - miss
    q = np.clip(f * r, CLAMP_EPS, 1 - CLAMP_EPS)
    bce = -(y * np.log(q) + (1 - y) * np.log(1 - q))
    dq = -(y / q - (1 - y) / (1 - q))
    dp_r = u * (1 - p) ** (u - 1)
    rt = np.maximum(r, TRUNC_EPS)
    nll = np.where(el, -(k * np.log(p) + (u - k) * np.log(1 - p) - np.log(rt)), 0.0)
    dnll = np.where(el, -(k / p - (u - k) / (1 - p) - dp_r / rt), 0.0)
    gap = np.log(p) - np.log(1 - p) - math.log(s.pbar / (1 - s.pbar))
    pp = p * (1 - p)
    grads = [
        (dq * r * f * (1 - f), dq * f * dp_r * pp),  # d bce / d head inputs
        (np.zeros_like(f), dnll * pp),
        (np.zeros_like(f), 2 * gap),
    ]
    out = [np.array([n.sum(), n[el].sum(), n @ bce, n @ nll, n @ gap**2])]

    def back(zf, zp, xb, hb):
        zf, zp, g = n * zf, n * zp, {}
        if s.width:
            dh = (np.outer(zf, w["wf"]) + np.outer(zp, w["wp"])) * (hb > 0)
            g["w1"], g["b1"] = xb.T @ dh, dh.sum(0)
        g["wf"], g["bf"] = hb.T @ zf, np.array([zf.sum()])
        g["wp"], g["bp"] = hb.T @ zp, np.array([zp.sum()])
        return np.concatenate([g[n].ravel() for n, _ in shapes(d, s)])

    vectors = [back(zf, zp, x, h) for zf, zp in grads]
    if s.shift_index >= 0:
        x2 = x.copy()
        x2[:, s.shift_index] += 0.5
        f2, _, h2 = heads(theta, x2, s)
        drop = np.maximum(0.0, f - f2)
        zero = np.zeros_like(f)
        vectors.append(
            back(2 * drop * f * (1 - f), zero, x, h) - back(2 * drop * f2 * (1 - f2), zero, x2, h2)
        )
        hinge_sum = n @ drop**2
    else:
        vectors.append(np.zeros_like(theta))
        hinge_sum = 0.0
    return np.concatenate([*out, [hinge_sum], *vectors])


def _matrix(batch: pa.RecordBatch):
    """The design matrix straight from the list column's buffer, and the other columns."""
    lists = batch.column("x")
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
    el = batch.column("eligible").to_numpy(zero_copy_only=False).astype(bool)
    return (x, number("y"), number("u"), number("k"), el), number("n") if "n" in batch.schema.names else None


SEEN = ["x", "y", "u", "k", "eligible"]
SUMS = "branch int, sums binary"
BRANCHES = 32


def _sum_group(group: pa.Table) -> pa.Table:
    v = sum(np.frombuffer(b, np.float64) for b in group["sums"].to_pylist())
    return pa.table({"branch": pa.array([0], pa.int32()), "sums": pa.array([v.tobytes()], pa.binary())})


def evaluate(data: DataFrame, theta: np.ndarray, s: Settings) -> tuple[dict, np.ndarray]:
    """Loss and gradient over a table. Tasks return one vector each; Spark adds them, by branches first
    where there are many tasks. With a column n a row stands for n equal ones."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                columns, weight = _matrix(batch)
                part = batch_sums(theta, *columns, s, weight)
                total = part if total is None else total + part
        if total is not None:
            branch = TaskContext.get().partitionId() % BRANCHES
            yield pa.RecordBatch.from_pydict(
                {"branch": [branch], "sums": [total.tobytes()]}, schema=pa.schema([("branch", pa.int32()), ("sums", pa.binary())])
            )

    parts = data.select(*SEEN, *[c for c in data.columns if c == "n"]).mapInArrow(partial, SUMS)
    if data.rdd.getNumPartitions() > BRANCHES:
        parts = parts.groupBy("branch").applyInArrow(_sum_group, SUMS)
    vectors = [np.frombuffer(r["sums"], np.float64) for r in parts.orderBy("branch").collect()]  # at most BRANCHES
    v = sum(vectors) if vectors else np.zeros(6 + 4 * len(theta))
    n, n_el, bce, nll, om1, om2 = v[:6]
    n = max(n, 1.0)
    g = v[6:].reshape(4, -1)
    el = max(n_el, 1.0)
    terms = {"bce": bce / n, "nll": nll / el, "omega1": om1 / n, "omega2": om2 / n}
    terms["total"] = terms["bce"] + s.lam * terms["nll"] + s.mu1 * terms["omega1"] + s.mu2 * terms["omega2"]
    grad = g[0] / n + s.lam * g[1] / el + s.mu1 * g[2] / n + s.mu2 * g[3] / n
    return terms, grad


def equal_rows(data: DataFrame) -> DataFrame:
    """Rows that agree in all the model sees, as one durable row with their number."""
    return durable(data.groupBy(*SEEN).agg(F.count("*").alias("n")))


def fit(train: DataFrame, valid: DataFrame | None, d: int, s: Settings) -> tuple[np.ndarray, list[dict]]:
    """Full-batch training with decoupled decay and a cosine rate; stops on validation loss.

    Both tables have x (array<double>), y, u, k and eligible. Equal rows are counted once, and epochs read
    these counts. Only the weight vector and its gradient visit the driver.
    """
    train, valid = equal_rows(train), None if valid is None else equal_rows(valid)
    theta = initial(d, s)
    m, v2 = np.zeros_like(theta), np.zeros_like(theta)
    best, best_loss, waited, log = theta, math.inf, 0, []
    for epoch in range(s.epochs):
        terms, grad = evaluate(train, theta, s)
        watch = evaluate(valid, theta, s)[0] if valid is not None else terms
        log.append({"epoch": epoch, "train": terms["total"], "valid": watch["total"]})
        if watch["total"] < best_loss:
            best, best_loss, waited = theta, watch["total"], 0
        else:
            waited += 1
            if waited >= s.patience:
                break
        rate = 0.5 * s.rate * (1 + math.cos(math.pi * epoch / s.epochs))
        m = 0.9 * m + 0.1 * grad
        v2 = 0.999 * v2 + 0.001 * grad**2
        step = (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v2 / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        theta = theta * (1 - rate * s.decay) - rate * step
    return best, log


def score(data: DataFrame, theta: np.ndarray, s: Settings) -> DataFrame:
    """Add f, p and q to a table with x and u; rows stay keyed."""
    kept = [c for c in data.columns if c != "x"]
    fields = [f"`{c}` {data.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("x")
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
                u = batch.column("u").to_numpy(zero_copy_only=False).astype(np.float64)
                f, p, _ = heads(theta, x, s)
                p = np.clip(p, CLAMP_EPS, 1 - CLAMP_EPS)
                q = np.clip(f * (1 - (1 - p) ** u), CLAMP_EPS, 1 - CLAMP_EPS)
                columns = [*[batch.column(c) for c in kept], *[pa.array(v) for v in (f, p, q)]]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "f", "p", "q"])

    return data.mapInArrow(run, ", ".join([*fields, "f double", "p double", "q double"]))


def stated_scores(data: DataFrame, theta: np.ndarray, s: Settings) -> DataFrame:
    """Like `score`, by array expressions of the JVM; the weights are literals of the plan."""
    d = (len(theta) - 2) // s.width - 3 if s.width else (len(theta) - 2) // 2
    w = unpack(theta, d, s)
    numbers = lambda v: F.lit([float(a) for a in v])
    dot = lambda x, v: F.aggregate(F.zip_with(x, v, lambda a, b: a * b), F.lit(0.0), lambda t, a: t + a)
    hidden = F.col("x")
    if s.width:
        units = F.array(*[F.struct(numbers(w["w1"][:, j]).alias("w"), F.lit(float(w["b1"][j])).alias("b")) for j in range(s.width)])
        hidden = F.transform(units, lambda unit: F.greatest(dot(F.col("x"), unit["w"]) + unit["b"], F.lit(0.0)))
    head = lambda n: numeric.sigmoid(dot(F.col("_hidden"), numbers(w[f"w{n}"])) + float(w[f"b{n}"][0]))
    rows = data.withColumn("_hidden", hidden).withColumns({"f": head("f"), "p": head("p")})
    rows = rows.withColumn("p", numeric.clamp(F.col("p"), CLAMP_EPS, 1 - CLAMP_EPS))
    q = numeric.clamp(F.col("f") * numeric.detection(F.col("p"), F.col("u")), CLAMP_EPS, 1 - CLAMP_EPS)
    return rows.withColumn("q", q).drop("_hidden", "x")


def save_weights(spark: SparkSession, theta: np.ndarray, path: str) -> None:
    rows = [(i, float(v)) for i, v in enumerate(theta)]
    spark.createDataFrame(rows, "i int, v double").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["v"] for r in spark.read.parquet(path).orderBy("i").collect()])
