"""Statistics on paired differences: effect sizes by cluster, resampling, tests and verdicts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from trialspan.functions.numbers import hash_draw, percentile_at_floor, t_survival

SEED = 20260506


@pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Survival function of Student's t."""
    return pd.Series([t_survival(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])


def with_p_values(summary: DataFrame) -> DataFrame:
    """One-sided p of the magnitude, and of the directions below and above zero."""
    upper = t_sf(F.col("t"), F.col("df"))
    rows = summary.withColumn("p_greater", upper)
    return rows.withColumn("p_less", 1 - F.col("p_greater")).withColumn("p_magnitude", F.least("p_greater", "p_less"))


def cluster_moments(deltas: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Sufficient statistics of each cluster, centred on the mean of its key: (n, s1, s2, centre).

    Centring keeps the sums of squares free of cancellation. One aggregate by cluster; the centre
    is combined from the clusters' own moments, so no row is read twice.
    """
    by = deltas.groupBy(*keys, cluster).agg(F.count("*").alias("n"), F.avg("delta").alias("m"), F.coalesce(F.var_pop("delta"), F.lit(0.0)).alias("v"))
    over = W.partitionBy(*keys)
    by = by.withColumn("centre", F.sum(F.col("n") * F.col("m")).over(over) / F.sum("n").over(over))
    shift = F.col("m") - F.col("centre")
    return by.select(*keys, cluster, "n", (F.col("n") * shift).alias("s1"), (F.col("n") * (F.col("v") + shift * shift)).alias("s2"), "m", "centre")


def effect_from_sums(n, s1, s2, centre):
    """d = mean / sample sd from centred sums; null where there are under two values or no spread."""
    variance = (s2 - s1 * s1 / n) / (n - 1)
    return F.when((n > 1) & (variance > 1e-18), (centre + s1 / n) / F.sqrt(variance))


def leave_one_out(moments: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """d without each cluster, from totals less the cluster's own sums."""
    over = W.partitionBy(*keys)
    rest = {c: F.sum(c).over(over) - F.col(c) for c in ("n", "s1", "s2")}
    rows = moments.select(*keys, cluster, "centre", F.col("n").alias("n_left_out"), *[v.alias(f"rest_{c}") for c, v in rest.items()], *[F.sum(c).over(over).alias(f"all_{c}") for c in ("n", "s1", "s2")])
    rows = rows.withColumn("d_all", effect_from_sums(F.col("all_n"), F.col("all_s1"), F.col("all_s2"), F.col("centre")))
    rows = rows.withColumn("d_without", effect_from_sums(F.col("rest_n"), F.col("rest_s1"), F.col("rest_s2"), F.col("centre")))
    return rows.select(*keys, cluster, "n_left_out", "d_all", "d_without")


def leave_one_out_summary(left_out: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Median, range and number of kept signs of d without each cluster, and the most influential cluster.

    Ties of influence are decided by the cluster's name.
    """
    influence = F.abs(F.col("d_without") - F.col("d_all"))
    most = W.partitionBy(*keys).orderBy(influence.desc_nulls_last(), cluster)
    rows = left_out.withColumn("nth", F.row_number().over(most))
    return rows.groupBy(*keys).agg(
        F.count("d_without").alias("n_clusters"), F.median("d_without").alias("d_median"), F.min("d_without").alias("d_min"), F.max("d_without").alias("d_max"),
        F.count(F.when(F.signum("d_without") == F.signum("d_all"), 1)).alias("n_same_sign"), F.max(F.when(F.col("nth") == 1, F.col(cluster))).alias("most_influential"),
    )


def cluster_effect(moments: DataFrame, keys: list[str]) -> DataFrame:
    """d of the cluster means, and how many of them are below zero."""
    by = moments.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.avg("m").alias("mean_of_means"), F.stddev_samp("m").alias("sd_of_means"), F.count(F.when(F.col("m") < 0, 1)).alias("n_below"))
    return by.withColumn("d_clusters", F.when(F.col("sd_of_means") > 0, F.col("mean_of_means") / F.col("sd_of_means")))


def cluster_bootstrap(moments: DataFrame, keys: list[str], cluster: str, replicates: int = 10_000, seed: int = SEED, draws: str = "hash") -> DataFrame:
    """Confidence bounds of d with clusters drawn anew and their sessions pooled; floor-index percentiles.

    Clusters are few, so their sums are collected into one small array per key and every
    replicate is a row: the draw table is made by the executors, and no session is read again.
    ``draws`` is ``hash`` (any engine can repeat it) or ``exact`` (the random stream of Python's
    generator, one draw after the other, from the seed anew for each key).
    """
    lists = moments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(cluster, "n", "s1", "s2"))).alias("c"), F.first("centre").alias("centre"))
    if draws == "exact":
        return _exact_cluster_bootstrap(lists, keys, replicates, seed)
    size = F.size("c")
    rows = lists.select(*keys, "c", "centre", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    drawn = rows.select(*keys, "centre", "r", "c", F.explode(F.sequence(F.lit(0), size - 1)).alias("k"))
    pick = F.element_at("c", (hash_draw(F.size("c"), F.lit(seed), F.col("r"), F.col("k")) + 1).cast("int"))
    by = drawn.select(*keys, "centre", "r", pick.alias("p")).groupBy(*keys, "r").agg(F.first("centre").alias("centre"), *[F.sum(f"p.{x}").alias(x) for x in ("n", "s1", "s2")])
    effects = by.select(*keys, effect_from_sums(F.col("n"), F.col("s1"), F.col("s2"), F.col("centre")).alias("d")).where("d IS NOT NULL")
    return bounds(effects, keys)


def bounds(effects: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Floor-index percentiles of the replicates of each key."""
    by = effects.groupBy(*keys).agg(F.collect_list("d").alias("ds"))
    return by.select(*keys, F.size("ds").alias("n_replicates"), percentile_at_floor(F.col("ds"), low).alias("low"), percentile_at_floor(F.col("ds"), high).alias("high"))


def _exact_cluster_bootstrap(lists: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    fields = ", ".join(f"{k} {dict(lists.dtypes)[k]}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import random

        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                sums = np.array([[c["n"], c["s1"], c["s2"]] for c in row.c], float)
                rng = random.Random(seed)
                picks = np.array([[rng.randint(0, len(sums) - 1) for _ in sums] for _ in range(replicates)])
                n, s1, s2 = np.moveaxis(sums[picks].sum(axis=1), 1, 0)
                with np.errstate(all="ignore"):
                    variance = (s2 - s1 * s1 / n) / (n - 1)
                    d = (row.centre + s1 / n) / np.sqrt(variance)
                d = np.sort(d[np.isfinite(d) & (variance > 1e-18)])
                at = [float(d[min(int(q * len(d)), len(d) - 1)]) if len(d) else None for q in (0.025, 0.975)]
                out.append([*[getattr(row, k) for k in keys], len(d), *at])
            yield pd.DataFrame(out, columns=[*keys, "n_replicates", "low", "high"])

    return lists.mapInPandas(run, f"{fields}, n_replicates int, low double, high double")


#: a 32-bit mixing step: any SQL engine can repeat it in 64-bit integers
_GOLDEN, _MIX = 2654435769, 0x045D9F3B
#: the Poisson distribution of mean 1 as bounds of a 32-bit draw
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9)]


def draws(ids: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """(ids, replicates) 32-bit draws, each a hash of its id's 32 bits, the replicate and the seed alone."""
    x = (ids.astype(np.uint32)[:, None] + (replicates + seed).astype(np.uint32)[None, :] * np.uint32(_GOLDEN)).astype(np.uint32)
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(_MIX)
    return x ^ (x >> np.uint32(16))


def replicate_sums(deltas: DataFrame, keys: list[str], replicates: int, seed: int, weights: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, n, observed, w, s): per key the number and sum of its differences, and for each replicate the sums of its weights and of its weighted differences.

    Each task adds up one vector of replicates for each key, whatever its number of sessions. Vectors are added in two
    steps, so that no task gets those of all tasks; sessions are never exploded.
    """
    ids = F.conv(F.substring(F.md5(F.col("prompt_id")), 1, 8), 16, 10).cast("long").alias("_id")
    fields = ", ".join(f"{k} {dict(deltas.dtypes)[k]}" for k in keys)
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        every = np.arange(replicates)
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True))
            code, own = batch.column(width).to_numpy(), batch.column(width + 1).to_numpy()
            different, place = np.unique(code, return_inverse=True)  # a session of several keys is drawn for once
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                groups.setdefault(name, []).append(i)
            for name, rows in groups.items():
                total = sums.setdefault(name, [0, 0.0, np.zeros(replicates), np.zeros(replicates)])
                total[0] += len(rows)
                total[1] += float(own[rows].sum())
            for start in range(0, len(different), 256):
                w = weights(draws(different[start : start + 256], every, seed))
                for name, rows in groups.items():
                    mine = np.array(rows)[(place[rows] >= start) & (place[rows] < start + 256)]
                    if len(mine):
                        drawn = w[place[mine] - start]
                        sums[name][2] += drawn.sum(axis=0)
                        sums[name][3] += own[mine] @ drawn
        yield _vectors(sums)

    def _vectors(sums: dict[tuple, list]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums]) for i in range(width)] if sums else [pa.array([], pa.string())] * width
        rest = [pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64()), *[pa.array([v[i] for v in sums.values()], pa.list_(pa.float64())) for i in (2, 3)]]
        return pa.RecordBatch.from_arrays([*columns, *rest], names=[*keys, "n", "observed", "w", "s"])

    def add(table: pa.Table) -> pa.Table:
        vector = lambda c: np.vstack([np.asarray(x) for x in table.column(c).to_pylist()]).sum(axis=0)
        one = {tuple(table.column(k)[0].as_py() for k in keys): [sum(table.column("n").to_pylist()), sum(table.column("observed").to_pylist()), vector("w"), vector("s")]}
        return pa.Table.from_batches([_vectors(one)])

    schema = f"{fields}, n long, observed double, w array<double>, s array<double>"
    parts = deltas.where("delta IS NOT NULL AND prompt_id IS NOT NULL").select(*keys, ids, F.col("delta").cast("double")).mapInArrow(run, schema)
    first = parts.withColumn("_part", F.spark_partition_id() % 64).groupBy(*keys, "_part").applyInArrow(lambda t: add(t.drop_columns("_part")), schema)
    return first.groupBy(*keys).applyInArrow(add, schema)


def session_bootstrap(deltas: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = SEED) -> DataFrame:
    """Bounds of the mean by a Poisson bootstrap: each session counts a hash-drawn number of times in each replicate.

    A session's weight depends on its id, the replicate and the seed alone, so partitions need not
    be known to each other and the partial sums combine before the shuffle.
    """
    bounds = np.array(POISSON, np.uint64)
    sums = replicate_sums(deltas, keys, replicates, seed, lambda x: np.searchsorted(bounds, x.ravel().astype(np.uint64), side="right").reshape(x.shape).astype(np.float64))
    each = sums.select(*keys, F.explode(F.arrays_zip("w", "s")).alias("x")).where("x.w > 0").select(*keys, (F.col("x.s") / F.col("x.w")).alias("d"))
    return each.groupBy(*keys).agg(F.count("*").cast("int").alias("n_replicates"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))


def sign_flip(deltas: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = SEED) -> DataFrame:
    """Share of replicates with hash-drawn signs whose sum is at least as extreme as the observed, in its direction."""
    sums = replicate_sums(deltas, keys, replicates, seed, lambda x: 1.0 - 2.0 * (x & np.uint32(1)))
    rows = sums.select(*keys, "observed", F.explode("s").alias("flipped"))
    extreme = F.when(F.col("observed") < 0, F.col("flipped") <= F.col("observed") + 1e-9).otherwise(F.col("flipped") >= F.col("observed") - 1e-9)
    return rows.groupBy(*keys).agg(F.count("*").cast("int").alias("n_replicates"), F.avg(extreme.cast("double")).alias("p"))


def cluster_effect_interval(moments: DataFrame, keys: list[str], cluster: str, replicates: int = 10_000, seed: int = SEED) -> DataFrame:
    """d of the cluster means with its bootstrap bounds: clusters drawn anew, linear percentiles; replicates without spread are left out."""
    lists = moments.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(cluster, "m"))), lambda c: c["m"]).alias("c"))
    rows = lists.select(*keys, "c", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    drawn = rows.select(*keys, "r", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 1)).alias("k"))
    pick = F.element_at("c", (hash_draw(F.size("c"), F.lit(seed), F.col("r"), F.col("k")) + 1).cast("int"))
    by = drawn.select(*keys, "r", pick.alias("m")).groupBy(*keys, "r").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    each = by.where("sd > 1e-12").select(*keys, (F.col("mean") / F.col("sd")).alias("d"))
    bounds = each.groupBy(*keys).agg(F.count("*").cast("int").alias("n_replicates"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    return cluster_effect(moments, keys).join(bounds, keys, "left")


def floor_checks(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Checks outside any family of comparisons: each has the whole ``alpha``, and holds where its difference lies below zero with a smaller p."""
    return with_p_values(summary).withColumn("alpha", F.lit(alpha)).withColumn("holds", F.coalesce(F.col("p_less") < alpha, F.lit(False)))


_EXACT_TESTS = "n int, mean_low double, mean_high double, d_low double, d_high double, p_sign_flip double"


def exact_resampling(deltas: DataFrame, keys: list[str], replicates: int = 10_000, seed: int = SEED, most: int = 1_000_000) -> DataFrame:
    """Session bootstraps of the mean and of d, and the sign-flip test, on the random streams of a numpy generator.

    The streams are sequential, so a key's differences are ordered by session and taken by one
    task: a key of more than ``most`` sessions is an error; ``session_bootstrap`` and ``sign_flip``
    have no such bound.
    """
    fields = ", ".join(f"{k} {dict(deltas.dtypes)[k]}" for k in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("prompt_id")["delta"].to_numpy()
        n = len(x)
        if n > most:
            raise ValueError(f"a key has {n} sessions; the sequential streams are for up to {most}")
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, n, n)].mean() for _ in range(replicates)])
        rng = np.random.default_rng(seed)
        effects = []
        for start in range(0, replicates, 256):
            drawn = x[rng.integers(0, n, (min(256, replicates - start), n))]
            with np.errstate(all="ignore"):
                effects.append(drawn.mean(axis=1) / drawn.std(axis=1, ddof=1))
        d = np.concatenate(effects)
        d = d[np.isfinite(d)]
        rng = np.random.default_rng(seed)
        observed, hits = x.mean(), 0
        for start in range(0, replicates, 256):
            flipped = (rng.choice([-1.0, 1.0], (min(256, replicates - start), n)) * x).mean(axis=1)
            hits += int((flipped <= observed).sum() if observed < 0 else (flipped >= observed).sum())
        q = lambda v: np.quantile(v, [0.025, 0.975]).tolist() if len(v) else [None, None]
        return pd.DataFrame([[*[frame[k].iloc[0] for k in keys], n, *q(means), *q(d), hits / replicates]], columns=[*keys, "n", "mean_low", "mean_high", "d_low", "d_high", "p_sign_flip"])

    return deltas.select(*keys, "prompt_id", "delta").groupBy(*keys).applyInPandas(run, f"{fields}, {_EXACT_TESTS}")


def bonferroni(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The family's threshold: ``alpha`` by the number of comparisons that could be computed, those with a d."""
    return summary.withColumn("alpha_family", F.lit(alpha) / F.nullif(F.count("d").over(W.partitionBy()), F.lit(0)))


def verdict(d, p, win: float = 0.10, alpha: float = 0.05):
    """``win`` below -0.10 with a small p, ``equivalent`` within 0.10, else ``inconclusive``."""
    return F.when((d < -win) & (p < alpha), "win").when(F.abs(d) < win, "equivalent").otherwise("inconclusive")


def compare_cells(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Cell by cell against another table: identical, different, or on one side only."""
    a, b = left.select(*keys, F.col(value).alias("a")), right.select(*keys, F.col(value).alias("b"))
    state = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "identical").when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only")
        .when(F.abs(F.col("a") - F.col("b")) <= tolerance, "identical").otherwise("different")
    )
    return a.join(b, keys, "full").withColumn("state", state)
