"""Rank fusion, coarse scores and truncation of candidate lists.

Lists are (ref_id, channel, cand_id, rank) with 1-based ranks; fused lists are (ref_id, cand_id, score, rank).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS, Settings
from kinweave.operators.common import top


def rrf(lists: DataFrame, k: float = 60, weights: Mapping[str, float] | None = None, top_n: int | None = None, digits: int = 12, truth: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: each channel gives weight / (k + rank); channels of weight 0 are left out, ties go to the smaller id.

    With truth (ref_id, cand_id), hit is 1 for true pairs, else null: they are dealt by reference with the lists, so fused lists need no join with them.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(float(w))).otherwise(weight)
    rows = lists.select("ref_id", "channel", "cand_id", "rank").withColumn("w", weight).where("w != 0")
    if truth is not None:
        rows = rows.unionByName(truth.select("ref_id", F.lit(None).cast("string").alias("channel"), "cand_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("w")))
    rows = rows.repartition("ref_id")  # once for all groups below
    best = rows.groupBy("ref_id", "channel", "cand_id", "w").agg(F.min("rank").alias("rank"))  # a repeated candidate counts once, where it comes first
    score = F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), digits).alias("score")
    hit = [] if truth is None else [F.max(F.when(F.col("w").isNull(), 1)).alias("hit")]
    fused = best.groupBy("ref_id", "cand_id").agg(score, *hit)
    fused = fused.where("score is not null") if hit else fused
    return top(fused, ["ref_id"], [F.desc("score"), F.col("cand_id")], top_n)


def rrf_extra(fused: DataFrame, extra: DataFrame, k: float = 60, top_n: int | None = None) -> DataFrame:
    """Fuse a fused list, as one channel, with further channels."""
    base = fused.select("ref_id", F.lit("base").alias("channel"), "cand_id", "rank")
    return rrf(base.unionByName(extra.select("ref_id", "channel", "cand_id", "rank")), k, top_n=top_n)


def rrf_in_turn(lists: DataFrame, extra: list[str], k: float = 60, k_extra: float = 60, top_n: int | None = None, digits: int = 12) -> DataFrame:
    """rrf_extra of the fused other channels, with k, and the channels `extra`, with k_extra; rows are dealt by reference once for both."""
    best = lists.select("ref_id", "channel", "cand_id", "rank").repartition("ref_id").groupBy("ref_id", "channel", "cand_id").agg(F.min("rank").alias("rank"))
    late = F.col("channel").isin(*extra)
    each = best.groupBy("ref_id", "cand_id").agg(F.round(F.sum(F.when(~late, 1 / (F.lit(float(k)) + F.col("rank")))), digits).alias("base"), F.sum(F.when(late, 1 / (F.lit(float(k_extra)) + F.col("rank")))).alias("more"))
    placed = top(each, ["ref_id"], [F.desc_nulls_last("base"), F.col("cand_id")], None, "place")
    first = F.when(F.col("base").isNotNull(), 1 / (F.lit(float(k_extra)) + F.col("place")))
    fused = placed.select("ref_id", "cand_id", F.round(F.coalesce(first, F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), digits).alias("score"))
    return top(fused, ["ref_id"], [F.desc("score"), F.col("cand_id")], top_n)


def signals(lists: DataFrame, k: float, n_channels: int, digits: int = 12) -> DataFrame:
    """(ref_id, cand_id, rrf_score, channel_agreement) of all pairs of the lists, dealt by pair once, as joins with pairs need them."""
    best = lists.select("ref_id", "channel", "cand_id", "rank").repartition("ref_id", "cand_id").groupBy("ref_id", "cand_id", "channel").agg(F.min("rank").alias("rank"))
    score = F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), digits)
    return best.groupBy("ref_id", "cand_id").agg(score.alias("rrf_score"), (F.count("channel") / F.lit(float(n_channels))).alias("channel_agreement"))


def agreement(lists: DataFrame, n_channels: int) -> DataFrame:
    """The share of channels that found each candidate."""
    return lists.groupBy("ref_id", "cand_id").agg((F.count_distinct("channel") / F.lit(float(n_channels))).alias("agreement"))


def coarse(fused: DataFrame, lists: DataFrame, n_channels: int, exact: str = "exact", s: Settings = DEFAULTS) -> DataFrame:
    """0.60 * score / best score + 0.25 * agreement + 0.15 if the exact channel has it; ties keep the fused order."""
    a, b, c = s.coarse_weights
    found = agreement(lists, n_channels).join(lists.where(F.col("channel") == exact).select("ref_id", "cand_id", F.lit(1.0).alias("exact")).distinct(), ["ref_id", "cand_id"], "left")
    peak = F.max("score").over(Window.partitionBy("ref_id"))
    rows = fused.withColumn("share", F.when(peak > 0, F.col("score") / peak).otherwise(0.0)).join(found, ["ref_id", "cand_id"], "left")
    scored = rows.withColumn("coarse", F.round(a * F.col("share") + b * F.coalesce("agreement", F.lit(0.0)) + c * F.coalesce("exact", F.lit(0.0)), 9))
    ranked = top(scored.withColumnRenamed("rank", "fused_rank"), ["ref_id"], [F.desc("coarse"), F.col("fused_rank")], None)
    return ranked.select("ref_id", "cand_id", F.col("coarse").alias("score"), "rank")


def truncate(ranked: DataFrame, ratio: float = DEFAULTS.ratio, k_min: int = DEFAULTS.k_min, k_max: int = DEFAULTS.k_max) -> DataFrame:
    """Keep scores of at least ratio * best, at most k_max of them, at least k_min; if the best isn't positive, all count as above."""
    w = Window.partitionBy("ref_id")
    kept = ranked.withColumn("peak", F.max("score").over(w))
    passed = F.sum(F.when((F.col("peak") <= 0) | (F.col("score") >= F.lit(ratio) * F.col("peak")), 1).otherwise(0)).over(w)
    return kept.withColumn("limit", F.greatest(F.lit(k_min), F.least(F.lit(k_max), passed))).where("rank <= limit").drop("peak", "limit")


def grid(spark: SparkSession, name: str, values) -> DataFrame:
    """A table of a parameter's values: a handful of rows, fixed by the settings, that may be broadcast."""
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def over_grid(df: DataFrame, name: str, values) -> DataFrame:
    """A copy of df for each value of a parameter, by exploding a constant array."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def _heads(lists: DataFrame, n: int, values) -> DataFrame:
    """(ref_id, cand_id, k, score, rank): the first n of the fused list for each k. Rows are dealt by reference before there is one for each k, and not again."""
    best = lists.select("ref_id", "channel", "cand_id", "rank").repartition("ref_id").groupBy("ref_id", "channel", "cand_id").agg(F.min("rank").alias("rank"))
    each = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score")) for k in values])
    fused = best.groupBy("ref_id", "cand_id").agg(each.alias("each")).select("ref_id", "cand_id", F.inline("each"))
    return top(fused, ["k", "ref_id"], [F.desc("score"), F.col("cand_id")], n)


def rrf_grid(lists: DataFrame, truth: DataFrame, n: int, values=DEFAULTS.rrf_k_grid) -> DataFrame:
    """Recall among the first n of the fused list for each k: (k, hits, pairs, recall), best first, smaller k on ties."""
    head = _heads(lists, n, values)
    hits = head.join(truth, ["ref_id", "cand_id"]).groupBy("k").agg(F.count("*").alias("hits"))
    total = truth.agg(F.count("*").alias("pairs"))
    every = over_grid(total, "k", values).join(hits, "k", "left")
    return every.select("k", F.coalesce("hits", F.lit(0)).alias("hits"), "pairs", F.when(F.col("pairs") == 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("pairs")).alias("recall")).orderBy(F.desc("recall"), "k")


def ratio_grid(ranked: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(ratio, avg_k, recall, in_band) of truncation at each ratio."""
    w = Window.partitionBy("ratio", "ref_id")
    rows = over_grid(ranked, "ratio", s.ratio_grid).withColumn("peak", F.max("score").over(w))
    passed = F.sum(F.when((F.col("peak") <= 0) | (F.col("score") >= F.col("ratio") * F.col("peak")), 1).otherwise(0)).over(w)
    kept = rows.withColumn("limit", F.greatest(F.lit(s.k_min), F.least(F.lit(s.k_max), passed))).where("rank <= limit")
    per = kept.join(truth.withColumn("hit", F.lit(1)), ["ref_id", "cand_id"], "left").groupBy("ratio").agg(F.count("*").alias("kept"), F.count_distinct("ref_id").alias("refs"), F.count("hit").alias("hits"))
    low, high = s.target_k_band
    return per.join(F.broadcast(truth.agg(F.count("*").alias("pairs")))).select(
        "ratio", (F.col("kept") / F.col("refs")).alias("avg_k"), F.when(F.col("pairs") == 0, 0.0).otherwise(F.col("hits") / F.col("pairs")).alias("recall")
    ).withColumn("in_band", F.col("avg_k").between(low, high))


def choose_ratio(grid_rows: DataFrame, s: Settings = DEFAULTS) -> float:
    """The ratio of best recall whose average K is in the band; if none is, the one whose K is closest to the target."""
    rows = sorted(grid_rows.collect(), key=lambda r: r["ratio"])
    inside = [r for r in rows if r["in_band"]]
    return max(inside, key=lambda r: r["recall"])["ratio"] if inside else min(rows, key=lambda r: abs(r["avg_k"] - s.target_k))["ratio"]


def reduction_ratio(kept: DataFrame, refs: DataFrame, cands: DataFrame) -> DataFrame:
    """1 - kept / (references * candidates)."""
    one = kept.agg(F.count("*").alias("kept")).crossJoin(refs.agg(F.count("*").alias("refs"))).crossJoin(cands.agg(F.count("*").alias("pool")))  # three single rows
    return one.select("kept", "refs", "pool", (1 - F.col("kept") / (F.col("refs") * F.col("pool"))).alias("reduction_ratio"))


def tune_rrf(lists: DataFrame, truth: DataFrame, refs: DataFrame, n: int, values=DEFAULTS.rrf_k_grid) -> dict[str, float]:
    """For each bucket the k of best recall among the first n, the smaller on ties; without true pairs the grid's first."""
    by = refs.select("ref_id", "bucket")
    head = _heads(lists, n, values)
    hits = head.join(truth.distinct(), ["ref_id", "cand_id"]).join(by, "ref_id").groupBy("bucket", "k").agg(F.count("*").alias("hits"))
    out = {r["bucket"]: float(values[0]) for r in by.select("bucket").distinct().collect()}
    for r in hits.orderBy("bucket", "hits", F.desc("k")).collect():
        out[r["bucket"]] = r["k"]
    return out


def weight_sweep(lists: DataFrame, truth: DataFrame, weights: list[dict[str, float]], n: int, k: float = 60) -> list[tuple[dict[str, float], float]]:
    """Recall among the first n for each set of channel weights, best first."""
    pairs = truth.distinct()
    total = max(1, pairs.count())
    found = [(w, rrf(lists, k, w, n).join(pairs, ["ref_id", "cand_id"]).count() / total) for w in weights]
    return sorted(found, key=lambda x: -x[1])
