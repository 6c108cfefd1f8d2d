"""Retrieval and match metrics.

References are (ref_id), truth and predictions are (ref_id, cand_id); references without true or predicted rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS
from kinweave.operators.common import ratio
from kinweave.sources.folders import checkpoint


def f_beta(p: Column, r: Column, beta: float = 0.5) -> Column:
    b = beta * beta
    return F.when(b * p + r == 0, 0.0).otherwise((1 + b) * p * r / (b * p + r))


def per_reference(refs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(ref_id, n_true, n_pred, n_hit, precision, recall, f05); two empty sets score 1, one empty set 0."""
    g = truth.select("ref_id", "cand_id", F.lit(1).alias("t")).distinct()
    p = pred.select("ref_id", "cand_id", F.lit(1).alias("p")).distinct()
    pairs = g.join(p, ["ref_id", "cand_id"], "full").groupBy("ref_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("n_hit"))
    out = refs.select("ref_id").distinct().join(pairs, "ref_id", "left").fillna(0, ["n_true", "n_pred", "n_hit"])
    t, n, h = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    f = F.when((t == 0) & (n == 0), 1.0).when((t == 0) | (n == 0), 0.0).otherwise(5.0 * h / (t + 4.0 * n))
    return out.select("ref_id", "n_true", "n_pred", "n_hit", ratio(h, n).alias("precision"), ratio(h, t).alias("recall"), f.alias("f05"))


def macro_f05(refs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """The mean of F0.5 over all references, over those without and those with true matches."""
    rows = per_reference(refs, truth, pred)
    single = F.col("n_true") == 0
    return rows.agg(
        F.count("*").alias("n_refs"), F.avg("f05").alias("macro_f05"), F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(0.0)).alias("singleton_f05"),
        F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)).alias("match_f05"), F.count(F.when(single, 1)).alias("n_singletons"),
    )


def channel_stats(refs: DataFrame, truth: DataFrame, lists: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each channel: micro recall, share of references with any hit, candidates per reference, share of singletons that got any.

    References without a row in refs are left out. by: further columns of refs, whose totals come too (as null).
    """
    keys = by or []
    pairs = lists.select("channel", "ref_id", "cand_id").unionByName(truth.select(F.lit(None).cast("string").alias("channel"), "ref_id", "cand_id"))  # true pairs have no channel
    pairs = pairs.repartition("ref_id").groupBy("ref_id", "cand_id", "channel").agg(F.lit(1).alias("one"))  # dealt by reference, once for what follows
    hit = F.max(F.when(F.col("channel").isNull(), 1)).over(Window.partitionBy("ref_id", "cand_id"))
    per = pairs.withColumn("hit", hit).groupBy("ref_id", "channel").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    hits, true = per.where("channel is not null"), per.where("channel is null").select("ref_id", F.col("n").alias("t"))
    channels = lists.select("channel").distinct()
    every = refs.select("ref_id", *keys).join(true, "ref_id", "left").join(F.broadcast(channels))  # a handful of channels
    rows = every.join(hits, ["channel", "ref_id"], "left").fillna(0, ["n", "hits", "t"])
    grouped = rows.groupBy("channel", *keys) if not keys else rows.rollup("channel", *keys)
    raw = grouped.agg(
        F.count("*").alias("n_refs"), F.sum("t").alias("pairs"), F.sum("hits").alias("hits"), F.sum("n").alias("cands"),
        F.count(F.when(F.col("t") > 0, 1)).alias("matched"), F.count(F.when(F.col("hits") > 0, 1)).alias("any_hit"),
        F.count(F.when(F.col("t") == 0, 1)).alias("singletons"), F.count(F.when((F.col("t") == 0) & (F.col("n") > 0), 1)).alias("contaminated"),
    ).where("channel is not null")
    c = F.col
    return raw.select("channel", *keys, "n_refs", "pairs", "hits", ratio(c("hits"), c("pairs")).alias("micro_recall"), ratio(c("any_hit"), c("matched")).alias("any_hit_rate"), ratio(c("cands"), c("n_refs")).alias("avg_cands"), ratio(c("contaminated"), c("singletons")).alias("singleton_rate"))


def union_stats(refs: DataFrame, truth: DataFrame, lists: DataFrame) -> DataFrame:
    return channel_stats(refs, truth, lists.withColumn("channel", F.lit("union")))


def recall_at(ranked: DataFrame, truth: DataFrame, cuts=(1, 3, 5, 10, 20, 50)) -> DataFrame:
    """(n, hits, pairs, recall) for each cut of the ranked lists."""
    met = ranked.join(truth.distinct(), ["ref_id", "cand_id"]).select("rank").withColumn("n", F.explode(F.array(*map(F.lit, cuts))))
    hits = met.where("rank <= n").groupBy("n").agg(F.count("*").alias("hits"))
    total = truth.distinct().agg(F.count("*").alias("pairs")).withColumn("n", F.explode(F.array(*map(F.lit, cuts))))
    return total.join(hits, "n", "left").select("n", F.coalesce("hits", F.lit(0)).alias("hits"), "pairs").withColumn("recall", ratio(F.col("hits"), F.col("pairs")))


def recall_by(ranked: DataFrame, truth: DataFrame, groups: DataFrame, cuts=(5, 10, 20, 50)) -> DataFrame:
    """(group, n, hits, pairs, recall) for each cut and each group of the true candidates, and for all as `overall`; groups: cand_id, group."""
    pairs = truth.distinct().join(groups.select("cand_id", "group"), "cand_id")
    ranked = ranked.where("hit = 1") if "hit" in ranked.columns else ranked  # as rrf marks them
    pairs = pairs.withColumn("group", F.explode(F.array(F.col("group"), F.lit("overall"))))
    spread = pairs.groupBy("group").agg(F.count("*").alias("pairs")).withColumn("n", F.explode(F.array(*map(F.lit, cuts))))
    hits = pairs.join(ranked.select("ref_id", "cand_id", "rank"), ["ref_id", "cand_id"]).withColumn("n", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= n").groupBy("group", "n").agg(F.count("*").alias("hits"))
    return spread.join(hits, ["group", "n"], "left").select("group", "n", F.coalesce("hits", F.lit(0)).alias("hits"), "pairs").withColumn("recall", ratio(F.col("hits"), F.col("pairs")))


def first_hit_rank(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """References with a hit, and the mean rank of their first."""
    met = ranked.where("hit = 1") if "hit" in ranked.columns else ranked.join(truth.distinct(), ["ref_id", "cand_id"])  # as rrf marks them
    first = met.groupBy("ref_id").agg(F.min("rank").alias("first"))
    return first.agg(F.count("*").alias("n_refs"), F.coalesce(F.avg("first"), F.lit(0.0)).alias("mean_first_hit_rank"))


def oracle_f05(refs: DataFrame, ranked: DataFrame, truth: DataFrame, cuts=(1, 3, 5, 10)) -> DataFrame:
    """The best macro F0.5 a decision could reach on the first n candidates: just the true ones are kept."""
    true = truth.distinct().groupBy("ref_id").agg(F.count("*").alias("t"))
    met = ranked.join(truth.distinct(), ["ref_id", "cand_id"]).select("ref_id", "rank").withColumn("n", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= n")
    hits = met.groupBy("n", "ref_id").agg(F.count("*").alias("h"))
    every = refs.select("ref_id").distinct().join(true, "ref_id", "left").withColumn("n", F.explode(F.array(*map(F.lit, cuts)))).join(hits, ["n", "ref_id"], "left").fillna(0, ["t", "h"])
    f = F.when(F.col("t") == 0, 1.0).when(F.col("h") == 0, 0.0).otherwise(5.0 * F.col("h") / (F.col("t") + 4.0 * F.col("h")))
    return every.groupBy("n").agg(F.avg(f).alias("oracle_f05"))


def brier_and_log_loss(scores: DataFrame, eps: float = 1e-15) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("prob")))
    return scores.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("brier"), F.avg(-(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))).alias("log_loss"))


def reliability(scores: DataFrame, bins: int = DEFAULTS.ece_bins, by: list[str] | None = None) -> DataFrame:
    """(bin, n, mean_prob, positive_rate) of equal bins; a bin begins at its lower edge, the last includes 1. by: columns that come first, each group with its own bins."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("prob") * bins))).cast("int")
    return scores.groupBy(*(by or []), b.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def ece(scores: DataFrame, bins: int = DEFAULTS.ece_bins, by: list[str] | None = None) -> DataFrame:
    return reliability(scores, bins, by).groupBy(*(by or [])).agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("positive_rate"))), F.sum("n")).alias("ece"))


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks, ties sharing their mean rank.

    Counts per distinct score come first; the running total is then over distinct scores, in blocks of equal score
    ranges, so no task holds all rows.
    """
    per = scores.groupBy("prob").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))
    per = checkpoint(per)  # read twice
    cell = F.floor(F.col("prob") * 1024).cast("long")
    blocks = per.groupBy(cell.alias("cell")).agg(F.sum(F.col("n") - F.col("pos")).alias("neg"))  # bounded by the cells
    before = F.coalesce(F.sum("neg").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("cell", before.alias("before"))
    w = Window.partitionBy("cell").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumn("cell", cell).join(F.broadcast(offsets), "cell").withColumn("below", F.col("before") + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + 0.5 * (F.col("n") - F.col("pos"))))
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return rows.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos == 0) | (neg == 0), 0.0).otherwise(wins / (pos.cast("double") * neg)).alias("auc"))


def baselines(refs: DataFrame, truth: DataFrame, lists: DataFrame) -> DataFrame:
    """Macro F0.5 of trivial predictions: none at all, every candidate, and the truth with a first candidate for singletons."""
    nothing = truth.limit(0).select("ref_id", "cand_id")
    whole = lists.select("ref_id", "cand_id").distinct()
    single = refs.select("ref_id").join(truth.select("ref_id").distinct(), "ref_id", "left_anti")
    first = lists.join(single, "ref_id", "left_semi").groupBy("ref_id").agg(F.min("cand_id").alias("cand_id"))
    out = None
    for name, pred in (("all_empty", nothing), ("all_candidates", whole), ("no_singleton_filter", truth.select("ref_id", "cand_id").unionByName(first))):
        row = macro_f05(refs, truth, pred).select(F.lit(name).alias("baseline"), "macro_f05")
        out = row if out is None else out.unionByName(row)
    return out
