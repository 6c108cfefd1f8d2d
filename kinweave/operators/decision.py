"""From scored pairs (ref_id, cand_id, prob) to match sets, and the tuning of the rules.

Every reference starts from the reference table (ref_id, and is_open for references of countries without labels), so
one without any score has an empty set.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS, Settings
from kinweave.operators.common import top
from kinweave.operators.fusion import over_grid


def best_scores(scores: DataFrame) -> DataFrame:
    """One row per pair, with its largest score; dealt by reference, once for what follows."""
    return scores.select("ref_id", "cand_id", "prob").repartition("ref_id").groupBy("ref_id", "cand_id").agg(F.max("prob").alias("prob"))


def best_labelled(scores: DataFrame, refs: DataFrame, truth: DataFrame) -> DataFrame:
    """best_scores of the references, with hit 1 for true pairs, else null. True pairs are dealt by reference with the scores, so a grid's rows need no join with them."""
    true = truth.select("ref_id", "cand_id", F.lit(None).alias("prob"), F.lit(1).alias("hit"))
    rows = scores.select("ref_id", "cand_id", "prob", F.lit(None).alias("hit")).unionByName(true).repartition("ref_id")
    best = rows.groupBy("ref_id", "cand_id").agg(F.max("prob").alias("prob"), F.max("hit").alias("hit")).where("prob is not null")
    return best.join(refs.select("ref_id").distinct(), "ref_id")


def with_open(refs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """refs (ref_id, bucket) with is_open: its bucket is listed as open, or isn't among those seen."""
    return refs.withColumn("is_open", F.col("bucket").isin(*s.open_set) | ~F.col("bucket").isin(*s.seen))


def _kept(prob: Column, peak: Column, tau_match: Column, tau_s: Column, margin: Column, open_: Column, boost: Column, veto: Column) -> Column:
    refused = (peak < tau_s + F.when(open_, boost).otherwise(0.0)) | (open_ & (peak < veto))
    return ~refused & (prob >= F.greatest(tau_match, peak - margin))


def decide(scores: DataFrame, refs: DataFrame, tau_match: float = DEFAULTS.tau_match, tau_s: float = DEFAULTS.tau_s, margin: float = DEFAULTS.margin, boost: float = DEFAULTS.boost, veto: float = DEFAULTS.veto) -> DataFrame:
    """Thresholds: nothing if the best score is below tau_s (with the boost, if open) or an open reference's below the veto,
    else what reaches both tau_match and the best score less the margin."""
    rows = best_scores(scores).join(refs.select("ref_id", "is_open"), "ref_id").withColumn("peak", F.max("prob").over(Window.partitionBy("ref_id")))
    keep = _kept(F.col("prob"), F.col("peak"), F.lit(tau_match), F.lit(tau_s), F.lit(margin), F.col("is_open"), F.lit(boost), F.lit(veto))
    return rows.where(keep).select("ref_id", "cand_id", "prob")


def _macro_over(keys: list[str], params: DataFrame, refs: DataFrame, truth: DataFrame, kept: DataFrame) -> DataFrame:
    """Mean F0.5 of each setting over refs; params holds the settings, a handful of rows that may be broadcast.

    kept is (keys, ref_id, hit), dealt by reference. A reference that keeps nothing scores 1 without true pairs, else 0, at
    any setting; so only those that keep something are counted for each.
    """
    true = truth.distinct().groupBy("ref_id").agg(F.count("*").alias("t"))
    every = refs.select("ref_id").distinct().join(true, "ref_id", "left").fillna(0, ["t"])
    hits = kept.groupBy(*keys, "ref_id").agg(F.count("*").alias("p"), F.count("hit").alias("h")).join(every, "ref_id")
    t, p, h = F.col("t"), F.col("p"), F.col("h")
    more = hits.groupBy(*keys).agg(F.sum(F.when(t == 0, -1.0).otherwise(5.0 * h / (t + 4.0 * p))).alias("more"))
    base = every.agg(F.count("*").alias("n"), F.count(F.when(t == 0, 1)).alias("empty"))
    rows = params.join(F.broadcast(base)).join(more, keys, "left").where("n > 0")
    return rows.select(*keys, ((F.col("empty") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("macro_f05"))


def decide_grid(scores: DataFrame, refs: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(tau_match, tau_s, macro_f05) over the grid, without open-set terms."""
    peak = F.max("prob").over(Window.partitionBy("ref_id"))
    rows = best_labelled(scores, refs, truth).withColumn("peak", peak)
    spread = over_grid(over_grid(rows, "tau_match", s.tau_match_grid), "tau_s", s.tau_s_grid)
    no = F.lit(False)
    kept = spread.where(_kept(F.col("prob"), F.col("peak"), F.col("tau_match"), F.col("tau_s"), F.lit(s.margin), no, F.lit(0.0), F.lit(0.0)))
    one = scores.sparkSession.range(1).drop("id")
    params = over_grid(over_grid(one, "tau_match", s.tau_match_grid), "tau_s", s.tau_s_grid)
    return _macro_over(["tau_match", "tau_s"], params, refs, truth, kept)


def tune(scores: DataFrame, refs: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> tuple[float, float, float]:
    """The first best (tau_match, tau_s, macro_f05) in grid order."""
    r = decide_grid(scores, refs, truth, s).orderBy(F.desc(F.round("macro_f05", 12)), "tau_match", "tau_s").first()
    return r["tau_match"], r["tau_s"], r["macro_f05"]


def expected(scores: DataFrame, recall_hat: Column) -> DataFrame:
    """Rows in descending order with k, the expected F0.5 of keeping the first k, and that of keeping none."""
    w = Window.partitionBy("ref_id").orderBy(F.desc("prob"), "cand_id")
    whole = Window.partitionBy("ref_id")
    hat = F.greatest(F.lit(1e-3), F.least(F.lit(1.0), recall_hat))
    run, total, k = F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("prob").over(whole), F.row_number().over(w)
    rows = scores.withColumns({"k": k, "run": run, "total": total / hat})
    p, r = F.col("run") / F.col("k"), F.when(F.col("total") > 0, F.col("run") / F.col("total")).otherwise(0.0)
    none = F.aggregate(F.sort_array(F.collect_list("prob").over(whole)), F.lit(1.0), lambda acc, x: acc * (1 - x))
    return rows.withColumns({"e_f": F.round(1.25 * p * r / (0.25 * p + r + 1e-12), 12), "e_none": F.round(none, 12)})


def decide_expected(scores: DataFrame, refs: DataFrame, recall_hat: float = 0.85, tau_floor: float = 0.5, veto: float = DEFAULTS.veto) -> DataFrame:
    """The prefix with the largest expected F0.5, the shortest on ties and none if that isn't worse; then scores below
    tau_floor go. Open references whose best score is below the veto get nothing; the boost doesn't apply."""
    rows = expected(best_scores(scores).join(refs.select("ref_id", "is_open"), "ref_id"), F.lit(recall_hat))
    w = Window.partitionBy("ref_id")
    best = rows.withColumn("top_f", F.max("e_f").over(w)).withColumn("cut", F.min(F.when(F.col("e_f") == F.col("top_f"), F.col("k"))).over(w)).withColumn("peak", F.max("prob").over(w))
    keep = (F.col("top_f") > F.col("e_none")) & (F.col("k") <= F.col("cut")) & (F.col("prob") >= tau_floor) & ~(F.col("is_open") & (F.col("peak") < veto))
    return best.where(keep).select("ref_id", "cand_id", "prob")


def expected_grid(scores: DataFrame, refs: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(recall_hat, tau_floor, macro_f05) over the grid."""
    own = best_labelled(scores, refs, truth)
    w = Window.partitionBy("recall_hat", "ref_id")
    order = w.orderBy(F.desc("prob"), "cand_id")
    hat = F.greatest(F.lit(1e-3), F.least(F.lit(1.0), F.col("recall_hat")))
    none = F.aggregate(F.sort_array(F.collect_list("prob").over(Window.partitionBy("ref_id"))), F.lit(1.0), lambda acc, x: acc * (1 - x))
    rows = over_grid(own.withColumn("e_none", F.round(none, 12)), "recall_hat", s.recall_hat_grid)
    rows = rows.withColumns({"k": F.row_number().over(order), "run": F.sum("prob").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("prob").over(w) / hat})
    p, r = F.col("run") / F.col("k"), F.when(F.col("total") > 0, F.col("run") / F.col("total")).otherwise(0.0)
    rows = rows.withColumn("e_f", F.round(1.25 * p * r / (0.25 * p + r + 1e-12), 12)).withColumn("top_f", F.max("e_f").over(w))
    rows = rows.withColumn("cut", F.min(F.when(F.col("e_f") == F.col("top_f"), F.col("k"))).over(w)).where("top_f > e_none and k <= cut")
    kept = over_grid(rows, "tau_floor", s.tau_floor_grid).where("prob >= tau_floor")
    one = scores.sparkSession.range(1).drop("id")
    return _macro_over(["recall_hat", "tau_floor"], over_grid(over_grid(one, "recall_hat", s.recall_hat_grid), "tau_floor", s.tau_floor_grid), refs, truth, kept)


def top_scores(scores: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, bucket, peak) of the references that have a score."""
    return scores.groupBy("ref_id").agg(F.max("prob").alias("peak")).join(refs.select("ref_id", "bucket"), "ref_id")


def score_quantiles(tops: DataFrame, shares=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Linearly interpolated quantiles of the best scores of each bucket."""
    q = F.percentile("peak", F.array(*map(F.lit, shares)))
    return tops.groupBy("bucket").agg(F.count("*").alias("n"), q.alias("q")).select("bucket", "n", *[F.col("q")[i].alias(f"q{round(100 * x):02d}") for i, x in enumerate(shares)])


def veto_impact(tops: DataFrame, thresholds=(0.0, 0.3, 0.5, 0.7, 0.9, 0.95)) -> DataFrame:
    """How many references each veto would leave empty."""
    rows = over_grid(tops, "threshold", thresholds)
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), F.sum(F.when(F.col("peak") < F.col("threshold"), 1).otherwise(0)).alias("vetoed")).withColumn("share", F.col("vetoed") / F.col("n"))


def open_set_grid(scores: DataFrame, refs: DataFrame, truth: DataFrame, boosts=(0.0, 0.1, 0.2), vetoes=(0.0, 0.3, 0.5, 0.6, 0.7), tau_match: float = DEFAULTS.tau_match, tau_s: float = DEFAULTS.tau_s, margin: float = DEFAULTS.margin) -> DataFrame:
    """(boost, veto, macro_f05) with all given references, of a labelled bucket that is held out, treated as open."""
    rows = best_labelled(scores, refs, truth).withColumn("peak", F.max("prob").over(Window.partitionBy("ref_id")))
    spread = over_grid(over_grid(rows, "boost", boosts), "veto", vetoes)
    kept = spread.where(_kept(F.col("prob"), F.col("peak"), F.lit(tau_match), F.lit(tau_s), F.lit(margin), F.lit(True), F.col("boost"), F.col("veto")))
    one = scores.sparkSession.range(1).drop("id")
    return _macro_over(["boost", "veto"], over_grid(over_grid(one, "boost", boosts), "veto", vetoes), refs, truth, kept)


def tune_open_set(scores: DataFrame, refs: DataFrame, truth: DataFrame, boosts=(0.0, 0.1, 0.2), vetoes=(0.0, 0.3, 0.5, 0.6, 0.7), **thresholds: float) -> DataFrame:
    """(held, boost, veto, macro_f05): each labelled bucket in turn held out and treated as open, over the grid.

    Both parameters touch open references alone, so a bucket's own references are all that counts.
    """
    labelled = [r["bucket"] for r in refs.where(~F.col("is_open")).select("bucket").distinct().orderBy("bucket").collect()]
    out = None
    for name in labelled:
        part = refs.where(F.col("bucket") == name)
        own = part.select("ref_id")
        grid = open_set_grid(scores.join(own, "ref_id", "left_semi"), part, truth.join(own, "ref_id", "left_semi"), boosts, vetoes, **thresholds).select(F.lit(name).alias("held"), "boost", "veto", "macro_f05")
        out = grid if out is None else out.unionByName(grid)
    return out


def choose_open_set(grid: DataFrame, boost: float = DEFAULTS.boost, veto: float = DEFAULTS.veto) -> dict[str, dict[str, float]]:
    """For each held bucket the first best policy in grid order, the default's score and what is gained on it."""
    out: dict[str, dict[str, float]] = {}
    for r in sorted(grid.collect(), key=lambda r: (r["held"], r["boost"], r["veto"])):  # buckets times the grid
        best = out.setdefault(r["held"], {"macro_f05": -1.0, "default": 0.0})
        if round(r["macro_f05"], 12) > round(best["macro_f05"], 12):
            best |= {"boost": r["boost"], "veto": r["veto"], "macro_f05": r["macro_f05"]}
        if (r["boost"], r["veto"]) == (boost, veto):
            best["default"] = r["macro_f05"]
    return {k: v | {"improvement": v["macro_f05"] - v["default"]} for k, v in out.items()}


def compare(scores: DataFrame, refs: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(rule, a, b, macro_f05): the first best setting of thresholds (tau_match, tau_s) and of expected F0.5 (recall_hat, tau_floor)."""
    one = decide_grid(scores, refs, truth, s).select(F.lit("thresholds").alias("rule"), F.col("tau_match").alias("a"), F.col("tau_s").alias("b"), "macro_f05")
    two = expected_grid(scores, refs, truth, s).select(F.lit("expected").alias("rule"), F.col("recall_hat").alias("a"), F.col("tau_floor").alias("b"), "macro_f05")
    return top(one.unionByName(two).withColumn("f", F.round("macro_f05", 12)), ["rule"], [F.desc("f"), F.col("a"), F.col("b")], 1).select("rule", "a", "b", "macro_f05")


def tune_expected(scores: DataFrame, refs: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> tuple[float, dict[str, float], float]:
    """(tau_floor, recall_hat of each bucket, recall_hat for all): first the best pair for all references, then for each
    bucket without open references the recall_hat that suits it best, smaller values first on ties.
    """
    def first(rows: list, *keys: str):
        return max(sorted(rows, key=lambda r: tuple(r[k] for k in keys)), key=lambda r: round(r["macro_f05"], 12))

    best = first(expected_grid(scores, refs, truth, s).collect(), "tau_floor", "recall_hat")
    floor, hat = best["tau_floor"], best["recall_hat"]
    own = {}
    for r in refs.groupBy("bucket").agg(F.max("is_open").alias("open")).orderBy("bucket").collect():
        if not r["open"]:
            part = refs.where(F.col("bucket") == r["bucket"])
            inside = expected_grid(scores.join(part.select("ref_id"), "ref_id", "left_semi"), part, truth.join(part.select("ref_id"), "ref_id", "left_semi"), s).where(F.col("tau_floor") == floor)
            own[r["bucket"]] = first(inside.collect(), "recall_hat")["recall_hat"]
    return floor, own, hat


def decide_expected_by_bucket(scores: DataFrame, refs: DataFrame, tau_floor: float, hats: dict[str, float], hat: float, veto: float = DEFAULTS.veto) -> DataFrame:
    """decide_expected with each bucket's recall_hat; open references use the one for all."""
    out = decide_expected(scores, refs.where(F.col("is_open") | ~F.col("bucket").isin(*hats)), hat, tau_floor, veto)
    for name, own in hats.items():
        out = out.unionByName(decide_expected(scores, refs.where(~F.col("is_open") & (F.col("bucket") == name)), own, tau_floor, veto))
    return out


@dataclass
class Policy:
    """What a decision needs, as stored between runs."""

    tau_match: float = DEFAULTS.tau_match
    tau_s: float = DEFAULTS.tau_s
    margin: float = DEFAULTS.margin
    boost: float = DEFAULTS.boost
    veto: float = DEFAULTS.veto
    open_set: list[str] = field(default_factory=lambda: list(DEFAULTS.open_set))

    def dump(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def resolve(given: dict[str, Any], *stored: dict[str, Any]) -> Policy:
    """A policy from explicit values, then stored ones in their order, then the defaults; None counts as not given."""
    names = Policy.__dataclass_fields__
    return Policy(**{n: v for n in names for v in [next((d[n] for d in (given, *stored) if d.get(n) is not None), None)] if v is not None})
