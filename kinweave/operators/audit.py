"""Profiles, checks of coverage, diagnostics and leak probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import metrics
from kinweave.operators.common import ratio, top
from kinweave.sources.folders import exists


def missing_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_pct): the share of rows that are empty after trimming, in percent to four places."""
    row = df.agg(*[F.round(F.coalesce(F.avg(F.when(F.trim(text.filled(F.col(c))) == "", 100.0).otherwise(0.0)), F.lit(0.0)), 4).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_pct")) for c in columns])).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def text_profile(df: DataFrame, column: str, by: str) -> DataFrame:
    """Mean, median and largest length and number of words."""
    rows = df.select(by, F.length(column).alias("chars"), F.size(F.filter(F.split(column, r"\s+"), lambda x: x != "")).alias("words"))
    stats = [f(c).cast("double").alias(f"{name}_{c}") for c in ("chars", "words") for name, f in (("mean", F.avg), ("median", F.median), ("max", F.max))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *stats)


def cardinality(refs: DataFrame, truth: DataFrame) -> DataFrame:
    """How many references have no, one, or more true matches."""
    n = truth.distinct().groupBy("ref_id").agg(F.count("*").alias("t"))
    rows = refs.select("ref_id").distinct().join(n, "ref_id", "left").fillna(0, ["t"])
    return rows.groupBy(F.when(F.col("t") == 0, "0").when(F.col("t") == 1, "1").otherwise("2+").alias("matches")).agg(F.count("*").alias("n_refs"))


def bucket_mismatch(records: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs whose records have different buckets."""
    own = records.select("entity_id", "bucket")
    a, b = own.select(F.col("entity_id").alias("ref_id"), F.col("bucket").alias("ba")), own.select(F.col("entity_id").alias("cand_id"), F.col("bucket").alias("bb"))
    rows = truth.join(a, "ref_id").join(b, "cand_id")
    return rows.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.when(F.col("ba") != F.col("bb"), 1).otherwise(0)), F.lit(0)).alias("mismatched"))


def twin_mismatch(records: DataFrame, key: str) -> DataFrame:
    """bucket_mismatch of all pairs of a reference and a candidate with equal keys, from counts per key and bucket; no pair is made."""
    per = records.groupBy(key, "bucket").agg(F.count(F.when(F.col("src") == 1, 1)).alias("a"), F.count(F.when(F.col("src") != 1, 1)).alias("b"))
    keys = per.where(F.col(key).isNotNull()).groupBy(key).agg((F.sum("a") * F.sum("b")).alias("pairs"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("a") * F.col("b")).otherwise(0)).alias("same"))
    return keys.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.col("pairs") - F.col("same")), F.lit(0)).alias("mismatched"))


def missing_references(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References of each bucket that `found` lacks."""
    return refs.join(found.select("ref_id").distinct(), "ref_id", "left_anti").groupBy("bucket").agg(F.count("*").alias("missing"))


def coverage(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, expected, found, missing, share)."""
    have = found.select("ref_id").distinct().withColumn("have", F.lit(1))
    rows = refs.join(have, "ref_id", "left").groupBy("bucket").agg(F.count("*").alias("expected"), F.count("have").alias("found"))
    return rows.withColumns({"missing": F.col("expected") - F.col("found"), "share": ratio(F.col("found"), F.col("expected"))})


def check_coverage(refs: DataFrame, found: DataFrame, least: float = 1.0) -> None:
    """Raise if a bucket's references aren't covered, or if rows are outside the references."""
    bad = coverage(refs, found).where(F.col("share") < least).orderBy("bucket").head(20)
    if bad:
        raise ValueError("missing references: " + ", ".join(f"{r['bucket']} {r['missing']} of {r['expected']}" for r in bad))
    if not found.select("ref_id").distinct().join(refs.select("ref_id"), "ref_id", "left_anti").isEmpty():
        raise ValueError("rows of references out of scope")


def planned_counts(refs: DataFrame, run: dict | None = None) -> dict[str, int]:
    """The references of each bucket that later stages should find: what a deliberately sampled or capped run processed, else all."""
    if run and (run.get("ref_sample") is not None or run.get("max_refs") is not None) and run.get("per_bucket"):
        return {b: int(n) for b, n in run["per_bucket"].items()}
    return {r["bucket"]: r["count"] for r in refs.groupBy("bucket").count().collect()}


def check_artifacts(spark: SparkSession, places: dict[str, str], expected: dict[str, int], least: float = 0.999, allow_missing: bool = False) -> dict[str, dict]:
    """What each bucket's stored table covers; raises if one is missing or truncated.

    places: bucket to path. A bucket without expected references is out of scope, not missing; a table with fewer than
    `least` of its references is truncated, as a trial run leaves behind.
    """
    out, bad = {}, []
    for bucket in dict.fromkeys(x.strip().lower() for names in places for x in names.split(",") if x.strip()):
        n = expected.get(bucket)
        there = exists(spark, places[bucket])
        found = spark.read.parquet(places[bucket]).select("ref_id").distinct().count() if there else 0
        state = "present" if there and (not n or found >= least * n) else "truncated" if there else "out of scope" if n == 0 else "missing"
        out[bucket] = {"state": state, "expected": n, "found": found}
        if state == "truncated" or state == "missing" and not allow_missing:
            bad.append(f"{bucket}: {state}, {found} of {n} references")
    if bad:
        raise ValueError("; ".join(bad))
    return out


def missed_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    return truth.distinct().join(found.select("ref_id", "cand_id").distinct(), ["ref_id", "cand_id"], "left_anti")


def missed_profile(truth: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """What missed true pairs look like: equal names, shared tokens, missing addresses, different scripts."""
    rec = records.select("entity_id", F.struct("name_core", "addr_norm", text.script(F.col("name_core")).alias("script")).alias("r"))
    rows = missed_pairs(truth, found).join(rec.select(F.col("entity_id").alias("ref_id"), F.col("r").alias("a")), "ref_id").join(rec.select(F.col("entity_id").alias("cand_id"), F.col("r").alias("b")), "cand_id")
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    names, addresses = (text.jaccard(text.tokens(F.col(f"a.{c}")), text.tokens(F.col(f"b.{c}"))) for c in ("name_core", "addr_norm"))
    one, two = F.col("a.addr_norm") == "", F.col("b.addr_norm") == ""
    return rows.agg(
        F.count("*").alias("missed"), share(F.col("a.name_core") == F.col("b.name_core")).alias("same_name"), share(names >= 0.5).alias("similar_name"), share(names < 0.5).alias("other_name"), share(addresses >= 0.5).alias("similar_address"),
        share(one & two).alias("missing_both"), share(one != two).alias("missing_address"), share((names < 0.5) & (addresses < 0.5)).alias("other_both"),
        share((F.col("a.script") != F.col("b.script")) & ((F.col("a.script") == "latin") | (F.col("b.script") == "latin"))).alias("cross_script"),
    )


def error_classes(refs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """per_reference with the class of its outcome, a bucket of its number of predictions and what they draw on."""
    rows = metrics.per_reference(refs, truth, pred)
    t, p, f = F.col("n_true"), F.col("n_pred"), F.col("f05")
    kind = F.when((t == 0) & (p == 0), "true_singleton").when(t == 0, "false_positive").when(p == 0, "miss").when(f == 1.0, "exact").otherwise("partial")
    mixes = []
    for name, df in (("pred_source", pred), ("gt_source", truth)):
        mixes.append(df.groupBy("ref_id").agg(text.source_mix(F.collect_set(F.substring("cand_id", 1, 3))).alias(name)))  # at most a few prefixes
    out = rows.withColumn("error_class", kind)
    for m in mixes:
        out = out.join(m, "ref_id", "left")
    return out.fillna("none", ["pred_source", "gt_source"])


def group_metrics(classes: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Means and class counts by a column, the largest groups first."""
    c = F.col("error_class")
    single = c == "true_singleton"
    rows = classes.groupBy(F.col(by).cast("string").alias("group")).agg(
        F.count("*").alias("n"), F.avg("f05").alias("macro_f05"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        *[F.count(F.when(c == k, 1)).alias(k) for k in ("true_singleton", "false_positive", "miss", "exact", "partial")],
        F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(0.0)).alias("singleton_mean"), F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)).alias("match_mean"),
    ).orderBy(F.desc("n"), "group")
    return rows.limit(n) if n else rows


def error_focus(classes: DataFrame) -> DataFrame:
    """(error_class, n, share, f05_mass): where the loss lies."""
    total = classes.agg(F.count("*").alias("total"))
    per = classes.groupBy("error_class").agg(F.count("*").alias("n"), F.round(F.sum("f05"), 4).alias("f05_mass"))
    return per.join(F.broadcast(total)).select("error_class", "n", ratio(F.col("n"), F.col("total")).alias("share"), "f05_mass")  # one row


def with_dimensions(classes: DataFrame, records: DataFrame) -> DataFrame:
    """classes with the columns that diagnostics group by: bucket, length buckets of name and address, script."""
    own = records.select(F.col("entity_id").alias("ref_id"), "bucket", text.length_bucket(F.length("name_core")).alias("name_bucket"), text.length_bucket(F.length("addr_norm")).alias("addr_bucket"), text.script(F.col("name_core")).alias("script"))
    return classes.drop("bucket").join(own, "ref_id")


DIMENSIONS = ("bucket", "gt_source", "pred_source", "name_bucket", "addr_bucket", "script")


def diagnostics(classes: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """group_metrics by each dimension, with the dimension's name; the rows are read once, each once for a dimension."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    rows = classes.select("*", each.alias("d")).select("*", F.concat_ws("\x00", "d.dimension", "d.value").alias("__both"))
    found = group_metrics(rows, "__both")
    parts = F.split("group", "\x00")
    return found.withColumns({"dimension": parts[0], "group": parts[1]})


def spot_check(refs: DataFrame, pred: DataFrame, scores: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Volumes of an unlabelled bucket's predictions, and the n references with the best scores."""
    per = refs.select("ref_id").join(pred.groupBy("ref_id").agg(F.count("*").alias("n_pred")), "ref_id", "left").join(scores.groupBy("ref_id").agg(F.max("prob").alias("peak")), "ref_id", "left").fillna(0, ["n_pred"])
    totals = per.agg(F.count("*").alias("n_refs"), F.count(F.when(F.col("n_pred") > 0, 1)).alias("non_empty"), F.avg("n_pred").alias("mean_pred"), F.percentile("peak", 0.5).alias("median_peak"))
    return totals, per.orderBy(F.desc_nulls_last("peak"), "ref_id").limit(n)


def name_twins(records: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of a reference and a candidate source's records with equal keys, counted on each side; no pair is made."""
    sides = records.groupBy(*key).agg(F.count(F.when(F.col("src") == 1, 1)).alias("a"), F.count(F.when(F.col("src") != 1, 1)).alias("b"))
    return sides.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("pairs"), F.count(F.when((F.col("a") > 0) & (F.col("b") > 0), 1)).alias("keys"))


def overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that both tables have."""
    return a.select(*key).intersect(b.select(*key)).agg(F.count("*").alias("shared"))


def id_offsets(truth: DataFrame) -> DataFrame:
    """How often true pairs have each difference of id numbers: a leak shows as one that stands out."""
    num = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    return truth.distinct().groupBy((num("cand_id") - num("ref_id")).alias("offset")).agg(F.count("*").alias("n"))


def rank_offsets(a: DataFrame, b: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for places in the two tables' order within a bucket."""
    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), F.row_number().over(Window.partitionBy("bucket").orderBy("seq")).alias(f"{name}_place"))

    rows = truth.distinct().join(placed(a, "ref_id"), "ref_id").join(placed(b, "cand_id"), "cand_id")
    return rows.groupBy((F.col("cand_id_place") - F.col("ref_id_place")).alias("offset")).agg(F.count("*").alias("n"))


def signal_rates(features: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The share of true pairs that pass each similarity's threshold."""
    row = features.where("label = 1").agg(F.count("*").alias("n"), *[F.coalesce(F.avg(F.when(F.col(c) >= t, 1.0).otherwise(0.0)), F.lit(0.0)).alias(c) for c, t in thresholds.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.lit(t).alias("threshold"), F.col(c).alias("share")) for c, t in thresholds.items()])).alias("x")).select("x.*")


def inspect_pairs(truth: DataFrame, records: DataFrame, n: int = 20) -> DataFrame:
    """The first n true pairs with both records' names and addresses."""
    rec = records.select("entity_id", F.struct("name_raw", "addr_raw").alias("r"))
    head = truth.distinct().orderBy("ref_id", "cand_id").limit(n)
    return head.join(rec.select(F.col("entity_id").alias("ref_id"), F.col("r").alias("ref")), "ref_id").join(rec.select(F.col("entity_id").alias("cand_id"), F.col("r").alias("cand")), "cand_id")


def largest(df: DataFrame, keys: list[str], by: str, n: int) -> DataFrame:
    return top(df, keys, [F.desc(by)], n)
