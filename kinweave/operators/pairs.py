"""Splits, samples and labelled pairs. Everything random is a hash of ids, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS, Settings
from kinweave.operators.common import top


#: Cells of a range of hashes.
CELLS = 4096


def spread(number: Column) -> Column:
    """A multiplicative hash of a non-negative whole number to 0 .. 2**32 - 1, the same in any SQL engine."""
    return (F.pmod(number, F.lit(1 << 30)) * F.lit(2654435761)) % F.lit(1 << 32)


def hashed(*ids: Column, seed: int = DEFAULTS.seed) -> Column:
    return F.xxhash64(*ids, F.lit(seed))


def split(refs: DataFrame, share: float = 0.2, key: Column | None = None) -> DataFrame:
    """refs with the column split: `val` for the share of the references whose hash is smallest, rounded down, else `train`.

    Ties go by id. The hashes' range is cut into CELLS equal cells, whose counts tell the cell where the share ends; only
    that cell's references are ranked.
    """
    h = hashed(F.col("ref_id")) if key is None else key
    rows = refs.withColumn("__h", h)
    total, low, high = rows.agg(F.count("*"), F.min("__h"), F.max("__h")).first()
    n, span = int(total * share), float((high or 0) - (low or 0) + 1)
    cell = F.floor((F.col("__h").cast("double") - F.lit(float(low or 0))) / F.lit(span) * CELLS)
    rows = rows.withColumn("__cell", cell)
    left, last = n, None
    for r in sorted(rows.groupBy("__cell").count().collect(), key=lambda r: r["__cell"]):  # about CELLS rows at most
        if left < r["count"]:
            last = r["__cell"]
            break
        left -= r["count"]
    if last is None:
        return refs.withColumn("split", F.lit("val" if n else "train"))
    edge = rows.where(F.col("__cell") == last).select("ref_id", "__h").orderBy("__h", "ref_id").limit(left).select("ref_id").withColumn("__val", F.lit(True))
    val = (F.col("__cell") < last) | F.coalesce("__val", F.lit(False))
    return rows.join(edge, "ref_id", "left").withColumn("split", F.when(val, "val").otherwise("train")).drop("__h", "__cell", "__val")


def sample_references(refs: DataFrame, n: int, key: Column | None = None) -> DataFrame:
    """The n references of each bucket whose hash is smallest."""
    h = hashed(F.col("ref_id")) if key is None else key
    return top(refs.withColumn("h", h), ["bucket"], [F.col("h"), F.col("ref_id")], n).drop("h", "rank")


def folds(refs: DataFrame, n: int = DEFAULTS.folds, key: Column | None = None) -> DataFrame:
    """refs with a fold of 0 .. n - 1 for each ref_id; all pairs of a reference share it."""
    return refs.withColumn("fold", F.pmod(hashed(F.col("ref_id")) if key is None else key, F.lit(n)).cast("int"))


def easy_pool(cands: DataFrame, n: int = DEFAULTS.easy_pool, key: Column | None = None) -> DataFrame:
    """Up to n candidates of each bucket, numbered from 0 in hash order."""
    h = hashed(F.col("cand_id")) if key is None else key
    pool = top(cands.withColumn("h", h), ["bucket"], [F.col("h"), F.col("cand_id")], n)
    return pool.select("bucket", "cand_id", (F.col("rank") - 1).alias("slot"))


def draw_easy(refs: DataFrame, pool: DataFrame, taken: DataFrame, key: Column, tries: int = 8) -> DataFrame:
    """(ref_id, cand_id): up to `want` candidates of the pool for each reference (ref_id, bucket, want), none of them taken.

    A reference tries the pool's slots from its hash on, `tries` times what it wants.
    """
    sizes = pool.groupBy("bucket").agg(F.count("*").alias("size"))
    tried = refs.where("want > 0").join(F.broadcast(sizes), "bucket").withColumn("try", F.explode(F.sequence(F.lit(0), F.least(F.col("want") * tries, F.col("size")).cast("int") - 1)))
    slots = tried.withColumn("slot", F.pmod(key + F.col("try"), F.col("size")).cast("int"))
    free = slots.join(pool, ["bucket", "slot"]).join(taken.select("ref_id", "cand_id"), ["ref_id", "cand_id"], "left_anti")
    return top(free, ["ref_id"], [F.col("try")], None).where("rank <= want").select("ref_id", "cand_id")


def sample_pairs(refs: DataFrame, ranked: DataFrame, truth: DataFrame, pool: DataFrame, key: Column | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """(ref_id, cand_id, label, neg_type, bucket, rank): labelled pairs for training.

    Positives are candidates that are true; hard negatives the best others, easy ones drawn from the pool. rank counts
    from 0, -1 for easy ones.
    """
    marked = ranked if "hit" in ranked.columns else ranked.join(truth.distinct().withColumn("hit", F.lit(1)), ["ref_id", "cand_id"], "left")  # as rrf marks them
    marked = marked.withColumn("label", F.when(F.col("hit") == 1, 1).otherwise(0))
    true = refs.select("ref_id", "bucket").join(truth.groupBy("ref_id").agg(F.count("*").alias("n_true")), "ref_id", "left").fillna(0, ["n_true"])
    single = F.col("n_true") == 0
    placed = top(marked.withColumn("n_pos", F.sum("label").over(Window.partitionBy("ref_id"))).withColumnRenamed("rank", "list_rank"), ["ref_id"], [F.col("label"), F.col("list_rank"), F.col("cand_id")], None, "place")  # false pairs come first
    most = F.when(single, s.singleton_hard).otherwise(F.col("n_pos") * s.hard_per_positive)
    own = placed.where((F.col("label") == 1) | (F.col("place") <= F.greatest(F.lit(s.singleton_hard), F.col("n_pos") * s.hard_per_positive))).join(true, "ref_id").where((F.col("label") == 1) | (F.col("place") <= most))
    own = own.select("ref_id", "cand_id", "label", F.when(F.col("label") == 1, "pos").otherwise("hard").alias("neg_type"), "bucket", (F.col("list_rank") - 1).alias("rank"))
    counts = true.join(marked.groupBy("ref_id").agg(F.sum("label").alias("n_pos")), "ref_id", "left").fillna(0, ["n_pos"])
    wants = counts.withColumn("want", F.when(single, s.singleton_easy).otherwise(F.col("n_pos") * s.easy_per_positive))
    taken = ranked.select("ref_id", "cand_id").unionByName(truth.select("ref_id", "cand_id"))
    easy = draw_easy(wants.select("ref_id", "bucket", "want"), pool, taken, hashed(F.col("ref_id")) if key is None else key)
    easy = easy.join(refs.select("ref_id", "bucket"), "ref_id").select("ref_id", "cand_id", F.lit(0).alias("label"), F.lit("easy").alias("neg_type"), "bucket", F.lit(-1).alias("rank"))
    return own.unionByName(easy)


def without_hard(pairs: DataFrame) -> DataFrame:
    return pairs.where("neg_type != 'hard'")


def without_easy(pairs: DataFrame) -> DataFrame:
    return pairs.where("neg_type != 'easy'")


def summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("neg_type").agg(F.count("*").alias("n_pairs"), F.count_distinct("ref_id").alias("n_refs"), F.sum("label").alias("n_positive"))


def attach_signals(pairs: DataFrame, signals: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of a stored table of signals by (ref_id, cand_id).

    Raises if the tables have drifted apart: if a pair lacks its row, or the stored table has a pair twice.
    """
    keys = ["ref_id", "cand_id"]
    own = signals.select(*keys, *columns)
    if not own.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the stored signals have a pair twice")
    missing = pairs.select(*keys).join(own.select(*keys), keys, "left_anti")
    if not missing.isEmpty():
        r = missing.first()
        raise ValueError(f"the stored signals lack pairs, such as {r['ref_id']} and {r['cand_id']}: they belong to other lists")
    return pairs.join(own, keys)
