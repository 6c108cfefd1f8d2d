"""The linkage pipeline from records to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS, Settings
from kinweave.operators import blocking, decision, features, fusion, packed
from kinweave.plans import views
from kinweave.sources import records
from kinweave.sources.folders import checkpoint, stored


def channels(refs: DataFrame, cands: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(ref_id, channel, cand_id, score, rank) of the exact, word and character channels."""
    whole = F.trim(F.concat_ws(" ", "name_core", "addr_norm"))
    chars = blocking.char_channel(refs.withColumn("key", whole), cands.withColumn("key", whole), s, column="key")
    return blocking.union_channels(exact=blocking.exact_channel(refs, cands, s.top_k, s.exact_posting_cap), word=blocking.word_channel(refs, cands, s), char=chars)


def token_similarity(pairs: DataFrame, refs: DataFrame, cands: DataFrame) -> DataFrame:
    """(ref_id, cand_id, prob) of pairs of a bucket: Jaccard similarity of the records' tokens, to six places, in place of a trained model."""
    return packed.jaccard(pairs, refs.withColumn("terms", F.col("toks")), cands.withColumn("terms", F.col("toks")))


def _documents(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/documents.parquet"]


def stored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all channels, retrieved once in a session."""
    return stored(spark, "channels", _documents(sf_dir), lambda: channels(*views.sides(spark, sf_dir)))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of all channels with their scores, computed once in a session."""
    return stored(spark, "scores", _documents(sf_dir), lambda: token_similarity(stored_lists(spark, sf_dir), *views.sides(spark, sf_dir)))


def link(raw: DataFrame, score=None, s: Settings = DEFAULTS) -> DataFrame:
    """(ref_id, cand_id, prob) of matches in normalised records of the three sources.

    score takes the feature table and returns it with prob; without one the name and address similarities are averaged.
    """
    raw = checkpoint(raw)  # this and what follows are read several times
    refs, cands = records.references_and_candidates(raw)
    body = F.trim(F.concat_ws(" ", "name_core", "addr_norm"))
    refs, cands = refs.withColumn("text", body), cands.withColumn("text", body)
    lists = checkpoint(blocking.union_channels(exact=blocking.exact_channel(refs, cands), word=blocking.word_channel(refs, cands, s), char=blocking.char_channel(refs, cands, s)))
    fused = checkpoint(fusion.rrf(lists, s.rrf_k_grid[0]))
    kept = fusion.truncate(fusion.coarse(fused, lists, 3, s=s), s.ratio, s.k_min, s.k_max)
    signals = fused.select("ref_id", "cand_id", F.col("score").alias("rrf_score")).join(fusion.agreement(lists, 3).withColumnRenamed("agreement", "channel_agreement"), ["ref_id", "cand_id"])
    weighed = checkpoint(features.with_weights(raw, checkpoint(features.idf_table(raw)), raw.count()))
    pairs = checkpoint(kept.select("ref_id", "cand_id", (F.col("rank") - 1).alias("rank")).join(signals, ["ref_id", "cand_id"], "left"))
    table = features.features(pairs, weighed)
    probs = score(table) if score else table.withColumn("prob", (F.col("name_token_sort") + F.col("addr_token_jaccard")) / 2)
    open_refs = decision.with_open(refs.select(F.col("id").alias("ref_id"), "bucket"), s)
    return decision.decide(probs.select("ref_id", "cand_id", F.col("prob").cast("double").alias("prob")), open_refs, s.tau_match, s.tau_s, s.margin, s.boost, s.veto)
