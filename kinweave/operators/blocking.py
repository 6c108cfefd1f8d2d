"""Candidate retrieval: exact keys, sparse term indexes, phonetic tiers.

Records are (id, bucket, seq, ...); seq is a total order of the candidates that breaks ties and orders postings.
Results are (ref_id, cand_id, score, rank), the best k for each reference; joins are equi-joins on (bucket, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULTS, Settings
from kinweave.functions import arrow, lists, text
from kinweave.operators import packed
from kinweave.operators.common import bound, top


def postings(df: DataFrame, keys: list[str], cap: int, order: str = "seq") -> DataFrame:
    """The first `cap` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def exact_keys(df: DataFrame) -> DataFrame:
    """A row for each key of a record: tier 3 is name and postal code, 2 name and house number, 1 the name."""
    parts = ("addr_postal", "addr_house_number")
    df = bound(df, __name=F.col("name_core"), **{f"__{p}": text.filled(F.col(p)) for p in parts})  # a filter on a name would split the texts a second time
    name = F.col("__name")

    def with_part(tier: int, part: str) -> Column:
        value = F.col(f"__{part}")
        return F.struct(F.lit(tier).alias("tier"), F.when(value != "", F.concat(name, F.lit("|"), value)).alias("key"))

    keys = F.array(with_part(3, "addr_postal"), with_part(2, "addr_house_number"), F.struct(F.lit(1).alias("tier"), name.alias("key")))
    return df.where(name != "").select("id", "bucket", "seq", F.inline(keys)).where("key is not null")


def exact_channel(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, cap: int = DEFAULTS.exact_posting_cap) -> DataFrame:
    """Candidates that share a key of the best tier at which the reference meets any; first k in candidate order.

    A reference has one key of a tier, so no more than the first k postings of a key are ever needed: an index row holds
    just those, and a hot key adds one row to each reference.
    """
    first = postings(exact_keys(cands), ["bucket", "tier", "key"], min(k, cap))
    index = first.groupBy("bucket", "tier", "key").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("id").alias("cand_id")))).alias("held"))  # at most k
    met = exact_keys(refs).select(F.col("id").alias("ref_id"), "bucket", "tier", "key").join(index, ["bucket", "tier", "key"])
    best = met.groupBy("ref_id").agg(F.max("tier").cast("double").alias("score"), F.max_by("held", "tier").alias("held"))
    return best.select("ref_id", "score", F.posexplode("held").alias("at", "x")).select("ref_id", F.col("x.cand_id").alias("cand_id"), "score", (F.col("at") + 1).alias("rank"))


def document_frequency(postings_: DataFrame, sizes: DataFrame, min_df: int, max_df: float, small_pool: int = 0) -> DataFrame:
    """(bucket, term, df, idf) of the terms that min_df documents and a share of max_df documents at most have; all terms of buckets below small_pool documents."""
    return weighted_terms(postings_.groupBy("bucket", "term").agg(F.count("*").alias("df")), sizes, min_df, max_df, small_pool)


def weighted_terms(counts: DataFrame, sizes: DataFrame, min_df: int, max_df: float, small_pool: int = 0) -> DataFrame:
    """document_frequency from (bucket, term, df)."""
    df = counts.join(F.broadcast(sizes), "bucket")
    df = df.where((F.col("n") < small_pool) | (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * F.col("n")))
    return df.select("bucket", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def sparse_index(cands: DataFrame, min_df: int = DEFAULTS.word_min_df, max_df: float = DEFAULTS.word_max_df, scan: int = DEFAULTS.max_posting_scan, small_pool: int = 0) -> DataFrame:
    """(bucket, term, df, idf, cand_id, seq): the first `scan` postings of each term of the array column `terms`.

    A table that may be written and searched again. The buckets' sizes are one row per bucket, hence the broadcast.
    """
    held = cands.select("id", "bucket", "seq", F.explode(F.array_distinct("terms")).alias("term"))
    vocabulary = document_frequency(held, cands.groupBy("bucket").agg(F.count("*").alias("n")), min_df, max_df, small_pool)
    indexed = held.join(vocabulary, ["bucket", "term"])
    short, long = indexed.where(F.col("df") <= scan), postings(indexed.where(F.col("df") > scan), ["bucket", "term"], scan)
    return short.unionByName(long).select("bucket", "term", "df", "idf", F.col("id").alias("cand_id"), "seq")


def sparse_search(refs: DataFrame, index: DataFrame, k: int = DEFAULTS.top_k, query_terms: int = DEFAULTS.max_query_terms, vocabulary: DataFrame | None = None) -> DataFrame:
    """Retrieval from a sparse_index over the array column `terms` of refs.

    A reference's terms weigh (1 + ln tf) * idf, scaled to unit length over the vocabulary; its `query_terms` rarest
    terms scan their postings; a candidate scores the sum of the query's weights of the terms it shares.
    """
    if vocabulary is None:
        vocabulary = index.groupBy("bucket", "term").agg(F.max("df").alias("df"), F.max("idf").alias("idf"))
    asked = refs.select("id", "bucket", F.explode("terms").alias("term")).groupBy("id", "bucket", "term").agg(F.count("*").alias("tf"))
    weighed = asked.join(vocabulary, ["bucket", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    weighed = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))
    rare = top(weighed, ["id"], [F.col("df"), F.col("term")], query_terms).select(F.col("id").alias("ref_id"), "bucket", "term", "w")
    found = rare.join(index.select("bucket", "term", "cand_id", "seq"), ["bucket", "term"])
    summed = found.groupBy("ref_id", "cand_id", "seq").agg(F.round(F.sum("w"), 9).alias("score")).where("score > 0")
    return top(summed, ["ref_id"], [F.desc("score"), F.col("seq")], k).select("ref_id", "cand_id", "score", "rank")


def sparse_channel(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, min_df: int = DEFAULTS.word_min_df, max_df: float = DEFAULTS.word_max_df, query_terms: int = DEFAULTS.max_query_terms, scan: int = DEFAULTS.max_posting_scan, small_pool: int = 0) -> DataFrame:
    """What sparse_search finds in the sparse_index of cands, from packed blocks instead of a row for each posting and pair."""
    return packed.search(refs, cands, k, query_terms, scan, lambda counts, sizes: weighted_terms(counts, sizes, min_df, max_df, small_pool))


def word_channel(refs: DataFrame, cands: DataFrame, s: Settings = DEFAULTS, k: int | None = None, column: str = "text") -> DataFrame:
    terms = text.word_terms(text.filled(F.col(column)))
    return sparse_channel(refs.withColumn("terms", terms), cands.withColumn("terms", terms), k or s.top_k, s.word_min_df, s.word_max_df, s.max_query_terms, s.max_posting_scan)


def char_channel(refs: DataFrame, cands: DataFrame, s: Settings = DEFAULTS, k: int | None = None, column: str = "text") -> DataFrame:
    terms = text.char_terms(text.filled(F.col(column)), *s.char_ngrams)
    return sparse_channel(refs.withColumn("terms", terms), cands.withColumn("terms", terms), k or s.top_k, s.char_min_df, s.char_max_df, s.max_query_terms, s.max_posting_scan)


def sparse_cosine(refs: DataFrame, cands: DataFrame, k: int = 200, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """The full product of unit query and document weights, a true cosine without limits on terms or postings."""
    def tf(df: DataFrame) -> DataFrame:
        return df.select("id", "bucket", F.explode("terms").alias("term")).groupBy("id", "bucket", "term").agg(F.count("*").alias("tf"))

    held = tf(cands)
    vocabulary = document_frequency(held, cands.groupBy("bucket").agg(F.count("*").alias("n")), min_df, max_df)

    def unit(df: DataFrame) -> DataFrame:
        w = df.join(vocabulary, ["bucket", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        return w.select("id", "bucket", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("w"))

    q, d = unit(tf(refs)), unit(held).select(F.col("id").alias("cand_id"), "bucket", "term", F.col("w").alias("v"))
    scored = q.withColumnRenamed("id", "ref_id").join(d, ["bucket", "term"]).groupBy("ref_id", "cand_id").agg(F.round(F.sum(F.col("w") * F.col("v")), 9).alias("score"))
    scored = scored.join(cands.select(F.col("id").alias("cand_id"), "seq"), "cand_id")
    return top(scored, ["ref_id"], [F.desc("score"), F.col("seq")], k).select("ref_id", "cand_id", "score", "rank")


def phonetic_columns(df: DataFrame, name: str = "name_raw", address: str | None = None) -> DataFrame:
    """df with core, ph, addr_ph and terms: romanised core of the name, its phonetic key, that of the address, prefixed codes."""
    plain = F.lower(arrow.romanized(text.filled(F.col(name))))
    df = df.withColumn("core", F.array_join(F.filter(text.tokens(F.regexp_replace(plain, lists.LEGAL_FORMS, " ")), lambda t: F.length(t) >= 2), " "))
    if address:
        bare = F.regexp_replace(F.regexp_replace(F.lower(arrow.romanized(text.filled(F.col(address)))), lists.ADDRESS_NOISE, " "), r"[^\p{L}\p{N}_\s]", " ")
        df = df.withColumn("addr_core", F.array_join(F.filter(text.tokens(bare), lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{Nd}+$")), " "))
    else:
        df = df.withColumn("addr_core", F.lit(""))
    df = df.withColumns({"ph": arrow.metaphone_key(F.col("core")), "addr_ph": arrow.metaphone_key(F.col("addr_core"))})

    def codes(key: str, source: str, m: str, s: str) -> Column:
        sounds = F.filter(F.transform(text.tokens(F.col(source)), arrow.soundex), lambda x: x != "")
        return F.concat(F.transform(text.tokens(F.col(key)), lambda x: F.concat(F.lit(m), x)), F.transform(sounds, lambda x: F.concat(F.lit(s), x)))

    return df.withColumn("terms", F.concat(codes("ph", "core", "M_", "S_"), codes("addr_ph", "addr_core", "AM_", "AS_")))


def phonetic_keys(df: DataFrame) -> DataFrame:
    """Keys and their scores: core and address 4, core 3 with or without postal code, phonetic and address 2.5, phonetic 2, address 1.5."""
    core, ph, addr, post = (text.filled(F.col(x)) for x in ("core", "ph", "addr_ph", "addr_postal"))

    def key(score: float, kind: str, *parts: Column, more=None) -> Column:
        ok = parts[0] != ""
        for p in parts[1:]:
            ok &= p != ""
        return F.struct(F.lit(score).alias("score"), F.lit(kind).alias("kind"), F.when(ok if more is None else ok & more, F.concat_ws("|", *parts)).alias("key"))

    keys = F.array(
        key(4.0, "core_addr", core, addr), key(3.0, "core_postal", core, post), key(3.0, "core", core), key(2.5, "ph_addr", ph, addr),
        key(2.0, "ph_postal", ph, post), key(2.0, "ph", ph), key(1.5, "addr", addr, more=F.size(text.tokens(addr)) >= 2),
    )
    return df.select("id", "bucket", "seq", F.inline(keys)).where("key is not null")


def phonetic_channel(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, s: Settings = DEFAULTS, small_pool: int = 50) -> DataFrame:
    """The best score of each candidate over the exact tiers and the sparse channel of phonetic codes.

    In buckets below small_pool candidates all codes count, however rare or frequent.
    """
    index = phonetic_keys(cands)
    capped = postings(index.where("kind != 'addr'"), ["bucket", "kind", "key"], s.exact_posting_cap).unionByName(postings(index.where("kind = 'addr'"), ["bucket", "kind", "key"], s.address_posting_cap))
    tiers = phonetic_keys(refs).select(F.col("id").alias("ref_id"), "bucket", "kind", "key", "score").join(capped.select("bucket", "kind", "key", F.col("id").alias("cand_id")), ["bucket", "kind", "key"]).select("ref_id", "cand_id", "score")
    sparse = sparse_channel(refs, cands, k, 2, s.phonetic_max_df, s.phonetic_query_terms, s.max_posting_scan, small_pool).select("ref_id", "cand_id", "score")
    best = tiers.unionByName(sparse).groupBy("ref_id", "cand_id").agg(F.max("score").alias("score"))
    return top(best, ["ref_id"], [F.desc("score"), F.col("cand_id")], k).select("ref_id", "cand_id", "score", "rank")


def extra_channels(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, query_terms: int = 25, scan: int = 50_000) -> DataFrame:
    """Lists of three further sparse channels: words of the address, its character 3- to 5-grams, and phonetic codes of the name (column codes)."""
    terms = {"addr_word": text.word_terms(text.filled(F.col("addr_norm"))), "addr_char": text.char_terms(text.filled(F.col("addr_norm")), 3, 5), "name_codes": F.col("codes")}
    return union_channels(**{name: sparse_channel(refs.withColumn("terms", t), cands.withColumn("terms", t), k, query_terms=query_terms, scan=scan) for name, t in terms.items()})


def union_channels(**channels: DataFrame) -> DataFrame:
    """(ref_id, channel, cand_id, score, rank) of several channels."""
    parts = [df.select("ref_id", F.lit(name).alias("channel"), "cand_id", F.col("score").cast("double").alias("score"), "rank") for name, df in channels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
