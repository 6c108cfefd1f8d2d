"""Records, truth and vectors over the test tables, for Spark and as SQL.

The tables hold no business records, so a document stands for one: its source follows from its id, its name is its
first four words and its address the next eight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, src, doc_id, seq, bucket, text, toks, name_core, addr_norm, addr_postal, addr_house_number)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("bucket"))
    toks = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    src = 1 + F.col("doc_id") % 3
    first = lambda p: F.coalesce(F.get(F.filter("toks", lambda t: (t >= "0") & (t < ":") & t.rlike(p)), 0), F.lit(""))  # noqa: E731  few tokens begin with a digit
    df = docs.withColumns({"src": src, "toks": toks}).withColumn("entity_id", F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("doc_id")))
    return df.select(
        "entity_id", "src", "doc_id", (F.col("src") * F.lit(10**12) + F.col("doc_id")).alias("seq"), "bucket", "text", "toks", F.array_join(F.slice("toks", 1, 4), " ").alias("name_core"),
        F.array_join(F.slice("toks", 5, 8), " ").alias("addr_norm"), first("^[0-9]{4,}$").alias("addr_postal"), first("^[0-9]{1,3}$").alias("addr_house_number"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rec = records(spark, sf_dir).withColumnRenamed("entity_id", "id")
    return rec.where("src = 1"), rec.where("src > 1")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("bucket"))
    return docs.where("doc_id % 3 = 0").select(F.concat(F.lit("S1-"), F.col("doc_id")).alias("ref_id"), "doc_id", "bucket")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources 1 and 2 or 3 with equal texts in the same bucket; lengths and SHA-256 digests travel for the texts."""
    rec = records(spark, sf_dir).select("entity_id", "src", "bucket", F.octet_length("text").alias("size"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    a = rec.where("src = 1").select(F.col("entity_id").alias("ref_id"), "bucket", "size", "digest")
    b = rec.where("src > 1").select(F.col("entity_id").alias("cand_id"), "bucket", "size", "digest")
    return a.join(b, ["bucket", "size", "digest"]).select("ref_id", "cand_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("V-"), F.col("vec_id")).alias("id"), F.col("label").cast("string").alias("bucket"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("v"), "vec_id")
    return v.where("vec_id % 3 = 0"), v.where("vec_id % 3 != 0")


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("terms", text.word_terms(F.col("text")))


REC = r"""rec AS (
  SELECT 'S' || src || '-' || doc_id AS entity_id, src, doc_id, src * 1000000000000 + doc_id AS seq, bucket, text, toks,
    array_to_string(toks[1:4], ' ') AS name_core, array_to_string(toks[5:12], ' ') AS addr_norm,
    coalesce(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]{4,}'))[1], '') AS addr_postal,
    coalesce(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]{1,3}'))[1], '') AS addr_house_number
  FROM (SELECT doc_id, text, lang AS bucket, 1 + doc_id % 3 AS src, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents)
)"""
REFS = "refs AS (SELECT 'S1-' || doc_id AS ref_id, doc_id, lang AS bucket FROM documents WHERE doc_id % 3 = 0)"
GT = "gt AS (SELECT a.entity_id AS ref_id, b.entity_id AS cand_id FROM rec a JOIN rec b ON a.bucket = b.bucket AND a.text = b.text WHERE a.src = 1 AND b.src > 1)"


def sparse_sql(name: str, terms: str, query_terms: int = 12, min_df: int = 2, max_df: float = 0.05, scan: int = 10_000, small_pool: int = 0) -> str:
    """CTEs of the sparse channel over terms(entity_id, src, seq, bucket, term), a row for each occurrence."""
    return f"""{name}_held AS (SELECT DISTINCT entity_id, bucket, seq, term FROM {terms} WHERE src > 1),
{name}_n AS (SELECT bucket, count(*) AS n FROM rec WHERE src > 1 GROUP BY bucket),
{name}_voc AS (SELECT h.bucket, term, count(*) AS df, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM {name}_held h JOIN {name}_n USING (bucket) GROUP BY h.bucket, term, n HAVING n < {small_pool} OR count(*) >= {min_df} AND count(*) <= {max_df} * n),
{name}_tf AS (SELECT entity_id, bucket, term, count(*) AS tf FROM {terms} WHERE src = 1 GROUP BY ALL),
{name}_w AS (SELECT entity_id AS ref_id, bucket, term, df, (1 + ln(tf)) * idf AS w FROM {name}_tf JOIN {name}_voc USING (bucket, term)),
{name}_rare AS (SELECT * FROM (SELECT ref_id, bucket, term, w / sqrt(sum(w * w) OVER (PARTITION BY ref_id)) AS w, row_number() OVER (PARTITION BY ref_id ORDER BY df, term) AS place FROM {name}_w) WHERE place <= {query_terms}),
{name}_post AS (SELECT * FROM (SELECT entity_id AS cand_id, bucket, term, seq, row_number() OVER (PARTITION BY bucket, term ORDER BY seq) AS place FROM {name}_held SEMI JOIN {name}_voc USING (bucket, term)) WHERE place <= {scan}),
{name}_sum AS (SELECT ref_id, cand_id, seq, round(sum(w), 9) AS score FROM {name}_rare r JOIN {name}_post p USING (bucket, term) GROUP BY ALL),
{name} AS (SELECT ref_id, cand_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, seq) AS rank FROM {name}_sum WHERE score > 0) WHERE rank <= 50)"""


WORD = r"word_terms AS (SELECT entity_id, src, seq, bucket, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM rec)," + sparse_sql("word", "word_terms")
CHAR = """char_words AS (SELECT entity_id, src, seq, bucket, ' ' || unnest(string_split(trim(name_core || ' ' || addr_norm), ' ')) || ' ' AS p FROM rec),
char_terms AS (SELECT entity_id, src, seq, bucket, substr(p, i, n) AS term FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM char_words, (VALUES (2), (3), (4)) g(n) WHERE len(p) >= n AND p <> '  ')),""" + sparse_sql("chars", "char_terms")
EXACT = """exact_keys AS (
  SELECT entity_id, src, seq, bucket, 3 AS tier, name_core || '|' || addr_postal AS key FROM rec WHERE name_core <> '' AND addr_postal <> ''
  UNION ALL SELECT entity_id, src, seq, bucket, 2, name_core || '|' || addr_house_number FROM rec WHERE name_core <> '' AND addr_house_number <> ''
  UNION ALL SELECT entity_id, src, seq, bucket, 1, name_core FROM rec WHERE name_core <> ''
),
exact_index AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, tier, key ORDER BY seq) AS place FROM exact_keys WHERE src > 1) WHERE place <= 2000),
exact_met AS (SELECT r.entity_id AS ref_id, c.entity_id AS cand_id, c.seq, r.tier, max(r.tier) OVER (PARTITION BY r.entity_id) AS best FROM exact_keys r JOIN exact_index c USING (bucket, tier, key) WHERE r.src = 1),
exact AS (SELECT ref_id, cand_id, tier::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY seq) AS rank FROM exact_met WHERE tier = best) WHERE rank <= 50)"""
LISTS = "lists AS (SELECT ref_id, 'exact' AS channel, cand_id, score, rank FROM exact UNION ALL SELECT ref_id, 'word', cand_id, score, rank FROM word UNION ALL SELECT ref_id, 'char', cand_id, score, rank FROM chars)"
PROBS = """probs AS (
  SELECT ref_id, cand_id, floor(len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS prob
  FROM (SELECT DISTINCT ref_id, cand_id FROM lists) p JOIN rec a ON a.entity_id = p.ref_id JOIN rec b ON b.entity_id = p.cand_id
)"""
CHANNELS = ",\n".join((REC, EXACT, WORD, CHAR, LISTS))
SCORED = ",\n".join((CHANNELS, PROBS, REFS, GT))
