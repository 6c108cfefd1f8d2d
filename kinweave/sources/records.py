"""Tables of raw and normalised records, and the id lists that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinweave.functions import text

RAW = StructType([StructField(c, StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = StructType([StructField(c, StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


class InputError(ValueError):
    """An input that breaks its format."""


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A tab-separated file with exactly the schema's header; every field is text, empty fields are empty strings."""
    head = spark.read.text(path).first()
    if head is None or head[0].split("\t") != schema.fieldNames():
        raise InputError(f"{path}: the header isn't {schema.fieldNames()}")
    df = spark.read.csv(path, sep="\t", schema=schema, header=True, quote="", escape="", nullValue="\x00", emptyValue="", enforceSchema=True)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in schema.fieldNames()])


def read_source(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Source `number` of raw records; all its ids begin with S<number>-."""
    df = read_tsv(spark, path, RAW)
    if not df.where(~F.col("entity_id").startswith(f"S{number}-")).isEmpty():
        raise InputError(f"{path}: ids without the prefix S{number}-")
    return df


def id_pairs(lists: DataFrame, ref: str, ids: str) -> DataFrame:
    """(ref_id, cand_id) of comma-separated lists; blanks are dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(ids), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select(F.col(ref).alias("ref_id"), F.explode(parts).alias("cand_id"))


def read_truth(spark: SparkSession, path: str, references: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(refs, pairs): all references of the file, with those that match nothing, and the true pairs.

    Every reference must be in references (entity_id); scope (ref_id) keeps only its own.
    """
    lists = read_tsv(spark, path, TRUTH)
    if not lists.join(references.select("entity_id"), F.col("source1_entity_id") == F.col("entity_id"), "left_anti").isEmpty():
        raise InputError(f"{path}: references that source 1 doesn't have")
    if scope is not None:
        lists = lists.join(scope.select(F.col("ref_id").alias("source1_entity_id")).distinct(), "source1_entity_id", "left_semi")
    return lists.select(F.col("source1_entity_id").alias("ref_id")), id_pairs(lists, "source1_entity_id", "matched_entity_ids").distinct()


def read_candidates(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(refs, pairs with a 1-based rank) of a candidate or match list; the header may be missing unless strict."""
    names = ["source1_entity_id", "candidate_entity_ids"]
    head = spark.read.text(path).first()
    first = head[0].split("\t")[0] if head else ""
    if strict and (head is None or first != names[0]):
        raise InputError(f"{path}: no header")
    schema = StructType([StructField(c, StringType()) for c in names])
    df = spark.read.csv(path, sep="\t", schema=schema, header=first == names[0], quote="", escape="", enforceSchema=True)
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(names[1]), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pairs = df.select(F.col(names[0]).alias("ref_id"), F.posexplode(parts).alias("rank", "cand_id"))
    return df.select(F.col(names[0]).alias("ref_id")), pairs.withColumn("rank", F.col("rank") + 1)


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """A table's first row of each key, in the order of its files and of their rows."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    row = F.struct(*df.columns)
    return df.select(row.alias("row"), place.alias("place")).groupBy(F.col(f"row.{key}").alias("key")).agg(F.min_by("row", "place").alias("row")).select("row.*")


def scan_bucket(spark: SparkSession, path: str, bucket: str, columns: list[str], ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Normalised records of one bucket, the first row of each id; the filter and the columns reach the Parquet scan.

    ids (entity_id) keeps only those; most keeps so many, the smallest ids.
    """
    from kinweave.functions.lists import COUNTRY

    names = sorted({k for k, v in COUNTRY.items() if v == bucket} | {bucket})
    rows = first_rows(spark.read.parquet(path).where(F.col("country_norm").isin(*names)).select(*dict.fromkeys(["entity_id", *columns])), "entity_id").select(*columns)
    if ids is not None:
        rows = lookup(rows, ids)
    return rows if most is None else rows.orderBy("entity_id").limit(most)


def reference_ids(records: DataFrame) -> DataFrame:
    """(ref_id): the distinct ids of source 1."""
    return records.where(F.col("entity_id").startswith("S1-")).select(F.col("entity_id").alias("ref_id")).distinct()


def reference_metadata(records: DataFrame, refs: DataFrame) -> DataFrame:
    """The columns that diagnostics group by, of the references (ref_id)."""
    columns = ("entity_id", "country_norm", "name_norm", "name_core", "addr_norm", "script_type", "is_missing_addr")
    return lookup(records.select(*columns), refs.select(F.col("ref_id").alias("entity_id")))


def count_rows(spark: SparkSession, *paths: str) -> int:
    """Rows of Parquet tables; no column is read, so the counts come from the files' footers."""
    return sum(spark.read.parquet(p).count() for p in paths)


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose entity_id is in ids."""
    return records.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def references_and_candidates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source 1, and sources 2 and 3, each with its bucket and seq: source, then id."""
    rows = records.withColumn("bucket", text.bucket(F.col("country_norm"))).withColumnRenamed("entity_id", "id")
    rows = rows.withColumn("seq", F.struct("source", "id"))
    return rows.where("source = 'S1'"), rows.where("source in ('S2', 'S3')")
