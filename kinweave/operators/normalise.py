"""Raw records to normalised ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import address, arrow, text
from kinweave.operators.common import bound


def normalise(raw: DataFrame, address_script: bool = False) -> DataFrame:
    """(entity_id, business_name, business_address, country) to the 24 columns of a normalised record.

    Nulls count as empty strings, which stand for missing values throughout. An address loses its accents if the name is
    in Latin letters; with address_script, if the address itself is, so that a name without letters doesn't decide.
    """
    c = F.col
    df = raw.select(
        text.filled(c("entity_id")).alias("entity_id"), text.source_of(text.filled(c("entity_id"))).alias("source"), text.filled(c("country")).alias("country_raw"),
        text.country(c("country")).alias("country_norm"), text.filled(c("business_name")).alias("name_raw"), text.filled(c("business_address")).alias("addr_raw"),
    )
    df = df.withColumn("name_nfkc", arrow.nfkc(c("name_raw"))).withColumn("script_type", text.script(c("name_nfkc")))
    df = df.withColumn("name_clean", arrow.clean_text(c("name_nfkc"), c("script_type")))
    df = df.withColumn("addr_clean", arrow.clean_text(c("addr_raw"), text.script(arrow.nfkc(c("addr_raw"))) if address_script else c("script_type")))
    df = bound(df, name_tokens=text.expand(text.tokens(F.lower(text.punctuation(c("name_clean")))), c("country_norm")), addr_tokens=text.tokens(F.lower(text.punctuation(c("addr_clean")))))
    df = df.withColumn("name_phonetic", F.when(c("script_type") == "latin", arrow.metaphones(c("name_tokens"))).otherwise(F.array().cast("array<string>")))
    df = bound(df, name_legal_suffix=text.legal_suffix(c("name_tokens"), c("country_norm")), addr_norm=F.array_join("addr_tokens", " ")).withColumn("place", address.place(c("addr_tokens"), c("country_norm")))
    df = bound(df, core=text.without_stopwords(text.without_suffix(c("name_tokens"), c("name_legal_suffix"))), addr_postal=address.postal(c("addr_norm"), c("country_norm")), addr_state=c("place.state"))
    df = bound(df, addr_city=F.when(c("place.city") == "", address.city_after_postal(c("addr_tokens"), c("addr_postal"))).otherwise(c("place.city")))
    return df.select(
        "entity_id", "source", "country_raw", "country_norm", "name_raw", F.array_join("name_tokens", " ").alias("name_norm"), "name_tokens", "name_phonetic",
        "name_legal_suffix", F.array_join("core", " ").alias("name_core"), "addr_raw", "addr_norm", "addr_tokens", address.house_number(c("addr_tokens")).alias("addr_house_number"),
        "addr_postal", "addr_state", "addr_city", text.digit_runs(c("addr_raw")).alias("addr_digits"), "script_type",
        (F.trim("name_raw") == "").alias("is_missing_name"), (F.trim("addr_raw") == "").alias("is_missing_addr"), (c("addr_postal") == "").alias("is_missing_postal"),
        (c("addr_state") == "").alias("is_missing_state"), (c("addr_city") == "").alias("is_missing_city"),
    )
