"""Writers: id lists as TSV, tables as Parquet, reports as JSON and Markdown."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_lists(refs: DataFrame, pairs: DataFrame, out: str = "matched_entity_ids", by: str | None = None) -> DataFrame:
    """(source1_entity_id, comma-separated ids) with a row for every reference, empty if it has no ids.

    Ids are sorted, or in the order of the column `by`.
    """
    listed = F.array_sort(F.collect_set("cand_id")) if by is None else F.transform(F.array_sort(F.collect_list(F.struct(by, "cand_id"))), lambda x: x["cand_id"])
    lists = pairs.groupBy("ref_id").agg(F.array_join(listed, ",").alias(out))
    return refs.select("ref_id").join(lists, "ref_id", "left").select(F.col("ref_id").alias("source1_entity_id"), F.coalesce(out, F.lit("")).alias(out))


def write_id_lists(refs: DataFrame, pairs: DataFrame, path: str, out: str = "matched_entity_ids", by: str | None = None) -> None:
    """Tab-separated files with a header each; a missing list is an empty field."""
    id_lists(refs, pairs, out, by).orderBy("source1_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "snappy")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def artifact(root: str, stage: str, split: str, bucket: str | None = None) -> str:
    """Where a stage's table lies; a bucket is a partition, so that a filter on it prunes the others."""
    return f"{root}/{stage}/split={split}" + (f"/bucket={bucket}" if bucket else "")


def merge_report(path: str, key: str, run: dict[str, Any]) -> dict[str, Any]:
    """Put a run into a JSON report: earlier runs stay under `runs`, the newest one's values stand on top. Replaced at once."""
    old: dict[str, Any] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = json.load(f)
    runs = old.get("runs") or ({"earlier": old} if old else {})
    report = {**run, "runs": {**runs, key: run}}
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    os.replace(temporary, path)
    return report


def markdown(rows: list[dict[str, Any]], columns: list[str] | None = None) -> str:
    """Rows as a Markdown table."""
    names = columns or sorted({k for r in rows for k in r})
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [names, ["---"] * len(names), *[[cell(r.get(c)) for c in names] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
