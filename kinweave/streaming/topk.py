"""The best k candidates of each reference, kept up to date as scored pairs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.common import top
from kinweave.sources.folders import exists, remove_folder


def merge(old: DataFrame | None, new: DataFrame, k: int) -> DataFrame:
    """The k best of both for each reference: a pair's best score counts, ties go to the smaller id."""
    rows = new.select("ref_id", "cand_id", "score")
    if old is not None:
        rows = rows.unionByName(old.select("ref_id", "cand_id", "score"))
    best = rows.groupBy("ref_id", "cand_id").agg(F.max("score").alias("score"))
    return top(best, ["ref_id"], [F.desc("score"), F.col("cand_id")], k)


class TopK:
    """A stream of (ref_id, cand_id, score) merged into a table of versions.

    References are dealt to `parts` by a hash. A batch reads and writes only the parts that its references are in, under
    its own version; a version's manifest tells where each part's newest rows lie. A batch that is run again overwrites
    its own version and starts from the one before, so results don't depend on failures; versions before that are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, k: int, parts: int = 64) -> None:
        self.spark, self.folder, self.k, self.parts = spark, folder.rstrip("/"), k, parts

    def _place(self, part: int, batch: int) -> str:
        return f"{self.folder}/rows/version={batch}/part={part}"

    def _manifest(self, batch: int) -> str:
        return f"{self.folder}/manifest/version={batch}"

    def places(self, batch: int) -> dict[int, int]:
        """The version that holds each part's rows."""
        if batch < 0:
            return {}
        return {r["part"]: r["version"] for r in self.spark.read.schema("part int, version long").parquet(self._manifest(batch)).collect()}  # at most `parts` rows

    def _read(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], "ref_id string, cand_id string, score double, rank int")
        return self.spark.read.parquet(*[self._place(p, v) for p, v in sorted(places.items())])

    def add(self, new: DataFrame, batch: int) -> None:
        before = self.places(batch - 1)
        own = F.pmod(F.xxhash64("ref_id"), F.lit(self.parts)).cast("int")
        rows = new.select("ref_id", "cand_id", "score").persist()
        try:
            touched = {r["part"] for r in rows.select(own.alias("part")).distinct().collect()}  # at most `parts` rows
            old = {p: v for p, v in before.items() if p in touched}
            if touched:
                merge(self._read(old) if old else None, rows, self.k).withColumn("part", own).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/version={batch}")
        finally:
            rows.unpersist()
        after = before | {p: batch for p in touched}
        self.spark.createDataFrame(sorted(after.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(self._manifest(batch))
        earlier = self.places(batch - 2) if batch > 1 and exists(self.spark, self._manifest(batch - 2)) else {}
        for part, version in earlier.items():
            if before.get(part) != version:
                remove_folder(self.spark, self._place(part, version))
        if earlier:
            remove_folder(self.spark, self._manifest(batch - 2))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

    def current(self, batch: int) -> DataFrame:
        return self._read(self.places(batch))
