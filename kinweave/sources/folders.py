"""Shared folders, and tables that are written once and read back by later queries of the session."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, folder: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with the scheme of the file system that it is on."""
    path = _path(spark, folder)
    full = _files(spark, path).makeQualified(path).toString().rstrip("/")
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with its scheme; a folder of our own where none is named, which only a local session may have."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        base = _own[app]
    return qualified(spark, base)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/kinweave-{name}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    _files(spark, path).mkdirs(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = _path(spark, folder)
    _files(spark, path).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = _path(spark, folder)
    return _files(spark, path).exists(path)


def state_of(spark: SparkSession, paths: Iterable[str]) -> tuple[tuple[str, int, int], ...]:
    """Names, sizes and times of the files in folders, and of files themselves."""
    out = []
    for p in paths:
        path = _path(spark, p)
        if exists(spark, p):
            for s in _files(spark, path).listStatus(path):
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return tuple(sorted(out))


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it has run; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_kept: list[str] = []


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, a table of rows of MBs, written to a new shared folder and read back; compressed, which a checkpoint isn't.

    A row is a row group, so that readers can take rows as they need them. What a stored table is made from goes when that
    is written, the rest stays for the session.
    """
    folder = new_folder(df.sparkSession, name)
    _kept.append(folder)
    by_row = {"parquet.block.size": "65536", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    with cleared(df.sparkSession):
        df.write.options(**by_row).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, a table of many rows that a stored table is made from, written to a new shared folder and read back; compressed, and gone when kept()'s are."""
    folder = new_folder(df.sparkSession, name)
    _kept.append(folder)
    with cleared(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def files_by(df: DataFrame, column: str) -> dict[str, list[str]]:
    """The files of a table that hold each value of a column."""
    out: dict[str, list[str]] = {}
    for value, file in df.select(column, F.input_file_name()).distinct().collect():
        out.setdefault(value, []).append(unquote(file))
    return {value: sorted(files) for value, files in out.items()}


def rows_of(files: Iterable[str], columns: list[str], where: tuple[str, str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of kept files, one at a time, for a task that reads the shared folder itself; with `where`, those of that column and value."""
    for file in files:
        store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub("^file:/+", "file:///", file)))
        with store.open_input_file(path) as f:
            held = pq.ParquetFile(f)
            for g in range(held.num_row_groups):
                names = held.read_row_group(g, [where[0]])[where[0]].to_pylist() if where else None
                if names and where[1] not in names:
                    continue
                for i, batch in enumerate(held.iter_batches(1, [g], columns)):
                    if not names or names[i] == where[1]:
                        yield batch.select(columns)


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, inputs: Iterable[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives, written to the shared folder once for each session and state of the input files, and read back."""
    inputs = tuple(inputs)
    key = (spark.sparkContext.applicationId, name, inputs, state_of(spark, inputs))
    if key not in _stored or not exists(spark, _stored[key]):
        folder, before = new_folder(spark, name), len(_kept)
        with cleared(spark):
            build().write.parquet(folder)
        _stored[key] = folder
        for made in _kept[before:]:
            remove_folder(spark, made)
        del _kept[before:]
    return spark.read.parquet(_stored[key])
