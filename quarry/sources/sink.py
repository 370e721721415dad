"""A store of Parquet tables that change by commits: a Python data source whose writer stages files, and manifests that make them part of the store.

Under the store's path:
  data/<table>/<batch>-<try>/   files of one try to write a batch; nobody reads them for being there
  commits/<batch>.json          the files of a batch, by table, with their schemas: put in place by one move, after all files are written

A reader takes the files that manifests name. So a job that fails leaves nothing to be read (and its files are taken away), a batch that is written again under its
id changes nothing, and a batch over several tables is there in all of them or in none. The path is any that pyarrow's file systems know and that all executors share.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

FORMAT = "quarry_store"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


@dataclass
class Staged(WriterCommitMessage):
    """What a task wrote: no file where it had no rows."""

    file: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.table, self.attempt = options["path"], options["table"], options["try"]
        self.folder = f"data/{self.table}/{self.attempt}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        where, base = _at(self.path)
        file, n, out = f"{self.folder}/{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        where.create_dir(f"{base}/{self.folder}", recursive=True)
                        out = pq.ParquetWriter(f"{base}/{file}", batch.schema, filesystem=where, compression="zstd")
                    out.write_batch(batch)
                    n += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                where.delete_file(f"{base}/{file}")
            raise
        if out is not None:
            out.close()
        return Staged(file if n else None, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """Notes what was written beside the files; only a manifest makes it part of the store."""
        where, base = _at(self.path)
        where.create_dir(f"{base}/{self.folder}", recursive=True)
        with where.open_output_stream(f"{base}/{self.folder}/written.json") as out:
            out.write(json.dumps({"files": sorted(m.file for m in messages if m and m.file), "rows": sum(m.rows for m in messages if m)}).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        _remove(self.path, self.folder)


class StoreSource(DataSource):
    """Stages a DataFrame's rows as files of one try; see write()."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def _remove(path: str, folder: str) -> None:
    where, base = _at(path)
    if where.get_file_info(f"{base}/{folder}").type == fs.FileType.Directory:
        where.delete_dir(f"{base}/{folder}")


def _manifests(path: str) -> dict[str, dict]:
    where, base = _at(path)
    found = where.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    return {posixpath.basename(f.path)[:-5]: json.loads(where.open_input_stream(f.path).read()) for f in found if f.path.endswith(".json")}


def committed(path: str, batch: str) -> bool:
    where, base = _at(path)
    return where.get_file_info(f"{base}/commits/{batch}.json").type == fs.FileType.File


def write(path: str, batch: str, tables: dict[str, DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]]) -> bool:
    """Adds rows to tables under a batch id, all or nothing; False where the batch is there already. The id names a file.

    What follows from rows of the batch is a function instead: it is given a reader of the tables before it, as this try staged them, so that they are neither worked out twice nor kept elsewhere.
    """
    if committed(path, batch):
        return False
    attempt = f"{batch}-{uuid.uuid4().hex}"
    manifest: dict[str, dict] = {}
    spark = next(df.sparkSession for df in tables.values() if isinstance(df, DataFrame))
    staged = lambda name: _rows(spark, path, manifest[name]["files"], T.StructType.fromJson(manifest[name]["schema"]))
    try:
        for name, rows in tables.items():
            df = rows if isinstance(rows, DataFrame) else rows(staged)
            df.sparkSession.dataSource.register(StoreSource)
            df.write.format(FORMAT).mode("append").options(path=path, table=name, **{"try": attempt}).save()
            where, base = _at(path)
            manifest[name] = json.loads(where.open_input_stream(f"{base}/data/{name}/{attempt}/written.json").read()) | {"schema": df.schema.jsonValue()}
        where, base = _at(path)
        where.create_dir(f"{base}/commits", recursive=True)
        held = f"{base}/commits/.{attempt}"
        with where.open_output_stream(held) as out:
            out.write(json.dumps(manifest).encode())
        if committed(path, batch):  # another try of the same batch came first
            where.delete_file(held)
            raise _Late
        where.move(held, f"{base}/commits/{batch}.json")
    except _Late:
        for name in tables:
            _remove(path, f"data/{name}/{attempt}")
        return False
    except BaseException:
        for name in tables:
            _remove(path, f"data/{name}/{attempt}")
        raise
    return True


class _Late(Exception):
    pass


def _rows(spark: SparkSession, path: str, files: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mergeSchema", "false").parquet(*(f"{path}/{f}" for f in files)) if files else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, table: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The rows of all committed batches, with the column `_batch`; schema is for a table that has none yet."""
    held = {b: m[table] for b, m in _manifests(path).items() if table in m}
    parts = [(b, m) for b, m in sorted(held.items()) if m["files"]]
    if not parts:
        known = T.StructType.fromJson(next(iter(held.values()))["schema"]) if held else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if known is None:
            raise ValueError(f"no batch was committed to {table}")
        return spark.createDataFrame([], known).withColumn("_batch", F.lit(""))
    rows = _rows(spark, path, [f for _, m in parts for f in m["files"]], T.StructType.fromJson(parts[0][1]["schema"]))
    return rows.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), f"/data/{table}/(.*)-[0-9a-f]{{32}}/", 1))


def count(path: str, table: str) -> int:
    """Rows of all committed batches, as manifests say."""
    return sum(m[table]["rows"] for m in _manifests(path).values() if table in m)


def stream(rows: DataFrame, path: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]], name: str = "stream") -> StreamingQuery:
    """Each micro-batch of a stream is a batch of the store, so that a batch which is run again after a crash is there once."""

    def one(df: DataFrame, batch_id: int) -> None:
        write(path, f"{name}.{batch_id}", tables(df))

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
