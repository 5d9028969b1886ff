"""Batches of rows that are added whole or not at all: a data source writer that stages files and renames once.

Tasks write Parquet files into a staging folder that readers do not see (its name begins with ``_``). Only when all tasks
are done, and only with the files that they report, the folder becomes ``batch=<id>`` by one rename; if any fails, it is
deleted. A batch that is there already is not added again, so a retry is harmless."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from docsieve.sources.scratch import file_system


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, required: list[str]):
        self.path, self.batch, self.required = path, batch, required
        self.run = uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        store, root = file_system(self.path)
        return store, f"{root}/_staging-{self.batch}-{self.run}", f"{root}/batch={self.batch}"

    def begin(self) -> None:
        """Makes the staging folder, on the driver: a task that outlives the end of its job finds none and can leave nothing."""
        store, staging, _ = self._places()
        store.create_dir(staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, staging, _ = self._places()
        name, writer, rows = f"part-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                for column in self.required:
                    if batch.column(column).null_count:
                        raise ValueError(f"column {column} has no value in a row of batch {self.batch}")
                writer = writer or pq.ParquetWriter(f"{staging}/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Staged(name if writer is not None else "", rows)

    def commit(self, messages: list[Staged | None]) -> None:
        store, staging, final = self._places()
        if store.get_file_info(final).type != fs.FileType.NotFound:
            store.delete_dir(staging)  # another run of the batch was first
            return
        kept = {m.file for m in messages if m is not None and m.file}
        for f in store.get_file_info(fs.FileSelector(staging)):  # what tasks wrote that were run twice
            if f.base_name not in kept:
                store.delete_file(f.path)
        store.move(staging, final)

    def abort(self, messages: list[Staged | None]) -> None:
        store, staging, _ = self._places()
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class BatchInsert(DataSource):
    """``df.write.format("batch_insert").option("path", …).option("batch", id).option("required", "a,b").mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "batch_insert"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("batches are only added")
        batch = self.options.get("batch", "")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"{batch!r} is no name of a batch")
        out = _Writer(self.options["path"], batch, [c for c in self.options.get("required", "").split(",") if c])
        out.begin()
        return out


def batches_there(path: str) -> list[str]:
    store, root = file_system(path)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name.removeprefix("batch=") for f in found if f.base_name.startswith("batch="))


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows that are there; none if nothing was added yet."""
    if not batches_there(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def insert_batch(rows: DataFrame, path: str, batch: str, key: list[str], required: Sequence[str] = ()) -> bool:
    """Adds the rows as one batch; False if the batch is there already. A row without a key or
    without a value in a ``required`` column, a key that repeats in the batch or one that is there already refuses the whole batch. The check is a count by key, so no task holds more than sums."""
    spark = rows.sparkSession
    if batch in batches_there(path):
        return False
    there = read_batches(spark, path, rows.schema).select(*key, F.lit(1).alias("_old"))
    seen = rows.select(*key, F.lit(0).alias("_old")).unionByName(there).dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_old").alias("_old"))
    bad = seen.filter("_n > 1 and _old = 0").limit(1).collect()
    if bad:
        raise ValueError(f"key {tuple(bad[0][k] for k in key)} is there already or twice in batch {batch}")
    spark.dataSource.register(BatchInsert)
    rows.write.format("batch_insert").option("path", path).option("batch", batch).option("required", ",".join([*key, *required])).mode("append").save()
    return True
