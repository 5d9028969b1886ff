"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors are
    threads of the driver (tests) gets a temporary one; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='docsieve-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docsieve-{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder; results read from them must be saved before."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_written: ContextVar[list[tuple[str, bool]] | None] = ContextVar("written", default=None)


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """Collects the paths of all tables that are written and kept inside, to be removed once they are not needed."""
    paths: list[str] = []
    token = _written.set(found := [])
    try:
        yield paths
    finally:
        _written.reset(token)
        paths += [p for p, _ in found]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those with ``keep``."""
    token = _written.set(found := [])
    try:
        yield
    finally:
        _written.reset(token)
        remove_tables(spark, [p for p, keep in found if not keep])
        outer = _written.get()
        if outer is not None:
            outer += [(p, False) for p, keep in found if keep]


def persist_table(df: DataFrame, name: str, partition_by: str | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends in files every executor sees. The shuffle
    files of the write are given back at once, not when the driver next collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    found = _written.get()
    if found is not None:
        found.append((path, keep))
    schema = df.schema
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the byte-wise lower(); other text is translated letter by letter."""
    return F.when(F.length(column) == F.octet_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus
