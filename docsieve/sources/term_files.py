"""Term lists that people keep as CSV files: a data source of their cells, one partition a file."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from docsieve.operators import rule_tables
from docsieve.sources.scratch import file_system

# Encodings in the order in which they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")


@dataclass
class TermFile(InputPartition):
    path: str


def text_of_bytes(raw: bytes, name: str) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{name} is in none of the encodings {', '.join(ENCODINGS)}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[TermFile]:
        """All CSV files of the folder and the folders in it, or the one file; none is opened here."""
        store, path = file_system(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [TermFile(path)]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = (f.path for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File)
        return [TermFile(p) for p in sorted(found) if p.lower().endswith(".csv") and not p.rsplit("/", 1)[-1].startswith((".", "_"))]

    def read(self, partition: TermFile) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        name = partition.path.rsplit("/", 1)[-1]
        with store.open_input_stream(partition.path) as f:
            text = text_of_bytes(f.read(), name)
        for number, row in enumerate(csv.reader(io.StringIO(text, newline="")), 1):
            yield name, number, row


@dataclass
class Written(WriterCommitMessage):
    file: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, encoding: str, header: list[str]):
        self.path, self.encoding, self.header = path, encoding, header

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file with the header for each task that has rows; it appears under its name when it is complete."""
        store, folder = file_system(self.path)
        name, out = f"{uuid.uuid4().hex}.csv", io.StringIO(newline="")
        writer = csv.writer(out)
        writer.writerow(self.header)
        rows = 0
        for batch in iterator:
            column = batch.column("cells").to_pylist()
            writer.writerows(column)
            rows += len(column)
        if not rows:
            return Written("")
        store.create_dir(folder)
        with store.open_output_stream(f"{folder}/_{name}") as f:
            f.write(out.getvalue().encode(self.encoding))
        store.move(f"{folder}/_{name}", f"{folder}/{name}")
        return Written(name)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = file_system(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{folder}/{m.file}")


class TermCells(DataSource):
    """``spark.read.format("term_cells").load(path)``: sheet (the file's name), row_number (from 1), cells. Written, it takes
    rows of ``cells``, an ``encoding`` and a ``header`` (cells parted by tabs). Term lists are small: a task holds its file."""

    @classmethod
    def name(cls) -> str:
        return "term_cells"

    def schema(self) -> str:
        return "sheet string, row_number int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("term_cells needs a path")
        return _Reader(self.options["path"])


    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        encoding = self.options.get("encoding", ENCODINGS[0])
        if overwrite or encoding not in ENCODINGS or schema.names != ["cells"]:
            raise ValueError(f"term_cells appends rows of cells in one of {ENCODINGS}")
        return _Writer(self.options["path"], encoding, self.options.get("header", "").split("\t"))


def write_term_cells(rows: DataFrame, path: str, encoding: str, header: list[str]) -> None:
    """Rows of ``cells`` as CSV files below ``path``, each with the header."""
    rows.sparkSession.dataSource.register(TermCells)
    rows.write.format("term_cells").option("path", path).option("encoding", encoding).option("header", "\t".join(header)).mode("append").save()


def term_cells(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TermCells)
    return spark.read.format("term_cells").load(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of all term files below ``path``: standard, discouraged, language_scope, sheet, row_number, one for each
    standard term and scope. A scope that is not known stops the query with the file's name and the row."""
    return rule_tables.united(rule_tables.rules_of(term_cells(spark, path)))
