"""Readers of the Parquet tables of a data folder, and the views of them that the operators expect."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen as tasks: the customer owns them, the priority is their type."""
    o = read(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    return o.select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("owner"), status.alias("status"), F.col("o_orderpriority").alias("task_type"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items seen as report items of a task (the flag is the type, the line status the acceptance)."""
    li = read(spark, folder, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "issue").when(F.col("l_returnflag") == "A", "suggestion").otherwise("non_issue")
    return li.select(
        F.col("l_orderkey").alias("task_id"),
        F.concat(F.lit("check_"), (F.col("l_suppkey") % 5).cast("string")).alias("code"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).cast("long").alias("idx"),
        kind.alias("type"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("location"),
        F.when(F.col("l_tax") < 0.02, "high").when(F.col("l_tax") < 0.05, "medium").when(F.col("l_tax") < 0.07, "low").otherwise("").alias("severity"),
        F.when(F.col("l_discount") < 0.03, "high").when(F.col("l_discount") < 0.06, "medium").otherwise("low").alias("confidence"),
        F.concat(F.lit("cat"), (F.col("l_suppkey") % 3).cast("string")).alias("category"),
        F.lit("").alias("excerpt"),
        F.concat(F.lit("d"), (F.col("l_linenumber") % 2).cast("string")).alias("description"),
        F.lit("").alias("impact"),
        F.lit("").alias("suggestion"),
        F.when(F.col("l_linestatus") == "F", "accepted").otherwise("rejected").alias("acceptance"),
    )


@F.pandas_udf(T.StringType())
def _chinese(contents: pd.Series) -> pd.Series:
    def read_one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else bytes(raw).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return pd.Series([read_one(c) for c in contents], dtype=object)


def decoded(content: Column, keep_mark: bool = True) -> Column:
    """The text of a file's bytes: UTF-8, else GB18030, else null. The byte order mark stays, unless told otherwise (term
    tables drop it). Python sees only what is no UTF-8."""
    plain = F.try_validate_utf8(content.cast("string"))
    text = F.coalesce(plain, _chinese(F.when(plain.isNull(), content)))
    return text if keep_mark else F.regexp_replace(text, "^\\x{feff}", "")
