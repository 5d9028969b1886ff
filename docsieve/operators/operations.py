"""Operational analytics over a task table: overview, trends, queue, leases, retention, cached totals, upserts.

A task table has task_id, owner, status, task_type, created_at and what each operator names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.ordered import numbered

STATUSES = ("queued", "running", "completed", "failed", "canceled")


def effective_owner(owner: Column, ip: Column) -> Column:
    """The signed-in owner, or the address."""
    return F.coalesce(owner, F.concat(F.lit("ip:"), ip))


def in_days(ts: Column, first: Column, last: Column) -> Column:
    """From the start of one day to the end of the other, in either order."""
    low, high = F.least(first, last), F.greatest(first, last)
    return (ts >= low) & (ts < F.date_add(high, 1))


def overview(tasks: DataFrame, types: list[str], statuses: list[str]) -> DataFrame:
    """One row: tasks, owners, tasks by type and by status."""
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("owner").alias("users"),
        *[F.count_if(F.col("task_type") == t).alias(f"type_{k}") for k, t in enumerate(types)],
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in statuses],
    )


def daily_trend(tasks: DataFrame, statuses: list[str], days: int = 30) -> DataFrame:
    """The newest days with tasks, newest first."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    return tasks.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("owner").alias("users"), *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in statuses]).orderBy(F.desc("day")).limit(days)


def top_owners(tasks: DataFrame, n: int = 10) -> DataFrame:
    """Owners by tasks, then latest task, then name."""
    return tasks.groupBy("owner").agg(F.count(F.lit(1)).alias("total"), F.max("created_at").alias("last_at")).orderBy(F.desc("total"), F.desc("last_at"), F.asc("owner")).limit(n)


def status_histogram(tasks: DataFrame, statuses: list[str], by: list[str]) -> DataFrame:
    """Zero-filled counts by status; a status that is not listed counts in the total only."""
    return tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in statuses])


def known_owners(tasks: DataFrame, named: DataFrame) -> DataFrame:
    """All owners that have a task or a name, with name, tasks and latest task."""
    owners = tasks.select("owner").union(named.select("owner")).distinct()
    per = tasks.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_at"))
    return owners.join(named, "owner", "left").join(per, "owner", "left").select("owner", "name", F.coalesce("n", F.lit(0)).alias("tasks"), "last_at")


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered list; the page is brought into range first."""
    total = rows.count()
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset((min(max(1, page), last) - 1) * size).limit(size)


def rule_version(rules: DataFrame, by: str, id_col: str, updated: str) -> DataFrame:
    """``count:sum of ids:latest change`` of each group."""
    return rules.groupBy(by).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(id_col).cast("string"), F.max(updated).cast("string")).alias("version"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_anti")


def without_twins(rows: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Rows with the flag go where a row of the same key has none."""
    plain = rows.filter(~F.col(flag)).select(*key).distinct()
    return rows.filter(~F.col(flag)).unionByName(rows.filter(flag).join(plain, key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_filled: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones by key (null keys are equal); ``keep_filled`` columns keep an old text that is not empty. Of
    new rows with one key the last by ``order`` counts (ties, or no order: the largest row)."""
    row = F.struct(*old.columns)
    last = F.max_by(row, F.struct(*order, row.alias("_row"))).alias("_new")
    n = new.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(last).withColumn("_here", F.lit(True))
    joined = old.join(n, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "full")
    out = []
    for c in old.columns:
        value = F.when(F.col("_here"), F.col("_new")[c]).otherwise(F.col(c))
        if c in keep_filled:
            value = F.when(F.col("_here"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_new")[c])).otherwise(F.col(c))
        out.append(value.alias(c))
    return joined.select(*out)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, one per key."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def claims(tasks: DataFrame, user_limit: int, global_limit: int, look_ahead: int = 50) -> DataFrame:
    """Queued tasks to start now: of the oldest ``look_ahead`` queued ones, first come first served, within what running
    tasks leave of each owner's and the global limit. Only counts of running tasks and those few rows are gathered."""
    running = tasks.filter("status = 'running'")
    busy = running.groupBy("owner").agg(F.count(F.lit(1)).alias("busy"))
    total = running.agg(F.count(F.lit(1)).alias("all_busy"))
    queue = tasks.filter("status = 'queued'").orderBy("created_at", "task_id").limit(look_ahead)
    mine = Window.partitionBy("owner").orderBy("created_at", "task_id")
    fair = queue.join(busy, "owner", "left").withColumn("nth", F.row_number().over(mine)).filter(F.col("nth") + F.coalesce("busy", F.lit(0)) <= user_limit)
    # One row on one side, ``look_ahead`` rows on the other.
    place = F.row_number().over(Window.orderBy("created_at", "task_id"))
    return fair.withColumn("place", place).join(F.broadcast(total), F.col("place") <= global_limit - F.col("all_busy")).select("task_id", "owner", "place")


def recover_leases(tasks: DataFrame, now: Column) -> DataFrame:
    """Running tasks whose lease has passed are queued again, without claim and progress."""
    gone = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    return (
        tasks.withColumn("_gone", F.coalesce(gone, F.lit(False)))
        .withColumn("status", F.when(F.col("_gone"), "queued").otherwise(F.col("status")))
        .withColumn("claim_token", F.when(~F.col("_gone"), F.col("claim_token")))
        .withColumn("lease_expires_at", F.when(~F.col("_gone"), F.col("lease_expires_at")))
        .withColumn("progress", F.when(F.col("_gone"), 0).otherwise(F.col("progress")))
        .drop("_gone")
    )


def expired(tasks: DataFrame, now: Column, days: int, limit: int = 100) -> DataFrame:
    """Finished tasks whose files have outlived their time, oldest first."""
    ended = F.coalesce("finished_at", "updated_at", "created_at")
    due = tasks.filter(F.col("status").isin("completed", "failed", "canceled") & F.col("cleaned_at").isNull()).withColumn("ended_at", ended)
    return due.filter(F.col("ended_at") < now - F.make_dt_interval(F.lit(days))).orderBy("ended_at", "task_id").limit(limit)


def refresh_stats(tasks: DataFrame, stats: DataFrame, compute) -> DataFrame:
    """Cached per-task aggregates: rows whose task and rule set have not changed stay, the others are computed anew.

    ``stats`` has task_id, source_updated_at, rule_version and values; ``compute(tasks)`` gives such rows."""
    fresh = tasks.select("task_id", F.col("updated_at").alias("source_updated_at"), "rule_version")
    valid = stats.join(fresh, ["task_id", "source_updated_at", "rule_version"], "left_semi")
    stale = tasks.join(valid.select("task_id"), "task_id", "left_anti")
    return valid.unionByName(compute(stale))


def submit_once(requests: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of requests with one token, the first; requests without a token all count and are not sorted."""
    first = Window.partitionBy(*key).orderBy(*order)
    missing = F.col(key[-1]).isNull() | (F.col(key[-1]) == "")
    named = requests.filter(~missing).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return requests.filter(missing).unionByName(named)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """Batches of ``size`` rows of each group, in an order that tells the rows of a group apart."""
    return numbered(rows, by, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size).cast("long")).select(*rows.columns, "batch")


def missing_codes(asked: DataFrame, answered: DataFrame, by: list[str]) -> DataFrame:
    """What was asked and not answered, to be asked once more."""
    return asked.select(*by).distinct().join(answered.select(*by).distinct(), by, "left_anti")


def reorder(rows: DataFrame, wanted: list[int], id_col: str, order_col: str) -> DataFrame:
    """Named ids first in the given order (of an id named twice the first place counts), the rest as before, numbered by tens."""
    place = F.array_position(F.array(*[F.lit(i) for i in wanted]).cast("array<bigint>"), F.col(id_col).cast("bigint")) if wanted else F.lit(0)
    placed = rows.withColumns({"_first": F.when(place > 0, place).otherwise(F.lit(1 << 60)), "_old": F.col(order_col)})
    done = numbered(placed, [], ["_first", "_old", id_col], "_n")
    return done.select(*[(F.col("_n") * 10).alias(c) if c == order_col else F.col(c) for c in rows.columns])
