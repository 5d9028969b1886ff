"""Checks that people define: a log of commands folded into the current table of checks.

A command (``seq``, ``action``, and what it needs) creates, edits, enables, disables, resets, deletes or reorders checks.
What a check is now depends on its own commands only, apart from its place: so the log is grouped by check, not walked. A
check lives from its creation (built-in ones from the beginning) to its first valid deletion; a command outside of that, or
without what it needs, is refused with a reason and changes nothing. Each value is that of the last valid command that set
it. For the place, of two checks of one type the one that a later command put in front (created it, or listed it in a
reorder) comes first; those of one reorder by their place in its list, untouched built-in ones by their first order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.ordered import numbered

# Types of tasks and the prefixes of codes of checks made for them.
CODE_PREFIXES = {"document": "custom", "consistency": "custom-consistency", "language_consistency": "custom-language-consistency", "image": "custom-image", "video": "custom-video"}
VALUES = ("name", "description", "prompt", "enabled")
ACTIONS = ("create", "edit", "enable", "disable", "reset", "delete", "reorder")


def task_type(value: Column) -> Column:
    """The named type, or ``document``."""
    return F.when(value.isin(*CODE_PREFIXES), value).otherwise("document")


def code_of(kind: Column, token: Column) -> Column:
    """Prefix by type, then a token of its own."""
    prefix = F.create_map(*[F.lit(x) for pair in CODE_PREFIXES.items() for x in pair])[kind]
    return F.concat(prefix, F.lit("-"), token)


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def judged(builtin: DataFrame, commands: DataFrame) -> DataFrame:
    """Each command with ``problem``: null if it takes effect, else why not. ``builtin`` has code, task_type, name,
    description, prompt, enabled, sort_order; ``commands`` has seq (which tells them apart), action, code (of the check; of
    a creation: the new code), task_type, name, description, prompt, enabled, codes (of a reorder)."""
    known = builtin.select("code", F.lit(True).alias("_builtin"))
    rows = commands.withColumn("_kind", task_type(F.col("task_type"))).join(known, "code", "left").withColumn("_builtin", F.coalesce("_builtin", F.lit(False)))
    texts = _blank("name") | _blank("prompt")
    shape = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "reorder") & (F.coalesce(F.size("codes"), F.lit(0)) <= 0), "empty order")
        .when(F.col("action").isin("create", "edit") & texts, "no name or prompt")
        .when((F.col("action") == "create") & (F.col("_builtin") | F.col("code").isNull()), "code is taken")
        .when((F.col("action") == "delete") & F.col("_builtin"), "built-in")
        .when((F.col("action") == "reset") & ~F.col("_builtin"), "nothing to reset to")
    )
    rows = rows.withColumn("_shape", shape)
    # A code is made once and goes once; what else was asked of it before or after is refused.
    sound = F.col("_shape").isNull() & F.col("code").isNotNull()
    begin = rows.filter(sound & (F.col("action") == "create")).groupBy("code").agg(F.min("seq").alias("_begin"))
    dated = rows.join(begin, "code", "left").withColumn("_begin", F.when(F.col("_builtin"), F.lit(-(1 << 62))).otherwise(F.col("_begin")))
    end = dated.filter(sound & (F.col("action") == "delete") & (F.col("seq") > F.col("_begin"))).groupBy("code").agg(F.min("seq").alias("_end"))
    dated = dated.join(end, "code", "left")
    single = ~F.col("action").isin("create", "reorder")
    problem = (
        F.when(F.col("_shape").isNotNull(), F.col("_shape"))
        .when((F.col("action") == "create") & (F.col("seq") != F.col("_begin")), "code is taken")
        .when(single & (F.col("_begin").isNull() | (F.col("seq") < F.col("_begin")) | (F.col("seq") > F.col("_end"))), "no such check")
    )
    return dated.select(*commands.columns, F.col("_kind").alias("kind"), problem.alias("problem"))


def current_checks(builtin: DataFrame, commands: DataFrame) -> DataFrame:
    """The table after all commands: code, task_type, name, description, prompt, enabled, builtin, sort_order (by tens in each
    type)."""
    valid = judged(builtin, commands).filter("problem is null")
    base = builtin.select("code", "task_type", *VALUES, F.col("sort_order").cast("long").alias("_first"), F.lit(-(1 << 62)).alias("seq"), F.lit("create").alias("action"), F.col("prompt").alias("_default"))
    steps = valid.filter("action <> 'reorder'").select("code", F.col("kind").alias("task_type"), *VALUES, F.lit(None).cast("long").alias("_first"), "seq", "action", F.lit(None).cast("string").alias("_default"))
    all_steps = base.unionByName(steps)
    sets = {
        "name": F.col("action").isin("create", "edit"), "description": F.col("action").isin("create", "edit"), "prompt": F.col("action").isin("create", "edit", "reset"), "enabled": F.col("action").isin("create", "edit", "enable", "disable"),
    }
    value = {"enabled": F.when(F.col("action") == "enable", True).when(F.col("action") == "disable", False).otherwise(F.coalesce("enabled", F.lit(False))), "name": F.trim("name"), "description": F.trim(F.coalesce("description", F.lit(""))), "prompt": F.trim("prompt")}
    checks = all_steps.groupBy("code").agg(
        F.min_by("task_type", "seq").alias("task_type"),
        *[F.max_by(F.struct(value[v].alias("v"), F.col("action").alias("a")), F.when(sets[v], F.col("seq"))).alias(v) for v in VALUES],
        F.max("_default").alias("_default"), F.max("_first").alias("_first"), F.max(F.when(F.col("action") == "create", F.col("seq"))).alias("_made"), F.bool_or(F.col("action") == "delete").alias("_gone"),
    )
    prompt = F.when(F.col("prompt.a") == "reset", F.col("_default")).otherwise(F.col("prompt.v"))
    alive = checks.filter("not _gone").select("code", "task_type", F.col("name.v").alias("name"), F.col("description.v").alias("description"), prompt.alias("prompt"), F.col("enabled.v").alias("enabled"), F.col("_default").isNotNull().alias("builtin"), "_first", "_made")
    orders = valid.filter("action = 'reorder'").select("seq", "kind", F.posexplode("codes").alias("_at", "code"))
    listed = orders.groupBy("code", "kind", "seq").agg(F.min("_at").cast("long").alias("_at")).groupBy("code", F.col("kind").alias("task_type")).agg(F.max(F.struct("seq", F.col("_at"))).alias("_listed"))
    placed = alive.join(listed, ["code", "task_type"], "left")
    later = F.col("_listed.seq") > F.col("_made")
    placed = placed.withColumns({"_new": F.when(later, -F.col("_listed.seq")).otherwise(-F.col("_made")), "_at": F.when(later, F.col("_listed._at")).otherwise(F.coalesce("_first", F.lit(0)))})
    done = numbered(placed, ["task_type"], ["_new", "_at", "code"], "_n")
    return done.select("code", "task_type", "name", "description", "prompt", "enabled", "builtin", (F.col("_n") * 10).alias("sort_order"))


def refused(builtin: DataFrame, commands: DataFrame) -> DataFrame:
    """The commands that changed nothing, and why: seq, action, code, problem."""
    return judged(builtin, commands).filter("problem is not null").select("seq", "action", "code", "problem")


def next_sort_order(checks: DataFrame) -> DataFrame:
    """For each type the order that puts a new check before all others."""
    return checks.groupBy("task_type").agg((F.min("sort_order") - 10).alias("sort_order"))

