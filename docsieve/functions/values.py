"""Numbers, dates, sizes and tolerant parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_RATIO = "无法计算"
ISSUE_LIMIT = 30


def decimals(value: Column, places: int) -> Column:
    """Fixed decimals as text without grouping, half-even on the binary value."""
    return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))


def percent_label(part: Column, whole: Column) -> Column:
    """``12.5%``, or ``-`` where there is nothing to divide by."""
    return F.when(whole <= 0, "-").otherwise(F.concat(decimals(part / whole * 100, 1), F.lit("%")))


def ratio_label(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, NO_RATIO).otherwise(decimals(part / whole, 2))


def tolerant_bool(value: Column, default: bool = False) -> Column:
    """Words for yes and no in any case; anything else is the default."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off", ""), False).otherwise(default)


def tolerant_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.trim(value).try_cast("long"), F.lit(default).cast("long"))


def issue_limit(value: Column) -> Column:
    """1 to 30; less than 1, more than 30 or no number: 30."""
    n = F.trim(value.cast("string")).try_cast("long")
    return F.when(n.isNull() | (n < 1) | (n > ISSUE_LIMIT), ISSUE_LIMIT).otherwise(n).cast("int")


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    n = F.coalesce(F.trim(value.cast("string")).try_cast("long"), F.lit(default))
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))


def kilobytes(size: Column) -> Column:
    return F.concat(decimals(size / 1024, 1), F.lit(" KB"))


def progress(done: Column, total: Column) -> Column:
    """5 to 90, by the share that is done."""
    return (F.lit(5) + F.floor(done / F.greatest(total, F.lit(1)) * 85)).cast("int")


def progress_ramp(start: Column, end: Column, elapsed: Column, timeout: Column, current: Column) -> Column:
    """Creeps from start to end within the (clamped) timeout and never goes back."""
    span = F.least(F.greatest(timeout, F.lit(60)), F.lit(300))
    now = start + F.floor((end - start) * F.least(F.lit(1.0), elapsed / span))
    return F.greatest(current, now).cast("int")


def media_time(seconds: Column) -> Column:
    """``MM:SS.mmm``, with hours in front where there are any."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000, 0).cast("long")
    s = F.floor(ms / 1000)
    tail = F.format_string("%02d:%02d.%03d", F.floor(s % 3600 / 60), s % 60, ms % 1000)
    return F.when(s >= 3600, F.concat(F.format_string("%02d:", F.floor(s / 3600)), tail)).otherwise(tail)


def number_text(value: Column) -> Column:
    """Whole doubles without a fraction."""
    return F.when(value.isNull(), "").when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size)).cast("long")


def bounded_page(page: Column, total: Column, size: int) -> Column:
    return F.least(F.greatest(page, F.lit(1)), pages(total, size)).cast("long")


def date_or(value: Column, default: Column) -> Column:
    """Strict yyyy-MM-dd."""
    return F.coalesce(F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd")), default)


def first_time(*times: Column) -> Column:
    """The first time that is known."""
    return F.coalesce(*times)


def first_text(*values: Column) -> Column:
    """The first text that is not empty; otherwise the empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def item_id(code: Column, index: Column, text: Column) -> Column:
    """16 hex digits of SHA-1 over code, index and text."""
    return F.substring(F.sha1(F.concat_ws("\n", code, index.cast("string"), text)), 1, 16)


def json_string(value: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def rule_fingerprint(task_type: Column, code: Column, description: Column) -> Column:
    """SHA-256 over compact JSON with sorted keys."""
    raw = F.concat(F.lit('{"check_code":'), json_string(code), F.lit(',"description":'), json_string(description), F.lit(',"task_type":'), json_string(task_type), F.lit("}"))
    return F.sha2(raw, 256)


def page_list_label(pages_array: Column) -> Column:
    """One page, ``a-b`` for a run, or the pages joined."""
    low, high, n = F.array_min(pages_array), F.array_max(pages_array), F.size(pages_array)
    return (
        F.when(n == 0, "")
        .when(n == 1, low.cast("string"))
        .when(high - low + 1 == n, F.concat_ws("-", low.cast("string"), high.cast("string")))
        .otherwise(F.array_join(F.transform(F.array_sort(pages_array), lambda p: p.cast("string")), "、"))
    )


def chunks(values: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(size))
    return F.when(F.size(values) == 0, F.array()).otherwise(F.transform(starts, lambda i: F.slice(values, i + 1, F.lit(size))))


def file_extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without a dot."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def allowed_file(name: Column) -> Column:
    return file_extension(name).isin("docx", "pdf", "txt", "md", "html", "xlsx", "xlsm", "xls")


def magic_mime(content: Column) -> Column:
    """Image type by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (head.substr(17, 8) == "57454250"), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
        .otherwise("")
    )
