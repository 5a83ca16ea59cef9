"""Sizes, durations, names and times as text, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30


def format_bytes(size: Column) -> Column:
    """Bytes as a whole number, larger units with one decimal, half to even; gigabytes are the largest."""

    def scaled(unit: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(unit)), 1)), F.lit(f" {name}"))

    small = F.concat(size.cast("string"), F.lit(" B"))
    return F.when(size < KB, small).when(size < MB, scaled(KB, "KB")).when(size < GB, scaled(MB, "MB")).otherwise(scaled(GB, "GB"))


def format_duration(milliseconds: Column) -> Column:
    """'XmYs' from a minute on (no hours), whole seconds from one on, else milliseconds."""
    ms = milliseconds.cast("long")
    seconds = F.floor(ms / 1000)
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(seconds >= 60, minutes).when(seconds > 0, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))


def parse_size(text: Column) -> Column:
    """Bytes of '10', '5MB', '1.5k' and the like; null for what is no number, is negative, or not finite."""
    s = F.lower(F.trim(text))
    unit = F.regexp_extract(s, "(kb|k|mb|m|gb|g|b)$", 1)
    letter = F.substring(unit, 1, 1)
    factor = F.when(letter == "k", KB).when(letter == "m", MB).when(letter == "g", GB).otherwise(1)
    doubled = F.regexp_replace(F.when(letter == "b", F.regexp_replace(s, "b+$", "")).otherwise(F.regexp_replace(s, "((kb)+|(mb)+|(gb)+)$", "")), "(k+|m+|g+)$", "")
    body = F.when(unit == "", s).otherwise(doubled)
    number = F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), body.try_cast("double"))
    return F.when(number >= 0, F.floor(number * factor).cast("long"))


def sanitize_filename(name: Column) -> Column:
    """Characters that some systems forbid become '_'; dots and spaces go from the end."""
    clean = F.rtrim(F.regexp_replace(name, r'[<>:"|?*/\\\p{Cc}]', "_"), F.lit(". "))
    return F.when(clean == "", F.lit("unnamed_file")).otherwise(clean)


def sanitize_repo_name(name: Column) -> Column:
    """Letters, numbers, '-', '.' and '_' stay, others become '_'; at most 100 characters."""
    clean = F.trim(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}._-]", "_"), F.lit("._ "))
    return F.when(clean == "", F.lit("unnamed_repo")).otherwise(F.left(clean, F.lit(100)))


def utc_text(time: Column, seconds: bool = True) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss 'UTC'" if seconds else "yyyy-MM-dd HH:mm 'UTC'")


def shown_extension(ext: Column) -> Column:
    return F.when(ext == "no_extension", F.lit("no extension")).otherwise(ext)
