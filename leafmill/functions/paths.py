"""Parts of relative paths, whose separator is a slash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components; sorting by them is the order of a directory walk."""
    return F.split(path, "/")


def filename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def extension(name: Column) -> Column:
    """Lower-cased, after the last dot; empty if that dot is the first character, the last one, or missing."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def directories(path: Column) -> Column:
    """Components before the file name."""
    p = parts(path)
    return F.slice(p, F.lit(1), F.size(p) - 1)


def parent(path: Column) -> Column:
    """The directory as a string; empty at the root."""
    return F.array_join(directories(path), "/")


def ancestors(path: Column) -> Column:
    """All directories above a file, as paths from the root."""
    dirs = directories(path)
    some = F.transform(dirs, lambda _, i: F.array_join(F.slice(dirs, F.lit(1), i + 1), "/"))
    return F.when(F.size(dirs) > 0, some).otherwise(F.array().cast("array<string>"))


def link(path: Column, preserve: Column | bool = True) -> Column:
    """Target of a link in an index: the path, or the name alone in a flat output."""
    keep = preserve if isinstance(preserve, Column) else F.lit(preserve)
    return F.replace(F.when(keep, path).otherwise(filename(path)), F.lit("\\"), F.lit("/"))


def relative(path: Column, root: Column) -> Column:
    """The path below a root; null where it is not below, or holds '..'."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    below = F.substring(path, F.length(base) + 1, F.length(path))
    return F.when(F.startswith(path, base) & ~F.array_contains(parts(below), ".."), below)
