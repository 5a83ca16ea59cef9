"""Rules that choose documentation files, as columns over a catalog (relative_path, filename, extension, size)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.config import Filters
from leafmill.functions import paths

# Names and directories that the rules know.
SCAN_NAMES = (
    "readme", "license", "licence", "changelog", "contributing", "authors", "notice", "install", "usage", "todo", "copying", "news",
    "history", "credits", "maintainers", "thanks", "acknowledgments", "acknowledgements", "code_of_conduct", "security", "support", "codeofconduct",
)
DOCUMENT_NAMES = (
    "readme", "license", "changelog", "contributing", "authors", "notice", "install", "usage", "todo", "copying", "news",
    "history", "credits", "maintainers", "thanks", "acknowledgments",
)
SHOWN_HIDDEN_DIRS = (".github", ".vscode", ".devcontainer")
BUILD_DIRS = (
    "target", "build", "dist", "out", "output", "bin", "obj", "node_modules", "vendor", ".cache", "tmp", "temp",
    "__pycache__", ".pytest_cache", ".mypy_cache", "coverage", ".coverage", "htmlcov",
)
LONGEST_PATH = 4096
FORBIDDEN = r'[<>:"|?*\p{Cc}]'
# End of fixed values.


def has_extension(filters: Filters) -> Column:
    return (F.col("extension") != "") & F.col("extension").isin(*filters.extensions)


def known_name(name: Column) -> Column:
    """Whole names, in any case, that are documentation without an extension."""
    return F.lower(name).isin(*SCAN_NAMES)


def extensionless_document() -> Column:
    """The narrower rule for a row: no extension, and a name of the shorter list."""
    return (F.col("extension") == "") & F.lower("filename").isin(*DOCUMENT_NAMES)


def within_size(filters: Filters) -> Column:
    return F.col("size") <= filters.max_file_size


def within_depth(filters: Filters) -> Column:
    return F.size(paths.parts(F.col("relative_path"))) <= filters.max_depth


def in_excluded_dir(filters: Filters) -> Column:
    names = [d.lower() for d in filters.exclude_dirs]
    return F.exists(paths.directories(F.col("relative_path")), lambda d: F.lower(d).isin(*names)) if names else F.lit(False)


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether some pattern is found in the text."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def in_matching_dir(filters: Filters) -> Column:
    """Patterns look at directories, as paths from the root; at files only where the settings say so."""
    hit = F.exists(paths.ancestors(F.col("relative_path")), lambda p: matches_any(p, filters.patterns))
    return hit | matches_any(F.col("relative_path"), filters.patterns) if filters.patterns_on_files else hit


def in_hidden_dir() -> Column:
    return F.exists(paths.directories(F.col("relative_path")), lambda d: F.startswith(d, F.lit(".")) & ~F.lower(d).isin(*SHOWN_HIDDEN_DIRS))


def in_build_dir() -> Column:
    return F.exists(paths.directories(F.col("relative_path")), lambda d: F.lower(d).isin(*BUILD_DIRS))


def reject_reason(filters: Filters) -> Column:
    """The first rule that keeps a file out: those of its directories, its name, its size; null if it stays."""
    return (
        F.when(~within_depth(filters), F.lit("depth"))
        .when(in_excluded_dir(filters), F.lit("excluded_dir"))
        .when(in_matching_dir(filters), F.lit("pattern"))
        .when(in_hidden_dir(), F.lit("hidden_dir"))
        .when(in_build_dir(), F.lit("build_dir"))
        .when(~(has_extension(filters) | known_name(F.col("filename"))), F.lit("not_documentation"))
        .when(~within_size(filters), F.lit("size"))
    )


def documentation(catalog: DataFrame, filters: Filters) -> DataFrame:
    """The rows that stay. Cheap rules come first; all of them are one pass over narrow columns."""
    return catalog.where(reject_reason(filters).isNull())


def path_problem(path: Column) -> Column:
    """Why a destination is refused, null if it isn't: '..', its length in bytes, characters or the end of its name."""
    name = paths.filename(path)
    return (
        F.when(F.array_contains(paths.parts(path), ".."), F.lit("traversal"))
        .when(too_long(path), F.lit("too_long"))
        .when(name.rlike(FORBIDDEN), F.lit("invalid_characters"))
        .when(name.rlike(r"[ .]$"), F.lit("trailing_space_or_dot"))
    )


def too_long(path: Column, most: int = LONGEST_PATH) -> Column:
    return F.octet_length(path) > most
