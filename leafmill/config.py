"""Settings of a scan: defaults, TOML files, overrides from a command line, and checks."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# The default settings.
EXTENSIONS = ("md", "markdown", "mdown", "rst", "rest", "adoc", "asciidoc", "asc", "txt", "text", "org", "wiki", "tex", "latex")
EXCLUDE_DIRS = ("node_modules", ".git", "target", "build", "dist", "vendor", ".vscode", ".idea")
EXCLUDE_PATTERNS = (r".*\.min\..*", r".*\.lock", r"package-lock\.json", r"yarn\.lock")
MAX_FILE_SIZE = 10 * 1024 * 1024
MAX_DEPTH = 10
TIMEOUT = 300
# End of fixed values.

#: Files looked for in the working directory, in this order.
FILE_NAMES = ("leafmill.toml", "leafmill.config.toml", ".leafmill.toml")


class ConfigError(ValueError):
    """A settings file that can't be read, or settings that can't hold."""


@dataclass(frozen=True)
class Filters:
    extensions: tuple[str, ...] = EXTENSIONS
    max_file_size: int = MAX_FILE_SIZE
    exclude_dirs: tuple[str, ...] = EXCLUDE_DIRS
    exclude_patterns: tuple[str, ...] = EXCLUDE_PATTERNS
    max_depth: int = MAX_DEPTH
    patterns_on_files: bool = False

    def with_extension(self, extension: str) -> Filters:
        low = extension.lower()
        return self if low in self.extensions else replace(self, extensions=(*self.extensions, low))

    def without_extension(self, extension: str) -> Filters:
        return replace(self, extensions=tuple(x for x in self.extensions if x != extension.lower()))

    def with_excluded_dir(self, name: str) -> Filters:
        return self if name in self.exclude_dirs else replace(self, exclude_dirs=(*self.exclude_dirs, name))

    @property
    def patterns(self) -> tuple[str, ...]:
        """The patterns of a language without backtracking that compile; others are passed over."""
        return _compiling(tuple(p for p in self.exclude_patterns if _regular(p)))


@dataclass(frozen=True)
class Output:
    preserve_structure: bool = True
    create_index: bool = True
    generate_report: bool = True
    base_directory: str = field(default_factory=os.getcwd)
    force: bool = False


@dataclass(frozen=True)
class Git:
    clone_depth: int | None = None
    timeout: int = TIMEOUT
    branch: str | None = None


@dataclass(frozen=True)
class Config:
    filters: Filters = field(default_factory=Filters)
    output: Output = field(default_factory=Output)
    git: Git = field(default_factory=Git)


#: Keys that a file may leave out; it must have all others.
OPTIONAL = {"clone_depth", "branch", "patterns_on_files", "force"}


#: Letters that may follow a backslash in a pattern.
ESCAPED = frozenset("aftnrvAzbBdDsSwWpPxuU")


def _regular(pattern: str) -> bool:
    """Whether a pattern has no look-around, back-reference, atomic group or escape that only backtracking engines know."""
    escaped = re.findall(r"(?s)\\(.)", pattern)
    bare = re.sub(r"(?s)\\.", "_", pattern)
    while (inner := re.sub(r"\[\^?\]?[^\[\]]*\]", "_", bare)) != bare:  # classes, from the inside out
        bare = inner
    known = all(c in ESCAPED or (c.isascii() and not c.isalnum()) for c in escaped)
    return known and not re.search(r"\(\?(?:[=!>]|<[=!])", bare)


@cache
def _compiling(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Those that the engine that will run them takes, by one statement where it takes all; needs a session."""
    if not patterns:
        return ()
    try:
        tests = ", ".join(f"'' RLIKE :p{i}" for i in range(len(patterns)))
        SparkSession.active().sql(f"SELECT {tests}", {f"p{i}": p for i, p in enumerate(patterns)}).collect()
    except PySparkException:
        half = len(patterns) // 2
        return _compiling(patterns[:half]) + _compiling(patterns[half:]) if half else ()
    return patterns


def load_file(path: str) -> Config:
    """Settings of a TOML file; every key must be there but the optional ones."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    parts = {}
    for name, kind in (("filters", Filters), ("output", Output), ("git", Git)):
        given = data.get(name)
        if given is None:
            raise ConfigError(f"{path}: no table {name}")
        known = {f.name for f in fields(kind)}
        if missing := known - OPTIONAL - set(given):
            raise ConfigError(f"{path}: {name} lacks {', '.join(sorted(missing))}")
        parts[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
    return Config(**parts)


def discover(path: str | None = None, directory: str = ".") -> Config:
    """The file given, or the first of FILE_NAMES that is there, or the defaults."""
    if path:
        return load_file(path)
    found = [p for n in FILE_NAMES if os.path.isfile(p := os.path.join(directory, n))]
    return load_file(found[0]) if found else Config()


def to_toml(config: Config) -> str:
    """Settings as TOML text that load_file reads back."""

    def shown(value: object) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, tuple | list):
            return "[" + ", ".join(map(shown, value)) + "]"
        # a JSON string is a basic string of TOML, which escapes DEL too
        return str(value) if isinstance(value, int) else json.dumps(str(value), ensure_ascii=False).replace("\x7f", "\\u007f")

    blocks = []
    for name, values in asdict(config).items():
        blocks.append("\n".join([f"[{name}]", *[f"{k} = {shown(v)}" for k, v in values.items() if v is not None]]))
    return "\n\n".join(blocks) + "\n"


def split_formats(csv: str) -> tuple[str, ...]:
    return tuple(y for x in csv.split(",") if (y := x.strip().lower()))


def merge(config: Config, given: Mapping[str, object]) -> Config:
    """Settings with the overrides that are not None: formats, exclude, max_file_size, output_dir, preserve_structure, timeout, branch, force."""
    has = {k: v for k, v in given.items() if v is not None}
    filters, output, git = config.filters, config.output, config.git
    if "formats" in has:
        filters = replace(filters, extensions=split_formats(has["formats"]))
    if "exclude" in has:
        extra: Iterable[str] = has["exclude"]
        filters = replace(filters, exclude_dirs=(*filters.exclude_dirs, *extra))
    if "max_file_size" in has:
        filters = replace(filters, max_file_size=has["max_file_size"])
    if "output_dir" in has:
        output = replace(output, base_directory=has["output_dir"])
    for key in ("preserve_structure", "force"):
        if key in has:
            output = replace(output, **{key: has[key]})
    for key in ("timeout", "branch"):
        if key in has:
            git = replace(git, **{key: has[key]})
    return Config(filters, output, git)


def problem(config: Config) -> str | None:
    """The first thing wrong with the settings; None if they hold."""
    if not config.filters.extensions:
        return "no_extensions"
    if config.filters.max_file_size <= 0:
        return "max_file_size"
    if config.git.timeout <= 0:
        return "timeout"
    if config.filters.max_depth <= 0:
        return "max_depth"
    parent = os.path.dirname(os.path.abspath(config.output.base_directory))
    return None if os.path.isdir(parent) else "base_directory"
