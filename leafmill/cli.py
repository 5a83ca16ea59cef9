"""Command line: extract the documentation of a directory tree, by the settings of a file and of options.

The tree is a checkout that is already there; fetching one is outside of this program. ``--url`` names
the repository it came from, and is checked by the address rules.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafmill import config as settings
from leafmill.functions import urls
from leafmill.operators import messages
from leafmill.plans.extract import Repository, RunError, described, extract, interruptible


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafmill", description=__doc__)
    p.add_argument("tree", nargs="?", help="directory to scan")
    p.add_argument("--url", help="address of the repository")
    p.add_argument("-o", "--output", help="name of the output directory, or a path")
    p.add_argument("-f", "--formats", help="extensions, e.g. md,rst,txt")
    p.add_argument("-e", "--exclude", type=lambda s: s.split(","), help="directories to leave out")
    p.add_argument("-c", "--config", help="TOML file")
    p.add_argument("-b", "--branch")
    p.add_argument("--max-size", type=int, help="greatest file size in MB")
    p.add_argument("--timeout", type=int)
    p.add_argument("--preserve-structure", type=lambda s: s.lower() == "true")
    p.add_argument("--output-format", choices=["human", "json", "plain"], default="human")
    talk = p.add_mutually_exclusive_group()
    talk.add_argument("-v", "--verbose", action="count", default=0)
    talk.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--generate-config", action="store_true")
    return p


def effective_config(args: argparse.Namespace) -> settings.Config:
    """Settings of the file found, with the options given; checked."""
    size = None if args.max_size is None else args.max_size << 20
    given = {"formats": args.formats, "exclude": args.exclude, "max_file_size": size, "preserve_structure": args.preserve_structure, "timeout": args.timeout, "branch": args.branch, "force": args.force or None}
    if args.output and "/" in args.output:
        given["output_dir"] = os.path.dirname(args.output.rstrip("/"))
    merged = settings.merge(settings.discover(args.config), given)
    if what := settings.problem(merged):
        raise RunError("config", what)
    return merged


def show_progress(files: int, size: int) -> None:
    print(f"\r  {files} files, {size} bytes", end="", file=sys.stderr, flush=True)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.generate_config:
        with open("leafmill.toml", "w", encoding="utf-8") as f:
            f.write(settings.to_toml(settings.Config()))
        return messages.OK
    spark = spark or SparkSession.builder.appName("leafmill").getOrCreate()

    def say(level: str, text: str) -> None:
        mode, row = F.lit(args.output_format), spark.range(1)
        shown = messages.is_shown(F.lit(level), F.lit(args.verbose), F.lit(args.quiet))
        r = row.select(shown.alias("shown"), messages.render(mode, F.lit(level), F.lit(text)).alias("line"), messages.to_stderr(mode, F.lit(level)).alias("err")).first()
        if r["shown"]:
            print(r["line"], file=sys.stderr if r["err"] else sys.stdout)

    try:
        config = effective_config(args)
        url = args.url or ""
        if url:
            r = spark.range(1).select(urls.url_problem(F.lit(url)).alias("problem"), urls.owner(F.lit(url)).alias("owner"), urls.repository(F.lit(url)).alias("name")).first()
            if r["problem"] != "ok":
                raise RunError("invalid_url", url)
            repository = Repository(r["name"], r["owner"], url, config.git.branch or "main")
        elif args.tree:
            repository = Repository(os.path.basename(os.path.abspath(args.tree)), default_branch=config.git.branch or "main")
        else:
            raise RunError("invalid_path", "no tree given")
        from leafmill.functions.text import sanitize_repo_name

        clean = spark.range(1).select(sanitize_repo_name(F.lit(repository.name)).alias("n")).first()["n"]
        name = os.path.basename(args.output.rstrip("/")) if args.output else f"docs_{clean}"
        if args.dry_run:
            plan = {"repository": f"{repository.owner}/{repository.name}", "output": os.path.join(config.output.base_directory, name), "extensions": list(config.filters.extensions), "max_file_size": config.filters.max_file_size, "exclude_dirs": list(config.filters.exclude_dirs), "preserve_structure": config.output.preserve_structure}
            print(json.dumps(plan, indent=2) if args.output_format == "json" else "\n".join(f"{k}: {v}" for k, v in plan.items()))
            return messages.OK
        if not args.tree:
            raise RunError("invalid_path", "no tree given")
        live = args.output_format == "human" and not args.quiet and sys.stderr.isatty()
        with interruptible(spark, "leafmill-describe", config.git.timeout):
            repository = described(spark, args.tree, repository)
        with interruptible(spark, "leafmill-extract"):
            run = extract(spark, args.tree, config, repository, name, args.output_format, show_progress if live else None)
    except (RunError, settings.ConfigError) as e:
        kind, detail = (e.kind, e.detail) if isinstance(e, RunError) else ("config", str(e))
        r = spark.range(1).select(messages.message(F.lit(kind), F.lit(detail)).alias("m"), messages.hint(F.lit(kind)).alias("h"), messages.exit_code(F.lit(kind), F.lit(0)).alias("c")).first()
        say("error", r["m"])
        if r["h"]:
            say("info", r["h"])
        return r["c"]
    except KeyboardInterrupt:
        return messages.KINDS["cancelled"][2]
    say("info", f"Written to {run.output}")
    if not args.quiet:
        print(run.summary)
    print(run.report)
    return messages.OK_WITH_ERRORS if run.errors else messages.OK


if __name__ == "__main__":
    sys.exit(main())
