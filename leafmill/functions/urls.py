"""Which repository addresses are taken, and what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "github.com"
#: Fixed value: the greatest length of an owner's or a repository's name.
LONGEST_NAME = 100


# Characters that a path holds only as percent codes.
ENCODED = {" ": "%20", '"': "%22", "<": "%3C", ">": "%3E", "[": "%5B", "\\": "%5C", "]": "%5D", "^": "%5E", "`": "%60", "{": "%7B", "|": "%7C", "}": "%7D"}
# End of fixed values.


def _written(url: Column) -> Column:
    """The address as browsers write it: trimmed, without line breaks, odd characters behind the host as percent codes."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    bare = F.when(bare.rlike("(?i)^(https?|ftp):"), F.replace(bare, F.lit("\\"), F.lit("/"))).otherwise(bare)
    start = r"(?s)^([^:/?#]*://[^/?#]*)?(.*)$"
    rest = F.regexp_replace(F.regexp_extract(bare, start, 2), "%(?![0-9A-Fa-f]{2})", "%25")
    for character, code in ENCODED.items():
        rest = F.replace(rest, F.lit(character), F.lit(code))
    return F.concat(F.regexp_extract(bare, start, 1), rest)


def _part(url: Column, what: str) -> Column:
    return F.try_parse_url(_written(url), F.lit(what))


def segments(url: Column) -> Column:
    """Components of the path. '.' goes, and '..' takes the one before it along; at the end they leave an empty one."""
    given = F.split(F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "^/", ""), "/")

    def step(above: Column, part: Column) -> Column:
        dots = F.regexp_replace(part, "(?i)%2e", ".")
        without = F.slice(above, F.lit(1), F.greatest(F.size(above) - 1, F.lit(0)))
        return F.when(dots == "..", without).when(dots == ".", above).otherwise(F.concat(above, F.array(part)))

    left = F.aggregate(given, F.array().cast("array<string>"), step)
    return F.when(F.element_at(given, -1).rlike(r"(?i)^(\.|%2e){1,2}$"), F.concat(left, F.array(F.lit("")))).otherwise(left)


def owner(url: Column) -> Column:
    return F.get(segments(url), F.lit(0))


def repository(url: Column) -> Column:
    """The second component, without one '.git' at its end; null if there is none."""
    return F.regexp_replace(F.get(segments(url), F.lit(1)), r"\.git$", "")


def _transport(url: Column, host: str, strict: bool) -> Column:
    scheme, name = F.lower(_part(url, "PROTOCOL")), F.lower(_part(url, "HOST"))
    named = F.coalesce(name, F.lit(""))
    ours = (named == host) | F.endswith(named, F.lit(f".{host}")) if strict else F.endswith(named, F.lit(host))
    return (
        F.when(url.isNull() | scheme.isNull(), F.lit("bad_url"))
        .when(~scheme.isin("https", "ssh", "git"), F.lit("scheme"))
        .when((scheme == "git") & ~F.contains(named, F.lit(host)), F.lit("git_host"))
        .when(named == "", F.lit("no_host"))
        .when(~ours, F.lit("host"))
    )


def url_problem(url: Column, host: str = HOST, strict_host: bool = False) -> Column:
    """The first rule that an address breaks; 'ok' if none. ``strict_host`` takes the host and its subdomains only."""
    first, second = owner(url), repository(url)
    odd = r"[^A-Za-z0-9._-]"  # other characters are percent-encoded in an address, and "%" is refused
    deeper = (
        F.when(F.size(segments(url)) < 2, F.lit("path"))
        .when((first == "") | (F.get(segments(url), F.lit(1)) == ""), F.lit("empty"))
        .when(first.rlike(odd), F.lit("owner_chars"))
        .when(second.rlike(odd), F.lit("repo_chars"))
        .when(F.startswith(first, F.lit(".")) | F.startswith(second, F.lit(".")), F.lit("dot"))
        .when((F.octet_length(first) > LONGEST_NAME) | (F.octet_length(second) > LONGEST_NAME), F.lit("length"))
        .otherwise(F.lit("ok"))
    )
    return F.coalesce(_transport(url, host, strict_host), deeper)


def clone_problem(url: Column, host: str = HOST) -> Column:
    """The weaker rules for what is fetched: scheme and host alone."""
    return F.coalesce(_transport(url, host, False), F.lit("ok"))


def output_name(url: Column, given: Column | None = None) -> Column:
    named = F.concat(F.lit("docs_"), repository(url))
    return named if given is None else F.coalesce(given, named)


def output_path(name: Column, base: Column) -> Column:
    """A name with a slash as it is, others below the base."""
    return F.when(F.contains(name, F.lit("/")), name).otherwise(F.concat(base, F.lit("/"), name))
