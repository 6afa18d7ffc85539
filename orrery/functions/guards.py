"""Checks and clean forms of names, paths, messages and addresses, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Branches that can't be changed, endings of files with secrets, parts of names that tell a component.
PROTECTED = ["main", "master", "production", "prod"]
SECRET_ENDINGS = [".env", ".env.local", ".env.production", "credentials.json", "service-account.json", "id_rsa", "id_ed25519", ".pem"]
COMPONENTS = [("webhook", "webhooks"), ("api", "api"), ("service", "service")]
ENDPOINT_MARKS = [".GET(", ".POST(", ".PUT(", ".DELETE(", "HandleFunc(", "Handle(", ".Get(", ".Post("]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def branch_problem(name: Column) -> Column:
    """Why a branch name is refused (empty, long, dot, characters, protected), or null; null counts as empty."""
    name = F.coalesce(name, F.lit(""))
    return (
        F.when(name == "", "empty").when(F.length(name) > 255, "long").when(name.startswith(".") | name.endswith("."), "dot")
        .when(name.rlike(r"\.\.|[~^:]"), "characters").when(F.lower(name).isin(PROTECTED), "protected")
    )


def secret_file(path: Column) -> Column:
    """Whether the last part of a path is, or ends like, a file that holds secrets."""
    base = F.element_at(F.split(path, "/"), -1)
    return _any([base.endswith(e) for e in SECRET_ENDINGS])


def large_file(size: Column, most: int = 10) -> Column:
    """Whether a size in bytes is over `most` MiB."""
    return size > most * 1024 * 1024


def exported_function(name: Column, path: Column) -> Column:
    """Whether a Go function is visible outside its package, and not in a test file."""
    return name.rlike("^[A-Z]") & ~path.endswith("_test.go")


def entry_point(code: Column) -> Column:
    return F.contains(code, F.lit("func main()")) | F.contains(code, F.lit("func init()"))


def endpoint_line(line: Column) -> Column:
    return _any([F.contains(line, F.lit(m)) for m in ENDPOINT_MARKS])


def struct_names(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"type\s+(\w+)\s+struct\s*\{"), F.lit(1))


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def commit_message(text: Column) -> Column:
    """A message without control characters other than newline, of at most 500 characters; a default for none."""
    clean = F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F]", "")
    clean = F.when(F.length(clean) > 500, F.concat(F.substring(clean, 1, 497), F.lit("..."))).otherwise(clean)
    return F.when(F.coalesce(text, F.lit("")) == "", "chore: automated commit").otherwise(strip(clean))


def remote_host(url: Column) -> Column:
    """scheme://host of a remote address: scp-like, ssh or http(s); a port is kept only of http(s) and if not 80 or 443."""
    scp, ssh, http = r"^git@([^:]+):", r"^ssh://(?:[^@/]*@)?([^:/]+)", r"^(https?://)(?:[^@/]*@)?([^:/]+)(?::(?:80|443)(?!\d)|(:\d+))?"
    return (
        F.when(url.rlike(scp), F.concat(F.lit("https://"), F.regexp_extract(url, scp, 1)))
        .when(url.rlike(ssh), F.concat(F.lit("https://"), F.regexp_extract(url, ssh, 1)))
        .when(url.rlike(http), F.concat(F.regexp_extract(url, http, 1), F.regexp_extract(url, http, 2), F.regexp_extract(url, http, 3)))
        .otherwise("")
    )


def remote_path(url: Column) -> Column:
    """group/project of a remote address, without .git."""
    rest = F.when(url.startswith("git@"), F.regexp_extract(url, r"^git@[^:]+:(.*)$", 1)).when(url.rlike("^(ssh|https?)://"), F.regexp_extract(url, r"^\w+://[^/]*/*([^?#]*)", 1)).otherwise("")
    return F.regexp_replace(F.regexp_replace(rest, "/+$", ""), r"\.git$", "")


def component(name: Column) -> Column:
    out = F.lit("other")
    for part, tag in reversed(COMPONENTS):
        out = F.when(F.contains(F.lower(name), F.lit(part)), tag).otherwise(out)
    return out


def branch_slug(description: Column, n: int = 40) -> Column:
    return F.substring(F.translate(F.lower(description), " ", "-"), 1, n)


def mermaid(text: Column) -> Column:
    """The inside of the first mermaid fence, or the empty string."""
    return strip(F.regexp_extract(text, r"(?s)```mermaid\s*\n(.*?)```", 1))


def code_fences(text: Column) -> Column:
    """The insides of all code fences."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```\w*\n(.*?)```"), F.lit(1)), strip)


def first_line_with(text: Column, needle: Column) -> Column:
    """Number (from 1) of the first line that holds needle in any case; 1 where none does."""
    at = F.array_position(F.transform(F.split(F.lower(text), "\n"), lambda x: F.contains(x, F.lower(needle))), True)
    return F.greatest(F.coalesce(at, F.lit(0)), F.lit(1))


def outer_json(text: Column) -> Column:
    """What stands between the first { and the last }, or the empty string."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def merge_request(url: Column) -> Column:
    """Struct (base_url, project_path, mr_iid, encoded_project) of a merge request's address, whatever page of it; null if it is none."""
    u, pattern = F.trim(url), r"^(https?://[^/]+)/(.+?)/-/merge_requests/(\d+)"
    part = lambda i: F.regexp_extract(u, pattern, i)
    quoted = F.replace(F.url_encode(part(2)), F.lit("+"), F.lit("%20"))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    found = F.struct(part(1).alias("base_url"), part(2).alias("project_path"), part(3).cast("long").alias("mr_iid"), quoted.alias("encoded_project"))
    return F.when(u.rlike(pattern), found)


# What a file must not hold before it is pushed, by kind.
CREDENTIALS = {"gitlab": r"glpat-[A-Za-z0-9_-]{20,}", "github": r"ghp_[A-Za-z0-9]{36,}", "slack": r"xox[baprs]-", "hook": r"hooks\.slack\.com/services/[A-Za-z0-9/]+"}


def credentials(text: Column) -> Column:
    """Kinds of credentials that a text holds, in the order of CREDENTIALS; none for null."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(k)) for k, p in CREDENTIALS.items()]))
