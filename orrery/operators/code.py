"""Code analysis over text columns: symbols, imports, uses, diffs, reviews, traces, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Patterns of definitions by language.
_JS = [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)\s*=>|function)", r"(?:^|\n)\s*(?:export\s+)?class\s+(\w+)"]
DEFINITIONS = {"GO": [r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\("], "PY": [r"(?:^|\n)\s*def\s+(\w+)\s*\(", r"(?:^|\n)\s*class\s+(\w+)\s*[\(:]"], "JS": _JS, "TS": _JS}
TAGS = ("TODO", "FIXME", "HACK", "XXX")
SECRET_WORDS = ("password", "secret", "api_key", "token")


def short_language(language: Column) -> Column:
    out = F.upper(language)
    for a, b in (("PYTHON", "PY"), ("GOLANG", "GO"), ("JAVASCRIPT", "JS"), ("TYPESCRIPT", "TS")):
        out = F.when(F.upper(language) == a, b).otherwise(out)
    return out


def symbols(code: Column, language: Column) -> Column:
    """Names that the code defines, each once, in order of pattern."""
    lang, none = short_language(language), F.array().cast("array<string>")
    every = {k: F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in ps]) for k, ps in DEFINITIONS.items()}
    out = none
    for k, v in every.items():
        out = F.when(lang == k, v).otherwise(out)
    return F.array_distinct(out)


def lines(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line from 1, content)."""
    return rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("long"))


def use_of(line: Column, symbol: Column) -> Column:
    """How a line uses a symbol that it contains: definition, import, call, type_usage or reference; the first that fits."""
    s = F.concat(F.lit(r"\Q"), symbol, F.lit(r"\E"))
    like = lambda *parts: F.regexp_like(line, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return (
        F.when(like(r"(?:func|def|class)\s+(?:\([^)]*\)\s+)?", s, r"\b"), "definition")
        .when(like(r"(?:import|from)\s.*\b", s, r"\b"), "import")
        .when(like(r"\b", s, r"\s*\("), "call")
        .when(like(r":\s*", s, r"\b|", s, r"\s*\{"), "type_usage")
        .otherwise("reference")
    )


def uses(code: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, symbol, line, usage) of each line of code (id, code) that contains a symbol of wanted (symbol)."""
    rows = lines(code, "code", "id").join(F.broadcast(wanted), F.contains(F.col("content"), F.col("symbol")))
    return rows.select("id", "symbol", "line", use_of(F.col("content"), F.col("symbol")).alias("usage"))


def imports(code: Column) -> Column:
    """Imported names: quoted Go paths (single or in a block), Python modules, JavaScript sources; each once."""
    block = F.array_join(F.regexp_extract_all(code, F.lit(r"import\s+\(([^)]+)\)"), F.lit(1)), "\n")
    found = [
        F.regexp_extract_all(code, F.lit(r'import\s+"([^"]+)"'), F.lit(1)), F.regexp_extract_all(block, F.lit(r'"([^"]+)"'), F.lit(1)),
        F.regexp_extract_all(code, F.lit(r"(?m)^\s*from\s+([\w.]+)\s+import\b"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"(?m)^\s*import\s+([\w.]+)"), F.lit(1)),
        F.regexp_extract_all(code, F.lit(r"(?:import|require)\s*\(\s*[\"']([^\"']+)"), F.lit(1)), F.regexp_extract_all(code, F.lit(r"from\s+[\"']([^\"']+)[\"']"), F.lit(1)),
    ]
    return F.array_distinct(F.concat(*found))


def changed_symbols(diffs: DataFrame) -> DataFrame:
    """(id, symbol) that the added lines of a diff (id, diff) define."""
    added = lines(diffs, "diff", "id").where(F.col("content").startswith("+"))
    name = F.regexp_extract("content", r"(?:func|def|class|function)\s+(?:\([^)]*\)\s+)?(\w+)", 1)
    return added.select("id", name.alias("symbol")).where(F.length("symbol") > 1).distinct()


def review(diffs: DataFrame) -> DataFrame:
    """(id, line, type, severity, message) of the fixed rules on added lines; lines count added lines from 0."""
    added = F.filter(F.split("diff", "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    rows = diffs.select("id", F.posexplode(added).alias("line", "raw")).select("id", F.col("line").cast("long").alias("line"), F.expr("substring(raw, 2)").alias("content"))
    low, plain = F.lower("content"), F.trim("content")
    secret = F.lit(False)
    for w in SECRET_WORDS:
        secret = secret | F.contains(low, F.lit(w))
    secret = secret & F.contains(F.col("content"), F.lit("=")) & ~plain.startswith("//") & ~plain.startswith("#")
    issue = lambda when, kind, severity, text: F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(text).alias("message")))
    found = [issue(secret, "security", "high", "Possible hardcoded secret")]
    found += [issue(F.contains(F.col("content"), F.lit(t)), "quality", "low", f"Contains {t}") for t in TAGS]
    found += [issue(F.col("content").rlike(r"fmt\.(Println|Printf)"), "quality", "medium", "Use structured logger instead of fmt.Print")]
    return rows.select("id", "line", F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "line", "x.type", "x.severity", "x.message")


def verdict(issues: DataFrame) -> DataFrame:
    high = F.max((F.col("severity") == "high").cast("int")) == 1
    return issues.groupBy("id").agg(F.count(F.lit(1)).alias("n_issues"), F.when(high, "REQUEST_CHANGES").otherwise("APPROVE").alias("decision"))


def requirements(files: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, version) of requirements files (repo, content)."""
    rows = lines(files, "content", "repo").select("repo", F.trim("content").alias("x")).where("x <> '' and not startswith(x, '#') and not startswith(x, '-')")
    pattern = r"^([a-zA-Z0-9_-]+)\s*([><=!~]+\s*[\d.]+)?"
    return rows.where(F.col("x").rlike(pattern)).select("repo", F.lit("python").alias("ecosystem"), F.regexp_extract("x", pattern, 1).alias("name"), F.trim(F.coalesce(F.regexp_extract("x", pattern, 2), F.lit(""))).alias("version"))


def package_json(files: DataFrame) -> DataFrame:
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.select("repo", parsed.alias("p")).select("repo", F.explode(F.array("p.dependencies", "p.devDependencies")).alias("m"))
    return rows.select("repo", F.explode("m").alias("name", "version")).select("repo", F.lit("node").alias("ecosystem"), "name", "version")


def go_mod(files: DataFrame) -> DataFrame:
    """Required modules of go.mod files, from blocks and single lines."""
    rows = lines(files, "content", "repo").select("repo", F.regexp_replace("content", r"//.*$", "").alias("x"))
    pattern = r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[\w./\-]+|[\w.\-]+/[\w./\-]+)\s+(v[\w.\-+]+)"
    return rows.where(F.col("x").rlike(pattern)).select("repo", F.lit("go").alias("ecosystem"), F.regexp_extract("x", pattern, 1).alias("name"), F.regexp_extract("x", pattern, 2).alias("version"))


def frames(traces: DataFrame) -> DataFrame:
    """(id, line, file, at) of the frames of traces (id, trace): Go file:line and Python File "x", line n."""
    rows = lines(traces, "trace", "id")
    go, py = r"(\S+\.go):(\d+)", r'File "([^"]+)", line (\d+)'
    file = F.when(F.col("content").rlike(py), F.regexp_extract("content", py, 1)).otherwise(F.regexp_extract("content", go, 1))
    at = F.when(F.col("content").rlike(py), F.regexp_extract("content", py, 2)).otherwise(F.regexp_extract("content", go, 2))
    return rows.select("id", "line", file.alias("file"), F.expr("1").alias("_one"), at.alias("at")).where("file <> ''").select("id", "line", "file", F.col("at").cast("long").alias("at"))


def unified_diff(changes: DataFrame, by: str, path: str, order: str, body: str) -> DataFrame:
    """(by, diff): the changes of one request, each under its two file marks, in order."""
    part = F.concat(F.lit("--- a/"), F.col(path), F.lit("\n+++ b/"), F.col(path), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return changes.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["p"]), "\n").alias("diff"))


def change_counters(changes: DataFrame, by: str, body: str, new: Column, deleted: Column, renamed: Column) -> DataFrame:
    """Files, added and removed lines (a first line is not counted), and files by tag: NEW before DEL before REN before MOD."""
    count = lambda mark: F.coalesce(F.regexp_count(body, F.lit("\\n" + mark)), F.lit(0))
    tag = F.when(new, "NEW").when(deleted, "DEL").when(renamed, "REN").otherwise("MOD")
    of = lambda t: F.sum((F.col("_tag") == t).cast("long")).alias(t.lower())
    rows = changes.withColumn("_tag", tag)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum(count(r"\+")).cast("long").alias("added"), F.sum(count("-")).cast("long").alias("removed"), *[of(t) for t in ("NEW", "DEL", "REN", "MOD")])


def diff_keywords(diff: Column, most: int = 5) -> Column:
    """Names of functions and packages and last parts of quoted paths in changed lines, in order of appearance by kind, at most
    five; without any, one default phrase."""
    changed = F.filter(F.split(diff, "\n"), lambda x: x.startswith("+") | x.startswith("-"))
    first = lambda p: F.filter(F.transform(changed, lambda x: F.regexp_extract(x, p, 1)), lambda x: x != "")
    paths = F.transform(F.filter(first(r'"([^"]+)"'), lambda x: F.contains(x, F.lit("/"))), lambda x: F.regexp_extract(x, "([^/]*)$", 1))
    found = F.slice(F.array_distinct(F.concat(first(r"func\s+(?:\([^)]+\)\s+)?(\w+)"), first(r"package\s+(\w+)"), paths)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("error handling")))  # fixed value: the default phrase


def impact(hits: DataFrame, symbol: str, repo: str, file: str, usage: str) -> DataFrame:
    """Per symbol and repository: hits, files and definitions, with the repository's place by hits."""
    r = hits.groupBy(symbol, repo).agg(F.count(F.lit(1)).alias("hits"), F.countDistinct(file).alias("files"), F.sum((F.col(usage) == "definition").cast("long")).alias("definitions"))
    return r.withColumn("place", F.row_number().over(Window.partitionBy(symbol).orderBy(F.col("hits").desc(), repo)).cast("long"))


def impact_totals(hits: DataFrame, repo: str, file: str, symbol: str) -> DataFrame:
    """Over all symbols of a change: symbols with hits, affected repositories and files."""
    return hits.agg(F.countDistinct(symbol).alias("symbols"), F.countDistinct(repo).alias("repos"), F.countDistinct(file).alias("files"))


def untested(functions: DataFrame, tests: DataFrame, name: str, *by: str) -> DataFrame:
    """Functions (by, name) for which tests (by, name) have neither the name itself nor the name after `test`, case aside."""
    covered = tests.select(*[F.col(c).alias(f"_{c}") for c in by], F.regexp_replace(F.lower(name), "^test_?", "").alias("_name")).distinct()
    return functions.join(covered, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lower(name) == F.col("_name")], "left_anti")
