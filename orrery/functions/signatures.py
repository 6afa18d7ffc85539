"""Signatures, documentation and imports of code, and the text made of them for indexing, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import strip

# The patterns by language, in order; ^ and $ are bounds of lines.
SIGNATURES = {
    "python": [r"^(\s*def\s+\w+\s*\([^)]*\)(?:\s*->.*?)?)\s*:", r"^(\s*class\s+\w+(?:\([^)]*\))?)\s*:", r"^(\s*async\s+def\s+\w+\s*\([^)]*\)(?:\s*->.*?)?)\s*:"],
    "go": [r"^(func\s+(?:\([^)]+\)\s+)?\w+\s*\([^)]*\)(?:\s*(?:\([^)]*\)|\w+))?)\s*\{", r"^(type\s+\w+\s+(?:struct|interface))\s*\{"],
    "javascript": [
        r"^(\s*(?:export\s+)?(?:async\s+)?function\s+\w+\s*\([^)]*\))", r"^(\s*(?:export\s+)?class\s+\w+(?:\s+extends\s+\w+)?)",
        r"^(\s*(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>)",
    ],
    "typescript": [
        r"^(\s*(?:export\s+)?(?:async\s+)?function\s+\w+\s*(?:<[^>]+>)?\s*\([^)]*\)(?:\s*:\s*\w+)?)",
        r"^(\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+(?:<[^>]+>)?(?:\s+(?:extends|implements)\s+\w+)?)", r"^(\s*(?:export\s+)?interface\s+\w+(?:<[^>]+>)?)",
    ],
}
IMPORTS = {
    "python": [r"^import\s+(.+)$", r"^from\s+(\S+)\s+import\s+(.+)$"],
    "go": [r'import\s+"([^"]+)"', r'import\s+\w+\s+"([^"]+)"'],
    "javascript": [r"import\s+.*?from\s+['\"]([^'\"]+)['\"]", r"(?:const|let|var)\s+.*?=\s*require\(['\"]([^'\"]+)['\"]\)"],
    "typescript": [r"import\s+.*?from\s+['\"]([^'\"]+)['\"]"],
}
DOCSTRING = r"""(?:def|class)\s+\w+[^:]*:\s*\n\s*(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')"""
BLOCK_COMMENT = r"/\*\*([\s\S]*?)\*/\s*\n\s*(?:func|type|class|export|pub)"
BLOCK_LANGUAGES = ["go", "java", "javascript", "typescript", "rust"]

def _by_language(language: Column, found: dict[str, Column]) -> Column:
    none = F.array().cast("array<string>")
    return reduce(lambda out, k: F.when(language == k, found[k]).otherwise(out), found, none)


def _all(code: Column, pattern: str, group: int = 1) -> Column:
    """What a group takes in each match, stripped; only a newline ends a line."""
    return F.transform(F.regexp_extract_all(code, F.lit("(?md)" + pattern), F.lit(group)), strip)


def _some(found: Column) -> Column:
    return F.filter(found, lambda x: x != "")


def signatures(code: Column, language: Column) -> Column:
    """Heads of functions and types, pattern after pattern; none for other languages, null for null code."""
    return _by_language(language, {k: _some(F.concat(*[_all(code, p) for p in ps])) for k, ps in SIGNATURES.items()})


def imports(code: Column, language: Column) -> Column:
    """Imported names; what follows "from" and "import" in one line come one after the other."""
    pair = lambda p: F.flatten(F.zip_with(_all(code, p, 1), _all(code, p, 2), lambda a, b: _some(F.array(a, b))))
    each = lambda p: pair(p) if p.startswith("^from") else _all(code, p)
    return _by_language(language, {k: F.concat(*map(each, ps)) for k, ps in IMPORTS.items()})


def docstrings(code: Column, language: Column) -> Column:
    """Python's first strings of functions and classes without their quotes; block comments above definitions without their stars."""
    quoted = F.transform(_all(code, DOCSTRING), lambda x: F.regexp_replace(x, r"""^["']+|["']+$""", ""))
    starred = F.transform(F.regexp_extract_all(code, F.lit(BLOCK_COMMENT), F.lit(1)), lambda x: strip(F.regexp_replace(x, r"(?md)^\s*\*\s?", "")))
    return _by_language(language, {"python": _some(quoted)} | dict.fromkeys(BLOCK_LANGUAGES, _some(starred)))


def enriched(code: Column, heads: Column, documentation: Column) -> Column:
    """The code, then its signatures and its documentation, each under a heading, where there are any."""
    part = lambda name, found: F.when(F.size(found) > 0, F.concat(F.lit(f"\n--- {name} ---\n"), F.array_join(found, "\n")))
    return F.concat_ws("\n", code, part("Signatures", heads), part("Documentation", documentation))
