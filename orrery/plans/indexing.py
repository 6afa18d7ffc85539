"""Queries of code prepared for indexing and of documentation digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signatures as S
from ..operators import digest
from . import fixtures as X
from .registry import query

SOURCES = [
    (1, "go", 'package a\n\nimport "fmt"\nimport x "b/c"\n\n/**\n * Says it.\n *\n */\nfunc (s *T) Say(a int) error {\n\treturn nil\n}\ntype T struct {\n}\n'),
    (2, "python", 'import os\nfrom a.b import c, d\n\nclass K(Base):\n    """Holds\n    things."""\n\n    def f(self, x) -> int:\n        \'\'\'Gives x.\'\'\'\n        return x\n\n    async def g(self):\n        return 1\n'),
    (3, "javascript", "import q from 'lib/q'\nconst y = require(\"fs\")\n/** Runs. */\nexport class R extends Q {\n}\nconst h = async (a, b) => a\nexport async function go(x) {\n}\n"),
    (4, "typescript", "import { z } from 'z'\nexport interface I<T> {\n}\nexport abstract class C<T> extends D {\n}\nfunction f<T>(a: T): string {\n}\n"),
    (5, "java", "/**\n * Main.\n */\nclass Main {\n}\n"), (6, "cobol", "/** x */\nclass y"), (7, "python", ""),
]
HITS = [
    ("shop", "main", 1, "main.go", "package main\nfunc main() {\n}"), ("shop", "main", 2, "db.go", "package db\nfunc open() {\n}"), ("shop", "main", 6, "late.go", "package late\nfunc init() {\n}"),
    ("shop", "handlers", 1, "routes.go", 'package web\n\tr.GET("/a", a)\n\tx := 1\n\tr.POST("/b", b)'), ("shop", "models", 1, "db.go", "type A struct {\n}\ntype B  struct{\n}"),
    ("shop", "configs", 1, "env.go", "package main\nvar X = 1"), ("lib", "configs", 2, "", ""), ("lib", "other", 1, "z.go", "package z"),
]


def _sql_found(patterns: dict[str, list[str]], keep: str) -> str:
    q = lambda p: "'(?m)" + p.replace("'", "''") + "'"
    one = lambda p: f"list_transform(regexp_extract_all(code, {q(p)}, 1), lambda x: {SQL_STRIP})"
    two = lambda p: f"flatten(list_transform(list_zip(regexp_extract_all(code, {q(p)}, 1), regexp_extract_all(code, {q(p)}, 2)), lambda x: [trim(x[1]), trim(x[2])]))"
    each = lambda p: two(p) if p.startswith("^from") else one(p)
    whens = " ".join(f"when '{k}' then list_filter(flatten([{', '.join(map(each, ps))}]), lambda x: x <> '')" for k, ps in patterns.items())
    return f"array_to_string(coalesce(case language {whens} end, []), '{keep}')"


SQL_STRIP = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
SQL_STARS = r"regexp_replace(regexp_replace(x, '(?m)^\s*\*\s?', '', 'g'), '^\s+|\s+$', '', 'g')"
SQL_QUOTES = r"""regexp_replace(x, '^["'']+|["'']+$', '', 'g')"""
SQL_DOCS = (
    "array_to_string(list_filter(case when language = 'python' then list_transform(regexp_extract_all(code, '" + S.DOCSTRING.replace("'", "''") + f"', 1), lambda x: {SQL_QUOTES})"
    + " when language in ('go', 'java', 'javascript', 'typescript', 'rust') then list_transform(regexp_extract_all(code, '" + S.BLOCK_COMMENT + f"', 1), lambda x: {SQL_STARS}) else [] end, lambda x: x <> ''), chr(10))"
)
SQL_PARTS = f"select id, code, {_sql_found(S.SIGNATURES, chr(10))} as signatures, {SQL_DOCS} as docstrings, {_sql_found(S.IMPORTS, ' ')} as imports from {X.values(SOURCES, 'id', 'language', 'code')}"


@query(f"select id, signatures, docstrings, imports, code || case when signatures <> '' then chr(10) || chr(10) || '--- Signatures ---' || chr(10) || signatures else '' end || case when docstrings <> '' then chr(10) || chr(10) || '--- Documentation ---' || chr(10) || docstrings else '' end as enriched_text from ({SQL_PARTS})")
def enriched_code(spark, d):
    code, language = F.col("code"), F.col("language")
    rows = X.frame(spark, SOURCES, "id int, language string, code string")
    rows = rows.select("id", "code", S.signatures(code, language).alias("s"), S.docstrings(code, language).alias("d"), S.imports(code, language).alias("i"))
    return rows.select("id", F.array_join("s", "\n").alias("signatures"), F.array_join("d", "\n").alias("docstrings"), F.array_join("i", " ").alias("imports"), S.enriched(code, F.col("s"), F.col("d")).alias("enriched_text"))


@query()
def docs_digest(spark, d):
    return digest.docs_digest(X.frame(spark, HITS, "repo string, search string, rank int, file string, code string"))
