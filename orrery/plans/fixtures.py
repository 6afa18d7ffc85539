"""Small inline tables of code, diffs, traces and manifests, as rows for Spark and as VALUES for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODE = [
    (1, "GO", 'package main\nimport "fmt"\nfunc GetUser(id int) string {\n\treturn fmt.Sprint(id)\n}\nfunc (s *Store) Save(x int) {\n\tGetUser(x)\n}\n'),
    (2, "PY", "from os.path import join\nimport json\nclass Store(Base):\n    def save(self, x):\n        return json.dumps(x)\ndef GetUser(a):\n    return a\n"),
    (3, "JS", "import x from 'lib/x'\nconst f = (a) => a\nfunction GetUser(id) {\n  return f(id)\n}\nexport class Store {\n}\nconst y = require('fs')\n"),
    (4, "RB", "def nothing\nend\n"),
    (5, "PY", ""),
]
DIFFS = [
    (1, "--- a/x.go\n+++ b/x.go\n context line\n+func NewHandler(w int) {\n+\tfmt.Println(w)\n+\tpassword = \"abc\"\n+\t// TODO later\n-old line\n"),
    (2, "+def load(a):\n+    return a\n-def gone():\n"),
    (3, " nothing added\n"),
]
TRACES = [(1, 'panic: nil pointer\nmain.run()\n\t/app/main.go:42 +0x1\n\t/app/store/store.go:7 +0x2'), (2, 'Traceback:\n  File "a/b.py", line 12, in f\nValueError: no'), (3, "nothing here")]
QUERIES = [
    (1, "getUserById function"), (2, "how does the authentication flow work in this system"), (3, "find database connection error handling"),
    (4, "import redis"), (5, "who calls save_user"), (6, ""), (7, "what is similar to http.Get and os.path.join"), (8, "payment retries"),
]
REQUIREMENTS = [("a", "numpy>=1.2\n# note\n-r other.txt\npandas == 2.0\nrequests\n"), ("b", "numpy\nflask~=3.0\n")]
PACKAGES = [("c", '{"dependencies": {"react": "^18", "left-pad": "1.0"}, "devDependencies": {"jest": "29"}}')]
MODULES = [("d", "module x\nrequire github.com/a/b v1.2.3\nrequire (\n\tgithub.com/c/d v0.1.0 // indirect\n\tgolang.org/x/net v0.5.0\n)\n")]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], *names: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({', '.join(names)})"
