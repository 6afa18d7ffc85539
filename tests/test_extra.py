"""Sources, sinks, guards, chunkers and streams against values made by hand."""

import json

from orrery.functions import guards
from orrery.operators import assistant, chunks, monitor, names
from orrery.plans import extra
from orrery.sources import files, sinks
from orrery.streaming import flows
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_source_files(spark, tmp_path):
    for name, text in {"a/x.py": "def f(): pass", "a/vendor/y.py": "no", "b.go": "package b", "c.txt": "no", "d.py": " \n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(p.rsplit("/", 1)[-1], lang) for p, lang, _ in files.source_files(spark, str(tmp_path)).collect()}
    assert got == {("x.py", "python"), ("b.go", "go")}


def test_repositories_and_configuration(spark):
    df = spark.createDataFrame([("/r/a/.git/config",), ("/r//a/.git",), ("/r/b/x.py",), ("/r/c/.git/HEAD",)], "path string")
    assert rows(files.repositories(df)) == [("/r/a", "a"), ("/r/c", "c")]
    assert files.base_paths("/a:/b", None) == ["/a", "/b"] and files.base_paths("/a, /b", None) == ["/a", "/b"] and files.base_paths(None, {"paths": ["/c"]}) == ["/c"]
    assert files.merged_config({"a": 1}, {"a": 2, "b": 3}, {"b": 4}) == {"a": 1, "b": 3}


def test_services(spark):
    units = spark.createDataFrame([("/e/pay-api.service", "[Service]\nWorkingDirectory=/srv/pay\nExecStart=/bin/x --y\nExecStart=/bin/z"), ("/e/mail.service", ""), ("/e/x.txt", "WorkingDirectory=/a")], "path string, content string")
    found = files.service_units(units)
    assert rows(found.where("working_directory is not null")) == [("pay-api", "/srv/pay", "/bin/x --y")]
    repos = spark.createDataFrame([(0, "mail-worker", "srv2/mail-worker"), (1, "pay", "srv/pay")], "place int, name string, local_path string")
    assert rows(names.map_services(found, repos)) == [("mail", "mail-worker"), ("pay-api", "pay")]


def test_json_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_json(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), path)
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert rows(files.json_lines(spark, path, "k string, n long", k="b")) == [("b", 2)]


def test_overrides(spark):
    tasks = spark.createDataFrame([(1, "a", "dev"), (2, "a", ""), (3, "b", None), (4, "c", None)], "task_id int, repo string, source_branch string")
    repos = spark.createDataFrame([("a", "/x", "main"), ("b", "/y", "main")], "repo string, base string, source_branch string")
    bases = spark.createDataFrame([("/x", "forced")], "base string, forced string")
    assert rows(assistant.with_overrides(tasks, repos, bases).select("task_id", "branch")) == [(1, "dev"), (2, "forced"), (3, "main"), (4, "master")]


def test_remote_addresses(spark):
    got = {r["id"]: (r["host"], r["path"]) for r in extra.remote_addresses(spark, "").collect()}
    host = "https://git.example.com"
    assert got == {1: (host, "group/sub/project"), 2: (host, "group/project"), 3: (host + ":8443", "group/project"), 4: ("http://git.example.com", "a/b"), 5: ("", "")}


def test_guards(spark):
    assert one(spark, guards.commit_message(F.col("t")), t=" a\x07b\nc ") == "ab\nc" and len(one(spark, guards.commit_message(F.col("t")), t="x" * 600)) == 500
    assert one(spark, guards.first_line_with(F.col("t"), F.col("n")), t="a\nFoo b\nfoo", n="foo B") == 2 and one(spark, guards.first_line_with(F.col("t"), F.col("n")), t="a", n="z") == 1
    assert one(spark, guards.code_fences(F.col("t")), t="x\n```py\na = 1\n```\n```\nb\n```") == ["a = 1", "b"]
    assert one(spark, guards.secret_file(F.col("t")), t="a/server.pem") and not one(spark, guards.secret_file(F.col("t")), t="a/pem.txt")
    assert json.loads(one(spark, guards.outer_json(F.col("t")), t='so {"a": {"b": 1}} end')) == {"a": {"b": 1}}
    assert one(spark, assistant.replace_word(F.col("t"), "a.b", "$1"), t="a.b axb a.bc") == "$1 axb a.bc"


def test_prompt(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "id int, question string")
    h = spark.createDataFrame([(1, t, f"q{t}", f"a{t}") for t in range(5)], "id int, turn int, q string, a string")
    c = spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "id int, rank int, block string")
    got = dict(rows(assistant.prompts(q, h, c)))
    assert got == {1: "Q: q2\nA: a2\n\nQ: q3\nA: a3\n\nQ: q4\nA: a4\n\nA\n\nB\n\nQuestion: why?", 2: "Question: how?"}


def test_incidents(spark):
    got = {r["id"]: r for r in extra.incident_parse(spark, "").collect()}
    assert (got[1]["error_type"], got[1]["error_message"], got[1]["functions"], got[1]["files"]) == ("panic", "nil pointer", "run", "/app/main.go|/app/store/store.go")
    assert (got[2]["error_type"], got[2]["error_message"], got[2]["files"]) == ("Error", "no", "a/b.py") and got[3]["error_type"] == ""


def test_chunks(spark):
    go = "package a\n\nfunc A() {\n\tx()\n}\n\nfunc B() {\n\tif y {\n\t}\n}\n"
    py = "import os\nclass C:\n    def f(self):\n        return 1\n\nx = 2\n"
    df = spark.createDataFrame([("g", "go", go), ("p", "python", py), ("r", "ruby", "a\n" * 5), ("n", "go", None)], "file string, language string, content string")
    got = rows(chunks.chunk(df, 5, 40).select("file", "start", "end"))
    assert got == [("g", 3, 5), ("g", 7, 10), ("p", 2, 2), ("p", 3, 5), ("r", 1, 6)]
    parent = rows(chunks.parents(chunks.chunk(df, 5, 40), df, 1).where("file = 'p' and chunk = 0"))
    assert parent == [("p", 0, "import os\nimport os\nclass C:\n    def f(self):")]
    assert chunks.stripped("a = 1 # x\n# y\n'''doc\nmore\n'''\nb", "python") == "a = 1 \nb"
    assert list(chunks.packed(["x" * 50, "y", "z"], 10, 4)) == [(0, 0, "lines"), (1, 2, "lines")]


def test_stream_limiter_equals_batch(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"{part}.json").write_text("".join(json.dumps({"u": i % 2, "s": 1000 + part * 40 + i * 3, "k": part * 10 + i}) + "\n" for i in range(8)))
    schema = "u long, s long, k long"
    batch = spark.read.schema(schema).json(str(tmp_path)).withColumn("ts", F.timestamp_seconds("s"))
    want = rows(monitor.admitted(batch, "u", "ts", "k", 2, 30).select("k", "admitted"))
    stream = flows.event_stream(spark, str(tmp_path), schema).withColumn("ts", F.timestamp_seconds("s"))
    q = flows.limiter(stream, "u", "ts", "k", 2, 30).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("limited").select("k", "admitted")) == want


def test_index_merge(spark, tmp_path):
    merge = flows.index_merge(str(tmp_path), ["file"])
    schema = "file string, text string, deleted boolean"
    merge(spark.createDataFrame([("a", "1", False), ("b", "1", None)], schema), 0)
    for _ in range(2):  # a batch that runs again
        merge(spark.createDataFrame([("a", "2", False), ("b", "1", True), ("c", "3", False)], schema), 1)
    assert rows(spark.read.parquet(str(tmp_path / "v=1")).select("file", "text")) == [("a", "2"), ("c", "3")]
