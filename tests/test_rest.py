"""Collections, placeholders, credentials; the queries of plans/rest.py are held against SQL in test_engine.py."""

from orrery.functions import guards
from orrery.operators import search, workflow
from orrery.plans import rest  # noqa: F401 (registers its queries)
from orrery.sources import sinks
from pyspark.sql import functions as F


def test_collections(spark, tmp_path):
    at = str(tmp_path / "c")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    sinks.replace_collection(rows(1, 2), at, "a")
    sinks.replace_collection(rows(3).withColumn("y", F.lit("y")), at, "b c")
    sinks.replace_collection(rows(4), at, "a")
    assert sorted((r.collection, r.x, r.y) for r in sinks.unified(spark, at).collect()) == [("a", 4, None), ("b c", 3, "y")]
    assert sinks.drop_collection(spark, at, "a") and not sinks.drop_collection(spark, at, "a")
    assert [r.x for r in sinks.unified(spark, at).collect()] == [3]
    for n in (2, 1):
        sinks.snapshot_json(spark.range(n), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_placeholders():
    ctx = {"user": {"repo": "r", "n": 3, "none": None}, "s": "text"}
    got = workflow.resolve({"a": "{user.repo}-{user.n}", "b": "{user}", "c": ["{user.n}", {"k": "{s}"}], "d": {"e": "x{gone}y"}, "f": "{s.t}", "g": "a{s.t}", "h": "<{user.none}>", "i": 7}, ctx)
    assert got == {"a": "r-3", "b": ctx["user"], "c": [3, {"k": "{s}"}], "d": {"e": "xy"}, "f": "{s.t}", "g": "a{s.t}", "h": "<>", "i": 7}


def test_credentials(spark):
    texts = ["glpat-" + "a" * 20 + " xoxb-1", "glpat-" + "a" * 19, "ghp_" + "b" * 36, "https://hooks.slack.com/services/T/B", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(guards.credentials(F.col("t"))).collect()]
    assert got == [["gitlab", "slack"], [], ["github"], ["hook"], [], []]


def test_bm25_counts(spark):
    """Documents without words, repeated rows and null ids count in n and in the mean length; empty tokens never match."""
    docs = spark.createDataFrame([(1, ["a", "b", ""]), (2, ["a", "a", None]), (3, []), (4, None), (None, ["c"]), (None, ["c"])], "doc long, w array<string>")
    asked = spark.createDataFrame([(1, ["a", "", "z"]), (2, ["c"]), (3, [])], "query long, words array<string>")
    got = {(r["query"], r["doc"]): r["score"] for r in search.bm25(docs, "doc", F.col("w"), asked).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, None)}
    one = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "x"]), (3, ["y"]), (4, [])], "doc long, w array<string>")
    score = {r["doc"]: r["score"] for r in search.bm25(one, "doc", F.col("w"), asked).collect()}
    import math
    part = lambda tf, dl: math.log(1 + 2.5 / 2.5) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 1.5))
    assert {k: round(v, 9) for k, v in score.items()} == {1: round(part(1, 2), 9), 2: round(part(2, 3), 9)}
