"""Queries of plans/more.py against SQL, and their operators on hand-made rows."""

import os
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import catalog, code, evaluate, monitor, names, search
from orrery.plans import extra, more, registry  # noqa: F401 (extra registers its queries)

SF = "/root/testdata/sf0.001"
NAMES = [k for k, f in registry.QUERIES.items() if f.__module__ == more.__name__ and k in registry.ORACLE]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", [*NAMES, "graph_hops", "semantic_cache", "latency_percentiles", "csat", "drift_check", "progressive_cutoff"])
def test_query_equals_sql(spark, duck, name):
    flat = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in r) for r in rows), key=str)
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert flat(got.select(*columns).collect()) == flat(want.select(*columns).fetchall())


def test_search_cache_equals_a_fold_by_hand(spark):
    rows = registry.events(spark, SF).orderBy("ts", "event_id").collect()
    stored, want = {}, {}
    for r in rows:
        space = more.SPACES.get(r["event_type"], "other")
        key, t = (space, r["user_id"]), r["ts"].timestamp()
        hit = key in stored and t - stored[key] < monitor.TTL.get(space, monitor.TTL_DEFAULT)
        if not hit:
            stored[key] = t
        n = want.setdefault(space, [0, 0])
        n[0 if hit else 1] += 1
    got = {r["namespace"]: [r["hits"], r["misses"]] for r in more.search_cache(spark, SF).collect()}
    assert got == want and any(n[0] for n in want.values())


def test_uuid5_and_stamps(spark):
    rows = ["a:1", "", "é"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(T.uuid5(more.UUID, F.col("x"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(more.UUID), x)) for x in rows]
    lines = spark.createDataFrame([("2024-01-02 03:04:05 INFO x",), ("no time",), (None,)], "l string").select(T.stamped(F.col("l")).alias("t")).collect()
    assert lines[0]["t"].isoformat() == "2024-01-02T03:04:05" and lines[1]["t"] is None and lines[2]["t"] is None


def test_mentions(spark):
    known = spark.createDataFrame([(n,) for n in ("order-service", "order", "user_api", "pay gate", None)], "name string")
    asks = [("how does order-service work", "order-service"), ("the ORDER SERVICE here", "order-service"), ("an order", "order"), ("user-api docs", "user_api"), ("what is PAY_GATE", "pay gate"), ("nothing", None), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(asks)], "id int, text string")
    assert [r["name"] for r in names.mentioned(df, known).orderBy("id").collect()] == [w for _, w in asks]
    assert names.mentioned(df, known.limit(0)).where("name is not null").count() == 0 and names.mentioned(df, known.limit(0)).count() == len(asks)


def test_keyword_boost_normalises_the_repository(spark):
    df = spark.createDataFrame([(["user", "api", "user", "of"], "User api", "src/user.py", "user-api_x")], "w array<string>, code string, file string, repo string")
    assert round(df.select(search.keyword_boost(F.col("w"), F.col("code"), F.col("file"), F.col("repo"), F.lit(1.0))).first()[0], 6) == 2.8


def test_in_result_statistics_differ_by_query(spark):
    rows = [(1, 1, 0.1, ["a", "b"], ["a"]), (1, 2, 0.2, ["b"], ["a"]), (2, 1, 0.3, ["a"], ["a"]), (3, 9, 0.0, [], ["a"])]
    df = spark.createDataFrame(rows, "query int, doc int, distance double, w array<string>, asked array<string>")
    got = {(r["query"], r["doc"]): r for r in search.hybrid_within(df, F.col("w"), F.col("asked"), F.lit(0.3)).collect()}
    assert len(got) == 4 and got[1, 2]["bm25_score"] == 0 and got[3, 9]["vector_score"] == 1 / 3  # a zero distance counts as none given


def test_evaluation_edges(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (2, 5, 1)], "query int, doc int, rank int")
    got = {r["query"]: r for r in evaluate.at_k(ranked, spark.createDataFrame([(1, 5)], "query int, doc int")).collect()}
    assert got[1]["p1"] == got[1]["ndcg1"] == 1 and got[2]["p1"] == got[2]["r1"] == got[2]["ndcg3"] == 0
    df = spark.createDataFrame([(["the", "cache"], ["what", "cache"]), (["the"], ["cache"])], "a array<string>, q array<string>")
    assert [r[0] for r in df.select(evaluate.relevance(F.col("a"), F.col("q"))).collect()] == [1.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([(0.8,), (0.7,), (0.6,), (0.59,)], "s double").select(evaluate.rating(F.col("s"))).collect()] == ["Excellent", "Good", "Fair", "Needs Improvement"]


def test_diffs_and_coverage(spark):
    diff = '+func (s *S) Save(x int)\n+import "github.com/a/b"\n-package old\n context func no()'
    df = spark.createDataFrame([(1, diff), (2, "plain"), (3, None)], "id int, d string").orderBy("id")
    assert [r[0] for r in df.select(code.diff_keywords(F.col("d"))).collect()][:2] == [["Save", "old", "b"], ["error handling"]]
    f = spark.createDataFrame([("Save",), ("Load",), ("drop",)], "name string")
    t = spark.createDataFrame([("TestSave",), ("test_drop",)], "name string")
    assert [r[0] for r in code.untested(f, t, "name").collect()] == ["Load"]
    c = spark.createDataFrame([(1, 2, "b", "x\n+y\n-z"), (1, 1, "a", "+first"), (1, 3, "c", None)], "mr int, o int, p string, body string")
    got = code.change_counters(c, "mr", "body", F.col("o") == 1, F.col("o") == 1, F.col("o") == 3).first()
    assert (got["files"], got["added"], got["removed"], got["new"], got["del"], got["ren"], got["mod"]) == (3, 1, 1, 1, 0, 1, 1)
    assert code.unified_diff(c, "mr", "p", "o", "body").first()["diff"].startswith("--- a/a\n+++ b/a\n+first\n--- a/b")


def test_percentiles_of_repeated_values(spark):
    rows = [("a", 1.0)] * 90 + [("a", 5.0)] * 10 + [("a", None), ("b", None)]
    r = {x["k"]: x for x in monitor.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (r["a"]["p50"], r["a"]["p95"], r["a"]["n"], r["a"]["mean"]) == (1.0, 5.0, 100, 1.4) and "b" not in r


def test_catalog_pieces(spark):
    df = spark.createDataFrame([("r", "node"), ("r", "go"), ("q", "x"), ("q", None)], "repo string, lang string")
    assert {r["repo"]: r["l"] for r in df.groupBy("repo").agg(catalog.precedence({"go": 0, "python": 1, "node": 2}, "lang").alias("l")).collect()}["r"] == "go"
