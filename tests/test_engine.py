"""The engine's own queries against their SQL in DuckDB at the smallest size, code parsers against values by hand."""

import math

import duckdb
import pytest

import __spark_entry__
from orrery.functions import text as T
from orrery.operators import catalog, code, monitor, search
from orrery.plans import fixtures as X
from orrery.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_symbols(spark):
    assert rows(registry.QUERIES["code_symbols"](spark, SF)) == sorted([(1, "GetUser"), (1, "Save"), (2, "save"), (2, "GetUser"), (2, "Store"), (3, "GetUser"), (3, "f"), (3, "Store")])


def test_imports(spark):
    assert rows(registry.QUERIES["code_imports"](spark, SF)) == sorted([(1, "fmt"), (2, "os.path"), (2, "json"), (3, "x"), (3, "fs"), (3, "lib/x")])


def test_diff_review_and_traces(spark):
    assert rows(registry.QUERIES["diff_symbols"](spark, SF)) == [(1, "NewHandler"), (2, "load")]
    diffs = X.frame(spark, X.DIFFS, "id int, diff string")
    assert rows(code.review(diffs).select("id", "line", "severity")) == [(1, 1, "medium"), (1, 2, "high"), (1, 3, "low")]
    assert rows(code.verdict(code.review(diffs))) == [(1, 3, "REQUEST_CHANGES")]
    assert rows(registry.QUERIES["trace_frames"](spark, SF).select("id", "file", "at")) == [(1, "/app/main.go", 42), (1, "/app/store/store.go", 7), (2, "a/b.py", 12)]


def test_dependencies(spark):
    got = {(r["ecosystem"], r["name"]): (r["uses"], r["repos"]) for r in registry.QUERIES["dependency_usage"](spark, SF).collect()}
    assert got[("python", "numpy")] == (2, "a,b") and got[("go", "golang.org/x/net")] == (1, "d") and ("node", "jest") in got and len(got) == 10


def test_limiter_ignores_rejected_requests(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 20, 3), (1, 61, 4), (1, 62, 5), (2, 0, 6)], "u long, s long, k long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["k"]: r["admitted"] for r in monitor.admitted(df, "u", "ts", "k", 2, 60).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_single_hit_and_ties_normalise_to_zero(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 2.0), (2, 2, 2.0)], "query int, doc int, score double")
    assert [r[0] for r in df.select(search.min_max(df, "score")).collect()] == [0.0, 0.0, 0.0]


def test_tokens_come_three_times(spark):
    got = spark.createDataFrame([("getUser my_name plain",)], "t string").select(T.tokens(F.col("t"))).first()[0]
    assert sorted(got) == sorted(["getuser", "getuser", "get", "user", "name", "plain", "plain", "plain"])


def test_even_split_gives_the_last_part_the_rest(spark):
    got = [r[0] for r in spark.range(7).select(catalog.split_evenly(None, "id", 3)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 2]


def test_entry(spark):
    assert __spark_entry__.FLAGSHIP if hasattr(__spark_entry__, "FLAGSHIP") else registry.FLAGSHIP in __spark_entry__.queries()
