"""Vectors, names, sketches, state and significance against brute force, hand values and restarts."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import evaluate, monitor, names, sketches, vectors
from orrery.plans import scale
from orrery.streaming import state


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def crowd(spark):
    """Vectors around 30 centres, exact copies and a null."""
    r = np.random.default_rng(3)
    v = unit(r.standard_normal((30, 16)).repeat(40, axis=0) + 0.35 * r.standard_normal((1200, 16)))
    v[50:60] = v[49]
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (5000, None)], "id long, v array<double>").cache()
    return v, df


def best(v, q, k):
    cos = v @ v[q]
    return sorted(range(len(v)), key=lambda i: (-round(cos[i], 9), i))[:k]


def test_cells_are_exact_and_probes_alone_nearly_so(crowd):
    v, df = crowd
    q = df.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("asked"))
    want = {i: best(v, i, 10) for i in range(0, 1200, 100)}

    def got(hits):
        out = {}
        for r in sorted(hits.collect(), key=lambda r: r["rank"]):
            out.setdefault(r["query"], []).append(r["doc"])
        out.pop(5000, None)
        return out

    assert got(vectors.knn(df, "id", "v", q, 10)) == want
    assert got(vectors.knn(df, "id", "v", q, 10, block=3)) == want
    assert got(vectors.knn_cells(df, "id", "v", q, 10, 24, 3)) == want
    near = got(vectors.knn_cells(df, "id", "v", q, 10, 24, 3, exact=False))
    assert sum(len(set(near[i]) & set(want[i])) for i in want) / (10 * len(want)) >= 0.9
    assert vectors.knn_cells(df.limit(0), "id", "v", q, 10).count() == 0
    plan = vectors.knn_cells(df, "id", "v", q, 10, 24, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_large_cells_meet_in_blocks(crowd, monkeypatch):
    v, df = crowd
    monkeypatch.setattr(vectors, "ROWS", 50)
    q = df.where("id < 130").select(F.col("id").alias("query"), F.col("v").alias("asked"))
    got = {(r["query"], r["doc"]) for r in vectors.knn_cells(df, "id", "v", q, 5, 4, 1).collect()}
    assert got == {(i, j) for i in range(130) for j in best(v, i, 5)}


def test_banded_pairs(crowd):
    v, df = crowd
    of = {i: 49 if 49 <= i < 60 else i for i in range(1200)}
    cos = v @ v.T
    want = {(i, j) for i in range(1200) for j in range(i + 1, 1200) if of[i] == i and of[j] == j and cos[i, j] >= 0.95}
    got = vectors.banded_pairs(df, "id", "v", 0.95, bits=8)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) > 20
    assert {r["id"]: r["class"] for r in vectors.classes(df, "id", "v").collect()} == of
    files = df.select("id", (F.col("id") % 3).cast("string").alias("file"))
    for r in vectors.best_of_file_pairs(got, files).collect():
        own = [(-round(cos[i, j], 9), *((i, j) if i % 3 < j % 3 else (j, i))) for i, j in want if {str(i % 3), str(j % 3)} == {r["file_a"], r["file_b"]} and i % 3 != j % 3]
        assert (r["a"], r["b"]) == min(own)[1:] and r["file_a"] < r["file_b"]


def test_a_hundred_thousand_names(spark):
    r = random.Random(4)
    table = spark.range(100_000).select(F.concat(F.lit("service-"), F.md5(F.col("id").cast("string")).substr(1, 8), F.lit("-api")).alias("needle")).cache()
    some = [x[0] for x in table.orderBy("needle").limit(30).collect()]
    texts = [(i, " ".join(r.choice(["see", "the", "service-", "api", r.choice(some)]) for _ in range(12))) for i in range(60)] + [(90, None), (91, ""), (92, "no name")]
    got = {(x["id"], x["needle"]) for x in names.contained(spark.createDataFrame(texts, "id long, text string"), table).collect()}
    assert got == {(i, n) for i, t in texts for n in some if t and n in t} and len(got) > 30


def test_sketches_merge(spark):
    e = spark.range(20_000).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"), (F.col("id") % 5000).alias("u"), F.timestamp_seconds(F.col("id") * 3).alias("ts"))
    spans = sketches.by_span(e, "ts", ["k"], "v", "u")
    assert spans.select("span").distinct().count() > 10
    for r in sketches.read(sketches.merged(spans, ["k"]), {"p50": 0.5, "p95": 0.95}).collect():
        own = sorted(x["v"] for x in e.where(F.col("k") == r["k"]).collect())
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            assert abs(sum(x <= r[name] for x in own) / len(own) - q) <= sketches.RANK_ERROR
        assert r["n"] == 10_000 and abs(r["distinct"] / 2500 - 1) <= sketches.USERS_ERROR


def test_sketches_of_a_stream(spark, tmp_path):
    e = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"), (F.col("id") % 70).alias("u"), F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = sketches.by_span(rows, "ts", ["k"], "v", "u").writeStream.format("memory").queryName("spans").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = sketches.read(sketches.merged(spark.table("spans"), ["k"]), {"p50": 0.5}).first()
    assert r["n"] == 3000 and abs(r["p50"] - 1500) <= 3000 * sketches.RANK_ERROR and abs(r["distinct"] / 70 - 1) <= sketches.USERS_ERROR


@pytest.fixture
def store(spark):
    for k, v in state.STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in state.STORE:
        spark.conf.unset(k)


def requests(spark):
    return spark.createDataFrame([(f"u{i % 3}", i, f"2024-01-01 00:{i // 6:02d}:{i % 6 * 10:02d}") for i in range(90)], "u string, k long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def run(df, path, name, rows):
    """Runs a stream until its output has that many rows in all; queries with timers by the clock never end by themselves."""
    spark = df.sparkSession
    q = df.writeStream.format("parquet").option("path", f"{path}/out-{name}").option("checkpointLocation", f"{path}/checkpoint-{name}").outputMode("append").start()
    end = time.time() + 120
    try:
        while time.time() < end and q.exception() is None:
            if any(x["numInputRows"] for x in q.recentProgress) and spark.read.parquet(f"{path}/out-{name}").count() >= rows:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert q.exception() is None


def test_limiter_survives_a_restart(spark, tmp_path, store):
    rows = requests(spark)
    want = sorted((r["k"], r["admitted"]) for r in monitor.admitted(rows, "u", "ts", "k", 2, 90).collect())
    stream = lambda: state.limited(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "u", "ts", "k", 2, 90)
    for part, n in (("k < 40", 40), ("k >= 40", 90)):  # each a run of its own from the checkpoint of the one before
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stream(), tmp_path, "limited", n)
    assert sorted((r["k"], r["admitted"]) for r in spark.read.parquet(f"{tmp_path}/out-limited").collect()) == want
    assert 0 < sum(ok for _, ok in want) < len(want)


def test_cache_entries_leave(spark, tmp_path, store):
    rows = [(1, "a", "2024-01-01 00:00:00", None), (2, "a", "2024-01-01 00:01:00", "one"), (3, "a", "2024-01-01 00:01:00", None), (4, "a", "2024-01-01 00:05:59", None), (5, "a", "2024-01-01 00:06:00", None), (6, "b", "2024-01-01 00:02:00", None)]
    df = spark.createDataFrame(rows, "id long, key string, t string, answer string")
    want = [(1, None, False), (3, "one", True), (4, "one", True), (5, None, False), (6, None, False)]
    df.where("id < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: state.answered(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 300)
    run(stream(), tmp_path, "answered", 2)
    df.where("id >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(stream(), tmp_path, "answered", 5)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out-answered").collect())) == want


def test_admitted_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["k"]: r["admitted"] for r in monitor.admitted(requests(spark), "u", "ts", "k", 2, 90).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held, want = {}, {}
    for i in range(90):
        times = [t for t in held.get(i % 3, []) if t > i * 10 - 90]
        want[i] = len(times) < 2
        held[i % 3] = times + [i * 10] * want[i]
    assert got == want


def test_p_values(spark):
    """Closed forms for 1, 2 and 4 degrees of freedom; the normal distribution for many."""
    forms = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 4: lambda t: 1 - 0.75 * (t / math.sqrt(1 + t * t / 4)) * (1 - t * t / (12 * (1 + t * t / 4)))}
    cases = [(t, df) for df in forms for t in (0.0, 0.1, 1.0, 2.5, 12.0)]
    got = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, df double").select("t", "df", evaluate.p_value(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert abs(r["p"] - forms[int(r["df"])](r["t"])) < 1e-9, r
    many = spark.createDataFrame([(1.96, 4e6)], "t double, df double").select(evaluate.p_value(F.col("t"), F.col("df"))).first()[0]
    assert abs(many - math.erfc(1.96 / math.sqrt(2))) < 1e-6
    arms = spark.createDataFrame([("a", x, 1.0) for x in (1.0, 2.0, 3.0, 4.0)] + [("b", x, 2.0) for x in (2.0, 4.0, 6.0, 8.0)], "arm string, v double, c double")
    r = evaluate.significance(arms, "arm", "v", "c").first()
    assert abs(r["t"] - math.sqrt(3)) < 1e-12 and r["df"] == 6.0 and abs(r["welch_df"] - (25 / 12) ** 2 / ((25 + 400) / 144 / 3 * 1)) < 1e-9 and (r["cost_a"], r["cost_b"]) == (1.0, 2.0)
    x = 6 / (6 + 3)
    assert abs(r["p"] - (1 - math.sqrt(1 - x) * (1 + x / 2 + 3 * x * x / 8))) < 1e-9  # the closed form for 6 degrees of freedom
    assert evaluate.significance(arms.where("v > 7"), "arm", "v", "c").first()["p"] is None


def test_best_of_files_needs_no_list_of_pairs(crowd, spark, monkeypatch):
    v, df = crowd
    cos, of = v @ v.T, {i: 49 if 49 <= i < 60 else i for i in range(1200)}
    files = df.select("id", (F.col("id") % 7).cast("string").alias("file"))
    want = {}
    for i in range(1200):
        for j in range(1200):
            if i % 7 < j % 7 and of[i] == i and of[j] == j and cos[i, j] >= 0.9:
                key = (str(i % 7), str(j % 7))
                want[key] = min(want.get(key, (9,)), (-round(cos[i, j], 9), i, j))
    met = []
    monkeypatch.setattr(vectors, "banded_pairs", lambda *a, **k: met.append(a))
    for steps in (vectors.STEPS, ((0.95, 12),), ()):
        monkeypatch.setattr(vectors, "STEPS", steps)
        got = vectors.best_of_files(df, "id", "v", files, 0.9).collect()
        assert {(r["file_a"], r["file_b"]): (-round(r["cos"], 9), r["a"], r["b"]) for r in got} == want and len(want) == 21
    assert not met


def test_hashed_rows_of_one_key_count_together(spark):
    rows = spark.createDataFrame([(1, ["ab", "cd"]), (1, ["ab"]), (2, ["ab", "ab", "cd"]), (3, []), (4, None)], "id long, w array<string>")
    got = {r["key"]: r["vector"] for r in vectors.hashed(rows, "id", F.col("w")).collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and len(got[1]) == 64
    plan = vectors.hashed(rows, "id", F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row a word


def test_linked_files_leave_no_link_out(crowd, spark, monkeypatch):
    """Every pair of rows of two files counts, copies too, whatever the blocks and what is held at once."""
    v, df = crowd
    cos = np.round(v @ v.T, 9)
    files = df.select("id", F.when(F.col("id") < 1190, (F.col("id") % 7).cast("string")).alias("file"))
    want = {}
    for i in range(1190):
        for j in np.flatnonzero(cos[i, :1190] >= 0.9).tolist():
            if i % 7 < j % 7:
                n, best = want.get((str(i % 7), str(j % 7)), (0, (9,)))
                want[str(i % 7), str(j % 7)] = (n + 1, min(best, (-cos[i, j], i, j)))
    assert len(want) == 21 and want["0", "1"][1][1:] == (49, 50)  # a copy in another file
    for block, held in ((vectors.BLOCK, vectors.HELD), (300, 1 << 14)):
        monkeypatch.setattr(vectors, "HELD", held)
        got = vectors.linked_files(df, "id", "v", files.union(files.limit(50)), 0.9, block).collect()
        assert {(r["file_a"], r["file_b"]): (r["links"], (-round(r["cos"], 9), r["a"], r["b"])) for r in got} == want and len(got) == 21
    assert vectors.linked_files(df.limit(0), "id", "v", files, 0.9).count() == 0


def test_linked_files_at_the_threshold(spark):
    a, b, c = (np.array(x) / math.sqrt(10) for x in ((3, 1, 0), (3, 0, 1), (3, 0.9999, 0.0141418)))
    df = spark.createDataFrame([("x", a.tolist()), ("y", b.tolist()), ("z", c.tolist())], "id string, v array<double>")
    assert a @ b < 0.9 <= round(a @ b, 9)  # 0.9 but for rounding
    got = vectors.linked_files(df, "id", "v", df.select("id", F.col("id").alias("file")), 0.9).collect()
    assert {(r["file_a"], r["file_b"], r["links"], r["a"], r["b"]) for r in got} == {("x", "y", 1, "x", "y"), ("x", "z", 1, "x", "z"), ("y", "z", 1, "y", "z")}


def test_similar_files_see_copies_in_other_sources(spark, tmp_path):
    one, two = "alpha beta gamma delta " * 5, "alpha beta gamma delta " * 5 + "epsilon"
    rows = [(1, one, "a"), (2, one, "b"), (3, two, "c"), (4, one, "b"), (5, "quite other words", "d"), (6, "", "a"), (7, None, "b"), (8, one, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["file_a"], r["file_b"]): (r["links"], r["a"], r["b"]) for r in scale.similar_files(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (2, 1, 2), ("a", "c"): (1, 1, 3), ("b", "c"): (2, 2, 3)}
