"""Prepared code, digests, an expiring cache, polling."""

from datetime import datetime, timezone

from orrery.operators import assistant
from orrery.plans import indexing
from orrery.streaming import upkeep
from pyspark.sql import functions as F


def test_enriched_code(spark):
    got = {r["id"]: r for r in indexing.enriched_code(spark, None).collect()}
    assert got[1]["signatures"] == "func (s *T) Say(a int) error\ntype T struct" and got[1]["docstrings"] == "Says it." and got[1]["imports"] == "fmt b/c"
    assert got[2]["signatures"].split("\n") == ["def f(self, x) -> int", "class K(Base)", "async def g(self)"] and got[2]["imports"] == "os a.b c, d"
    assert got[2]["docstrings"] == "Holds\n    things.\nGives x."
    assert got[5]["docstrings"] == "Main." and got[6]["docstrings"] == got[6]["signatures"] == "" and got[7]["enriched_text"] == ""
    assert got[5]["enriched_text"].endswith("\n}\n\n\n--- Documentation ---\nMain.")


def test_digest(spark):
    got = {r["repo"]: r for r in indexing.docs_digest(spark, None).collect()}
    r = got["shop"]
    assert (r["files_found"], r["packages"], r["key_files"]) == (4, ["main", "db", "web"], ["main.go", "db.go", "routes.go", "env.go"])
    assert [e["file"] for e in r["entry_points"]] == ["main.go"] and [e["line"] for e in r["endpoints"]] == ['r.GET("/a", a)', 'r.POST("/b", b)']
    assert [m["name"] for m in r["models"]] == ["A", "B"]
    assert r["markdown"] == "\n".join([
        "# shop\n", "## Overview\n", "- **Packages**: main, db, web", "- **Files**: 4 indexed", "", "## Entry Points\n", "- `main.go`", "",
        "## API Endpoints\n", '- `r.GET("/a", a)`  (routes.go)', '- `r.POST("/b", b)`  (routes.go)', "", "## Data Models\n", "- `A` (db.go)", "- `B` (db.go)", "",
    ])
    assert got["lib"]["files_found"] == 1 and got["lib"]["packages"] == [] and "##" not in got["lib"]["markdown"].replace("## Overview", "")


def test_cache_expires(spark, tmp_path):
    at = str(tmp_path / "cache")
    utc = lambda *v: datetime(2024, 1, *v, tzinfo=timezone.utc)
    rows = lambda *v: spark.createDataFrame(list(v), "key string, answer string, stored_at timestamp, expires_at timestamp")
    store = upkeep.cache_writer(at)
    store(rows(("a", "old", utc(1), utc(2, 12)), ("b", "x", utc(1), utc(1, 5)), ("c", "y", utc(1), None)), 0)
    for _ in range(2):  # a batch that is run again
        store(rows(("a", "new", utc(1, 1), utc(3))), 1)
    now = utc(2, 1)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, key string")
    found = assistant.cached(asked, upkeep.live(spark, at, now), F.lit(now))
    assert sorted(map(tuple, found.collect())) == [(1, "new", True), (2, None, False), (3, None, False)]
    assert upkeep.live(spark, at, now).count() == 2 and upkeep.drop_expired(spark, at, now) == 1 and upkeep.drop_expired(spark, at, now) == 0
    assert upkeep.live(spark, at, now).count() == 2 and upkeep.live(spark, at, utc(3)).count() == 0


def test_poll_repeats_what_stays_pending(spark, tmp_path):
    tasks, seen = spark.createDataFrame([(1, "pending"), (2, "done")], "id int, status string"), []
    q = upkeep.poll(spark, lambda: tasks, lambda df, n: seen.append((n, [r["id"] for r in df.collect()])), str(tmp_path / "p"), seconds=0.5, iterations=3)
    q.awaitTermination(60)
    assert seen == [(1, [1]), (2, [1]), (3, [1])] and not q.isActive
