"""More registered queries: expansion, guards, caches, chunks, windows over events, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards
from ..functions.synonyms import ROWS as SYNONYMS
from ..operators import assistant, chunks
from ..sources import sinks
from ..streaming import flows
from . import fixtures as X
from .registry import docs, events, query, read

BRANCHES = [(1, "feature/a"), (2, ""), (3, "Main"), (4, ".x"), (5, "a..b"), (6, "a:b"), (7, "x" * 256), (8, "fix-1")]
REMOTES = [(1, "git@git.example.com:group/sub/project.git"), (2, "ssh://git@git.example.com/group/project.git"), (3, "https://git.example.com:8443/group/project.git/"), (4, "http://git.example.com:80/a/b"), (5, "none")]


@query(f"with q as (select id, q, list_filter(string_split_regex(lower(q), '\\s+'), lambda w: w <> '') as l from {X.values(X.QUERIES, 'id', 'q')}), w as (select id, l, unnest(l) as w, generate_subscripts(l, 1) as pos from q), h as (select id, synonym, min(place * 1000 + pos) as p from w join {X.values(SYNONYMS, 'word', 'place', 'synonym')} on w = word where not list_contains(l, synonym) group by all), r as (select *, row_number() over (partition by id order by p, synonym) as rn from h), s as (select id, string_agg(synonym, ' ' order by rn) as more from r where rn <= 5 group by id) select q.id, q.q || coalesce(' ' || more, '') as expanded from q left join s on q.id = s.id")
def synonym_expand(spark, d):
    return assistant.expand(X.frame(spark, X.QUERIES, "id int, q string"), X.frame(spark, SYNONYMS, "word string, place int, synonym string"))


@query(f"select id, case when name = '' then 'empty' when length(name) > 255 then 'long' when starts_with(name, '.') or ends_with(name, '.') then 'dot' when regexp_matches(name, '\\.\\.|[~^:]') then 'characters' when lower(name) in ('main', 'master', 'production', 'prod') then 'protected' end as problem from {X.values(BRANCHES, 'id', 'name')}")
def branch_rules(spark, d):
    return X.frame(spark, BRANCHES, "id int, name string").select("id", guards.branch_problem(F.col("name")).alias("problem"))


@query()
def remote_addresses(spark, d):
    rows = X.frame(spark, REMOTES, "id int, url string")
    return rows.select("id", guards.remote_host(F.col("url")).alias("host"), guards.remote_path(F.col("url")).alias("path"))


@query("select source, count(*) as n_chunks, count(*) > 100 as too_large from documents group by source")
def chunk_gate(spark, d):
    return assistant.within_chunks(docs(spark, d), "source", 100)


@query("select source, cast(sum(len(regexp_extract_all(text, '[a-z]+ing '))) as bigint) as matches, count(*) filter (where regexp_matches(text, '[a-z]+ing ')) as files from documents group by source")
def pattern_dry_run(spark, d):
    n = F.regexp_count("text", F.lit("[a-z]+ing "))
    return docs(spark, d).groupBy("source").agg(F.sum(n).cast("long").alias("matches"), F.count(F.when(n > 0, 1)).alias("files"))


@query("select item_id as id, case when item_id % 3 = 0 then 'answer ' || item_id end as answer, item_id % 3 = 0 as hit from benchmark")
def exact_cache(spark, d):
    rows = read(spark, d, "benchmark")
    key = lambda text: assistant.cache_key(text, F.col("item_id"), F.lit(0.2))
    asked = rows.select(F.col("item_id").alias("id"), key(F.col("text")).alias("key"))
    stored = rows.where("item_id % 3 < 2").select(key(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("   ")))).alias("key"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"), F.col("item_id").alias("stored_at"), (F.col("item_id") % 3).alias("m"))
    return assistant.cached(asked, stored.withColumn("expires_at", F.when(F.col("m") == 0, 10).otherwise(0)), F.lit(5))


@query("with s as (select q.vec_id as id, v.vec_id as entry, list_dot_product(q.embedding::double[], v.embedding::double[]) as sim from embeddings q join embeddings v on q.label = v.label and q.vec_id <> v.vec_id where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by id order by round(sim, 9) desc, entry) as rn from s where round(sim, 9) >= 0.2) select id, entry, round(sim, 6) as sim from r where rn = 1")
def semantic_cache(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("parameters"), F.col("embedding").alias("vector"))
    found = assistant.near_cached(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "id"), v.withColumnRenamed("vec_id", "entry"), 0.2, F.col("id") != F.col("entry"))
    return found.select("id", "entry", F.round("sim", 6).alias("sim"))


@query("select query_id, seq, stage from (select item_id as query_id, unnest(l) as stage, (generate_subscripts(l, 1) - 1)::int as seq from (select item_id, case item_id % 4 when 0 then ['start', 'cache_hit', 'complete'] when 1 then ['start', 'hyde', 'vector', 'complete'] when 2 then ['start', 'vector', 'hybrid', 'reranked', 'complete'] else ['start', 'hyde', 'vector', 'reranked', 'graph', 'complete'] end as l from benchmark))")
def query_stages(spark, d):
    m = F.col("item_id") % 4
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (m == 0).alias("cache_hit"), (m % 2 == 1).alias("hyde"), F.when(m == 1, 0).otherwise(3).alias("hits"), (m == 2).alias("hybrid"), (m == 3).alias("graph"))
    return assistant.stages(q)


@query("select strftime(ts, '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, d):
    w = flows.tumbling(events(spark, d), "ts", "event_type", "value")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("with e as (select user_id, ts, coalesce(ts - lag(ts) over w > interval 6 hour, true)::int as fresh from events window w as (partition by user_id order by ts)), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts range unbounded preceding) as k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as n from s group by user_id, k")
def event_sessions(spark, d):
    s = flows.sessions(events(spark, d), "ts", "user_id", "6 hours")
    return s.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("select event_id, 'event: ' || event_type || chr(10) || 'data: {\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' || chr(10) || chr(10) as frame from events")
def event_frames(spark, d):
    return events(spark, d).select("event_id", sinks.event_frame(F.col("event_type"), F.struct("event_id", "user_id")).alias("frame"))


@query("with i as (select r_regionkey, r_name, left(n_name, 1) as s, string_agg('- ' || n_name, chr(10) order by n_nationkey) as items from nation join region on n_regionkey = r_regionkey group by 1, 2, 3), b as (select *, '## ' || s || chr(10) || chr(10) || items as body from i), w as (select r_regionkey, r_name, string_agg(body, chr(10) || chr(10) order by s) as bodies from b group by 1, 2) select r_regionkey, '# ' || r_name || chr(10) || chr(10) || bodies || chr(10) as markdown from w")
def outline_document(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("section", F.substring("n_name", 1, 1))
    return sinks.document(rows, "r_regionkey", "r_name", "section", "n_nationkey", "n_name")


@query()
def incident_parse(spark, d):
    rows = assistant.incidents(X.frame(spark, X.TRACES, "id int, trace string"))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("id", "error_type", "error_message", joined("functions"), joined("files"), joined("suggestions"))


@query()
def code_chunks(spark, d):
    lang = F.create_map(*[F.lit(x) for x in ("GO", "go", "PY", "python", "JS", "javascript", "RB", "ruby")])
    files = X.frame(spark, X.CODE, "id int, lang string, content string").select(F.col("id").cast("string").alias("file"), F.try_element_at(lang, F.col("lang")).alias("language"), "content")
    return chunks.chunk(files, 5, 1000)
