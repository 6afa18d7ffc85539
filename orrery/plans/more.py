"""Registered queries of base search, in-result fusion, impact analysis, caches, roll-ups and small report operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, code, evaluate, monitor, names, search, vectors
from . import fixtures as X
from .registry import ASKED, COS, ORACLE, asked, bench, docs, events, query, read, sql_tokens

ASKS = ["license of src3 repo", "where is the password in src-12", "compare src_1 and src12", "the mit license", "src 7 token", ""]
ASK_ROWS = [(i + 1, q) for i, q in enumerate(ASKS)]

# ---- search ----------------------------------------------------------------------------------------------------------

#: Vector hits of each asked vector with the document of the same number; what is asked in words names the vector's own source.
NEAR = f"{ASKED}, near as (select *, row_number() over (partition by query order by round(cos, 9) desc, doc) as vrank from (select q.query, v.vec_id as doc, {COS} as cos from asked q, embeddings v)), hits as (select n.query, n.doc, 1 - cos as distance, d.text, d.lang, d.source, q.source || ' ' || q.lang || ' the mit license' as words from near n join documents d on n.doc = d.doc_id join documents q on n.query = q.doc_id where vrank <= 30)"


def near(spark, d, k):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    hits = vectors.knn(v, "vec_id", "embedding", asked(spark, d).drop("asked_label"), k).drop("rank")
    rows = docs(spark, d)
    hits = hits.join(rows.select(F.col("doc_id").alias("doc"), "text", "lang", "source"), "doc")
    words = F.concat_ws(" ", "source", "lang", F.lit("the mit license"))
    return hits.join(rows.select(F.col("doc_id").alias("query"), words.alias("words")), "query")


@query(f"with {NEAR}, b as (select *, list_distinct(list_filter(string_split(lower(words), ' '), lambda w: length(w) >= 3)) as ws, translate(lower(source), '-_', '  ') as r from hits), s as (select query, doc, distance, list_sum(list_transform(ws, lambda w: contains(r, w)::int + 0.4 * contains(lower(lang), w)::int + 0.2 * contains(lower(text), w)::int)) * 1.55::double as boost from b), o as (select *, row_number() over (partition by query order by round(distance - boost, 9), doc) as rank from s) select query, doc, rank, round(boost::double, 6) as keyword_boost, round(distance - boost, 6) as hybrid_score from o where rank <= 10")
def base_search(spark, d):
    hits = near(spark, d, 30)
    r = search.base_search(hits, F.split(F.lower("words"), " "), F.col("text"), F.col("lang"), F.col("source"), F.lit("keyword"), 10)
    return r.select("query", "doc", "rank", F.round("keyword_boost", 6).alias("keyword_boost"), F.round("hybrid_score", 6).alias("hybrid_score"))


@query(f"with {NEAR}, c as (select query, doc, distance, {sql_tokens('text')} as t, {sql_tokens('words')} as a from hits), w as (select *, len(t) as dl, count(*) over (partition by query) as n, greatest(avg(len(t)) over (partition by query), 1.0) as avgdl from c), x as (select query, doc, dl, n, avgdl, t, a, unnest(list_distinct(a)) as term from w), y as (select *, len(list_filter(t, lambda i: i = term)) as tf, len(list_filter(a, lambda i: i = term)) as qtf from x), z as (select *, count(*) over (partition by query, term) as df from y where tf > 0), s as (select query, doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from z group by all having sum(1) > 0), m as (select query, doc, (score - min(score) over (partition by query)) / coalesce(nullif(max(score) over (partition by query) - min(score) over (partition by query), 0), 1) as b from s where score > 0), h as (select c.query, c.doc, coalesce(b, 0) as bm25_score, coalesce(b, 0) * 0.6 + 0.4 / (1 + coalesce(nullif(distance, 0), 2)) as hybrid_score from c left join m on c.query = m.query and c.doc = m.doc), o as (select *, row_number() over (partition by query order by round(hybrid_score, 9) desc, doc) as rank from h) select query, doc, rank, round(bm25_score, 5) as bm25_score, round(hybrid_score, 5) as hybrid_score from o where rank <= 10")
def in_result_bm25(spark, d):
    hits = near(spark, d, 30)
    fused = search.hybrid_within(hits, T.tokens(F.col("text")), T.tokens(F.col("words")), F.lit(0.6))
    return search.top(fused, 10, score="hybrid_score").select("query", "doc", "rank", F.round("bm25_score", 5).alias("bm25_score"), F.round("hybrid_score", 5).alias("hybrid_score"))


@query(f"select id, intent <> 'semantic' as hybrid, intent = 'dependency' as graph, id * 4 <= 20 as rerank from ({ORACLE['query_router']})")
def search_gates(spark, d):
    q = X.frame(spark, X.QUERIES, "id int, q string")
    return q.select("id", *[c.alias(k) for k, c in search.gates(T.intent(F.col("q")), F.col("id") * 4).items()])


@query(f"with {ASKED}, c as (select q.query, v.vec_id as doc, round({COS}, 6) as cos, row_number() over (partition by q.query order by round({COS}, 9) desc, v.vec_id) as rank from asked q, embeddings v) select query, doc, round((1 - (1 - cos)) * 100, 1) as similarity from c where rank <= 5")
def similarity_percents(spark, d):
    r = vectors.knn(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", asked(spark, d), 5)
    return r.select("query", "doc", search.similarity_percent(1 - F.round("cos", 6)).alias("similarity"))


@query("select doc_id, source from documents order by doc_id limit 10")
def peek_rows(spark, d):
    return docs(spark, d).orderBy("doc_id").limit(10).select("doc_id", "source")


@query("select doc_id, source from documents where contains(lower(text), 'license') and regexp_matches(text, '\\bMIT License\\b') and lang = 'en'")
def contains_post_check(spark, d):
    return docs(spark, d).where(F.contains(F.lower("text"), F.lit("license")) & F.col("text").rlike(r"\bMIT License\b") & (F.col("lang") == "en")).select("doc_id", "source")


@query("select doc_id, sha256(text) as document, lang as meta_lang, source as meta_source from documents")
def payload_split(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("text").alias("document"), F.struct("lang", "source").alias("metadata"))
    return rows.select("doc_id", F.sha2(F.col("document").cast("binary"), 256).alias("document"), F.col("metadata.lang").alias("meta_lang"), F.col("metadata.source").alias("meta_source"))


@query("select item_id, case when lower(s) <> lower(text) then text || ' ' || s else text end as q from (select item_id, text, replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_', ' ') as s from benchmark)")
def normal_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", T.normal_terms(F.col("text")).alias("q"))


@query(f"with q as (select id, lower(trim(q)) as l from {X.values(ASK_ROWS, 'id', 'q')}), n as (select distinct source as name from documents), h as (select id, name from q, n where contains(l, lower(name)) or contains(replace(replace(l, '_', '-'), ' ', '-'), replace(replace(lower(name), '_', '-'), ' ', '-'))), b as (select id, arg_min(name, lpad((100 - length(name))::varchar, 3, '0') || name) as name from h group by id) select q.id, b.name from q left join b on q.id = b.id")
def repo_mentions(spark, d):
    asks = X.frame(spark, ASK_ROWS, "id int, q string").select("id", F.col("q").alias("text"))
    return names.mentioned(asks, docs(spark, d).select(F.col("source").alias("name")).distinct())


# ---- impact, diffs, coverage -----------------------------------------------------------------------------------------

WANTED = ["password", "token", "license"]
LINES = "ln as (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents), hit as (select doc_id, source, s as symbol, line from ln, (select unnest(['password', 'token', 'license']) as s) where contains(line, s)), use as (select *, case when regexp_matches(line, '(?:func|def|class)\\s+(?:\\([^)]*\\)\\s+)?' || symbol || '\\b') then 'definition' when regexp_matches(line, '(?:import|from)\\s.*\\b' || symbol || '\\b') then 'import' when regexp_matches(line, '\\b' || symbol || '\\s*\\(') then 'call' when regexp_matches(line, ':\\s*' || symbol || '\\b|' || symbol || '\\s*\\{') then 'type_usage' else 'reference' end as usage from hit)"


def usages(spark, d):
    """Lines of all documents that hold one of the symbols; the symbols are a constant array, not a joined table."""
    rows = code.lines(docs(spark, d), "text", "doc_id", "source").where(" or ".join(f"contains(content, '{s}')" for s in WANTED))
    rows = rows.select("doc_id", "source", "content", F.explode(F.array(*map(F.lit, WANTED))).alias("symbol")).where(F.contains(F.col("content"), F.col("symbol")))
    return rows.select("doc_id", "source", "symbol", code.use_of(F.col("content"), F.col("symbol")).alias("usage"))


@query("with " + LINES + " select symbol, usage, count(*) as n, count(distinct doc_id) as files from use group by all")
def usage_histogram(spark, d):
    return usages(spark, d).groupBy("symbol", "usage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files"))


@query("with " + LINES + ", g as (select symbol, source as repo, count(*) as hits, count(distinct doc_id) as files, cast(sum((usage = 'definition')::int) as bigint) as definitions from use group by all) select *, row_number() over (partition by symbol order by hits desc, repo) as place from g")
def impact_summary(spark, d):
    return code.impact(usages(spark, d).withColumnRenamed("source", "repo"), "symbol", "repo", "doc_id", "usage")


@query("with " + LINES + " select count(distinct symbol) as symbols, count(distinct source) as repos, count(distinct doc_id) as files from use")
def diff_impact(spark, d):
    return code.impact_totals(usages(spark, d), "source", "doc_id", "symbol")


@query(f"with k as (select doc_id, 1 as place from documents where contains(text, 'license')), v as (select vec_id as doc_id, row_number() over (order by round(cos, 9) desc, vec_id) as r from (select v.vec_id, {COS} as cos from (select embedding from embeddings where vec_id = 0) q, embeddings v)), s as (select v.doc_id, 2 as place from v join documents d on v.doc_id = d.doc_id where r <= 100 and contains(lower(d.text), 'license')), u as (select * from k union all select * from s) select doc_id, min(place) as found_by from u group by doc_id")
def impact_candidates(spark, d):
    rows = docs(spark, d)
    by_word = rows.where(F.contains("text", F.lit("license"))).select("doc_id", F.lit(1).alias("found_by"))
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    asked_one = v.where("vec_id = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))
    hits = vectors.knn(v, "vec_id", "embedding", asked_one, 100).select(F.col("doc").alias("h"))
    by_vector = rows.join(hits, F.col("doc_id") == F.col("h"), "left_semi").where(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", F.lit(2).alias("found_by"))
    return by_word.unionByName(by_vector).groupBy("doc_id").agg(F.min("found_by").alias("found_by"))


BODY = "replace(replace(text, ', ', chr(10) || '+'), '. ', chr(10) || '-')"


@query(f"select conv_id, sha256(string_agg('--- a/f' || turn || chr(10) || '+++ b/f' || turn || chr(10) || coalesce({BODY}, ''), chr(10) order by turn, {BODY})) as diff from conversations group by conv_id")
def request_diffs(spark, d):
    c = changes(spark, d)
    return code.unified_diff(c, "conv_id", "path", "turn", "body").select("conv_id", F.sha2(F.col("diff").cast("binary"), 256).alias("diff"))


def changes(spark, d):
    """Conversations as change lists: a turn is a file; after a comma a line is added, after a full stop one is removed."""
    body = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("\n+")), F.lit(". "), F.lit("\n-"))
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("f"), F.col("turn").cast("string")).alias("path"), body.alias("body"))


@query(f"with c as (select conv_id, turn, role, {BODY} as body from conversations) select conv_id, count(*) as files, cast(sum((length(body) - length(replace(body, chr(10) || '+', ''))) / 2) as bigint) as added, cast(sum((length(body) - length(replace(body, chr(10) || '-', ''))) / 2) as bigint) as removed, cast(sum((turn = 0)::int) as bigint) as new, cast(sum((turn > 0 and role = 'user')::int) as bigint) as del, cast(sum((turn > 0 and role <> 'user' and turn % 3 = 0)::int) as bigint) as ren, cast(sum((turn > 0 and role <> 'user' and turn % 3 <> 0)::int) as bigint) as mod from c group by conv_id")
def change_counters(spark, d):
    return code.change_counters(changes(spark, d), "conv_id", "body", F.col("turn") == 0, F.col("role") == "user", F.col("turn") % 3 == 0)


KEYED = "list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '+') or starts_with(x, '-'))"


@query(f"with c as (select id, {KEYED} as ls from {X.values(X.DIFFS, 'id', 'diff')}), k as (select id, list_filter(list_transform(ls, lambda x: regexp_extract(x, 'func\\s+(?:\\([^)]+\\)\\s+)?(\\w+)', 1)), lambda x: x <> '') as f, list_filter(list_transform(ls, lambda x: regexp_extract(x, 'package\\s+(\\w+)', 1)), lambda x: x <> '') as p from c) select id, case when len(f) + len(p) = 0 then 'error handling' else array_to_string(list_concat(f, p), ',') end as words from k")
def diff_keywords(spark, d):
    return X.frame(spark, X.DIFFS, "id int, diff string").select("id", F.array_join(code.diff_keywords(F.col("diff")), ",").alias("words"))


@query(f"with t as (select source, list_distinct({sql_tokens('text')}) as w from documents), n as (select distinct source, unnest(w) as name from t), f as (select * from n where not starts_with(name, 'the')), c as (select distinct source, regexp_replace(name, '^the', '') as name from n where starts_with(name, 'the')) select f.source, count(*) as functions, count(c.name) as tested, round(100.0 * count(c.name) / count(*), 2) as percent from f left join c on f.source = c.source and f.name = c.name group by f.source")
def test_coverage(spark, d):
    """Tokens as functions; those that begin with `the` stand for tests of what follows."""
    names = docs(spark, d).select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("name")).distinct()
    functions = names.where("not startswith(name, 'the')")
    tests = names.where("startswith(name, 'the')").select("source", F.regexp_replace("name", "^the", "test").alias("name"))
    rest = code.untested(functions, tests, "name", "source")
    counts = functions.groupBy("source").agg(F.count(F.lit(1)).alias("functions")).join(rest.groupBy("source").agg(F.count(F.lit(1)).alias("open")), "source", "left")
    tested = F.col("functions") - F.coalesce("open", F.lit(0))
    return counts.select("source", "functions", tested.alias("tested"), F.round(100.0 * tested / F.col("functions"), 2).alias("percent"))


# ---- caches, costs, evaluation ---------------------------------------------------------------------------------------

SPACES = {"click": "embedding", "view": "query", "purchase": "hyde", "signup": "rerank", "error": "search"}


@query()
def search_cache(spark, d):
    """Events as lookups of users in the cache's name spaces. A fold decides each hit, which SQL can't express; tested by hand."""
    space = F.create_map(*[x for k, v in SPACES.items() for x in (F.lit(k), F.lit(v))])
    e = events(spark, d).withColumn("namespace", F.coalesce(F.try_element_at(space, F.col("event_type")), F.lit("other")))
    ttl = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in monitor.TTL.items() for x in (F.lit(k), F.lit(v))]), F.col("namespace")), F.lit(monitor.TTL_DEFAULT))
    return monitor.cache_stats(monitor.cache_lookups(e, "namespace", "user_id", "ts", "event_id", ttl), "namespace")


@query("select event_type, round(sum(user_id / 1e6 * case event_type when 'click' then 0.15 when 'view' then 2.5 else 0.15 end + 2 * user_id / 1e6 * case event_type when 'click' then 0.6 when 'view' then 10.0 else 0.6 end), 6) as cost from events group by event_type")
def million_costs(spark, d):
    model = F.when(F.col("event_type") == "click", "gpt-4o-mini").when(F.col("event_type") == "view", "gpt-4o").otherwise("unknown")
    cost = monitor.million_price("openai", model, F.col("user_id"), 2 * F.col("user_id"))
    return events(spark, d).groupBy("event_type").agg(F.round(F.sum(cost), 6).alias("cost"))


@query("select event_id, user_id % 10 * 100 + 150 as input_tokens, user_id % 10 * 100 + 150 + 200 as total_tokens, round((user_id % 10 * 100 + 150) / 1000 * 0.0025 + 200 / 1000 * 0.01, 8) as total_cost from events")
def query_costs(spark, d):
    c = evaluate.cost_per_query(F.col("user_id") % 10, F.lit(100), F.lit(200), F.lit(0.0025), F.lit(0.01))
    return events(spark, d).select("event_id", c["input_tokens"].alias("input_tokens"), c["total_tokens"].alias("total_tokens"), F.round(c["total_cost"], 8).alias("total_cost"))


@query(f"with r as ({ORACLE['retrieval_eval']}), g as ({ORACLE['answer_metrics']}), s as (select 'retrieval' as part, avg((p3 + r3 + rr + ndcg3) / 4) as score from r union all select 'generation', avg((f1 + faithfulness + relevance) / 3) from g), a as (select * from s union all select 'overall', avg(score) from s) select part, round(score, 5) as score, case when round(score, 5) >= 0.8 then 'Excellent' when round(score, 5) >= 0.7 then 'Good' when round(score, 5) >= 0.6 then 'Fair' else 'Needs Improvement' end as rating from a")
def eval_rollup(spark, d):
    from .registry import answer_metrics, retrieval_eval

    r = retrieval_eval(spark, d).agg(F.avg((F.col("p3") + F.col("r3") + F.col("rr") + F.col("ndcg3")) / 4).alias("score")).select(F.lit("retrieval").alias("part"), "score")
    g = answer_metrics(spark, d).agg(F.avg((F.col("f1") + F.col("faithfulness") + F.col("relevance")) / 3).alias("score")).select(F.lit("generation").alias("part"), "score")
    parts = r.unionByName(g)
    every = parts.unionByName(parts.agg(F.avg("score").alias("score")).select(F.lit("overall").alias("part"), "score")).withColumn("score", F.round("score", 5))
    return every.withColumn("rating", evaluate.rating(F.col("score")))


@query("with p as (select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by event_type) select event_type, 'p50' as stage, round(p50, 6) as value from p union all select event_type, 'p95', round(p95, 6) from p")
def latency_map(spark, d):
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    rows = events(spark, d).groupBy("event_type").agg(F.create_map(F.lit("p50"), p(0.5), F.lit("p95"), p(0.95)).alias("stages"))
    return rows.select("event_type", F.explode("stages").alias("stage", "value"))


# ---- catalog and reports ---------------------------------------------------------------------------------------------


@query("select (select count(distinct source) from documents) as repos, (select count(*) from documents) as chunks, (select count(*) from benchmark) as queries")
def engine_stats(spark, d):
    n = read(spark, d, "benchmark").agg(F.count(F.lit(1)).alias("queries"))
    return docs(spark, d).agg(F.countDistinct("source").alias("repos"), F.count(F.lit(1)).alias("chunks")).join(F.broadcast(n))


@query("select source as repo, count(*) as deps, arg_min(lang, case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 else 3 end) as language from documents group by source")
def repo_dependencies(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("deps"), catalog.precedence({"en": 0, "fr": 1, "de": 2}, "lang").alias("language"))


@query("select count(*) as total, cast(sum((o_orderstatus = 'F')::int) as bigint) as completed, cast(sum((o_orderstatus = 'O')::int) as bigint) as pending, cast(sum((o_orderstatus = 'P')::int) as bigint) as running from orders")
def workflow_counters(spark, d):
    of = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    return read(spark, d, "orders").agg(F.count(F.lit(1)).alias("total"), of("F").alias("completed"), of("O").alias("pending"), of("P").alias("running"))


@query("select count(distinct source) as indexed, 80 as expected, round(100.0 * count(distinct source) / 80, 1) as percent from documents")
def index_progress(spark, d):
    n = docs(spark, d).agg(F.countDistinct("source").alias("indexed"))
    return n.select("indexed", F.lit(80).alias("expected"), F.round(100.0 * F.col("indexed") / 80, 1).alias("percent"))


@query("with t as (select source, count(*) as n, sum(n_chars) as chars from documents group by source), m as (select avg(chars) as each from t) select count(*) as done, 80 - count(*) as remaining, round(any_value(each) * (80 - count(*)), 2) as eta from t, m")
def index_eta(spark, d):
    per = docs(spark, d).groupBy("source").agg(F.sum("n_chars").alias("chars"))
    return per.agg(F.count(F.lit(1)).alias("done"), F.avg("chars").alias("each")).select("done", (80 - F.col("done")).alias("remaining"), F.round(F.col("each") * (80 - F.col("done")), 2).alias("eta"))


@query("select o_orderpriority as base, count(*) as tasks, sha256(string_agg(o_orderkey::varchar, ',' order by o_orderkey)) as listed from orders group by o_orderpriority")
def task_groups(spark, d):
    rows = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("base")).agg(F.count(F.lit(1)).alias("tasks"), F.sha2(rows.cast("binary"), 256).alias("listed"))


@query("select * from (select o_orderkey, o_totalprice, 'largest' as side, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders union all select o_orderkey, o_totalprice, 'smallest', row_number() over (order by o_totalprice, o_orderkey) from orders) where rank <= 3")
def best_and_worst(spark, d):
    return monitor.extremes(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 3)


@query("with l as (select user_id, max(ts) as last from events group by user_id order by last desc, user_id limit 24), r as (select e.event_id, e.user_id, row_number() over (partition by e.user_id order by ts desc, event_id desc) as rn from events e join l on e.user_id = l.user_id) select event_id, user_id from r where rn <= 80")
def newest_threads(spark, d):
    return catalog.newest_threads(events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id")


@query("with c as (select l_orderkey, l_partkey, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey) as rank from (select distinct l_orderkey, l_partkey, l_extendedprice from lineitem where l_quantity >= 45)) select l_partkey, o_custkey, min(rank) as rank, count(*) as children from c join orders on l_orderkey = o_orderkey where rank <= 5 group by all")
def child_parents(spark, d):
    li = read(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey", "l_extendedprice").distinct()
    hits = search.top(li, 5, by="l_partkey", score="l_extendedprice", key="l_orderkey")
    orders = read(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return catalog.parents(hits.select("l_orderkey", "l_partkey", "rank"), orders, "l_orderkey", "o_custkey", "rank", "l_partkey")


@query("with h as (select source, count(*) as n from documents group by source) select source, n, row_number() over (order by n desc, source) as place from h")
def sorted_histogram(spark, d):
    from pyspark.sql.window import Window

    h = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")).cast("long"))  # a row a source


@query("select conv_id, array_to_string(list_sort(list_distinct(list_concat(list(distinct 'f' || turn), list(distinct 'f' || (turn + 1) % 3)))), ',') as files from conversations group by conv_id")
def changed_files(spark, d):
    own, other = F.collect_set(F.concat(F.lit("f"), F.col("turn").cast("string"))), F.collect_set(F.concat(F.lit("f"), ((F.col("turn") + 1) % 3).cast("string")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_union(own, other)), ",").alias("files"))


@query("select event_id, cast(date_diff('minute', date_trunc('second', ts), timestamp '2024-01-31 00:00:00') as bigint) as minutes, date_trunc('second', ts) < timestamp '2024-01-31 00:00:00' - interval 20 minute as stale from events")
def log_staleness(spark, d):
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO worker: "), F.col("event_type"))
    at, now = T.stamped(line), F.lit("2024-01-31 00:00:00").cast("timestamp")
    minutes = (F.floor(now.cast("long") / 60) - F.floor(at.cast("long") / 60)).cast("long")
    return events(spark, d).select("event_id", minutes.alias("minutes"), (at < now - F.expr("interval 20 minutes")).alias("stale"))


UUID = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"with h as (select doc_id, sha1(unhex('{UUID.replace('-', '')}') || encode(source || ':' || doc_id)) as h from documents) select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || case when substr(h, 17, 1) in ('0', '4', '8', 'c') then '8' when substr(h, 17, 1) in ('1', '5', '9', 'd') then '9' when substr(h, 17, 1) in ('2', '6', 'a', 'e') then 'a' else 'b' end || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point from h")
def point_ids(spark, d):
    return docs(spark, d).select("doc_id", T.uuid5(UUID, F.concat_ws(":", "source", F.col("doc_id").cast("string"))).alias("point"))


@query("select o_orderkey, 'fix-' || strftime(o_orderdate, '%Y%m%d-%H%M%S') as branch from orders")
def stamped_branches(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("fix-"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss")).alias("branch"))
