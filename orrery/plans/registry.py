"""All registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, code, evaluate, monitor, search, vectors
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "hybrid_hashed"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# ---- text and BM25 ---------------------------------------------------------------------------------------------------

STOPS = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def sql_tokens(column: str) -> str:
    camel = f"regexp_replace(regexp_replace({column}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(lower({column}) || ' ' || lower({camel}) || ' ' || lower(replace({column}, '_', ' ')), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z][a-z0-9]+') and t not in {STOPS})"


POSTINGS = f"tok as (select doc_id as doc, unnest({sql_tokens('text')}) as term from documents), post as (select doc, term, count(*) as tf from tok group by all), dl as (select doc, cast(sum(tf) as bigint) as dl from post group by doc), dfs as (select term, count(*) as df from post group by term), st as (select (select count(*) from documents) as n, greatest((select sum(dl) from dl) / (select count(*) from documents), 1.0) as avgdl)"
BM25 = POSTINGS + f", asked as (select query, term, count(*) as qtf from (select item_id as query, unnest({sql_tokens('text')}) as term from benchmark) group by all), hits as (select query, asked.term, post.doc, qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl.dl / avgdl)) as part from asked join dfs on asked.term = dfs.term join post on asked.term = post.term join dl on post.doc = dl.doc, st), scored as (select query, doc, sum(part) as score from hits group by all having sum(part) > 0), best as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from scored)"


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), T.tokens(F.col("text")).alias("words"), "text")


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(search.spread(docs(spark, sf_dir)), "doc_id", T.tokens(F.col("text")), bench(spark, sf_dir))


@query("with " + POSTINGS + " select doc, count(*) as terms, cast(max(tf) as bigint) as most, any_value(dl.dl) as dl from post join dl using (doc) group by doc")
def token_stats(spark, d):
    post = search.postings(search.spread(docs(spark, d)), "doc_id", T.tokens(F.col("text")))
    return post.groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.max("tf").alias("most"), F.sum("tf").alias("dl"))


@query("with " + POSTINGS + " select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs, st")
def doc_freq_idf(spark, d):
    rows = docs(spark, d)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    terms = search.spread(rows).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))  # a document is one row
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n))
    return df.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


@query("with " + BM25 + " select query, doc, rank, round(score, 5) as score from best where rank <= 10")
def bm25_batch(spark, d):
    return search.top(bm25_scores(spark, d), 10).select("query", "doc", "rank", F.round("score", 5).alias("score"))


@query("select lang, count(*) as files, count(distinct source) as repos from documents group by lang")
def lang_counts(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("source").alias("repos"))


@query("select doc_id from documents where contains(text, 'the MIT License') and lang = 'en'")
def filtered_contains(spark, d):
    return docs(spark, d).where((F.col("lang") == "en") & F.contains("text", F.lit("the MIT License"))).select("doc_id")


@query(f"select id, regexp_replace(q, 'x', 'x') as q, case when trim(q) = '' then 'hybrid' when regexp_matches(q, '(?i){T.DEPENDENCY}') then 'dependency' when round(1 - w, 2) >= 0.72 then 'semantic' when w >= 0.48 then 'keyword' else 'hybrid' end as intent, w as bm25_weight from (select *, case when kw + sem = 0 then 0.3 else round(0.2 + 0.4 * kw / (kw + sem), 2) end as w from (select id, q, k + case when n <= 3 and k > 0 then 2 else 0 end as kw, s + case when n > 6 and s > 0 then 2 else 0 end as sem from (select id, q, len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) as n, " + " + ".join([f"regexp_matches(q, '(?i){p}')::int" for p in T.KEYWORD] + [f"regexp_matches(q, '{T.KEYWORD_CASED}')::int"]) + " as k, " + " + ".join(f"regexp_matches(q, '(?i){p}')::int" for p in T.SEMANTIC) + f" as s from {X.values(X.QUERIES, 'id', 'q')})))")
def query_router(spark, d):
    q = X.frame(spark, X.QUERIES, "id int, q string")
    return q.select("id", "q", T.intent(F.col("q")).alias("intent"), T.keyword_weight(F.col("q")).alias("bm25_weight"))


@query("select id, array_to_string(list_distinct_ordered, ' ') as ids from (select id, list_reduce(list_prepend([]::varchar[], list_transform(list_concat(list_concat(list_concat(regexp_extract_all(q, '\\b[a-z]+(?:[A-Z][a-z]+)+\\b'), regexp_extract_all(q, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')), regexp_extract_all(q, '\\b[a-z]+(?:_[a-z]+)+\\b')), regexp_extract_all(q, '\\b\\w+\\.\\w+(?:\\.\\w+)*\\b')), lambda x: [x])), lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as list_distinct_ordered from " + X.values(X.QUERIES, "id", "q") + ")")
def identifier_extract(spark, d):
    return X.frame(spark, X.QUERIES, "id int, q string").select("id", F.array_join(T.identifiers(F.col("q")), " ").alias("ids"))


@query("select item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as q, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key from benchmark")
def normalize_question(spark, d):
    q = T.normal_question(F.col("text"))
    return read(spark, d, "benchmark").select("item_id", q.alias("q"), F.sha2(q.cast("binary"), 256).alias("key"))


# ---- vectors and fusion ----------------------------------------------------------------------------------------------

COS = "list_dot_product(q.embedding::double[], v.embedding::double[])"
ASKED = "asked as (select vec_id as query, embedding, label from embeddings where vec_id % 100 = 0)"


def asked(spark, d):
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"), F.col("label").alias("asked_label"))


def knn_sql(on: str = "true", part: str = "query", k: int = 10) -> str:
    return f"with {ASKED}, c as (select q.query, v.vec_id as doc, v.label, {COS} as cos from asked q join embeddings v on {on}), r as (select *, row_number() over (partition by {part} order by round(cos, 9) desc, doc) as rank from c) select query, doc, rank, round(cos, 6) as cos from r where rank <= {k}"


@query(knn_sql())
def knn_batch(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.knn(v, "vec_id", "embedding", asked(spark, d), 10).select("query", "doc", "rank", F.round("cos", 6).alias("cos"))


@query(knn_sql("q.label = v.label"))
def knn_same_label(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.knn(v, "vec_id", "embedding", asked(spark, d), 10, ("label", "asked_label")).select("query", "doc", "rank", F.round("cos", 6).alias("cos"))


@query(knn_sql(part="query, label", k=3))
def knn_fan_out(spark, d):
    v = read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc")
    found = None
    for part in search.in_blocks(asked(spark, d), "query"):
        hits = v.join(F.broadcast(part)).select("query", "doc", "label", search.dot("asked", "embedding").alias("cos"))
        hits = search.top(hits.withColumn("part", F.struct("query", "label")), 3, "part", "cos")
        found = hits if found is None else found.unionByName(hits)
    return found.select("query", "doc", "rank", F.round("cos", 6).alias("cos"))


@query("select q.vec_id as a, v.vec_id as b, round(" + COS + ", 6) as cos from embeddings q join embeddings v on q.vec_id < v.vec_id where " + COS + " >= 0.35")
def near_pairs(spark, d):
    v = read(spark, d, "embeddings")
    return search.similar_pairs(v, "vec_id", "embedding", 0.35).select("a", "b", F.round("cos", 6).alias("cos"))


FUSED = BM25 + f", v{ASKED}, near as (select *, row_number() over (partition by query order by round(cos, 9) desc, doc) as rank from (select q.query, v.vec_id as doc, {COS} as cos from vasked q, embeddings v)), vec as (select query, doc, rank, cos from near where rank <= 20), kwd as (select query, doc, rank, score from best where rank <= 20)"


def both(spark, d):
    kwd = search.top(bm25_scores(spark, d), 20)
    vec = vectors.knn(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", asked(spark, d), 20)
    return kwd, vec


@query("with " + FUSED + ", f as (select query, doc, sum(1.0::double / (60 + rank)) as score from (select query, doc, rank from vec union all select query, doc, rank from kwd) group by all), r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from f) select query, doc, rank, round(score, 8) as score from r where rank <= 10")
def hybrid_rrf(spark, d):
    kwd, vec = both(spark, d)
    return search.top(search.rrf(kwd, vec), 10).select("query", "doc", "rank", F.round("score", 8).alias("score"))


@query("with " + FUSED + ", k as (select query, doc, (score - min(score) over (partition by query)) / coalesce(nullif(max(score) over (partition by query) - min(score) over (partition by query), 0), 1) as b from kwd), h as (select coalesce(k.query, v.query) as query, coalesce(k.doc, v.doc) as doc, coalesce(b, 0) * 0.3 + coalesce(1 / (1 + (1 - cos)), 0) * 0.7 as score from k full join vec v on k.query = v.query and k.doc = v.doc), r as (select *, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from h) select query, doc, rank, round(score, 5) as score from r where rank <= 10")
def hybrid_weighted(spark, d):
    kwd, vec = both(spark, d)
    fused = search.weighted(kwd, vec, F.lit(0.3))
    return search.top(fused, 10, score="hybrid_score").select("query", "doc", "rank", F.round("hybrid_score", 5).alias("score"))


@query("with " + BM25 + ", r as (select b.query, b.doc, b.rank, length(t.text) as n from best b join documents t on b.doc = t.doc_id where b.rank <= 10), u as (select *, sum(n) over (partition by query order by rank) as used from r) select query, doc, rank, cast(used as bigint) as used from u where used <= 6000")
def context_budget(spark, d):
    hits = search.top(bm25_scores(spark, d), 10).join(docs(spark, d).select(F.col("doc_id").alias("doc"), F.length("text").cast("long").alias("n")), "doc")
    return search.within_budget(hits, F.col("n"), 6000).select("query", "doc", "rank", "used")


@query(f"select query, doc, rank from (select *, max(c) over (partition by query) as best from (select query, doc, rank, cos as c from ({knn_sql().replace('round(cos, 6) as cos', 'cos')}))) where rank <= 3 or best < 0.28")
def progressive_cutoff(spark, d):
    hits = vectors.knn(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", asked(spark, d), 10)
    return search.progressive(hits, "cos", 3, 0.28).select("query", "doc", "rank")


LEX = "list_distinct(list_filter(string_split(lower(b.text), ' '), lambda w: length(w) >= 3))"


@query("with " + BM25 + f", c as (select k.query, k.doc, {LEX} as w, lower(t.text) as x, lower(t.source) as s, t.lang as l from best k join documents t on k.doc = t.doc_id join benchmark b on k.query = b.item_id where k.rank <= 20) select query, doc, round(list_sum(list_transform(w, lambda i: contains(x, i)::int + 2 * contains(l, i)::int + 3 * contains(s, i)::int)) / greatest(len(w), 1), 6) as rerank_score from c")
def lexical_rerank(spark, d):
    hits = search.top(bm25_scores(spark, d), 20).join(docs(spark, d).withColumnRenamed("doc_id", "doc"), "doc").drop("n_chars").withColumnRenamed("text", "code")
    hits = hits.join(bench(spark, d).select("query", F.split(F.lower("text"), " ").alias("w")), "query")
    return hits.select("query", "doc", F.round(search.lexical_rerank(F.col("w"), F.col("code"), F.col("lang"), F.col("source")), 6).alias("rerank_score"))


# ---- telemetry -------------------------------------------------------------------------------------------------------


@query("with l as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as z from events), r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from l where z <= 1000) select event_type, max(case when i = least(floor(n * 0.5), n - 1) then value end) as p50, max(case when i = least(floor(n * 0.95), n - 1) then value end) as p95, max(case when i = least(floor(n * 0.99), n - 1) then value end) as p99, round(avg(value), 6) as mean, min(value) as low, max(value) as high, count(*) as n from r group by event_type")
def latency_percentiles(spark, d):
    last = monitor.latest(events(spark, d), ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 1000)
    r = monitor.nearest_rank(last, "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return r.withColumn("mean", F.round("mean", 6))


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def interp_percentiles(spark, d):
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    return events(spark, d).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


ACTIONS = {"click": "click", "view": "skip", "purchase": "thumbs_up", "signup": "reformulate", "error": "thumbs_down"}


@query("select round(avg(v), 4) as satisfaction, count(v) as n from (select case event_type when 'purchase' then 1.0 when 'click' then 0.7 when 'view' then 0.3 when 'error' then 0.0 end::double as v from (select * from events where event_type <> 'signup' order by ts desc, event_id desc limit 1000))")
def csat(spark, d):
    action = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    last = events(spark, d).where("event_type <> 'signup'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000)
    return monitor.satisfaction(last.withColumn("action", F.try_element_at(action, F.col("event_type"))), "action")


@query("select event_type, count(*) as n from (select * from events order by ts desc, event_id desc limit 500) group by event_type")
def action_histogram(spark, d):
    return events(spark, d).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("with r as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as a, row_number() over (partition by event_type order by ts desc, event_id desc) as z from events), g as (select event_type, avg(case when a <= 50 then value end) as b, avg(case when z <= 50 then value end) as r from r group by event_type) select event_type, round(b, 6) as baseline, round(r, 6) as recent, round(abs(r - b) / b, 6) as change, abs(r - b) / b > 0.15 as drifted from g")
def drift_check(spark, d):
    r = monitor.drift(events(spark, d), "event_type", ["ts", "event_id"], "value")
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("baseline", "recent", "change")], "drifted")


@query("with recursive e as (select user_id, event_id, epoch_us(ts::timestamp) as t, row_number() over (partition by user_id order by ts::timestamp, event_id) as n from events), f as (select user_id, n, event_id, true as admitted, [t] as times from e where n = 1 union all select user_id, n, event_id, len(live) < 3, case when len(live) < 3 then list_append(live, t) else live end from (select e.user_id, e.n, e.event_id, e.t, list_filter(f.times, lambda x: x > e.t - 3600000000) as live from f join e on e.user_id = f.user_id and e.n = f.n + 1)) select user_id, event_id, admitted from f")
def rate_limit(spark, d):
    return monitor.admitted(events(spark, d), "user_id", "ts", "event_id", 3, 3600)


MODELS = "case event_type when 'click' then 'gpt-4o-mini-x' when 'view' then 'GPT-4o' when 'purchase' then 'ollama' else 'unknown' end"


@query(f"with c as (select {MODELS} as model, user_id as ti, user_id * 2 as t_o from events), p as (select *, case when contains(lower(model), 'gpt-4o-mini') then ti / 1000 * 0.00015 + t_o / 1000 * 0.0006 when contains(lower(model), 'gpt-4o') then ti / 1000 * 0.0025 + t_o / 1000 * 0.01 else 0 end as cost from c) select model, count(*) as calls, cast(sum(ti + t_o) as bigint) as tokens, round(sum(cost), 6) as cost from p group by rollup (model)")
def cost_rollup(spark, d):
    model = F.expr(MODELS)
    calls = events(spark, d).select(model.alias("model"), F.col("user_id").alias("tokens_in"), (F.col("user_id") * 2).alias("tokens_out"))
    return monitor.costs(calls).withColumn("cost", F.round("cost", 6))


@query("with l as (select user_id as key, max(ts) as last_access, max(ts) + interval 1 day as expires_at from events group by user_id), x as (select *, row_number() over (order by last_access desc, key) as rn from l where expires_at > timestamp '2024-01-20') select key from x where rn <= 50")
def lru_ttl_survivors(spark, d):
    e = events(spark, d).groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"))
    e = e.withColumn("expires_at", F.col("last_access") + F.expr("interval 1 day"))
    return monitor.survivors(e, F.lit("2024-01-20").cast("timestamp"), 50).select("key")


@query("select 'events_total{type=\"' || event_type || '\"} ' || count(*) as line from events group by event_type")
def prometheus_lines(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@query("select round(avg((event_type = 'error')::int), 6) as error_rate, count(*) as n, count(distinct user_id) as users from events")
def error_rate(spark, d):
    return events(spark, d).agg(F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("error_rate"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


# ---- evaluation ------------------------------------------------------------------------------------------------------

JUDGED = f"with {ASKED}, c as (select q.query, v.vec_id as doc, (q.label = v.label)::int as hit, row_number() over (partition by q.query order by round({COS}, 9) desc, v.vec_id) as rank from asked q, embeddings v), rel as (select q.query, count(*) as nr from asked q join embeddings v on q.label = v.label group by q.query), "
PER_K = ", ".join(f"round(sum(case when rank <= {k} then hit else 0 end) / {k}, 6) as p{k}, round(sum(case when rank <= {k} then hit else 0 end) / any_value(nr), 6) as r{k}, round(sum(case when rank <= {k} then hit / log2(rank + 1) else 0 end) / list_sum(list_transform(range(1, least({k}, any_value(nr)) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg{k}" for k in (1, 3, 5))


@query(JUDGED + f"t as (select c.*, nr from c join rel using (query) where rank <= 10) select query, round(coalesce(1.0 / min(case when hit = 1 then rank end), 0), 6) as rr, {PER_K} from t group by query")
def retrieval_eval(spark, d):
    v = read(spark, d, "embeddings")
    q = asked(spark, d)
    found = vectors.knn(v.select("vec_id", "embedding"), "vec_id", "embedding", q, 10)
    relevant = q.select("query", F.col("asked_label").alias("label")).join(v.select(F.col("vec_id").alias("doc"), "label"), "label").select("query", "doc")
    r = evaluate.at_k(found.select("query", "doc", "rank"), relevant)
    return r.select("query", *[F.round(c, 6).alias(c) for c in r.columns if c != "query"])


QSTOPS = "[" + ", ".join(f"'{w}'" for w in T.QUESTION_STOP_WORDS) + "]"
SETS = "select conv_id, turn, list_filter(list_distinct(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+')), lambda w: w <> '') as w, role from conversations"


@query(f"with s as ({SETS}), p as (select a.conv_id, a.turn, a.w as answer, q.w as question, list_filter(a.w, lambda x: not list_contains({QSTOPS}, x)) as pa, list_filter(q.w, lambda x: not list_contains({QSTOPS}, x)) as pq from s a join s q on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant' and q.role = 'user') select conv_id, turn, round(len(list_intersect(answer, question)) / greatest(len(answer), 1), 6) as faithfulness, round(case when len(pa) = 0 or len(pq) = 0 then 0 else len(list_intersect(pa, pq)) / (len(pa) + len(pq) - len(list_intersect(pa, pq))) end, 6) as relevance, round(case when len(answer) + len(question) > 0 then 2 * len(list_intersect(answer, question)) / (len(answer) + len(question)) else 0 end, 6) as f1 from p")
def answer_metrics(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", T.plain_words(F.col("text")).alias("w"))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("w").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("question"))
    p = a.join(q, ["conv_id", "turn"])
    x, y = F.col("answer"), F.col("question")
    return p.select("conv_id", "turn", F.round(evaluate.faithfulness(x, y), 6).alias("faithfulness"), F.round(evaluate.relevance(x, y), 6).alias("relevance"), F.round(evaluate.overlap_f1(x, y), 6).alias("f1"))


@query("with g as (select user_id % 2 as arm, count(value) as n, avg(value) as m, var_samp(value) as v from events group by 1), x as (select max(case when arm = 0 then n end) as na, max(case when arm = 1 then n end) as nb, max(case when arm = 0 then m end) as ma, max(case when arm = 1 then m end) as mb, max(case when arm = 0 then v end) as va, max(case when arm = 1 then v end) as vb from g) select na as n_a, nb as n_b, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(100 * (mb - ma) / ma, 5) as change_percent, round((mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 5) as t from x")
def ab_compare(spark, d):
    e = events(spark, d).withColumn("arm", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    r = evaluate.compare(e, "arm", "value")
    return r.select("n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round("change_percent", 5).alias("change_percent"), F.round("t", 5).alias("t"))


# ---- graph and catalog -----------------------------------------------------------------------------------------------


def edges(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("supplies").alias("relation")).distinct()


EDGES = "e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem)"


@query(f"with {EDGES}, n as (select src as node, dst as m from e union select dst, src from e) select node, count(*) as degree from n group by node")
def graph_degrees(spark, d):
    return catalog.neighbours(edges(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"with {EDGES}, n as (select src as node, dst as m from e union select dst, src from e), h1 as (select distinct node as seed, m as node from n where node like 's%' and cast(substr(node, 2) as bigint) % 100 = 0), h2 as (select distinct h1.seed, n.m as node from h1 join n on h1.node = n.node where n.m <> h1.seed and (h1.seed, n.m) not in (select seed, node from h1)) select seed, node, 1::bigint as hop from h1 union all select seed, node, 2::bigint from h2")
def graph_hops(spark, d):
    n = catalog.neighbours(edges(spark, d)).select(F.col("node").alias("src"), F.col("neighbour").alias("dst"))
    seeds = read(spark, d, "supplier").where("s_suppkey % 100 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))
    return catalog.hops(seeds.join(n, F.col("seed") == F.col("src"), "left_semi"), n, 2)


@query("select source as repo, count(*) as chunks, count(distinct lang) as languages, min(doc_id) as first_file, round(avg(n_chars), 4) as mean_chars from documents group by source")
def repo_catalog(spark, d):
    return docs(spark, d).groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("lang").alias("languages"), F.min("doc_id").alias("first_file"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("select doc_id, case when n_chars % 7 = 0 then 'deleted' when n_chars % 7 = 1 then 'changed' when n_chars % 7 = 2 then 'new' else 'same' end as status from documents")
def hash_diff(spark, d):
    rows = docs(spark, d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), (F.col("n_chars") % 7).alias("m"))
    old, new = rows.where("m <> 2"), rows.where("m <> 0").withColumn("sha", F.when(F.col("m") == 1, F.reverse("sha")).otherwise(F.col("sha")))
    new = new.withColumn("sha", F.when(F.col("m") == 1, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")))
    return catalog.hash_diff(old, new, ["doc_id"], "sha")


@query("select doc_id, case when n_chars % 5 = 0 then 'xx' else lang end as lang from documents")
def upsert_merge(spark, d):
    rows = docs(spark, d).select("doc_id", "lang", "n_chars")
    return catalog.upsert(rows, rows.where("n_chars % 5 = 0").withColumn("lang", F.lit("xx")), ["doc_id"]).select("doc_id", "lang")


@query("select doc_id from documents where source not in ('src1', 'src2')")
def delete_by_file(spark, d):
    gone = X.frame(spark, [("src1",), ("src2",)], "source string")
    return catalog.delete(docs(spark, d).select("doc_id", "source"), gone, ["source"]).select("doc_id")


@query("select sha256(text) as sha, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_dup_groups(spark, d):
    return docs(spark, d).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn = 1")
def dedupe_first(spark, d):
    return catalog.first_by(docs(spark, d).select("source", "doc_id", "n_chars"), ["source"], [F.col("n_chars").desc(), "doc_id"]).select("source", "doc_id")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc, role, text) as rn from conversations) where rn <= 3")
def history_window(spark, d):
    c = read(spark, d, "conversations")
    return monitor.latest(c, ["conv_id"], [F.col("turn").desc(), F.col("role"), F.col("text")], 3).select("conv_id", "turn", "role")


# ---- code ------------------------------------------------------------------------------------------------------------


@query()
def code_symbols(spark, d):
    return X.frame(spark, X.CODE, "id int, lang string, code string").select("id", F.explode(code.symbols(F.col("code"), F.col("lang"))).alias("symbol"))


@query()
def code_imports(spark, d):
    return X.frame(spark, X.CODE, "id int, lang string, code string").select("id", F.explode(code.imports(F.col("code"))).alias("name"))


@query()
def code_uses(spark, d):
    return code.uses(X.frame(spark, X.CODE, "id int, lang string, code string"), X.frame(spark, [("GetUser",), ("json",), ("Store",)], "symbol string"))


@query()
def diff_symbols(spark, d):
    return code.changed_symbols(X.frame(spark, X.DIFFS, "id int, diff string"))


@query()
def static_review(spark, d):
    return code.review(X.frame(spark, X.DIFFS, "id int, diff string"))


@query()
def trace_frames(spark, d):
    return code.frames(X.frame(spark, X.TRACES, "id int, trace string"))


@query()
def dependency_usage(spark, d):
    rows = code.requirements(X.frame(spark, X.REQUIREMENTS, "repo string, content string"))
    rows = rows.union(code.package_json(X.frame(spark, X.PACKAGES, "repo string, content string"))).union(code.go_mod(X.frame(spark, X.MODULES, "repo string, content string")))
    return rows.groupBy("ecosystem", "name").agg(F.count(F.lit(1)).alias("uses"), F.array_join(F.array_sort(F.collect_list("repo")), ",").alias("repos"))
