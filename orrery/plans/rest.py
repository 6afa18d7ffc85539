"""Queries of reranking by plug-in, addresses, credentials and webhooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards
from ..operators import search, workflow
from . import fixtures as X
from .more import NEAR, near
from .registry import docs, query

URLS = [
    (1, "https://gitlab.com/group/project/-/merge_requests/123"), (2, " http://git.a.org:8080/g/sub group/p/-/merge_requests/4/diffs?x=1"),
    (3, "https://gitlab.com/group/project"), (4, ""), (5, "https://h/a/-/b/-/merge_requests/07/commits"),
]
PAYLOADS = [
    (1, '{"project": {"name": "shop"}, "object_attributes": {"title": "T", "source_branch": "f", "target_branch": "main", "last_commit": {"message": "+x"}}}'),
    (2, '{"project": {"name": "shop"}, "object_attributes": {"title": "U", "last_commit": {"message": ""}}}'),
    (3, '{"project": {"name": "api", "git_http_url": "https://h/api.git"}}'), (4, "{}"), (5, "not json"),
]
MR = r"^(https?://[^/]+)/(.+?)/-/merge_requests/(\d+)"


@query(f"select id, case when m then regexp_extract(u, '{MR}', 1) end as base_url, case when m then regexp_extract(u, '{MR}', 2) end as project_path, case when m then cast(regexp_extract(u, '{MR}', 3) as bigint) end as mr_iid, case when m then url_encode(regexp_extract(u, '{MR}', 2)) end as encoded_project from (select id, trim(url) as u, regexp_matches(trim(url), '{MR}') as m from {X.values(URLS, 'id', 'url')})")
def merge_request_urls(spark, d):
    return X.frame(spark, URLS, "id int, url string").select("id", guards.merge_request(F.col("url")).alias("m")).select("id", "m.*")


@query("select doc_id, unnest(kinds) as kind from (select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in guards.CREDENTIALS.items()) + "], lambda x: x is not null) as kinds from documents)")
def credential_scan(spark, d):
    return docs(spark, d).select("doc_id", F.explode(guards.credentials(F.col("text"))).alias("kind"))


@query(f"select id, case when coalesce(diff, '') <> '' then 'review' when mr then 'none' else 'reindex' end as action, coalesce(j ->> '$.project.name', '') as repo, j ->> '$.object_attributes.title' as title, j ->> '$.object_attributes.source_branch' as source_branch, j ->> '$.object_attributes.target_branch' as target_branch, diff from (select id, j, json_extract(j, '$.object_attributes') is not null as mr, j ->> '$.object_attributes.last_commit.message' as diff from (select id, case when json_valid(p) then p else '{{}}' end as j from {X.values(PAYLOADS, 'id', 'p')}))")
def webhook_actions(spark, d):
    return workflow.webhooks(X.frame(spark, PAYLOADS, "id int, payload string"))


@query(f"with {NEAR}, o as (select query, doc, distance, row_number() over (partition by query order by round(distance, 9), doc) as rank from hits) select query, doc, rank, round(distance, 6) + 0.0 as rerank_score from o where rank <= 5")
def rerank_without_model(spark, d):
    hits = search.rerank(near(spark, d, 30), None, 5)
    return hits.select("query", "doc", "rank", (F.round("rerank_score", 6) + 0.0).alias("rerank_score"))


@query(f"with {NEAR}, s as (select query, doc, length(substr(text, 1, 1500)) / (1.0 + length(words)) as v from hits), o as (select *, row_number() over (partition by query order by round(v, 9) desc, doc) as rank from s) select query, doc, rank, round(v, 6) as rerank_score from o where rank <= 5")
def rerank_by_plugin(spark, d):
    longer = lambda q, c: F.length(c) / (1 + F.length(q))
    hits = search.rerank(near(spark, d, 30), longer, 5, asked="words", code="text", cut=1500)
    return hits.select("query", "doc", "rank", (F.round("rerank_score", 6) + 0.0).alias("rerank_score"))
