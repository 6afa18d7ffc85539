"""Queries of the corpus operators with production parameters, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bytebpe, chatformat, flac, langid, licenses, mixing, neardup, packing, phrases, quality, secretscan, substrings
from .common import Scratch, n_words


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    part = lambda f: F.array_join(F.transform("finds", f), ",")
    text = part(lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["stop"].cast("string"), x["matched"].cast("string")))
    return found.select("doc_id", "n_tokens", "n_finds", text.alias("finds"), F.coalesce(F.array_max(F.transform("finds", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", *quality.COUNTERS, "base_failed", "kept", "bits"]
    return quality.quality(documents(spark, sf_dir)).select(*columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(documents(spark, sf_dir)).drop("kept_text")


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(documents(spark, sf_dir))


#: The tree's first level: sources by the remainder of their number. Domain 0 is wanted five times as much as domain 2.
WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}}


def domain():
    digits = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("domain"), F.pmod(digits.cast("long"), F.lit(3)).cast("string"))).otherwise(F.lit("other"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), domain(), WEIGHTS, 100, 4, 7)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secrets(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


# Fixed values of the contract: a conversation whose texts look like marks.
TRAP = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    rendered = chatformat.render(chatformat.fold(chatformat.streamed(rows.unionByName(trap))))
    return chatformat.digests(Scratch(spark, "chat").table(rendered, "rendered"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), n_words(F.col("text")), F.xxhash64("text"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_minhash_near_dedup, op4_substring_dedup, op5_flac_media, op6_source_mixing, op7_secret_scan, op8_language_id, op9_chat_format, op10_best_fit_packing, op11_token_alignment, op12_phrases, op13_byte_bpe)
}

ORACLE: dict[str, str] = {
    "op12_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from pieces
), n as (select lang, sum(len(words))::bigint as n from w group by lang
), grams as (
  select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase
  from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where len(words) >= k)
), f as (select lang, k, phrase, count(*)::bigint as a from grams group by all having count(*) >= 30
), cuts as (
  select lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[1 : cut], ' ') as head, array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') as rest
  from (select *, unnest(range(1, k)) as cut from f where k >= 2)
), scored as (
  select c.lang, c.phrase, c.a, x.a as l, y.a as r, (2000000::hugeint * c.a // (x.a::hugeint + y.a))::bigint as score,
    row_number() over (partition by c.lang, c.phrase order by 2000000::hugeint * c.a // (x.a::hugeint + y.a), cut) as best
  from cuts c join f x on c.lang = x.lang and c.head = x.phrase join f y on c.lang = y.lang and c.rest = y.phrase
), inner_parts as (
  select lang, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from f where k >= 3)) group by 1, 2
), kept as (
  select s.* from scored s left join inner_parts p on s.lang = p.lang and s.phrase = p.phrase
  where best = 1 and (longer is null or 100::hugeint * longer < 80::hugeint * s.a)
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000""",
    "op9_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sizes as (
  select *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') as safe,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') as safe_role from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length('<turn role="') + length(safe_role) + length('">') + 1 + length(safe) + length('</turn>') + 1) as bigint) as formatted_chars
from sizes group by conv_id""",
    "op6_source_mixing": r"""
with d as (
  select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens,
    case when regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) <> '' then 'domain' || (cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 3) else 'other' end as domain,
    coalesce(lang, '') as lang, coalesce(source, '') as source, text
  from documents
), leaf as (
  select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * 4 as can, 1::bigint as weight from d group by all
), a as (
  select domain, sum(can)::hugeint as can,
    case domain when 'domain0' then 5 when 'domain1' then 3 else 1 end as weight,
    (select sum(tokens) * 100 // 100 from leaf)::hugeint as of_parent from leaf group by domain
), a1 as (
  select *, coalesce(sum(can) over (order by can / weight, domain rows between unbounded preceding and 1 preceding), 0) as earlier,
    sum(weight) over (order by can / weight, domain rows between current row and unbounded following) as heavier from a
), a2 as (select *, can * heavier <= (of_parent - earlier) * weight as short from a1
), a3 as (
  select *, of_parent - sum(case when short then can else 0 end) over () as rest, greatest(sum(case when short then 0 else weight end) over (), 1) as total,
    sum(case when short then 0 else weight end) over (order by can / weight, domain rows unbounded preceding) as upto from a2
), a4 as (select domain, case when short then can else rest * upto // total - rest * (upto - weight) // total end as budget from a3
), b as (
  select leaf.domain, lang, sum(can)::hugeint as can, case lang when 'en' then 4 when 'fr' then 2 when 'de' then 2 else 1 end as weight, any_value(a4.budget) as of_parent
  from leaf join a4 on leaf.domain = a4.domain group by leaf.domain, lang
), b1 as (
  select *, coalesce(sum(can) over (partition by domain order by can / weight, lang rows between unbounded preceding and 1 preceding), 0) as earlier,
    sum(weight) over (partition by domain order by can / weight, lang rows between current row and unbounded following) as heavier from b
), b2 as (select *, can * heavier <= (of_parent - earlier) * weight as short from b1
), b3 as (
  select *, of_parent - sum(case when short then can else 0 end) over (partition by domain) as rest, greatest(sum(case when short then 0 else weight end) over (partition by domain), 1) as total,
    sum(case when short then 0 else weight end) over (partition by domain order by can / weight, lang rows unbounded preceding) as upto from b2
), b4 as (select domain, lang, case when short then can else rest * upto // total - rest * (upto - weight) // total end as budget from b3
), c as (
  select leaf.*, b4.budget as of_parent from leaf join b4 on leaf.domain = b4.domain and leaf.lang = b4.lang
), c1 as (
  select *, coalesce(sum(can) over (partition by domain, lang order by can / weight, source rows between unbounded preceding and 1 preceding), 0) as earlier,
    sum(weight) over (partition by domain, lang order by can / weight, source rows between current row and unbounded following) as heavier from c
), c2 as (select *, can * heavier <= (of_parent - earlier) * weight as short from c1
), c3 as (
  select *, of_parent - sum(case when short then can else 0 end) over (partition by domain, lang) as rest, greatest(sum(case when short then 0 else weight end) over (partition by domain, lang), 1) as total,
    sum(case when short then 0 else weight end) over (partition by domain, lang order by can / weight, source rows unbounded preceding) as upto from c2
), c4 as (
  select domain, lang, source, tokens, cast(case when short then can else rest * upto // total - rest * (upto - weight) // total end as bigint) as budget from c3
), e as (
  select d.*, c4.budget, case when tokens > 0 then budget // tokens else 0 end as epochs, budget - (case when tokens > 0 then budget // tokens else 0 end) * tokens as rest
  from d join c4 on d.domain = c4.domain and d.lang = c4.lang and d.source = c4.source
), f as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('7:' || epochs || ':' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) as before from e
)
select doc_id, domain, lang, source, n_tokens, budget, cast(epochs as bigint) as epochs, cast(least(n_tokens, greatest(rest - before, 0)) as bigint) as prefix_tokens from f""",
}
