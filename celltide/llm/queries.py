"""One query for each operator over its whole table, with production parameters, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, license, mixing, neardup, sharding, tokencount, topk, toxicity, urlfilter
from .common import table

#: Rules of op4: (host and path, verdict).
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Shards of op7 and of the pipeline.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix holds each document: sources at 5, 2 and 1, longer documents repeated sooner than short ones."""
    return mixing.mix(table(spark, sf_dir, "documents"), weight_col=mixing.longer_first()).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled four fifths by crc32 of the doc_id; the rest is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = langid.train(docs, ~held_out)
    return docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), langid.predict(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document under a model of the labels' grades, learned from a bounded sample of labelled rows."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id", F.col("toxic").alias("grade"))
    # at most SAMPLE_ROWS labels of each of MAX_GRADES grades are picked first, so that texts without one aren't moved
    chosen = F.broadcast(toxicity.smallest(labels, F.col("doc_id")))
    model = toxicity.train(docs.join(chosen, "doc_id"))
    return toxicity.severity(docs, model)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; blocks reach the aliases that pages declare."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, and after two rounds of edits to the trees that are kept: first a new beginning
    and a changed middle, then an end."""
    edit = lambda at, remove, put: F.struct(at.cast("int").alias("at"), F.lit(remove).alias("remove"), F.lit(put).alias("put"))
    n = F.length("text")
    first = tokencount.token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("n_tokens", "n_first")
    edits = F.array(edit(F.lit(0), 0, "Draft: "), edit(F.floor(n / 2), 12, " [edited] "))
    once = tokencount.edited_counts(first.withColumn("edits", edits), passed=["n_first"]).withColumnRenamed("n_reencoded", "n_once")
    twice = tokencount.edited_counts(once.withColumn("edits", F.array(edit(n, 0, "\nEnd."))), passed=["n_first", "n_once"])
    return twice.select("doc_id", F.col("n_first").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), (F.col("n_once") + F.col("n_reencoded")).alias("n_reencoded"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document, linked by 85 % of three-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Config(words=3, percent=85))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and the shard of every document."""
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.select("vec_id", topk.quantised("embedding").alias("v")), F.col("vec_id") % 20 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that are within windows of benchmark items, and which items those are."""
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document holds, and the best match."""
    found = license.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_units", "license", F.round("dice", 6).alias("dice"), F.array_join("licenses", ",").alias("licenses"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pareto_mix, op2_language_id, op3_toxicity, op4_url_filter, op5_token_counts, op6_near_duplicates, op7_sharding, op8_top_k, op9_decontaminate, op10_license_scan)}


_MIX = r"""
with t as (
  select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) as size,
    ((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::bigint) + 0.5::double) / 4503599627370496.0::double as u
  from documents
), d as (
  select *, 1000 * (least(size // 200, 3) + 1) as wish from t
), s as (
  select source, sum(size)::double as source_size from d group by source
), w as (
  select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from s
), f as (
  select *, 2.0::double * source_size / w as fill from w
), l as (
  select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from f window before as (order by fill, source is null, source rows between unbounded preceding and 1 preceding)
), lv as (
  select level from l where level < fill order by fill, source is null, source limit 1
), g as (
  select source, source_size, coalesce(least(2.0::double * source_size, w * (select level from lv)), 2.0::double * source_size) as target from l
), n as (
  select source, wish, sum(size) as words from d group by all
), a as (
  select n.*, g.source_size, g.target, coalesce(sum(words) over (partition by n.source order by wish desc rows between unbounded preceding and 1 preceding), 0)::double as fixed,
    (sum(words * wish) over (partition by n.source order by wish rows unbounded preceding))::double as free
  from n join g on n.source is not distinct from g.source
), b as (
  select *, case when free > 0 then (target - 2.0::double * fixed) / free end as c from a
), c as (
  select source, any_value(source_size) as source_size, any_value(target) as target,
    coalesce(arg_max(c, wish) filter (c * wish < 2.0::double), arg_min(c, wish) filter (c is not null), 0.0::double) as c from b group by source
), x as (
  select d.*, c.source_size, c.target, least(2.0::double, c.c * wish) as want from d join c on d.source is not distinct from c.source
), p as (
  select *, floor(want)::bigint as certain, want - floor(want) as p from x
), z as (
  select *, case when p > 0 and size > 0 then ((u / (1 - u)) / (p / (1 - p))) end as odds from p
), r as (
  select *, least(odds / (1 + odds), 1 - power(2.0::double, -40)) as z, target - sum(certain * size) over (partition by source) as rest from z
), o as (
  select *, coalesce(sum(case when odds is not null then size end) over (partition by source order by case when odds is null then 2 else z end, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before from r
)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  ((certain + case when odds is not null and before + size / 2.0::double <= rest then 1 else 0 end) * size)::bigint as taken
from o
"""

_URL = r"""
with p as (
  select page_id, url, html,
    case when url like '%://%' then translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '://[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), rules(h, q, rule, says) as (
  values ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'block'), ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')
), own as (
  select p.*, r.rule, r.says from p left join (
    select page_id as id, url as u, max_by(rule, length(rule)) as rule, max_by(says, length(rule)) as says
    from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by 1, 2
  ) r on p.page_id is not distinct from r.id and p.url is not distinct from r.u
)
select page_id, host, path, rule, coalesce(says, 'allow') as verdict from own
"""

_NEAR = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w
), e as (
  select doc_id, len(s) as n, unnest(s) as x from s
), shared as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all
), links as (
  select a as u, b as v from shared where 100 * k >= 85 * (na + nb - k)
), both_ways as (
  select u, v from links union select v, u from links
), reach(node, root) as (
  select distinct u, u from both_ways union select v, root from reach join both_ways on u = node
), c as (
  select node, min(root) as root from reach group by node
)
select doc_id, len(s)::bigint as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
from s left join c on node = doc_id
"""

_TOP = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""

_LEAK = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark
), win as (
  select distinct item_id, n, g from (
    select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) as g from iw where len(w) > 0
  )
), sizes as (
  select distinct n from win
), occ as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) as g from dw, sizes where len(w) >= n
), hit as (
  select doc_id, item_id, i, n from occ join win using (n, g)
), words as (
  select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id
), items as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id
)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""


def _license_sql() -> str:
    rows = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(license.TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    return rf"""
with t(template, license, body) as (values {rows}
), tg as (
  select template, license, {grams} as g from (select *, {words.format("body")} as w from t)
), lines as (
  select doc_id, text, regexp_split_to_array(text, '\r\n|\n|\r') as l from documents where text is not null
), u as (
  select doc_id, unnest(range(1, len(l) + 1)) as unit, unnest(l) as body from lines
  union all select doc_id, 0, text from lines where len(l) > 1
), ug as (
  select doc_id, unit, {grams} as g from (select *, {words.format("body")} as w from u)
), m as (
  select doc_id, unit, template, license, 2.0::double * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) as dice
  from ug join tg on len(ug.g) * 1.2 >= 0.8 * len(tg.g) and len(ug.g) * 0.8 <= 1.2 * len(tg.g)
), f as (
  select * from m where dice >= 0.8
), b as (
  select doc_id, count(distinct unit) as n_units, first(license order by dice desc, template, unit) as license, max(dice) as dice, string_agg(distinct license, ',' order by license) as licenses from f group by doc_id
)
select d.doc_id, coalesce(n_units, 0)::bigint as n_units, license, round(dice, 6) as dice, coalesce(licenses, '') as licenses from documents d left join b using (doc_id)
"""


def _shard_sql() -> str:
    """The table of slots is that of ``lookup_table``, which has a test of its own; slots and look-ups are SQL's."""
    at = ", ".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""
with s as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 15))::bigint % {sharding.TABLE_SIZE} as slot from documents),
t as (select unnest(range({sharding.TABLE_SIZE})) as slot, unnest([{at}]) as k)
select doc_id, slot, 'shard-' || lpad(k::varchar, 3, '0') as shard from s join t using (slot)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": _MIX,
        "op4_url_filter": _URL,
        "op6_near_duplicates": _NEAR,
        "op7_sharding": _shard_sql(),
        "op8_top_k": _TOP,
        "op9_decontaminate": _LEAK,
        "op10_license_scan": _license_sql(),
    }
