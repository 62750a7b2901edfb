"""The registered queries of the training-data operators, and SQL for those that it can express.

Each query reads its whole table and returns its operator's rows; what becomes of nulls, empty and very long texts, ties,
repeated rows, empty tables and other columns is said in the operator's own docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm._common import read_table
from loomframe.llm.decontamination import find_contaminated
from loomframe.llm.jaccard_join import similarity_classes
from loomframe.llm.language_id import identify_languages
from loomframe.llm.mixing import offset, plan_mix
from loomframe.llm.quality_cnn import score_quality
from loomframe.llm.quality_rules import judge_quality
from loomframe.llm.sharding import assign_shards
from loomframe.llm.toxicity import score_toxicity
from loomframe.llm.url_filter import judge_urls
from loomframe.llm.warc import roundtrip

SEED = 7


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(read_table(spark, sf_dir, "documents"), seed=SEED).drop("copies", "key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 40)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read_table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_quality_rules, op3_mixing, op4_toxicity, op5_url_filters, op6_decontamination, op7_warc, op8_sharding, op9_jaccard_join, op10_language_id)
}

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": rf"""
with sized as (
  select doc_id, source, text, cast(coalesce(len({_WORDS.format("text")}), 0) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), ranked as (
  select *, cast(source_size * 2 as double) as cap,
         cast([3, 1, 2][1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)] as double) as weight from sources
), levelled as (
  select *, (sum(source_size) over () * 150 / 100.0
             - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
         cap / weight as fill from ranked
), water as (
  select arg_min(level, fill) as water from levelled where level * weight <= cap
), targets as (
  select source, source_size, case when water is null then cap else least(cap, water * weight) end as target from levelled, water
), placed as (
  select s.doc_id, s.size, t.source_size, t.target,
         row_number() over (partition by s.source order by s.size, s.doc_id nulls first) as n,
         case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(size * (floor(n * rate + {offset(SEED)!r}) - floor((n - 1) * rate + {offset(SEED)!r})) as bigint) as taken
from placed""",
    "op6_decontamination": r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), b as (
  select item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from benchmark
), ds as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)
), bs as (
  select distinct item_id, array_to_string(w[i : i + 4], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 3)) as i from b)
), n as (
  select item_id, count(*) as n_item from bs group by item_id
)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item
from ds join bs using (s) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 80 * any_value(n_item)""",
    "op7_warc": r"""
with p as (
  select page_id, coalesce(html, '') as html from pages
), h as (
  select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p
), k as (
  select *, max(page_id) over (partition by hex) as kept from h
)
select page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(hex, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as int), 1) for i in range(32)], '') as payload_digest,
       case when page_id < kept then 'revisit' else 'response' end as record_type,
       case when page_id < kept then kept end as refers_to
from k""",
    "op9_jaccard_join": r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from d where len(w) > 0)
), n as (
  select d.doc_id, count(s.s) as n from d left join s using (doc_id) group by d.doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), least_of as (
  select a, min(b) as m from reach group by a
)
select n.doc_id, n.n as n_shingles, coalesce(least(n.doc_id, m), n.doc_id) as component_id from n left join least_of on a = n.doc_id""",
}
