"""Queries of problem 5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators import references as R
from pagewright.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each faulty reference."""
    return _faulty(spark, sf_dir).select("rev_id", "field", "target", "reason")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty references per field, month and reason."""
    return R.orphan_report(_faulty(spark, sf_dir))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.faulty_references(*(table(spark, sf_dir, t) for t in ("corpus_pages", "path_changes", "edge_decls")))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_FAULTY = r"""
with entries as (
  select distinct rev_id, wiki, type, indexed_at, field, target from (
    select rev_id, wiki, type, indexed_at, 'body_links' as field, unnest(body_links) as target from corpus_pages
    union all
    select rev_id, wiki, type, indexed_at, k as field, unnest(v) as target
    from (select rev_id, wiki, type, indexed_at, unnest(map_keys(fields)) as k, unnest(map_values(fields)) as v from corpus_pages)
    where k in ('sources', 'concepts', 'document_refs', 'superseded_by')) where target is not null),
named as (
  select *, regexp_replace(trim(regexp_replace(regexp_replace(trim(target), '^wiki://[^/]+/', ''), '[|#].*$', '', 's')), '\.md$', '') as slug,
    case when trim(target) like 'wiki://%/%' then regexp_extract(trim(target), '^wiki://([^/]+)/', 1) when field <> 'body_links' then wiki end as in_wiki
  from entries),
refs as (select *, case when in_wiki is null then slug else in_wiki || '/' || slug end as key from named where slug <> ''),
pages as (
  select key, min(indexed_at) as first_at, arg_max(type, struct_pack(a := indexed_at, b := rev_id)) filter (type is not null) as t_type, count(*) as n
  from (select slug as key, * from corpus_pages where slug is not null union all select wiki || '/' || slug as key, * from corpus_pages where slug is not null) group by key),
changes as (select wiki, changed_at, change_id, status, regexp_replace(regexp_replace(regexp_replace(path, '^wiki/', ''), '\.md$', ''), '/index$', '') as slug from path_changes where path is not null),
gone as (
  select key, arg_max(status, struct_pack(a := changed_at, b := change_id)) as last
  from (select slug as key, * from changes union all select wiki || '/' || slug as key, * from changes) group by key),
judged as (
  select r.*, case when p.n is null then 'missing' when g.last = 'D' then 'deleted' when p.first_at > r.indexed_at then 'late'
    when len(d.target_types) > 0 and not coalesce(list_contains(d.target_types, p.t_type), false) then 'wrong-type' end as reason
  from refs r left join pages p using (key) left join gone g using (key) left join edge_decls d on d.type = r.type and d.field = r.field)
"""

ORACLE_SQL = {
    "p5_found": _FAULTY + "select rev_id, field, target, reason from judged where reason is not null",
    "p5_report": _FAULTY + "select field, strftime(indexed_at, '%Y-%m') as month, reason, count(*) as n_refs from judged where reason is not null group by all",
}
