"""Shared parts of queries and of the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators.index import current_pages
from pagewright.session import table

QUERY = "sparse router gating 检索 索引 router"
AS_OF = "2025-06-30"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of each page."""
    return current_pages(table(spark, sf_dir, "corpus_pages"))


# pages: newest delivery of each page
PAGES = """
with recursive pages as (
  select * exclude (rn) from (select *, row_number() over (partition by wiki, slug order by indexed_at desc nulls last, rev_id desc) as rn from corpus_pages where slug is not null) where rn = 1)
"""

# tokens: one row a token of title, summary and body with its weight
TOKENS = PAGES + r""",
parts as (
  select wiki, slug, 3 as w, title as x from pages union all select wiki, slug, 2, summary from pages union all select wiki, slug, 1, body from pages),
tokens as (
  select wiki, slug, w, lower(unnest(regexp_extract_all(regexp_replace(coalesce(x, ''), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{Nd}]+|\p{Han}'))) as term from parts)
"""

# edges and nodes of the graph
EDGES = PAGES + """,
raw as (
  select f.wiki, f.slug as src, unnest(f.targets) as dst, d.relation
  from (select wiki, slug, type, unnest(map_keys(fields)) as field, unnest(map_values(fields)) as targets from pages) f
  join (select distinct type, field, relation from edge_decls) d on d.type = f.type and d.field = f.field
  union all select wiki, slug, unnest(body_links), 'links-to' from pages),
edges as (
  select r.wiki, src, dst, relation from raw r where dst like 'wiki://%'
  union all select r.wiki, src, dst, relation from raw r join pages p on p.wiki = r.wiki and p.slug = r.dst where dst not like 'wiki://%' and src <> dst),
nodes as (
  select wiki, slug, coalesce(title, '') as title, coalesce(type, '') as type, false as external from pages
  union all select distinct wiki, dst, dst, '', true from edges where dst like 'wiki://%')
"""
