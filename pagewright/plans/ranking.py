"""Queries of tokens, statistics, ranking and facets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.catalog import Corpus
from pagewright.config import Search
from pagewright.functions import text as X
from pagewright.operators import index as I
from pagewright.operators import search as S
from pagewright.plans.common import PAGES, QUERY, TOKENS, pages
from pagewright.session import shared_dir, table
from pagewright.sources.embeddings import unit

VECTOR = [round(((k * 37) % 23 - 11) / 90.0, 6) for k in range(64)]


def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the bodies of all documents with their counts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def q_weighted_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.postings(pages(spark, sf_dir))


def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.term_stats(I.postings(pages(spark, sf_dir)))


def q_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.corpus_stats(pages(spark, sf_dir), per_wiki=True)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("wiki", "slug", "score")


def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(S.keyword(pages(spark, sf_dir), QUERY))


def q_bm25_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(S.keyword(pages(spark, sf_dir), QUERY, type="concept", k=25))


def q_bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the query, from postings."""
    p = pages(spark, sf_dir)
    scored = S.bm25_postings(I.postings(p), p.select("wiki", "slug", X.bag_length().alias("len")), QUERY)
    return scored.select("wiki", "slug", F.round("bm25", 4).alias("bm25"))


def q_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best pages with their excerpts."""
    return S.keyword(pages(spark, sf_dir), QUERY, excerpts=True)


def q_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(S.semantic(pages(spark, sf_dir).withColumn("embedding", _usable()), VECTOR, k=20))


def _usable() -> Column:
    """Vectors of the query's width without NaN; others count as never embedded."""
    return F.when((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x)), F.col("embedding"))


def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return _hits(S.hybrid(p.withColumn("embedding", S.normalise(_usable())), QUERY, VECTOR, k=20))


def q_cross_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(S.cross_wiki(pages(spark, sf_dir), QUERY))


# Queries of the batch, numbered from 0.
BATCH = [
    "sparse router gating", "检索 索引", "chunk store rebuild", "evaluation harness noise", "schema changes", "nested prompt paragraph", "stale backlinks in the graph", "community detector", "分词器 稳定 模式", "gating layer heuristic", "histogram histogram shard", "zyzzyva",
]


def store(spark: SparkSession, sf_dir: str) -> I.Store:
    """The index of a data folder in the shared folder, written once in a session."""
    name = hashlib.md5(f"{spark.sparkContext.applicationId} {sf_dir}".encode()).hexdigest()
    found = I.Store(spark, f"{shared_dir(spark)}/index-{name}")
    if not found.versions():
        found.write(pages(spark, sf_dir), I.State("", "", "simple", 0, 0, {}))
    return found


def q_search_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword search of q_bm25 from the persisted postings."""
    return Corpus(pages(spark, sf_dir), store=store(spark, sf_dir)).search(QUERY).select("wiki", "slug", "title", "score")


def q_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten pages of many queries in one job from the persisted postings."""
    return Corpus(pages(spark, sf_dir), store=store(spark, sf_dir)).batch(BATCH)


def q_search_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search entry with a query that a provider embeds."""
    p = pages(spark, sf_dir).withColumn("embedding", _usable())
    return _hits(S.entry(p, QUERY, "semantic", lambda texts: [VECTOR for _ in texts], k=20))


def q_search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).withColumn("embedding", S.normalise(_usable()))
    return _hits(S.entry(p, QUERY, "hybrid", lambda texts: [VECTOR for _ in texts], k=20))


def q_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type navigation: types with their pages, sections left out."""
    return Corpus(pages(spark, sf_dir)).types()


def q_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of the embeddings table, summed up by component to compare."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", S.normalise(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def q_facets_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facet(S.candidates(pages(spark, sf_dir)), "type")


def q_facets_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facet(S.candidates(pages(spark, sf_dir)), "status")


def q_facets_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facet_tags(S.candidates(pages(spark, sf_dir)), Search().facet_tags)


def q_facets_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.facets_in_one_scan(pages(spark, sf_dir))


def q_facets_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merged_tag_facets(S.candidates(pages(spark, sf_dir)), 5)


QUERIES = {f.__name__: f for f in (q_tokens, q_weighted_bag, q_term_stats, q_corpus_stats, q_bm25, q_bm25_type_filter, q_bm25_postings, q_excerpts, q_semantic_topk, q_hybrid, q_cross_wiki, q_search_store, q_search_batch, q_search_semantic, q_search_hybrid, q_types, q_normalise, q_facets_type, q_facets_status, q_facets_tags, q_facets_one_scan, q_facets_merged)}

_TERMS = "(values " + ", ".join(f"('{t}', {n})" for t, n in sorted({t: X.query_tokens(QUERY).count(t) for t in X.query_tokens(QUERY)}.items())) + ") as q(term, times)"
_STATUS = "case when coalesce(status, '') = 'active' then 1.0 when status = 'draft' then 0.8 when status = 'archived' then 0.3 else 0.9 end"


def _scores(by_wiki: bool = False) -> str:
    """CTEs up to scored(wiki, slug, bm25, the columns of pages)."""
    key = "s.wiki = t.wiki" if by_wiki else "true"
    group = "wiki" if by_wiki else "1"
    return TOKENS + f""",
lens as (select p.wiki, p.slug, coalesce(sum(t.w), 0) as len from pages p left join tokens t using (wiki, slug) group by p.wiki, p.slug),
stats as (select {"wiki" if by_wiki else "1 as one"}, count(*) as n, avg(len) as avg_len from lens group by {group}),
tf as (select wiki, slug, term, sum(w) as tf from tokens where term in (select term from {_TERMS}) group by all),
df as (select {"wiki," if by_wiki else ""} term, count(*) as df from tf group by all),
bits as (select t.wiki, t.slug, q.times * log2(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg_len)) as x
  from tf t join lens l using (wiki, slug) join stats s on {key} join df d on d.term = t.term {"and d.wiki = t.wiki" if by_wiki else ""} join {_TERMS} on q.term = t.term),
bm as (select wiki, slug, sum(x) as bm25 from bits group by all),
scored as (select p.*, coalesce(b.bm25, 0) as bm25, {_STATUS} * coalesce(confidence, 1.0) as mult from pages p left join bm b using (wiki, slug) where coalesce(type, '') <> 'section')
"""


_UNIT = unit(VECTOR)
_BATCH = "(values " + ", ".join(f"({k}, '{t}', {X.query_tokens(q).count(t)})" for k, q in enumerate(BATCH) for t in sorted(set(X.query_tokens(q)))) + ") as q(query_id, term, times)"
_ROUND = "trunc(score * 100 + 0.5) / 100"


def _vector(v: list[float]) -> str:
    return "[" + ", ".join(f"{x!r}::double" for x in v) + "]"


_VEC = _vector(VECTOR)
_COS = f"list_inner_product(cast(embedding as double[]), {_VEC})"



def _hybrid(vector: str) -> str:
    return _scores() + f""", unit as (select *, case when len(embedding) = 64 and len([1 for x in embedding if isnan(x)]) = 0 then [cast(case when nn > 0 then x / nn else x end as float)::double for x in embedding] end as u
  from (select *, sqrt(list_sum([x::double * x::double for x in embedding])) as nn from scored)),
mixed as (select *, (0.5 * coalesce(greatest(list_sum([x[1] * x[2] for x in list_zip(u, {vector})]), 0), 0) + 0.5 * bm25 / (select max(bm25) from scored)) * mult as score from unit)
select wiki, slug, {_ROUND} as score from (select * from mixed where score > 0 order by score desc, slug, wiki limit 20)"""


ORACLE_SQL = {
    "q_tokens": r"select doc_id, term, count(*) as n from (select doc_id, lower(unnest(regexp_extract_all(regexp_replace(text, '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{Nd}]+|\p{Han}'))) as term from documents where text is not null) group by all",
    "q_weighted_bag": TOKENS + "select wiki, slug, term, cast(sum(w) as int) as tf from tokens group by all",
    "q_term_stats": TOKENS + "select term, count(*) as df from (select distinct wiki, slug, term from tokens) group by term",
    "q_corpus_stats": TOKENS + ", lens as (select p.wiki, p.slug, coalesce(sum(t.w), 0) as len from pages p left join tokens t using (wiki, slug) group by all) select wiki, count(*) as n, cast(sum(len) as bigint) as total_len, avg(len) as avg_len from lens group by wiki",
    "q_bm25": _scores() + f"select wiki, slug, {_ROUND} as score from (select *, bm25 * mult as score from scored where bm25 > 0 order by bm25 * mult desc, slug, wiki limit 10)",
    "q_bm25_type_filter": _scores() + f"select wiki, slug, {_ROUND} as score from (select *, bm25 * mult as score from scored where bm25 > 0 and type = 'concept' order by bm25 * mult desc, slug, wiki limit 25)",
    "q_bm25_postings": _scores() + "select wiki, slug, round(bm25, 4) as bm25 from bm",
    "q_semantic_topk": PAGES + f"select wiki, slug, {_ROUND} as score from (select *, {_COS} * {_STATUS} * coalesce(confidence, 1.0) as score from pages where coalesce(type, '') <> 'section' and len(embedding) = 64 and len([1 for x in embedding if isnan(x)]) = 0 order by score desc, slug, wiki limit 20)",
    "q_hybrid": _hybrid(_VEC),
    "q_cross_wiki": _scores(True) + f"select wiki, slug, score from (select wiki, slug, {_ROUND} as score from (select *, bm25 * mult as score, row_number() over (partition by wiki order by bm25 * mult desc, slug) as r from scored where bm25 > 0) where r <= 10) order by score desc, slug, wiki limit 10",
    "q_search_store": _scores() + f"select wiki, slug, title, {_ROUND} as score from (select *, bm25 * mult as score from scored where bm25 > 0 order by bm25 * mult desc, slug, wiki limit 10)",
    "q_search_batch": TOKENS + f""",
lens as (select p.wiki, p.slug, coalesce(sum(t.w), 0) as len from pages p left join tokens t using (wiki, slug) group by p.wiki, p.slug),
stats as (select count(*) as n, avg(len) as avg_len from lens),
tf as (select wiki, slug, term, sum(w) as tf from tokens where term in (select term from {_BATCH}) group by all),
df as (select term, count(*) as df from tf group by all),
bm as (select q.query_id, t.wiki, t.slug, sum(q.times * log2(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg_len))) as bm25
  from {_BATCH} join tf t on t.term = q.term join df d on d.term = q.term join lens l using (wiki, slug) cross join stats s group by all),
ranked as (select query_id, wiki, slug, bm25 * {_STATUS} * coalesce(confidence, 1.0) as score from bm join pages using (wiki, slug) where coalesce(type, '') <> 'section')
select * from (select query_id, row_number() over (partition by query_id order by score desc, slug, wiki) as rank, wiki, slug, {_ROUND} as score from ranked) where rank <= 10""",
    "q_search_semantic": PAGES + f"select wiki, slug, {_ROUND} as score from (select *, {_COS.replace(_VEC, _vector(_UNIT))} * {_STATUS} * coalesce(confidence, 1.0) as score from pages where coalesce(type, '') <> 'section' and len(embedding) = 64 and len([1 for x in embedding if isnan(x)]) = 0 order by score desc, slug, wiki limit 20)",
    "q_search_hybrid": _hybrid(_vector(_UNIT)),
    "q_types": PAGES + "select type as value, count(*) as n from pages where coalesce(type, '') not in ('', 'section') group by type",
    "q_normalise": "select vec_id, round(list_sum([cast(x / n as float)::double for x in embedding]), 4) as total from (select *, sqrt(list_sum([x::double * x::double for x in embedding])) as n from embeddings)",
    "q_facets_type": PAGES + "select type as value, count(*) as n from pages where coalesce(type, '') not in ('', 'section') group by type",
    "q_facets_status": PAGES + "select status as value, count(*) as n from pages where coalesce(type, '') <> 'section' and coalesce(status, '') <> '' group by status",
    "q_facets_tags": PAGES + "select value, count(*) as n from (select unnest(tags) as value from pages where coalesce(type, '') <> 'section') group by value order by n desc, value limit 10",
    "q_facets_one_scan": PAGES + "select 'type' as facet, type as value, count(*) as n from pages where coalesce(type, '') <> '' group by type union all select 'status', status, count(*) from pages where coalesce(status, '') <> '' group by status",
    "q_facets_merged": PAGES + ", c as (select wiki, value, count(*) as n from (select wiki, unnest(tags) as value from pages where coalesce(type, '') <> 'section') group by all) select value, cast(sum(n) as bigint) as n from (select *, row_number() over (partition by wiki order by n desc, value) as r from c) where r <= 5 group by value order by n desc, value limit 5",
}
