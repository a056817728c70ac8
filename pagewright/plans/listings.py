"""Queries of listing, export, text functions, links, history and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import links as L
from pagewright.functions import text as X
from pagewright.operators import index as I
from pagewright.operators import listing
from pagewright.plans.common import PAGES, pages
from pagewright.session import spread, table
from pagewright.streaming.watch import debounce


# A page that others name.
SOURCE = "sources/kocuhipe-sampling"


def q_current_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("wiki", "slug", "rev_id")


def q_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.page_list(pages(spark, sf_dir), 2, 20, status="active").select("slug", "wiki", "title", "total")


def q_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.recent(pages(spark, sf_dir))


def q_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.all_backlinks(pages(spark, sf_dir))


def q_with_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword field equality: pages that name one source."""
    return listing.with_field(pages(spark, sf_dir), "tags_of", "none").unionByName(listing.with_field(pages(spark, sf_dir), "sources", SOURCE))


def q_backlinks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to one page."""
    return listing.backlinks(pages(spark, sf_dir), SOURCE)


def q_export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.export_order(pages(spark, sf_dir)).select("wiki", "slug", "place", "n_type")


def q_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.export_lines(pages(spark, sf_dir)).select("wiki", "place", "line")


def q_export_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.export_full(pages(spark, sf_dir))


def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.export_json(pages(spark, sf_dir))


def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.history(table(spark, sf_dir, "commits"), "wiki/index.md").select("wiki", "hash", "date")


def q_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.activity(table(spark, sf_dir, "commits")).select("wiki", "hash", "date")


def q_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries as the index, newest ones as the rescan, path_changes as the change set."""
    p = table(spark, sf_dir, "corpus_pages")
    old = p.filter("slug is not null").groupBy("wiki", "slug").agg(F.min_by("rev_id", F.struct("indexed_at", "rev_id")).alias("rev_id"))
    return I.apply_changes(old, I.last_changes(table(spark, sf_dir, "path_changes")), pages(spark, sf_dir).select("wiki", "slug", "rev_id"))


def q_last_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_changes(table(spark, sf_dir, "path_changes"))


def q_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.count_pages(pages(spark, sf_dir))


def q_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path changes of a wiki, collected until it is quiet for an hour."""
    d = debounce(table(spark, sf_dir, "path_changes"), "1 hour")
    return d.select("wiki", "opened_at", F.array_join("paths", ",").alias("paths"), "n_events")


def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks of all bodies."""
    p = table(spark, sf_dir, "corpus_pages")
    return p.select("rev_id", F.explode(L.wikilinks(F.col("body"))).alias("link"))


def q_body_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks and inline links of all bodies, relative ones resolved against the folder of the page."""
    rows = table(spark, sf_dir, "corpus_pages").filter("body is not null").select("rev_id", "slug", "body")
    folder = F.regexp_replace(F.coalesce("slug", F.lit("")), r"/?[^/]+$", "")
    return spread(rows, "rev_id").select("rev_id", F.posexplode(L.body_links_udf("body", folder)).alias("n", "link"))


def q_link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    rows = p.select("wiki", "slug", F.explode(L.page_links()).alias("link"))
    return rows.withColumn("c", L.classify(F.col("link"))).groupBy("c.wiki", "c.cross").agg(F.count(F.lit(1)).alias("n"))


def q_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.element_at(F.split("slug", "/"), -1)
    return pages(spark, sf_dir).select("wiki", "slug", X.title_case(stem).alias("name"))


def q_heading_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.element_at(F.split("slug", "/"), -1)
    return pages(spark, sf_dir).select("wiki", "slug", X.heading_title(F.col("body"), stem).alias("name"))


def q_slug_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of body_links as slugs."""
    rows = table(spark, sf_dir, "corpus_pages").select(F.explode("body_links").alias("entry")).distinct()
    return rows.select("entry", X.valid_slug(F.col("entry")).alias("ok"))


def q_slug_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "path_changes").select("path").distinct()
    return rows.select("path", X.slug_of_path(F.regexp_replace("path", "^wiki/", "")).alias("slug"))


def q_uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "corpus_pages").select(F.explode(F.try_element_at("fields", F.lit("sources"))).alias("entry")).distinct()
    return p.withColumn("u", X.parse_uri(F.col("entry"), "handbook", ["handbook", "atlas"])).select("entry", "u.wiki", "u.slug")


def q_confidence_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence given as text: numbers of pages, words, and what is no confidence."""
    raw = F.when(F.col("rev_id") % 5 == 0, F.element_at(F.array(*[F.lit(w) for w in ("high", "medium", "low", "none", "7", "-1", "NaN")]), (F.col("rev_id") % 7 + 1).cast("int"))).otherwise(F.col("confidence").cast("string"))
    return table(spark, sf_dir, "corpus_pages").select("rev_id", X.confidence(raw).alias("confidence"))


def q_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_pages").select("rev_id", F.md5(X.embed_text(300).cast("binary")).alias("digest"))


def q_embed_text_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding text under the limit of its wiki: max_text_chars, or 4000 where that is missing or not positive."""
    most = table(spark, sf_dir, "embed_config").groupBy("wiki").agg(F.max("max_text_chars").alias("_most"))
    rows = table(spark, sf_dir, "corpus_pages").join(most, "wiki", "left")
    limit = F.when(F.col("_most") > 0, F.col("_most")).otherwise(4000)
    return rows.select("rev_id", F.md5(X.embed_text(limit).cast("binary")).alias("digest"))


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret patterns over all bodies: one row a line and pattern."""
    p = table(spark, sf_dir, "corpus_pages").filter("body is not null").select("rev_id", "body")
    found = X.redact_secrets(p, "rev_id", "body")
    return found.select("rev_id", F.explode("matches").alias("m")).select("rev_id", "m.pattern_name", "m.line_number")


def q_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "corpus_pages").select("rev_id", F.md5(X.html_escape(F.coalesce("body", F.lit(""))).cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        q_current_pages, q_list_page, q_recent, q_backlinks, q_backlinks_of, q_with_field, q_export_order, q_export_lines, q_export_full, q_export_json, q_history, q_activity, q_incremental_merge, q_last_changes, q_page_counts, q_debounce_sessions,
        q_links, q_body_links, q_link_classes, q_title_case, q_heading_title, q_slug_valid, q_slug_of_path, q_uri_parse, q_confidence_norm, q_embed_text, q_embed_text_effective, q_secrets, q_html_escape,
    )
}

_LAST = r"""
slugged as (select wiki, regexp_replace(regexp_replace(regexp_replace(path, '^wiki/', ''), '\.[^./]+$', ''), '/index$', '') as slug, status, changed_at, change_id from path_changes where path is not null),
last as (select wiki, slug, arg_max(status, struct_pack(a := changed_at, b := change_id)) as status from slugged where slug <> 'index' group by all)
"""
_ORDER = """, live as (select *, coalesce(type, '') as t, coalesce(title, '') as ti, coalesce(confidence, 1.0) as c from pages where coalesce(status, '') <> 'archived'),
counted as (select *, count(*) over (partition by wiki, t) as n_type from live),
placed as (select *, row_number() over (partition by wiki order by n_type desc, t, c desc, ti, slug) as place from counted)
"""
_SECRET = [("github-pat", "ghp_[A-Za-z0-9]{36}"), ("openai-key", "sk-[A-Za-z0-9]{48}"), ("anthropic-key", r"sk-ant-[A-Za-z0-9\-]{90,}"), ("aws-access-key", "AKIA[0-9A-Z]{16}"), ("bearer-token", r"Bearer [A-Za-z0-9\-._~+/]{20,}"), ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")]

ORACLE_SQL = {
    "q_current_pages": PAGES + "select wiki, slug, rev_id from pages",
    "q_list_page": PAGES + "select slug, wiki, title, (select count(*) from pages where status = 'active') as total from pages where status = 'active' order by slug, wiki limit 20 offset 20",
    "q_recent": PAGES + "select wiki, slug, title, coalesce(text_vals['last_updated'], '') as last_updated from pages order by coalesce(text_vals['last_updated'], '') desc, slug, wiki limit 20",
    "q_backlinks": PAGES + "select target, count(*) as n_pages from (select distinct wiki, slug, unnest(body_links) as target from pages) where target is not null group by target",
    "q_with_field": PAGES + f"select wiki, slug from pages where list_contains(fields['sources'], '{SOURCE}')",
    "q_backlinks_of": PAGES + f"select wiki, slug, title from pages where list_contains(body_links, '{SOURCE}')",
    "q_heading_title": PAGES + r"""select wiki, slug, case when found <> '' then found else array_to_string([upper(w[1]) || w[2:] for w in string_split(regexp_replace(string_split(slug, '/')[-1], '\.md$', ''), '-')], ' ') end as name
from (select *, trim(regexp_extract(replace(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^[ \t]*# [ \t]*(\S[^\n]*)', 1)) as found from pages)""",
    "q_export_order": PAGES + _ORDER + "select wiki, slug, place, n_type from placed",
    "q_export_lines": PAGES + _ORDER + "select wiki, place, '- [' || ti || '](' || uri || ')' || case when coalesce(summary, '') = '' then '' else ': ' || summary end as line from placed",
    "q_export_full": PAGES + _ORDER + r"select wiki, place, '---' || chr(10) || chr(10) || '# [' || ti || '](' || uri || ')' || chr(10) || chr(10) || case when coalesce(summary, '') = '' then '' else '_' || summary || '_' || chr(10) || chr(10) end || trim(coalesce(body, '')) || chr(10) || chr(10) as text from placed" + " union all select wiki, 0, '# ' || wiki || chr(10) || chr(10) || count(*) || ' pages' || chr(10) || chr(10) from live group by wiki",
    "q_history": "select wiki, hash, date from (select wiki, hash, date from commits where path = 'wiki/index.md' group by all) order by date desc, hash, wiki limit 10",
    "q_activity": "select wiki, hash, date from (select wiki, hash, date from commits group by all) order by date desc, hash, wiki limit 15",
    "q_incremental_merge": PAGES + "," + _LAST + """, old as (select wiki, slug, arg_min(rev_id, struct_pack(a := indexed_at, b := rev_id)) as rev_id from corpus_pages where slug is not null group by all)
select wiki, slug, rev_id from old where (wiki, slug) not in (select wiki, slug from last)
union all select p.wiki, p.slug, p.rev_id from pages p join last l on l.wiki = p.wiki and l.slug = p.slug where l.status <> 'D'""",
    "q_last_changes": "with " + _LAST.strip() + " select wiki, slug, status from last",
    "q_page_counts": PAGES + "select count(*) filter (coalesce(type, '') <> 'section') as pages, count(*) filter (type = 'section') as sections from pages",
    "q_debounce_sessions": """
with g as (select *, case when changed_at >= lag(changed_at) over w + interval 1 hour then 1 else 0 end as fresh from path_changes window w as (partition by wiki order by changed_at)),
s as (select *, sum(fresh) over (partition by wiki order by changed_at range unbounded preceding) as session from g)
select wiki, min(changed_at) as opened_at, array_to_string(list_sort(list(distinct path)), ',') as paths, count(*) as n_events from s group by wiki, session""",
    "q_links": r"select distinct rev_id, link from (select rev_id, trim(unnest(regexp_extract_all(body, '\[\[(.*?)\]\]', 1, 's'))) as link from corpus_pages) where link <> ''",
    "q_link_classes": PAGES + """select wiki, cross_wiki as "cross", count(*) as n from (
  select case when link similar to 'wiki://[^/]*/.*' then regexp_extract(link, '^wiki://([^/]*)/', 1) end as wiki, link similar to 'wiki://[^/]*/.*' as cross_wiki
  from (select distinct wiki as w, slug, unnest(list_concat(coalesce(fields['sources'], []), coalesce(fields['concepts'], []), coalesce(body_links, []))) as link from pages) where link is not null) group by all""",
    "q_title_case": PAGES + "select wiki, slug, array_to_string([upper(w[1]) || w[2:] for w in string_split(string_split(slug, '/')[-1], '-')], ' ') as name from pages",
    "q_slug_valid": r"select entry, entry <> '' and not regexp_matches(entry, '(^|/)(\.|$)|^/|//') and not regexp_matches(string_split(entry, '/')[-1], '\.[^.]+$') as ok from (select distinct unnest(body_links) as entry from corpus_pages)",
    "q_slug_of_path": r"select path, regexp_replace(regexp_replace(regexp_replace(path, '^wiki/', ''), '\.[^./]+$', ''), '/index$', '') as slug from (select distinct path from path_changes where path <> 'wiki/index.md') union all select distinct path, null from path_changes where path = 'wiki/index.md'",
    "q_uri_parse": "select entry, case when entry similar to 'wiki://(handbook|atlas)/.+' then regexp_extract(entry, '^wiki://([^/]+)/', 1) else 'handbook' end as wiki, case when entry similar to 'wiki://(handbook|atlas)/.+' then regexp_replace(entry, '^wiki://[^/]+/', '') else regexp_replace(entry, '^wiki://', '') end as slug from (select distinct unnest(fields['sources']) as entry from corpus_pages)",
    "q_confidence_norm": "select rev_id, case when rev_id % 5 = 0 then [0.9, 0.5, 0.2, null, 1.0, 0.0, null][rev_id % 7 + 1] when confidence is not null then least(greatest(confidence, 0.0), 1.0) end as confidence from corpus_pages",
    "q_embed_text": "select rev_id, md5(left(concat_ws(chr(10), coalesce(title, ''), nullif(summary, ''), nullif(body, '')), 300)) as digest from corpus_pages",
    "q_embed_text_effective": """select rev_id, md5(left(concat_ws(chr(10), coalesce(title, ''), nullif(summary, ''), nullif(body, '')), case when m > 0 then m else 4000 end)) as digest
from corpus_pages left join (select wiki, max(max_text_chars) as m from embed_config group by wiki) using (wiki)""",
    "q_secrets": "select rev_id, p.name as pattern_name, n as line_number from (select rev_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as n from corpus_pages where body is not null) l join (values "
    + ", ".join(f"('{a}', '{b}')" for a, b in _SECRET) + ") as p(name, re) on regexp_matches(l.line, p.re)",
    "q_html_escape": """select rev_id, md5(replace(replace(replace(replace(replace(coalesce(body, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(39), '&#39;'), '"', '&#34;')) as digest from corpus_pages""",
}
