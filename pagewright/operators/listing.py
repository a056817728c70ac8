"""Listing, recency, backlinks, lookup, history and export of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.session import number_rows


def filtered(pages: DataFrame, type: str | None = None, status: str | None = None) -> DataFrame:
    if type:
        pages = pages.filter(F.col("type") == type)
    return pages.filter(F.col("status") == status) if status else pages


def page_list(pages: DataFrame, page: int = 1, size: int = 20, type: str | None = None, status: str | None = None) -> DataFrame:
    """One page of the listing in slug order, with the total; a page below 1 is the first, a size below 1 an error."""
    if size < 1:
        raise ValueError("page_size must be at least 1")
    rows = filtered(pages, type, status)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    out = rows.select("slug", "wiki", "uri", "title", "type", "status", "confidence", "tags", "summary").orderBy("slug", "wiki").offset((max(1, page) - 1) * size).limit(size)
    return out.crossJoin(F.broadcast(total))


def recent(pages: DataFrame, k: int = 20) -> DataFrame:
    """Pages by last_updated, newest first; those without come last."""
    updated = F.coalesce(F.try_element_at(F.col("text_vals"), F.lit("last_updated")), F.lit(""))
    rows = pages.select("wiki", "slug", "title", updated.alias("last_updated"))
    return rows.orderBy(F.desc("last_updated"), "slug", "wiki").limit(k)


def with_field(pages: DataFrame, name: str, value: str) -> DataFrame:
    """(wiki, slug) of pages whose keyword field holds a value."""
    return pages.filter(F.array_contains(F.try_element_at(F.col("fields"), F.lit(name)), value)).select("wiki", "slug")


def backlinks(pages: DataFrame, slug: str) -> DataFrame:
    return pages.filter(F.array_contains("body_links", slug)).select("wiki", "slug", "title").orderBy("slug", "wiki")


def all_backlinks(pages: DataFrame) -> DataFrame:
    """(target, n_pages): pages that link to a target; repeats within a page count once."""
    return pages.select(F.explode(F.array_distinct("body_links")).alias("target")).filter("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"))


def history(commits: DataFrame, path: str, k: int = 10) -> DataFrame:
    """Newest commits of a path; a commit delivered twice counts once."""
    rows = commits.filter(F.col("path") == path).groupBy("wiki", "hash", "date").agg(F.min("message").alias("message"), F.min("author").alias("author"))
    return rows.orderBy(F.desc("date"), "hash", "wiki").limit(k)


def activity(commits: DataFrame, k: int = 15) -> DataFrame:
    """Newest commits of all paths."""
    rows = commits.groupBy("wiki", "hash", "date").agg(F.min("message").alias("message"), F.min("author").alias("author"))
    return rows.orderBy(F.desc("date"), "hash", "wiki").limit(k)


def export_order(pages: DataFrame, include_archived: bool = False) -> DataFrame:
    """Pages of each wiki with their place in the export: types with most pages first, then type, confidence downwards, title, slug."""
    rows = pages if include_archived else pages.filter(F.coalesce("status", F.lit("")) != "archived")
    rows = rows.withColumns({"type": F.coalesce("type", F.lit("")), "title": F.coalesce("title", F.lit("")), "_c": F.coalesce("confidence", F.lit(1.0))})
    # placed without the texts, which join again by page: no wiki has to fit into one task
    narrow = rows.select("wiki", "slug", "type", "title", "_c")
    counts = narrow.groupBy("wiki", "type").agg(F.count(F.lit(1)).alias("n_type"))
    placed = number_rows(narrow.join(counts, ["wiki", "type"]), "wiki", [F.desc("n_type"), F.asc("type"), F.desc("_c"), F.asc("title"), F.asc("slug")])
    return rows.drop("_c").join(placed.select("wiki", "slug", "n_type", "place"), ["wiki", "slug"])


def export_lines(pages: DataFrame, include_archived: bool = False) -> DataFrame:
    """(wiki, place, line) of the short export: one linked line a page."""
    tail = F.when(F.coalesce("summary", F.lit("")) == "", "").otherwise(F.concat(F.lit(": "), "summary"))
    return export_order(pages, include_archived).select("wiki", "place", "type", "n_type", F.concat(F.lit("- ["), "title", F.lit("]("), "uri", F.lit(")"), tail).alias("line"))


def export_text(pages: DataFrame, wiki: str, include_archived: bool = False) -> DataFrame:
    """(place, text): lines of the short export of one wiki, headers included, to be written as text in order."""
    lines = export_lines(pages.filter(F.col("wiki") == wiki), include_archived)
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("type").orderBy("place")) == 1
    head = F.when(first, F.concat(F.lit("## "), "type", F.lit(" ("), "n_type", F.lit(")\n\n"))).otherwise("")
    last = F.row_number().over(W.partitionBy("type").orderBy(F.desc("place"))) == 1
    body = lines.select(F.col("place").cast("long").alias("place"), F.concat(head, "line", F.when(last, "\n").otherwise("")).alias("text"))
    intro = total.select(F.lit(0).cast("long").alias("place"), F.concat(F.lit(f"# {wiki}\n\n"), F.col("n").cast("string"), F.lit(" pages\n")).alias("text"))
    return intro.unionByName(body).orderBy("place")


def export_full(pages: DataFrame, include_archived: bool = False) -> DataFrame:
    """(wiki, place, text) of the full export: the name and number of pages at place 0, then rule, linked title, summary in italics and body of each page."""
    summary = F.when(F.coalesce("summary", F.lit("")) == "", "").otherwise(F.concat(F.lit("_"), "summary", F.lit("_\n\n")))
    text = F.concat(F.lit("---\n\n# ["), "title", F.lit("]("), "uri", F.lit(")\n\n"), summary, F.trim(F.coalesce("body", F.lit(""))), F.lit("\n\n"))
    ordered = export_order(pages, include_archived)
    head = F.concat(F.lit("# "), "wiki", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" pages\n\n")).alias("text")
    live = pages if include_archived else pages.filter(F.coalesce("status", F.lit("")) != "archived")
    heads = live.groupBy("wiki").agg(F.count(F.lit(1)).alias("n")).select("wiki", F.lit(0).alias("place"), head)
    return ordered.select("wiki", "place", text.alias("text")).unionByName(heads)


def export_json(pages: DataFrame, include_archived: bool = False) -> DataFrame:
    """(wiki, place, json): one object a page; an absent confidence is left out. frontmatter holds the remaining fields, of the column rest or else of fields, text_vals and numeric_vals; it is left out where there are none."""
    blank = lambda n: F.coalesce(n, F.lit("")).alias(n)
    ordered = export_order(pages, include_archived)
    if "rest" in ordered.columns:
        rest = F.when(~F.coalesce("rest", F.lit("{}")).isin("{}", ""), F.parse_json("rest"))
    else:
        maps = [F.coalesce(F.transform_values(n, lambda k, v: v.cast("variant")), F.create_map().cast("map<string,string>").cast("map<string,variant>")) for n in ("fields", "text_vals", "numeric_vals")]
        rest = F.map_from_entries(F.array_sort(F.flatten(F.array(*[F.map_entries(m) for m in maps])), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
        rest = F.when(F.size(rest) > 0, rest)
    row = F.struct("slug", "uri", "title", "type", blank("status"), "confidence", blank("summary"), rest.alias("frontmatter"), "body")
    return ordered.select("wiki", "place", F.to_json(row, {"ignoreNullFields": "true"}).alias("json"))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def feed(pages: DataFrame, base: str = "", k: int = 20) -> DataFrame:
    """(last_updated, slug, item): RSS items of the recent pages, with link and date; base is the address that pages lie below."""
    rows = recent(pages, k)
    day = F.when(F.col("last_updated").rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date("last_updated", "yyyy-MM-dd"))
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format(day, "EEE, dd MMM yyyy 00:00:00"), F.lit(" +0000</pubDate>")), F.lit(""))
    link = _escaped(F.concat(F.lit(base.rstrip("/") + "/"), "wiki", F.lit("/"), "slug"))
    item = F.concat(F.lit("<item><title>"), _escaped(F.col("title")), F.lit("</title><link>"), link, F.lit("</link><guid>"), _escaped(F.concat(F.lit("wiki://"), "wiki", F.lit("/"), "slug")), F.lit("</guid>"), date, F.lit("</item>"))
    return rows.select("last_updated", "slug", item.alias("item"))


def feed_xml(pages: DataFrame, title: str, base: str = "", k: int = 20) -> str:
    """The whole feed; k bounds its items."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    items = "".join(r.item for r in feed(pages, base, k).collect())
    return f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{escape(title)}</title><link>{escape(base)}</link>{items}</channel></rss>'


def render_hits(hits: DataFrame) -> str:
    """Linked lines of search results, few by construction."""
    rows = hits.collect()
    return "".join(f"- [{r.title}]({r.uri}){': ' + r.summary if r.summary else ''}\n" for r in rows) or "No results found.\n"


def render_list(rows: list, page: int, size: int, total: int) -> str:
    """Listing page as Markdown: groups by size, then name; archived pages struck through; a footer if there are more."""
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r["type"] or "", []).append(r)
    out = []
    for name, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
        out.append(f"## {name} ({len(members)})\n\n")
        for r in sorted(members, key=lambda r: (-(1.0 if r["confidence"] is None else r["confidence"]), r["title"] or "")):
            line = f"[{r['title']}]({r['uri']}){': ' + r['summary'] if r['summary'] else ''}"
            out.append(f"- ~~{line}~~\n" if r["status"] == "archived" else f"- {line}\n")
        out.append("\n")
    if total > size:
        out.append(f"_Page {page}/{-(-total // size)} — {total} total pages_\n")
    return "".join(out)
