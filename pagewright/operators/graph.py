"""The labelled link graph of pages: build, merge, traverse, measure, render.

Nodes are (wiki, slug, title, type, external), edges (wiki, src, dst, relation),
a multiset. Edges come from the declared fields of a page's type and from its
body links (links-to); an edge to itself, or to a page that the wiki lacks, is
none; a wiki:// target makes an external node.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.functions.text import round2
from pagewright.session import cut_lineage, salted_join


def build(pages: DataFrame, decls: DataFrame, types: list[str] | None = None, relation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every wiki; types keeps pages of some types, relation edges of one."""
    if types:
        pages = pages.filter(F.col("type").isin(types))
    local = pages.select("wiki", "slug", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("type", F.lit("")).alias("type"), F.lit(False).alias("external"))
    raw = raw_edges(pages, decls)
    if relation:
        raw = raw.filter(F.col("relation") == relation)
    outside = raw.filter(F.col("dst").startswith("wiki://"))
    inside = salted_join(raw.filter(~F.col("dst").startswith("wiki://") & (F.col("src") != F.col("dst"))), local.select("wiki", F.col("slug").alias("dst")), ["wiki", "dst"], "src")
    edges = inside.select("wiki", "src", "dst", "relation").unionByName(outside)
    external = outside.select("wiki", F.col("dst").alias("slug"), F.col("dst").alias("title"), F.lit("").alias("type"), F.lit(True).alias("external")).distinct()
    return local.unionByName(external), edges


def raw_edges(pages: DataFrame, decls: DataFrame) -> DataFrame:
    """(wiki, src, dst, relation) as declared, before targets are looked up."""
    fielded = pages.select("wiki", "slug", "type", F.explode("fields").alias("field", "targets"))
    # declarations are a dimension: Spark broadcasts them only below its threshold
    declared = fielded.join(decls.select("type", "field", "relation").distinct(), ["type", "field"]).select("wiki", F.col("slug").alias("src"), F.explode("targets").alias("dst"), "relation")
    linked = pages.select("wiki", F.col("slug").alias("src"), F.explode("body_links").alias("dst"), F.lit("links-to").alias("relation"))
    return declared.unionByName(linked).filter("dst is not null")


def merge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph over all wikis: keys are wiki/slug, external nodes that a wiki has become that page."""
    local = nodes.filter("not external").select(F.concat_ws("/", "wiki", "slug").alias("key"), "title", "type", F.lit(False).alias("external"))
    target = F.when(F.col("dst").startswith("wiki://"), F.regexp_replace("dst", r"^wiki://", "")).otherwise(F.concat_ws("/", "wiki", "dst"))
    keyed = edges.select(F.concat_ws("/", "wiki", "src").alias("src"), target.alias("key"), "relation", F.col("dst").startswith("wiki://").alias("crossing"))
    joined = salted_join(keyed, local.select("key", F.lit(True).alias("known")), ["key"], "src", how="left")
    dst = F.when(F.col("known") | ~F.col("crossing"), F.col("key")).otherwise(F.concat(F.lit("wiki://"), "key"))
    merged = joined.select("src", dst.alias("dst"), "relation")
    outside = merged.filter(F.col("dst").startswith("wiki://")).select(F.col("dst").alias("key"), F.col("dst").alias("title"), F.lit("").alias("type"), F.lit(True).alias("external")).distinct()
    return local.unionByName(outside), merged


def degrees(edges: DataFrame) -> DataFrame:
    """(wiki, slug, degree): ends of edges, parallel edges counted."""
    ends = edges.select("wiki", F.explode(F.array("src", "dst")).alias("slug"))
    return ends.groupBy("wiki", "slug").agg(F.count(F.lit(1)).alias("degree"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(wiki, nodes, edges, orphans, avg_connections, density) of each wiki; external nodes count."""
    n = nodes.groupBy("wiki").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("wiki").agg(F.count(F.lit(1)).alias("edges"))
    lone = nodes.join(degrees(edges), ["wiki", "slug"], "left_anti").groupBy("wiki").agg(F.count(F.lit(1)).alias("orphans"))
    out = n.join(e, "wiki", "left").join(lone, "wiki", "left").na.fill(0, ["edges", "orphans"])
    v, m = F.col("nodes"), F.col("edges")
    return out.select("wiki", "nodes", "edges", "orphans", round2(2 * m / v).alias("avg_connections"), F.when(v > 1, round2(m / (v * (v - 1)))).otherwise(0.0).alias("density"))


def top_hubs(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Nodes with most edge ends, ties by title."""
    return degrees(edges).join(nodes, ["wiki", "slug"]).orderBy(F.desc("degree"), "title", "slug", "wiki").limit(k).select("wiki", "slug", "title", "degree")


def relations(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relation")


def neighbours(edges: DataFrame, wiki: str, slug: str) -> DataFrame:
    """(direction, slug) of a node's neighbours, with multiplicity."""
    here = edges.filter(F.col("wiki") == wiki)
    out = here.filter(F.col("src") == slug).select(F.lit("out").alias("direction"), F.col("dst").alias("slug"))
    return out.unionByName(here.filter(F.col("dst") == slug).select(F.lit("in").alias("direction"), F.col("src").alias("slug")))


def subgraph(nodes: DataFrame, edges: DataFrame, root: tuple[str, str], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth steps of a root in either direction, with their distance, and the edges among them. A root that is missing gives nothing."""
    wiki, slug = root
    here = edges.filter(F.col("wiki") == wiki)
    both = here.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(here.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    seen = cut_lineage(nodes.filter((F.col("wiki") == wiki) & (F.col("slug") == slug)).select("slug", F.lit(0).alias("dist")))
    frontier = seen
    for step in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("slug").alias("a")), "a").select(F.col("b").alias("slug")).distinct().join(seen, "slug", "left_anti")
        frontier = cut_lineage(reached.withColumn("dist", F.lit(step)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    kept = nodes.filter(F.col("wiki") == wiki).join(seen, "slug").select("wiki", "slug", "title", "type", "external", "dist")
    inner = here.join(seen.select(F.col("slug").alias("src")), "src", "left_semi").join(seen.select(F.col("slug").alias("dst")), "dst", "left_semi")
    return kept, inner.select("wiki", "src", "dst", "relation")


# Fill colours of page types in diagrams.
COLOURS = {"concept": "#cce5ff", "query-result": "#cce5ff", "paper": "#d4edda", "article": "#d4edda", "documentation": "#d4edda", "skill": "#ffeeba", "doc": "#e2e3e5", "section": "#f8f9fa"}


def bounded(df: DataFrame, most: int) -> list:
    """Rows for a drawing; more than most of them is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to draw")
    return rows


def _diagram_id(title: str) -> str:
    return title.replace("://", "__").translate(str.maketrans("/-:", "___"))


def render_mermaid(nodes: DataFrame, edges: DataFrame, most: int = 20_000) -> str:
    """Mermaid text of the graph of one wiki."""
    ns = sorted(bounded(nodes, most), key=lambda n: n.slug)
    title = {n.slug: n.title for n in ns}
    lines = ["graph LR"]
    lines += [f'  {_diagram_id(n.title)}["{n.title}"]:::{"external" if n.external else n.type}' for n in ns]
    lines.append("")
    lines += [f"  {_diagram_id(title[e.src])} -->|{e.relation}| {_diagram_id(title[e.dst])}" for e in sorted(bounded(edges, most))]
    lines.append("")
    if any(n.external for n in ns):
        lines.append("  classDef external fill:#eee,stroke:#999,stroke-dasharray:5 5")
    used = {n.type for n in ns if not n.external}
    lines += [f"  classDef {t} fill:{c}" for t, c in COLOURS.items() if t in used]
    return "\n".join(lines) + "\n"


def render_dot(nodes: DataFrame, edges: DataFrame, most: int = 20_000) -> str:
    """Graphviz text of the graph of one wiki."""
    ns = sorted(bounded(nodes, most), key=lambda n: n.slug)
    lines = [f'  "{n.slug}" [label="{n.title}" type="{"external" if n.external else n.type}"{" style=" + chr(34) + "dashed" + chr(34) if n.external else ""}];' for n in ns]
    lines += [f'  "{e.src}" -> "{e.dst}" [label="{e.relation}"];' for e in sorted(bounded(edges, most))]
    return "\n".join(["digraph wiki {", *lines, "}"]) + "\n"


def render_summary(nodes: DataFrame, edges: DataFrame, most: int = 20_000) -> str:
    """Description of the graph of one wiki in a few lines; titles are cut to eight of a type by rank before they come to the driver."""
    n, m = nodes.count(), edges.count()
    local = nodes.filter("not external")
    first = local.withColumn("_r", F.row_number().over(W.partitionBy("type").orderBy("title", "slug"))).filter("_r <= 8")
    some = first.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("some"))
    groups = local.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(some, "type").orderBy(F.desc("n"), "type").collect()
    hubs = [f"{h.title} ({h.degree} edges)" for h in top_hubs(nodes, edges).collect()]
    out = [f"The wiki graph has {n} nodes and {m} edges across {len(groups)} type groups.", ""]
    out += [f"**{g.type}** ({g.n} nodes): {', '.join(g.some)}{', ...' if g.n > 8 else ''}" for g in groups]
    if hubs:
        out += ["", f"Key hubs: {', '.join(hubs)}"]
    rel = relations(edges).collect()
    if rel:
        out += ["", "**Edges by relation:**"] + [f"- `{r.relation}` ({r.n})" for r in rel]
    lone = nodes.join(degrees(edges), ["wiki", "slug"], "left_anti").select("slug", "title")
    outside = nodes.filter("external").select("slug", "title")
    for name, rows, key in (("Isolated nodes", lone, 0), ("External references", outside, 1)):
        titles = [r.title for r in sorted(bounded(rows, most), key=lambda r: r[key])]
        if titles:
            out += ["", f"**{name} ({len(titles)}):** {', '.join(titles)}"]
    return "\n".join(out) + "\n"


FORMATS = {"mermaid": render_mermaid, "dot": render_dot, "llms": render_summary}


def entry(nodes: DataFrame, edges: DataFrame, kind: str = "mermaid", output: str | None = None, generated: str = "", root: tuple[str, str] | None = None, depth: int = 3, types: list[str] | None = None) -> str:
    """The drawing of a graph, of the pages about a root if one is given, also written to a file; a .md file gets front matter and a fence."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    if root:
        nodes, edges = subgraph(nodes, edges, root, depth)
    text = FORMATS[kind](nodes, edges)
    if output:
        file = Path(output)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(wrap_markdown(text, kind, generated, root[1] if root else "", depth, types) if file.suffix == ".md" else text, "utf-8")
    return text


def wrap_markdown(rendered: str, kind: str, generated: str, root: str = "", depth: int = 0, types: list[str] | None = None) -> str:
    """A rendered graph as a Markdown page with front matter."""
    head = {"title": '"Wiki Graph"', "generated": f'"{generated}"', "format": kind, "root": root, "depth": depth, "types": f"[{', '.join(types or [])}]", "status": "generated"}
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + f"---\n\n```{kind}\n{rendered}```\n"
