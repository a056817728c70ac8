"""Lint rules, edge target checks, staleness, statistics and schema validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import LINK_FIELDS, Lint
from pagewright.config import Graph as GraphConfig
from pagewright.functions.text import round2
from pagewright.operators import graph as G
from pagewright.operators import structure as T
from pagewright.session import cut_lineage, salted_join

FINDING = ["wiki", "slug", "rule", "severity", "message"]


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.array().cast("array<string>"))


def links(pages: DataFrame) -> DataFrame:
    """(wiki, slug, field, target) of body links, reference fields and the first superseded_by."""
    empty = F.array().cast("array<string>")
    lists = {"body_links": F.coalesce("body_links", empty)} | {f: _field(f) for f in LINK_FIELDS} | {"superseded_by": F.slice(_field("superseded_by"), 1, 1)}
    tag = lambda name: lambda x: F.struct(F.lit(name).alias("field"), x.alias("target"))
    rows = pages.select("wiki", "slug", F.explode(F.concat(*[F.transform(v, tag(k)) for k, v in lists.items()])).alias("x"))
    return rows.select("wiki", "slug", "x.field", "x.target").filter("target is not null and target != ''")


def _found(rows: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return rows.select("wiki", "slug", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def orphans(pages: DataFrame) -> DataFrame:
    """Pages, not sections or indexes, that nothing in their wiki links to."""
    targets = links(pages).select("wiki", F.col("target").alias("slug")).distinct()
    rows = pages.filter((F.coalesce("type", F.lit("")) != "section") & (F.col("slug") != "index") & ~F.col("slug").endswith("/index"))
    return _found(rows.join(targets, ["wiki", "slug"], "left_anti"), "orphan", "warning", F.lit("no incoming links"))


def broken_links(pages: DataFrame) -> DataFrame:
    rows = links(pages).filter(~F.col("target").startswith("wiki://"))
    known = pages.select("wiki", F.col("slug").alias("target"), F.lit(True).alias("known"))
    lost = salted_join(rows, known, ["wiki", "target"], "slug", how="left").filter("known is null")
    return _found(lost, "broken-link", "error", F.concat(F.lit("broken link in "), "field", F.lit(": "), "target"))


def broken_cross_links(pages: DataFrame) -> DataFrame:
    """Links to wikis that do not exist."""
    rows = links(pages).filter(F.col("target").rlike("^wiki://[^/]*/")).withColumn("_w", F.regexp_extract("target", r"^wiki://([^/]*)/", 1))
    mounted = pages.select(F.col("wiki").alias("_w")).distinct()
    return _found(rows.join(mounted, "_w", "left_anti"), "broken-cross-wiki-link", "warning", F.concat(F.lit("cross-wiki link to unmounted wiki: "), "target"))


def _present(name: Column) -> Column:
    """Whether a page has a required field; a field of no known kind counts as present."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    held = F.size(F.coalesce(F.try_element_at("fields", name), F.array().cast("array<string>"))) > 0
    texts = F.coalesce(F.try_element_at("text_vals", name), F.lit("")) != ""
    numbers = F.coalesce(F.map_contains_key("numeric_vals", name), F.lit(False))
    return F.when(name == "title", blank("title")).when(name == "type", blank("type")).when(name == "summary", blank("summary")).when(name == "status", blank("status")).otherwise(held | texts | numbers)


def missing_fields(pages: DataFrame, types: DataFrame) -> DataFrame:
    required = types.select("type", F.explode("required").alias("need"))
    rows = pages.join(required, "type").filter(~F.coalesce(_present(F.col("need")), F.lit(False)))
    return _found(rows, "missing-fields", "error", F.concat(F.lit("required field missing: "), "need"))


def unknown_types(pages: DataFrame, types: DataFrame) -> DataFrame:
    rows = pages.filter(F.coalesce("type", F.lit("")) != "").join(types.select("type").distinct(), "type", "left_anti")
    return _found(rows, "unknown-type", "error", F.concat(F.lit("unknown type: "), "type"))


def stale(pages: DataFrame, as_of: str, c: Lint = Lint()) -> DataFrame:
    """Active pages of low confidence whose last_updated is missing, no date, or older than the limit."""
    updated = F.try_element_at(F.col("text_vals"), F.lit("last_updated"))
    day = F.when(updated.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(updated, "yyyy-MM-dd"))
    old = F.datediff(F.lit(as_of).cast("date"), day) > c.stale_days
    rows = pages.filter(F.coalesce("status", F.lit("")).isin("active", "") & (F.col("confidence") < c.stale_confidence_threshold) & F.coalesce(old, F.lit(True)))
    note = F.when(day.isNotNull(), F.concat(F.lit("last updated "), updated)).otherwise("no last_updated date")
    return _found(rows, "stale", "warning", F.concat(F.lit("stale page: "), note))


def structural(cuts: DataFrame) -> DataFrame:
    """Findings of cut_structure()."""
    text = F.when(F.col("kind") == "bridge", F.concat(F.lit("link "), "a", F.lit(" → "), "b", F.lit(" is a bridge — its removal disconnects the graph"))).otherwise("removing this page would disconnect the graph — add alternative link paths")
    return cuts.select("wiki", F.col("a").alias("slug"), F.col("kind").alias("rule"), F.lit("warning").alias("severity"), text.alias("message"))


def periphery(ecc: DataFrame) -> DataFrame:
    far = ecc.groupBy("wiki").agg(F.max("eccentricity").alias("eccentricity"))
    return _found(ecc.join(far, ["wiki", "eccentricity"]), "periphery", "warning", F.lit("most structurally isolated page — furthest from all others in the graph"))


def lint(pages: DataFrame, types: DataFrame, as_of: str, rules: list[str] | None = None, severity: str | None = None, c: Lint = Lint(), structure: DataFrame | None = None) -> DataFrame:
    """Findings of the chosen rules, in order of slug and rule; structure adds findings of the graph rules."""
    made = {
        "orphan": lambda: orphans(pages), "broken-link": lambda: broken_links(pages), "broken-cross-wiki-link": lambda: broken_cross_links(pages),
        "missing-fields": lambda: missing_fields(pages, types), "stale": lambda: stale(pages, as_of, c), "unknown-type": lambda: unknown_types(pages, types),
    }
    chosen = [f() for name, f in made.items() if not rules or name in rules] + ([structure] if structure is not None else [])
    out = chosen[0]
    for f in chosen[1:]:
        out = out.unionByName(f)
    if severity:
        out = out.filter(F.col("severity") == severity)
    return out.orderBy("slug", "rule", "message", "wiki")


def edge_target_warnings(pages: DataFrame, decls: DataFrame) -> DataFrame:
    """(wiki, slug, field, target, target_type): declared references to local pages of a type that is not allowed."""
    allowed = decls.filter(F.size("target_types") > 0)
    rows = pages.select("wiki", "slug", "type", F.explode("fields").alias("field", "targets")).join(allowed, ["type", "field"])
    rows = rows.select("wiki", "slug", "field", F.explode("targets").alias("target"), "target_types")
    known = pages.select("wiki", F.col("slug").alias("target"), F.coalesce("type", F.lit("")).alias("target_type"))
    joined = salted_join(rows, known, ["wiki", "target"], "slug")
    return joined.filter(~F.array_contains("target_types", F.col("target_type"))).select("wiki", "slug", "field", "target", "target_type")


def age_class(updated: Column, as_of: str) -> Column:
    """fresh below 7 days, stale_7d below 30, else stale_30d; a future day is fresh, a missing one stale_30d."""
    day = F.when(updated.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(updated, "yyyy-MM-dd"))
    days = F.datediff(F.lit(as_of).cast("date"), day)
    return F.when(days < 7, "fresh").when(days < 30, "stale_7d").otherwise("stale_30d")


def staleness(pages: DataFrame, as_of: str) -> DataFrame:
    """(wiki, fresh, stale_7d, stale_30d)."""
    age = age_class(F.try_element_at(F.col("text_vals"), F.lit("last_updated")), as_of)
    return pages.withColumn("_age", age).groupBy("wiki").agg(*[F.count_if(F.col("_age") == k).alias(k) for k in ("fresh", "stale_7d", "stale_30d")])


def _counts(pages: DataFrame, name: str, out: str) -> DataFrame:
    """(wiki, map of value to count) of a column, empty values left out."""
    per = pages.filter(F.coalesce(name, F.lit("")) != "").groupBy("wiki", name).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("wiki").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "n")))).alias(out))


def stats(pages: DataFrame, decls: DataFrame, as_of: str) -> DataFrame:
    """One row a wiki: pages, sections, graph measures and staleness."""
    nodes, edges = G.build(pages, decls)
    return _basics(pages).join(G.metrics(nodes, edges), "wiki").join(staleness(pages, as_of), "wiki")


def _basics(pages: DataFrame) -> DataFrame:
    return pages.groupBy("wiki").agg(F.count_if(F.coalesce("type", F.lit("")) != "section").alias("pages"), F.count_if(F.col("type") == "section").alias("sections"), round2(F.avg("confidence")).alias("avg_confidence"))


def dashboard(pages: DataFrame, decls: DataFrame, as_of: str, c: GraphConfig = GraphConfig(), index: dict | None = None) -> DataFrame:
    """stats() with counts by type and status, communities, distances with the centre or a note why there are none, and the health of the index (a Store's status)."""
    # the newest deliveries are found once, and not by each part again
    pages = cut_lineage(pages.select("wiki", "slug", "title", "type", "status", "confidence", "fields", "body_links", "text_vals"))
    nodes, edges = G.build(pages, decls)
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    out = _basics(pages).join(G.metrics(nodes, edges), "wiki").join(staleness(pages, as_of), "wiki")
    out = out.join(_counts(pages, "type", "types"), "wiki", "left").join(_counts(pages, "status", "statuses"), "wiki", "left")
    out = out.join(T.community_stats(T.communities(nodes, edges, c.min_nodes_for_communities)), "wiki", "left")
    far = T.distance_summary(T.eccentricities(nodes, edges, c.max_nodes_for_diameter)).drop("periphery")
    local = nodes.filter("not external").groupBy("wiki").agg(F.count(F.lit(1)).alias("_local"))
    note = F.concat(F.lit("graph too large for diameter computation ("), F.col("_local").cast("string"), F.lit(f" nodes > max_nodes_for_diameter={c.max_nodes_for_diameter})"))
    out = out.join(far, "wiki", "left").join(local, "wiki", "left").withColumn("structural_note", F.when(F.col("_local") > c.max_nodes_for_diameter, note)).drop("_local")
    return out.withColumns({"index_stale": F.lit(bool(index["stale"]) if index else None).cast("boolean"), "index_built": F.lit(index["built"] if index else None).cast("string")})


def lint_totals(findings: DataFrame) -> DataFrame:
    """(rule, severity, n): findings by rule."""
    return findings.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def validate(pages: DataFrame, types: DataFrame, strict: bool = False) -> DataFrame:
    """(wiki, slug, severity, message): a title or name is a must; a missing or unknown type is a warning, or an error if strict."""
    known = types.select(F.col("type").alias("_known")).distinct()
    # types are a dimension; the broadcast is left to Spark's size threshold
    rows = pages.join(known, pages["type"] == known["_known"], "left")
    named = (F.coalesce("title", F.lit("")) != "") | (F.coalesce(F.try_element_at("text_vals", F.lit("name")), F.lit("")) != "")
    kind = F.coalesce(F.col("type"), F.lit(""))
    no_type = F.when(kind == "", F.struct(F.lit("warning").alias("severity"), F.lit("missing type, default assumed").alias("message")))
    bad_type = F.when((kind != "") & F.col("_known").isNull(), F.struct(F.lit("error" if strict else "warning").alias("severity"), F.concat(F.lit("unknown type: "), kind).alias("message")))
    no_title = F.when(~named, F.struct(F.lit("error").alias("severity"), F.lit("title or name is required").alias("message")))
    return rows.select("wiki", "slug", F.explode(F.array_compact(F.array(no_title, no_type, bad_type))).alias("x")).select("wiki", "slug", "x.severity", "x.message")
