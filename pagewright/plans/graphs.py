"""Queries of the graph, its structure, lint, statistics and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.operators import graph as G
from pagewright.operators import quality as Q
from pagewright.operators import structure as T
from pagewright.operators import suggest as U
from pagewright.plans.common import AS_OF, EDGES, PAGES, TOKENS, pages
from pagewright.session import cut_lineage, table


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.build(pages(spark, sf_dir), table(spark, sf_dir, "edge_decls"))


def q_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].groupBy("wiki", "src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))


def q_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def q_relation_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relations(_graph(spark, sf_dir)[1])


def q_graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.metrics(*_graph(spark, sf_dir))


def q_top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_hubs(*_graph(spark, sf_dir))


def q_graph_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the graph over all wikis, by relation and whether they leave it."""
    _, edges = G.merge(*_graph(spark, sf_dir))
    return edges.groupBy("relation", F.col("dst").startswith("wiki://").alias("outside")).agg(F.count(F.lit(1)).alias("n"))


def q_subgraph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps about the most connected page."""
    nodes, edges = _graph(spark, sf_dir)
    hub = G.top_hubs(nodes.filter("not external"), edges, 1).first()
    return G.subgraph(nodes, edges, (hub.wiki, hub.slug), 3)[0].select("wiki", "slug", "dist")


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return T.components(nodes, T.undirected(nodes, edges))


def q_cut_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articulation points and bridges."""
    return T.cut_structure(*_graph(spark, sf_dir))


def q_eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.eccentricities(*_graph(spark, sf_dir))


def q_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.distance_summary(T.eccentricities(*_graph(spark, sf_dir)))


def q_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.communities(*_graph(spark, sf_dir))


def q_community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.community_stats(T.communities(*_graph(spark, sf_dir)))


def q_lint_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.orphans(pages(spark, sf_dir)).select("wiki", "slug")


def q_lint_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.broken_links(pages(spark, sf_dir)).select("wiki", "slug", "message")


def q_lint_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.broken_cross_links(pages(spark, sf_dir)).select("wiki", "slug", "message")


def q_lint_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.missing_fields(pages(spark, sf_dir), table(spark, sf_dir, "page_types")).select("wiki", "slug", "message")


def q_lint_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stale(pages(spark, sf_dir), AS_OF).select("wiki", "slug", "message")


def q_lint_unknown_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.unknown_types(pages(spark, sf_dir), table(spark, sf_dir, "page_types")).select("wiki", "slug", "message")


def q_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules, the structural ones included."""
    p = pages(spark, sf_dir)
    nodes, edges = _graph(spark, sf_dir)
    structure = Q.structural(T.cut_structure(nodes, edges)).unionByName(Q.periphery(T.eccentricities(nodes, edges)))
    return Q.lint(p, table(spark, sf_dir, "page_types"), AS_OF, structure=structure)


def q_edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.edge_target_warnings(pages(spark, sf_dir), table(spark, sf_dir, "edge_decls"))


def q_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.staleness(pages(spark, sf_dir), AS_OF)


def q_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stats(pages(spark, sf_dir), table(spark, sf_dir, "edge_decls"), AS_OF)


def q_schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.validate(pages(spark, sf_dir), table(spark, sf_dir, "page_types"))


def q_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is known of each wiki, communities and distances included."""
    return Q.dashboard(pages(spark, sf_dir), table(spark, sf_dir, "edge_decls"), AS_OF)


def q_lint_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.lint_totals(q_lint(spark, sf_dir))


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the most connected page, with multiplicity."""
    nodes, edges = _graph(spark, sf_dir)
    hub = G.top_hubs(nodes.filter("not external"), edges, 1).first()
    return G.neighbours(edges, hub.wiki, hub.slug)


def q_suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that share tags, of every page: the exact variant."""
    p = pages(spark, sf_dir)
    return U.by_tags(p, p).drop("reason")


def q_suggest_tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a search for a page's tags finds and that share one, of every page."""
    p = pages(spark, sf_dir)
    return U.by_tag_search(p, p)


def q_suggest_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes two steps away, of every page."""
    return U.by_two_hops(_graph(spark, sf_dir)[1], pages(spark, sf_dir)).drop("score")


def q_suggest_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with content like the title and summary, of every page."""
    p = pages(spark, sf_dir)
    return U.by_texts(p, p).drop("reason")


def q_suggest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best suggestions of every page by tag search, hops, text and community, with the field to record them in."""
    # only the terms need the texts, and are made once; the strategies read the pages and the graph many times
    held = cut_lineage(U.terms_of(pages(spark, sf_dir)))
    p = cut_lineage(pages(spark, sf_dir).drop("body", "embedding"))
    texts = cut_lineage(U.by_texts(p, p, held=held))
    searched = cut_lineage(U.by_tag_search(p, p, held=held))
    decls = table(spark, sf_dir, "edge_decls")
    nodes, edges = G.build(p, decls)
    edges = cut_lineage(edges)
    hops = cut_lineage(U.best_two_hops(edges, p, Config().suggest.default_limit))
    taken = U.linked(p)
    for part in (searched, hops, texts):
        taken = taken.unionByName(part.select("wiki", "slug", "other"))
    peers = cut_lineage(U.by_community(T.communities(nodes, edges), p, taken, tags_taken=False))
    return U.link_field(U.merge(p, [searched, hops, texts, peers]), p, decls)


QUERIES = {
    f.__name__: f
    for f in (
        q_graph_edges, q_graph_nodes, q_relation_hist, q_graph_metrics, q_top_hubs, q_graph_merged, q_subgraph_bfs, q_components, q_cut_structure, q_eccentricity, q_diameter, q_louvain, q_community_stats,
        q_lint_orphan, q_lint_broken, q_lint_cross, q_lint_missing_fields, q_lint_stale, q_lint_unknown_type, q_lint, q_edge_targets, q_staleness, q_stats, q_schema_validate, q_dashboard, q_lint_totals, q_neighbours, q_suggest_tags, q_suggest_tag_search, q_suggest_2hop, q_suggest_bm25, q_suggest_merged,
    )
}

_LINKS = PAGES + """, links as (
  select wiki, slug, field, target from (
    select wiki, slug, 'body_links' as field, unnest(body_links) as target from pages
    union all select wiki, slug, 'sources', unnest(fields['sources']) from pages
    union all select wiki, slug, 'concepts', unnest(fields['concepts']) from pages
    union all select wiki, slug, 'document_refs', unnest(fields['document_refs']) from pages
    union all select wiki, slug, 'superseded_by', fields['superseded_by'][1] from pages) where target is not null and target <> '')
"""
_DEGREES = ", ends as (select wiki, src as slug from edges union all select wiki, dst from edges), degrees as (select wiki, slug, count(*) as degree from ends group by all)"
_METRICS = _DEGREES + """, measured as (
  select n.wiki, n.nodes, coalesce(e.edges, 0) as edges, coalesce(o.orphans, 0) as orphans
  from (select wiki, count(*) as nodes from nodes group by wiki) n left join (select wiki, count(*) as edges from edges group by wiki) e using (wiki)
  left join (select n.wiki, count(*) as orphans from nodes n left join degrees d using (wiki, slug) where d.degree is null group by n.wiki) o using (wiki)),
metrics as (select *, trunc(2 * edges / nodes * 100 + 0.5) / 100 as avg_connections, case when nodes > 1 then trunc(edges / (nodes * (nodes - 1)) * 100 + 0.5) / 100 else 0.0 end as density from measured)"""
_PAIRS = ", pairs as (select distinct wiki, src as a, dst as b from edges where dst not like 'wiki://%' union select distinct wiki, dst, src from edges where dst not like 'wiki://%')"
# what is left of the component of each node, or without each edge, from its first node on; steps between all nodes
_CUTS = _PAIRS + """, reach(wiki, slug, other) as (select wiki, a, a from pairs union select r.wiki, r.slug, p.b from reach r join pairs p on p.wiki = r.wiki and p.a = r.other),
comp as (select wiki, slug, min(other) as root, count(*) as size from reach group by all),
starts as (select c.wiki, c.slug as v, min(r.other) as start, any_value(c.size) as size from comp c join reach r on r.wiki = c.wiki and r.slug = c.slug and r.other <> c.slug group by all),
without(wiki, v, y) as (select wiki, v, start from starts union select w.wiki, w.v, p.b from without w join pairs p on p.wiki = w.wiki and p.a = w.y where p.b <> w.v),
points as (select s.wiki, s.v from starts s join (select wiki, v, count(*) as n from without group by all) w on w.wiki = s.wiki and w.v = s.v where w.n < s.size - 1),
cut_edges as (select p.wiki, p.a, p.b, c.root from pairs p join comp c on c.wiki = p.wiki and c.slug = p.a where p.a < p.b),
unlinked(wiki, a, b, y) as (select wiki, a, b, root from cut_edges union select u.wiki, u.a, u.b, p.b from unlinked u join pairs p on p.wiki = u.wiki and p.a = u.y where not (p.a = u.a and p.b = u.b) and not (p.a = u.b and p.b = u.a)),
ends_of as (select e.wiki, e.a, e.b, bool_or(u.y = e.a) as has_a, bool_or(u.y = e.b) as has_b from cut_edges e join unlinked u on u.wiki = e.wiki and u.a = e.a and u.b = e.b group by all),
cut_structure as (select wiki, 'articulation-point' as kind, v as a, cast(null as varchar) as b from points union all select wiki, 'bridge', case when has_a then a else b end, case when has_a then b else a end from ends_of where not (has_a and has_b))"""
_ECC = """, steps(wiki, s, y, d) as (select wiki, slug, slug, 0 from pages union select t.wiki, t.s, p.b, t.d + 1 from steps t join pairs p on p.wiki = t.wiki and p.a = t.y where t.d < 24),
shortest as (select wiki, s, y, min(d) as d from steps group by all),
ecc as (select wiki, s as slug, max(d) as eccentricity from shortest where wiki in (select wiki from pages group by wiki having count(*) <= 2000) group by all)"""
_DAY = r"case when regexp_matches(coalesce(text_vals['last_updated'], ''), '^\d{4}-\d\d-\d\d$') then try_cast(text_vals['last_updated'] as date) end"
_AGE = f"""ages as (select wiki, case when d < 7 then 'fresh' when d < 30 then 'stale_7d' else 'stale_30d' end as age from (select wiki, date_diff('day', {_DAY}, date '{AS_OF}') as d from pages)),
aged as (select wiki, count(*) filter (age = 'fresh') as fresh, count(*) filter (age = 'stale_7d') as stale_7d, count(*) filter (age = 'stale_30d') as stale_30d from ages group by wiki)"""
ORACLE_SQL = {
    "q_graph_edges": EDGES + "select wiki, src, dst, relation, count(*) as n from edges group by all",
    "q_graph_nodes": EDGES + "select * from nodes",
    "q_relation_hist": EDGES + "select relation, count(*) as n from edges group by relation",
    "q_graph_metrics": EDGES + _METRICS + " select * from metrics",
    "q_top_hubs": EDGES + _DEGREES + " select wiki, slug, title, degree from degrees join nodes using (wiki, slug) order by degree desc, title, slug, wiki limit 5",
    "q_graph_merged": EDGES + ", keyed as (select relation, dst like 'wiki://%' as crossing, case when dst like 'wiki://%' then replace(dst, 'wiki://', '') else wiki || '/' || dst end as key from edges) select relation, crossing and p.slug is null as outside, count(*) as n from keyed k left join pages p on p.wiki || '/' || p.slug = k.key group by all",
    "q_subgraph_bfs": EDGES + _DEGREES + """, root as (select wiki, slug from degrees join nodes using (wiki, slug) where not external order by degree desc, title, slug, wiki limit 1),
both_ways as (select wiki, src as a, dst as b from edges union select wiki, dst, src from edges),
walk(wiki, slug, dist) as (select wiki, slug, 0 from root union select w.wiki, p.b, w.dist + 1 from walk w join both_ways p on p.wiki = w.wiki and p.a = w.slug where w.dist < 3)
select wiki, slug, min(dist) as dist from walk group by wiki, slug""",
    "q_components": EDGES + _PAIRS + """, reach(wiki, slug, other) as (
  select wiki, slug, slug from pages union select r.wiki, r.slug, p.b from reach r join pairs p on p.wiki = r.wiki and p.a = r.other)
select wiki, slug, min(other) as component from reach group by wiki, slug""",
    "q_cut_structure": EDGES + _CUTS + " select * from cut_structure",
    "q_eccentricity": EDGES + _PAIRS + _ECC + " select wiki, slug, eccentricity from ecc",
    "q_diameter": EDGES + _PAIRS + _ECC + ", far as (select wiki, max(eccentricity) as diameter, min(eccentricity) as radius from ecc group by wiki) select wiki, diameter, radius, list(slug order by slug) filter (eccentricity = radius) as center, list(slug order by slug) filter (eccentricity = diameter) as periphery from ecc join far using (wiki) group by all",
    "q_neighbours": EDGES + _DEGREES + ", hub as (select wiki, slug from degrees join nodes using (wiki, slug) where not external order by degree desc, title, slug, wiki limit 1) select 'out' as direction, dst as slug from edges e join hub h on h.wiki = e.wiki and h.slug = e.src union all select 'in', src from edges e join hub h on h.wiki = e.wiki and h.slug = e.dst",
    "q_lint_orphan": _LINKS + "select wiki, slug from pages where coalesce(type, '') <> 'section' and slug <> 'index' and slug not like '%/index' and (wiki, slug) not in (select wiki, target from links)",
    "q_lint_broken": _LINKS + "select wiki, slug, 'broken link in ' || field || ': ' || target as message from links l where target not like 'wiki://%' and not exists (select 1 from pages p where p.wiki = l.wiki and p.slug = l.target)",
    "q_lint_cross": _LINKS + "select wiki, slug, 'cross-wiki link to unmounted wiki: ' || target as message from links where target like 'wiki://%/%' and regexp_extract(target, '^wiki://([^/]*)/', 1) not in (select wiki from pages)",
    "q_lint_missing_fields": PAGES + """select wiki, slug, 'required field missing: ' || need as message from (select p.*, unnest(t.required) as need from pages p join page_types t using (type)) where not case
  when need = 'title' then coalesce(title, '') <> '' when need = 'type' then coalesce(type, '') <> '' when need = 'summary' then coalesce(summary, '') <> '' when need = 'status' then coalesce(status, '') <> ''
  else coalesce(len(fields[need]), 0) > 0 or coalesce(text_vals[need], '') <> '' or coalesce(list_contains(map_keys(numeric_vals), need), false) end""",
    "q_lint_stale": PAGES + f"""select wiki, slug, 'stale page: ' || case when day is not null then 'last updated ' || text_vals['last_updated'] else 'no last_updated date' end as message
from (select *, {_DAY} as day from pages) where coalesce(status, '') in ('active', '') and confidence < 0.4 and (day is null or date_diff('day', day, date '{AS_OF}') > 90)""",
    "q_lint_unknown_type": PAGES + "select wiki, slug, 'unknown type: ' || type as message from pages where coalesce(type, '') <> '' and type not in (select type from page_types)",
    "q_edge_targets": PAGES + """select f.wiki, f.slug, f.field, f.target, coalesce(p.type, '') as target_type
from (select wiki, slug, field, unnest(targets) as target, target_types from (select wiki, slug, type, unnest(map_keys(fields)) as field, unnest(map_values(fields)) as targets from pages) x join edge_decls d using (type, field) where len(target_types) > 0) f
join pages p on p.wiki = f.wiki and p.slug = f.target where not list_contains(f.target_types, coalesce(p.type, ''))""",
    "q_staleness": PAGES + ", " + _AGE + " select * from aged",
    "q_stats": EDGES + _METRICS + ", " + _AGE + ", counts as (select wiki, count(*) filter (coalesce(type, '') <> 'section') as pages, count(*) filter (type = 'section') as sections, trunc(avg(confidence) * 100 + 0.5) / 100 as avg_confidence from pages group by wiki) select * from counts join metrics using (wiki) join aged using (wiki)",
    "q_schema_validate": PAGES + """
select wiki, slug, 'error' as severity, 'title or name is required' as message from pages where coalesce(title, '') = '' and coalesce(text_vals['name'], '') = ''
union all select wiki, slug, 'warning', 'missing type, default assumed' from pages where coalesce(type, '') = ''
union all select wiki, slug, 'warning', 'unknown type: ' || type from pages where coalesce(type, '') <> '' and type not in (select type from page_types)""",
    "q_suggest_tags": PAGES + """, t as (select distinct wiki, slug, type, greatest(coalesce(len(tags), 1), 1) as n, unnest(tags) as tag from pages)
select a.wiki, a.slug, b.slug as other, count(*) / max(b.n) as score from t a join t b on a.wiki = b.wiki and a.tag = b.tag and a.slug <> b.slug group by all""",
    "q_suggest_2hop": EDGES + """, both_ways as (select wiki, src as a, dst as b from edges union select wiki, dst, src from edges),
one as (select b.wiki, a as slug, b as other from both_ways b join pages p on p.wiki = b.wiki and p.slug = b.a)
select o.wiki, o.slug, b.b as other, '2 hops via ' || min(o.other) as reason from one o join both_ways b on b.wiki = o.wiki and b.a = o.other where b.b <> o.slug and (o.wiki, o.slug, b.b) not in (select wiki, slug, other from one) group by o.wiki, o.slug, b.b""",
}


def _rule(name: str, rule: str, severity: str) -> str:
    """The rows of a rule's own SQL as findings; its tables are those that all share."""
    own = ORACLE_SQL[name]
    head = _LINKS if own.startswith(_LINKS) else PAGES
    rows = own[len(head) :].strip()
    message = "'no incoming links'" if rule == "orphan" else "message"
    return f"select wiki, slug, '{rule}' as rule, '{severity}' as severity, {message} as message from ({rows})"


_RULES = [("q_lint_orphan", "orphan", "warning"), ("q_lint_broken", "broken-link", "error"), ("q_lint_cross", "broken-cross-wiki-link", "warning"), ("q_lint_missing_fields", "missing-fields", "error"), ("q_lint_stale", "stale", "warning"), ("q_lint_unknown_type", "unknown-type", "error")]
_LINT = EDGES + _CUTS + _ECC + ", " + _LINKS[len(PAGES) :].strip().removeprefix(",") + ", findings as (" + " union all ".join(_rule(*r) for r in _RULES) + """
union all select wiki, a, kind, 'warning', case when kind = 'bridge' then 'link ' || a || ' → ' || b || ' is a bridge — its removal disconnects the graph' else 'removing this page would disconnect the graph — add alternative link paths' end from cut_structure
union all select e.wiki, e.slug, 'periphery', 'warning', 'most structurally isolated page — furthest from all others in the graph' from ecc e join (select wiki, max(eccentricity) as eccentricity from ecc group by wiki) f using (wiki, eccentricity))"""
ORACLE_SQL["q_lint"] = _LINT + " select * from findings"
ORACLE_SQL["q_lint_totals"] = _LINT + " select rule, severity, count(*) as n from findings group by all"


def _matches(queries: str, k: int) -> str:
    """CTEs up to best(wiki, qid, other, raw, score): the k best pages of its wiki for each query of queries(wiki, qid, term, times)."""
    return TOKENS + f""", queries as ({queries}),
lens as (select p.wiki, p.slug, coalesce(sum(t.w), 0) as len from pages p left join tokens t using (wiki, slug) group by p.wiki, p.slug),
stats as (select wiki, count(*) as n, avg(len) as avg_len from lens group by wiki),
tf as (select wiki, slug, term, sum(w) as tf from tokens group by all),
df as (select wiki, term, count(*) as df from tf group by all),
bm as (select q.wiki, q.qid, t.slug as other, sum(q.times * log2(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg_len))) as bm25
  from queries q join tf t on t.wiki = q.wiki and t.term = q.term join df d on d.wiki = q.wiki and d.term = q.term join lens l on l.wiki = t.wiki and l.slug = t.slug join stats s on s.wiki = q.wiki group by all),
ranked as (select b.wiki, qid, other, bm25 * case when coalesce(status, '') = 'active' then 1.0 when status = 'draft' then 0.8 when status = 'archived' then 0.3 else 0.9 end * coalesce(confidence, 1.0) as raw
  from bm b join pages p on p.wiki = b.wiki and p.slug = b.other where coalesce(type, '') <> 'section'),
best as (select *, trunc(raw * 100 + 0.5) / 100 as score from (select *, row_number() over (partition by wiki, qid order by round(raw, 9) desc, other) as r from ranked where raw > 0) where r <= {k})
"""


_CUT = r"lower(unnest(regexp_extract_all(regexp_replace({}, '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{Nd}}]+|\p{{Han}}')))"
ORACLE_SQL["q_suggest_bm25"] = (
    _matches("select wiki, qid, term, count(*) as times from (select wiki, slug as qid, " + _CUT.format("coalesce(title, '') || ' ' || coalesce(summary, '')") + " as term from pages) group by all", 10)
    + "select wiki, qid as slug, other, score / greatest(top, 0.001) * 0.7 as score from (select *, max(score) over (partition by wiki, qid) as top from best) where qid <> other"
)
ORACLE_SQL["q_suggest_tag_search"] = (
    _matches("select wiki, qid, term, count(*) as times from (select wiki, tag as qid, " + _CUT.format("tag") + " as term from (select distinct wiki, unnest(tags) as tag from pages)) group by all", 20)
    + """select wiki, slug, other, len([t for t in tags if list_contains(their_tags, t)]) / greatest(len(their_tags), 1) as score, 'shares tags: ' || array_to_string(tags, ', ') as reason
from (select distinct p.wiki, p.slug, b.other, p.tags, o.tags as their_tags from (select wiki, slug, tags, unnest(tags) as tag from pages) p join best b on b.wiki = p.wiki and b.qid = p.tag join pages o on o.wiki = b.wiki and o.slug = b.other where o.slug <> p.slug)
where len([t for t in tags if list_contains(their_tags, t)]) > 0"""
)
