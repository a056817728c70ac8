"""The three-page wiki end to end: files, pages, search, graph, lint, versions, ingest, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagewright import catalog, config, ingest
from pagewright.operators import graph as G
from pagewright.operators import index as I
from pagewright.operators import listing, quality, structure, suggest
from pagewright.operators import search as S
from pagewright.sources import git, markdown, schemas
from pagewright.streaming import watch

EDGES = {"sources": {"relation": "fed-by", "target_types": ["paper"]}, "concepts": {"relation": "depends-on", "target_types": ["concept"]}}
SCHEMAS = {
    "base.json": {"x-wiki-types": {"default": "any"}, "required": ["title", "type"], "properties": {"title": {"type": "string"}, "status": {"type": "string", "enum": ["active", "draft"]}, "last_updated": {"type": "string"}}},
    "concept.json": {"x-wiki-types": {"concept": "a concept"}, "required": ["title", "type", "read_when"], "properties": {"read_when": {"type": "string"}, "concepts": {"type": "array"}}, "x-graph-edges": EDGES, "x-index-aliases": {"name": "title"}},
}
# The pages of the conformance wiki, whose counts, ranks and findings are checked below. Other cases use wikis of their own.
PAGES = {
    "concepts/attention.md": '---\ntitle: 注意力机制\ntype: concept\nstatus: active\nlast_updated: "2026-08-16"\nconfidence: 0.9\ntags: [deep-learning]\nconcepts: [concepts/moe]\n---\n\n注意力机制 looks at all tokens. [[concepts/moe]] and [rnn](../concepts/rnn.md)\n',
    "concepts/moe.md": '---\ntitle: 混合专家模型\ntype: concept\nstatus: active\nlast_updated: "2026-08-15"\nconfidence: 0.8\ntags: [deep-learning, transformer]\nconcepts: [concepts/attention]\n---\n\n门控网络 路由 picks experts, see [[concepts/attention]].\n',
    "concepts/rnn.md": '---\ntitle: 循环神经网络\ntype: concept\nstatus: draft\nlast_updated: "2026-07-01"\ntags: [deep-learning]\n---\n\nrecurrent gating of states\n',
    "index.md": "---\ntitle: Home\n---\n\nhome",
}


@pytest.fixture(scope="module")
def wiki(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo") / "wiki"
    for name, text in PAGES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, "utf-8")
    return root


@pytest.fixture(scope="module")
def registry():
    return schemas.load(".", SCHEMAS)


@pytest.fixture(scope="module")
def pages(spark, wiki, registry):
    return markdown.to_pages(markdown.read_files(spark, str(wiki)), "w", registry).cache()


@pytest.fixture(scope="module")
def decls(spark, registry):
    return spark.createDataFrame(registry.edge_rows(), "type string, field string, relation string, target_types array<string>")


def test_pages(spark, wiki, pages):
    rows = {r.slug: r for r in pages.collect()}
    assert sorted(rows) == ["concepts/attention", "concepts/moe", "concepts/rnn"]
    assert rows["concepts/attention"].body_links == ["concepts/moe", "concepts/rnn"]
    assert rows["concepts/attention"].fields == {"concepts": ["concepts/moe"]} and rows["concepts/rnn"].confidence is None
    assert rows["concepts/moe"].uri == "wiki://w/concepts/moe"
    assert [r.path for r in markdown.skipped(markdown.read_files(spark, str(wiki))).collect()] == ["index.md"]


def test_search(pages):
    top = lambda q: S.keyword(pages, q, excerpts=True).first()
    for query, slug in (("注意力机制", "attention"), ("混合专家模型", "moe"), ("门控网络 路由", "moe"), ("recurrent gating", "rnn")):
        assert top(query).slug == f"concepts/{slug}" and top(query).excerpt
    assert S.keyword(pages, "zzz").count() == 0 and listing.render_hits(S.keyword(pages, "zzz")) == "No results found.\n"
    with pytest.raises(ValueError):
        S.keyword(pages, "gating", k=-1)


def test_vectors(spark, pages):
    axis = {"concepts/moe": [1.0, 0.0, 0.0, 0.0], "concepts/attention": [0.0, 1.0, 0.0, 0.0], "concepts/rnn": None}
    v = spark.createDataFrame(list(axis.items()), "slug string, embedding array<float>")
    p = pages.join(v, "slug")
    assert [r.slug for r in S.semantic(p, [1.0, 0, 0, 0]).collect()] == ["concepts/moe", "concepts/attention"]
    assert {r.slug for r in S.hybrid(p, "recurrent", [0, 1.0, 0, 0]).collect()} == {"concepts/attention", "concepts/rnn"}


def test_postings_score_as_the_scan(pages):
    from pagewright.functions import text as X

    a = {r.slug: round(r.bm25, 9) for r in S.bm25(pages, "gating 注意 gating").filter("bm25 > 0").collect()}
    b = {r.slug: round(r.bm25, 9) for r in S.bm25_postings(I.postings(pages), pages.select("wiki", "slug", X.bag_length().alias("len")), "gating 注意 gating").collect()}
    assert a == b and a


def test_graph(pages, decls):
    nodes, edges = (x.cache() for x in G.build(pages, decls))
    assert nodes.count() == 3 and edges.count() == 5
    assert {r.relation: r.n for r in G.relations(edges).collect()} == {"links-to": 3, "depends-on": 2}
    assert "Key hubs" in G.render_summary(nodes, edges) and "digraph wiki" in G.render_dot(nodes, edges) and "graph LR" in G.render_mermaid(nodes, edges)
    cuts = sorted((r.kind, r.a, r.b) for r in structure.cut_structure(nodes, edges).collect())
    assert cuts == [("articulation-point", "concepts/attention", None), ("bridge", "concepts/attention", "concepts/moe"), ("bridge", "concepts/attention", "concepts/rnn")]
    d = structure.distance_summary(structure.eccentricities(nodes, edges)).first()
    assert (d.diameter, d.radius, d.center) == (2, 1, ["concepts/attention"])
    assert {r.slug for r in G.subgraph(nodes, edges, ("w", "concepts/rnn"), 1)[0].collect()} == {"concepts/rnn", "concepts/attention"}
    assert G.subgraph(nodes, edges, ("w", "none"))[0].count() == 0
    two = suggest.by_two_hops(edges, pages.filter("slug = 'concepts/moe'")).collect()
    assert [r.other for r in two] == ["concepts/rnn"]
    assert [r.slug for r in listing.backlinks(pages, "concepts/moe").collect()] == ["concepts/attention"]


def test_lint(spark, pages, registry):
    types = spark.createDataFrame([(k, v["required"]) for k, v in registry.types.items()], "type string, required array<string>")
    found = quality.lint(pages, types, "2026-08-20").collect()
    assert sum(f.rule == "missing-fields" for f in found) == 3 and not any(f.rule == "broken-link" for f in found)
    assert quality.lint(pages, types, "2026-08-20", rules=["orphan"]).count() == 0


def test_list_and_export(pages):
    rows = listing.page_list(pages, 1, 2).collect()
    assert [r.slug for r in rows] == ["concepts/attention", "concepts/moe"] and rows[0].total == 3
    assert "_Page 1/2" in listing.render_list(rows, 1, 2, 3)
    with pytest.raises(ValueError):
        listing.page_list(pages, 1, 0)
    text = "\n".join(r.text for r in listing.export_text(pages, "w").collect())
    assert text.startswith("# w\n\n3 pages\n\n## concept (3)\n\n- [")


def test_versions(spark, pages, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/ix")
    assert store.state() is None
    s = I.State("h", "c1", "simple", 3, 0, {"concept": "x"})
    for _ in range(3):
        store.write(pages, s, keep=2)
    assert store.versions() == [3, 2] and store.state() == s and store.read("postings").count() > 0
    assert I.staleness(None, s) == "full_rebuild_needed" and I.staleness(s, s) == "current"
    assert I.staleness(s, I.State("h", "c2", "simple", 3, 0, {"concept": "x"})) == "commit_changed"
    assert I.staleness(s, I.State("g", "c1", "simple", 3, 0, {"concept": "y"})) == "types_changed"


def test_incremental_is_a_rebuild(spark, pages):
    fresh = pages.withColumn("title", F.lit("new"))
    changed = spark.createDataFrame([("w", "concepts/moe", "M"), ("w", "concepts/rnn", "D"), ("w", "concepts/none", "D")], "wiki string, slug string, status string")
    got = {r.slug: r.title for r in I.apply_changes(pages, changed, fresh).collect()}
    assert got == {"concepts/attention": "注意力机制", "concepts/moe": "new"}


def test_ingest(spark, registry):
    text = "---\ntitle: A\ntype: concept\n---\n\r\nkey: ghp_" + "a" * 36 + "\n"
    files = spark.createDataFrame([("a.md", text), ("b.md", "no title")], "path string, content string")
    rows = {r.path: r for r in ingest.ingest(files, registry).collect()}
    assert [(m.pattern_name, m.line_number) for m in rows["a.md"].redacted] == [("github-pat", 6)] and "ghp_" not in rows["a.md"].content
    assert rows["b.md"].problems[0].severity == "error" and rows["a.md"].problems[0].message.endswith("read_when is required")
    only = ingest.report(ingest.ingest(files, registry, spark.createDataFrame([("a.md",)], "path string"))).first()
    assert (only.pages_validated, only.unchanged_count) == (1, 1)
    everything = ingest.report(ingest.ingest(files, registry, spark.createDataFrame([], "path string"))).first()
    assert everything.pages_validated == 2


def test_streams(spark, wiki, tmp_path):
    seen = []
    q = watch.ingest_stream(watch.file_stream(spark, str(wiki)), lambda df, n: seen.append(df.count()), f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert sum(seen) == 4
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    ev = spark.createDataFrame([("w", "a", at(0)), ("w", "b", at(1)), ("w", "a", at(1)), ("w", "c", at(9)), ("v", "a", at(1))], "wiki string, path string, changed_at timestamp")
    got = sorted((r.wiki, tuple(r.paths), r.n_events) for r in watch.debounce(ev, "2 seconds").collect())
    assert got == [("v", ("a",), 1), ("w", ("a", "b"), 3), ("w", ("c",), 1)]
    ev.write.parquet(f"{tmp_path}/ev")
    stream = watch.debounce(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev"), "2 seconds", "0 seconds")
    run = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp2").start()
    run.awaitTermination(120)
    closed = {(r.wiki, tuple(r.paths)) for r in spark.table("sessions").collect()}
    assert closed <= {(w, p) for w, p, _ in got} and ("w", ("a", "b")) in closed
    before = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [tuple(r) for r in watch.deletions(before, before.filter("path = 'a'")).collect()] == [("b", "D")]


def test_git(spark, tmp_path):
    import subprocess

    repo = tmp_path / "g"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.md").write_text("one two three four five six seven\n")
    (repo / "b.md").write_text("b")
    run("add", "."), run("commit", "-qm", "first")
    base = git.head(str(repo))
    run("mv", "a.md", "c.md"), run("commit", "-qm", "second")
    (repo / "b.md").unlink()
    (repo / "d.md").write_text("d")
    assert {r.path: r.status for r in git.changes(spark, str(repo), base).collect()} == {"a.md": "D", "c.md": "A", "b.md": "D", "d.md": "A"}
    assert [r.message for r in git.history(spark, str(repo), "c.md").collect()] == ["second", "first"]


def test_catalog(tmp_path):
    c = catalog.Catalog.open(tmp_path / "c.json")
    c.create("w", tmp_path / "r")
    c.create("v", tmp_path / "s")
    assert catalog.Catalog.open(tmp_path / "c.json").names() == ["v", "w"] and c.default == "w"
    with pytest.raises(ValueError):
        c.remove("w")
    with pytest.raises(ValueError):
        catalog.check_root(tmp_path, "../x")
    p = catalog.new_page(c.root("w"), "a/b-c", "2024-01-01")
    assert p.exists() and (c.root("w") / "a/index.md").exists() and "B C" in p.read_text()
    with pytest.raises(ValueError):
        catalog.write_page(c.root("w"), "../x", "")
    assert catalog.promote(c.root("w"), "a/b-c").name == "index.md"


def test_config(tmp_path):
    (tmp_path / "a.toml").write_text("[search]\ntop_k = 3\n[search.status]\nstub = 0.5\n[embedding]\napi_key = 'abcdefghijklmnop'\n")
    c = config.load(tmp_path / "a.toml", tmp_path / "none.toml")
    assert c.search.top_k == 3 and c.search.page_size == 20 and c.search.status["stub"] == 0.5 and c.search.status["draft"] == 0.8
    assert c.get("embedding.api_key") == "abc...mnop" and c.set("graph.depth", 5).graph.depth == 5
    with pytest.raises(KeyError):
        c.get("search.none")


def test_schemas(registry):
    assert registry.kinds["concepts"] == "keyword" and registry.kinds["status"] == "keyword" and registry.kinds["read_when"] == "text"
    assert schemas.violations({"a": 1, "b": [1, "x"]}, {"type": "object", "required": ["c"], "properties": {"a": {"type": "string"}, "b": {"type": "array", "items": {"type": "string"}}}}) == ["/: c is required", "/a: is not string", "/b/0: is not string"]
    assert registry.template("concept") == {"title": "", "type": "concept", "read_when": ""}
    with pytest.raises(ValueError):
        schemas.load(".", {"a.json": {}})
