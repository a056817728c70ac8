"""Rebuild, update, ingest, snapshots, catalog and search entry, on small wikis of their own."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from pagewright import catalog as C
from pagewright import config, ingest, pipeline
from pagewright.functions import frontmatter as M
from pagewright.operators import graph as G
from pagewright.operators import index as I
from pagewright.operators import listing
from pagewright.operators import search as S
from pagewright.operators import structure as T
from pagewright.session import cut_lineage, number_rows
from pagewright.sources import schemas

SCHEMAS = {
    "default.json": {"required": ["title", "type"], "properties": {"title": {"type": "string"}, "type": {"type": "string"}}, "x-wiki-types": {"default": "a page"}},
    "recipe.json": {
        "required": ["title", "type"], "properties": {"title": {"type": "string"}, "type": {"type": "string"}, "uses": {"type": "array", "items": {"type": "string"}}},
        "x-wiki-types": {"recipe": "a dish"}, "x-graph-edges": {"uses": {"relation": "uses", "target_types": ["recipe"]}},
    },
}
FILES = {"soup.md": "---\ntitle: Leek soup\ntype: recipe\nuses: [bread, stock]\n---\n\nSimmer the leeks. See [[bread]].\r\n", "bread.md": "---\ntitle: Rye bread\ntype: recipe\ntags: [rye]\n---\n\nKnead. mail ghp_" + "a" * 36 + "\n", "stock/index.md": "---\ntitle: Stock\ntype: default\n---\n\nBones.\n"}


@pytest.fixture
def wiki(tmp_path):
    root = tmp_path / "repo" / "wiki"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "stock" / "photo.bin").write_bytes(b"\0\1")
    for args in (["init", "-q"], ["config", "user.email", "cook@kitchen.example"], ["config", "user.name", "Cook"], ["add", "."], ["commit", "-q", "-m", "first"]):
        subprocess.run(["git", "-C", str(tmp_path / "repo"), *args], check=True)
    return root


@pytest.fixture
def registry():
    return schemas.load("", SCHEMAS)


def test_rebuild_and_refresh(spark, wiki, registry, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/ix")
    failing = lambda texts: 1 / 0
    got = pipeline.refresh(spark, str(wiki), "k", registry, store, "c1", provider=failing)
    assert (got["action"], got["pages"], got["sections"]) == ("rebuild", 3, 0) and "3 pages" in got["warning"]
    now = I.State(registry.hash(), "c1", "simple", 0, 0, {t: registry.type_hash(t) for t in registry.types})
    assert store.status(now) == {"openable": True, "queryable": True, "stale": False, "built": "", "pages": 3, "sections": 0, "embedding_model": "", "embedding_dims": 0}
    assert pipeline.refresh(spark, str(wiki), "k", registry, store, "c1")["action"] == "none"
    (wiki / "bread.md").unlink()
    (wiki / "pie.md").write_text("---\ntitle: Pie\ntype: recipe\n---\n\nCrust with leeks.\n")
    changed = spark.createDataFrame([("bread.md", "D"), ("pie.md", "A")], "path string, status string")
    got = pipeline.refresh(spark, str(wiki), "k", registry, store, "c2", changed, provider=lambda texts: [[3.0, 4.0] for _ in texts])
    assert got["action"] == "update" and got["warning"] == ""
    rows = {r.slug: r for r in store.read().collect()}
    assert sorted(rows) == ["pie", "soup", "stock"] and [round(x, 2) for x in rows["pie"].embedding] == [0.6, 0.8]
    other = schemas.load("", {**SCHEMAS, "recipe.json": {**SCHEMAS["recipe.json"], "properties": {**SCHEMAS["recipe.json"]["properties"], "year": {"type": "number"}}}})
    assert pipeline.refresh(spark, str(wiki), "k", other, store, "c2")["action"] == "update_types"
    assert I.Store(spark, f"file://{tmp_path}/none").status(now)["openable"] is False


def test_store_search(spark, wiki, registry, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/ix")
    pipeline.rebuild(spark, str(wiki), "k", registry, store)
    corpus = C.Corpus(store.read(), store=store)
    hits = corpus.search("leeks bread").collect()
    scanned = S.keyword(store.read(), "leeks bread").collect()
    assert [(r.slug, r.score) for r in hits] == [(r.slug, r.score) for r in scanned] and hits[0].title
    rows = corpus.batch(spark.createDataFrame([(7, "stock bones"), (8, ""), (9, None), (7, "stock")], "query_id long, query string")).collect()
    assert {r.query_id for r in rows} == {7} and rows[0].slug == "stock"
    assert corpus.batch([]).count() == 0 and corpus.batch(["nothing"]).count() == 0 and corpus.batch(["stock"], type="recipe").filter("slug = 'stock'").count() == 0
    with pytest.raises(ValueError, match="not configured"):
        corpus.search("x", mode="semantic")
    with pytest.raises(ValueError, match="unknown search mode"):
        corpus.search("x", mode="fuzzy")
    vectors = store.read().withColumn("embedding", F.when(F.col("slug") == "soup", F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))))
    asked = C.Corpus(vectors, provider=lambda texts: [[2.0, 0.0] for _ in texts])
    assert [r.slug for r in asked.search("broth", mode="semantic").collect()] == ["soup"] and asked.search("bread", mode="hybrid", k=1).collect()[0].slug == "soup"


def test_dictionary_tokenizer_reaches_the_index(spark, tmp_path):
    pages = spark.createDataFrame([("k", "a", "u", "注意力机制", "", "", "x", "", 1.0), ("k", "b", "u", "力学", "", "", "x", "", 1.0)], "wiki string, slug string, uri string, title string, summary string, body string, type string, status string, confidence double")
    words = {"注意力": 10.0, "机制": 8.0, "力学": 5.0}
    store = I.Store(spark, f"file://{tmp_path}/ix")
    store.write(pages, I.State("", "", "zh", 2, 0, {}), cut=I.cutter("zh", words))
    corpus = C.Corpus(pages, config.Config(tokenizer="zh"), store=store, dictionary=words)
    assert [r.slug for r in corpus.search("注意力").collect()] == ["a"] and I.cutter("simple", words) is I.X.tokens
    with pytest.raises(ValueError):
        I.cutter("klingon")


def test_graph_snapshots(spark, wiki, registry, tmp_path):
    from pagewright.sources.markdown import read_files, to_pages

    pages = to_pages(read_files(spark, str(wiki)), "k", registry)
    decls = spark.createDataFrame(registry.edge_rows(), "type string, field string, relation string, target_types array<string>")
    calls = []
    build = lambda: calls.append(1) or G.build(pages, decls)
    store = I.GraphStore(spark, f"file://{tmp_path}/graph")
    assert store.load() is None
    nodes, edges = store.graph("c1", build, lambda n, e: T.communities(n, e, 1))
    store.graph("c1", build)
    assert len(calls) == 1 and nodes.count() == 3 and {(e.src, e.dst) for e in edges.collect()} == {("soup", "bread"), ("soup", "stock")}
    assert store.communities("c1").count() == 3 and store.communities("c9") is None
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)  # the snapshot they come from goes
    for k in range(2, 6):
        store.write(nodes, edges, f"c{k}", keep=2)
    assert store.versions() == [5, 4] and store.load("c1") is None and store.load("c5") is not None
    for name in G.FORMATS:
        text = G.entry(nodes, edges, name, str(tmp_path / "out" / f"{name}.md"), "2025-01-01")
        assert text in (tmp_path / "out" / f"{name}.md").read_text() or name == "llms"
    lone = nodes.unionByName(spark.createDataFrame([("k", "alone", "Alone", "recipe", False), ("k", "wiki://o/p", "wiki://o/p", "", True)], nodes.schema))
    summary = G.render_summary(lone, edges)
    assert "**Isolated nodes (2):** Alone, wiki://o/p" in summary and "**External references (1):** wiki://o/p" in summary
    with pytest.raises(ValueError):
        G.entry(nodes, edges, "svg")


def test_ingest_writes(spark, wiki, registry, tmp_path):
    store = I.Store(spark, f"file://{tmp_path}/ix")
    before = (wiki / "soup.md").read_bytes()
    dry = ingest.run(spark, str(wiki.parent), str(wiki), "k", registry, store, dry_run=True)
    assert (dry["pages_validated"], dry["redactions"], dry["assets_found"], dry["written"]) == (3, 1, 1, 0) and (wiki / "soup.md").read_bytes() == before
    out = ingest.run(spark, str(wiki.parent), str(wiki), "k", registry, store)
    assert out["written"] == 2 and out["redacted"] == [("bread.md", "github-pat", 7)] and out["version"] == 1 and out["commit"]
    assert b"\r" not in (wiki / "soup.md").read_bytes() and "[REDACTED:github-pat]" in (wiki / "bread.md").read_text()
    assert out["target_warnings"] == 1 and store.read().count() == 3
    again = ingest.run(spark, str(wiki.parent), str(wiki), "k", registry)
    assert again["written"] == 0 and again["commit"] == ""
    none = spark.createDataFrame([], "path string")
    assert ingest.report(ingest.ingest(spark.createDataFrame([("a.md", "x")], "path string, content string"), registry, none)).first().pages_validated == 1


def test_catalog_operations(tmp_path, wiki, monkeypatch):
    for k, v in {"GIT_AUTHOR_NAME": "Cook", "GIT_AUTHOR_EMAIL": "c@k.example", "GIT_COMMITTER_NAME": "Cook", "GIT_COMMITTER_EMAIL": "c@k.example"}.items():
        monkeypatch.setenv(k, v)
    cat = C.Catalog.open(tmp_path / "spaces.json")
    cat.create("kitchen", tmp_path / "new")
    assert (tmp_path / "new" / ".git").is_dir() and "create: kitchen" in subprocess.run(["git", "-C", str(tmp_path / "new"), "log", "--oneline"], capture_output=True, text=True).stdout
    assert schemas.load(tmp_path / "new" / "schemas").types.keys() == {"default"} and cat.info()["status"] == "ok"
    (tmp_path / "new" / "wiki").rename(tmp_path / "new" / "gone")
    assert cat.info()["status"] == "degraded"
    for bad in ("../x", "a/../../x", "", "/x", ".hidden", "a//b", "x.md"):
        for f in (lambda s: C.new_page(wiki, s, "2025-01-01"), lambda s: C.promote(wiki, s), lambda s: C.write_page(wiki, s, ""), lambda s: C.commit_pages(wiki.parent, wiki, [s], "m")):
            with pytest.raises(ValueError):
                f(bad)
    (wiki.parent / "schemas").mkdir()
    (wiki.parent / "schemas" / "recipe.md").write_text("## Steps\n")
    page = C.new_page(wiki, "cakes/lemon", "2025-01-01", body=C.body_template(wiki.parent, "recipe"))
    assert page.read_text().endswith("## Steps\n") and C.body_template(wiki.parent, "../x") == "" == C.body_template(wiki.parent, "none")
    assert C.page_uris(wiki, "k") == [f"wiki://k/{s}" for s in ("bread", "cakes", "cakes/lemon", "soup", "stock")] and C.page_uris(wiki, "k", "cakes/lemon.md") == ["wiki://k/cakes/lemon"]
    assert C.count_files(wiki) == 5
    got = C.read_content(wiki, "stock")
    assert got["assets"] == ["stock/photo.bin"] and got["notice"] is None and C.read_content(wiki, "stock", strip=True)["text"] == "Bones.\n"
    assert C.read_content(wiki, "stock/photo.bin") == {"asset": "stock/photo.bin", "binary": True, "text": None}
    C.write_page(wiki, "old", "---\ntitle: O\nsuperseded_by: bread\n---\nx")
    assert C.read_content(wiki, "old.md")["notice"] == "superseded by bread"
    for lost in ("nothing", "../spaces.json"):
        with pytest.raises(FileNotFoundError):
            C.read_content(wiki, lost)
    assert C.commit_pages(wiki.parent, wiki, ["stock", "old"], "pages") and not C.commit_pages(wiki.parent, wiki, ["old"], "again")


def test_views_and_table_functions(spark, wiki, registry):
    from pagewright.sources.markdown import read_files, to_pages

    pages = to_pages(read_files(spark, str(wiki)), "k", registry)
    C.register_views(spark, pages, spark.createDataFrame(registry.edge_rows(), "type string, field string, relation string, target_types array<string>"))
    assert [r.slug for r in spark.sql("select * from backlinks_of('bread')").collect()] == ["soup"]
    assert {(r.direction, r.slug) for r in spark.sql("select * from neighbours_of('k', 'bread')").collect()} == {("in", "soup")}
    assert [r.slug for r in spark.sql("select * from tagged('rye')").collect()] == ["bread"] and spark.sql("select * from pages_of('recipe')").count() == 2
    assert spark.sql("select * from pages_with('uses', 'stock')").count() == 1


def test_schema_operations(tmp_path):
    for name, s in SCHEMAS.items():
        (tmp_path / name).write_text(json.dumps(s))
    registry = schemas.load(tmp_path)
    assert [t["type"] for t in schemas.list_types(registry)] == ["default", "recipe"] and schemas.show(registry, "recipe")["edges"][0]["field"] == "uses"
    new = {"required": ["title"], "properties": {"title": {"type": "string"}}, "x-wiki-types": {"menu": "dishes"}}
    schemas.add(tmp_path, "menu", new)
    assert "menu" in schemas.load(tmp_path).types
    for name, bad in (("menu2", new), ("../x", new), ("y", {"required": ["z"], "x-wiki-types": {"y": ""}}), ("z", {})):
        with pytest.raises(ValueError):
            schemas.add(tmp_path, name, bad)
    assert schemas.remove(tmp_path, "menu") == ["menu.json"] and not (tmp_path / "menu.json").exists()
    with pytest.raises(KeyError):
        schemas.remove(tmp_path, "menu")
    with pytest.raises(KeyError):
        schemas.show(registry, "menu")


def test_config_is_written_back(tmp_path):
    file = tmp_path / "c.toml"
    config.save(file, "search.top_k", 7)
    config.save(file, "embedding.api_key", "secret-of-the-house")
    config.save(file, "search.status.draft", 0.5)
    c = config.load(file)
    assert c.search.top_k == 7 and c.search.status == {"active": 1.0, "draft": 0.5, "archived": 0.3, "unknown": 0.9} and c.list()["embedding.api_key"] == "sec...ouse" and c.list()["search.top_k"] == 7
    with pytest.raises(KeyError):
        config.save(file, "search.nothing", 1)


def test_strict_front_matter(spark):
    rows = ["---\na: 1\n---\nx", "---\na: [1\n---\nx", "no", "---\nopen", "---\n- a\n---\n", ""]
    got = [r.e for r in spark.createDataFrame([(t,) for t in rows], "t string").select(M.strict_error(F.col("t")).alias("e")).collect()]
    assert got[0] is None and got[1].startswith("invalid YAML") and got[2:] == ["no frontmatter block found", "no closing --- found", "frontmatter is not a mapping", "no frontmatter block found"]


def test_numbers_within_groups(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.randint(0, 50), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, id int").repartition(7)
    got = {x.id: x.place for x in number_rows(df, "g", [F.desc("x"), F.asc("id")]).collect()}
    for g in {x[0] for x in rows}:
        ordered = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in ordered] == list(range(1, len(ordered) + 1))
    assert number_rows(df.limit(0), "g", [F.asc("x")]).count() == 0


def plain_louvain(near):
    """The rule in its plainest form."""
    nodes = sorted(near)
    m = sum(map(len, near.values())) / 2
    at = {v: k for k, v in enumerate(nodes)}
    for _ in range(10 * len(nodes) + 100):
        moved = False
        for v in nodes:
            best = (0.0, None)
            for c in sorted({at[w] for w in near[v]} - {at[v]}):
                inside = sum(at[w] == c for w in near[v])
                total = sum(len(near[w]) for w in nodes if at[w] == c)
                gain = inside / m - total * len(near[v]) / (2 * m * m)
                if gain > best[0]:
                    best = (gain, c)
            if best[1] is not None:
                at[v], moved = best[1], True
        if not moved:
            break
    ids = {}
    return {v: ids.setdefault(at[v], len(ids)) for v in nodes}


def test_communities_follow_the_rule():
    for seed in range(15):
        r = random.Random(seed)
        near = {f"n{k:02d}": set() for k in range(r.randint(3, 14))}
        names = sorted(near)
        for _ in range(r.randint(2, 25)):
            a, b = r.sample(names, 2)
            near[a].add(b)
            near[b].add(a)
        near = {k: sorted(v) for k, v in near.items() if v}
        got = T.louvain_of(near)
        assert got == plain_louvain(near), seed


def test_distances_and_community_lists(spark):
    nodes = spark.createDataFrame([("k", s, False) for s in "abcdef"] + [("k", "x", True)], "wiki string, slug string, external boolean")
    edges = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c"), ("k", "d", "e"), ("k", "c", "x")], "wiki string, src string, dst string")
    (row,) = T.distance_summary(T.eccentricities(nodes, edges)).collect()
    assert (row.diameter, row.radius, row.center, row.periphery) == (2, 0, ["f"], ["a", "c"])
    found = spark.createDataFrame([("k", "a", 0), ("k", "b", 0), ("k", "c", 0), ("k", "d", 1), ("k", "e", 1), ("k", "f", None)], "wiki string, slug string, community int")
    (stats,) = T.community_stats(found).collect()
    assert (stats.communities, stats.largest, stats.smallest, stats.isolated) == (3, 3, 1, ["d", "e", "f"])


def test_exports(spark):
    pages = spark.createDataFrame([("k", "a", "wiki://k/a", "A", "t", None, 0.5, "", "body", {"f": ["x"]}, {"d": "2024-01-02"}, {"n": 2.0}), ("k", "b", "wiki://k/b", "B & <C>", "t", "archived", None, "s", "", None, None, None)], "wiki string, slug string, uri string, title string, type string, status string, confidence double, summary string, body string, fields map<string,array<string>>, text_vals map<string,string>, numeric_vals map<string,double>")
    rows = [json.loads(r.json) for r in listing.export_json(pages, include_archived=True).orderBy("place").collect()]
    assert rows[1]["frontmatter"] == {"d": "2024-01-02", "f": ["x"], "n": 2.0} and "frontmatter" not in rows[0] and "confidence" not in rows[0]
    full = {r.place: r.text for r in listing.export_full(pages).collect()}
    assert full[0] == "# k\n\n1 pages\n\n" and full[1].startswith("---\n\n# [A](wiki://k/a)") and len(full) == 2
    xml = listing.feed_xml(pages, "Kitchen", "https://k.example")
    assert "<title>B &amp; &lt;C&gt;</title><link>https://k.example/k/b</link>" in xml and xml.endswith("</channel></rss>")
