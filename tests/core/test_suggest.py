"""Suggestions of every page against brute force."""

import random
import time

from pyspark.sql import functions as F

from pagewright.config import LINK_FIELDS
from pagewright.functions import text as X
from pagewright.operators import graph as G
from pagewright.operators import quality as Q
from pagewright.operators import structure as T
from pagewright.operators import suggest as U
from pagewright.plans import graphs as P
from pagewright.plans.common import pages
from pagewright.session import cut_lineage

SCHEMA = "wiki string, slug string, title string, summary string, body string, type string, status string, confidence double, tags array<string>, body_links array<string>, fields map<string,array<string>>"


def small(spark, seed=4, n=40):
    r = random.Random(seed)
    words = "router gate sparse index graph page link 检 索 expert".split()
    rows = []
    for w in "wv":
        for k in range(n):
            text = lambda m: " ".join(r.choices(words, k=m))
            tags = r.choices("abcdefg", k=r.randint(0, 3)) or None
            links = [f"p{r.randrange(n + 3):02d}" for _ in range(r.randint(0, 3))]
            rows.append((w, f"p{k:02d}", text(2), text(3) if k % 4 else None, text(12), r.choice(["skill", "note", "section", None]), r.choice(["active", "draft", None]), r.choice([None, 0.5, 1.0]), tags, links, {LINK_FIELDS[0]: links[:1]}))
    return spark.createDataFrame(rows, SCHEMA).cache()


def tag_rows(rows):
    return {(a.wiki, a.slug, b.slug): len(set(a.tags) & set(b.tags)) / max(len(b.tags), 1) for a in rows for b in rows if a.wiki == b.wiki and a.slug != b.slug and a.tags and b.tags and set(a.tags) & set(b.tags)}


def test_tags_of_every_page(spark):
    p = small(spark)
    rows = p.collect()
    want = tag_rows(rows)
    assert {(r.wiki, r.slug, r.other): r.score for r in U.by_tags(p, p).collect()} == want
    got = {}
    for r in U.best_by_tags(p, p).collect():
        assert want[r.wiki, r.slug, r.other] == r.score
        got.setdefault((r.wiki, r.slug), []).append((r.score, r.other))
    skip = {(x.wiki, x.slug): {x.slug, *(x.body_links or []), *(v for vs in x.fields.values() for v in vs)} for x in rows}
    for x in rows:
        best = lambda found: sorted((-int(s * 100 + 0.5), o) for s, o in found if s >= 0.1 and o not in skip[x.wiki, x.slug])[:5]
        assert best(got.get((x.wiki, x.slug), [])) == best([(s, o) for (w, a, o), s in want.items() if (w, a) == (x.wiki, x.slug)])


def test_peers_are_no_candidates_yet(spark):
    p = small(spark)
    rows = p.collect()
    found = spark.createDataFrame([(x.wiki, x.slug, int(x.slug[1:]) % 3) for x in rows], "wiki string, slug string, community int")
    taken = U.linked(p)
    gone = {tuple(x) for x in taken.collect()} | set(tag_rows(rows))
    want = {(x.wiki, x.slug, o) for x in rows for o in [y.slug for y in rows if y.wiki == x.wiki and (int(y.slug[1:]) - int(x.slug[1:])) % 3 == 0 and (x.wiki, x.slug, y.slug) not in gone][:2]}
    assert {(x.wiki, x.slug, x.other) for x in U.by_community(found, p, taken).collect()} == want


def test_every_type_gets_suggestions(spark, data):
    types = {tuple(r) for r in pages(spark, data).select("wiki", "slug", "type").collect()}
    for name in ("q_suggest_tags", "q_suggest_2hop", "q_suggest_tag_search", "q_suggest_merged"):
        asked = {tuple(r) for r in P.QUERIES[name](spark, data).select("wiki", "slug").distinct().collect()}
        assert len({t for w, s, t in types if (w, s) in asked}) > 10, name


def test_text_of_every_page(spark):
    p = small(spark, n=24).withColumn("uri", F.lit(""))
    for block in (4096, 7):
        got = {}
        for r in U.by_texts(p, p, block=block).collect():
            got.setdefault((r.wiki, r.slug), {})[r.other] = round(r.score, 9)
        assert len(got) == 48
        for x in p.filter("slug in ('p00', 'p05', 'p10') and wiki = 'w'").collect():
            assert got[x.wiki, x.slug] == {r.other: round(r.score, 9) for r in U.by_text(p, x.title, x.summary or "", x.slug, x.wiki).collect()}


def test_merge_holds_similar_content(spark, data):
    assert P.q_suggest_merged(spark, data).filter("reason = 'similar content'").count() > 0


def test_first_two_hops_are_enough(spark):
    """The merge keeps the same rows from the bounded form as from all nodes two steps away, about a hub too."""
    r = random.Random(3)
    names = [f"p{k:02d}" for k in range(40)]
    pairs = {("w", "p00", s) for s in names[1:30]} | {("w", *r.sample(names, 2)) for _ in range(50)} | {("v", "p01", "p02"), ("v", "p02", "p03")}
    edges = spark.createDataFrame(sorted(pairs), "wiki string, src string, dst string")
    links = {}
    for w, a, b in pairs:
        links.setdefault((w, a), []).append(b)
    p = spark.createDataFrame([(w, s, "t", "skill", [], links.get((w, s)), None) for w in "wv" for s in names], "wiki string, slug string, title string, type string, tags array<string>, body_links array<string>, fields map<string,array<string>>").cache()
    every = U.by_two_hops(edges, p).cache()
    few = U.best_two_hops(edges, p, 5).cache()
    assert few.count() <= every.count() and few.exceptAll(every).count() == 0
    kept = [sorted((x.wiki, x.slug, x.other, x.score, x.reason, x.place) for x in U.merge(p, [part]).collect()) for part in (every, few)]
    assert kept[0] == kept[1] and len(kept[0]) > 60


def test_tag_search(spark):
    rows = [("w", "a", "red apple", ["fruit", "red"]), ("w", "b", "fruit bowl", ["fruit"]), ("w", "c", "fruit", ["bowl"]), ("w", "d", "nothing", ["fruit"]), ("v", "e", "fruit", ["fruit"]), ("w", "f", None, None)]
    p = spark.createDataFrame([(w, s, "", t, "", "", "skill", "active", None, tags) for w, s, t, tags in rows], "wiki string, slug string, uri string, title string, summary string, body string, type string, status string, confidence double, tags array<string>")
    got = {(x.slug, x.other): (x.score, x.reason) for x in U.by_tag_search(p, p).collect()}
    # d has the tag, but its text is not found
    assert got == {("a", "b"): (1.0, "shares tags: fruit, red"), ("d", "b"): (1.0, "shares tags: fruit")}
    assert U.by_tag_search(p.limit(0), p.limit(0)).count() == 0


def linked_pages(spark, n=2100):
    """A wiki whose communities take some minutes as plain Python."""
    r = random.Random(9)
    rows = [("w", f"p{k:04d}", f"P{k}", None, None, "note", "active", 0.5, None, [f"p{r.randrange(n):04d}" for _ in range(3)], {}, {"last_updated": "2025-06-29"}) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA + ", text_vals map<string,string>").cache(), spark.createDataFrame([], "type string, field string, relation string, target_types array<string>")


def test_dashboard_of_a_larger_wiki(spark):
    p, decls = linked_pages(spark)
    start = time.perf_counter()
    (row,) = Q.dashboard(p, decls, "2025-06-30").collect()
    assert (row.pages, row.nodes, row.fresh, row.diameter) == (2100, 2100, 2100, None) and row.structural_note and 1 < row.communities < 2100
    assert time.perf_counter() - start < 150


def test_dashboard_finds_the_pages_once(spark, data):
    plan = P.q_dashboard(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "indexed_at" not in plan  # each part that found the newest deliveries ranked them by indexed_at


def test_peers_of_a_larger_wiki(spark):
    p, decls = linked_pages(spark)
    start = time.perf_counter()
    found = T.communities(*G.build(p, decls))
    peers = U.by_community(found, p, U.linked(p), tags_taken=False)
    of = {x.slug: x.community for x in found.collect()}
    rows = peers.collect()
    assert len(of) == 2100 and len(rows) > 2100 and all(of[x.slug] == of[x.other] for x in rows)
    assert time.perf_counter() - start < 150


def test_terms_are_made_once(spark, data, monkeypatch):
    p = small(spark, n=24).withColumns({"uri": F.lit(""), "tags": F.split("title", " ")})
    held, light = U.terms_of(p).cache(), p.drop("body")
    for f in (U.by_texts, U.by_tag_search):
        want = sorted(tuple(r) for r in f(p, p).collect())
        assert want and sorted(tuple(r) for r in f(light, light, held=held).collect()) == want
    made = []
    for name in ("weighted_bag", "bag_length"):
        one = getattr(X, name)
        monkeypatch.setattr(X, name, lambda *a, one=one, name=name, **k: made.append(name) or one(*a, **k))
    assert P.q_suggest_merged(spark, data).count() > 0 and made == ["weighted_bag"]


def test_a_cut_leaves_no_shuffle(spark):
    kept = lambda: str(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")).count("shuffle_")
    before = kept()
    cut = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert cut.count() == 7 and kept() <= before + 2  # those of the count itself
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
