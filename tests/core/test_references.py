"""Orphan references against plain loops, on a fixture with every odd case."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagewright.operators import references as R

PAGES = "rev_id long, wiki string, slug string, type string, indexed_at timestamp, body_links array<string>, fields map<string,array<string>>, key string, period int, container long"
CHANGES = "change_id long, wiki string, path string, status string, changed_at timestamp"
DECLS = "type string, field string, relation string, target_types array<string>"


def fixture(seed: int, n: int = 160):
    r = random.Random(seed)
    slugs = [f"a/p{k}" for k in range(60)]
    home = {s: r.choice(["x", "y"]) for s in slugs}
    day = datetime(2024, 1, 1)
    dress = [lambda s: s, lambda s: f" {s} ", lambda s: s + "#part", lambda s: s + "|name", lambda s: s + ".md", lambda s: f"wiki://{home.get(s, 'x')}/{s}", lambda s: f"wiki://none/{s}", lambda s: "", lambda s: "  ", lambda s: None]
    ref = lambda: r.choice(dress)(r.choice(slugs + ["a/none"]))
    hot = slugs[0]
    pages = []
    for k in range(n):
        s = r.choice(slugs[:50])
        fields = r.choice([None, {}, {"sources": [ref(), ref()], "concepts": [ref()], "aliases": ["a/none"]}, {"superseded_by": [ref()]}])
        links = r.choice([None, [], [hot, hot, ref()], [ref(), ref()]])
        pages.append({"rev_id": k, "wiki": home[s], "slug": s, "type": r.choice(["concept", "paper", None]), "indexed_at": day + timedelta(hours=r.randrange(5000)), "body_links": links, "fields": fields, "key": "clash", "period": 7, "container": None})
    kinds = {}
    for p in pages:  # a page keeps its type
        p["type"] = kinds.setdefault(p["slug"], p["type"])
    changes = [{"change_id": k, "wiki": home[s], "path": r.choice([f"wiki/{s}.md", f"wiki/{s}/index.md"]), "status": r.choice("AMDRC?D"), "changed_at": day + timedelta(hours=r.randrange(9))} for k, s in enumerate(r.choices(slugs, k=70))]
    decls = [{"type": "concept", "field": "sources", "relation": "fed-by", "target_types": ["paper"]}, {"type": "paper", "field": "sources", "relation": "cites", "target_types": None}, {"type": "concept", "field": "superseded_by", "relation": "s", "target_types": []}]
    return pages, changes, decls


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_loops(spark, seed):
    pages, changes, decls = fixture(seed)
    got = R.faulty_references(spark.createDataFrame(pages, PAGES), spark.createDataFrame(changes, CHANGES), spark.createDataFrame(decls, DECLS)).select("rev_id", "field", "target", "reason")
    assert sorted(map(tuple, got.collect())) == sorted(R.brute_force(pages, changes, decls))


def test_empty_tables(spark):
    none = [spark.createDataFrame([], s) for s in (PAGES, CHANGES, DECLS)]
    assert R.faulty_references(*none).count() == 0
    assert R.orphan_report(R.faulty_references(*none)).count() == 0


def test_split_of_hot_keys_loses_nothing(spark):
    from pagewright.session import salted_join

    many = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)], "id long, key string")
    one = spark.createDataFrame([("hot", 1)] + [(f"k{k}", 2) for k in range(0, 300, 3)], "key string, v int")
    got = salted_join(many, one, ["key"], "id", hot_rows=20)
    assert got.count() == 300 and got.columns.count("_salt") == 0
    assert got.select("id").distinct().count() == 300


@given(st.sets(st.integers(0, 65535), max_size=9000), st.sets(st.integers(0, 65535), max_size=9000))
def test_containers(a, b):
    pa, pb = (R.pack_container(np.array(sorted(x), np.int64)) for x in (a, b))
    assert R.unpack_container(pa).tolist() == sorted(a)
    assert R.and_not(pa, pb).tolist() == sorted(a - b)


def test_dense_containers():
    a, b = np.arange(0, 60000, 2), np.arange(0, 60000, 3)
    assert R.and_not(R.pack_container(a), R.pack_container(b)).tolist() == sorted(set(a) - set(b))
