"""Lint rules of the graph."""

from pagewright.operators import quality as Q
from pagewright.operators import structure as T
from pagewright.plans import graphs as P


def test_periphery_of_small_wikis(spark):
    nodes = spark.createDataFrame([("w", s, False) for s in "abcd"] + [("w", "wiki://v/x", True)], "wiki string, slug string, external boolean")
    edges = spark.createDataFrame([("w", "a", "b"), ("w", "b", "c"), ("w", "c", "d"), ("w", "a", "wiki://v/x")], "wiki string, src string, dst string")
    got = Q.periphery(T.eccentricities(nodes, edges)).collect()
    assert {(r.wiki, r.slug, r.rule, r.severity) for r in got} == {("w", "a", "periphery", "warning"), ("w", "d", "periphery", "warning")}
    assert Q.periphery(T.eccentricities(nodes, edges, most_nodes=3)).count() == 0


def test_lint_holds_every_structural_rule(spark, data):
    found = P.q_lint(spark, data)
    want = {(r.wiki, r.slug) for r in Q.periphery(P.q_eccentricity(spark, data)).collect()}
    assert {(r.wiki, r.slug) for r in found.filter("rule = 'periphery'").collect()} == want and want
    assert {"articulation-point", "bridge", "periphery", "orphan"} <= {r.rule for r in found.select("rule").distinct().collect()}
