"""The driver contract."""

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "pagewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "pagewright.llm" not in p.read_text("utf-8")


def test_some_queries_run(spark, data):
    q = entry.queries()
    for name in ("q_bm25", "q_facets_one_scan", "q_graph_metrics", "p5_found", "q_list_page", "q_export_lines"):
        assert q[name](spark, data).count() > 0
