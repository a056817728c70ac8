"""Listing queries."""

import hashlib

from pagewright.plans import listings as P

ROWS = "rev_id long, wiki string, title string, summary string, body string"


def test_embedding_text_is_cut_by_wiki(spark, tmp_path):
    body = "x" * 9000
    wikis = ["short", "long", "zero", "null", "gone"]
    spark.createDataFrame([(k, w, "T", "", body) for k, w in enumerate(wikis)], ROWS).write.parquet(f"{tmp_path}/corpus_pages.parquet")
    spark.createDataFrame([("short", 600), ("long", 8000), ("zero", 0), ("null", None)], "wiki string, max_text_chars int").write.parquet(f"{tmp_path}/embed_config.parquet")
    got = {r.rev_id: r.digest for r in P.q_embed_text_effective(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(f"T\n{body}"[:n].encode()).hexdigest() for k, n in enumerate((600, 8000, 4000, 4000, 4000))}
