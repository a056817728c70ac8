"""Ranking: BM25 over pages or postings, vectors, both, several wikis at once, and facets.

Statistics (pages, document frequency, average length) always come from the
whole index, whatever filter a query has. Scores are double; ties go by slug.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.config import Search
from pagewright.functions import text as X
from pagewright.session import cut_lineage
from pagewright.sources.embeddings import unit

KEY = ["wiki", "slug"]


def status_multiplier(c: Search) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in c.status.items() for x in (k, float(v))]) if c.status else F.create_map().cast("map<string,double>")
    unknown = float(c.status.get("unknown", 0.9))
    return F.coalesce(F.when(F.coalesce("status", F.lit("")) != "", F.try_element_at(table, F.col("status"))), F.lit(unknown))


def multiplier(c: Search) -> Column:
    return status_multiplier(c) * F.coalesce("confidence", F.lit(1.0))


def candidates(pages: DataFrame, type: str | None = None, include_sections: bool = False) -> DataFrame:
    """Rows that a search may return: no sections unless wanted, one type if given."""
    kind = F.coalesce("type", F.lit(""))
    if not include_sections:
        pages = pages.filter(kind != "section")
    return pages.filter(kind == type) if type else pages


def _idf(n: Column, df: Column) -> Column:
    return F.log2(1 + (n - df + 0.5) / (df + 0.5))


def _part(tf: Column, length: Column, avg: Column, c: Search) -> Column:
    return tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * length / avg))


def bm25(pages: DataFrame, query: str, c: Search = Search(), per_wiki: bool = False) -> DataFrame:
    """Pages without their bodies, with their bm25 score, from one scan that tokenises each text once.

    The counts of the few query terms are taken within each row and kept in the
    shared folder, as statistics and scores both read them; statistics are one
    row (or one row a wiki), joined back. A repeated query term counts as often.
    """
    times = Counter(X.query_tokens(query))
    if not times:
        return pages.drop("body").withColumn("bm25", F.lit(0.0))
    terms = list(times)
    counted = cut_lineage(_counted(pages, terms))
    stats = (counted.groupBy("wiki") if per_wiki else counted.groupBy()).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), F.array(*[F.count_if(F.col("_tf")[k] > 0) for k in range(len(terms))]).alias("_df")
    )
    # statistics are one row, or one a wiki
    joined = counted.join(stats, "wiki") if per_wiki else counted.crossJoin(F.broadcast(stats))
    parts = [times[t] * _idf(F.col("_n"), F.col("_df")[k]) * _part(F.col("_tf")[k], F.col("_len"), F.col("_avg"), c) for k, t in enumerate(terms)]
    score = sum(parts[1:], parts[0])
    return joined.withColumn("bm25", F.when(F.col("_avg") > 0, score).otherwise(0.0)).drop("_tf", "_len", "_n", "_avg", "_df")


def _counted(pages: DataFrame, terms: list[str]) -> DataFrame:
    """Adds _tf, the weighted count of each term, and _len; the body goes."""
    toks = pages.withColumns({f"_{n}": X.tokens(F.col(n)) for n in X.WEIGHTS}).drop("body")
    # a field of weight w is counted w times, so one array holds the weighted hits of all terms
    weighted = F.concat(*[F.filter(f"_{n}", lambda x: x.isin(terms)) for n, w in X.WEIGHTS.items() for _ in range(w)])
    size = sum((F.size(F.col(f"_{n}")) * w for n, w in X.WEIGHTS.items()), F.lit(0)).cast("long")
    hits = toks.withColumns({"_hits": weighted, "_len": size}).drop(*[f"_{n}" for n in X.WEIGHTS])
    return hits.withColumn("_tf", F.array(*[F.size("_hits") - F.size(F.array_remove("_hits", t)) for t in terms])).drop("_hits")


def bm25_postings(posted: DataFrame, lengths: DataFrame, query: str, c: Search = Search()) -> DataFrame:
    """(wiki, slug, bm25) from persisted postings: the term filter reaches the scan, and only pages with a term are touched."""
    times = Counter(X.query_tokens(query))
    if not times:
        return lengths.select(*KEY, F.lit(0.0).alias("bm25")).limit(0)
    table = F.create_map(*[F.lit(x) for k, v in times.items() for x in (k, v)])
    hit = posted.filter(F.col("term").isin(list(times)))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    # df has a row for each query term, stats is one row
    rows = hit.join(F.broadcast(df), "term").join(lengths.select(*KEY, "len"), KEY).crossJoin(F.broadcast(stats))
    score = F.element_at(table, F.col("term")) * _idf(F.col("n"), F.col("df")) * _part(F.col("tf"), F.col("len"), F.col("avg"), c)
    return rows.groupBy(*KEY).agg(F.sum(score).alias("bm25"))


def batch(posted: DataFrame, terms: DataFrame, corpus: DataFrame, queries: list[str] | DataFrame, c: Search = Search(), k: int | None = None, type: str | None = None, include_sections: bool = False, cut: Callable[[Column], Column] = X.tokens) -> DataFrame:
    """(query_id, rank, wiki, slug, score): the best pages of many queries in one job, from the tables of an index store.

    queries are texts, numbered from 0, or rows of (query_id, query). Only
    postings of their terms are read; what ranking needs of a page stands in the
    posting, so there is no join before the best are known. The statistics are
    those of the whole index.
    """
    k = c.top_k if k is None else k
    if k < 0:
        raise ValueError("top_k must not be negative")
    if isinstance(queries, list):
        every = {t for q in queries for t in X.query_tokens(q)}
        if cut is X.tokens:  # known on the driver: the filter reaches the scan
            posted, terms = (t.filter(F.col("term").isin(sorted(every))) for t in (posted, terms))
        queries = posted.sparkSession.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    asked = queries.select("query_id", F.explode(cut(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weighed = asked.join(terms, "term").crossJoin(F.broadcast(corpus))  # statistics are one row
    hits = candidates(posted, type, include_sections).join(weighed, "term")
    part = F.when(F.col("avg_len") > 0, F.col("times") * _idf(F.col("n"), F.col("df")) * _part(F.col("tf"), F.col("len"), F.col("avg_len"), c)).otherwise(0.0)
    scored = hits.groupBy("query_id", "wiki", "slug").agg(F.sum(part).alias("bm25"), F.first("status").alias("status"), F.first("confidence").alias("confidence"))
    scored = scored.filter("bm25 > 0").select("query_id", "wiki", "slug", (F.col("bm25") * multiplier(c)).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "slug", "wiki"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("score", X.round2(F.col("score")))


def entry(pages: DataFrame, query: str, mode: str = "keyword", provider: Callable[[list[str]], list[list[float]]] | None = None, c: Search = Search(), k: int | None = None, type: str | None = None, include_sections: bool = False) -> DataFrame:
    """Search by keyword, semantic or hybrid; the last two need a provider that embeds the query."""
    if mode == "keyword":
        return keyword(pages, query, c, k, type, include_sections, excerpts=True)
    if mode not in ("semantic", "hybrid"):
        raise ValueError(f"unknown search mode: {mode}")
    if provider is None:
        raise ValueError("semantic search not configured: no embedding provider")
    vector = unit(provider([query])[0])
    if mode == "semantic":
        return semantic(pages, vector, c, k, type)
    return hybrid(pages, query, vector, c, k, c.hybrid_weight, type)


def _top(scored: DataFrame, k: int) -> DataFrame:
    if k < 0:
        raise ValueError("top_k must not be negative")
    return scored.orderBy(F.desc("score"), "slug", "wiki").limit(k)


def _results(top: DataFrame, query: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Hits with rounded score; excerpts are made of the bodies of the few that are left."""
    out = top.withColumns({"_raw": F.col("score"), "score": X.round2(F.col("score"))})
    if query is not None:
        # the keys of the hits, no more than were asked for, go down to the scan
        bodies = pages.select(*KEY, "body").join(F.broadcast(out.select(*KEY)), KEY, "left_semi")
        excerpts = bodies.select(*KEY, X.excerpt_udf(tuple(X.query_tokens(query)))("body").alias("excerpt"))
        out = out.join(excerpts, KEY, "left").orderBy(F.desc("_raw"), "slug", "wiki")
    cols = ["wiki", "slug", "uri", "title", "type", "summary", "score"]
    return out.select(*cols, *(["excerpt"] if query is not None else []))


def keyword(pages: DataFrame, query: str, c: Search = Search(), k: int | None = None, type: str | None = None, include_sections: bool = False, excerpts: bool = False) -> DataFrame:
    """Best pages by BM25 times status and confidence; scores of 0 or less are no hit."""
    scored = candidates(bm25(pages, query, c), type, include_sections).filter("bm25 > 0").withColumn("score", F.col("bm25") * multiplier(c))
    return _results(_top(scored, c.top_k if k is None else k), query if excerpts else None, pages)


def cosine(v: Column, query: list[float]) -> Column:
    """Dot product in double of a unit vector column with a unit query; 0 if the widths differ."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(v) == len(query), dot).otherwise(0.0)


def normalise(v: Column) -> Column:
    """Unit vector as float; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x).cast("float"))


def semantic(pages: DataFrame, vector: list[float], c: Search = Search(), k: int | None = None, type: str | None = None) -> DataFrame:
    """Best pages that have a vector by cosine times status and confidence; negative scores stay."""
    rows = candidates(pages, type).filter(F.col("embedding").isNotNull())
    return _results(_top(rows.withColumn("score", cosine(F.col("embedding"), vector) * multiplier(c)), c.top_k if k is None else k))


def hybrid(pages: DataFrame, query: str, vector: list[float], c: Search = Search(), k: int | None = None, weight: float | None = None, type: str | None = None) -> DataFrame:
    """Weighted sum of cosine and of BM25 over its maximum among the candidates."""
    w = weight if weight and weight > 0 else 0.5
    rows = candidates(bm25(pages, query, c), type)
    best = rows.agg(F.max("bm25").alias("_max"))
    norm = F.when(F.col("_max") > 0, F.col("bm25") / F.col("_max")).otherwise(0.0)
    cos = F.when(F.col("embedding").isNotNull(), F.greatest(cosine(F.col("embedding"), vector), F.lit(0.0))).otherwise(0.0)
    scored = rows.crossJoin(F.broadcast(best)).withColumn("score", (w * cos + (1 - w) * norm) * multiplier(c)).filter("score > 0")
    return _results(_top(scored, c.top_k if k is None else k))


def cross_wiki(pages: DataFrame, query: str, c: Search = Search(), k: int | None = None) -> DataFrame:
    """Best of each wiki by its own statistics, then best of all by rounded score."""
    k = c.top_k if k is None else k
    scored = candidates(bm25(pages, query, c, per_wiki=True)).filter("bm25 > 0").withColumn("score", F.col("bm25") * multiplier(c))
    per = W.partitionBy("wiki").orderBy(F.desc("score"), "slug")
    return _results(scored.withColumn("_r", F.row_number().over(per)).filter(F.col("_r") <= k)).orderBy(F.desc("score"), "slug", "wiki").limit(k)


def facet(pages: DataFrame, name: str) -> DataFrame:
    """(value, n) of a column, empty values left out."""
    return pages.filter(F.coalesce(name, F.lit("")) != "").groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def facet_tags(pages: DataFrame, top: int) -> DataFrame:
    """(value, n) of tags, the most frequent first; repeated tags of a page count, 0 means all."""
    counts = pages.select(F.explode("tags").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(top) if top else counts


def facets_in_one_scan(pages: DataFrame) -> DataFrame:
    """(facet, value, n) of type and status as grouping sets."""
    counted = pages.groupingSets([["type"], ["status"]], "type", "status").agg(F.grouping("type").alias("_g"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("_g") == 0, F.col("type")).otherwise(F.col("status"))
    return counted.select(F.when(F.col("_g") == 0, "type").otherwise("status").alias("facet"), value.alias("value"), "n").filter("coalesce(value, '') != ''")


def merged_tag_facets(pages: DataFrame, top: int) -> DataFrame:
    """(value, n): tags cut to the top of each wiki, summed over wikis, cut again."""
    counts = pages.select("wiki", F.explode("tags").alias("value")).groupBy("wiki", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("wiki").orderBy(F.desc("n"), "value"))
    kept = counts.withColumn("_r", rank).filter(F.col("_r") <= top)
    return kept.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(top)
