"""Related pages of every page at once, by shared tags, two hops, similar text and community.

The strategies run for a whole set of pages in one plan each, so a batch of
suggestions costs a few joins and not a search a page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.config import LINK_FIELDS, SOURCE_TYPES, Config, Search
from pagewright.functions import text as X
from pagewright.operators import index as I
from pagewright.operators import search as S
from pagewright.session import cut_lineage, number_rows

OUT = ["wiki", "slug", "other", "score", "reason"]


def linked(pages: DataFrame) -> DataFrame:
    """(wiki, slug, other): pages that a page refers to already, itself included."""
    empty = F.array().cast("array<string>")
    field = lambda n: F.coalesce(F.try_element_at(F.col("fields"), F.lit(n)), empty)
    every = F.concat(F.array("slug"), F.coalesce("body_links", empty), *[field(n) for n in LINK_FIELDS])
    return pages.select("wiki", "slug", F.explode(F.array_distinct(every)).alias("other")).filter("other is not null")


def _tagged(pages: DataFrame) -> DataFrame:
    """(wiki, slug, tags, n): the tag set of each page that has one, and how many tags it gives."""
    rows = pages.select("wiki", "slug", F.array_sort(F.array_distinct("tags")).alias("tags"), F.greatest(F.size("tags"), F.lit(1)).alias("n"))
    return rows.filter(F.size("tags") > 0)


def _set_pairs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(wiki, tags, their_tags, n, shared): distinct tag sets that meet. Pages of a hot tag are pre-aggregated to their sets."""
    a = mine.select("wiki", "tags").distinct().withColumn("tag", F.explode("tags"))
    b = theirs.select("wiki", F.col("tags").alias("their_tags"), "n").distinct().withColumn("tag", F.explode("their_tags"))
    return a.join(b, ["wiki", "tag"]).groupBy("wiki", "tags", "their_tags", "n").agg(F.count(F.lit(1)).alias("shared"))


def by_tags(pages: DataFrame, of: DataFrame) -> DataFrame:
    """Pages that share tags with the asked ones: shared tags over the tags of the candidate.

    Pairs are counted once for two tag sets and then go to the pages of both.
    """
    mine, theirs = _tagged(of).drop("n"), _tagged(pages)
    others = theirs.select("wiki", F.col("slug").alias("other"), F.col("tags").alias("their_tags"), "n")
    pairs = mine.join(_set_pairs(mine, theirs), ["wiki", "tags"]).join(others, ["wiki", "their_tags", "n"]).filter("slug != other")
    return pairs.select("wiki", "slug", "other", (F.col("shared") / F.col("n")).alias("score"), F.lit("shares tags").alias("reason"))


def best_by_tags(pages: DataFrame, of: DataFrame, c: Config = Config()) -> DataFrame:
    """The rows of by_tags() that merge() can keep: for each page as many of the best as its limit and its links together.

    The best are ranked once for each tag set, so no pair of pages is made beyond them.
    """
    room = linked(of).groupBy("wiki", "slug").agg((F.count(F.lit(1)) + c.suggest.default_limit).alias("room"))
    mine, theirs = _tagged(of).drop("n").join(room, ["wiki", "slug"]), _tagged(pages)
    most = mine.groupBy("wiki", "tags").agg(F.max("room").alias("most"))
    sizes = theirs.groupBy("wiki", F.col("tags").alias("their_tags"), "n").agg(F.count(F.lit(1)).alias("size"))
    scored = _set_pairs(mine, theirs).withColumn("score", F.col("shared") / F.col("n")).filter(F.col("score") >= c.suggest.min_score).withColumn("s", X.round2(F.col("score")))
    by_score = scored.join(sizes, ["wiki", "their_tags", "n"]).join(most, ["wiki", "tags"])
    better = W.partitionBy("wiki", "tags").orderBy(F.desc("s"))
    ahead = F.sum("size").over(better.rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("size").over(W.partitionBy("wiki", "tags", "s"))
    kept = by_score.withColumn("ahead", ahead).filter("ahead < most").drop("ahead", "size")
    widest = most.groupBy("wiki").agg(F.max("most").alias("widest"))
    first = F.row_number().over(W.partitionBy("wiki", "their_tags", "n").orderBy("other"))
    others = theirs.select("wiki", F.col("slug").alias("other"), F.col("tags").alias("their_tags"), "n").withColumn("_r", first).join(widest, "wiki").filter("_r <= widest").drop("_r", "widest")
    place = F.row_number().over(W.partitionBy("wiki", "tags").orderBy(F.desc("s"), "other"))
    best = kept.join(others, ["wiki", "their_tags", "n"]).withColumn("_r", place).filter("_r <= most").select("wiki", "tags", "other", "score", "_r")
    rows = mine.join(best, ["wiki", "tags"]).filter("_r <= room and slug != other")
    return rows.select("wiki", "slug", "other", "score", F.lit("shares tags").alias("reason"))


def by_two_hops(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Nodes two steps away that are not one step away."""
    both = edges.select("wiki", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("wiki", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    one = both.join(of.select("wiki", F.col("slug").alias("a")), ["wiki", "a"], "left_semi").select("wiki", F.col("a").alias("slug"), F.col("b").alias("other"))
    two = one.withColumnRenamed("other", "a").join(both, ["wiki", "a"]).select("wiki", "slug", F.col("b").alias("other"), F.col("a").alias("via")).filter("slug != other")
    least = two.groupBy("wiki", "slug", "other").agg(F.min("via").alias("via")).join(one, ["wiki", "slug", "other"], "left_anti")
    return least.select("wiki", "slug", "other", F.lit(0.5).alias("score"), F.concat(F.lit("2 hops via "), "via").alias("reason"))


def best_two_hops(edges: DataFrame, of: DataFrame, limit: int) -> DataFrame:
    """The rows of by_two_hops() that merge() can keep: for each page the first by slug, as many as the limit and what its links take away.

    A page takes as many of the first neighbours of each of its neighbours, so a
    hub does not meet all pairs of its pages. Neighbours are numbered over
    ranges, and steps are joined by neighbour and number. Nodes are numbers in
    their order until the end, as there are many more steps than rows to keep.
    """
    named = edges.select("wiki", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select("wiki", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    ends = named.select("wiki", F.col("a").alias("slug"), F.lit(0).alias("_all")).distinct()
    ids = cut_lineage(number_rows(ends, "_all", [F.asc("wiki"), F.asc("slug")], "id").select("wiki", "slug", "id"))
    end = lambda name: ids.select("wiki", F.col("slug").alias(name), F.col("id").alias(f"_{name}"))
    both = cut_lineage(named.join(end("a"), ["wiki", "a"]).join(end("b"), ["wiki", "b"]).select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    numbered = number_rows(both, "a", [F.asc("b")]).select(F.col("a").alias("via"), F.col("b").alias("other"), F.col("place").alias("n"))
    degree = both.groupBy(F.col("a").alias("slug")).agg(F.count(F.lit(1)).alias("degree"))
    gone = linked(of).groupBy("wiki", "slug").agg(F.count(F.lit(1)).alias("gone")).join(ids, ["wiki", "slug"]).select(F.col("id").alias("slug"), "gone")
    room = gone.join(degree, "slug").select("slug", (F.col("gone") + F.col("degree") + limit).alias("room"))
    one = both.select(F.col("a").alias("slug"), F.col("b").alias("via")).join(room, "slug")
    steps = one.join(degree.select(F.col("slug").alias("via"), "degree"), "via").select("slug", "via", F.explode(F.sequence(F.lit(1), F.least("room", "degree").cast("int"))).alias("n"))
    two = steps.join(numbered, ["via", "n"]).filter("slug != other").groupBy("slug", "other").agg(F.min("via").alias("via"))
    far = two.join(one.select("slug", F.col("via").alias("other")), ["slug", "other"], "left_anti").join(gone, "slug")
    # so many are among the first of every neighbour that has them, so the neighbour named is the first of all
    first = far.withColumn("_r", F.row_number().over(W.partitionBy("slug").orderBy("other"))).filter(F.col("_r") <= F.col("gone") + limit).select("slug", "other", "via")
    name = lambda of_id: ids.select(F.col("id").alias(of_id), F.col("slug").alias(f"_{of_id}"))
    rows = first.join(name("other"), "other").join(name("via"), "via").join(ids.select("wiki", F.col("id").alias("slug"), F.col("slug").alias("_slug")), "slug")
    return rows.select("wiki", F.col("_slug").alias("slug"), F.col("_other").alias("other"), F.lit(0.5).alias("score"), F.concat(F.lit("2 hops via "), "_via").alias("reason"))


def by_text(pages: DataFrame, title: str, summary: str, slug: str, wiki: str, c: Search = Search()) -> DataFrame:
    """BM25 of a page's title and summary against its wiki: 0.7 of the share of the best score."""
    hits = S.keyword(pages.filter(F.col("wiki") == wiki), f"{title} {summary}".strip(), c, k=10)
    best = hits.agg(F.greatest(F.max("score"), F.lit(0.001)).alias("_best"))
    rows = hits.crossJoin(F.broadcast(best)).filter(F.col("slug") != slug)
    return rows.select("wiki", F.lit(slug).alias("slug"), F.col("slug").alias("other"), (F.col("score") / F.col("_best") * 0.7).alias("score"), F.lit("similar content").alias("reason"))


TEXT = "wiki string, slug string, other string, score double"


def _best_of_block(k: int, c: Search):
    """The best k documents of a block for each query of a block, by BM25 times the multiplier, ties to the smaller slug."""

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        if not asked.num_rows or not docs.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.string()) for n in ("wiki", "slug", "other", "score")})
        asked, docs = asked.combine_chunks(), docs.sort_by("slug").combine_chunks()
        terms = [pa.chunked_array([x]) if not isinstance(x, pa.ChunkedArray) else x for x in (pc.list_flatten(asked["terms"]), pc.list_flatten(docs["terms"]))]
        code = pa.concat_arrays([x.cast(pa.string()) for t in terms for x in t.chunks]).dictionary_encode().indices.to_numpy()
        of_query, of_doc = code[: len(terms[0])], code[len(terms[0]) :]
        at = np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs["terms"]).to_numpy())
        tf, norm = pc.list_flatten(docs["tfs"]).to_numpy().astype(np.float64), docs["norm"].to_numpy()
        value = tf * (c.k1 + 1) / (tf + norm[at])
        order = np.argsort(of_doc, kind="stable")
        at, value = at[order], value[order]
        lo, hi = np.searchsorted(of_doc[order], of_query), np.searchsorted(of_doc[order], of_query, side="right")
        weight, ends = pc.list_flatten(asked["weights"]).to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(asked["terms"]).to_numpy())))
        factor, n = docs["factor"].to_numpy(), docs.num_rows
        who, what, scores = [], [], []
        for q in range(asked.num_rows):
            spans = [(lo[j], hi[j], weight[j]) for j in range(ends[q], ends[q + 1]) if lo[j] < hi[j]]
            if not spans:
                continue
            # terms come in one order, so equal documents of different blocks get equal sums
            total = np.bincount(np.concatenate([at[a:b] for a, b, _ in spans]), np.concatenate([value[a:b] * w for a, b, w in spans]), minlength=n)
            hit = np.flatnonzero(total > 0)
            score = total[hit] * factor[hit]
            if len(hit) > k:
                some = np.flatnonzero(score >= np.partition(score, len(hit) - k)[len(hit) - k])
                hit, score = hit[some], score[some]
            best = np.argsort(-score, kind="stable")[:k]
            who.append(np.full(len(best), q))
            what.append(hit[best])
            scores.append(score[best])
        if not who:
            return run(asked.slice(0, 0), docs)
        q, d = pa.array(np.concatenate(who)), pa.array(np.concatenate(what))
        return pa.table({"wiki": asked["wiki"].take(q), "slug": asked["slug"].take(q), "other": docs["slug"].take(d), "score": pa.array(np.concatenate(scores))})

    return run


def terms_of(pages: DataFrame) -> DataFrame:
    """(wiki, slug, terms, tfs, len): the postings of each page that has any, in one row, and the sum of their counts, which is its length."""
    of = I.postings(pages).groupBy("wiki", "slug").agg(F.collect_list(F.struct("term", "tf")).alias("x"), F.sum("tf").alias("len"))
    return of.select("wiki", "slug", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"), "len")


def best_matches(pages: DataFrame, words: DataFrame, c: Search = Search(), k: int = 10, block: int = 4096, held: DataFrame | None = None) -> DataFrame:
    """(wiki, slug, other, score): the best k pages of the wiki for each query, by BM25 times the multiplier, scores rounded; words are rows of (wiki, slug, term, times), slug being any name of a query.

    Each wiki is a grid of query blocks and document blocks, and every pair is
    scored. Statistics are those of the whole wiki. Only the best k of a query
    leave a block. ``held`` is terms_of() the pages where it is kept already; else
    it is kept here, as three steps read it.
    """
    held = cut_lineage(terms_of(pages)) if held is None else held
    length = F.coalesce("len", F.lit(0))
    stats = pages.select("wiki", "slug").join(held.select("wiki", "slug", "len"), ["wiki", "slug"], "left").groupBy("wiki").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(length).alias("avg_len"))
    stats = stats.withColumn("grid", F.ceil(F.col("n_docs") / block).cast("int"))
    part = F.pmod(F.xxhash64("slug"), F.col("grid")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("grid") - 1))
    norm = c.k1 * (1 - c.b + c.b * F.col("len") / F.col("avg_len"))
    sized = S.candidates(pages).select("wiki", "slug", S.multiplier(c).alias("factor")).join(stats, "wiki").join(held, ["wiki", "slug"])
    docs = sized.select("wiki", every.alias("q_block"), part.alias("d_block"), "slug", "factor", norm.alias("norm"), "terms", "tfs")
    bag = held.select("wiki", F.explode("terms").alias("term"))
    weighed = words.join(I.term_stats(bag, per_wiki=True), ["wiki", "term"]).join(stats, "wiki").withColumn("weight", F.col("times") * S._idf(F.col("n_docs"), F.col("df")))
    sought = weighed.groupBy("wiki", "slug", "grid").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("x"))
    # aliases, as both sides of the cogroup may come from the same pages
    asked = sought.select(F.col("wiki").alias("wiki"), part.alias("q_block"), every.alias("d_block"), F.col("slug").alias("slug"), F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    keys = ["wiki", "q_block", "d_block"]
    found = asked.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInArrow(_best_of_block(k, c), TEXT)
    rank = F.row_number().over(W.partitionBy("wiki", "slug").orderBy(F.desc("score"), "other"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r").withColumn("score", X.round2(F.col("score")))


def by_texts(pages: DataFrame, of: DataFrame, c: Search = Search(), k: int = 10, block: int = 4096, held: DataFrame | None = None) -> DataFrame:
    """by_text() of all asked pages at once."""
    words = of.select("wiki", "slug", F.explode(F.concat(X.tokens(F.col("title")), X.tokens(F.col("summary")))).alias("term")).groupBy("wiki", "slug", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = best_matches(pages, words, c, k, block, held)
    best = F.greatest(F.max("score").over(W.partitionBy("wiki", "slug")), F.lit(0.001))
    return hits.withColumn("_best", best).filter("slug != other").select("wiki", "slug", "other", (F.col("score") / F.col("_best") * 0.7).alias("score"), F.lit("similar content").alias("reason"))


def by_tag_search(pages: DataFrame, of: DataFrame, c: Search = Search(), k: int = 20, held: DataFrame | None = None) -> DataFrame:
    """Pages that a search for the text of one of the page's tags finds and that share a tag with it: shared tags over the tags of the candidate.

    A tag is searched for once a wiki, whatever the number of pages that have it.
    """
    tagged = of.filter(F.size("tags") > 0).select("wiki", "slug", "tags", F.explode(F.array_distinct("tags")).alias("tag"))
    words = tagged.select("wiki", F.col("tag").alias("slug")).distinct().select("wiki", "slug", F.explode(X.tokens(F.col("slug"))).alias("term")).groupBy("wiki", "slug", "term").agg(F.count(F.lit(1)).alias("times"))
    hits = best_matches(pages, words, c, k, held=held).select("wiki", F.col("slug").alias("tag"), "other")
    theirs = pages.select("wiki", F.col("slug").alias("other"), F.col("tags").alias("their_tags"))
    found = hits.join(theirs, ["wiki", "other"]).filter(F.size("their_tags") > 0)
    # a hit of several tags of a page counts once
    pairs = tagged.join(found, ["wiki", "tag"]).filter("slug != other").select("wiki", "slug", "other", "tags", "their_tags").distinct()
    shared = F.size(F.filter("tags", lambda t: F.array_contains(F.col("their_tags"), t)))
    reason = F.concat(F.lit("shares tags: "), F.array_join("tags", ", "))
    return pairs.select("wiki", "slug", "other", (shared / F.greatest(F.size("their_tags"), F.lit(1))).alias("score"), reason.alias("reason")).filter("score > 0")


def by_community(found: DataFrame, of: DataFrame, taken: DataFrame, limit: int = 2, tags_taken: bool = True) -> DataFrame:
    """The first pages by slug of the same community that are not taken yet; tags_taken if every page that shares a tag is a candidate already.

    The members of a community are one sorted array, so no pair of its pages is made.
    """
    member = found.filter("community is not null").join(of.select("wiki", "slug", "tags"), ["wiki", "slug"], "left")
    peers = member.groupBy("wiki", "community").agg(F.array_sort(F.collect_list(F.struct("slug", "tags"))).alias("peers"))
    gone = taken.groupBy("wiki", "slug").agg(F.collect_set("other").alias("gone"))
    mine = of.select("wiki", "slug", "tags").join(found.filter("community is not null"), ["wiki", "slug"]).join(gone, ["wiki", "slug"], "left").join(peers, ["wiki", "community"])
    apart = F.filter("peers", lambda x: (x["slug"] != F.col("slug")) & ~(F.lit(tags_taken) & F.coalesce(F.arrays_overlap(x["tags"], F.col("tags")), F.lit(False))))
    free = F.array_except(F.transform(apart, lambda x: x["slug"]), F.coalesce("gone", F.array().cast("array<string>")))
    return mine.select("wiki", "slug", F.explode(F.slice(free, 1, limit)).alias("other"), F.lit(0.4).alias("score"), F.lit("same knowledge cluster").alias("reason"))


def merge(pages: DataFrame, parts: list[DataFrame], c: Config = Config()) -> DataFrame:
    """Best score of each candidate, first strategy on a tie, without what is linked already; the best few of each page."""
    rows = parts[0].withColumn("_s", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("_s", F.lit(k)))
    best = rows.groupBy("wiki", "slug", "other").agg(F.max_by(F.struct("score", "reason"), F.struct("score", -F.col("_s"))).alias("b")).select("wiki", "slug", "other", "b.score", "b.reason")
    free = best.filter(F.col("score") >= c.suggest.min_score).join(linked(pages), ["wiki", "slug", "other"], "left_anti")
    about = pages.select("wiki", F.col("slug").alias("other"), F.col("title").alias("other_title"), F.col("type").alias("other_type"))
    named = free.join(about, ["wiki", "other"]).withColumn("score", X.round2(F.col("score")))
    rank = F.row_number().over(W.partitionBy("wiki", "slug").orderBy(F.desc("score"), "other"))
    return named.withColumn("place", rank).filter(F.col("place") <= c.suggest.default_limit)


def link_field(suggested: DataFrame, pages: DataFrame, decls: DataFrame) -> DataFrame:
    """Adds the field to record a suggestion in: the first declared one, by name, that allows the type, or for two source types the first of all; else a wikilink."""
    kinds = decls.select(F.col("type").alias("_t"), "field", "target_types").distinct().groupBy("_t").agg(F.array_sort(F.collect_list(F.struct("field", "target_types"))).alias("decls"))
    own = suggested.join(pages.select("wiki", "slug", F.col("type").alias("_t")), ["wiki", "slug"]).join(kinds, "_t", "left")
    source = lambda x: F.coalesce(x.isin(*SOURCE_TYPES), F.lit(False))
    fits = F.filter("decls", lambda d: F.coalesce(F.array_contains(d["target_types"], F.col("other_type")), F.lit(False)) | (source(F.col("_t")) & source(F.col("other_type"))))
    return own.withColumn("field", F.coalesce(F.get(fits, F.lit(0))["field"], F.lit("[[wikilink]]"))).drop("_t", "decls")


def as_uri(wiki: Column, slug: Column) -> Column:
    return F.concat(F.lit("wiki://"), wiki, F.lit("/"), slug)
