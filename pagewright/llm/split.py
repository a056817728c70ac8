"""Splitting oversized texts at natural boundaries.

Boundaries are the ends of paragraphs, headings, lines, sentences, clauses and
words, each with a penalty; those within code fences and tables cost more. A
stretch without a boundary that is longer than a piece may add can be cut at any
grapheme cluster. Dynamic programming over all boundary positions minimises the
sum of cut penalties and of squared imbalance of the pieces, subject to the
maximum length and the overlap. Finer boundaries join in only while they could
still be part of a better solution: one that holds a cut of a class costs at least
its penalty, so a minimum below that over the coarser ones is the minimum over all.

Defined results: a null text gives no piece, an empty text one empty piece. The
limit is in code points. A limit that is missing, null or below 1 means 4000, a
missing, null or negative overlap 0; an overlap of the limit or more is lowered
to half the limit, as the text could not advance otherwise. Every piece after
the first starts exactly ``overlap`` code points before the end of the one
before. A cut falls inside a grapheme cluster only if the cluster alone is
longer than what a piece may add.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import spread

DEFAULT_LIMIT = 4000
# Penalties of a cut, from the best place to the worst.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, GRAPHEME, ANYWHERE = 0.0, 0.15, 0.3, 0.6, 1.2, 4.0, 9.0
IN_BLOCK = 0.8  # added inside a code fence or table
NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", GRAPHEME: "grapheme", ANYWHERE: "forced"}
IMBALANCE = 1.0

_LINES = re.compile(r"(?:\r\n|\r|\n)(?:[ \t]*(?:\r\n|\r|\n))*")
_SENTENCES = re.compile(r"[.!?]+[\"')\]»”’]*[ \t]+|[。！？｡]+[」』”’）]*")
_CLAUSES = re.compile(r"[,;:][ \t]+|[，、；：]")
_WORDS = re.compile(r"[ \t  -  　]+|(?<=[぀-ヿ㐀-鿿])(?=[぀-ヿ㐀-鿿])")
# Code points that continue a grapheme cluster.
_CONTINUES = re.compile("[̀-ͯ҃-֑҇-ֽً-ٟऀ-ःऺ-ॏ᪰-᫿᷀-᷿‌‍⃐-⃿゙゚︀-️︠-︯\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]")
_FENCE = re.compile(r"(?m)^ {0,3}(```+|~~~+)[^\n\r]*")
_BLOCK_LINE = re.compile(r"(?m)^[ \t]*\|[^\n\r]*")


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans of code fences and table rows, within which lines are poor places to cut."""
    spans, opened = [], None
    if "```" in text or "~~~" in text:
        for m in _FENCE.finditer(text):
            if opened is None:
                opened = (m.start(), m[1])
            elif m[1][0] == opened[1][0] and len(m[1]) >= len(opened[1]):
                spans.append((opened[0], m.end()))
                opened = None
        if opened is not None:
            spans.append((opened[0], len(text)))
    if "|" in text:
        for m in _BLOCK_LINE.finditer(text):
            if spans and 0 <= m.start() - spans[-1][1] <= 2:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append((m.start(), m.end()))
    return sorted(spans)


_CROSSED = re.compile("\r(?=\n)|\u200d(?=.)|[\U0001f1e6-\U0001f1ff](?=[\U0001f1e6-\U0001f1ff])", re.S)


def _unsafe(text: str) -> np.ndarray:
    """Sorted places that lie within a grapheme cluster."""
    if text.isascii() and "\r\n" not in text:
        return np.zeros(0, np.int64)
    return np.unique(np.array([m.start() for m in _CONTINUES.finditer(text)] + [m.end() for m in _CROSSED.finditer(text)], np.int64))


def _safe(text: str, at: int) -> bool:
    """Whether no grapheme cluster crosses this place."""
    return at <= 0 or at >= len(text) or at not in _unsafe(text)


class Boundaries:
    """Places of a text where it may be cut, by class, with their penalties."""

    def __init__(self, text: str):
        self.text, self.unsafe = text, _unsafe(text)
        self.known: dict[int, float] = {}
        spans = _blocks(text)
        self.starts, self.ends = [], []
        for start, end in spans:
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)
        for m in _LINES.finditer(text):
            s = m.group()
            self.known[m.end()] = PARAGRAPH if len(s) > 2 or s in ("\n\n", "\r\r") else LINE
        self._add(_SENTENCES, SENTENCE)

    def _add(self, pattern: re.Pattern, penalty: float) -> None:
        for m in pattern.finditer(self.text):
            self.known.setdefault(m.end(), penalty)

    def add(self, penalty: float, step: int) -> None:
        """Takes in the boundaries of a class; GRAPHEME those in stretches that the others leave longer than step."""
        if penalty == CLAUSE:
            self._add(_CLAUSES, CLAUSE)
        elif penalty == WORD:
            self._add(_WORDS, WORD)
        else:
            places, _ = self.places()
            for a in np.flatnonzero(np.diff(places) > step):
                inside = np.arange(places[a] + 1, places[a + 1])
                whole = np.setdiff1d(inside, self.unsafe, assume_unique=True)
                self.known.update(dict.fromkeys(whole.tolist(), GRAPHEME))
                whole = np.concatenate(([places[a]], whole, [places[a + 1]]))
                for b in np.flatnonzero(np.diff(whole) > step):  # a cluster longer than what a piece may add
                    self.known.update(dict.fromkeys(range(int(whole[b]) + 1, int(whole[b + 1])), ANYWHERE))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places with penalties, from 0 to the end. Only ANYWHERE cuts within a grapheme cluster."""
        n = len(self.text)
        at = np.fromiter(self.known, np.int64, len(self.known))
        pens = np.fromiter(self.known.values(), float, len(self.known))
        kept = (at > 0) & (at < n) & ((pens == ANYWHERE) | ~np.isin(at, self.unsafe))
        at, pens = at[kept], pens[kept]
        order = np.argsort(at)
        at, pens = at[order], pens[order]
        if self.starts:
            k = np.searchsorted(self.starts, at) - 1
            pens = pens + IN_BLOCK * ((k >= 0) & (at < np.array(self.ends)[k]))
        return np.concatenate(([0], at, [n])), np.concatenate(([0.0], pens, [0.0]))


EACH = 0.05  # what every piece costs, so that fewer are better


def cheapest(places: np.ndarray, pens: np.ndarray, limit: int, overlap: int, target: float) -> tuple[float, list[int]]:
    """Least cost over all sequences of cuts at the places, and their numbers; infinite if there is none.

    Places are taken in blocks: pieces that begin before a block are weighed for
    all its places at once. Pieces within a block are so short that a bound on
    their imbalance mostly rules them out; where it does not they are weighed too.
    """
    m, step = len(places), limit - overlap
    cost, back = np.full(m, np.inf), np.zeros(m, np.int64)
    cost[0] = 0.0
    lows = np.searchsorted(places, places - step)
    lows[places <= limit] = 0
    scale = IMBALANCE / limit**2
    lead = np.where(np.arange(m) > 0, overlap, 0) - places  # length of a piece from i to j is places[j] + lead[i]
    stops = np.searchsorted(places, places + max(1, step // 6), side="right")
    j = 1
    while j < m:
        stop = min(int(stops[j]), j + 128, m)
        low = min(int(lows[j]), j - 1)
        length = places[j:stop, None] + lead[low:j]
        total = length - target
        total *= total * scale
        total += cost[low:j]
        total[length > limit] = np.inf
        k = total.argmin(axis=1)
        best = total[np.arange(stop - j), k]
        done = best + pens[j:stop] + EACH
        cost[j:stop], back[j:stop] = done, low + k
        span = places[stop - 1] - places[j] + overlap
        least = done.min() + max(0.0, target - span) ** 2 * scale if stop - j > 1 else np.inf
        if (best > least).any():
            for x in range(j + 1, stop):
                length = places[x] + lead[j:x]
                inner = cost[j:x] + np.where(length > limit, np.inf, (length - target) ** 2 * scale)
                y = int(inner.argmin())
                if inner[y] < best[x - j]:
                    cost[x], back[x] = inner[y] + pens[x] + EACH, j + y
        j = stop
    ends, j = [], m - 1
    while j:
        ends.append(j)
        j = int(back[j])
    return float(cost[-1]), ends[::-1]


def effective_overlap(limit: int, overlap: int) -> int:
    return overlap if overlap < limit else limit // 2


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut at the end) of each piece of one text."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    overlap = effective_overlap(limit, overlap)
    step = limit - overlap  # what a piece after the first may add
    least = 1 + max(0, -(-(n - limit) // step))
    target = (n + (least - 1) * overlap) / least  # even length of pieces, overlap included
    boundaries = Boundaries(text)
    for finer in (CLAUSE, WORD, GRAPHEME, None):
        places, pens = boundaries.places()
        cost, ends = cheapest(places, pens, limit, overlap, target)
        # a solution with a finer cut costs its penalty and the number of pieces; past words, only what has to be cut is
        if cost < np.inf and (finer in (GRAPHEME, None) or cost <= finer + EACH * least):
            break
        boundaries.add(finer, step)
    out, start = [], 0
    for j in ends:
        pen = float(pens[j])
        kind = "end" if j == len(places) - 1 else NAMES.get(round(pen, 2)) or "block " + NAMES.get(round(pen - IN_BLOCK, 2), "line")
        out.append((start, int(places[j]), kind))
        start = int(places[j]) - overlap
    return out


CUTS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("boundary", T.StringType())]))


@F.pandas_udf(CUTS)
def _cuts_udf(text: pd.Series, limit: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b, "boundary": k} for a, b, k in cuts(t, int(m), int(o))] for t, m, o in zip(text, limit, overlap)])


# so marked, a filter on the pieces is not pushed below it, where the texts would be cut a second time
cuts_udf = _cuts_udf.asNondeterministic()


def effective(limit: Column, overlap: Column) -> tuple[Column, Column]:
    limit = F.when(limit > 0, limit).otherwise(F.lit(DEFAULT_LIMIT)).cast("int")
    return limit, F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)).cast("int")


def split_oversized(pages: DataFrame, config: DataFrame, with_text: bool = True) -> DataFrame:
    """(rev_id, piece_no, n_pieces, start, stop, boundary[, piece]) of every body; piece_no counts from 1.

    Bodies within their limit pass as one piece without leaving the JVM; only
    oversized ones are shuffled, by id, so that long texts spread evenly.
    config has one row a wiki; repeated rows of a wiki count once.
    """
    per_wiki = config.groupBy("wiki").agg(F.max("max_text_chars").alias("max_text_chars"), F.max("overlap_chars").alias("overlap_chars"))
    limit, overlap = effective(F.col("max_text_chars"), F.col("overlap_chars"))
    # a dimension with a row a wiki; Spark broadcasts it only below autoBroadcastJoinThreshold
    rows = pages.filter(F.col("body").isNotNull()).select("rev_id", "wiki", "body").join(per_wiki, "wiki", "left").select("rev_id", "body", limit.alias("limit"), overlap.alias("overlap"))
    whole = rows.filter(F.length("body") <= F.col("limit"))
    large = spread(rows.filter(F.length("body") > F.col("limit")), "rev_id")
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("body").alias("stop"), F.lit("end").alias("boundary")))
    pieces = whole.select("rev_id", "body", one.alias("cuts")).unionByName(large.select("rev_id", "body", cuts_udf("body", "limit", "overlap").alias("cuts")))
    out = pieces.select("rev_id", *(["body"] if with_text else []), F.size("cuts").alias("n_pieces"), F.posexplode("cuts").alias("at", "c"))
    cols = ["rev_id", (F.col("at") + 1).alias("piece_no"), "n_pieces", "c.start", "c.stop", "c.boundary"]
    if with_text:
        cols.append(F.substring(F.col("body"), F.col("c.start") + 1, F.col("c.stop") - F.col("c.start")).alias("piece"))
    return out.select(*cols)


