"""Evaluation texts that leak into training text.

Texts become streams of folded letters and digits, without case, spaces,
punctuation, Markdown marks and differences of character form. By the q-gram
lemma, a passage that an edit budget has touched still shares a least number of
its q-grams with the item. An edit shifts the rest of a passage by one unit (a
word, or a character of Chinese items), so all of them lie within a few unit
diagonals. Shared q-grams are therefore counted in overlapping diagonal bands,
and only regions that reach the item's bound are kept; an alignment over the
diagonals of the region, widened by the edit budget, then decides exactly.

A document holds an item if n >= 12 successive words of the item (24 characters
of a Chinese one) align with one place of it with at most n / 5 units replaced,
dropped or added. Any such run holds a qualifying one of 12, 15 or 20 words
(24, 25 or 30 characters), so runs up to LONGEST units are enough to look at.

Defined results: null and empty documents and items hold nothing. Items shorter
than the least run cannot leak. Repeated item ids count once for each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalike import _prototype
from pagewright.session import spread

RUN_WORDS, RUN_CHARS, ONE_IN = 12, 24, 5
LONGEST = {False: 20, True: 30}  # longest run that has to be looked at, by whether units are characters
BUDGET = {k: n // ONE_IN for k, n in LONGEST.items()}
Q_WORDS, Q_CHARS = 6, 3  # q of an item, or the largest smaller one that leaves it a bound
BAND = 16  # unit diagonals of a band; half of it is more than any budget
CHUNK_CHARS = 1 << 20
BLOCK_BYTES, BLOCK_ITEMS = 8 << 20, 4000  # items of one gallery
MOST_HITS = 4 << 20  # shared q-grams that are expanded at once; beyond, the items are looked at in halves
PASS_BYTES = 128 << 20  # text of the items whose galleries one pass over the documents holds
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)|<[a-zA-Z/][^<>\n]{0,200}>")
_DROP = set("*_`~'’ʼ´")
SEPARATOR, DROPPED = 0, 1


@cache
def _folding() -> tuple[np.ndarray, re.Pattern]:
    """Code of every BMP character (0: separator, 1: dropped), and the characters that stand for several."""
    table, several = np.zeros(0x10000, np.uint32), []
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        if ch in _DROP:
            table[code] = DROPPED
            continue
        folded = [c for c in _prototype(ch).lower() if not 0x300 <= ord(c) < 0x370]
        if not folded:
            table[code] = DROPPED
        elif len(folded) > 1 and any(c.isalnum() for c in folded):
            several.append(ch)
            table[code] = ord(folded[0])
        elif folded[0].isalnum():
            table[code] = ord(folded[0])
    return table, re.compile("[" + "".join(map(re.escape, several)) + "]")


SEP = "\ue001"  # between the texts of a batch


def _prepared(text: str) -> str:
    if "](" in text or "<" in text:
        text = _LINK.sub("]", text)
    return text.replace(SEP, " ") if SEP in text else text


def _is_han(c: np.ndarray) -> np.ndarray:
    return ((c >= 0x3040) & (c < 0xA000)) | (c >= 0x20000)


@dataclass
class Stream:
    """Letters and digits of a batch of texts without separators: the text and the word that each belongs to, words counted over the batch."""

    chars: np.ndarray
    word: np.ndarray
    text: np.ndarray


def stream(texts: list[str | None]) -> Stream:
    joined = SEP.join(_prepared(t) if t else "" for t in texts)
    table, several = _folding()
    if not joined.isascii() and several.search(joined):
        joined = several.sub(lambda m: _prototype(m[0]), joined)
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    c = table[np.minimum(raw, 0xFFFF)]
    big = raw > 0xFFFF
    if big.any():
        c = np.where(big, np.where((raw >= 0x20000) & (raw < 0x32000), raw, SEPARATOR), c)
    kept = c != DROPPED
    c, text = c[kept], np.cumsum(raw == ord(SEP), dtype=np.int64)[kept]
    solid, han = c != SEPARATOR, _is_han(c)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | han[1:] | han[:-1]
    return Stream(c[solid].astype(np.uint64), (np.cumsum(starts) - 1)[solid], text[solid])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words(chars: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of a stretch."""
    if not len(chars):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(word) != 0)))
    size = np.diff(np.concatenate((starts, [len(chars)])))
    place = (np.arange(len(chars)) - np.repeat(starts, size)).astype(np.uint64)
    return np.add.reduceat(_mixed(chars * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED03)), starts) + size.astype(np.uint64)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram at each place."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(0x100000001B3)
        h += chars[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


@dataclass
class Item:
    id: int
    chars: np.ndarray
    unit_of: np.ndarray  # unit of each character
    units: np.ndarray
    by_char: bool
    q: int
    bound: int


def _bound(lengths: np.ndarray, q: int, least: int) -> int:
    """Fewest q-grams that any run of the item keeps within its edit budget: each edit spoils the grams that touch its unit."""
    total, worst = np.concatenate(([0], np.cumsum(lengths))), 1 << 30
    for n in {least, -(-least // ONE_IN) * ONE_IN, (-(-least // ONE_IN) + 1) * ONE_IN}:
        edits = n // ONE_IN
        for s in range(len(lengths) - n + 1):
            spoiled = np.sort(lengths[s : s + n])[::-1][:edits] + q - 1
            worst = min(worst, int(total[s + n] - total[s] - q + 1 - spoiled.sum()))
    return worst


def make_item(key: int, text: str) -> Item | None:
    s = stream([text])
    if not len(s.chars):
        return None
    by_char = bool(_is_han(s.chars).mean() > 0.3)
    lengths = np.ones(len(s.chars), np.int64) if by_char else np.bincount(s.word)
    least = RUN_CHARS if by_char else RUN_WORDS
    if len(lengths) < least:
        return None
    # with q = 1 only the letters of the edited units are lost, so some q always leaves a bound
    q = next(q for q in range(Q_CHARS if by_char else Q_WORDS, 0, -1) if q == 1 or _bound(lengths, q, least) >= 2)
    unit_of = np.arange(len(s.chars)) if by_char else s.word
    return Item(key, s.chars, unit_of, s.chars if by_char else words(s.chars, s.word), by_char, q, _bound(lengths, q, least))


class Gallery:
    """q-gram index of a bounded block of items."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.longest = max((len(i.units) for i in items), default=0)  # units of the longest item
        self.bounds = np.array([i.bound for i in items])
        self.tables = {kind: self._table(kind) for kind in sorted({(i.by_char, i.q) for i in items})}

    def _table(self, kind: tuple[bool, int]):
        which = [k for k, i in enumerate(self.items) if (i.by_char, i.q) == kind]
        h = [grams(self.items[k].chars, kind[1]) for k in which]
        owner = np.repeat(np.array(which), [len(x) for x in h])
        unit = np.concatenate([self.items[k].unit_of[: len(x)] for k, x in zip(which, h)])
        keys = np.concatenate(h)
        order = np.argsort(keys, kind="stable")
        keys, owner, unit = keys[order], owner[order], unit[order]
        unique, first, count = np.unique(keys, return_index=True, return_counts=True)
        mask = np.zeros(1 << 22, bool)
        mask[(unique >> np.uint64(42)).astype(np.int64)] = True
        return unique, first, count, owner, unit, mask

    @cache
    def halves(self) -> tuple[Gallery, Gallery]:
        """The same items in two galleries, for texts that share very many q-grams with them."""
        middle = len(self.items) // 2
        return Gallery(self.items[:middle]), Gallery(self.items[middle:])

    def regions(self, s: Stream, kind: tuple[bool, int]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, first, last diagonal, first, last unit of the item) of the bands that reach their item's bound.

        A diagonal is the unit of the text, counted over the batch, less the unit of the item.
        """
        by_char, q = kind
        unique, first, count, owner, unit, mask = self.tables[kind]
        h = grams(s.chars, q)
        at = np.flatnonzero(mask[(h >> np.uint64(42)).astype(np.int64)])
        at = at[s.text[at] == s.text[at + q - 1]]
        if not len(at):
            return
        k = np.minimum(np.searchsorted(unique, h[at]), len(unique) - 1)
        hit = unique[k] == h[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return
        n = count[k]
        if n.sum() > MOST_HITS and len(self.items) > 1:
            for half, base in zip(self.halves(), (0, len(self.items) // 2)):
                if kind in half.tables:
                    for text, item, *rest in half.regions(s, kind):
                        yield text, item + base, *rest
            return
        row = np.repeat(np.arange(len(at)), n)
        slot = first[k][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        # texts lie so far apart that no band holds diagonals of two of them
        where = (at if by_char else s.word[at]) + s.text[at] * (self.longest + 2 * BAND)
        there, item = unit[slot], owner[slot]
        diagonal = where[row] - there + self.longest
        for shift in (0, BAND // 2):  # bands overlap by half
            keys = (diagonal + shift) // BAND * (BLOCK_ITEMS + 1) + item
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.concatenate((cut, [len(keys)])))
            for c in np.flatnonzero(size >= self.bounds[keys[cut] % (BLOCK_ITEMS + 1)]):
                rows = order[cut[c] : cut[c] + size[c]]
                text = int(s.text[at[row[rows[0]]]])
                d, u = diagonal[rows] - self.longest - text * (self.longest + 2 * BAND), there[rows]
                yield text, int(item[rows[0]]), int(d.min()), int(d.max()), int(u.min()), int(u.max())


def aligned(item: Item, text: np.ndarray, first: int, last: int, low: int, high: int) -> bool:
    """Whether a run of the item that holds one of its units low to high aligns with the text on the diagonals first to last, widened by the budget."""
    longest, budget, least = LONGEST[item.by_char], BUDGET[item.by_char], RUN_CHARS if item.by_char else RUN_WORDS
    start, stop = max(0, low - longest + 1), min(high, len(item.units) - least)
    if start > stop:
        return False
    runs = stop - start + 1
    unit = np.arange(start, min(len(item.units), stop + longest))
    diagonal = np.arange(first - budget, last + budget + 1)
    place = unit[:, None] + diagonal
    differs = ((place < 0) | (place >= len(text)) | (text[np.clip(place, 0, len(text) - 1)] != item.units[unit][:, None])).astype(np.int16)
    col = np.arange(len(diagonal), dtype=np.int16)
    # row r is the run that begins at unit start + r; the text may begin on any diagonal of the band
    d = np.zeros((runs, len(diagonal)), np.int16)
    for i in range(longest):
        alive = min(runs, len(unit) - i)
        if alive <= 0:
            return False
        d = d[:alive]
        step = d + differs[i : i + alive]
        np.minimum(step[:, :-1], d[:, 1:] + 1, out=step[:, :-1])
        step -= col
        np.minimum.accumulate(step, axis=1, out=step)
        step += col
        d = step
        least_edits = d.min()
        if i + 1 >= least and least_edits <= (i + 1) // ONE_IN:
            return True
        if least_edits > budget:
            return False
    return False


def leaks(texts: list[str | None], galleries: list[Gallery]) -> list[list[int]]:
    """Ids of the items that each text holds."""
    out: list[list[int]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
            size += len(texts[hi] or "")
            hi += 1
        out += _leaks_of(texts[lo:hi], galleries)
        lo = hi
    return out


def _leaks_of(texts: list[str | None], galleries: list[Gallery]) -> list[list[int]]:
    s = stream(texts)
    found: list[dict[int, None]] = [{} for _ in texts]
    ends = np.searchsorted(s.text, np.arange(len(texts) + 1))
    first_word: dict[int, np.ndarray] = {}
    for gallery in galleries:
        for kind in gallery.tables:
            seen: set[tuple] = set()
            for text, k, first, last, low, high in gallery.regions(s, kind):
                item = gallery.items[k]
                if item.id in found[text] or (text, k, first, last, low, high) in seen:
                    continue
                seen.add((text, k, first, last, low, high))
                a, b = ends[text], ends[text + 1]
                if kind[0]:
                    units, before = s.chars[a:b], int(a)
                else:
                    if text not in first_word:
                        first_word[text] = words(s.chars[a:b], s.word[a:b])
                    units, before = first_word[text], int(s.word[a])
                if aligned(item, units, first - before, last - before, low, high):
                    found[text][item.id] = None
    return [list(f) for f in found]


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents against all items, which are a query set.

    Items come in blocks of bounded size, each a gallery; one pass over the
    documents holds the galleries of PASS_BYTES of item text, so a larger query
    set takes more passes, and no executor holds more than those of a pass.
    """
    spark = documents.sparkSession
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(total[0] or 0) // BLOCK_BYTES), -(-total[1] // (BLOCK_ITEMS // 2)))
    docs = spread(documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text"), "doc_id")
    passes, made, held = [], [], 0
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # one bounded block of the query set
        for at in range(0, max(1, len(rows)), BLOCK_ITEMS):
            gallery = Gallery([m for m in (make_item(r.item_id, r.text) for r in rows[at : at + BLOCK_ITEMS]) if m])
            made.append(spark.sparkContext.broadcast(gallery))
        held += sum(len(r.text) for r in rows)
        if held >= PASS_BYTES:
            passes, made, held = [*passes, made], [], 0
    parts = [docs.mapInArrow(_runner(galleries), "doc_id long, item_id long") for galleries in [*passes, made] if galleries]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _runner(galleries: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            text = batch.column(1)
            for lo in range(0, len(ids), 1000):
                found = leaks(text.slice(lo, 1000).to_pylist(), [g.value for g in galleries])
                pairs = [(d, i) for d, its in zip(ids[lo : lo + 1000], found) for i in its]
                if pairs:
                    a, b = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "item_id"])

    return run
