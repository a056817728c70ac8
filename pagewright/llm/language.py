"""Missing or wrong language labels: a language for each document and each segment of a mixed one.

Cross-parsing entropy: the labelled samples of each language make a suffix
automaton. A sentence is parsed against each, greedily taking the longest match
as one phrase; the language that needs the fewest phrases for its length wins.
Parsing runs over thousands of sentences at once, one character a step. Over
the sentences of a document the cheapest path with a price on each change of
language gives its segments.

Prose is what stays without front matter, code, tables, headings, links'
targets and short quoted phrases (up to 40 characters without the end of a
sentence, 16 of Chinese or Japanese); items of lists and quoted blocks are prose.

Defined results: a null or empty text, or one without prose, has no segment and
a null language; rows without doc_id take no part, and rows that repeat a doc_id
count as one document. Confidence lies in (0, 1]. Ties go to the first language in
alphabetical order. Labels are compared after case, spelling and region.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import spread

# Usual names of the nine languages.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglês engels английский 英语 英文 英語",
    "zh": "zh zho chi cmn yue chinese mandarin chinois chinesisch chino chinês chinees китайский 中文 汉语 漢語 华语 普通话 中国語 hans hant",
    "de": "de deu ger german allemand deutsch alemán aleman alemão duits немецкий 德语 德文 ドイツ語",
    "fr": "fr fra fre french français francais französisch francés frances francês frans французский 法语 法文 フランス語",
    "es": "es spa spanish castilian espagnol spanisch español espanol castellano espanhol spaans испанский 西班牙语 西班牙文 スペイン語",
    "pt": "pt por portuguese portugais portugiesisch portugués português portugues portugees португальский 葡萄牙语 葡萄牙文 ポルトガル語",
    "nl": "nl nld dut dutch flemish néerlandais niederländisch neerlandés holandês nederlands vlaams нидерландский голландский 荷兰语 荷兰文 オランダ語",
    "ja": "ja jpn jp japanese japonais japanisch japonés japonês japans японский 日语 日文 日本語",
    "ru": "ru rus russian russe russisch ruso russo русский 俄语 俄文 ロシア語",
}
LANGUAGES = tuple(sorted(NAMES))
_BY_NAME = {name: lang for lang, names in NAMES.items() for name in names.split()}
SWITCH = 3.0  # phrases that a change of language costs
SAMPLE_CHARS = 200_000  # documented bound of labelled text for each language
FEW = 12  # sentences; so few long ones are parsed one by one


def label_language(label: str | None) -> str | None:
    """The language that a label names, whatever its case, spelling or region; null if it names none of the nine."""
    if not label:
        return None
    parts = re.split(r"[-_ .,;:/()\[\]]+", unicodedata.normalize("NFKC", label).strip().lower())
    parts = [p for p in parts if p]
    return _BY_NAME.get(parts[0]) if parts else None


# --- prose ------------------------------------------------------------------------------------

_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_TABLE = re.compile(r"\s*\||.*\|.*\|")
_YAML = re.compile(r"\s*$|\s*#|\s+\S|-\s|[^\s:][^:]*:(?:\s|$)")
_RULE = re.compile(r"\s*(?:[-=*_]\s*){3,}$")
_MARK = re.compile(r"\s*(?:>\s*)*(?:(?:[-*+•]|\d{1,3}[.)])\s+)?(?:\[[ xX]\]\s+)?")
_ITEM = re.compile(r"\s*(?:>\s*)*(?:[-*+•]|\d{1,3}[.)])\s+")
_INLINE = re.compile(r"`[^`]*`|!?\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)|\]\([^)]*\)|https?://\S+|\S+@\S+|<[^<>]{1,80}>|[*_~\[\]]+")
_QUOTED = re.compile(r"“[^”.!?。！？]{1,40}”|«[^».!?]{1,40}»|„[^“.!?]{1,40}“|\"[^\".!?。！？]{1,40}\"|「[^」。]{1,16}」|『[^』。]{1,16}』|“[^”。]{1,16}”")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[.!?…][\"”’»)])\s+|(?<=[。！？])[”’」』）]*\s*")


def prose(text: str) -> list[str]:
    """Paragraphs of running text, markup removed."""
    lines = text.split("\n") if "\r" not in text else re.split(r"\r\n|\r|\n", text)
    start = 0
    if lines and lines[0].strip().lstrip("﻿") == "---":
        for k in range(1, len(lines)):
            if lines[k].strip() in ("---", "..."):
                start = k + 1
                break
            if not _YAML.match(lines[k]):
                break
    out: list[str] = []
    para: list[str] = []
    fence, quoted = None, False

    def close() -> None:
        if para:
            out.append(" ".join(para))
            para.clear()

    for line in lines[start:]:
        m = _FENCE.match(line)
        if fence is not None:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
            continue
        if m:
            close()
            fence = m[1]
            continue
        bare = line.strip()
        if not bare:
            close()
            continue
        if bare[0] == "#" or "|" in bare and _TABLE.match(bare) or _RULE.match(bare) or (line.startswith(("    ", "\t")) and not para and not _ITEM.match(line)):
            close()
            continue
        if _ITEM.match(line) or (bare[0] == ">") != quoted:
            close()
        quoted = bare[0] == ">"
        body = line[_MARK.match(line).end() :].strip()
        if body.startswith("#"):
            close()
            continue
        if body:
            para.append(body)
    close()
    return out


def pieces(text: str) -> list[str]:
    """The prose of a text cut at the ends of sentences."""
    out = []
    for p in prose(text):
        if "`" in p or "[" in p or "*" in p or "_" in p or "<" in p or "@" in p or "://" in p or "~" in p:
            p = _INLINE.sub(" ", p)
        if "“" in p or '"' in p or "«" in p or "「" in p or "『" in p or "„" in p:
            p = _QUOTED.sub(" ", p)
        out += [s for s in _SPLIT.split(p) if len(s) >= 4]
    return out


SEP = "\ue001"


@cache
def _letters() -> np.ndarray:
    """Of each BMP character, whether it is a letter."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x10000)])


class Batch:
    """Pieces of text as one array of lower-case letters, one space for all that lies between words and one at the end of a piece."""

    def __init__(self, texts: list[str]):
        joined = SEP.join(t.replace(SEP, " ") if SEP in t else t for t in texts) + SEP
        if not joined.isascii() and not unicodedata.is_normalized("NFKC", joined):
            joined = unicodedata.normalize("NFKC", joined)
        raw = np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[np.minimum(raw, 0xFFFF)] & (raw < 0x20000) | (raw >= 0x20000) & (raw < 0x32400)
        ends = raw == ord(SEP)
        after = np.concatenate(([False], letter[:-1]))
        kept = letter | after
        piece = (np.cumsum(ends) - ends)[kept]
        self.text = np.where(letter, np.minimum(raw, 0xFFFF), 32)[kept]
        n = len(texts)
        self.size = np.bincount(piece, minlength=n)
        self.begin = np.cumsum(self.size) - self.size
        self.words = np.bincount(piece[self.text == 32], minlength=n)
        wide = (self.text >= 0x3040) & (self.text < 0xA000)
        self.wide = np.bincount(piece[wide], minlength=n)
        self.cyrillic = np.bincount(piece[(self.text >= 0x400) & (self.text < 0x530)], minlength=n)
        self.latin = np.bincount(piece[(self.text >= 0x41) & (self.text < 0x250)], minlength=n)

    def whole(self) -> np.ndarray:
        """Of each piece, whether it is a sentence: five wide characters, or three words with ten letters."""
        return (self.wide >= 5) | (self.words >= 3) & (self.size - self.words >= 10)


def sentences(text: str) -> list[str]:
    """Whole sentences of the prose of a text; single words are none."""
    some = pieces(text)
    return [s for s, ok in zip(some, Batch(some).whole()) if ok] if some else []


# --- model ------------------------------------------------------------------------------------


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class DoubleArray:
    """Transitions of an automaton in two arrays: that of state s over code c lies at base[s] + c if owner there is s."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        size = sum(len(m) for m in moves) + 2 * width + 2
        self.base, owner, target = np.zeros(len(moves), np.int32), [-1] * size, [0] * size
        low, self.last = width + 1, 0  # places from width + 1 to low are taken, none beyond last
        roomy = low  # before it, states of several transitions seldom find room
        # the states with most transitions first, while there is room for them
        for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
            codes = sorted(moves[s])
            if not codes:
                continue
            while owner[low] >= 0:
                low += 1
            at, tries = (low if len(codes) == 1 else max(low, roomy)) - codes[0], 0
            while any(owner[at + c] >= 0 for c in codes):
                at, tries = at + 1, tries + 1
                if tries > 32:
                    roomy, tries = max(roomy, at), 0
                if at + width >= len(owner):
                    owner += [-1] * len(owner)
                    target += [0] * len(target)
            if at + 2 * width >= len(owner):
                owner += [-1] * len(owner)
                target += [0] * len(target)
            self.base[s] = at
            for c in codes:
                owner[at + c], target[at + c] = s, moves[s][c]
            self.last = max(self.last, at + codes[-1])
        used = self.last + width + 2
        self.owner, self.target = np.array(owner[:used], np.int32), np.array(target[:used], np.int32)
        self.owner = np.concatenate((self.owner, np.full(max(0, int(self.base.max(initial=0)) + width + 2 - used), -1, np.int32)))
        self.target = np.concatenate((self.target, np.zeros(len(self.owner) - len(self.target), np.int32)))
        self.root = np.array([moves[0].get(c, 0) for c in range(width + 1)], np.int32)

    def parse(self, coded: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each stretch of codes; stretches come longest first."""
        state, count = np.zeros(len(begin), np.int32), np.ones(len(begin), np.int64)
        steps = int(size[min(FEW, len(size) - 1)]) if len(size) > FEW else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        for t, a in enumerate(active.tolist()):
            c = coded[begin[:a] + t]
            at = self.base[state[:a]] + c
            hit = self.owner[at] == state[:a]
            count[:a] += ~hit
            state[:a] = np.where(hit, self.target[at], self.root[c])
        base, owner, target, root = self.base, self.owner, self.target, self.root
        for k in range(len(size)):
            if size[k] <= steps:
                break
            s, n = int(state[k]), 0
            for c in coded[begin[k] + steps : begin[k] + size[k]].tolist():
                at = base.item(s) + c
                if owner.item(at) == s:
                    s = target.item(at)
                else:
                    s, n = root.item(c), n + 1
            count[k] += n
        return count


class Model:
    """An automaton for each language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.tables: dict[str, tuple[np.ndarray, DoubleArray]] = {}
        for lang in LANGUAGES:
            texts = [t for t in samples.get(lang, []) if t]
            if not texts:
                continue
            b = Batch(texts)
            letters = np.unique(np.append(b.text, 32))
            into = np.zeros(0x10000, np.int32)  # code of a character, 0 if the samples lack it
            into[letters] = np.arange(1, len(letters) + 1)
            seq: list[int] = []
            for k, (at, n) in enumerate(zip(b.begin.tolist(), b.size.tolist())):
                seq += [int(into[32]), *into[b.text[at : at + n]].tolist(), -1 - k]  # a different end mark for each, so no match crosses
            moves = [{c: t for c, t in m.items() if c > 0} for m in suffix_automaton(seq)]
            self.tables[lang] = (into, DoubleArray(moves, len(letters)))
        self.langs = tuple(self.tables)

    def phrases(self, texts: list[str] | Batch) -> tuple[np.ndarray, np.ndarray]:
        """(sentences x languages) phrases of the cross-parse, and the length of each sentence in characters."""
        b = texts if isinstance(texts, Batch) else Batch(texts)
        order = np.argsort(-b.size, kind="stable")
        counts = np.zeros((len(b.size), len(self.langs)))
        for k, lang in enumerate(self.langs):
            into, automaton = self.tables[lang]
            script = b.wide if lang in ("zh", "ja") else b.cyrillic if lang == "ru" else b.latin
            counts[:, k] = b.size  # no letter of the script: each character is a phrase
            rows = order[(script > 0)[order]]
            if len(rows):
                counts[rows, k] = automaton.parse(into[b.text], b.begin[rows], b.size[rows])
        return counts, b.size


def path(costs: np.ndarray, switch: float = SWITCH) -> list[int]:
    """Cheapest sequence of languages over the sentences of a document."""
    best = costs.argmin(axis=1)
    if (best == best[0]).all():
        return best.tolist()
    total, back = costs[0].copy(), []
    for row in costs[1:]:
        k = int(total.argmin())
        stay = total <= total[k] + switch
        back.append(np.where(stay, np.arange(len(total)), k))
        total = np.where(stay, total, total[k] + switch) + row
    k = int(total.argmin())
    out = [k]
    for b in reversed(back):
        k = int(b[k])
        out.append(k)
    return out[::-1]


def confidence(costs: np.ndarray, k: int) -> float:
    """Share of the chosen language if each phrase halves the odds."""
    gap = np.clip(costs - costs[k], -30, 30)
    return float(1 / np.exp2(-gap).sum())


SEGMENTS = "doc_id long, segment_no int, lang string, confidence double, n_sentences int, n_chars int, n_all int"


def _segmenter(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            column = batch.column(1)
            for lo in range(0, len(ids), 1000):
                rows = segments(model.value, ids[lo : lo + 1000], column.slice(lo, 1000).to_pylist())
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "segment_no", "lang", "confidence", "n_sentences", "n_chars", "n_all"])

    return run


def segments(model: Model, ids: list[int], texts: list[str | None]) -> list[tuple]:
    """Runs of successive sentences of one language, for each text."""
    found = [pieces(t) if t else [] for t in texts]
    flat = [s for x in found for s in x]
    if not flat or not model.langs:
        return []
    batch = Batch(flat)
    counts, lengths = model.phrases(batch)
    whole = batch.whole()
    out, at = [], 0
    for key, own in zip(ids, found):
        here = np.flatnonzero(whole[at : at + len(own)]) + at
        at += len(own)
        if not len(here):
            continue
        costs, chars = counts[here], lengths[here]
        langs, no, lo = path(costs), 0, 0
        while lo < len(langs):
            hi = lo
            while hi < len(langs) and langs[hi] == langs[lo]:
                hi += 1
            no += 1
            out.append((key, no, model.langs[langs[lo]], confidence(costs[lo:hi].sum(axis=0), langs[lo]), hi - lo, int(chars[lo:hi].sum()), len(langs)))
            lo = hi
    return out


def fit(samples: DataFrame) -> Model:
    """Model from labelled snippets: of a language with more than SAMPLE_CHARS, a share by hash of that size; all of the others."""
    rows = samples.filter(F.col("text").isNotNull()).select("sample_id", "text", _named(F.col("lang")).alias("lang")).filter(F.col("lang").isNotNull())
    size = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))  # a row for each of nine languages
    share = F.lit(SAMPLE_CHARS) / F.col("chars") * (1 << 30)
    kept = rows.join(F.broadcast(size), "lang").filter(F.pmod(F.xxhash64("sample_id", "text"), F.lit(1 << 30)) <= share)
    texts: dict[str, list[str]] = {}
    for r in sorted(kept.select("sample_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect(), key=lambda r: (r.sample_id is None, r.sample_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts)


def language_segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, segment_no, lang, confidence, n_sentences, n_chars, n_all): segments of successive sentences, n_all of the document."""
    model = documents.sparkSession.sparkContext.broadcast(fit(samples))  # bounded by SAMPLE_CHARS
    docs = spread(documents.filter(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text"), "doc_id")
    return docs.mapInArrow(_segmenter(model), SEGMENTS)


def _named(label: Column) -> Column:
    """The language that a label names, natively; null if it names none."""
    first = F.split(F.trim(F.lower(label)), r"[-_ .,;:/()\[\]]+")
    names = F.create_map(*[F.lit(x) for pair in _BY_NAME.items() for x in pair])
    return F.try_element_at(names, F.try_element_at(F.filter(first, lambda x: x != ""), F.lit(1)))


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, label_lang, label_ok, runs): main language by prose, what the label names, and the languages of whole runs.

    A run is two or more successive sentences of a language, or the only
    sentence of the document.
    """
    seg = language_segments(documents, samples)
    # characters that carry a word weigh more: a Han or Kana character counts as three letters
    weight = F.when(F.col("lang").isin("zh", "ja"), 3).otherwise(1) * F.col("n_chars")
    per = seg.groupBy("doc_id", "lang").agg(F.sum(weight).alias("w"), F.max("n_sentences").alias("longest"), F.max("n_all").alias("n_all"), F.max("confidence").alias("confidence"))
    whole = (F.col("longest") >= 2) | (F.col("n_all") == 1)
    doc = per.groupBy("doc_id").agg(F.max_by(F.struct("lang", "confidence"), F.struct(F.col("w"), F.col("lang"))).alias("m"), F.array_sort(F.collect_set(F.when(whole, F.col("lang")))).alias("runs"))
    out = documents.select("doc_id", _named(F.col("lang")).alias("label_lang")).join(doc, "doc_id", "left")
    return out.select("doc_id", F.col("m.lang").alias("lang"), F.col("m.confidence").alias("confidence"), "label_lang", F.coalesce(F.col("label_lang") == F.col("m.lang"), F.lit(False)).alias("label_ok"), "runs")


def language_cases(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang): each language that has a run, of the documents whose label is missing or wrong or that hold a second language."""
    doc = document_languages(documents, samples).filter(F.col("lang").isNotNull())
    case = ~F.col("label_ok") | (F.size(F.array_remove(F.col("runs"), F.col("lang"))) > 0)
    return doc.filter(case).select("doc_id", F.explode("runs").alias("lang")).distinct()
