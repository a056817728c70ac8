"""Text expressions: tokens, weighted term bags, titles, slugs, URIs, scores and secrets."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A Han character is a token of its own; other letters and digits form runs.
TOKEN = r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"
WEIGHTS = {"title": 3, "summary": 2, "body": 1}
MODES = {"simple": "unigrams", "en": "unigrams", "en_stem": "unigrams", "auto": "dictionary", "gse": "dictionary", "zh": "dictionary", "cjk": "dictionary", "jieba": "dictionary"}


def lowered(text: Column) -> Column:
    """Lower case letter by letter: the dotted capital I becomes a plain i. Null is empty."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "İ", "i"))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null text has none."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """The tokens of a query, on the driver; the same rule as tokens()."""
    out, run = [], []
    for ch in text + " ":
        han = "⺀" <= ch <= "⿕" or ch in "々〇" or "〡" <= ch <= "〩" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or ord(ch) >= 0x20000
        if not han and (ch.isalpha() or ch.isdecimal()):
            run.append(ch)
            continue
        if run:
            out.append("".join(run).lower())
            run = []
        if han and (ch.isalpha() or ch.isnumeric()):
            out.append(ch)
    return out


def mode(name: str) -> str:
    """How Han text is cut under a tokenizer name; an unknown name raises ValueError."""
    if name not in MODES:
        raise ValueError(f"unknown tokenizer: {name}")
    return MODES[name]


class Segmenter:
    """Dictionary segmentation of Han runs: the most probable path over dictionary words, then their inner words of two and three characters."""

    def __init__(self, freq: dict[str, float]):
        import math

        self.words = freq
        total = sum(freq.values()) or 1.0
        self.log = {w: math.log(max(f, 1e-9) / total) for w, f in freq.items()}
        self.floor = math.log(0.5 / total)
        self.longest = max(map(len, freq), default=1)

    def run(self, text: str) -> list[str]:
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            best[i] = max((self.log.get(text[i:j], self.floor if j == i + 1 else float("-inf")) + best[j][0], j) for j in range(i + 1, min(n, i + self.longest) + 1))
        out, i = [], 0
        while i < n:
            j = best[i][1]
            word = text[i:j]
            for size in (2, 3):
                out += [word[k : k + size] for k in range(len(word) - size + 1) if len(word) > size and word[k : k + size] in self.words]
            out.append(word)
            i = j
        return out

    def __call__(self, text: str) -> list[str]:
        out = []
        for part in re.findall(r"[㐀-鿿豈-﫿]+|[^\W_]+", re.sub(r"([㐀-鿿豈-﫿]+)", r" \1 ", text or "")):
            out += self.run(part) if "㐀" <= part[0] <= "﫿" else [part.lower()]
        return out


def dictionary_tokens(freq: dict[str, float]):
    """Arrow UDF of dictionary segmentation; without a dictionary, Han characters stay single."""
    cut = Segmenter(freq)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: cut(t) if t else [])

    return udf


def weighted_bag(pages: DataFrame, keys: tuple[str, ...] = ("wiki", "slug"), cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """(keys, term, tf): three times the title, twice the summary and once the body. Map-side combined on (keys, term). cut makes the tokens of a text."""
    parts = [_weighted(cut(F.col(c)), w) for c, w in WEIGHTS.items()]
    return pages.select(*keys, F.explode(F.concat(*parts)).alias("x")).groupBy(*keys, F.col("x.term").alias("term")).agg(F.sum("x.w").cast("int").alias("tf"))


def _weighted(terms: Column, weight: int) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def bag_length(cut: Callable[[Column], Column] = tokens) -> Column:
    return sum((F.size(cut(F.col(c))) * w for c, w in WEIGHTS.items()), F.lit(0)).cast("long")


def title_case(stem: Column) -> Column:
    """mixture-of-experts to Mixture Of Experts; the rest of each word is untouched."""
    return F.array_join(F.transform(F.split(stem, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def heading_title(body: Column, stem: Column) -> Column:
    """First "# " line of a body, else the title-cased stem."""
    found = F.trim(F.regexp_extract(F.coalesce(body, F.lit("")), r"(?m)^[ \t]*# [ \t]*(\S[^\r\n]*)", 1))
    return F.when(found != "", found).otherwise(title_case(F.regexp_replace(stem, r"\.md$", "")))


def normalise_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def valid_slug(s: Column) -> Column:
    """Relative path without hidden, empty or dot segments, and without an extension on the last."""
    clean = ~s.rlike(r"(^|/)(\.|$)|^/|//")
    no_extension = ~F.element_at(F.split(s, "/"), -1).rlike(r"\.[^.]+$")
    return F.coalesce((s != "") & clean & no_extension, F.lit(False))


def slug_of_path(path: Column) -> Column:
    """x.md and x/index.md to x; a root index.md has none (null)."""
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.when(stem == "index", None).otherwise(F.regexp_replace(stem, r"/index$", ""))


def parse_uri(uri: Column, default_wiki: str, known: list[str] | None = None) -> Column:
    """struct(wiki, slug) of wiki://w/s, or of a bare slug in the default wiki. Given the known wikis, w/s of any other name is a slug of the default wiki."""
    cross = uri.rlike(r"^wiki://[^/]+/.")
    if known is not None:
        cross = cross & F.regexp_extract(uri, r"^wiki://([^/]+)/", 1).isin(known)
    return F.struct(
        F.when(cross, F.regexp_extract(uri, r"^wiki://([^/]+)/", 1)).otherwise(F.lit(default_wiki)).alias("wiki"),
        F.regexp_replace(F.when(cross, F.regexp_replace(uri, r"^wiki://[^/]+/", "")).otherwise(uri), r"^wiki://", "").alias("slug"),
    )


def confidence(raw: Column) -> Column:
    """Number in [0, 1] of a frontmatter value given as text: high, medium, low, or a finite number, clamped; else null."""
    n = raw.try_cast("double")
    word = F.when(raw == "high", 0.9).when(raw == "medium", 0.5).when(raw == "low", 0.2)
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return F.coalesce(word, F.when(finite, F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))))


def round2(x: Column) -> Column:
    """x * 100 + 0.5 cut toward zero, over 100."""
    return (x * 100 + 0.5).cast("long") / F.lit(100.0)


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def embed_text(limit: int | Column = 4000) -> Column:
    """Title, summary and body on lines of their own, cut to a number of code points."""
    parts = [F.coalesce("title", F.lit(""))] + [F.when(F.col(c) != "", F.col(c)) for c in ("summary", "body")]
    return F.substring(F.concat_ws("\n", *parts), F.lit(1), F.lit(limit))


# Secrets looked for at ingest, in this order.
SECRETS = (
    ("github-pat", r"ghp_[A-Za-z0-9]{36}"),
    ("openai-key", r"sk-[A-Za-z0-9]{48}"),
    ("anthropic-key", r"sk-ant-[A-Za-z0-9\-]{90,}"),
    ("aws-access-key", r"AKIA[0-9A-Z]{16}"),
    ("bearer-token", r"Bearer [A-Za-z0-9\-._~+/]{20,}"),
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
)


def redact_secrets(content: DataFrame, key: str, text: str, patterns: tuple = SECRETS, first_line: Column | None = None) -> DataFrame:
    """(key, redacted, matches): each pattern in turn over the lines of a text; matches hold one (pattern_name, line_number) for each pattern and line.

    Every pattern sees what the ones before have left. Lines before first_line
    (1-based, default 1) are front matter and stay.
    """
    first = first_line if first_line is not None else F.lit(1)
    lines = F.split(F.col(text), "\n")
    numbered = F.transform(lines, lambda l, i: F.struct(l.alias("s"), (i + 1).alias("no"), F.array().cast("array<string>").alias("hit")))
    for name, pattern in patterns:
        numbered = F.transform(numbered, _one_pattern(name, pattern, first))
    out = content.withColumn("_lines", numbered)
    flat = F.flatten(F.transform("_lines", lambda x: F.transform(x["hit"], lambda h: F.struct(h.alias("pattern_name"), x["no"].alias("line_number")))))
    return out.select(key, F.array_join(F.transform("_lines", lambda x: x["s"]), "\n").alias("redacted"), flat.alias("matches"))


def _one_pattern(name: str, pattern: str, first: Column):
    def step(x: Column) -> Column:
        hit = (x["no"] >= first) & x["s"].rlike(pattern)
        return F.struct(
            F.when(hit, F.regexp_replace(x["s"], pattern, f"[REDACTED:{name}]")).otherwise(x["s"]).alias("s"), x["no"].alias("no"),
            F.when(hit, F.concat(x["hit"], F.array(F.lit(name)))).otherwise(x["hit"]).alias("hit"),
        )

    return step


RADIUS = 80


def excerpt(body: str, terms: list[str]) -> str:
    """Window of 160 bytes about the earliest term, escaped, terms in <b>, dots where it is cut."""
    if not body:
        return ""
    raw, low = body.encode(), body.lower().encode()
    places = [p for p in (low.find(t.lower().encode()) for t in terms if t) if p >= 0]
    start = max(0, min(places) - RADIUS) if places else 0
    while 0 < start < len(raw) and raw[start] & 0xC0 == 0x80:
        start -= 1
    stop = min(len(raw), start + 2 * RADIUS)
    while start < stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop -= 1
    out = _escape(raw[start:stop].decode("utf-8", "ignore"))
    if not places:
        return out
    for t in terms:
        if t and not set(t) & set('&<>"'):
            out = re.sub(re.escape(t), lambda m: f"<b>{m[0]}</b>", out, flags=re.I)
    return ("…" if start else "") + out + ("…" if start + 2 * RADIUS < len(raw) else "")


def _escape(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        s = s.replace(a, b)
    return s


@cache
def excerpt_udf(terms: tuple[str, ...]):
    @F.pandas_udf(T.StringType())
    def udf(body: pd.Series) -> pd.Series:
        return body.map(lambda b: excerpt(b or "", list(terms)))

    return udf
