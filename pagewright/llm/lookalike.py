"""Visually identical text made of different characters.

The skeleton of a text: decompose, replace every character by the prototype of
a look-alike table, decompose again. Texts look the same exactly if their
skeletons are equal; originals are grouped by it.

Decomposition takes canonical forms and those compatibility forms that keep the
look (wide, narrow, font, no-break, and ligatures or radicals), but not
super- or subscripts, circled or squared signs and fractions, whose look
differs. Invisible characters are dropped, kinds of space become a space, of
hyphen a hyphen. Letter case, accents and line ends are kept. ASCII text is its
own skeleton: its letters and digits all look different in common fonts.

The table of prototypes is a parameter: the built-in one holds letters and signs
of the scripts that are mostly mixed with Latin; load_prototypes() reads the
public confusables format, for the whole of Unicode.

Defined results: a null text has a null skeleton, an empty text an empty one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import cut_lineage, salted_join, spread

# Letters and signs that look like a Latin one, after decomposition.
PROTOTYPES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "χ": "x", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "ϝ": "f",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "к": "k", "ү": "y", "Ӏ": "l", "З": "3", "б": "6",
    # Armenian, Hebrew, Cherokee, Coptic, Lisu
    "Տ": "S", "Օ": "O", "Լ": "L", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "յ": "j", "Ս": "U", "ѡ": "w", "ס": "o", "ו": "l", "ן": "l",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C",
    # Latin letters and signs
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "v", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɪ": "i", "ǃ": "!", "ƽ": "s", "ᴜ": "u", "ẝ": "f", "ſ": "f",
    "⁄": "/", "∕": "/", "⧸": "/", "∶": ":", "։": ":", "׃": ":", "∗": "*", "٭": "*", "‚": ",", "٫": ",", ";": ";", "ʼ": "'", "‘": "'", "’": "'", "′": "'", "ʹ": "'", "ʻ": "'", "ˈ": "'", "‛": "'", "“": "\"", "”": "\"", "″": "\"", "‹": "<", "›": ">", "٠": ".", "۰": ".", "․": ".", "·": "·", "‧": "·", "∙": "·", "⋅": "·", "•": "·", "･": "·",
}
# Canadian syllabics, and small letters that share the look of a small capital.
PROTOTYPES |= {"ᗅ": "A", "ᗷ": "B", "ᑕ": "C", "ᗞ": "D", "ᖴ": "F", "ᕼ": "H", "ᒍ": "J", "ᒪ": "L", "ᑭ": "P", "ᖇ": "R", "ᑌ": "U", "ᐯ": "V", "᙭": "X", "ᖯ": "b", "Ь": "b", "τ": "ᴛ", "т": "ᴛ", "в": "ʙ", "н": "ʜ", "м": "ᴍ"}
# Lisu letters have the look of the Latin capital that their names begin with.
PROTOTYPES |= {unicodedata.lookup(f"LISU LETTER {c}A"): c for c in "BPDTGKJCMNLSWY"} | {unicodedata.lookup(f"LISU LETTER {c}"): c for c in "AEIOU"}
# Simplified radicals without a Unicode decomposition, and the characters they look like.
RADICALS = {"⺀": "冫", "⺄": "乙", "⺈": "刀", "⺊": "卜", "⺋": "卩", "⺍": "小", "⺒": "巳", "⺓": "幺", "⺕": "彐", "⺗": "心", "⺘": "手", "⺙": "攵", "⺝": "月", "⺠": "民", "⺢": "水", "⺣": "灬", "⺨": "犭", "⺫": "目", "⺭": "礻", "⺮": "竹", "⺯": "糸", "⺰": "纟", "⺶": "羊", "⺷": "羊", "⺹": "老", "⺼": "肉", "⺾": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻲": "龟", "⻳": "龟"}
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
HYPHENS = "‐‑‒–−˗﹣⁃"
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")


def _prototype(ch: str, depth: int = 0, table: dict[str, str] = PROTOTYPES) -> str:
    """Look of one character by rule: invisible, space, hyphen, table, decomposition."""
    if ch.isascii():
        return ch
    if INVISIBLE.match(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in table:
        return table[ch]
    if ch in RADICALS:
        return RADICALS[ch]
    raw = unicodedata.decomposition(ch)
    if raw and depth < 8:
        parts = raw.split()
        if parts[0][0] != "<":
            return "".join(_prototype(chr(int(p, 16)), depth + 1, table) for p in parts)
        if parts[0] in SAME_LOOK:
            return "".join(_prototype(chr(int(p, 16)), depth + 1, table) for p in parts[1:])
    return ch


class Looks(dict):
    """The look of each character under a table of prototypes, filled as characters turn up, for str.translate."""

    def __init__(self, prototypes: dict[str, str] = PROTOTYPES):
        self.prototypes = prototypes

    def __missing__(self, code: int) -> str:
        value = self[code] = _prototype(chr(code), table=self.prototypes)
        return value

    def __reduce__(self):
        return Looks, (self.prototypes,)


_LOOKS = Looks()


def load_prototypes(lines: list[str]) -> dict[str, str]:
    """Prototypes of the public confusables format, 'source ; target ; kind # note' in hexadecimal. ASCII characters stay as they are, so their classes keep apart."""
    out = {}
    for line in lines:
        parts = line.lstrip("\ufeff").split("#")[0].split(";")
        if len(parts) >= 2:
            source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
            if len(source) == 1 and not source.isascii():
                out[source] = target
    return out


def skeleton(text: str | None, looks: Looks = _LOOKS) -> str | None:
    """The form in which texts of equal look are equal."""
    if text is None or text.isascii():
        return text
    replaced = text.translate(looks)
    # combining marks in canonical order, Hangul and the rest fully decomposed
    return replaced if replaced.isascii() else unicodedata.normalize("NFD", replaced)


def readable(text: str | None) -> str | None:
    """The skeleton composed again, where a text is not meant for comparison alone but for reading."""
    s = skeleton(text)
    return s if s is None or s.isascii() else unicodedata.normalize("NFC", s)


def skeleton_udf(looks: Looks = _LOOKS):
    @F.pandas_udf(T.StringType())
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: skeleton(t, looks))

    return udf


def skeleton_key_udf(looks: Looks = _LOOKS):
    @F.pandas_udf(T.BinaryType())
    def udf(text: pd.Series) -> pd.Series:
        return text.map(lambda t: hashlib.md5(skeleton(t, looks).encode("utf-8", "surrogatepass")).digest() if t else None)

    return udf


def with_skeletons(pages: DataFrame, prototypes: dict[str, str] = PROTOTYPES) -> DataFrame:
    """Adds title_form and body_form, the consistent form of title and body."""
    form = skeleton_udf(Looks(prototypes))
    return spread(pages, "rev_id").withColumns({"title_form": form("title"), "body_form": form("body")})


def look_keys(pages: DataFrame, prototypes: dict[str, str] = PROTOTYPES) -> DataFrame:
    """(rev_id, field, look, same): 128-bit digest of the skeleton, and of the original, for each title and body that is not null or empty.

    ASCII texts are their own skeleton and are digested natively; Python gets a
    null in their place. The keys are narrow and are kept, as several steps read them.
    """
    key = skeleton_key_udf(Looks(prototypes))
    texts = spread(pages.select("rev_id", "title", "body"), "rev_id")
    rows = texts.select("rev_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("text")), F.struct(F.lit("body").alias("field"), F.col("body").alias("text")))).alias("x"))
    rows = rows.select("rev_id", "x.field", "x.text").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    same = F.unhex(F.md5(F.col("text").cast("binary")))
    other = F.when(F.octet_length("text") != F.length("text"), F.col("text"))
    return cut_lineage(rows.select("rev_id", "field", F.coalesce(key(other), same).alias("look"), same.alias("same")))


def look_groups(pages: DataFrame, prototypes: dict[str, str] = PROTOTYPES) -> tuple[DataFrame, DataFrame]:
    """(keys, variants): every distinct original of each look that has two or more of them, with its rows, its smallest rev_id, and the rows and originals of the look."""
    keys = look_keys(pages, prototypes)
    # a look with all its copies is pre-aggregated to its originals
    variants = keys.groupBy("field", "look", "same").agg(F.count(F.lit(1)).alias("n"), F.min("rev_id").alias("first_id"))
    shared = variants.groupBy("field", "look").agg(F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_rows"), F.min("first_id").alias("look_first_id")).filter("n_variants > 1")
    return keys, cut_lineage(variants.join(shared, ["field", "look"]))


def equal_look_pairs(pages: DataFrame, prototypes: dict[str, str] = PROTOTYPES) -> DataFrame:
    """(rev_id_a, rev_id_b, field): rows that look the same in a field but hold different strings.

    Exact copies meet only through their variant: variants of a look are paired
    first, then each side is expanded to its rows, with the rows of hot variants
    split over salts. All pairs are what is asked for here; look_classes() says
    the same in one row for each member.
    """
    keys, variants = look_groups(pages, prototypes)
    look, a, b = ["field", "look"], ["field", "look", "same_a"], ["field", "look", "same_b"]
    pairs = variants.select(*look, F.col("same").alias("same_a")).join(variants.select(*look, F.col("same").alias("same_b")), look).filter("same_a != same_b")
    members = salted_join(keys, variants.select(*look, "same"), [*look, "same"], "rev_id", counts=variants.select(*look, "same", F.col("n").alias("_n")))
    rows_a = members.withColumnsRenamed({"rev_id": "rev_id_a", "same": "same_a"})
    rows_b = members.withColumnsRenamed({"rev_id": "rev_id_b", "same": "same_b"})
    half = salted_join(rows_a, pairs, a, "rev_id_a", counts=variants.select(*look, F.col("same").alias("same_a"), F.col("n").alias("_n"))).select(*look, "same_b", "rev_id_a")
    # so many rows of all other variants come to each variant
    met = variants.select(*look, F.col("same").alias("same_b"), (F.col("n_rows") - F.col("n")).alias("_n"))
    out = salted_join(half, rows_b, b, "rev_id_a", counts=met).filter("rev_id_a < rev_id_b")
    return out.select("rev_id_a", "rev_id_b", "field").distinct()


def look_classes(pages: DataFrame, prototypes: dict[str, str] = PROTOTYPES) -> DataFrame:
    """(rev_id, field, look_id, same_id, look_first_id, n_variants, n_rows): rows whose look is shared by other strings, with their class.

    same_id is the smallest rev_id of the same string, look_first_id that of the
    look: they link representatives, and with the membership give every pair.
    """
    keys, variants = look_groups(pages, prototypes)
    per = variants.select("field", "look", "same", F.col("first_id").alias("same_id"), "look_first_id", "n_variants", "n_rows")
    rows = salted_join(keys, per, ["field", "look", "same"], "rev_id", counts=variants.select("field", "look", "same", F.col("n").alias("_n")))
    return rows.select("rev_id", "field", F.lower(F.hex("look")).alias("look_id"), "same_id", "look_first_id", "n_variants", "n_rows")
