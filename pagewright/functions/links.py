"""Links of Markdown bodies: wikilinks, inline links, relative destinations, classes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wikilinks(body: Column) -> Column:
    """Distinct trimmed contents of [[...]] in order, alias included; code is not exempt."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def relative(dest: str, source_dir: str) -> str:
    """Destination without .md, leading ./ and ../ resolved against a directory."""
    dest = dest.removesuffix(".md")
    steps = re.match(r"(?:\.\.?/)*(?:\.\.$)?", dest)[0]
    if not steps:
        return dest
    parts = [p for p in source_dir.split("/") if p]
    up = steps.count("..")
    kept = parts[: max(0, len(parts) - up)]
    rest = dest[len(steps) :]
    return "/".join(kept + ([rest] if rest else []))


_CLOSE = re.compile(r"\]\(([^)]*)\)")


def body_links(body: str | None, source_dir: str | None = None) -> list[str]:
    """All links of a body: wikilinks first, then inline links that are no image, address, mail or anchor; the wiki name of wiki:// is lost."""
    if not body:
        return []
    raw = [m.strip() for m in re.findall(r"\[\[(.*?)\]\]", body, re.S)]
    at = 0
    for m in _CLOSE.finditer(body):
        # the nearest bracket since the link before decides whether this is an image
        opened = body.rfind("[", at, m.start())
        if opened < 0:
            continue
        image = opened > at and body[opened - 1] == "!"
        at = m.end()
        dest = m[1].strip().split("#", 1)[0].strip()
        if not image and dest and not dest.startswith(("http://", "https://", "mailto:")):
            raw.append(relative(dest, source_dir) if source_dir is not None else dest)
    return [re.sub(r"^wiki://[^/]+/", "", x) for x in dict.fromkeys(x for x in raw if x)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def body_links_udf(body: pd.Series, source_dir: pd.Series) -> pd.Series:
    return pd.Series([body_links(b, d) for b, d in zip(body, source_dir)])


def classify(link: Column) -> Column:
    """struct(wiki, slug, cross): wiki://w/s is a link to another wiki."""
    cross = link.rlike(r"^wiki://[^/]*/")
    return F.struct(
        F.when(cross, F.regexp_extract(link, r"^wiki://([^/]*)/", 1)).alias("wiki"),
        F.when(cross, F.regexp_replace(link, r"^wiki://[^/]*/", "")).otherwise(link).alias("slug"),
        cross.alias("cross"),
    )


def page_links() -> Column:
    """Distinct sources, concepts and body links of a page row."""
    empty = F.array().cast("array<string>")
    field = lambda name: F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), empty)
    return F.array_distinct(F.concat(field("sources"), field("concepts"), F.coalesce(F.col("body_links"), empty)))
