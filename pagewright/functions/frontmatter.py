"""Front matter: native split, YAML in an Arrow UDF, and the values of a page row."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = r"^\x{FEFF}?---"


def yaml_block(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)^\x{FEFF}?---\r?\n?(?:---|(.*?)\n---)", 1)


def strip(content: Column) -> Column:
    """Body without the front matter; an unclosed block stays."""
    closed = content.rlike(r"(?s)^\x{FEFF}?---\r?\n?(?:---|.*?\n---)")
    return F.when(closed, F.regexp_replace(content, r"(?s)^\x{FEFF}?---\r?\n?(?:---|.*?\n---)(?:\r\n)?\n?", "")).otherwise(F.regexp_replace(content, r"^\x{FEFF}", ""))


def error(content: Column) -> Column:
    """Why the block is missing or broken; null if it is well closed."""
    return F.when(~content.rlike(_OPEN), "no frontmatter block found").when(~content.rlike(r"(?s)^\x{FEFF}?---\r?\n?(?:---|.*?\n---)"), "no closing --- found")


def yaml_error(block: str | None) -> str | None:
    """Why a block is no YAML mapping; null if it is one, or empty."""
    try:
        value = yaml.load(block or "", _Loader)
    except yaml.YAMLError as e:
        return "invalid YAML: " + str(e).split("\n")[0]
    return None if value is None or isinstance(value, dict) else "frontmatter is not a mapping"


@F.pandas_udf(T.StringType())
def yaml_error_udf(block: pd.Series) -> pd.Series:
    return block.map(yaml_error)


def strict_error(content: Column) -> Column:
    """error(), and for a closed block what is wrong with its YAML."""
    return F.coalesce(error(content), yaml_error_udf(yaml_block(content)))


class _Loader(yaml.SafeLoader):
    """Dates stay text."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def parse(block: str | None) -> dict:
    """A YAML mapping; anything else, or a broken block, gives an empty one."""
    try:
        value = yaml.load(block or "", _Loader)
    except yaml.YAMLError:
        return {}
    return {str(k): v for k, v in value.items()} if isinstance(value, dict) else {}


def keyword(v: Any) -> list[str]:
    if isinstance(v, bool):
        return [str(v).lower()]
    return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str) and x] if isinstance(v, list) else []


def text(v: Any) -> str:
    return v if isinstance(v, str) else "\n".join(x for x in v if isinstance(x, str)) if isinstance(v, list) else ""


def confidence(v: Any) -> float | None:
    if isinstance(v, str):
        return {"high": 0.9, "medium": 0.5, "low": 0.2}.get(v)
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
        return None
    return min(1.0, max(0.0, float(v)))


PROMOTED = ("title", "summary", "type", "status", "tags", "confidence")
PAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "summary", "type", "status")]
    + [
        T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()),
        T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("text_vals", T.MapType(T.StringType(), T.StringType())),
        T.StructField("numeric_vals", T.MapType(T.StringType(), T.DoubleType())), T.StructField("rest", T.StringType()),
    ]
)


def page_values(fm: dict, kinds: dict[str, str], aliases: dict[str, str]) -> dict:
    """Columns of a page: promoted values, then each known field by its kind; an alias fills its canonical field if that is absent."""
    out: dict = {n: fm[n] if isinstance(fm.get(n), str) else "" for n in PROMOTED[:4]}
    out["tags"] = [t for t in fm["tags"] if isinstance(t, str)] if isinstance(fm.get("tags"), list) else None
    out["confidence"] = confidence(fm.get("confidence"))
    out |= {"fields": {}, "text_vals": {}, "numeric_vals": {}}

    def put(name: str, v: Any) -> None:
        kind = kinds.get(name)
        if kind == "keyword" and (k := keyword(v)):
            out["fields"][name] = k
        elif kind == "text" and (t := text(v)):
            out["text_vals"][name] = t
        elif kind == "numeric" and isinstance(v, int | float) and not isinstance(v, bool):
            out["numeric_vals"][name] = float(v)

    for name, v in fm.items():
        if name not in PROMOTED and name not in aliases:
            put(name, v)
    for alias, name in aliases.items():
        if alias in fm and not any(name in out[m] for m in ("fields", "text_vals", "numeric_vals")):
            put(name, fm[alias])
    out["rest"] = json.dumps({k: v for k, v in fm.items() if k not in PROMOTED}, default=str, ensure_ascii=False)
    return out


def page_udf(kinds: dict[str, str], aliases: dict[str, str]):
    """Arrow UDF: YAML text to the columns of a page."""

    @F.pandas_udf(PAGE)
    def udf(block: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_values(parse(b), kinds, aliases) for b in block], columns=PAGE.names)

    return udf


def write(fm: dict, body: str) -> str:
    return f"---\n{yaml.safe_dump(fm, allow_unicode=True, sort_keys=True)}---\n\n{body}"
