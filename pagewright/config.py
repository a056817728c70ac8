"""Defaults of every operator, and TOML configuration merged key by key over them."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

# Type groups and the reference fields of pages.
SOURCE_TYPES = ("paper", "article", "documentation", "clipping", "transcript", "note", "data", "book-chapter", "thread")
LINK_FIELDS = ("sources", "concepts", "document_refs")


@dataclass(frozen=True)
class Search:
    top_k: int = 10
    facet_tags: int = 10
    page_size: int = 20
    hybrid_weight: float = 0.5
    k1: float = 1.2
    b: float = 0.75
    status: dict = field(default_factory=lambda: {"active": 1.0, "draft": 0.8, "archived": 0.3, "unknown": 0.9})


@dataclass(frozen=True)
class Graph:
    depth: int = 3
    min_nodes_for_communities: int = 30
    community_suggestions_limit: int = 2
    max_nodes_for_diameter: int = 2000


@dataclass(frozen=True)
class Suggest:
    default_limit: int = 5
    min_score: float = 0.1


@dataclass(frozen=True)
class Lint:
    stale_days: int = 90
    stale_confidence_threshold: float = 0.4


@dataclass(frozen=True)
class Embedding:
    model: str = ""
    batch_size: int = 16
    max_text_chars: int = 4000
    timeout_s: int = 60
    api_key: str = ""


@dataclass(frozen=True)
class Config:
    search: Search = Search()
    graph: Graph = Graph()
    suggest: Suggest = Suggest()
    lint: Lint = Lint()
    embedding: Embedding = Embedding()
    type_strictness: str = "loose"
    tokenizer: str = "simple"
    history_limit: int = 10
    debounce_ms: int = 500

    def get(self, key: str) -> Any:
        """Value of a dotted key; a secret comes masked, an unknown key raises KeyError."""
        at: Any = self
        for part in key.split("."):
            if isinstance(at, dict):
                at = at[part]
            elif is_dataclass(at) and part in {f.name for f in fields(at)}:
                at = getattr(at, part)
            else:
                raise KeyError(f"unknown key: {key}")
        return mask(at) if key.endswith("api_key") else at

    def list(self) -> dict[str, Any]:
        """Every dotted key with its value, secrets masked."""
        out: dict[str, Any] = {}

        def walk(node: Any, at: str) -> None:
            for name in [f.name for f in fields(node)] if is_dataclass(node) else list(node):
                key = f"{at}{name}"
                value = getattr(node, name) if is_dataclass(node) else node[name]
                if is_dataclass(value) or isinstance(value, dict):
                    walk(value, f"{key}.")
                else:
                    out[key] = mask(value) if key.endswith("api_key") else value

        walk(self, "")
        return out

    def set(self, key: str, value: Any) -> Config:
        """A copy with one dotted key changed."""
        head, _, rest = key.partition(".")
        if head not in {f.name for f in fields(self)}:
            raise KeyError(f"unknown key: {key}")
        return replace(self, **{head: _put(getattr(self, head), rest, value)})


def _put(node: Any, key: str, value: Any) -> Any:
    if not key:
        return value
    head, _, rest = key.partition(".")
    if isinstance(node, dict):
        return {**node, head: _put(node.get(head), rest, value)}
    if not is_dataclass(node) or head not in {f.name for f in fields(node)}:
        raise KeyError(f"unknown key: {key}")
    return replace(node, **{head: _put(getattr(node, head), rest, value)})


def mask(secret: str) -> str:
    """First three and last four characters of a long secret; a short one vanishes."""
    return secret if not secret else "***" if len(secret) <= 8 else f"{secret[:3]}...{secret[-4:]}"


def merge(base: Any, layer: dict) -> Any:
    """Layer over base, key by key; keys that the base lacks are ignored."""
    if isinstance(base, dict):
        return {**base, **layer}
    known = {f.name for f in fields(base)}
    return replace(base, **{k: merge(getattr(base, k), v) if isinstance(v, dict) else v for k, v in layer.items() if k in known})


def load(*paths: str | Path) -> Config:
    """Defaults, then each TOML file that exists."""
    out = Config()
    for p in map(Path, paths):
        if p.exists():
            out = merge(out, tomllib.loads(p.read_text("utf-8")))
    return out


def save(path: str | Path, key: str, value: Any) -> None:
    """Writes one dotted key into a TOML file and keeps the others; a key that the configuration lacks raises KeyError."""
    Config().set(key, value)
    file = Path(path)
    tree = tomllib.loads(file.read_text("utf-8")) if file.exists() else {}
    at = tree
    *heads, last = key.split(".")
    for head in heads:
        at = at.setdefault(head, {})
    at[last] = value
    file.write_text(_toml(tree), "utf-8")


def _toml(tree: dict, at: str = "") -> str:
    """Tables, text, numbers, truth values and lists as TOML."""
    one = lambda v: json.dumps(v, ensure_ascii=False) if not isinstance(v, list) else "[" + ", ".join(map(one, v)) + "]"
    plain = "".join(f"{json.dumps(k, ensure_ascii=False)} = {one(v)}\n" for k, v in tree.items() if not isinstance(v, dict))
    tables = "".join(_toml(v, f"{at}{json.dumps(k, ensure_ascii=False)}.") for k, v in tree.items() if isinstance(v, dict))
    return (f"\n[{at[:-1]}]\n" if at else "") + plain + tables
