"""Page types declared by JSON Schema files: registry, field kinds, aliases, edges, validation."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Registry:
    """Everything the schema files declare, first file by name first."""

    types: dict[str, dict] = field(default_factory=dict)  # name -> description, required, schema
    kinds: dict[str, str] = field(default_factory=dict)  # field -> keyword, text, numeric
    aliases: dict[str, str] = field(default_factory=dict)
    edges: list[dict] = field(default_factory=list)

    def hash(self) -> str:
        body = {k: [v["required"], v["schema"]] for k, v in self.types.items()}
        return hashlib.sha256(json.dumps([body, self.kinds, self.aliases, self.edges], sort_keys=True).encode()).hexdigest()

    def type_hash(self, name: str) -> str:
        return hashlib.sha256(json.dumps(self.types[name]["schema"], sort_keys=True).encode()).hexdigest()

    def edge_rows(self) -> list[tuple]:
        return [(e["type"], e["field"], e["relation"], e["target_types"]) for e in self.edges]

    def template(self, name: str) -> dict:
        """Front matter of a new page of a type, required fields empty."""
        props = self.types[name]["schema"].get("properties", {})
        return {f: [] if props.get(f, {}).get("type") == "array" else "" for f in self.types[name]["required"]} | {"type": name}

    def without(self, name: str) -> Registry:
        return Registry({k: v for k, v in self.types.items() if k != name}, dict(self.kinds), dict(self.aliases), [e for e in self.edges if e["type"] != name])


def kind_of(prop: dict, edge: bool, first_seen: str | None = None) -> str:
    """keyword, text or numeric, by the declaration of a field."""
    if edge:
        return "keyword"
    t = prop.get("type")
    closed = "enum" in prop or "const" in prop
    if t == "boolean" or t == "string" and closed:
        return "keyword"
    if t == "array":
        items = prop.get("items") or {}
        return "keyword" if prop.get("x-keyword") or "enum" in items or "const" in items else "text"
    return "numeric" if t in ("number", "integer") else "text"


def load(folder: str | Path, default: dict | None = None) -> Registry:
    """Registry of the *.json files of a folder, or of given {file: schema}. A type "default" with title and type must come of it."""
    files = default if default is not None else {p.name: json.loads(p.read_text("utf-8")) for p in sorted(Path(folder).glob("*.json"))}
    out = Registry(kinds={"slug": "keyword", "uri": "keyword", "body_links": "keyword", "body": "text"})
    edged = {f for s in files.values() for f in (s.get("x-graph-edges") or {})}
    for name in sorted(files):
        schema = files[name]
        for f, prop in (schema.get("properties") or {}).items():
            out.kinds.setdefault(f, kind_of(prop if isinstance(prop, dict) else {}, f in edged))
        for f in edged & set(schema.get("x-graph-edges") or {}):
            out.kinds.setdefault(f, "keyword")
        for a, b in (schema.get("x-index-aliases") or {}).items():
            out.aliases.setdefault(a, b)
        declared = schema.get("x-wiki-types") or {}
        declared = declared if isinstance(declared, dict) else {t: "" for t in declared}
        for t, about in declared.items():
            if t in out.types:
                continue
            out.types[t] = {"description": about, "required": list(schema.get("required") or []), "schema": schema}
            for f, e in (schema.get("x-graph-edges") or {}).items():
                out.edges.append({"type": t, "field": f, "relation": e.get("relation", f), "target_types": list(e.get("target_types") or [])})
    base = out.types.get("default")
    if base is None or not {"title", "type"} <= set(base["required"]):
        raise ValueError("a type named default that requires title and type is missing")
    return out


def violations(value: Any, schema: dict, at: str = "") -> list[str]:
    """Errors of a value under the part of JSON Schema that page schemas use."""
    out: list[str] = []
    names = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}
    t = schema.get("type")
    kinds = t if isinstance(t, list) else [t] if t else []
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = [number if k == "number" else number and float(value).is_integer() if k == "integer" else isinstance(value, names.get(k, object)) for k in kinds]
    if kinds and not any(fits):
        return [f"{at or '/'}: is not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at or '/'}: not one of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at or '/'}: not {schema['const']}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", 1 << 60):
            out.append(f"{at or '/'}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at or '/'}: does not match {schema['pattern']}")
    if number and not schema.get("minimum", float("-inf")) <= value <= schema.get("maximum", float("inf")):
        out.append(f"{at or '/'}: out of range")
    if isinstance(value, list) and "items" in schema:
        out += [e for k, v in enumerate(value) for e in violations(v, schema["items"], f"{at}/{k}")]
    if isinstance(value, dict):
        out += [f"{at or '/'}: {r} is required" for r in schema.get("required", []) if r not in value]
        props = schema.get("properties") or {}
        out += [e for k, v in value.items() if k in props for e in violations(v, props[k], f"{at}/{k}")]
        if schema.get("additionalProperties") is False:
            out += [f"{at or '/'}: {k} is not allowed" for k in value if k not in props]
    return out


def validate_page(fm: dict, registry: Registry, strict: bool = False) -> list[tuple[str, str]]:
    """(severity, message) of a page's front matter."""
    if not fm.get("title") and not fm.get("name"):
        return [("error", "title or name is required")]
    out, kind = [], fm.get("type") or ""
    if kind not in registry.types:
        bad = bool(kind)
        out.append(("error" if strict and bad else "warning", f"unknown type: {kind}" if bad else "missing type, default assumed"))
        kind = "default"
    level = "error" if strict else "warning"
    return out + [(level, m) for m in violations(fm, registry.types[kind]["schema"])]


def list_types(registry: Registry) -> list[dict]:
    """Name, description and required fields of every type, in order of name."""
    return [{"type": t, "description": d["description"], "required": d["required"], "fields": sorted(d["schema"].get("properties") or {})} for t, d in sorted(registry.types.items())]


def show(registry: Registry, name: str) -> dict:
    """The schema of a type, with its own edges."""
    if name not in registry.types:
        raise KeyError(f"unknown type: {name}")
    return registry.types[name] | {"edges": [e for e in registry.edges if e["type"] == name]}


def check_schema(schema: dict) -> list[str]:
    """What is wrong with a schema file."""
    out = [] if schema.get("type", "object") == "object" else ["a page schema describes an object"]
    if not schema.get("x-wiki-types"):
        out.append("x-wiki-types names no type")
    props = schema.get("properties") or {}
    out += [f"required field {f} has no property" for f in schema.get("required") or [] if f not in props]
    out += [f"edge field {f} has no property" for f in schema.get("x-graph-edges") or {} if f not in props]
    return out


def add(folder: str | Path, name: str, schema: dict) -> Path:
    """Writes a schema file; a faulty schema, a bad name or a type that is there already is an error."""
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]*", name):
        raise ValueError(f"bad schema name: {name}")
    if faults := check_schema(schema):
        raise ValueError("; ".join(faults))
    there = {t for p in Path(folder).glob("*.json") for t in json.loads(p.read_text("utf-8")).get("x-wiki-types") or {}}
    if known := there & set(schema["x-wiki-types"]):
        raise ValueError(f"types are declared already: {sorted(known)}")
    file = Path(folder) / f"{name}.json"
    file.write_text(json.dumps(schema, indent=1) + "\n", "utf-8")
    return file


def remove(folder: str | Path, name: str) -> list[str]:
    """Takes a type out of the schema files, and files that declare no other type away; gives the names of the files."""
    touched = []
    for p in sorted(Path(folder).glob("*.json")):
        schema = json.loads(p.read_text("utf-8"))
        types = schema.get("x-wiki-types") or {}
        if name in types:
            schema["x-wiki-types"] = {t: d for t, d in types.items() if t != name} if isinstance(types, dict) else [t for t in types if t != name]
            if schema["x-wiki-types"]:
                p.write_text(json.dumps(schema, indent=1) + "\n", "utf-8")
            else:
                p.unlink()
            touched.append(p.name)
    if not touched:
        raise KeyError(f"unknown type: {name}")
    return touched
