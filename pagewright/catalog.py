"""Wikis: registered spaces on disk, scaffolding of pages, and SQL views with table functions."""

from __future__ import annotations

import json
import re
import shutil
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.functions import frontmatter as M
from pagewright.operators import graph, listing, quality, search
from pagewright.operators.index import Store, cutter
from pagewright.sources import git as G
from pagewright.sources.embeddings import Provider

RESERVED = ("inbox", "raw", "schemas")
# Schema of a new wiki: pages of the type default have a title and a type.
DEFAULT_SCHEMA = {"type": "object", "required": ["title", "type"], "properties": {"title": {"type": "string"}, "type": {"type": "string"}}, "x-wiki-types": {"default": "a page"}}


def check_root(repo: Path, root: str) -> Path:
    """Folder of a wiki's pages within its repository."""
    p = Path(root)
    if p.is_absolute() or ".." in p.parts or (p.parts and p.parts[0] in RESERVED):
        raise ValueError(f"bad wiki root: {root}")
    full = (repo / p).resolve()
    if not full.is_dir() or not full.is_relative_to(repo.resolve()):
        raise ValueError(f"wiki root is not a folder of the repository: {root}")
    return full


@dataclass
class Catalog:
    """Registered wikis in one JSON file; the first one is the default."""

    file: Path
    spaces: dict[str, dict] = field(default_factory=dict)
    default: str = ""

    @classmethod
    def open(cls, file: str | Path) -> Catalog:
        file = Path(file)
        data = json.loads(file.read_text("utf-8")) if file.exists() else {}
        return cls(file, data.get("spaces", {}), data.get("default", ""))

    def save(self) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        new = self.file.with_suffix(".tmp")
        new.write_text(json.dumps({"spaces": self.spaces, "default": self.default}, indent=1), "utf-8")
        new.replace(self.file)

    def create(self, name: str, repo: str | Path, git: bool = True) -> None:
        """Lay out folders, the default schema, a readme and the wiki's own configuration, commit them, and register the wiki."""
        repo = Path(repo)
        for sub in ("wiki", "schemas", "inbox", "raw"):
            (repo / sub).mkdir(parents=True, exist_ok=True)
        first = {"schemas/default.json": json.dumps(DEFAULT_SCHEMA, indent=1) + "\n", "README.md": f"# {name}\n", "wiki.toml": f'name = {json.dumps(name)}\nroot = "wiki"\n'}
        for file, text in first.items():
            if not (repo / file).exists():
                (repo / file).write_text(text, "utf-8")
        if git and not (repo / ".git").exists():
            G.init(str(repo))
            G.commit(str(repo), f"create: {name}")
        self.register(name, repo, "wiki")

    def register(self, name: str, repo: str | Path, root: str = "wiki") -> None:
        if name in self.spaces:
            raise ValueError(f"wiki {name} is registered already")
        check_root(Path(repo), root)
        self.spaces[name] = {"path": str(Path(repo).resolve()), "root": root}
        self.default = self.default or name
        self.save()

    def names(self) -> list[str]:
        return sorted(self.spaces)

    def info(self, version: str = "1") -> dict:
        """Version, wikis, and ok, or degraded if the folder of one is gone."""
        lost = [n for n, s in self.spaces.items() if not (Path(s["path"]) / s["root"]).is_dir()]
        return {"version": version, "spaces": self.names(), "default": self.default, "status": "degraded" if lost else "ok", "missing": sorted(lost)}

    def reload(self) -> None:
        """Takes in what another process has registered."""
        fresh = Catalog.open(self.file)
        self.spaces, self.default = fresh.spaces, fresh.default

    def remove(self, name: str, delete: bool = False) -> None:
        if name == self.default:
            raise ValueError("the default wiki cannot be removed")
        space = self.spaces.pop(name)
        self.save()
        if delete:
            shutil.rmtree(space["path"])

    def set_default(self, name: str) -> None:
        if name not in self.spaces:
            raise KeyError(f"unknown wiki: {name}")
        self.default = name
        self.save()

    def root(self, name: str) -> Path:
        s = self.spaces[name]
        return Path(s["path"]) / s["root"]


def scaffold(slug: str, today: str, section: bool = False, title: str | None = None) -> str:
    """Text of a new page or section."""
    name = title or " ".join(w[:1].upper() + w[1:] for w in slug.rsplit("/", 1)[-1].split("-"))
    return M.write({"title": name, "type": "section" if section else "page", "status": "draft", "last_updated": today, "confidence": 0.5, "summary": "", "tags": []}, "")


def check_slug(slug: str) -> None:
    """Raises for empty, hidden and dot segments and for an extension, so that no path leaves the root."""
    parts = slug.split("/")
    if not slug or any(not p or p.startswith(".") for p in parts) or "." in parts[-1].rstrip("."):
        raise ValueError(f"bad slug: {slug}")


def write_page(root: Path, slug: str, content: str) -> Path:
    """Overwrite the flat page or the bundle, else make a flat page. Bad slugs are refused."""
    check_slug(slug)
    flat, bundle = root / f"{slug}.md", root / slug / "index.md"
    path = flat if flat.exists() or not bundle.exists() else bundle
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, "utf-8")
    return path


def new_page(root: Path, slug: str, today: str, bundle: bool = False, section: bool = False, body: str = "") -> Path:
    """A scaffolded page; parent folders become sections, an existing page is an error, bad slugs are refused."""
    check_slug(slug)
    target = root / slug / "index.md" if bundle or section else root / f"{slug}.md"
    if target.exists():
        raise FileExistsError(str(target))
    parts = slug.split("/")[:-1]
    for k in range(1, len(parts) + 1):
        parent = "/".join(parts[:k])
        if not (root / f"{parent}.md").exists() and not (root / parent / "index.md").exists():
            write = root / parent / "index.md"
            write.parent.mkdir(parents=True, exist_ok=True)
            write.write_text(scaffold(parent, today, section=True), "utf-8")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(scaffold(slug, today, section=section) + body, "utf-8")
    return target


def body_template(repo: Path, kind: str) -> str:
    """Body of a new page of a type: schemas/<type>.md of the repository, else none."""
    file = repo / "schemas" / f"{kind}.md"
    return file.read_text("utf-8") if re.fullmatch(r"[\w-]+", kind) and file.is_file() else ""


def page_uris(root: Path, wiki: str, below: str = "") -> list[str]:
    """URIs of all pages of a folder or file, in order."""
    start = (root / below).resolve()
    if not start.is_relative_to(root.resolve()):
        raise ValueError(f"outside the wiki: {below}")
    files = [start] if start.is_file() else sorted(start.rglob("*.md"))
    slugs = (f.relative_to(root.resolve()).with_suffix("").as_posix().removesuffix("/index") for f in files if f.suffix == ".md")
    return [f"wiki://{wiki}/{s}" for s in sorted(slugs) if s != "index" and not any(p.startswith(".") for p in s.split("/"))]


def count_files(root: Path) -> int:
    """Markdown files that an index run would read."""
    return sum(1 for _ in root.rglob("*.md"))


def read_content(root: Path, target: str, strip: bool = False) -> dict:
    """A page by slug, with its text, the files beside it and a notice if another page supersedes it; else a file of a bundle, binary ones without text."""
    clean = target.removesuffix(".md")
    for path in (root / f"{clean}.md", root / clean / "index.md"):
        if path.is_file() and path.resolve().is_relative_to(root.resolve()):
            text = path.read_text("utf-8")
            m = re.match(r"\ufeff?---\r?\n(.*?)\n---(?:\r?\n)*", text, re.S)
            by = M.keyword(M.parse(m[1] if m else "").get("superseded_by"))
            beside = sorted(f.relative_to(root).as_posix() for f in path.parent.iterdir() if f.is_file() and f.suffix != ".md") if path.name == "index.md" else []
            return {"slug": clean, "text": text[m.end() :] if strip and m else text, "assets": beside, "notice": f"superseded by {by[0]}" if by else None}
    path = (root / target).resolve()
    if not path.is_relative_to(root.resolve()) or not path.is_file():
        raise FileNotFoundError(target)
    data = path.read_bytes()
    binary = b"\0" in data[:8192]
    return {"asset": target, "binary": binary, "text": None if binary else data.decode("utf-8", "replace")}


def commit_pages(repo: Path, root: Path, slugs: list[str], message: str) -> str:
    """Commits pages, a bundle with all files of its folder."""
    paths = []
    for slug in slugs:
        check_slug(slug)
        bundle, flat = root / slug / "index.md", root / f"{slug}.md"
        if bundle.exists():
            paths += [str(f) for f in bundle.parent.rglob("*") if f.is_file()]
        elif flat.exists():
            paths.append(str(flat))
        else:
            raise FileNotFoundError(slug)
    return G.commit(str(repo), message, paths)


def promote(root: Path, slug: str) -> Path:
    """A flat page becomes a bundle. Bad slugs are refused."""
    check_slug(slug)
    bundle = root / slug / "index.md"
    bundle.parent.mkdir(parents=True, exist_ok=True)
    (root / f"{slug}.md").rename(bundle)
    return bundle


def read_page(pages: DataFrame, slug: str) -> dict | None:
    """One page with a notice if another one supersedes it."""
    row = pages.filter(F.col("slug") == slug).limit(1).collect()
    if not row:
        return None
    by = (row[0]["fields"] or {}).get("superseded_by") or []
    return row[0].asDict() | {"notice": f"superseded by {by[0]}" if by else None}


def register_views(spark: SparkSession, pages: DataFrame, decls: DataFrame, config: Config = Config()) -> None:
    """Temp views pages, nodes and edges, and table functions over them, for SQL.

    backlinks_of(slug), neighbours_of(wiki, slug), pages_of(type), pages_with(field, value), tagged(tag).
    """
    pages.createOrReplaceTempView("pages")
    nodes, edges = graph.build(pages, decls)
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    page = "wiki STRING, slug STRING, title STRING"
    functions = {
        "backlinks_of(target STRING)": (page, "SELECT wiki, slug, title FROM pages WHERE array_contains(body_links, target)"),
        "pages_of(kind STRING)": (page, "SELECT wiki, slug, title FROM pages WHERE type = kind"),
        "pages_with(name STRING, val STRING)": (page, "SELECT wiki, slug, title FROM pages WHERE array_contains(try_element_at(fields, name), val)"),
        "tagged(tag STRING)": (page, "SELECT wiki, slug, title FROM pages WHERE array_contains(tags, tag)"),
        "neighbours_of(in_wiki STRING, of_slug STRING)": ("direction STRING, slug STRING, relation STRING", "SELECT 'out', dst, relation FROM edges WHERE wiki = in_wiki AND src = of_slug UNION ALL SELECT 'in', src, relation FROM edges WHERE wiki = in_wiki AND dst = of_slug"),
    }
    for head, (columns, query) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {query}")


class Corpus:
    """Operators over one page table by name, for scripts and notebooks; with a store, keyword search reads its postings."""

    def __init__(self, pages: DataFrame, config: Config = Config(), provider: Provider | None = None, store: Store | None = None, dictionary: dict[str, float] | None = None):
        self.pages, self.config, self.provider, self.store = pages, config, provider, store
        self.cut = cutter(config.tokenizer, dictionary)

    def search(self, query: str, mode: str = "keyword", **options) -> DataFrame:
        if mode == "keyword" and self.store is not None:
            found = self.batch([query], **options).drop("query_id")
            about = self.store.read("docs").select("wiki", "slug", "uri", "title", "type", "summary")
            return found.join(about, ["wiki", "slug"]).orderBy("rank").drop("rank")
        return search.entry(self.pages, query, mode, self.provider, self.config.search, **options)

    def batch(self, queries: list[str] | DataFrame, **options) -> DataFrame:
        """(query_id, rank, wiki, slug, score) of many queries in one job, from the store."""
        tables = (self.store.read(n) for n in ("postings", "term_stats", "corpus_stats"))
        return search.batch(*tables, queries, self.config.search, cut=self.cut, **options)

    def list(self, page: int = 1, **options) -> DataFrame:
        return listing.page_list(self.pages, page, self.config.search.page_size, **options)

    def types(self) -> DataFrame:
        """(value, n) of page types without sections, in order of name."""
        return search.facet(search.candidates(self.pages), "type").orderBy("value")

    def research(self, query: str) -> tuple[list, dict | None]:
        """Five best hits, and the best one read in full."""
        hits = self.search(query, k=5).collect()
        return hits, read_page(self.pages.filter(F.col("wiki") == hits[0].wiki), hits[0].slug) if hits else None

    def home(self, decls: DataFrame, commits: DataFrame, as_of: str) -> dict[str, DataFrame]:
        """What a start page shows: statistics, ten recent pages, fifteen commits."""
        return {"stats": quality.stats(self.pages, decls, as_of), "recent": listing.recent(self.pages, 10), "activity": listing.activity(commits, 15)}
