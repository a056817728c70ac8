"""Page table, postings and statistics: build, incremental update, versions on disk."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagewright.functions import text as X

KEY = ["wiki", "slug"]


def current_pages(deliveries: DataFrame) -> DataFrame:
    """The newest delivery of each page, by indexed_at and then rev_id. Rank-limited before the shuffle."""
    newest = W.partitionBy(*KEY).orderBy(F.desc_nulls_last("indexed_at"), F.desc("rev_id"))
    return deliveries.filter(F.col("slug").isNotNull()).withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def postings(pages: DataFrame, cut: Callable[[Column], Column] = X.tokens) -> DataFrame:
    """(wiki, slug, term, tf); cut makes the tokens of a text."""
    return X.weighted_bag(pages, cut=cut)


def cutter(tokenizer: str, dictionary: dict[str, float] | None = None) -> Callable[[Column], Column]:
    """How a tokenizer of the configuration makes tokens: Han characters one by one, or by the words of a dictionary where one is given."""
    return X.dictionary_tokens(dictionary) if X.mode(tokenizer) == "dictionary" and dictionary else X.tokens


def term_stats(posted: DataFrame, per_wiki: bool = False) -> DataFrame:
    """([wiki,] term, df): pages that hold a term."""
    return posted.groupBy(*(["wiki"] if per_wiki else []), "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(pages: DataFrame, per_wiki: bool = False) -> DataFrame:
    """([wiki,] n, total_len, avg_len); an empty corpus has averages of 0."""
    sized = pages.select(*KEY, X.bag_length().alias("len"))
    grouped = sized.groupBy("wiki") if per_wiki else sized.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def apply_changes(pages: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Pages after a change set of (wiki, slug, status): deleted and changed keys leave, the fresh rows of keys that are not deleted come in."""
    keys = changed.select(*KEY).distinct()
    gone = changed.filter("status = 'D'").select(*KEY).distinct()
    incoming = fresh.join(keys, KEY, "left_semi").join(gone, KEY, "left_anti")
    return pages.join(keys, KEY, "left_anti").unionByName(incoming, allowMissingColumns=True)


def last_changes(path_changes: DataFrame) -> DataFrame:
    """(wiki, slug, status): last status of each slug by changed_at and change_id; both paths of a slug count."""
    slug = X.slug_of_path(F.regexp_replace("path", r"^wiki/", ""))
    per = path_changes.select("wiki", slug.alias("slug"), "status", "changed_at", "change_id").filter("slug is not null")
    return per.groupBy(*KEY).agg(F.max_by("status", F.struct("changed_at", "change_id")).alias("status"))


def merge_change_sources(committed: DataFrame, worktree: DataFrame) -> DataFrame:
    """(path, status) of both scans; the working tree wins."""
    w = worktree.select("path", F.col("status").alias("w"))
    return committed.select("path", F.col("status").alias("c")).join(w, "path", "full_outer").select("path", F.coalesce("w", "c").alias("status"))


@dataclass(frozen=True)
class State:
    """What an index version was built from."""

    schema_hash: str
    commit: str
    tokenizer: str
    pages: int
    sections: int
    types: dict
    embedding_model: str = ""
    embedding_dims: int = 0
    built: str = ""


def staleness(built: State | None, now: State) -> str:
    """full_rebuild_needed, types_changed, commit_changed or current."""
    if built is None or built.tokenizer != now.tokenizer or built.embedding_model != now.embedding_model:
        return "full_rebuild_needed"
    if built.schema_hash != now.schema_hash:
        return "types_changed" if built.types != now.types else "full_rebuild_needed"
    return "current" if built.commit == now.commit else "commit_changed"


def count_pages(pages: DataFrame) -> DataFrame:
    """(pages, sections)."""
    return pages.agg(F.count_if(F.coalesce(F.col("type"), F.lit("")) != "section").alias("pages"), F.count_if(F.col("type") == "section").alias("sections"))


def rebuild_types(pages: DataFrame, scanned: DataFrame, types: list[str]) -> DataFrame:
    """Pages of the given types come from the new scan, all others stay."""
    some = F.coalesce(F.col("type"), F.lit("")).isin(types)
    return pages.filter(~some).unionByName(scanned.filter(some), allowMissingColumns=True)


class Versions:
    """Versions of a set of tables in a shared folder: a folder each, complete once its state file is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[int]:
        """Complete versions, newest first."""
        if not self._fs.exists(self._path("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))]
        return sorted((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{n}/state.json"))), reverse=True)

    def _next(self) -> int:
        return (self.versions() or [0])[0] + 1

    def _finish(self, version: int, state: dict, keep: int) -> None:
        """Writes the state file last, then drops what is older than the newest keep versions."""
        out = self._fs.create(self._path(f"v{version}/state.json"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        for old in self.versions()[keep:]:
            self._fs.delete(self._path(f"v{old}"), True)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"nothing in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/v{version or found[0]}/{name}")

    def state_of(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/v{version}/state.json", wholetext=True).first()[0])


class Store(Versions):
    """Versions of an index: pages, and for search postings by term with what ranking needs of a page, document frequencies, and statistics."""

    def write(self, pages: DataFrame, state: State, keep: int = 3, cut: Callable[[Column], Column] = X.tokens) -> int:
        """A new version: postings clustered by term, so that a query's terms prune row groups; older ones beyond keep go."""
        v = self._next()
        base = f"{self.folder}/v{v}"
        pages.write.mode("overwrite").partitionBy("wiki").parquet(f"{base}/pages")
        stored = self.spark.read.parquet(f"{base}/pages")
        docs = stored.select("wiki", "slug", "uri", "title", "summary", "type", "status", "confidence", X.bag_length(cut).alias("len"))
        docs.write.parquet(f"{base}/docs")
        docs = self.spark.read.parquet(f"{base}/docs")
        posted = postings(stored, cut).join(docs.select("wiki", "slug", "type", "status", "confidence", "len"), KEY)
        posted.repartitionByRange("term", "wiki", "slug").sortWithinPartitions("term").write.parquet(f"{base}/postings")
        term_stats(self.spark.read.parquet(f"{base}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/term_stats")
        docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len")).write.parquet(f"{base}/corpus_stats")
        self._finish(v, asdict(state), keep)
        return v

    def read(self, name: str = "pages", version: int | None = None) -> DataFrame:
        return super().read(name, version)

    def state(self) -> State | None:
        found = self.versions()
        return State(**self.state_of(found[0])) if found else None

    def status(self, now: State) -> dict:
        """Whether the index can be read, is stale against now, and what it holds."""
        built = self.state()
        pages = built and self.read().limit(1).count() >= 0
        return {
            "openable": built is not None, "queryable": bool(pages), "stale": staleness(built, now) != "current", "built": built.built if built else None,
            "pages": built.pages if built else 0, "sections": built.sections if built else 0, "embedding_model": built.embedding_model if built else "", "embedding_dims": built.embedding_dims if built else 0,
        }


class GraphStore(Versions):
    """Snapshots of the graph and its communities by commit; the newest keep stay."""

    def write(self, nodes: DataFrame, edges: DataFrame, commit: str, communities: DataFrame | None = None, keep: int = 3) -> int:
        v = self._next()
        for name, df in (("nodes", nodes), ("edges", edges), ("communities", communities)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{self.folder}/v{v}/{name}")
        self._finish(v, {"commit": commit, "communities": communities is not None}, keep)
        return v

    def load(self, commit: str | None = None) -> tuple[DataFrame, DataFrame] | None:
        """(nodes, edges) of a commit, or of the newest snapshot that can be read; null if there is none."""
        for v in self.versions():
            if commit is None or self.state_of(v)["commit"] == commit:
                try:
                    return self.read("nodes", v), self.read("edges", v)
                except AnalysisException:  # a broken snapshot: an older one serves
                    continue
        return None

    def graph(self, commit: str, build: Callable[[], tuple[DataFrame, DataFrame]], communities: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """The graph of a commit, built and kept if it is not there yet. Filtered graphs are not for this cache."""
        found = self.load(commit)
        if found is None:
            nodes, edges = build()
            self.write(nodes, edges, commit, communities(nodes, edges) if communities else None)
            found = self.load(commit)
        return found

    def communities(self, commit: str) -> DataFrame | None:
        """(wiki, slug, community) as kept for a commit."""
        for v in self.versions():
            state = self.state_of(v)
            if state["commit"] == commit and state["communities"]:
                return self.read("communities", v)
        return None


def schema_hash(types: dict) -> str:
    return hashlib.sha256(json.dumps(types, sort_keys=True).encode()).hexdigest()
