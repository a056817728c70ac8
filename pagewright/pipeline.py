"""From Markdown files to an index version: full rebuild, partial and incremental update, and which of them is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import Config
from pagewright.operators import index as I
from pagewright.session import cut_lineage
from pagewright.sources.embeddings import Provider, embed
from pagewright.sources.markdown import read_files, skipped, to_pages
from pagewright.sources.schemas import Registry


def state(pages: DataFrame, registry: Registry, commit: str, config: Config = Config(), built: str = "") -> I.State:
    """What an index of these pages is built from."""
    n = I.count_pages(pages).first()
    dims = pages.agg(F.max(F.size("embedding"))).first()[0] if "embedding" in pages.columns else None
    return I.State(registry.hash(), commit, config.tokenizer, n["pages"], n["sections"], {t: registry.type_hash(t) for t in registry.types}, config.embedding.model, max(dims or 0, 0), built)


def embedded(pages: DataFrame, provider: Provider | None, config: Config) -> tuple[DataFrame, str]:
    """Pages with vectors, and a warning if the provider failed on some; without a provider, pages as they are."""
    if provider is None:
        return pages, ""
    vectors = cut_lineage(embed(pages, provider, config.embedding.batch_size, config.embedding.max_text_chars, degrade=True))
    failed = vectors.filter("embedding is null").count()
    kept = pages.withColumn("embedding", F.lit(None).cast("array<float>")) if "embedding" not in pages.columns else pages
    joined = kept.join(vectors.withColumnRenamed("embedding", "_v"), ["wiki", "slug"], "left").withColumn("embedding", F.coalesce("embedding", "_v")).drop("_v")
    return joined, f"no vectors for {failed} pages: the embedding provider failed" if failed else ""


def rebuild(spark: SparkSession, root: str, wiki: str, registry: Registry, store: I.Store, commit: str = "", provider: Provider | None = None, config: Config = Config(), dictionary: dict[str, float] | None = None, built: str = "") -> dict:
    """A new version from all files below a root."""
    files = read_files(spark, root)
    pages, warning = embedded(cut_lineage(to_pages(files, wiki, registry)), provider, config)
    pages = cut_lineage(pages)
    now = state(pages, registry, commit, config, built)
    version = store.write(pages, now, cut=I.cutter(config.tokenizer, dictionary))
    return {"action": "rebuild", "version": version, "pages": now.pages, "sections": now.sections, "skipped": skipped(files).count(), "warning": warning}


def update(spark: SparkSession, root: str, wiki: str, registry: Registry, store: I.Store, changed: DataFrame, commit: str = "", provider: Provider | None = None, config: Config = Config(), dictionary: dict[str, float] | None = None, built: str = "") -> dict:
    """A new version from the newest one and the changed files, (path, status) relative to the root."""
    fresh = to_pages(read_files(spark, root).join(changed.select("path"), "path", "left_semi"), wiki, registry)
    keys = changed.select(F.lit(wiki).alias("wiki"), F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/index$", "").alias("slug"), "status")
    # a flat page that became a bundle has both statuses; it is deleted only if no file of it is left
    last = keys.groupBy("wiki", "slug").agg(F.min(F.col("status") == "D").alias("gone")).withColumn("status", F.when(F.col("gone"), "D").otherwise("M"))
    return _merged(store, registry, I.apply_changes(store.read(), last, fresh), commit, provider, config, dictionary, built, "update")


def update_types(spark: SparkSession, root: str, wiki: str, registry: Registry, store: I.Store, types: list[str], commit: str = "", provider: Provider | None = None, config: Config = Config(), dictionary: dict[str, float] | None = None, built: str = "") -> dict:
    """A new version in which the pages of some types are read again."""
    fresh = to_pages(read_files(spark, root), wiki, registry)
    return _merged(store, registry, I.rebuild_types(store.read(), fresh, types), commit, provider, config, dictionary, built, "update_types")


def _merged(store: I.Store, registry: Registry, pages: DataFrame, commit: str, provider: Provider | None, config: Config, dictionary: dict[str, float] | None, built: str, action: str) -> dict:
    pages, warning = embedded(cut_lineage(pages), provider, config)
    pages = cut_lineage(pages)
    now = state(pages, registry, commit, config, built)
    return {"action": action, "version": store.write(pages, now, cut=I.cutter(config.tokenizer, dictionary)), "pages": now.pages, "sections": now.sections, "warning": warning}


def refresh(spark: SparkSession, root: str, wiki: str, registry: Registry, store: I.Store, commit: str = "", changed: DataFrame | None = None, **options) -> dict:
    """Does what is due: nothing, the changed files, the pages of changed types, or everything."""
    config = options.get("config", Config())
    old = store.state()
    now = I.State(registry.hash(), commit, config.tokenizer, 0, 0, {t: registry.type_hash(t) for t in registry.types}, config.embedding.model)
    due = I.staleness(old, now)
    if due == "current":
        return {"action": "none", "version": store.versions()[0]}
    if due == "types_changed":
        types = [t for t in {*old.types, *now.types} if old.types.get(t) != now.types.get(t)]
        if old.commit == commit:
            return update_types(spark, root, wiki, registry, store, sorted(types), commit, **options)
    elif due == "commit_changed" and changed is not None:
        return update(spark, root, wiki, registry, store, changed, commit, **options)
    return rebuild(spark, root, wiki, registry, store, commit, **options)
