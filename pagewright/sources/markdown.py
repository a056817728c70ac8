"""Markdown trees as page tables, and the assets beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import frontmatter as M
from pagewright.functions import links as L
from pagewright.functions import text as X
from pagewright.sources.schemas import Registry


def read_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, content) below a root; path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return with_relative(files, root).select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified_at"))


def with_relative(files: DataFrame, root: str) -> DataFrame:
    base = root.removeprefix("file://").rstrip("/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    return files.withColumn("path", F.substring(plain, len(base) + 2, 1 << 20))


def to_pages(files: DataFrame, wiki: str, registry: Registry) -> DataFrame:
    """Page rows of (path, content). A path without a valid slug is skipped, as a root index is."""
    rows = files.withColumn("slug", X.slug_of_path(F.col("path"))).filter(X.valid_slug(F.col("slug")))
    folder = F.when(F.col("path").endswith("/index.md"), F.col("slug")).otherwise(F.regexp_replace("slug", r"/?[^/]+$", ""))
    text = X.normalise_lines(F.col("content"))
    parsed = rows.withColumns({"fm": M.page_udf(registry.kinds, registry.aliases)(M.yaml_block(text)), "body": M.strip(text), "_dir": folder})
    out = parsed.select(
        F.lit(wiki).alias("wiki"), "slug", F.concat(F.lit(f"wiki://{wiki}/"), "slug").alias("uri"), "fm.*", "body", L.body_links_udf("body", "_dir").alias("body_links"), "path"
    )
    return out.withColumn("len", X.bag_length().cast("int"))


def skipped(files: DataFrame) -> DataFrame:
    """Paths that make no page."""
    return files.filter(~F.coalesce(X.valid_slug(X.slug_of_path(F.col("path"))), F.lit(False))).select("path")


def resolve(slugs: DataFrame, files: DataFrame) -> DataFrame:
    """(slug, path): slug.md if there is one, else slug/index.md."""
    paths = files.select("path", X.slug_of_path(F.col("path")).alias("slug"), F.col("path").endswith("/index.md").cast("int").alias("rank"))
    return slugs.join(paths.groupBy("slug").agg(F.min_by("path", "rank").alias("path")), "slug", "left")


def assets(spark: SparkSession, root: str, wiki: str, slug: str) -> DataFrame:
    """(uri) of the files beside the index.md of a bundle."""
    files = with_relative(spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{slug}").select("path"), root)
    return files.filter(~F.col("path").endswith("/index.md")).select(F.concat(F.lit(f"wiki://{wiki}/"), "path").alias("uri")).orderBy("uri")
