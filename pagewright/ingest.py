"""Ingest: line ends, secrets, validation and the report, for a batch of files or a micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright import pipeline
from pagewright.functions import frontmatter as M
from pagewright.functions import text as X
from pagewright.operators.index import Store
from pagewright.operators.quality import edge_target_warnings
from pagewright.session import cut_lineage
from pagewright.sources import git
from pagewright.sources.markdown import read_files, to_pages
from pagewright.sources.schemas import Registry, validate_page

# Lines of a report that are listed one by one; the counts are of all.
REPORTED = 1000


def validate_udf(registry: Registry, strict: bool):
    found = T.ArrayType(T.StructType([T.StructField("severity", T.StringType()), T.StructField("message", T.StringType())]))

    @F.pandas_udf(found)
    def udf(block: pd.Series) -> pd.Series:
        return block.map(lambda b: [{"severity": s, "message": m} for s, m in validate_page(M.parse(b), registry, strict)])

    return udf


def ingest(files: DataFrame, registry: Registry, changed: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(path, slug, content, redacted, problems, unchanged) of files; content is what would be written.

    With a change set only the changed files are validated; an empty change set
    validates everything. Nothing is written here, so this is the dry run too.
    """
    rows = files.withColumn("content", X.normalise_lines(F.col("content")))
    first = F.when(rows["content"].rlike(r"(?s)^---\n"), F.size(F.split(M.yaml_block(F.col("content")), "\n")) + 3).otherwise(1)
    clean = X.redact_secrets(rows, "path", "content", first_line=first).withColumnRenamed("redacted", "content")
    out = clean.withColumns({"slug": X.slug_of_path(F.col("path")), "problems": validate_udf(registry, strict)(M.yaml_block(F.col("content")))})
    out = out.withColumnRenamed("matches", "redacted").withColumn("unchanged", F.lit(False))
    if changed is not None:
        marks = changed.select("path").distinct().withColumn("_c", F.lit(True))
        some = changed.agg((F.count(F.lit(1)) > 0).alias("_some"))  # one row
        out = out.join(marks, "path", "left").crossJoin(F.broadcast(some)).withColumn("unchanged", F.col("_some") & F.col("_c").isNull()).drop("_c", "_some")
        out = out.withColumn("problems", F.when(~F.col("unchanged"), F.col("problems")))
    return out.select("path", "slug", "content", "redacted", "problems", "unchanged")


def report(ingested: DataFrame) -> DataFrame:
    """(pages_validated, unchanged_count, errors, warnings, redactions): one row."""
    level = lambda s: F.sum(F.size(F.filter(F.coalesce("problems", F.array().cast("array<struct<severity:string,message:string>>")), lambda p: p["severity"] == s)))
    return ingested.agg(F.count_if(~F.col("unchanged")).alias("pages_validated"), F.count_if("unchanged").alias("unchanged_count"), level("error").alias("errors"), level("warning").alias("warnings"), F.sum(F.size("redacted")).alias("redactions"))


def written(ingested: DataFrame, root: str) -> DataFrame:
    """(path, slug) of the files that were rewritten below a root, each by the task that holds it: content that differs from what lies there, of pages without an error."""
    ok = ~F.exists(F.coalesce("problems", F.array().cast("array<struct<severity:string,message:string>>")), lambda p: p["severity"] == "error")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            done = []
            for row in p.itertuples():
                file = Path(root) / row.path
                old = file.read_bytes() if file.exists() else None
                if old != row.content.encode():
                    file.parent.mkdir(parents=True, exist_ok=True)
                    new = file.with_name(f".{file.name}.new")
                    new.write_bytes(row.content.encode())
                    new.replace(file)  # whole or not at all, also when a task runs again
                    done.append((row.path, row.slug))
            yield pd.DataFrame(done, columns=["path", "slug"])

    return ingested.filter(~F.col("unchanged") & ok).select("path", "slug", "content").mapInPandas(run, "path string, slug string")


def run(spark: SparkSession, repo: str, root: str, wiki: str, registry: Registry, store: Store | None = None, changed: DataFrame | None = None, strict: bool = False, dry_run: bool = False, message: str = "ingest") -> dict:
    """Ingests the files of a wiki: line ends, secrets, validation; unless dry_run, the files are rewritten and committed, the index gets a new version, and targets of a type that is not allowed are counted.

    The repository lies on a file system that all executors share.
    """
    plan = cut_lineage(ingest(read_files(spark, root), registry, changed, strict))
    out = report(plan).first().asDict()
    others = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path").filter(~F.col("path").endswith(".md"))
    out["assets_found"] = others.count()
    out["problems"] = [tuple(r) for r in plan.select("path", F.explode("problems").alias("p")).select("path", "p.severity", "p.message").orderBy("path", "severity", "message").limit(REPORTED).collect()]
    out["redacted"] = [tuple(r) for r in plan.select("path", F.explode("redacted").alias("m")).select("path", "m.pattern_name", "m.line_number").orderBy("path", "line_number").limit(REPORTED).collect()]
    out |= {"written": 0, "commit": "", "version": None, "target_warnings": 0}
    if dry_run:
        return out
    out["written"] = cut_lineage(written(plan, root)).count()
    out["commit"] = git.commit(repo, message, [root])
    pages = cut_lineage(to_pages(read_files(spark, root), wiki, registry))
    edges = spark.createDataFrame(registry.edge_rows(), "type string, field string, relation string, target_types array<string>")
    out["target_warnings"] = edge_target_warnings(pages, edges).count()
    if store is not None:
        out["version"] = store.write(pages, pipeline.state(pages, registry, git.head(repo)))
    return out
