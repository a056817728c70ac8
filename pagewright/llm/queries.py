"""Queries of the llm operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language, leakage, lookalike, neighbors, packing, redact, split
from pagewright.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose body has to be split."""
    pieces = split.split_oversized(table(spark, sf_dir, "corpus_pages"), table(spark, sf_dir, "embed_config"), with_text=False)
    return pieces.filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 1)).select("rev_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body as ordered pieces with text."""
    return split.split_oversized(table(spark, sf_dir, "corpus_pages"), table(spark, sf_dir, "embed_config"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a body with each kind of personal data that it holds."""
    return redact.find_personal_data(table(spark, sf_dir, "corpus_pages"), table(spark, sf_dir, "redact_types")).distinct()


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each match, with its pseudonym and the link that equal values share.

    The key is spark.pagewright.pseudonymKey; where it is unset, a key that is
    thrown away with the plan, so that links hold within one run and nobody can
    restore the values.
    """
    key = spark.conf.get("spark.pagewright.pseudonymKey", None) or secrets.token_hex(32)
    return redact.personal_records(table(spark, sf_dir, "corpus_pages"), table(spark, sf_dir, "redact_types"), key)


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body with placeholders."""
    return redact.redact_bodies(table(spark, sf_dir, "corpus_pages"), table(spark, sf_dir, "redact_types"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose title or body look the same but differ."""
    return lookalike.equal_look_pairs(table(spark, sf_dir, "corpus_pages"))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every title and body."""
    return lookalike.with_skeletons(table(spark, sf_dir, "corpus_pages").select("rev_id", "title", "body")).select("rev_id", "title_form", "body_form")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each look that several strings share."""
    return lookalike.look_classes(table(spark, sf_dir, "corpus_pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows one of which is among the five most similar of the other."""
    return neighbors.neighbour_pairs(table(spark, sf_dir, "corpus_pages"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar rows of every usable row, with similarity and rank."""
    return neighbors.nearest(table(spark, sf_dir, "corpus_pages"))


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every capacity; copies of a text never share one."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), TOKENIZER)


def p6_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents of one source in different containers too."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"), TOKENIZER, one_per_source=True)


def p6_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused room of each capacity."""
    return packing.utilisation(p6_packed(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of evaluation items."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents with a missing or wrong label or more than one language."""
    return language.language_cases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all documents with language and confidence."""
    return language.language_segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of all documents, and what their labels name."""
    return language.document_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_records, p2_bodies, p3_found, p3_forms, p3_classes, p4_found, p4_nearest, p6_packed, p6_by_source, p6_utilisation, p7_found, p8_found, p8_segments, p8_documents)}

ORACLE_SQL = {
    "p1_found": """
select rev_id from corpus_pages left join (select wiki, max(max_text_chars) as m from embed_config group by wiki) using (wiki)
where length(body) > case when m > 0 then m else 4000 end
""",
}
