"""Queries of the training-data operators."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.layout_copies import layout_copies
from wordloom.llm.mixing import calibration, mix, mix_shares
from wordloom.llm.near_duplicates import near_duplicate_groups
from wordloom.llm.sequences import frequent_sequences
from wordloom.llm.set_pairs import similar_members, similar_pairs
from wordloom.llm.sql import P1_FOUND, P1_MEMBERS, P2_FOUND, P3_FOUND, P5_FOUND, P6_DECODED
from wordloom.llm.stuffing import stuffed_pages
from wordloom.llm.tokens import decode_corpus, encode_corpus
from wordloom.plans.registry import Registry
from wordloom.session import read_table

registry = Registry()


@registry.query("p1_found", P1_FOUND)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    workflows = read_table(spark, sf_dir, "workflows")
    return similar_pairs(workflows, "workflow_id", "prompt_shingles", "tool_shingles", share=(3, 5))


@registry.query("p1_members", P1_MEMBERS)
def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by workflow: its class of equal sets and its number of similar workflows."""
    workflows = read_table(spark, sf_dir, "workflows")
    return similar_members(workflows, "workflow_id", "prompt_shingles", "tool_shingles", share=(3, 5))


@registry.query("p2_found", P2_FOUND)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, sf_dir, "wiki_entries"), "id", "title", "content", size=3, share=0.6)


@registry.query("p3_found", P3_FOUND)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_copies(read_table(spark, sf_dir, "wiki_entries"), "id", "content", "tags")


@registry.query("p5_found", P5_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = read_table(spark, sf_dir, "transcript_digests")
    kinds = {"tool": F.col("tool_sequence"), "skill": F.col("skill_uses.skill")}
    tool, skill = (
        frequent_sequences(digests, "session_id", steps, Fraction(1, 10), 5).select(F.lit(kind).alias("kind"), "*")
        for kind, steps in kinds.items()
    )
    return tool.union(skill)


@registry.query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.query("p6_decoded", P6_DECODED)
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_corpus(encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@registry.query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = (read_table(spark, sf_dir, name) for name in ("documents", "mix_targets"))
    return mix(documents, targets, "doc_id", "text", "source")


@registry.query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = (read_table(spark, sf_dir, name) for name in ("documents", "mix_targets"))
    return mix_shares(documents, targets, "doc_id", "text", "source")


@registry.query("p7_calibration")
def p7_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out documents of each listed source beside the sum of their posteriors."""
    documents, targets = (read_table(spark, sf_dir, name) for name in ("documents", "mix_targets"))
    return calibration(documents, targets, "doc_id", "text", "source")


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (read_table(spark, sf_dir, name) for name in ("documents", "page_labels"))
    return stuffed_pages(documents, labels, "doc_id", "text", "is_spam", "lang")
