"""The registered queries of this subpackage: ``opN_<name>(spark, sf_dir)``.

Each reads its whole tables and derives the result columns from its operator's
real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import audit, chat, jaccard, lines, media, merkle, mixing, packing, simhash, sql, substrings, topk, toxicity, urls
from ledgerloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("""select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'),
                                         (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the least run said: later copies of every repeated run of non-blank lines."""
    return lines.line_report(table(spark, sf_dir, "documents"), min_words=1)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.self_search(table(spark, sf_dir, "embeddings"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.placed_media(table(spark, sf_dir, "documents"))


def media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser of ``op7`` finds in the web pages."""
    return media.page_report(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_url_filters": op4_url_filters,
    "op5_line_dedup": op5_line_dedup,
    "op5_line_dedup_whole": op5_line_dedup_whole,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_media_columns": op7_media_columns,
    "media_sequences": media_sequences,
    "op8_mixing": op8_mixing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": sql.OP3,
    "op4_url_filters": sql.OP4,
    "op5_line_dedup": sql.OP5_WHOLE,
    "op5_line_dedup_whole": sql.OP5_WHOLE,
    "op6_exact_top_k": sql.OP6,
    "op11_jaccard_join": sql.OP11,
    "op12_filter_audit": sql.OP12,
    "op13_merkle_manifest": sql.OP13,
}
