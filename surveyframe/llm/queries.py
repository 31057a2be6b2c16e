"""The registered queries of this subpackage: each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.llm import oracles
from surveyframe.llm.chat import Template, chat_digests, format_chats
from surveyframe.llm.compress import code_report
from surveyframe.llm.decontaminate import contaminated_documents
from surveyframe.llm.html import extract_text
from surveyframe.llm.jaccard import jaccard_components
from surveyframe.llm.language import identify, learn
from surveyframe.llm.licenses import license_scan
from surveyframe.llm.negatives import hard_negatives
from surveyframe.llm.pieces import encode_documents
from surveyframe.llm.quality import quality_rules
from surveyframe.llm.storage import small_batches
from surveyframe.llm.substrings import substring_dedup
from surveyframe.llm.tokens import token_counts
from surveyframe.llm.warc import read_archives, resolve, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLES["op8_quality_rules"] = oracles.quality_sql()


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(read_archives(spark, write_archives(table(spark, sf_dir, "pages"))))


ORACLES["op2_warc_revisits"] = oracles.revisits_sql()


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLES["op1_jaccard_join"] = oracles.jaccard_sql()


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_substring_dedup"] = oracles.spans_sql()


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold control strings, formatted beside the given ones.
_CONTROL_CHAT = "(-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')"


@query
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(f"select bigint(c) as conv_id, bigint(t) as turn, r as role, x as text from values {_CONTROL_CHAT} v(c, t, r, x)")
    return chat_digests(format_chats(given.unionByName(own)))


ORACLES["op11_chat_format"] = oracles.chat_sql(Template(), _CONTROL_CHAT)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLES["op12_hard_negatives"] = oracles.NEGATIVES_SQL


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_codes"] = oracles.codes_sql()
