"""The registered queries of the corpus operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, common, lexicon, linefreq, piecebpe, prefixcount, quotes, rules, subwords, suffixes, survival, tokenfile, urls, whitening

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexicon.digests(lexicon.encode_decode(docs, public_tokenizers.path(TOKENIZER)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subwords.classify(docs, subwords.fit(docs, table(spark, sf_dir, "labels")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = common.shared_folder(spark, "tokens")
    manifest = tokenfile.write(docs, public_tokenizers.path(TOKENIZER), folder)
    return tokenfile.read_documents(manifest, folder, docs.schema["doc_id"].dataType.simpleString())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.report(table(spark, sf_dir, "documents"))


def op9_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prefixcount.digests(prefixcount.prefix_counts(docs, public_tokenizers.path(TOKENIZER)), TOKEN_LIMIT)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survival.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return piecebpe.digests(piecebpe.encode_decode(docs, public_tokenizers.path(PIECES)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_file": op7_token_file,
    "op8_line_dedup": op8_line_dedup,
    "op9_chat_threads": op9_chat_threads,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_sentence_pieces": op13_sentence_pieces,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": rules.ORACLE,
        "op8_line_dedup": linefreq.ORACLE,
        "op9_chat_threads": quotes.ORACLE,
        "op12_filter_audit": survival.ORACLE,
    }
