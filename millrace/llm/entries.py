"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from millrace.llm import ann_scan, bpe, chat_format, chat_repair, fill_middle, language_mix, mpeg_audio, ngram_join, secret_scan, source_mix, substring_dedup, toxicity, url_filter
from millrace.llm.shared import table


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_join.ngram_jaccard(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op8_source_mix(spark, sf_dir):
    return source_mix.source_mix(table(spark, sf_dir, "documents"))


def op1_adaptive_scan(spark, sf_dir):
    return ann_scan.adaptive_scan(table(spark, sf_dir, "embeddings"))


def op2_chat_roundtrip(spark, sf_dir):
    return chat_format.chat_roundtrip(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_mix(spark, sf_dir):
    return language_mix.language_mix(table(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark, sf_dir):
    return mpeg_audio.mpeg_audio(table(spark, sf_dir, "documents"))


def op10_bpe_chunks(spark, sf_dir):
    return bpe.bpe_chunks(table(spark, sf_dir, "documents"))


def op11_chat_repair(spark, sf_dir):
    return chat_repair.structure_repair(table(spark, sf_dir, "conversations"))


def op12_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_adaptive_scan, op2_chat_roundtrip, op3_ngram_jaccard, op4_toxicity, op5_language_mix, op6_secret_scan, op7_substring_dedup, op8_source_mix, op9_mpeg_audio, op10_bpe_chunks, op11_chat_repair, op12_url_filter, op13_fill_middle)}
ORACLE = {"op2_chat_roundtrip": chat_format.SQL, "op3_ngram_jaccard": ngram_join.SQL, "op6_secret_scan": secret_scan.SQL, "op7_substring_dedup": substring_dedup.SQL, "op8_source_mix": source_mix.SQL, "op11_chat_repair": chat_repair.SQL, "op12_url_filter": url_filter.SQL, "op13_fill_middle": fill_middle.SQL}
