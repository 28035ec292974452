"""The registered queries of this subpackage and their SQL, where SQL can say it."""

from __future__ import annotations

from . import embed_join, langid, licenses, ngram_join, oracles, packing, phrase_dedup, pieces, quality, substring_dedup, token_output
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_embedding_join(spark, sf_dir):
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_output(spark, sf_dir):
    import public_tokenizers

    return token_output.training_order(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return phrase_dedup.digests(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op")}


def oracle_sql() -> dict:
    return dict(oracles.SQL)
