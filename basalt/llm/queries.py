"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, exact_topk, licenses, media_tiff, mixing, ngram_jaccard, quality, secrets, sentencepiece_codec, spelling, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_ngram_jaccard": ngram_jaccard.op3_ngram_jaccard,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secrets.op5_secrets,
    "op6_exact_topk": exact_topk.op6_exact_topk,
    "op7_media_tiff": media_tiff.op7_media_tiff,
    "op8_licenses": licenses.op8_licenses,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_spelling": spelling.op12_spelling,
    "op13_collocations": collocations.op13_collocations,
}

SQL: dict[str, str] = {
    "op3_ngram_jaccard": ngram_jaccard.OP3_SQL,
    "op5_secrets": secrets.OP5_SQL,
    "op6_exact_topk": exact_topk.OP6_SQL,
    "op8_licenses": licenses.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_decontamination": decontamination.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
