"""Queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, hardneg, jaccard, langid, licenses, media, mixing, packing, panes, quality, sql, substrings, tokenfile, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.query,
    "op2_quality": quality.query,
    "op3_licenses": licenses.query,
    "op4_token_files": tokenfile.query,
    "op5_packing": packing.query,
    "op6_decontamination": decontam.query,
    "op7_substrings": substrings.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_toxicity": toxicity.query,
    "op10_language_id": langid.query,
    "op11_hard_negatives": hardneg.query,
    "op12_panes": panes.query,
    "op13_mixing": mixing.query,
}
ORACLES: dict[str, str] = {"op3_licenses": licenses.oracle(), "op6_decontamination": sql.DECONTAMINATION, "op7_substrings": sql.SUBSTRINGS, "op8_ngram_jaccard": sql.JACCARD, "op11_hard_negatives": sql.HARD_NEGATIVES, "op12_panes": sql.PANES}
