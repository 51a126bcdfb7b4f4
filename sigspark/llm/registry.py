"""The dealt operators' queries and their DuckDB oracles."""

from __future__ import annotations

import functools

from . import (alignment, chat, embed_dedup, exact_dedup, fingerprints, langid, lm_scoring, mixing, ngram_join,
               piece_lattice, quality, resampling, token_files)
from .common import ship


def _shipped(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    quality.op1_quality,
    ngram_join.op2_ngram_join,
    exact_dedup.op3_exact_dedup,
    token_files.op4_token_files,
    langid.op5_language_id,
    chat.op6_chat_formatting,
    mixing.op7_mixing,
    piece_lattice.op8_sentencepiece,
    lm_scoring.op9_lm_scoring,
    embed_dedup.op10_embedding_dedup,
    alignment.op11_alignment,
    fingerprints.op12_fingerprints,
    resampling.op13_resampling,
)}
ORACLE = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_embedding_dedup": embed_dedup.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
