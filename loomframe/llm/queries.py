"""Queries of the training-data operators, one for each, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, embeddings, linededup, mixing, pii, quality, repetition, simhash, urlfilter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_pii": pii.op2_pii,
    "op3_chat": chat.op3_chat,
    "op4_mixing": mixing.op4_mixing,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_repetition": repetition.op7_repetition,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_url_filter": urlfilter.op10_url_filter,
}

ORACLE_SQL = {
    "op3_chat": chat.ORACLE,
    "op5_embeddings": embeddings.ORACLE,
    "op7_repetition": repetition.ORACLE,
    "op10_url_filter": urlfilter.ORACLE,
}
