"""Registered queries of the operators for training text, and their SQL oracles."""

from __future__ import annotations

from tickloom.llm import bpe, chat, media, mixing, pieces, quality, repeats, simhash, token_files, toxicity

QUERIES = {
    "op1_curriculum_mix": mixing.op1_curriculum_mix,
    "op2_heap_tokens": bpe.op2_heap_tokens,
    "op3_chat_format": chat.op3_chat_format,
    "op4_simhash_bktree": simhash.op4_simhash_bktree,
    "op5_repeated_passages": repeats.op5_repeated_passages,
    "op6_sampled_pieces": pieces.op6_sampled_pieces,
    "op7_line_quality": quality.op7_line_quality,
    "op8_media_boxes": media.op8_media_boxes,
    "op9_conv_toxicity": toxicity.op9_conv_toxicity,
    "op10_token_parquet": token_files.op10_token_parquet,
}

ORACLES = {
    "op1_curriculum_mix": mixing.ORACLE,
    "op3_chat_format": chat.ORACLE,
}
