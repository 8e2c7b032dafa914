"""The driver queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causelake.llm import backoff, bpe, decontaminate, html, mpeg, near_dup, quality, secrets, token_shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_layout": html.op1_html_layout,
    "op2_token_wavelet": token_shards.op2_token_wavelet,
    "op3_parity_sketch_join": near_dup.op3_parity_sketch_join,
    "op4_zstd_quality": quality.op4_zstd_quality,
    "op5_mpeg_audio": mpeg.op5_mpeg_audio,
    "op6_stupid_backoff": backoff.op6_stupid_backoff,
    "op7_noisy_or_toxicity": toxicity.op7_noisy_or_toxicity,
    "op8_numpy_bpe": bpe.op8_numpy_bpe,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op10_simhash_decontamination": decontaminate.op10_simhash_decontamination,
}

ORACLES: dict[str, str] = {
    "op6_stupid_backoff": backoff.ORACLE_SQL,
    "op9_secret_ledger": secrets.ORACLE_SQL,
}
