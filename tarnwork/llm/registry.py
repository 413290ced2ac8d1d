"""Queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tarnwork.llm import decontaminate, divergence, line_dedup, ngram_join, packing, quality, sharding, spelling, suffix_dedup, token_files, topk, url_filter, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_sharding": sharding.query,
    "op4_url_filter": url_filter.query,
    "op5_ngram_join": ngram_join.query,
    "op6_topk": topk.query,
    "op7_decontamination": decontaminate.query,
    "op8_line_dedup": line_dedup.query,
    "op9_quality": quality.query,
    "op10_warc": warc.query,
    "op11_divergence": divergence.query,
    "op12_token_files": token_files.query,
    "op13_spelling": spelling.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op6_topk": topk.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_divergence": divergence.SQL,
    "op13_spelling": spelling.SQL,
}
