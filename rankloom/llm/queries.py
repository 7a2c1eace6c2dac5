"""Queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from rankloom.llm.decontaminate import op3_benchmark_decontamination
from rankloom.llm.html_text import op1_html_extraction
from rankloom.llm.jaccard import op7_ngram_jaccard_join
from rankloom.llm.neighbours import op2_nearest_neighbours
from rankloom.llm.oracles import oracle_sql
from rankloom.llm.packing import op10_best_fit_packing
from rankloom.llm.pii import op9_pii_pseudonyms
from rankloom.llm.ppm import op8_lm_scoring
from rankloom.llm.quality import op5_quality_classifier
from rankloom.llm.topk import op12_exact_topk
from rankloom.llm.toxicity import op4_toxicity
from rankloom.llm.url_filter import op6_url_filter
from rankloom.llm.whitening import op11_embedding_whitening

__all__ = ["oracle_sql", "queries"]


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_extraction, op2_nearest_neighbours, op3_benchmark_decontamination, op4_toxicity, op5_quality_classifier, op6_url_filter, op7_ngram_jaccard_join, op8_lm_scoring, op9_pii_pseudonyms, op10_best_fit_packing, op11_embedding_whitening, op12_exact_topk)}
