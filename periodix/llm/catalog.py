"""Registered queries of the subpackage: name -> builder, and the SQL of
those that SQL can express."""

from __future__ import annotations

from periodix.llm import (
    decontaminate, html_text, jaccard, langid, packing, quality, sharding, substrings, tokenalign, tokenfiles, toxicity, warc,
    whitening,
)

QUERIES = {
    "op1_layout_text": html_text.op1_layout_text,
    "op2_spaced_seeds": decontaminate.op2_spaced_seeds,
    "op3_cross_parsing": langid.op3_cross_parsing,
    "op4_line_frequency": quality.op4_line_frequency,
    "op5_arrow_sequences": tokenfiles.op5_arrow_sequences,
    "op6_byte_shards": sharding.op6_byte_shards,
    "op7_dictionary_warc": warc.op7_dictionary_warc,
    "op8_subsequence_svm": toxicity.op8_subsequence_svm,
    "op9_divide_skip": jaccard.op9_divide_skip,
    "op10_nnls_packing": packing.op10_nnls_packing,
    "op11_rolling_windows": substrings.op11_rolling_windows,
    "op12_dqds_whitening": whitening.op12_dqds_whitening,
    "op13_interval_alignment": tokenalign.op13_interval_alignment,
}

SQL = {
    "op9_divide_skip": jaccard.SQL,
    "op4_line_frequency": quality.SQL,
    "op6_byte_shards": sharding.SQL,
    "op7_dictionary_warc": warc.SQL,
    "op11_rolling_windows": substrings.SQL,
}

# further results of an operator above; the first query of a number is its own
MORE = {"op9_link_counts": jaccard.op9_link_counts}
MORE_SQL = {"op9_link_counts": jaccard.LINKS_SQL}
