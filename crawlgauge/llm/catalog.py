"""Registered queries of the subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from crawlgauge.llm.line_labels import op1_line_labels
from crawlgauge.llm.dimension_scan import op8_dimension_scan
from crawlgauge.llm.license_scan import OP4_SQL, op4_license_scan
from crawlgauge.llm.line_spread import OP5_SQL, op5_line_spread
from crawlgauge.llm.merge_automaton import op13_merge_automaton
from crawlgauge.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from crawlgauge.llm.mixing import op7_mixing
from crawlgauge.llm.near_copies import op3_near_copies
from crawlgauge.llm.packing import op2_best_fit_packing
from crawlgauge.llm.page_blocks import op10_page_blocks
from crawlgauge.llm.quality_grades import op9_quality_grades
from crawlgauge.llm.repeated_spans import op6_repeated_spans
from crawlgauge.llm.token_alignment import op11_token_alignment

QUERIES = {
    "op6_repeated_spans": op6_repeated_spans,
    "op8_dimension_scan": op8_dimension_scan,
    "op3_near_copies": op3_near_copies,
    "op10_page_blocks": op10_page_blocks,
    "op4_license_scan": op4_license_scan,
    "op5_line_spread": op5_line_spread,
    "op1_line_labels": op1_line_labels,
    "op7_mixing": op7_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op9_quality_grades": op9_quality_grades,
    "op11_token_alignment": op11_token_alignment,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_merge_automaton": op13_merge_automaton,
}

ORACLES: dict[str, str] = {"op4_license_scan": OP4_SQL, "op5_line_spread": OP5_SQL, "op12_merkle_manifest": OP12_SQL}
