"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import ann, collocations, decontaminate, filter_audit, fingerprints, html_text, langid, linedup, neardup, packing, sstable, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_langid": langid.op2_langid,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ann": ann.op5_ann,
    "op6_sstable": sstable.op6_sstable,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_html_text": html_text.op8_html_text,
    "op9_neardup": neardup.op9_neardup,
    "op10_linedup": linedup.op10_linedup,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES: dict[str, str] = {"op3_decontaminate": decontaminate.SQL, "op7_url_filter": url_filter.SQL, "op9_neardup": neardup.SQL, "op10_linedup": linedup.SQL, "op12_filter_audit": filter_audit.SQL, "op13_collocations": collocations.SQL}
