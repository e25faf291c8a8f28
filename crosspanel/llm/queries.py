"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import audit, codes, contamination, licences, lines, minmax, packing, pii, quality, repeats, rules, secrets, spots

QUERIES = {
    "op1_licence_paragraphs": licences.op1_licence_paragraphs,
    "op2_nnls_packing": packing.op2_nnls_packing,
    "op3_suffix_array_dedup": repeats.op3_suffix_array_dedup,
    "op4_simhash_decontamination": contamination.op4_simhash_decontamination,
    "op5_bilstm_crf": pii.op5_bilstm_crf,
    "op6_byte_convolution": quality.op6_byte_convolution,
    "op7_credential_linking": secrets.op7_credential_linking,
    "op8_minmax_near_dups": minmax.op8_minmax_near_dups,
    "op9_threshold_rules": rules.op9_threshold_rules,
    "op10_line_winnowing": lines.op10_line_winnowing,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_spot_signatures": spots.op12_spot_signatures,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE_SQL: dict[str, str] = {"op9_threshold_rules": rules.oracle(), "op11_vector_codes": codes.oracle(), "op13_filter_audit": audit.oracle()}
