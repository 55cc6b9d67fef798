"""The subpackage's queries by name, and SQL for those that it can express."""

from __future__ import annotations

from . import alignment, audit, chunks, decontaminate, jaccard, joins_sql, language, lines, lines_sql, mixing, pieces, quality, tokens, toxicity, vectors

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_lines": lines.op2,
    "op3_chunks": chunks.op3,
    "op4_toxicity": toxicity.op4,
    "op5_jaccard": jaccard.op5,
    "op6_tokens": tokens.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_vectors": vectors.op8,
    "op9_language": language.op9,
    "op10_quality": quality.op10,
    "op11_alignment": alignment.op11,
    "op12_audit": audit.op12,
    "op13_pieces": pieces.op13,
}
SQL = {
    "op1_mixing": mixing.SQL,
    "op2_lines": lines_sql.SQL,
    "op5_jaccard": joins_sql.JACCARD,
    "op8_vectors": joins_sql.VECTORS,
    "op12_audit": audit.SQL,
}
