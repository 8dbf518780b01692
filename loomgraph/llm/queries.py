"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, htmltext, langid, linededup, neardup, pieces, pii, quality, simhash


def queries() -> dict:
    return {
        "op1_html_text": htmltext.op1_html_text,
        "op2_simhash": simhash.op2_simhash,
        "op3_chat": chat.op3_chat,
        "op4_line_templates": linededup.op4_line_templates,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_pii": pii.op6_pii,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_language_id": langid.op8_language_id,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_pieces": pieces.op10_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op4_line_templates": linededup.OP4_SQL, "op5_near_duplicates": neardup.OP5_SQL, "op9_decontaminate": decontaminate.OP9_SQL}
