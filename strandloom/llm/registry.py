"""The queries of these operators, and their SQL where there is one."""

from __future__ import annotations

from . import chat, decontaminate, html_text, lm_score, media, mixing, negatives, order_minhash, pii, quality, runs, simhash, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_mixing": mixing.op2_mixing,
    "op3_pii": pii.op3_pii,
    "op4_quality": quality.op4_quality,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_warc": warc.op6_warc,
    "op7_simhash": simhash.op7_simhash,
    "op8_media": media.op8_media,
    "op9_html": html_text.op9_html,
    "op10_chat": chat.op10_chat,
    "op11_order_minhash": order_minhash.op11_order_minhash,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLE_SQL = {"op1_decontamination": decontaminate.ORACLE, "op6_warc": warc.ORACLE, "op10_chat": chat.ORACLE, "op12_hard_negatives": negatives.ORACLE}
