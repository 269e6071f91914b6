"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bestfit, chat, decontaminate, divergence, gridjoin, hardneg, htmlmain, language, packing, pii, reputation, secrets, simhash


def queries() -> dict:
    return {
        "op1_html_main_text": htmlmain.op1_html_main_text,
        "op2_grid_join": gridjoin.op2_grid_join,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_pii": pii.op4_pii,
        "op5_pack_sequences": packing.op5_pack_sequences,
        "op6_chat_format": chat.op6_chat_format,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_language_id": language.op8_language_id,
        "op9_simhash_dedup": simhash.op9_simhash_dedup,
        "op10_url_reputation": reputation.op10_url_reputation,
        "op11_hard_negatives": hardneg.op11_hard_negatives,
        "op12_best_fit_packing": bestfit.op12_best_fit_packing,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_chat_format": chat.OP6_SQL,
        "op10_url_reputation": reputation.OP10_SQL,
        "op11_hard_negatives": hardneg.OP11_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
