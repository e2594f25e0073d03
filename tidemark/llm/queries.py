"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chat, decontamination, html_text, jaccard, langid, lm, mixing, quality, repair, token_files, topk, warc

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_language_id": langid.op2_language_id,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_html_text": html_text.op4_html_text,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_warc": warc.op6_warc,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_chat": chat.op8_chat,
    "op9_token_files": token_files.op9_token_files,
    "op10_mixing": mixing.op10_mixing,
    "op11_repair": repair.op11_repair,
    "op12_top_k": topk.op12_top_k,
    "op13_centroids": centroids.op13_centroids,
    "quality_ablation": quality.quality_ablation,
}
SQL = {"op11_repair": repair.OP11_SQL, "op12_top_k": topk.OP12_SQL, "op13_centroids": centroids.OP13_SQL, "op7_ngram_jaccard": jaccard.OP7_SQL, "op3_decontamination": decontamination.OP3_SQL, "op5_quality_rules": quality.OP5_SQL, "quality_ablation": quality.ABLATION_SQL}
