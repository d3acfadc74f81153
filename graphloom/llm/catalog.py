"""The subpackage's queries and their SQL, as registered in __spark_entry__.py."""

from __future__ import annotations

from graphloom.llm import chat, contextmix, media, mixing, mtree, neardup, ngram_join, packing, pointintime, quality, resampling, secrets, sharding

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_media_columns": media.op3_media_columns,
    "op4_minhash_dedup": neardup.op4_minhash_dedup,
    "op5_lm_scoring": contextmix.op5_lm_scoring,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_exact_topk": mtree.op9_exact_topk,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_ngram_jaccard_join": ngram_join.op11_ngram_jaccard_join,
    "op12_target_resampling": resampling.op12_target_resampling,
    "op13_point_in_time": pointintime.op13_point_in_time,
}
SQL = {"op4_minhash_dedup": neardup.OP4_SQL, "op8_chat_formatting": chat.OP8_SQL, "op9_exact_topk": mtree.OP9_SQL, "op10_secret_scans": secrets.OP10_SQL, "op11_ngram_jaccard_join": ngram_join.OP11_SQL, "op12_target_resampling": resampling.OP12_SQL, "op13_point_in_time": pointintime.OP13_SQL}
