"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from wardline.llm import ann, chat, fim, jaccard, langid, mixing, neardup, packing, pii, repair, secrets, sharding, tokenids


def queries() -> dict:
    return {
        "op1_personal_data": pii.op1_personal_data,
        "op2_shard_documents": sharding.op2_shard_documents,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_secret_ledger": secrets.op4_secret_ledger,
        "op5_embedding_neardup": neardup.op5_embedding_neardup,
        "op6_pack_documents": packing.op6_pack_documents,
        "op7_language_id": langid.op7_language_id,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_token_ids": tokenids.op9_token_ids,
        "op10_nearest": ann.op10_nearest,
        "op11_format_chats": chat.op11_format_chats,
        "op12_repair_conversations": repair.op12_repair_conversations,
        "op13_fill_in_middle": fim.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard.SQL, "op5_embedding_neardup": neardup.SQL, "op10_nearest": ann.SQL, "op8_mix_sources": mixing.SQL, "op11_format_chats": chat.SQL, "op13_fill_in_middle": fim.SQL}
