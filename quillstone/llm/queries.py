"""The queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from . import conversations, decontaminate, embeddings, html, manifest, mixing, pii, quality, sharding, simhash, substrings, tokens, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_warc": warc.op3_warc,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_substrings": substrings.op5_substrings,
    "op6_token_sstable": tokens.op6_token_sstable,
    "op7_html": html.op7_html,
    "op8_embeddings": embeddings.op8_embeddings,
    "op9_simhash": simhash.op9_simhash,
    "op10_quality": quality.op10_quality,
    "op11_manifest": manifest.op11_manifest,
    "op12_conversations": conversations.op12_conversations,
    "op13_sharding": sharding.op13_sharding,
}
ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_substrings": substrings.OP5_SQL,
    "op8_embeddings": embeddings.OP8_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op12_conversations": conversations.OP12_SQL,
    "op13_sharding": sharding.OP13_SQL,
}
