"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat, decontam, licenses, mixing, near_dup, pii, quality, sharding, url_rules

QUERIES = {
    "op1_pseudonyms": pii.op1_pseudonyms,
    "op2_quality": quality.op2_quality,
    "op3_url_filter": url_rules.op3_url_filter,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_nearest": ann.op5_nearest,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_near_duplicates": near_dup.op7_near_duplicates,
    "op8_format_chats": chat.op8_format_chats,
    "op9_shard": sharding.op9_shard,
    "op10_mix_sources": mixing.op10_mix_sources,
}
SQL = {
    "op3_url_filter": url_rules.OP3_SQL,
    "op6_license_scan": licenses.OP6_SQL,
    "op7_near_duplicates": near_dup.OP7_SQL,
    "op8_format_chats": chat.OP8_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
}
