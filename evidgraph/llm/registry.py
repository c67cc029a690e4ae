"""What the entry module registers for this subpackage."""

from __future__ import annotations

from . import decontam, html_extract, line_dedup, mixing, near_dup, pii, quality, sharding, suffix_dedup, warc

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_tensored_minhash": near_dup.op2_tensored_minhash,
    "op3_bucket_refinement": suffix_dedup.op3_bucket_refinement,
    "op4_quality_forest": quality.op4_quality_forest,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_jump_shards": sharding.op6_jump_shards,
    "op7_personal_data": pii.op7_personal_data,
    "op8_warc_round_trip": warc.op8_warc_round_trip,
    "op9_fair_mix": mixing.op9_fair_mix,
    "op10_recurrent_extract": html_extract.op10_recurrent_extract,
}
ORACLES = {
    "op3_bucket_refinement": suffix_dedup.SQL,
    "op1_decontaminate": decontam.SQL,
    "op2_tensored_minhash": near_dup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op6_jump_shards": sharding.SQL,
    "op8_warc_round_trip": warc.SQL,
    "op9_fair_mix": mixing.SQL,
}
