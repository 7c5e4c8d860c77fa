"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import ann, decontam, lengths, packing, quality, sharding, simhash, toxicity, urltree, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_decontamination": decontam.query,
    "op3_neighbours": ann.query,
    "op4_toxicity": toxicity.query,
    "op5_sharding": sharding.query,
    "op6_token_counts": lengths.query,
    "op7_simhash": simhash.query,
    "op8_url_templates": urltree.query,
    "op9_packing": packing.query,
    "op10_warc": warc.query,
}

ORACLES = {"op2_decontamination": decontam.ORACLE, "op10_warc": warc.ORACLE}
