"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import embedding, extraction, lm, mixing, packing, quality, secrets, simhash, urls, warc


def queries() -> dict:
    return {
        "op1_mix": mixing.op1_mix, "op2_pack": packing.op2_pack, "op3_warc": warc.op3_warc, "op4_urls": urls.op4_urls, "op5_simhash": simhash.op5_simhash,
        "op6_lm": lm.op6_lm, "op7_secrets": secrets.op7_secrets, "op8_html": extraction.op8_html, "op9_quality": quality.op9_quality, "op10_embedding": embedding.op10_embedding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": mixing.ORACLE, "op3_warc": warc.ORACLE, "op4_urls": urls.ORACLE, "op7_secrets": secrets.ORACLE}
