"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from . import ann, bpe, chat, decontam, langid, linededup, quality, simhash, substring, warc


def op1_simhash_near_dedup(spark, sf_dir):
    out = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "fingerprint", "component_id")


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_nearest_neighbours": ann.op2_nearest_neighbours,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_warc": warc.op6_warc,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_line_dedup": linededup.op8_line_dedup,
        "op9_language_id": langid.op9_language_id,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontam.ORACLE, "op8_line_dedup": linededup.ORACLE}
