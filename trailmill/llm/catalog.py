"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from . import arc_warc, chat_format, decontaminate, fill_middle, language_id, merkle, minhash, oracles, packing, quality_rules, secret_scan, simhash, substring_dedup, token_counts
from .common import table


def queries() -> dict:
    documents = lambda digest: lambda spark, sf_dir: digest(table(spark, sf_dir, "documents"))
    return {
        "op1_substring_dedup": documents(substring_dedup.digest),
        "op2_language_id": lambda spark, sf_dir: language_id.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")),
        "op3_decontaminate": lambda spark, sf_dir: decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op4_token_counts": documents(token_counts.digest),
        "op5_secret_scan": documents(secret_scan.digest),
        "op6_packing": documents(packing.digest),
        "op7_chat_format": lambda spark, sf_dir: chat_format.digest(table(spark, sf_dir, "conversations")),
        "op8_quality_rules": documents(quality_rules.digest),
        "op9_arc_warc": lambda spark, sf_dir: arc_warc.digest(table(spark, sf_dir, "pages")),
        "op10_simhash": documents(simhash.digest),
        "op11_fill_middle": documents(fill_middle.digest),
        "op12_minhash": documents(minhash.digest),
        "op13_merkle": documents(merkle.digest),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op7_chat_format": oracles.OP7, "op9_arc_warc": oracles.OP9, "op11_fill_middle": oracles.OP11, "op12_minhash": oracles.OP12, "op13_merkle": oracles.OP13}
