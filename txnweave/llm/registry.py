"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, bpe, conversations, decontaminate, lattice_lm, line_dedup, minhash, mixing, quality_rules, search, secrets, sharding, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_minhash": minhash.query,
        "op3_lattice_lm": lattice_lm.query,
        "op4_sharding": sharding.query,
        "op5_decontaminate": decontaminate.query,
        "op6_bpe": bpe.query,
        "op7_quality_rules": quality_rules.query,
        "op8_token_files": token_files.query,
        "op9_archives": archives.query,
        "op10_secrets": secrets.query,
        "op11_ranked_search": search.query,
        "op12_conversations": conversations.query,
        "op13_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op4_sharding": sharding.ORACLE_SQL,
        "op5_decontaminate": decontaminate.ORACLE_SQL,
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op9_archives": archives.ORACLE_SQL,
        "op11_ranked_search": search.ORACLE_SQL,
        "op13_mixing": mixing.ORACLE_SQL,
    }
