"""Registered queries of the subpackage, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from gazette.llm import (chat, exact_topk, host_rules, license_scan, mixing, near_dedup, packing, prefix_trie,
                         quality_knn, secret_scan, spelling, token_files, url_filter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fns = [packing.op1_packing, host_rules.op2_host_rules, mixing.op3_mixing, exact_topk.op4_exact_topk, license_scan.op5_license_scan,
           secret_scan.op6_secret_scan, near_dedup.op7_near_dedup, url_filter.op8_url_filter, token_files.op9_token_files, chat.op10_reply_trees,
           prefix_trie.op11_prefix_trie, quality_knn.op12_quality_knn, spelling.op13_spelling]
    return {f.__name__: f for f in fns} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op2_host_rules": host_rules.ORACLE_SQL, "op3_mixing": mixing.ORACLE_SQL, "op4_exact_topk": exact_topk.ORACLE_SQL,
           "op5_license_scan": license_scan.ORACLE_SQL, "op7_near_dedup": near_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL, "op13_spelling": spelling.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in sql.items() if v}
