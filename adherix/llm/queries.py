"""Queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from adherix.llm import p1_overlap, p2_split, p3_provenance, p4_syntax, p5_neighbours, p6_leaks, p7_mix, p8_residue
from adherix.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: p1_overlap.found(table(s, d, "pairs")),
        "p1_report": lambda s, d: p1_overlap.report(table(s, d, "pairs")),
        "p2_found": lambda s, d: p2_split.found(table(s, d, "function_chunks")),
        "p2_pieces": lambda s, d: p2_split.split_oversized(table(s, d, "function_chunks")),
        "p3_found": lambda s, d: p3_provenance.found(table(s, d, "function_chunks"), table(s, d, "lib_files")),
        "p3_provenance": lambda s, d: p3_provenance.provenance(table(s, d, "function_chunks"), table(s, d, "lib_files")),
        "p4_found": lambda s, d: p4_syntax.found(table(s, d, "function_chunks")),
        "p4_rates": lambda s, d: p4_syntax.rates(table(s, d, "function_chunks")),
        "p5_found": lambda s, d: p5_neighbours.found(table(s, d, "pattern_index")),
        "p5_neighbours": lambda s, d: p5_neighbours.most_similar(table(s, d, "pattern_index")),
        "p6_found": lambda s, d: p6_leaks.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_report": lambda s, d: p6_leaks.report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_proximity": lambda s, d: p6_leaks.proximity(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id", "matched_words", "span"),
        "p7_mix": lambda s, d: p7_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p7_full_shares": lambda s, d: p7_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"), total_tokens=p7_mix.ALL)[1],
        "p7_exact_shares": lambda s, d: p7_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"), total_tokens=p7_mix.EXACT)[1],
        "p7_shares": lambda s, d: p7_mix.mix(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
        "p8_found": lambda s, d: p8_residue.found(table(s, d, "documents")),
        "p8_residue": lambda s, d: p8_residue.residue(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT chunk_id FROM (
              SELECT chunk_id, function_code, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) AS n
              FROM function_chunks WHERE chunk_id IS NOT NULL)
            WHERE n = 1 AND length(function_code) > 4000""",
    }
