"""The corpus operators as named queries over the given tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import decontamination, infill, licenses, lines, minhash, mixing, packing, periods, pii, quality, sharding, substrings, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in [
        minhash.op1_near_duplicates,
        mixing.op2_source_mixture,
        licenses.op3_license_notices,
        quality.op4_importance_resampling,
        tokens.op5_packed_tokens,
        lines.op6_line_labels,
        pii.op7_surrogates,
        decontamination.op8_benchmark_hits,
        sharding.op9_stratified_interleaving,
        substrings.op10_repeated_passages,
        packing.op11_packed_sequences,
        periods.op12_periodic_runs,
        infill.op13_fill_in_middle,
    ]
}

ORACLES: dict[str, str] = {
    "op1_near_duplicates": minhash.OP1_SQL,
    "op8_benchmark_hits": decontamination.OP8_SQL,
    "op9_stratified_interleaving": sharding.OP9_SQL,
    "op10_repeated_passages": substrings.OP10_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
