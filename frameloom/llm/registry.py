"""The queries of this subpackage by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from frameloom.llm import alignment, ann, bpe, kneser_ney, langid, licenses, packing, phrases, pii, prefixes, quality, repeats, simhash

OPERATORS = (
    packing.op1_packing,
    licenses.op2_license_scan,
    simhash.op3_simhash,
    ann.op4_nearest,
    repeats.op5_suffix_array,
    langid.op6_language_id,
    pii.op7_pii,
    bpe.op8_byte_bpe,
    quality.op9_quality,
    kneser_ney.op10_kneser_ney,
    phrases.op11_collocations,
    alignment.op12_alignment,
    prefixes.op13_token_counts,
)


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


#: SQL over all documents; the other queries have columns that SQL can't express, and tests hold them against brute force.
ORACLES = {"op2_license_scan": licenses.ORACLE_SQL, "op5_suffix_array": repeats.ORACLE_SQL, "op11_collocations": phrases.ORACLE_SQL}


def oracles() -> dict[str, str]:
    return ORACLES
