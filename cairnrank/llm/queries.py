"""The registry of this subpackage: queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from cairnrank.llm.decontaminate import OP8_SQL, op8_decontamination
from cairnrank.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from cairnrank.llm.language_id import op7_language_id
from cairnrank.llm.mixing import op5_mixing
from cairnrank.llm.near_dedup import OP4_SQL, op4_near_dedup
from cairnrank.llm.quality import op10_quality
from cairnrank.llm.suffix_dedup import op3_suffix_dedup
from cairnrank.llm.token_counts import op2_token_counts
from cairnrank.llm.token_output import op6_token_output
from cairnrank.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_output": op6_token_output,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
}
ORACLE_SQL = {
    "op4_near_dedup": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
}
