"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontamination
from .language_id import op5_language_id
from .language_model import op4_language_model
from .mixing import OP2_SQL, op2_mixing
from .passages import op9_passages
from .quality_rules import OP1_SQL, op1_quality_rules
from .revisits import OP6_SQL, op6_revisits
from .simhash import op10_simhash
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_model": op4_language_model,
        "op5_language_id": op5_language_id,
        "op6_revisits": op6_revisits,
        "op7_toxicity": op7_toxicity,
        "op8_decontamination": op8_decontamination,
        "op9_passages": op9_passages,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_mixing": OP2_SQL, "op6_revisits": OP6_SQL, "op8_decontamination": OP8_SQL}
