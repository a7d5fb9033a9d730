"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontamination import OP5_SQL, op5_decontamination
from .language_model import op1_language_model
from .line_dedup import OP7_SQL, op7_line_dedup
from .passages import op9_substring_dedup
from .quality_classifier import op4_quality_classifier
from .quality_rules import op2_quality_rules
from .simhash import op8_simhash
from .toxicity import op3_toxicity
from .warc import OP10_SQL, op10_warc


def queries() -> dict:
    own = (op1_language_model, op2_quality_rules, op3_toxicity, op4_quality_classifier, op5_decontamination, op6_bpe, op7_line_dedup, op8_simhash, op9_substring_dedup, op10_warc)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_warc": OP10_SQL}
