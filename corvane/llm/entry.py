"""The queries of this subpackage and their SQL."""

from corvane.llm.ann import op9_ann
from corvane.llm.chat_format import OP6_SQL, op6_chat_format
from corvane.llm.class_lm import op8_class_lm
from corvane.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from corvane.llm.license_scan import OP2_SQL, op2_license_scan
from corvane.llm.near_dedup import op7_near_dedup
from corvane.llm.packing import op5_packing
from corvane.llm.pii import op4_pii
from corvane.llm.quality_rules import OP3_SQL, op3_quality_rules
from corvane.llm.sentencepiece_scan import op10_sentencepiece
from corvane.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from corvane.llm.token_alignment import op11_token_alignment
from corvane.llm.token_counts import op1_token_counts

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_chat_format": op6_chat_format,
    "op7_near_dedup": op7_near_dedup,
    "op8_class_lm": op8_class_lm,
    "op9_ann": op9_ann,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {"op2_license_scan": OP2_SQL, "op3_quality_rules": OP3_SQL, "op6_chat_format": OP6_SQL, "op12_substring_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
