"""Registered queries of the package: one for each operator, over the whole of its table."""

from quern.llm.bpe import op7_bpe
from quern.llm.conversations import op12_conversation_repair
from quern.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from quern.llm.license_scan import OP1_SQL, op1_license_scan
from quern.llm.line_dedup import OP2_SQL, op2_line_dedup
from quern.llm.lm_scoring import OP10_SQL, op10_lm_scoring
from quern.llm.mixing import op4_mixing
from quern.llm.packing import op11_packing
from quern.llm.quality_model import op6_quality_classifier
from quern.llm.quality_rules import OP3_SQL, op3_quality_rules
from quern.llm.simhash import op8_simhash_near_dedup
from quern.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from quern.llm.winnowing import op5_fingerprints

_ALL = (op1_license_scan, op2_line_dedup, op3_quality_rules, op4_mixing, op5_fingerprints, op6_quality_classifier, op7_bpe, op8_simhash_near_dedup, op9_substring_dedup, op10_lm_scoring, op11_packing, op12_conversation_repair, op13_hard_negatives)
QUERIES = {q.__name__: q for q in _ALL}
ORACLES: dict[str, str] = {"op1_license_scan": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_quality_rules": OP3_SQL, "op9_substring_dedup": OP9_SQL, "op10_lm_scoring": OP10_SQL, "op13_hard_negatives": OP13_SQL}
