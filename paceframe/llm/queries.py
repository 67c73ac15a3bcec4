"""The registered queries of the text operators, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from paceframe.llm.collocations import OP11_SQL, op11_collocations
from paceframe.llm.decontamination import op10_decontamination
from paceframe.llm.jaccard import OP9_SQL, op9_jaccard_join
from paceframe.llm.language_model import op2_language_model
from paceframe.llm.licenses import op1_license_scan
from paceframe.llm.line_dedup import OP8_SQL, op8_line_dedup
from paceframe.llm.packing import op7_best_fit_packing
from paceframe.llm.periodic_runs import op13_periodic_runs
from paceframe.llm.quality_classifier import op4_quality_classifier
from paceframe.llm.quality_rules import OP5_SQL, op5_quality_rules
from paceframe.llm.simhash import op12_simhash
from paceframe.llm.token_files import op6_token_files
from paceframe.llm.toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language_model, op3_toxicity, op4_quality_classifier, op5_quality_rules, op6_token_files, op7_best_fit_packing, op8_line_dedup, op9_jaccard_join, op10_decontamination, op11_collocations, op12_simhash, op13_periodic_runs)}
SQL: dict[str, str] = {"op5_quality_rules": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_jaccard_join": OP9_SQL, "op11_collocations": OP11_SQL}
