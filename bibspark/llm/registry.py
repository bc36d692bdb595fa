"""The registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from bibspark.llm.ann import op10_ann
from bibspark.llm.bpe import op3_bpe
from bibspark.llm.chat import ORACLE as CHAT
from bibspark.llm.chat import op4_chat
from bibspark.llm.decontaminate import ORACLE as DECONTAMINATE
from bibspark.llm.decontaminate import op9_decontaminate
from bibspark.llm.license_scan import BASE_ORACLE as LICENSE_BASE
from bibspark.llm.license_scan import license_base, op8_license
from bibspark.llm.merkle import ORACLE as MERKLE
from bibspark.llm.merkle import op11_merkle
from bibspark.llm.periodic import op12_runs
from bibspark.llm.quality import op6_quality
from bibspark.llm.quality_rules import BASE_ORACLE as RULES_BASE
from bibspark.llm.quality_rules import op13_rules, rules_base
from bibspark.llm.simhash import op5_simhash
from bibspark.llm.substrings import op1_substrings
from bibspark.llm.toxicity import op2_toxicity
from bibspark.llm.warc import ORACLE as WARC
from bibspark.llm.warc import op7_warc

QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_license": op8_license,
    "op9_decontaminate": op9_decontaminate,
    "op10_ann": op10_ann,
    "op11_merkle": op11_merkle,
    "op12_runs": op12_runs,
    "op13_rules": op13_rules,
    "license_base": license_base,
    "rules_base": rules_base,
}

ORACLES: dict[str, str] = {
    "op4_chat": CHAT,
    "op7_warc": WARC,
    "op9_decontaminate": DECONTAMINATE,
    "op11_merkle": MERKLE,
    "license_base": LICENSE_BASE,
    "rules_base": RULES_BASE,
}
