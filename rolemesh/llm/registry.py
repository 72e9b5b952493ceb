"""The queries of this subpackage, for __spark_entry__."""

from __future__ import annotations

from rolemesh.llm import collocations, exact_topk, jaccard_join, lm_scoring, mixing, prefix_trie, quality_classifier, quality_rules, secret_scans, warc
from rolemesh.llm.packing import op4_packing
from rolemesh.llm.token_counts import op7_token_counts
from rolemesh.llm.token_files import op10_token_files

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": op4_packing,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_secret_scans": secret_scans.op6_secret_scans,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_exact_topk": exact_topk.op9_exact_topk,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_warc": warc.op12_warc,
    "op13_collocations": collocations.op13_collocations,
    "rule_ablation": quality_rules.rule_ablation,
    "secret_versions": secret_scans.secret_versions,
}
ORACLES = {"op11_prefix_trie": prefix_trie.ORACLE, "op12_warc": warc.ORACLE, "op13_collocations": collocations.ORACLE, "op2_quality_rules": quality_rules.ORACLE, "op9_exact_topk": exact_topk.ORACLE, "op6_secret_scans": secret_scans.ORACLE, "rule_ablation": quality_rules.ABLATION_ORACLE, "secret_versions": secret_scans.VERSIONS_ORACLE}
