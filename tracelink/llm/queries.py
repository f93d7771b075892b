"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can say the same."""

from tracelink.llm.alignment import op13_alignment
from tracelink.llm.ann import op3_rp_forest
from tracelink.llm.byte_bpe import op5_byte_bpe
from tracelink.llm.fim import op11_fim
from tracelink.llm.packing import op8_best_fit_packing
from tracelink.llm.ppm import op2_ppm
from tracelink.llm.quality_classifier import op7_quality_classifier
from tracelink.llm.quality_rules import op1_quality_rules
from tracelink.llm.secret_scan import op6_secret_scan
from tracelink.llm.simhash import op4_simhash
from tracelink.llm.suffix_dedup import op12_suffix_dedup
from tracelink.llm.token_counts import op10_token_counts
from tracelink.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_ppm": op2_ppm,
    "op3_rp_forest": op3_rp_forest,
    "op4_simhash": op4_simhash,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
    "op11_fim": op11_fim,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op9_url_filter": OP9_SQL}
