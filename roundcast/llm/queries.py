"""The queries of the operators, with their SQL where SQL can say it."""

from roundcast.llm.decontaminate import OP2_SQL, op2_decontaminate
from roundcast.llm.line_crf import op9_quality
from roundcast.llm.line_runs import OP5_SQL, op5_line_dedup
from roundcast.llm.packing import op3_packing
from roundcast.llm.pieces import op13_sentencepiece
from roundcast.llm.quality_rules import OP6_SQL, op6_quality_rules
from roundcast.llm.ranked_search import OP11_SQL, op11_ranked_search
from roundcast.llm.simhash import op1_simhash
from roundcast.llm.source_audit import OP12_SQL, op12_source_audit
from roundcast.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from roundcast.llm.suffix_dedup import op7_suffix_dedup
from roundcast.llm.token_counts import op8_token_counts
from roundcast.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_decontaminate,
        op3_packing,
        op4_substring_dedup,
        op5_line_dedup,
        op6_quality_rules,
        op7_suffix_dedup,
        op8_token_counts,
        op9_quality,
        op10_warc,
        op11_ranked_search,
        op12_source_audit,
        op13_sentencepiece,
    )
}
ORACLE = {
    "op2_decontaminate": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op10_warc": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_source_audit": OP12_SQL,
}
