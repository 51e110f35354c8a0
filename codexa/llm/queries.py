"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audit import OP11_SQL, op11_filter_audit
from .bpe import op7_bpe
from .jaccard import op10_ngram_jaccard
from .lines import OP9_SQL, op9_quality_rules
from .mixing import OP6_SQL, op6_mix_sources
from .quality import op5_quality
from .recursive_bpe import op13_recursive_bpe
from .telephony import op4_telephony
from .toxicity import op1_toxicity
from .training_order import op2_training_order
from .urlfilter import OP3_SQL, op3_url_filter
from .variants import OP12_SQL, op12_spelling_variants
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_training_order": op2_training_order,
    "op3_url_filter": op3_url_filter,
    "op4_telephony": op4_telephony,
    "op5_quality": op5_quality,
    "op6_mix_sources": op6_mix_sources,
    "op7_bpe": op7_bpe,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_recursive_bpe": op13_recursive_bpe,
}
SQL = {"op3_url_filter": OP3_SQL, "op6_mix_sources": OP6_SQL, "op8_warc": OP8_SQL, "op9_quality_rules": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_spelling_variants": OP12_SQL}
