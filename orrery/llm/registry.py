"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from orrery.llm.bpe import op10_bpe
from orrery.llm.chat_format import OP2_SQL, op2_chat_format
from orrery.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from orrery.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from orrery.llm.language_id import op5_language_id
from orrery.llm.lm_score import BASE_SQL, lm_base, op3_lm_score
from orrery.llm.packing import op1_packing
from orrery.llm.quality_rules import ABLATIONS_SQL, OP9_SQL, op9_quality_rules, quality_ablations
from orrery.llm.toxicity import op6_toxicity
from orrery.llm.url_filter import RULES_SQL, op4_url_filter, url_rules
from orrery.shipping import ship


def shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat_format": op2_chat_format,
    "op3_lm_score": op3_lm_score,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "lm_base": lm_base,
    "quality_ablations": quality_ablations,
    "url_rules": url_rules,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLES = {"op2_chat_format": OP2_SQL, "op7_jaccard_join": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL, "lm_base": BASE_SQL, "quality_ablations": ABLATIONS_SQL, "url_rules": RULES_SQL}
