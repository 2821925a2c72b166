"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from regspark.llm.chat_format import OP10_SQL, op10_chat_formatting
from regspark.llm.decontaminate import op1_decontamination
from regspark.llm.language_model import op3_lm_scoring
from regspark.llm.near_dedup import op6_near_dedup
from regspark.llm.packing import op4_best_fit_packing
from regspark.llm.periodic_runs import op11_periodic_runs
from regspark.llm.quality_rules import op9_quality_rules
from regspark.llm.ranked_search import OP13_SQL, op13_ranked_search
from regspark.llm.secret_scan import OP12_SQL, op12_secret_scan
from regspark.llm.sharding import op5_sharding
from regspark.llm.substring_dedup import op2_substring_dedup
from regspark.llm.toxicity import op8_toxicity
from regspark.llm.url_filters import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_sharding": op5_sharding,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {"op7_url_filters": OP7_SQL, "op10_chat_formatting": OP10_SQL,
                           "op12_secret_scan": OP12_SQL, "op13_ranked_search": OP13_SQL}
