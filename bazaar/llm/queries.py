"""Registry of the package's queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from bazaar.llm import decontaminate, lexical, near_join
from bazaar.llm.fingerprints import op5_fingerprints
from bazaar.llm.langid import op3_language_id
from bazaar.llm.mixing import op13_source_mixing
from bazaar.llm.packing import op2_best_fit_packing
from bazaar.llm.quality import op7_line_quality
from bazaar.llm.repair import op12_conversation_repair
from bazaar.llm.sharding import op4_kd_sharding
from bazaar.llm.suffix_dedup import op1_suffix_dedup
from bazaar.llm.token_counts import op10_token_counts
from bazaar.llm.warc import op6_warc_normalise

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_fingerprints": op5_fingerprints,
    "op6_warc_normalise": op6_warc_normalise,
    "op7_line_quality": op7_line_quality,
    "op8_near_join": near_join.op8_near_join,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_ranked_search": lexical.op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE: dict[str, str] = {
    "op8_near_join": near_join.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
    "op11_ranked_search": lexical.ORACLE,
}
