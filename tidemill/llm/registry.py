"""The training-data queries and their DuckDB oracles."""

from __future__ import annotations

from tidemill.llm.decontaminate import OP8_SQL, op8_decontaminate
from tidemill.llm.divergence import OP13_SQL, op13_source_divergence
from tidemill.llm.fingerprint import op1_fingerprint
from tidemill.llm.jaccard_join import OP12_SQL, links_sql, op12_jaccard_join
from tidemill.llm.language_id import op6_language_id
from tidemill.llm.line_dedup import OP7_SQL, op7_line_dedup
from tidemill.llm.near_dedup import SHINGLE, op10_near_dedup
from tidemill.llm.packing import op9_packing
from tidemill.llm.quality import op3_quality
from tidemill.llm.resampling import OP11_SQL, op11_resampling
from tidemill.llm.substring_dedup import op5_substring_dedup
from tidemill.llm.suffix_dedup import op4_suffix_dedup
from tidemill.llm.toxicity import op2_toxicity

QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_toxicity, op3_quality, op4_suffix_dedup, op5_substring_dedup, op6_language_id, op7_line_dedup, op8_decontaminate, op9_packing, op10_near_dedup, op11_resampling, op12_jaccard_join, op13_source_divergence)}

ORACLE_SQL = {"op7_line_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL, "op10_near_dedup": links_sql(SHINGLE, ", doc_id = component_id AS kept"), "op11_resampling": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_source_divergence": OP13_SQL}
