"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import fingerprint, html_text, language_id, mixing, near_dedup, packing, periodic_runs, sharding, tool_calls, toxicity, vector_search, warc, whitening

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_html_text": html_text.op2_html_text,
    "op3_packing": packing.op3_packing,
    "op4_mixing": mixing.op4_mixing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_vector_search": vector_search.op6_vector_search,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_tool_calls": tool_calls.op8_tool_calls,
    "op9_warc": warc.op9_warc,
    "op10_sharding": sharding.op10_sharding,
    "op11_language_id": language_id.op11_language_id,
    "op12_whitening": whitening.op12_whitening,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op4_mixing": mixing.SQL,
    "op6_vector_search": vector_search.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_tool_calls": tool_calls.SQL,
    "op9_warc": warc.SQL,
}
