"""Registered queries of the corpus operators: one per operator, over its whole
table, and the DuckDB SQL of those that SQL can express."""

from . import chat, decontam, linededup, merkle, ranked, substr
from .chat import op8_prefix_targets
from .decontam import op7_decontamination
from .fingerprint import op6_fingerprint
from .hilbert import op5_hilbert_sharding
from .linededup import op11_line_dedup
from .lm import op1_ngram_trie
from .merkle import op13_merkle_manifest
from .neardup import op4_near_duplicates
from .packing import op2_packing
from .pii import op9_pii
from .ranked import op12_ranked_search
from .substr import op10_substring_dedup
from .toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_trie, op2_packing, op3_toxicity, op4_near_duplicates, op5_hilbert_sharding, op6_fingerprint, op7_decontamination, op8_prefix_targets, op9_pii, op10_substring_dedup, op11_line_dedup, op12_ranked_search, op13_merkle_manifest)}
ORACLE_SQL = {"op7_decontamination": decontam.SQL, "op8_prefix_targets": chat.SQL, "op10_substring_dedup": substr.SQL, "op11_line_dedup": linededup.SQL, "op12_ranked_search": ranked.SQL, "op13_merkle_manifest": merkle.SQL}
