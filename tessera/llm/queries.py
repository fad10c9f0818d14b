"""Registered queries of the training-data operators: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from tessera.llm.fingerprint_log import OP5_SQL, op5_substrings
from tessera.llm.hnsw import op1_ann
from tessera.llm.jaccard import OP4_SQL, op4_jaccard
from tessera.llm.langid import op2_langid
from tessera.llm.license_scan import op13_licenses
from tessera.llm.mixing import OP9_SQL, op9_mixing
from tessera.llm.packing import op6_packing
from tessera.llm.periodic_runs import op12_runs
from tessera.llm.prefix_trie import OP11_SQL, op11_trie
from tessera.llm.secret_scan import OP3_SQL, op3_secrets
from tessera.llm.sharding import op8_sharding
from tessera.llm.suffix_dedup import OP10_SQL, op10_suffixes
from tessera.llm.voronoi import OP7_SQL, op7_topk

QUERIES = {
    "op1_ann": (op1_ann, None),
    "op2_langid": (op2_langid, None),
    "op3_secrets": (op3_secrets, OP3_SQL),
    "op4_jaccard": (op4_jaccard, OP4_SQL),
    "op5_substrings": (op5_substrings, OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_topk": (op7_topk, OP7_SQL),
    "op8_sharding": (op8_sharding, None),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_suffixes": (op10_suffixes, OP10_SQL),
    "op11_trie": (op11_trie, OP11_SQL),
    "op12_runs": (op12_runs, None),
    "op13_licenses": (op13_licenses, None),
}
