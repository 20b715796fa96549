"""Queries over the intended tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe_round_trip
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .langid import op3_language_id
from .licenses import OP4_SQL, op4_license_scan
from .mixing import op9_mix_sources
from .odd_sketch import op12_minhash
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import op10_quality_rules
from .quality_mil import op8_quality_mil
from .secrets import op2_secret_scan
from .simhash import op7_simhash
from .suffix_dedup import op1_suffix_dedup
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_secret_scan,
        op3_language_id,
        op4_license_scan,
        op5_exact_dedup,
        op6_bpe_round_trip,
        op7_simhash,
        op8_quality_mil,
        op9_mix_sources,
        op10_quality_rules,
        op11_prefix_trie,
        op12_minhash,
        op13_vector_codes,
    )
}

ORACLE_SQL = {"op4_license_scan": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}
