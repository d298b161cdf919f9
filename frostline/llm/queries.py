"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from .decontamination import op2_decontamination
from .divergence import OP12_SQL, op12_source_divergence
from .fingerprint import op10_fingerprint
from .html_text import op5_html_text
from .language_id import op7_language_id
from .minhash import op13_minhash
from .ngram_join import op4_ngram_join
from .ngram_lm import op9_lm_score
from .oracles import linked_sql, substring_sql
from .packing import op8_packing
from .quality import op6_quality
from .secret_scan import op3_secret_scan
from .substring_dedup import op1_substring_dedup
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_decontamination,
        op3_secret_scan,
        op4_ngram_join,
        op5_html_text,
        op6_quality,
        op7_language_id,
        op8_packing,
        op9_lm_score,
        op10_fingerprint,
        op11_whitening,
        op12_source_divergence,
        op13_minhash,
    )
}

#: The others learn, lay out or fingerprint what SQL can't express; the tests hold brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_sql(50),
    "op4_ngram_join": linked_sql(5, 80, "*"),
    "op12_source_divergence": OP12_SQL,
    "op13_minhash": linked_sql(4, 80, "doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept"),
}
