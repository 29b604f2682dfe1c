"""Queries of this subpackage, and the SQL that gives their rows where SQL can."""

from __future__ import annotations

from .collocations import OP11_SQL, op11_collocations
from .erasure import op13_erasure
from .licenses import OP5_SQL, op5_license_scan
from .lz_dedup import OP10_SQL, op10_lz_dedup
from .mixing import OP2_SQL, op2_source_mix
from .neighbours import op12_neighbours
from .ngram_join import OP3_SQL, op3_ngram_join
from .quality import OP8_SQL, op8_quality_rules
from .secrets import op9_secret_scan
from .spm import op1_sentencepiece
from .suffix_dedup import op6_suffix_dedup
from .topk import OP4_SQL, op4_top_k
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_source_mix,
        op3_ngram_join,
        op4_top_k,
        op5_license_scan,
        op6_suffix_dedup,
        op7_toxicity,
        op8_quality_rules,
        op9_secret_scan,
        op10_lz_dedup,
        op11_collocations,
        op12_neighbours,
        op13_erasure,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_source_mix": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op4_top_k": OP4_SQL,
    "op5_license_scan": OP5_SQL,
    "op8_quality_rules": OP8_SQL,
    "op10_lz_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
}
