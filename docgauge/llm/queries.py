"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversations import OP11_SQL, op11_conversation_repair
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .license_scan import OP8_SQL, op8_license_scan
from .line_dedup import op4_line_dedup
from .media import op6_media_columns
from .merkle_manifest import OP12_SQL, op12_merkle_manifest
from .mixing import op7_mixing
from .near_join import OP3_SQL, op3_ngram_jaccard_join
from .packing import op9_packing
from .secrets import OP13_SQL, op13_secret_scan
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .toxicity import op2_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_media_columns": op6_media_columns,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_secret_scan": op13_secret_scan,
}
ORACLES = {
    "op1_warc": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op8_license_scan": OP8_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_secret_scan": OP13_SQL,
}
