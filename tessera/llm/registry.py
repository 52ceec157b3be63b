"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_byte_bpe
from .embedding_dedup import op4_embedding_near_dedup
from .fill_in_middle import op12_fill_in_middle
from .fingerprints import document_fingerprint_links, op7_document_fingerprints
from .jaccard_join import op9_ngram_jaccard_join
from .language_id import op6_language_id
from .license_scan import op1_license_scan
from .oracles import ORACLE_SQL as ORACLE_SQL
from .packing import op2_best_fit_packing
from .phrases import op11_phrase_collocations
from .sharding import op13_shuffled_shards
from .substring_dedup import op5_substring_dedup
from .tool_calls import op10_tool_call_linking
from .url_filter import op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_url_filter": op8_url_filter,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_tool_call_linking": op10_tool_call_linking,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_shuffled_shards": op13_shuffled_shards,
    "document_fingerprint_links": document_fingerprint_links,
}
