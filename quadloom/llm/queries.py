"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from quadloom.llm.html_extract import op5_html_extraction
from quadloom.llm.language_id import op4_language_id
from quadloom.llm.learned_ann import op1_learned_ann
from quadloom.llm.media import op9_media_columns
from quadloom.llm.ngram_join import op10_ngram_join
from quadloom.llm.packing import op3_best_fit_packing
from quadloom.llm.pii import op6_pii
from quadloom.llm.secret_scan import op8_secret_scan
from quadloom.llm.sentencepiece_codec import op2_sentencepiece
from quadloom.llm.substring_dedup import op7_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_learned_ann,
        op2_sentencepiece,
        op3_best_fit_packing,
        op4_language_id,
        op5_html_extraction,
        op6_pii,
        op7_substring_dedup,
        op8_secret_scan,
        op9_media_columns,
        op10_ngram_join,
    )
}
ORACLES: dict[str, str] = {}
