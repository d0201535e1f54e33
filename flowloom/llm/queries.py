"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .html_text import op7_html_text
from .packing import op6_packing
from .progressive_jpeg import op5_progressive_jpeg
from .quality import op1_quality
from .sentencepiece_codec import op9_sentencepiece
from .simhash import op4_simhash
from .spotsigs import op8_spotsigs
from .substring_dedup import op10_substring_dedup
from .token_counts import op2_token_counts
from .url_rules import op3_url_rules

QUERIES = {f.__name__: f for f in (
    op1_quality, op2_token_counts, op3_url_rules, op4_simhash, op5_progressive_jpeg,
    op6_packing, op7_html_text, op8_spotsigs, op9_sentencepiece, op10_substring_dedup,
)}
ORACLES: dict[str, str] = {}
