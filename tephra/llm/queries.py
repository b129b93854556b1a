"""The queries of this package, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, html_extract, langid, media, quality, simhash, token_blocks, token_counts, url_filter

QUERIES: dict[str, Callable] = {
    "op1_token_blocks": token_blocks.op1_token_blocks,
    "op2_media": media.op2_media,
    "op3_html": html_extract.op3_html,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_bpe": bpe.op5_bpe,
    "op6_langid": langid.op6_langid,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": decontaminate.ORACLE_SQL}
