"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact, media, minhash, mixing, pages, pieces, pii, quality, secrets, toxicity

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash,
    "op2_exact_dedup": exact.op2_exact,
    "op3_quality": quality.op3_quality,
    "op4_page_text": pages.op4_pages,
    "op5_sentencepiece": pieces.op5_pieces,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii_surrogates": pii.op7_pii,
    "op8_media": media.op8_media,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
}
ORACLES = {"op1_minhash_near_dedup": minhash.ORACLE, "op2_exact_dedup": exact.ORACLE}
