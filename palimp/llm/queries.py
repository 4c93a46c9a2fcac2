"""Registers the queries of this package."""

# Importing an operator registers its query.
from palimp.llm import (  # noqa: F401
    content_dedup, conversation_repair, decontamination, line_dedup, maxscore, minhash_tensor, mixing, piece_lattice, ppm, quote_linking, term_pipeline,
    token_counts, toxicity,
)
from palimp.llm.base import ORACLES, QUERIES  # noqa: F401
