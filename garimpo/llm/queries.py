"""Importing this module registers every query of the subpackage."""

from garimpo.llm import (  # noqa: F401
    bpe, exact_dedup, filter_audit, fingerprints, language, language_model, lexical_search, near_dedup, packing, pii,
    simhash, substring_dedup, suffix_dedup,
)
from garimpo.llm.registry import REGISTRY  # noqa: F401
