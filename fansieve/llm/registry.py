"""The queries of this subpackage and, where SQL can express them, the same queries in SQL."""

from __future__ import annotations

from fansieve.llm import (
    alignment,
    bk_trees,
    conversations,
    edit_fingerprints,
    language_id,
    language_model,
    licenses,
    mixing,
    near_duplicates,
    neighbours,
    packing,
    page_text,
    toxicity,
)

_MODULES = (near_duplicates, edit_fingerprints, language_id, mixing, licenses, page_text, language_model, packing, neighbours, toxicity, bk_trees, alignment, conversations)


def queries():
    return {name: query for module in _MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES if hasattr(module, "oracle_sql") for name, sql in module.oracle_sql().items()}
