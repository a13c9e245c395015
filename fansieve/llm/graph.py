"""The library's helpers for graphs and uneven joins, under the name by which the operators here know them."""

from fansieve.operators.graph import FREQUENT_KEYS, FREQUENT_ROWS, components, few, frequent, uneven_join

__all__ = ["FREQUENT_KEYS", "FREQUENT_ROWS", "components", "few", "frequent", "uneven_join"]
