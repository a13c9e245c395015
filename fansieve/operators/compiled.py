"""Matching with one compiled expression per subscription, for a handful of irregular ones.

Its cost grows with events x subscriptions, so it refuses large tables; ``match`` with the default
strategy has no such limit. It also accepts free Spark SQL texts that have no clause form.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fansieve.functions.attributes import SPARK_TYPES, attributes_of
from fansieve.functions.predicates import Either, Predicate, Test, quote_name

MAX_COMPILED = 2000
_CHUNK = 50


def _predicate(clauses) -> Predicate:
    out: Predicate | None = None
    for clause in clauses:
        both: Predicate | None = None
        for t in clause:
            literal = next((t[f] for f in ("ints", "strs", "str", "int", "float") if t[f] is not None), None)
            one = Test(t["attribute"], t["op"], literal)
            both = one if both is None else both & one
        out = both if out is None else Either(out, both)
    return out


def _typed(events_schema: T.StructType, attributes: Mapping[str, str]) -> dict[str, str]:
    """Of every event column the SQL text of its value: attributes in the type that they are declared with."""
    out = {f.name: quote_name(f.name) for f in events_schema.fields}
    return out | {a: f"CAST({quote_name(a)} AS {SPARK_TYPES[kind].simpleString()})" for a, kind in attributes.items()}


def any_holds(subscriptions: DataFrame, attributes: Mapping[str, str], events_schema: T.StructType) -> Column:
    """Whether any of a few (sub_id, clauses) or (sub_id, expression) rows accepts the event; never NULL."""
    by_clauses = "clauses" in subscriptions.columns
    rows = subscriptions.select("clauses" if by_clauses else "expression").limit(MAX_COMPILED + 1).collect()
    if len(rows) > MAX_COMPILED:
        raise ValueError(f"more than {MAX_COMPILED} subscriptions")
    if not by_clauses:
        return F.expr(" OR ".join(f"coalesce(({r[0]}), false)" for r in rows) or "false")
    typed = _typed(events_schema, attributes)
    texts = [f"coalesce({_predicate(r['clauses']).sql(typed)}, false)" for r in rows]
    return F.expr(" OR ".join(texts) or "false")


def ids_compiled(subscriptions: DataFrame, attributes: Mapping[str, str], events_schema: T.StructType) -> Column:
    """The sorted ids of the few (sub_id, clauses) or (sub_id, expression) rows that accept the event."""
    by_clauses = "clauses" in subscriptions.columns
    rows = subscriptions.select("sub_id", "clauses" if by_clauses else "expression").limit(MAX_COMPILED + 1).collect()
    if len(rows) > MAX_COMPILED:
        raise ValueError(f"more than {MAX_COMPILED} subscriptions")
    typed = _typed(events_schema, attributes)
    rows.sort(key=lambda r: r["sub_id"])
    hits = [F.when(F.expr(_predicate(r[1]).sql(typed) if by_clauses else r[1]), F.lit(r["sub_id"])) for r in rows]
    parts = [F.array_compact(F.array(*hits[k : k + _CHUNK])) for k in range(0, len(hits), _CHUNK)]
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array()


def match_compiled(events: DataFrame, subscriptions: DataFrame, attributes: Mapping[str, str] | None = None) -> DataFrame:
    """Same result as ``match``. Subscriptions are (sub_id, clauses) or (sub_id, expression) rows.

    Clauses see the attributes in their declared types, as the join does; free texts see the event columns as they are.
    """
    rest = [c for c in subscriptions.columns if c not in ("clauses", "expression")]
    rows = subscriptions.limit(MAX_COMPILED + 1).collect()
    if len(rows) > MAX_COMPILED:
        raise ValueError(f"more than {MAX_COMPILED} subscriptions: use the template strategy")
    schema = subscriptions.select(*map(F.col, map(quote_name, rest))).schema
    if not rows:
        return events.sparkSession.createDataFrame([], events.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields)).schema)
    by_clauses = "clauses" in subscriptions.columns
    typed = _typed(events.schema, attributes if attributes is not None else attributes_of(events.schema))
    position = "_position"
    while position in events.columns or position in rest:
        position = "_" + position

    # Expressions are evaluated in chunks so that each generated method stays small.
    chunks = []
    for start in range(0, len(rows), _CHUNK):
        hits = []
        for offset, row in enumerate(rows[start : start + _CHUNK]):
            condition = F.expr(_predicate(row["clauses"]).sql(typed) if by_clauses else row["expression"])
            hits.append(F.when(condition, F.lit(start + offset)))
        chunks.append(F.array_compact(F.array(*hits)))
    found = events.select("*", F.explode(F.concat(*chunks) if len(chunks) > 1 else chunks[0]).alias(position))
    # At most MAX_COMPILED rows.
    values = [tuple([i, *(r[c] for c in rest)]) for i, r in enumerate(rows)]
    ddl = f"{position} int, " + ", ".join(f"{quote_name(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    carried = events.sparkSession.createDataFrame(values, ddl)
    return found.join(F.broadcast(carried), position).drop(position)
