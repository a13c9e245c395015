"""Bounded samples of texts for training, the same in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a text that may be taken.
LONGEST = 1 << 20


def bounded_classes(docs: DataFrame, label: str, most: int, seed: int = 1) -> list[tuple]:
    """(label, text) of about ``most`` rows of each value of ``label``, null left out, at most 1.5 times as many.

    A class with more ids is thinned by a hash of the id, at a rate from their number; this first pass reads ids and labels only. Rows with the same label, id
    and text count once, so that what is taken is the same in every run. Texts of more than ``LONGEST`` bytes are not taken: rows bound the sample, this
    bounds its bytes.
    """
    docs = docs.where(F.col(label).isNotNull())
    counts = {r[label]: max(1, r["n"]) for r in docs.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 53)) / float(1 << 53)
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), min(1.0, 1.2 * most / n)).otherwise(rate)
    some = docs.where((place < rate) & (F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST))
    some = some.select(label, place.alias("place"), F.xxhash64("text").alias("of"), "text").dropDuplicates([label, "place", "of"])
    # Of one id with very many texts the first ones; the ranking is cut in the tasks already.
    turn = F.row_number().over(Window.partitionBy(label).orderBy("place", "of"))
    rows = some.withColumn("turn", turn).where(F.col("turn") <= int(1.5 * most)).collect()
    rows.sort(key=lambda r: (str(r[label]), r["turn"]))
    return [(r[label], r["text"] or "") for r in rows]
