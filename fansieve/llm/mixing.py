"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document may enter the mix several times. Each source has a target of words; every document of it then has the same fractional
number of copies, target / size of the source. Whole copies are certain, and the fraction is rounded dependently: two documents
meet, and words are moved from one to the other until one of them has a whole number of copies. The direction is random, so that every
document keeps its expected number of copies, and the words of both together do not change. What is left of a group, one document
with a fraction, meets those of other groups in the next round of a reduction tree. A source therefore misses its target by
less than one of its documents.

Cases: a null or wordless text has size 0 and takes nothing; rows that share source and doc_id (repeated rows) are rounded as one
unit and all get its number of copies; a null source is a source, the last one; an empty table gives an empty result;
other columns, whatever their names, are carried along and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fansieve.llm.graph import few
from fansieve.session import durable, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix has so many times the words of its input, and no source more than so many times its own.
SHARE, MOST = 1.5, 2.0
#: Mean number of documents that are rounded together.
GROUP = 128


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of ``(source, source_size)``, one row per source: the words that the mix should take from it (``target``).

    Sources by code point, null last, weigh ``weights`` in turn. A target above ``most`` times its source's size stops there and the
    rest is shared among the others by weight. Sources with the smallest size for their weight stop first, so the sources that
    stop are the first ones in that order: one window over the sources finds them all.
    """
    everywhere = Window.partitionBy()
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("most"))
    out = out.withColumns({"all": F.sum("source_size").over(everywhere) * share, "weights": F.sum("weight").over(everywhere)})
    out = out.withColumn("stops", level * F.col("weight") >= F.col("most"))
    left = F.col("all") - F.sum(F.when(F.col("stops"), F.col("most")).otherwise(0.0)).over(everywhere)
    sharing = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everywhere)
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.least(left * F.col("weight") / sharing, F.col("most")))
    return out.select("source", "source_size", target.alias("target"))


def _random(*parts) -> Column:
    """A number from 0 to 1 that depends on nothing but these values, so that another run draws the same."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _meet(state: Column, unit: Column) -> Column:
    """Let the unit with a fraction that is left so far (``state.left``) meet the next one; one of the two gets a whole number of copies."""

    def moved(x):
        a, b = state["left"], unit
        up, down = x["up"], x["down"]  # words that a can gain from b, and lose to b
        rises = _random(F.lit("meet"), a["doc_id"], b["doc_id"], F.lit("of"), a["size"]) * (up + down) < down
        a_full, b_full = a["size"] * (1 - a["part"]) <= b["size"] * b["part"], a["size"] * a["part"] <= b["size"] * (1 - b["part"])
        a_part = F.when(rises, F.when(a_full, 1.0).otherwise(a["part"] + b["size"] * b["part"] / a["size"])).otherwise(
            F.when(b_full, 0.0).otherwise(a["part"] - b["size"] * (1 - b["part"]) / a["size"])
        )
        b_part = F.when(rises, F.when(a_full, b["part"] - a["size"] * (1 - a["part"]) / b["size"]).otherwise(0.0)).otherwise(
            F.when(b_full, b["part"] + a["size"] * a["part"] / b["size"]).otherwise(1.0)
        )
        a_settled = F.when(rises, a_full).otherwise(b_full)
        return F.struct(
            a_settled.alias("settled"),
            F.struct(a["doc_id"].alias("doc_id"), a["size"].alias("size"), a_part.alias("part")).alias("a"),
            F.struct(b["doc_id"].alias("doc_id"), b["size"].alias("size"), b_part.alias("part")).alias("b"),
        )

    def parted(y):
        done = F.when(y["settled"], y["a"]).otherwise(y["b"])
        left = F.when(y["settled"], y["b"]).otherwise(y["a"])
        return F.struct(
            F.struct(left["doc_id"].alias("doc_id"), left["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), left["part"])).alias("part")).alias("left"),
            F.concat(state["done"], F.array(F.struct(done["doc_id"].alias("doc_id"), (done["part"] > 0.5).cast("long").alias("extra")))).alias("done"),
        )

    a, b = state["left"], unit
    room = F.array(
        F.struct(
            F.least(a["size"] * (1 - a["part"]), b["size"] * b["part"]).alias("up"),
            F.least(a["size"] * a["part"], b["size"] * (1 - b["part"])).alias("down"),
        )
    )
    # transform over an array of one element gives a value a name, so that it is computed once.
    return F.element_at(F.transform(F.transform(room, moved), parted), 1)


def _round_groups(units: DataFrame, number: int, id_type: str) -> DataFrame:
    """One round: ``units(source, doc_id, size, part, groups)`` by group; per group what is ``done`` and what is ``left``."""
    group = F.pmod(F.xxhash64(F.lit(number), F.col("doc_id")), F.col("groups"))
    # Large ones meet first, so that what is left at the end is rather a small one.
    member = F.struct((-F.col("size")).alias("at"), _random(F.lit("order"), F.lit(number), F.col("doc_id")).alias("then"), "doc_id", "size", "part")
    grouped = units.groupBy("source", group.alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    plain = F.transform("members", lambda m: F.struct(m["doc_id"].alias("doc_id"), m["size"].alias("size"), m["part"].alias("part")))
    nothing = F.array().cast(f"array<struct<doc_id:{id_type},extra:bigint>>")
    start = F.struct(F.element_at("plain", 1).alias("left"), nothing.alias("done"))
    state = F.aggregate(F.slice("plain", 2, F.greatest(F.size("plain") - 1, F.lit(0))), start, _meet)
    return grouped.select("source", plain.alias("plain")).select("source", state.alias("state")).select("source", "state.left", "state.done")


def copies(units: DataFrame, group: int = GROUP) -> DataFrame:
    """Round ``units(source, doc_id, size, target, source_size)`` to ``(source, doc_id, copies)``.

    (source, doc_id) must be unique. Each round leaves one unit with a fraction for ``group`` units, so there are
    log(units) / log(group) rounds; groups are dealt by a hash, so a source with a third of all rows has a third of the groups.
    """
    id_type = units.schema["doc_id"].dataType.simpleString()
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("mean", mean).withColumn("part", F.col("mean") - F.floor("mean"))
    meets = (F.col("part") > 0) & (F.col("size") > 0)
    alone = units.where(~meets).select("source", "doc_id", (F.floor("mean") + (_random(F.lit("alone"), F.col("doc_id")) < F.col("part")).cast("long")).alias("copies"))
    units = units.where(meets)
    whole = units.select("source", "doc_id", F.floor("mean").alias("copies"))
    left = units.select("source", "doc_id", F.col("size").cast("double").alias("size"), "part")
    number, settled = 0, []
    while True:
        counts = left.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / group)).alias("groups"))
        counts = durable(counts.withColumnRenamed("source", "its_source"))
        rounds = durable(_round_groups(left.join(counts, F.col("source").eqNullSafe(F.col("its_source"))), number, id_type))
        settled.append(rounds.select("source", F.explode("done").alias("x")).select("source", "x.doc_id", "x.extra"))
        left = rounds.select("source", "left.doc_id", "left.size", "left.part")
        number += 1
        if not counts.where(F.col("groups") > 1).head(1):
            break
    last = (_random(F.lit("last"), F.col("doc_id")) < F.col("part")).cast("long")
    settled.append(left.select("source", "doc_id", last.alias("extra")))
    extra = settled[0]
    for more in settled[1:]:
        extra = extra.unionByName(more)
    parts = alone.unionByName(whole).unionByName(extra.withColumnRenamed("extra", "copies"))
    return parts.groupBy("source", "doc_id").agg(F.sum("copies").alias("copies"))


def _decide(rows: DataFrame) -> DataFrame:
    """``(of_source, of_doc, source_size, target, copies)`` of the units of ``rows(doc_id, source, size)``."""
    narrow = durable(rows.select("doc_id", "source", "size"))
    units = narrow.groupBy("source", "doc_id").agg(F.sum("size").alias("size"))
    sources = durable(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))))
    here = sources.select(F.col("source").alias("its_source"), "source_size", "target")
    units = units.join(here, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    decided = units.select("source", "doc_id", "source_size", "target").join(
        copies(units).select(F.col("source").alias("of_source"), F.col("doc_id").alias("of_doc"), "copies"),
        F.col("source").eqNullSafe(F.col("of_source")) & F.col("doc_id").eqNullSafe(F.col("of_doc")),
    )
    return decided.select("of_source", "of_doc", "source_size", "target", "copies")


def _same() -> Column:
    return F.col("source").eqNullSafe(F.col("of_source")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))


def mix(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``row``, with ``size``, ``source_size``, ``target`` and ``copies``, the times that the mix has it."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), words().alias("size"))
    return rows.join(_decide(rows), _same()).select("row", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Whole rows are not shuffled if the decisions are few."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), words().alias("size"))
    decided = few(durable(_decide(rows).where(F.col("copies") > 0).select("of_source", "of_doc", "copies")))
    taken = rows.select("row", "doc_id", "source").join(decided, _same())
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mix(docs).select("row.doc_id", "size", "source_size", "target", taken)


def queries():
    return {"op4_mixing": op4_mixing}
