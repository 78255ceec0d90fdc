"""Class hierarchies: closures, depths, slot owners, reachability and structural features.

Edges are (schema-wide) rows (cls, parent).  Closures double the distance that is known in every round, so a
chain of n links takes some log2(n) joins, whatever its length; cycles end by themselves.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import shared_dir


def closure(edges: DataFrame) -> DataFrame:
    """(cls, ancestor, dist): every class with itself and all classes above it, at the least distance.

    Rounds are written to the shared folder.  A round joins the ways of the greatest known length with all
    ways of at most that length, which gives each longer way up to twice that length.
    """
    spark = edges.sparkSession
    edges = edges.select("cls", "parent").where("cls is not null").distinct()
    folder, schema = f"{shared_dir(spark)}/strandweave-closure-{uuid.uuid4().hex}", None
    links = edges.where("parent is not null and parent <> cls")
    nodes = edges.select("cls").unionByName(links.select(F.col("parent").alias("cls"))).distinct()
    rows = nodes.select("cls", F.col("cls").alias("ancestor"), F.lit(0).alias("dist")).unionByName(links.select("cls", F.col("parent").alias("ancestor"), F.lit(1).alias("dist")))
    rounds: list[DataFrame] = []
    length = 1
    while True:
        path, schema = f"{folder}/{len(rounds)}", schema or rows.schema
        rows.write.parquet(path)
        rounds.append(spark.read.schema(schema).parquet(path))
        known = reduce(DataFrame.unionByName, rounds)
        longest = rounds[-1].where(F.col("dist") == length)
        if longest.isEmpty():
            return known
        first = longest.select("cls", F.col("ancestor").alias("middle"), F.col("dist").alias("d"))
        rest = known.where("dist > 0").select(F.col("cls").alias("middle"), "ancestor", "dist")
        ways = first.join(rest, "middle").groupBy("cls", "ancestor").agg(F.min(F.col("d") + F.col("dist")).alias("dist"))
        rows, length = ways.join(known.select("cls", "ancestor"), ["cls", "ancestor"], "left_anti"), 2 * length


def depths(edges: DataFrame) -> DataFrame:
    """(cls, depth): links up to the root."""
    return closure(edges).groupBy("cls").agg(F.max("dist").alias("depth"))


def descendants(closed: DataFrame) -> DataFrame:
    """(cls, descendant) without the class itself."""
    return closed.where("dist > 0").select(F.col("ancestor").alias("cls"), F.col("cls").alias("descendant"))


def nearest_mapped(wanted: DataFrame, mapped: DataFrame, closed: DataFrame) -> DataFrame:
    """(cls, nearest): for each wanted class itself if mapped; else a mapped class below it; else the nearest
    mapped class above it; else null.  Equal distances go to the least name."""
    up = wanted.select("cls").distinct().join(closed, "cls").join(mapped.select(F.col("cls").alias("ancestor")).distinct(), "ancestor").select("cls", F.col("ancestor").alias("found"), "dist", F.when(F.col("dist") == 0, 0).otherwise(2).alias("kind"))
    below = closed.where("dist > 0").join(mapped.select("cls").distinct(), "cls").select(F.col("ancestor").alias("cls"), F.col("cls").alias("found"), "dist", F.lit(1).alias("kind"))
    down = below.join(wanted.select("cls").distinct(), "cls", "left_semi").select("cls", "found", "dist", "kind")
    best = up.unionByName(down).groupBy("cls").agg(F.min(F.struct("kind", "dist", "found")).alias("b")).select("cls", F.col("b.found").alias("nearest"))
    return wanted.select("cls").distinct().join(best, "cls", "left")


def slot_owners(class_slots: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(slot, owner): the first class that lists a slot directly, or else the first that inherits it.

    ``class_slots`` has (cls, slot, pos), pos in schema order.
    """
    rows = class_slots.select("slot", F.col("cls").alias("owner"), "pos", F.lit(0).alias("pass"))
    if closed is not None:
        inherited = closed.where("dist > 0").join(class_slots.select(F.col("cls").alias("ancestor"), "slot", "pos"), "ancestor")
        rows = rows.unionByName(inherited.select("slot", F.col("cls").alias("owner"), "pos", F.lit(1).alias("pass")))
    return rows.groupBy("slot").agg(F.min_by("owner", F.struct("pass", "pos", "owner")).alias("owner"))


def induced_slots(class_slots: DataFrame, closed: DataFrame, mixins: DataFrame | None = None) -> DataFrame:
    """(cls, slot): the slots a class lists, inherits or mixes in."""
    up = closed.select("cls", "ancestor")
    if mixins is not None:
        mixed = up.join(mixins.select(F.col("cls").alias("ancestor"), "mixin"), "ancestor").select("cls", F.col("mixin").alias("ancestor"))
        up = up.unionByName(mixed)
    return up.join(class_slots.select(F.col("cls").alias("ancestor"), "slot"), "ancestor").select("cls", "slot").distinct()


def unreachable(slot_targets: DataFrame, mapped: DataFrame, owners: DataFrame, closed: DataFrame) -> DataFrame:
    """(slot, owner) of mapped slots whose owner is unrelated to every mapped class; none without any."""
    owned = slot_targets.join(owners, "slot")
    near = nearest_mapped(owned.select(F.col("owner").alias("cls")), mapped, closed)
    some = mapped.select(F.lit(1).alias("__any")).limit(1)
    return owned.join(near.where("nearest is null").select(F.col("cls").alias("owner")), "owner", "left_semi").crossJoin(F.broadcast(some)).drop("__any").select(*slot_targets.columns, "owner")


def structural_features(classes: DataFrame, slots: DataFrame, class_slots: DataFrame) -> DataFrame:
    """(node, f0..f4) for classes (cls, parent) and slots (slot, parent, required, multivalued): whether a
    class, depth over the greatest depth, required, multivalued, and the share of classes using a slot.  A
    slot with a class's name stands for both in the hierarchy."""
    nodes = slots.select(F.col("slot").alias("cls"), "parent").unionByName(classes.select("cls", "parent").join(slots.select(F.col("slot").alias("cls")), "cls", "left_anti"))
    known = nodes.select("cls")
    edges = nodes.join(known.withColumnRenamed("cls", "parent"), "parent", "left_semi").select("cls", "parent").unionByName(nodes.select("cls", F.lit(None).cast("string").alias("parent")))
    deep = depths(edges)
    top = deep.agg(F.max("depth").alias("top"))
    deep = deep.crossJoin(F.broadcast(top)).select("cls", F.when(F.col("top") > 0, F.col("depth") / F.col("top")).otherwise(0.0).alias("f1"))
    used = class_slots.groupBy("slot").agg(F.count("*").alias("uses"))
    total = classes.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    zero = F.lit(0.0)
    of_classes = classes.join(deep, "cls", "left").select(F.col("cls").alias("node"), F.lit(1.0).alias("f0"), F.coalesce("f1", zero).alias("f1"), zero.alias("f2"), zero.alias("f3"), zero.alias("f4"))
    of_slots = slots.join(deep.withColumnRenamed("cls", "slot"), "slot", "left").join(used, "slot", "left").crossJoin(F.broadcast(total))
    flags = [F.coalesce(F.col(c).cast("double"), zero).alias(n) for c, n in (("required", "f2"), ("multivalued", "f3"))]
    of_slots = of_slots.select(F.col("slot").alias("node"), zero.alias("f0"), F.coalesce("f1", zero).alias("f1"), *flags, (F.coalesce("uses", F.lit(0)) / F.col("total")).alias("f4"))
    return of_classes.unionByName(of_slots)

