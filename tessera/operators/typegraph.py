"""Types with several bases: ancestors, common bases, compatibility of asked pairs, and lookup by the end of a name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import layers
from tessera.operators.staging import rounds, staged

# Kinds of types whose members fit each other; `unknown` fits all.
FITTING = (
    ("part", "item", "occurrence"), ("action", "calculation"), ("case", "analysis case", "verification case", "use case"),
    ("view", "viewpoint", "rendering"), ("attribute", "enumeration"), ("requirement", "constraint"),
)


def ancestors(bases: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """node, ancestor, steps: what each node (or only those of asked) inherits from, with the fewest steps; circles add nothing.

    Round by round, only what the last one found is joined with the bases.
    """
    with rounds(bases.sparkSession) as stage:
        edges = stage(bases.select("node", "base").where("base is not null").distinct())
        first = edges if asked is None else edges.join(asked.select("node").distinct(), "node", "left_semi")
        seen = new = stage(first.select("node", F.col("base").alias("ancestor"), F.lit(1).alias("steps")))
        steps = 1
        while not new.isEmpty():
            steps += 1
            come = new.select("node", F.col("ancestor").alias("mid")).join(edges.toDF("mid", "ancestor"), "mid").select("node", "ancestor", F.lit(steps).alias("steps")).distinct()
            new = stage(come.join(seen.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
            seen = seen.unionByName(new)
        return staged(seen)


def common_bases(pairs: DataFrame, bases: DataFrame) -> DataFrame:
    """a, b, base: the deepest type that both of a pair (a, b) are or inherit from, null if none; of equally deep ones the least.

    A type's depth is the longest way from a type without bases, circles counting once.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = ancestors(bases, asked).select("node", "ancestor").unionByName(asked.select("node", F.col("node").alias("ancestor"))).distinct()
    depth = layers(bases.where("base is not null").select(F.col("base").alias("src"), F.col("node").alias("dst")))
    both = pairs.select("a", "b").distinct().join(own.toDF("a", "base"), "a").join(own.toDF("b", "base"), ["b", "base"])
    both = both.join(depth.toDF("base", "layer"), "base", "left")
    best = both.groupBy("a", "b").agg(F.min(F.struct((-F.coalesce("layer", F.lit(0))).alias("up"), "base")).alias("m"))
    return pairs.select("a", "b").distinct().join(best.select("a", "b", F.col("m.base").alias("base")), ["a", "b"], "left")


def compatible(pairs: DataFrame, types: DataFrame, bases: DataFrame) -> DataFrame:
    """a, b, verdict: same, undefined (one is no type), specialization, common base, category or none, the first that holds.

    types has name and category.
    """
    kinds = types.groupBy("name").agg(F.min(F.lower("category")).alias("category"))
    group = F.lit(None).cast("int")
    for k, own in enumerate(FITTING):
        group = F.when(F.col("category").isin(*own), k).otherwise(group)
    kinds = kinds.withColumn("group", group)
    own = ancestors(bases, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    above = own.select(F.col("node").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("up"))
    rows = pairs.select("a", "b").distinct().join(kinds.toDF("a", "kind_a", "group_a"), "a", "left").join(kinds.toDF("b", "kind_b", "group_b"), "b", "left")
    rows = rows.join(above, ["a", "b"], "left").join(above.toDF("b", "a", "down"), ["a", "b"], "left").join(common_bases(pairs, bases), ["a", "b"], "left")
    fit = (F.col("kind_a") == F.col("kind_b")) | (F.col("group_a") == F.col("group_b")) | (F.col("kind_a") == "unknown") | (F.col("kind_b") == "unknown")
    verdict = (
        F.when(F.col("a") == F.col("b"), "same").when(F.col("kind_a").isNull() | F.col("kind_b").isNull(), "undefined").when(F.col("up") | F.col("down"), "specialization")
        .when(F.col("base").isNotNull(), "common base").when(fit, "category").otherwise("none")
    )
    return rows.select("a", "b", verdict.alias("verdict"))


def by_suffix(names: DataFrame, types: DataFrame) -> DataFrame:
    """asked, name: each asked name (names.asked) as the type of that name, or else the least type whose name ends with `::` and it; null if there is none.

    Types are joined by all ends of their names, so no name is compared with every type.
    """
    parts = F.split("name", "::")
    ends = types.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("asked")).distinct()
    best = names.select("asked").distinct().join(ends, "asked").groupBy("asked").agg(F.min(F.struct((F.col("name") != F.col("asked")).alias("longer"), "name")).alias("m"))
    return names.select("asked").distinct().join(best.select("asked", F.col("m.name").alias("name")), "asked", "left")


def unknown_bases(types: DataFrame, bases: DataFrame, unverifiable: DataFrame) -> DataFrame:
    """node, base: bases that are no type, by full name or end, and not among the unverifiable names (base)."""
    asked = bases.where("base is not null").select(F.col("base").alias("asked"))
    gone = by_suffix(asked, types).where("name is null").select(F.col("asked").alias("base"))
    return bases.join(gone, "base", "left_semi").join(unverifiable.select("base").distinct(), "base", "left_anti").select("node", "base").distinct()
