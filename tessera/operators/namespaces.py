"""Which names packages show, through imports of any depth, and what a name means in a scope: exists, missing or unverifiable.

Both go round by round with what the last round found: names flow along imports until no package learns a new one, and references climb to the next
scope until one has their name. Packages may import each other in circles; a name is learned once, so rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.staging import rounds, staged


def visible(owned: DataFrame, imports: DataFrame, most_steps: int | None = None) -> DataFrame:
    """package, name, kind, steps: all names that each package shows, or those that at most `most_steps` imports in a row lead to.

    owned has package, name, kind. imports has package, ord, target, form (`all`: every name of the target, `member`: one name of it, anything else: not listed) and name.
    What is nearer wins: a package's own name, then fewer imports in a row, then the earlier import, then the lesser kind.
    """
    with rounds(owned.sparkSession) as stage:
        own = owned.groupBy("package", "name").agg(F.min("kind").alias("kind")).select("package", "name", "kind", F.lit(0).alias("steps"))
        seen = new = stage(own)
        edges = stage(imports.where("form in ('all', 'member')").select(F.col("package").alias("to"), "ord", F.col("target").alias("package"), F.when(F.col("form") == "member", F.col("name")).alias("only")).distinct())
        steps = 0
        while steps != most_steps and not new.isEmpty():
            steps += 1
            come = new.join(edges, "package").where("only is null or only = name").groupBy(F.col("to").alias("package"), "name").agg(F.min(F.struct("ord", "kind")).alias("first"))
            come = come.select("package", "name", F.col("first.kind").alias("kind"), F.lit(steps).alias("steps"))
            new = stage(come.join(seen.select("package", "name"), ["package", "name"], "left_anti"))
            seen = seen.unionByName(new)
        return staged(seen)


def complete(packages: DataFrame, imports: DataFrame, names: DataFrame) -> DataFrame:
    """package, complete: whether the names that `visible` found for a package are all it has.

    They may not be if it has an import that is not listed, one of no known package, one of a member that its target does not show,
    or imports all of a package that is not complete.
    """
    with rounds(packages.sparkSession) as stage:
        known = packages.select("package").distinct()
        unknown = imports.join(known.toDF("target"), "target", "left_anti").select("package")
        unlisted = imports.where("form not in ('all', 'member')").select("package")
        gone = imports.where("form = 'member'").join(names.select(F.col("package").alias("target"), "name"), ["target", "name"], "left_anti").select("package")
        bad = new = stage(unknown.unionByName(unlisted).unionByName(gone).distinct())
        edges = stage(imports.where("form = 'all'").select("package", "target").distinct())
        while not new.isEmpty():
            new = stage(edges.join(new.toDF("target"), "target").select("package").distinct().join(bad, "package", "left_anti"))
            bad = bad.unionByName(new)
        return staged(known.join(bad.withColumn("bad", F.lit(True)), "package", "left").select("package", F.col("bad").isNull().alias("complete")))


def resolved(references: DataFrame, scopes: DataFrame, members: DataFrame, opaque: DataFrame) -> DataFrame:
    """ref, status, target, depth: references (ref, scope, name) looked up in their scope and then in the scopes around it.

    scopes has scope, parent; members has scope, name, target; opaque has the scopes whose members may not all be known. The nearest scope that has
    the name's first part decides (exists, with the least target there); parts behind `::` are looked up as members of what was found. A name that is not found is
    unverifiable if a scope that was looked through is opaque, and missing if none is. A scope outside the tree is looked through by itself.
    """
    with rounds(references.sparkSession) as stage:
        known = stage(members.groupBy("scope", "name").agg(F.min("target").alias("target")))
        doubt = stage(opaque.select("scope", F.lit(True).alias("opaque")).distinct())
        above = stage(scopes.select("scope", "parent").where("parent is not null and parent <> scope").distinct())
        looking = stage(references.select("ref", "scope", F.split("name", "::").alias("parts"), F.lit(False).alias("doubt"), F.lit(0).alias("depth")))
        done = None
        add = lambda x, y: y if x is None else x.unionByName(y)
        while not looking.isEmpty():
            met = looking.withColumn("name", F.col("parts")[0]).join(known, ["scope", "name"], "left").join(doubt, "scope", "left")
            met = stage(met.withColumn("doubt", F.col("doubt") | F.coalesce("opaque", F.lit(False))).drop("opaque", "name"))
            done = add(done, met.where("target is not null").drop("scope"))
            up = met.where("target is null").drop("target").join(above, "scope", "left")
            done = add(done, up.where("parent is null").select("ref", "parts", "doubt", "depth", F.lit(None).cast(known.schema["target"].dataType).alias("target")))
            looking = stage(up.where("parent is not null").select("ref", F.col("parent").alias("scope"), "parts", "doubt", (F.col("depth") + 1).alias("depth")))
        if done is None:
            done = looking.select("ref", "parts", "doubt", "depth", F.lit(None).cast(known.schema["target"].dataType).alias("target"))
        # members of what the first part stands for: only its own scope counts, and whether that is opaque
        inner, out = stage(done.where("size(parts) > 1 and target is not null").select("ref", "target", F.expr("slice(parts, 2, size(parts))").alias("parts"), "depth")), done.where("size(parts) = 1 or target is null")
        out = out.select("ref", "target", "doubt", "depth")
        while not inner.isEmpty():
            met = inner.select("ref", F.col("target").alias("scope"), F.col("parts")[0].alias("name"), "parts", "depth").join(known, ["scope", "name"], "left").join(doubt, "scope", "left")
            met = stage(met.select("ref", "target", "parts", "depth", F.coalesce("opaque", F.lit(False)).alias("doubt")))
            out = out.unionByName(met.where("size(parts) = 1 or target is null").select("ref", "target", "doubt", "depth"))
            inner = stage(met.where("size(parts) > 1 and target is not null").select("ref", "target", F.expr("slice(parts, 2, size(parts))").alias("parts"), "depth"))
        status = F.when(F.col("target").isNotNull(), "exists").when(F.col("doubt"), "unverifiable").otherwise("missing")
        return staged(out.select("ref", status.alias("status"), "target", F.when(F.col("target").isNotNull(), F.col("depth")).alias("depth")))
