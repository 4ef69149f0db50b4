"""Semantic models as tables: ast_nodes (node_id, parent_id, type, name, ordinal, bases) become stable ids, typed edges and views.

Model texts are parsed elsewhere; these operators start from the rows of a syntax tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.staging import staged
from tessera.operators.rules import resolve

# Kinds of inheritance and the edges they become.
KINDS = {"specializes": "specialization", "subsets": "subsetting", "redefines": "redefinition", "typed_by": "feature_typing"}
# Types that belong to a view.
VIEWS = {"structure": "_(def|usage|instance)$", "requirements": "^(requirement|satisfy|verify)", "states": "^(state|transition)", "actions": "^(action|succession|flow)"}


def with_stable_ids(nodes: DataFrame) -> DataFrame:
    """nodes with stable_id: $root, parent::name (#n from the second of a name on), parent/type#k for nodes without a name.

    Ids are put together level by level, each staged, until one is empty; numbers count siblings in document order. Nodes that no root
    leads to are left out.
    """
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    same = Window.partitionBy("parent_id", "name").orderBy("ordinal")
    kind = Window.partitionBy("parent_id", "type", named).orderBy("ordinal")
    n, k = F.row_number().over(same), F.row_number().over(kind)
    step = F.when(named, F.concat(F.lit("::"), "name", F.when(n > 1, F.concat(F.lit("#"), n)).otherwise(""))).otherwise(F.concat(F.lit("/"), "type", F.lit("#"), k))
    rows = staged(nodes.withColumn("_step", step))
    level = rows.where("parent_id IS NULL").withColumn("stable_id", F.lit("$root"))
    out = level
    while True:
        parents = level.select(F.col("node_id").alias("parent_id"), F.when(F.col("stable_id") == "$root", F.lit("")).otherwise(F.col("stable_id")).alias("_parent"))
        level = rows.join(parents, "parent_id").withColumn("stable_id", F.regexp_replace(F.concat("_parent", "_step"), "^::", "")).drop("_parent").select(*out.columns)
        level = staged(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("_step")


def inheritance_edges(nodes: DataFrame, registries: list[DataFrame], libraries: DataFrame) -> DataFrame:
    """from_id, to_id, kind, reference_text, resolution_status for each base of a node (bases: array of kind and ref).

    A reference that nothing declares is external if its first part names a library package (package), else an error.
    """
    refs = nodes.select(F.col("stable_id").alias("from_id"), F.explode("bases").alias("b")).select("from_id", F.col("b.kind").alias("k"), F.col("b.ref").alias("ref"))
    met = refs.join(resolve(refs, registries), "ref")
    known = libraries.select(F.col("package").alias("first")).distinct().withColumn("outside", F.lit(True))
    met = met.withColumn("first", F.element_at(F.split("ref", "::"), 1)).join(known, "first", "left")
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("k") == a, b).otherwise(kind)
    status = F.when(F.col("status") == "resolved", "resolved").when(F.coalesce("outside", F.lit(False)), "unresolved_external").otherwise("unresolved_error")
    return met.select("from_id", F.col("target").alias("to_id"), kind.alias("kind"), F.col("ref").alias("reference_text"), status.alias("resolution_status"))


def ancestors(ids: Column) -> Column:
    """All proper ancestors of a stable id, nearest first: what is left when last :: or / parts go."""
    marked = F.regexp_replace(ids, "(::|/)", "\x01$1")
    parts = F.split(marked, "\x01")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), ""))).otherwise(F.array().cast("array<string>"))


def nearest_drawn(items: DataFrame, drawn: DataFrame, item: str = "id") -> DataFrame:
    """item, owner: the nearest of an id and its ancestors that is drawn (id); an equi-join on exploded prefixes."""
    steps = items.select(item, F.posexplode(F.concat(F.array(item), ancestors(F.col(item)))).alias("distance", "owner"))
    met = steps.join(drawn.select(F.col("id").alias("owner")).distinct(), "owner", "left_semi")
    return met.groupBy(item).agg(F.min_by("owner", "distance").alias("owner"))


def view(nodes: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view: nodes of its types, and resolved edges with both ends among them."""
    own = nodes.where(F.col("type").rlike(VIEWS[name]))
    ids = own.select(F.col("stable_id").alias("id"))
    kept = edges.where("resolution_status = 'resolved'").join(ids.toDF("from_id"), "from_id", "left_semi").join(ids.toDF("to_id"), "to_id", "left_semi")
    return own, kept


def multiplicity_label(low: Column, high: Column) -> Column:
    """n for equal bounds, else low..high; * for an open end; null without any bound."""
    top = F.coalesce(high.cast("string"), F.lit("*"))
    return F.when(low.isNull() & high.isNull(), None).when(low == high, low.cast("string")).when(low.isNull(), top).otherwise(F.concat(low.cast("string"), F.lit(".."), top))


def transition_label(trigger: Column, guard: Column, effect: Column) -> Column:
    """trigger [guard] / effect, of which any part may be missing; null if all are."""
    text = F.trim(F.concat_ws(" ", trigger, F.concat(F.lit("["), guard, F.lit("]")), F.concat(F.lit("/ "), effect)))
    return F.when(text != "", text)


def layered_places(layers: DataFrame, width: str, gap: float = 40.0, height: float = 40.0) -> DataFrame:
    """layers (id, layer, width) with x and y: boxes of a layer side by side in order of ids, layers below each other."""
    w = Window.partitionBy("layer").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return layers.withColumn("x", F.coalesce(F.sum(F.col(width) + gap).over(w), F.lit(0.0))).withColumn("y", F.col("layer") * (height + gap))


def connector_label(name: Column, first: Column, second: Column) -> Column:
    """[m1] name [m2], of which any part may be missing; null if all are."""
    text = F.concat_ws(" ", F.concat(F.lit("["), first, F.lit("]")), F.when(name != "", name), F.concat(F.lit("["), second, F.lit("]")))
    return F.when(text != "", text)


def relation_edges(rows: DataFrame, registries: list[DataFrame]) -> DataFrame:
    """from_id, to_id, kind, label of the relations of a model, both ends resolved; ends that nothing declares are null.

    rows: stable_id, parent_id (its parent's stable id), type, name, ends (array of ref and multiplicity), has_body. A connection with two ends and no
    body is one edge between them, any other has an edge from itself to each end. satisfy and verify lead from what fulfils (the second
    end, or the parent without one) to the requirement. A transition, succession or flow leads from its first end to its second, and from its
    parent if it has one end only.
    """
    own = rows.where(F.col("type").isin("connection", "satisfy", "verify", "transition", "succession", "flow")).where(F.size("ends") > 0)
    n, end = F.size("ends"), lambda k: F.try_element_at("ends", F.lit(k))
    joined = (F.col("type") != "connection") | ((n == 2) & ~F.coalesce("has_body", F.lit(False)))
    one, two = end(1)["ref"], end(2)["ref"]
    back = F.col("type").isin("satisfy", "verify")
    label = F.when(F.col("type") == "connection", connector_label(F.col("name"), end(1)["multiplicity"], end(2)["multiplicity"])).otherwise(F.when(F.col("name") != "", F.col("name")))
    direct = own.where(joined).select(
        "stable_id", F.when(n > 1, F.when(back, two).otherwise(one)).alias("a"), F.when(n <= 1, F.col("parent_id")).alias("a_id"),
        F.when((n > 1) & ~back, two).otherwise(one).alias("b"), F.col("type").alias("kind"), label.alias("label"),
    )
    spread = own.where(~joined).select("stable_id", F.explode("ends").alias("e"), F.col("type").alias("kind"), "name")
    spread = spread.select("stable_id", F.lit(None).cast("string").alias("a"), F.col("stable_id").alias("a_id"), F.col("e.ref").alias("b"), "kind", connector_label(F.col("name"), F.lit(None).cast("string"), F.col("e.multiplicity")).alias("label"))
    rows = direct.unionByName(spread)
    asked = rows.select(F.explode(F.array("a", "b")).alias("ref")).where("ref IS NOT NULL").distinct()
    found = resolve(asked, registries).where("status = 'resolved'").select("ref", "target")
    met = rows.join(found.toDF("a", "a_found"), "a", "left").join(found.toDF("b", "b_found"), "b", "left")
    return met.select(F.coalesce("a_id", "a_found").alias("from_id"), F.col("b_found").alias("to_id"), "kind", "label")


def located(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """issues (id and others) with owner and line: of the nearest of the id and its ancestors that has a line in nodes (stable_id, line)."""
    lines = nodes.where("line IS NOT NULL").groupBy(F.col("stable_id").alias("owner")).agg(F.min("line").alias("line"))
    owners = nearest_drawn(issues.select("id").distinct(), lines.select(F.col("owner").alias("id")))
    return issues.join(owners.join(lines, "owner"), "id", "left")


def attached(findings: DataFrame, drawn: DataFrame) -> DataFrame:
    """owner, n, worst: how many findings (id, severity: error before warning) each drawn node (id) owns, itself or for what lies below it."""
    owners = findings.join(nearest_drawn(findings.select("id").distinct(), drawn), "id")
    return owners.groupBy("owner").agg(F.count("*").alias("n"), F.min("severity").alias("worst"))
