"""Types and texts of expressions that are held as trees in a table of nodes, from the leaves up.

A node is evaluated once all of its operands are: round by round, the parents of what the last round evaluated. Rounds are bounded by the height of the
tallest tree, and each node is joined with its operands once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.staging import rounds, staged

# Widths of number types, the type of each width, and what functions give.
WIDTHS = {"Integer": 1, "Natural": 1, "Positive": 1, "Real": 2, "Number": 2, "Complex": 3}
WIDEST = {1: "Integer", 2: "Real", 3: "Complex"}
FUNCTIONS = {"size": "Integer", "length": "Integer", "isEmpty": "Boolean", "toString": "String"}


def looked_up(value: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def literal_type(value: Column) -> Column:
    """Of a literal as it is written: quoted text, number, truth value; null for anything else."""
    quoted = value.rlike(r"""^(".*"|'.*')$""")
    return F.when(quoted, "String").when(value.rlike(r"^[+-]?[0-9]+$"), "Integer").when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), "Real").when(F.lower(value).isin("true", "false"), "Boolean")


def evaluated(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """tree, node, type, text: of every node of nodes (tree, node, parent, ord, kind, value); type is null where it cannot be told.

    kind is literal or name (value is what is written; names have their type in symbols, name and type), binary, unary or call (value is the operator or
    function), conditional (condition, then, else in order), or chain (the last part's type). Text: operands around the operator, `…` for kinds without a text.
    Nodes in a circle, or under none, are never evaluated and left out; operands are taken in order of ord, then node.
    """
    with rounds(nodes.sparkSession) as stage:
        own = nodes.select("tree", "node", "parent", "ord", "kind", "value")
        counts = own.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("needs"))
        types = symbols.groupBy(F.col("name").alias("value")).agg(F.min("type").alias("known"))
        own = stage(own.join(counts, ["tree", "node"], "left").join(types, "value", "left"))
        leaf = F.when(F.col("kind") == "literal", literal_type(F.col("value"))).when(F.col("kind") == "name", F.coalesce(F.col("known"), literal_type(F.col("value")))).when(F.col("kind") == "call", looked_up(F.col("value"), FUNCTIONS))
        text = F.when(F.col("kind").isin("literal", "name"), F.coalesce("value", F.lit("…"))).otherwise("…")
        level = stage(own.where("needs is null").select("tree", "node", "parent", "ord", leaf.alias("type"), text.alias("text")))
        done = level
        waiting = stage(own.where("needs is not null").select("tree", "node", "parent", "ord", "kind", "value", "needs"))
        while not level.isEmpty():
            near = level.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
            ready = waiting.join(near, ["tree", "node"], "left_semi")
            operands = done.select("tree", F.col("parent").alias("node"), F.struct("ord", F.col("node").alias("id"), "type", "text").alias("x"))
            met = ready.join(operands, ["tree", "node"]).groupBy("tree", "node", "parent", "ord", "kind", "value", "needs").agg(F.array_sort(F.collect_list("x")).alias("x")).where(F.size("x") == F.col("needs"))
            level = stage(met.select("tree", "node", "parent", "ord", joined_type(F.col("kind"), F.col("value"), F.col("x.type")).alias("type"), joined_text(F.col("kind"), F.col("value"), F.col("x.text")).alias("text")))
            done = done.unionByName(level)
            waiting = stage(waiting.join(level.select("tree", "node"), ["tree", "node"], "left_anti"))
        return staged(done.select("tree", "node", "type", "text"))


def joined_type(kind: Column, operator: Column, types: Column) -> Column:
    a, b, c = (F.get(types, F.lit(k)) for k in range(3))
    width = lambda t: looked_up(t, WIDTHS)
    wider = looked_up(F.greatest(width(a), width(b)), WIDEST)
    known = a.isNotNull() & b.isNotNull()
    binary = (
        F.when(operator.isin("+", "-", "*", "/"), F.when(width(a).isNotNull() & width(b).isNotNull(), wider)).when(operator.isin("<", ">", "<=", ">=", "==", "!="), F.when(known, "Boolean"))
        .when(operator.isin("and", "or"), F.when((a == "Boolean") & (b == "Boolean"), "Boolean"))
    )
    unary = F.when(operator.isin("+", "-"), F.when(a.isin("Integer", "Real", "Complex", "Number"), a)).when(operator == "not", F.when(a == "Boolean", a))
    branch = F.when(b == c, b).when(width(b).isNotNull() & width(c).isNotNull(), looked_up(F.greatest(width(b), width(c)), WIDEST))
    return (
        F.when((kind == "binary") & (F.size(types) == 2), binary).when((kind == "unary") & (F.size(types) == 1), unary).when(kind == "call", looked_up(operator, FUNCTIONS))
        .when((kind == "conditional") & (F.size(types) == 3), F.when(a == "Boolean", branch)).when(kind == "chain", F.element_at(types, -1))
    )


def joined_text(kind: Column, operator: Column, texts: Column) -> Column:
    return F.when((kind == "binary") & (F.size(texts) == 2), F.concat_ws(" ", F.get(texts, F.lit(0)), F.coalesce(operator, F.lit("?")), F.get(texts, F.lit(1)))).otherwise("…")
