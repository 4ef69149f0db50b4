"""Queries on static checks, over stand-ins for model tables: orders own lines, turns follow turns, names resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT 'known_part' AS rule, 'error' AS severity, CAST(l_orderkey AS VARCHAR) AS node, 'unknown reference ' || l_partkey AS message FROM lineitem WHERE l_returnflag <> 'N' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def rule_missing_reference(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a part outside the registry; lines still open (N) are opaque and not judged."""
    known = table(spark, d, "part").where("p_size <= 40")
    return rules.missing_reference(table(spark, d, "lineitem"), "l_partkey", known, "p_partkey", "known_part", "l_orderkey", F.col("l_returnflag") == "N")


@query("SELECT 'single_return' AS rule, 'error' AS severity, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS node, 'member number ' || n AS message FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem WHERE l_returnflag = 'R') WHERE n > 1")
def rule_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """An order may own one returned line; the second and later are issues."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    node = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    return rules.second_and_later(returned, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "single_return", node)


@query("SELECT 'question_follows_answer' AS rule, 'error' AS severity, conv_id || '/' || turn AS node, 'parent is ' || p AS message FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE role = 'user' AND p IS NOT NULL AND p NOT IN ('assistant')")
def rule_parent_type(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("p", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    return rules.wrong_parent(turns, F.col("p"), ("assistant",), "question_follows_answer", F.concat_ws("/", "conv_id", "turn"))


BASES = "b AS (SELECT CAST(p_partkey AS VARCHAR) AS node, CAST((p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS VARCHAR) AS base FROM part)"


def part_bases(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    return part.join(F.broadcast(n)).select(F.col("p_partkey").cast("string").alias("node"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).cast("string").alias("base"))


@query(f"WITH RECURSIVE {BASES}, walk AS (SELECT node, base AS x FROM b UNION SELECT walk.node, b.base AS x FROM walk JOIN b ON b.node = walk.x) "
       "SELECT DISTINCT 'no_inheritance_cycle' AS rule, 'warning' AS severity, node, 'inheritance cycle' AS message FROM walk WHERE node = x")  # fmt: skip
def rule_inheritance_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Parts that inherit from themselves, over any number of steps."""
    return rules.inheritance_cycles(part_bases(spark, d), "no_inheritance_cycle").where("message = 'inheritance cycle'")


@query(f"WITH RECURSIVE {BASES}, walk AS (SELECT node, base AS x FROM b UNION SELECT walk.node, b.base AS x FROM walk JOIN b ON b.node = walk.x), c AS (SELECT node FROM walk WHERE node = x) "
       "SELECT DISTINCT 'no_inheritance_cycle' AS rule, 'warning' AS severity, node, CASE WHEN node IN (SELECT node FROM c) THEN 'inheritance cycle' ELSE 'leads into an inheritance cycle' END AS message FROM walk WHERE x IN (SELECT node FROM c)")  # fmt: skip
def rule_inheritance_cycle_whole(spark: SparkSession, d: str) -> DataFrame:
    return rules.inheritance_cycles(part_bases(spark, d), "no_inheritance_cycle")


@query("""WITH refs AS (SELECT DISTINCT p_brand || '::' || p_name AS ref, p_name AS l FROM part), a AS (SELECT p_brand || '::' || p_name AS name, min(CAST(p_partkey AS VARCHAR)) AS t, count(DISTINCT p_partkey) AS n FROM part WHERE p_size <= 3 GROUP BY 1),
b AS (SELECT p_name AS name, min(CAST(p_partkey AS VARCHAR)) AS t, count(DISTINCT p_partkey) AS n FROM part WHERE p_size = 50 GROUP BY 1),
m AS (SELECT ref, coalesce(a.n, b.n) AS n, coalesce(a.t, b.t) AS t FROM refs LEFT JOIN a ON a.name = ref LEFT JOIN b ON b.name = l)
SELECT ref, CAST(CASE WHEN n = 1 THEN t END AS VARCHAR) AS target, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM m""")
def rule_scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Qualified part names, looked up in full among small parts and then by their last part among large ones."""
    part = table(spark, d, "part")
    full = F.concat_ws("::", "p_brand", "p_name")
    near = part.where("p_size <= 3").select(full.alias("name"), F.col("p_partkey").cast("string").alias("target"))
    far = part.where("p_size = 50").select(F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("target"))
    return rules.resolve(part.select(full.alias("ref")).distinct(), [near, far])


#: Widening of number types.
RANKS = {"Natural": 1, "Integer": 2, "Rational": 3, "Real": 4, "Complex": 5}


@query("SELECT o_orderpriority AS declared, count(*) AS n, CAST(sum((rank > allowed)::INT) AS BIGINT) AS incompatible FROM (SELECT o_orderpriority, CASE WHEN o_totalprice = floor(o_totalprice) THEN 2 ELSE 4 END AS rank, CASE WHEN o_orderpriority < '3' THEN 2 ELSE 4 END AS allowed FROM orders) GROUP BY 1")
def type_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Inferred number types of values against those declared for their group: a wider one does not fit."""
    inferred = F.when(F.col("o_totalprice") == F.floor("o_totalprice"), RANKS["Integer"]).otherwise(RANKS["Real"])
    allowed = F.when(F.col("o_orderpriority") < "3", RANKS["Integer"]).otherwise(RANKS["Real"])
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("declared"), (inferred > allowed).cast("long").alias("bad"))
    return rows.groupBy("declared").agg(F.count("*").alias("n"), F.sum("bad").alias("incompatible"))


@query("SELECT 'lower_below_upper' AS rule, 'error' AS severity, CAST(l_orderkey AS VARCHAR) AS node, lo || '..' || hi AS message FROM (SELECT l_orderkey, CAST(max(l_linenumber) AS INTEGER) AS lo, CAST(count(*) AS INTEGER) AS hi FROM lineitem GROUP BY 1) WHERE lo > hi")
def rule_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of each order, largest line number and count of lines: the lower may not exceed the upper."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("int").alias("lo"), F.count("*").cast("int").alias("hi")).where("lo > hi")
    return rules.issues(rows, "lower_below_upper", "error", F.col("l_orderkey"), F.concat_ws("..", "lo", "hi"))
