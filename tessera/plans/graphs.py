"""Queries on graphs: the star schema as a typed graph, turns of conversations as a chunk graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import components, graph
from tessera.plans.tables import table

QUERIES, ORACLES = {}, {}

#: src table, prefix, key, dst prefix, key, relation: the star schema as edges.
STAR = (
    ("nation", "N:", "n_nationkey", "R:", "n_regionkey", "part-of"),
    ("customer", "C:", "c_custkey", "N:", "c_nationkey", "part-of"),
    ("supplier", "S:", "s_suppkey", "N:", "s_nationkey", "part-of"),
    ("orders", "O:", "o_orderkey", "C:", "o_custkey", "depends-on"),
    ("lineitem", "O:", "l_orderkey", "P:", "l_partkey", "uses"),
    ("lineitem", "P:", "l_partkey", "S:", "l_suppkey", "implements"),
)
STAR_SQL = "e AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT '{p}' || {k} AS src, '{q}' || {m} AS dst, '{r}' AS relation FROM {t}" for t, p, k, q, m, r in STAR) + "))"
NODES_SQL = "n AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"

#: Weights of relations in the score of a path.
WEIGHTS = {"part-of": 0.8, "depends-on": 0.7, "uses": 0.6, "implements": 0.9}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def star(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges (src, dst, relation) of the star schema."""
    out = None
    for name, p, k, q, m, r in STAR:
        rows = table(spark, d, name).select(F.concat(F.lit(p), F.col(k)).alias("src"), F.concat(F.lit(q), F.col(m)).alias("dst"), F.lit(r).alias("relation"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(i) for i in ids))).alias("id"))


@query(f"WITH {STAR_SQL}, {NODES_SQL}, c AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) "
       "SELECT id, k AS degree, round(k / (count(*) OVER () - 1)::DOUBLE, 9) AS centrality, round(k / max(k) OVER ()::DOUBLE, 9) AS importance FROM n JOIN c USING (id)")  # fmt: skip
def node_degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    e = star(spark, d)
    return graph.degrees(None, e).select("id", "degree", F.round("centrality", 9).alias("centrality"), F.round("importance", 9).alias("importance"))


def levels(start: str, depth: int, edges: str = "e") -> str:
    """SQL for reachable(): l0, l1, ... and their union r."""
    out = [f"l0 AS ({start})"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        out.append(f"l{k} AS (SELECT DISTINCT dst AS id FROM {edges} JOIN l{k - 1} ON src = id WHERE dst NOT IN ({seen}))")
    return ", ".join(out) + ", r AS (" + " UNION ALL ".join(f"SELECT id, {k} AS distance FROM l{k}" for k in range(depth + 1)) + ")"


TWO_ORDERS = "SELECT unnest(['O:1', 'O:7']) AS id"


@query(f"WITH {STAR_SQL}, {levels(TWO_ORDERS, 3)} SELECT id, distance FROM r WHERE distance > 0")
def neighbors_within_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(star(spark, d), seeds(spark, "O:1", "O:7"), 3).where("distance > 0")


@query(f"WITH {STAR_SQL}, rev AS (SELECT dst AS src, src AS dst FROM e), {levels(chr(83) + 'ELECT unnest([' + chr(39) + 'N:3' + chr(39) + ', ' + chr(39) + 'N:5' + chr(39) + ']) AS id', 2, 'rev')} SELECT id, distance FROM r")
def min_distance_to_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Least number of forward hops from each node to any seed, up to two, found backwards from the seeds."""
    e = star(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reachable(e, seeds(spark, "N:3", "N:5"), 2)


@query(f"WITH {STAR_SQL} SELECT dst AS id, relation, 'out' AS direction FROM e WHERE src = 'P:10' AND relation IN ('uses', 'implements') UNION ALL SELECT src, relation, 'in' FROM e WHERE dst = 'P:10' AND relation IN ('uses', 'implements')")
def related_nodes_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(star(spark, d), F.lit("P:10"), ("uses", "implements"))


BOTH = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(f"WITH {STAR_SQL}, {BOTH}, {levels(chr(83) + 'ELECT ' + chr(39) + 'S:1' + chr(39) + ' AS id', 2, 'u')} SELECT id, distance FROM r")
def explore_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(graph.undirected(star(spark, d)), seeds(spark, "S:1"), 2)


def path_levels(depth: int) -> str:
    out = ["p0 AS (SELECT 'O:1' AS id, ['O:1'] AS path)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM p{j}" for j in range(k))
        out.append(f"p{k} AS (SELECT dst AS id, min(list_append(path, dst)) AS path FROM u JOIN p{k - 1} ON src = id WHERE dst NOT IN ({seen}) GROUP BY dst)")
    return ", ".join(out) + ", paths AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth + 1)) + ")"


@query(f"WITH {STAR_SQL}, {BOTH}, {path_levels(3)} SELECT id, array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS n_nodes FROM paths")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """From one order to every node within three hops, in either direction."""
    rows = graph.shortest_paths(graph.undirected(star(spark, d)), "O:1", 3)
    return rows.select("id", F.array_join("path", ">").alias("path"), F.size("path").alias("n_nodes"))


WEIGHT_SQL = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " END"


@query(f"""WITH {STAR_SQL}, {BOTH}, {path_levels(2)}, g AS (SELECT id, least(count(*) / 100.0::DOUBLE, 1) AS i FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max({WEIGHT_SQL}) AS w FROM e GROUP BY ALL),
q AS (SELECT id, path, len(path) AS n FROM paths WHERE len(path) > 1),
im AS (SELECT q.id, avg(g.i) AS i FROM (SELECT id, unnest(path) AS node FROM q) q JOIN g ON g.id = q.node GROUP BY q.id),
we AS (SELECT s.id, avg(w) AS w FROM (SELECT id, path[k] AS x, path[k + 1] AS y FROM (SELECT id, path, unnest(generate_series(1, n - 1)) AS k FROM q)) s JOIN w ON a = least(x, y) AND b = greatest(x, y) GROUP BY s.id)
SELECT id, round(0.4::DOUBLE * i + 0.4::DOUBLE * w + 0.2::DOUBLE / (1 + 0.1::DOUBLE * greatest(n - 2, 0)), 6) AS quality FROM q JOIN im USING (id) JOIN we USING (id) WHERE 0.4::DOUBLE * i + 0.4::DOUBLE * w + 0.2::DOUBLE / (1 + 0.1::DOUBLE * greatest(n - 2, 0)) >= 0.3""")
def path_quality(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the shortest paths of two hops at most; those below 0.3 are left out."""
    e = star(spark, d)
    paths = graph.shortest_paths(graph.undirected(e), "O:1", 2).where(F.size("path") > 1)
    degree = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.least(F.count("*") / 100, F.lit(1.0)).alias("i"))
    weight = F.when(F.col("relation") == "part-of", WEIGHTS["part-of"])
    for k, v in WEIGHTS.items():
        weight = weight.when(F.col("relation") == k, v)
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(weight).alias("w"))
    importance = paths.select("id", F.explode("path").alias("node")).join(degree, "node").groupBy("id").agg(F.collect_list("i").alias("i"))
    steps = paths.select("id", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("x"), F.slice("path", 2, F.size("path")).alias("y"))).alias("s"))
    steps = steps.select("id", F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b")).join(pairs, ["a", "b"]).groupBy("id").agg(F.collect_list("w").alias("w"))
    return importance.join(steps, "id").select("id", F.round(graph.path_score(F.col("i"), F.col("w")), 6).alias("quality")).where("quality >= 0.3")


@query(f"WITH {STAR_SQL}, {BOTH} SELECT dst AS id FROM u WHERE src IN ('C:0', 'C:6') GROUP BY dst HAVING count(DISTINCT src) = 2")
def bridge_concepts(spark: SparkSession, d: str) -> DataFrame:
    return graph.common_neighbours(star(spark, d), "C:0", "C:6")


def by_year(spark: SparkSession, d: str, year: int) -> DataFrame:
    rows = table(spark, d, "orders").where(F.year("o_orderdate") == year)
    return rows.select(F.concat(F.lit("C:"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.col("o_orderstatus").alias("relation"))


def year_sql(year: int) -> str:
    return f"(SELECT 'C:' || o_custkey AS src, o_orderpriority AS dst, o_orderstatus AS relation FROM orders WHERE year(o_orderdate) = {year})"


@query(f"""SELECT what, sum((b = 0)::INT)::BIGINT AS only_a, sum((a = 0)::INT)::BIGINT AS only_b, sum((a + b = 2)::INT)::BIGINT AS shared, round(sum((a + b = 1)::INT) / count(*)::DOUBLE, 9) AS difference_rate FROM (
SELECT 'edges' AS what, src, dst, max(a) AS a, max(b) AS b FROM (SELECT src, dst, 1 AS a, 0 AS b FROM {year_sql(1995)} UNION ALL SELECT src, dst, 0, 1 FROM {year_sql(1996)}) GROUP BY src, dst
UNION ALL SELECT 'nodes', src, NULL, max(a), max(b) FROM (SELECT src, 1 AS a, 0 AS b FROM {year_sql(1995)} UNION ALL SELECT src, 0, 1 FROM {year_sql(1996)}) GROUP BY src) GROUP BY what""")
def graph_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = by_year(spark, d, 1995), by_year(spark, d, 1996)
    out = graph.compare(a, b, ["src", "dst"]).withColumn("what", F.lit("edges")).unionByName(graph.compare(a, b, ["src"]).withColumn("what", F.lit("nodes")))
    return out.withColumn("difference_rate", F.round("difference_rate", 9))


@query(f"SELECT src, dst, min({{'g': g, 'relation': relation}}).relation AS relation FROM (SELECT *, 0 AS g FROM {year_sql(1995)} UNION ALL SELECT *, 1 FROM {year_sql(1996)}) GROUP BY src, dst")
def graph_union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_first(by_year(spark, d, 1995), by_year(spark, d, 1996))



@query()
def cycle_check(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers, with an edge from each part to its suppliers and from a supplier to its first part: nodes on cycles."""
    li = table(spark, d, "lineitem")
    down = li.select(F.concat(F.lit("P:"), "l_partkey").alias("src"), F.concat(F.lit("S:"), "l_suppkey").alias("dst"))
    up = li.groupBy("l_suppkey").agg(F.min("l_partkey").alias("p")).select(F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "p").alias("dst"))
    return components.on_cycles(down.unionByName(up))


ORACLES["cycle_check"] = """WITH RECURSIVE e AS (SELECT DISTINCT 'P:' || l_partkey AS src, 'S:' || l_suppkey AS dst FROM lineitem UNION SELECT 'S:' || l_suppkey, 'P:' || min(l_partkey) FROM lineitem GROUP BY l_suppkey),
r AS (SELECT src AS a, dst AS b FROM e WHERE src LIKE 'S:%' UNION SELECT a, dst FROM r JOIN e ON src = b), s AS (SELECT a FROM r WHERE a = b)
SELECT a AS id FROM s UNION SELECT x.dst FROM e x JOIN e y ON y.src = x.dst WHERE x.src LIKE 'S:%' AND (y.dst = x.src OR EXISTS (SELECT 1 FROM r WHERE r.a = y.dst AND r.b = x.src))"""


@query("""WITH n AS (SELECT p_partkey, p_name, lower(replace(p_name, ' ', '')) AS k FROM part), c AS (SELECT k, min({'l': -length(p_name), 'n': p_name}).n AS name FROM n GROUP BY k)
SELECT DISTINCT c.name AS src, p_brand AS dst, 'is-a' AS relation FROM part JOIN n USING (p_partkey) JOIN c USING (k)""")
def alias_merge(spark: SparkSession, d: str) -> DataFrame:
    """Part names that are equal without spaces and case become the spaced, longest one."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_name").alias("alias"), F.lower(F.regexp_replace("p_name", " ", "")).alias("k"))
    best = names.groupBy("k").agg(F.min(F.struct((-F.char_length("alias")).alias("l"), "alias")).alias("m")).select("k", F.col("m.alias").alias("name"))
    edges = part.select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst"), F.lit("is-a").alias("relation"))
    return graph.merged(edges, names.distinct().join(best, "k").select("alias", "name"))


@query("""SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND abs(a.l_linenumber - b.l_linenumber) <= 10
GROUP BY 1, 2 HAVING count(*) >= 2""")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.band_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", 10, 2)


@query("""WITH RECURSIVE e AS (SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst FROM nation UNION SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer),
r AS (SELECT DISTINCT src AS id, 0 AS layer FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, layer + 1 FROM r JOIN e ON src = id) SELECT id, CAST(max(layer) AS INTEGER) AS layer FROM r GROUP BY id""")
def layer_assignment(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "nation").select(F.concat(F.lit("R:"), "n_regionkey").alias("src"), F.concat(F.lit("N:"), "n_nationkey").alias("dst"))
    below = table(spark, d, "customer").select(F.concat(F.lit("N:"), "c_nationkey").alias("src"), F.concat(F.lit("C:"), "c_custkey").alias("dst"))
    return components.layers(top.unionByName(below).distinct())


#: Which way a change travels along each kind of edge.
DIRECTIONS = {"part-of": "reverse", "depends-on": "reverse", "uses": "forward", "implements": "both"}


@query(f"""WITH {STAR_SQL}, s AS (SELECT src, dst, relation FROM e WHERE relation IN ('uses', 'implements') UNION ALL SELECT dst, src, relation FROM e WHERE relation IN ('part-of', 'depends-on', 'implements')),
l1 AS (SELECT dst AS id, array_to_string(list_sort(list_distinct(list(relation))), ',') AS kinds FROM s WHERE src = 'P:1' AND dst <> 'P:1' GROUP BY dst),
l2 AS (SELECT dst AS id, array_to_string(list_sort(list_distinct(list(relation))), ',') AS kinds FROM s JOIN l1 ON src = l1.id WHERE dst <> 'P:1' AND dst NOT IN (SELECT id FROM l1) GROUP BY dst)
SELECT id, 1 AS distance, kinds FROM l1 UNION ALL SELECT id, 2, kinds FROM l2""")
def impact_two_hops(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame(list(DIRECTIONS.items()), "relation string, direction string")
    rows = graph.impact(star(spark, d), kinds, seeds(spark, "P:1"))
    return rows.select("id", "distance", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH {STAR_SQL} SELECT src, dst, relation FROM e WHERE relation IN ('depends-on', 'part-of') AND src IN (SELECT 'O:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'C:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def traceability_view(spark: SparkSession, d: str) -> DataFrame:
    """Edges that leave urgent orders, and those that leave the customers these pull in."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    chosen = urgent.select(F.explode(F.array(F.concat(F.lit("O:"), "o_orderkey"), F.concat(F.lit("C:"), "o_custkey"))).alias("src")).distinct()
    return star(spark, d).where(F.col("relation").isin("depends-on", "part-of")).join(chosen, "src", "left_semi")


@query(f"""WITH {STAR_SQL}, h AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(text, ' the ')),
x AS (SELECT h.conv_id, c.turn, min(abs(c.turn - h.turn)) AS d FROM h JOIN conversations c ON c.conv_id = h.conv_id AND abs(c.turn - h.turn) <= 2 GROUP BY 1, 2)
SELECT conv_id, turn, CAST(d AS BIGINT) AS distance, round(least(1, 0.5::DOUBLE / greatest(1, d)), 9) AS graph_score FROM x""")
def graph_expand_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Turns within two steps of a hit, with a score that falls with the distance."""
    turns = table(spark, d, "conversations")
    hits = turns.where((F.col("role") == "user") & F.contains("text", F.lit(" the ")))
    near = hits.select("conv_id", F.col("turn").alias("hit"), F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("turn"))
    met = near.join(turns.select("conv_id", "turn"), ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min(F.abs(F.col("turn") - F.col("hit"))).alias("distance"))
    return met.withColumn("graph_score", F.round(F.least(F.lit(1.0), 0.5 / F.greatest(F.lit(1), F.col("distance"))), 9))


@query(f"""WITH {STAR_SQL}, {BOTH}, top AS (SELECT 'S:' || s_suppkey AS id, s_acctbal / 10000 AS base FROM supplier), deg AS (SELECT id, count(*) AS g FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
one AS (SELECT DISTINCT dst AS id FROM u WHERE src = 'N:1')
SELECT id, round(base + CASE WHEN one.id IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + 0.2::DOUBLE * g / max(g) OVER () + 0.1::DOUBLE * g / ((SELECT count(*) FROM (SELECT DISTINCT src FROM u)) - 1), 6) AS score FROM top JOIN deg USING (id) LEFT JOIN one USING (id)""")
def graph_aware_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers by balance, raised by closeness to a seed nation, by degree and by centrality."""
    e = star(spark, d)
    degree = graph.degrees(None, e).where(F.col("id").startswith("S:"))
    near = graph.reachable(graph.undirected(e), seeds(spark, "N:1"), 1).where("distance > 0")
    own = table(spark, d, "supplier").select(F.concat(F.lit("S:"), "s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("base"))
    rows = own.join(degree, "id").join(near, "id", "left")
    rows = rows.join(F.broadcast(rows.agg(F.max("degree").alias("top"))))  # one row
    boost = F.when(F.col("distance").isNotNull(), 0.3 / (F.col("distance") + 1)).otherwise(0.0)
    return rows.select("id", F.round(F.col("base") + boost + 0.2 * F.col("degree") / F.col("top") + 0.1 * F.col("centrality"), 6).alias("score"))


@query(f"""WITH {STAR_SQL}, {levels(TWO_ORDERS, 2, "(SELECT * FROM e WHERE relation IN ('uses', 'implements', 'depends-on'))")} SELECT split_part(id, ':', 1) AS entity_type, count(*) AS n, min(distance) AS nearest, string_agg(id, ',' ORDER BY distance, id) FILTER (place <= 10) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY split_part(id, ':', 1) ORDER BY distance, id) AS place FROM r WHERE distance > 0) GROUP BY 1""")
def evidence_by_relation(spark: SparkSession, d: str) -> DataFrame:
    """Per type, how many nodes two hops by some relations reach, and the ten nearest."""
    e = star(spark, d).where(F.col("relation").isin("uses", "implements", "depends-on"))
    rows = graph.reachable(e, seeds(spark, "O:1", "O:7"), 2).where("distance > 0")
    kinds = rows.withColumn("entity_type", F.split_part("id", F.lit(":"), F.lit(1)))
    counts = kinds.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("distance").alias("nearest"))
    return counts.join(graph.first_items(kinds, "entity_type", "id", ["distance", "id"], 10, "ids"), "entity_type").withColumn("ids", F.array_join("ids", ","))


@query("""WITH a AS (SELECT list_sort(list_distinct(list('P:' || l_partkey))) AS x FROM lineitem WHERE l_orderkey = 1), o AS (SELECT l_orderkey AS case_id, list_distinct(list('P:' || l_partkey)) AS y FROM lineitem GROUP BY 1)
SELECT case_id, list_sort(y) = x AS exact, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 9) AS node_jaccard FROM o, a""")
def eval_path_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Parts of each order against those of one expected order: equal sets and Jaccard index."""
    sets = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("P:"), "l_partkey"))).alias("y"))
    want = sets.where("l_orderkey = 1").select(F.col("y").alias("x"))
    rows = sets.join(F.broadcast(want))
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return rows.select(F.col("l_orderkey").alias("case_id"), (F.col("x") == F.col("y")).alias("exact"), F.round(jaccard, 9).alias("node_jaccard"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(url), '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages), c AS (SELECT DISTINCT path FROM p)
SELECT page_id, max_by(c.path, length(c.path)) AS parent FROM p JOIN c ON starts_with(p.path, c.path || '/') GROUP BY page_id""")
def effective_parent(spark: SparkSession, d: str) -> DataFrame:
    """The nearest page whose path is a proper prefix of a page's path: an equi-join on the exploded prefixes."""
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace(F.lower("url"), "^[a-z]+://|[?#].*$", "").alias("path"))
    parts = F.split("path", "/")
    ahead = paths.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).where("path <> ''")
    return ahead.join(paths.select("path").distinct(), "path", "left_semi").groupBy("page_id").agg(F.max_by("path", F.char_length("path")).alias("parent"))
