"""History as a stream against the same as a batch, with a restart and a time to live; statements that carry their last target."""

import random

from pyspark.sql import functions as F

from tessera.operators import history, statements

SCHEMA = "key string, start string, end string, path array<string>, success boolean, quality double, items array<string>, at timestamp"


def facts(n, seed):
    import datetime

    r = random.Random(seed)
    names = list("abcde")
    for _ in range(n):
        path = r.sample(names, r.randint(0, 4))
        yield (r.choice(["k1", "k2", "k3", None]), *((path[0], path[-1]) if path else (None, None)), path, r.random() < 0.7, r.choice([None, round(r.random(), 3)]), r.sample(names, r.randint(0, 3)), datetime.datetime(2024, 1, r.randint(1, 20)))


def reports(tables):
    return [sorted(map(str, x.collect())) for x in (history.patterns(tables), history.importance(tables), tables["best"])]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [*facts(60, 1)]
    table = lambda own: spark.createDataFrame(own, SCHEMA)
    source, state, checkpoint = (f"{tmp_path}/{x}" for x in ("facts", "state", "checkpoint"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        history.record(stream, state, checkpoint).awaitTermination()

    table(rows[:35]).repartition(3).write.mode("append").parquet(source)
    run()
    table(rows[35:]).repartition(2).write.mode("append").parquet(source)
    run()  # a restart goes on where the last run ended
    run()
    whole = history.partials(table(rows))
    assert reports(history.together(history.read(spark, state))) == reports(history.together(whole))
    since = F.lit("2024-01-10").cast("date")
    young = history.partials(table([x for x in rows if x[-1].day >= 10]))
    assert reports(history.together(history.read(spark, state), since)) == reports(history.together(young))
    got = {x.key: x for x in history.patterns(history.together(whole)).collect()}
    for key in ("k1", "k2", "k3"):
        own = [x for x in rows if x[0] == key]
        assert (got[key].n, got[key].success_rate) == (len(own), round(sum(x[4] for x in own) / len(own), 6))
        assert abs(got[key].mean_quality - sum(x[5] or 0 for x in own) / len(own)) < 2e-6
    best = {(x.start, x.end): x.path for x in history.together(whole)["best"].collect()}
    good = [x for x in rows if x[4] and (x[5] or 0) > 0.5 and x[3]]
    assert best == {(s, e): max((x[5], -len(x[3]), x[3]) for x in good if (x[1], x[2]) == (s, e))[2] for s, e in {(x[1], x[2]) for x in good}}


def test_signs_follow_importance(spark):
    nodes = spark.createDataFrame([("a", 1.0), ("b", 0.4), ("c", 0.8)], "node string, importance double")
    signs = spark.createDataFrame([("a", ["b", "c", "z", "c"]), ("b", []), ("y", ["a"])], "node string, routes array<string>")
    got = {x.node: (x.important, x.routes) for x in history.adjusted(signs, nodes, most=2).collect()}
    assert got == {"a": (True, ["c", "b"]), "b": (False, []), "y": (False, ["a"])}


def test_statements_carry_their_last_target(spark):
    rows = [
        ("o", [0], "first", "s", "a"), ("o", [1], "then", None, "b"), ("o", [2], "note", "q", None), ("o", [2, 0], "then", None, "c"), ("o", [2, 1], "flow", None, "d"), ("o", [3], "then", None, None),
        ("o", [4], "then", None, "e"), ("o", [10], "connect", "x", "y"), ("p", [0], "then", None, "z"), ("p", [1], "odd", None, "w"), ("p", [2], "transition", None, "v"),
    ]
    table = spark.createDataFrame(rows, "owner string, place array<int>, kind string, source string, target string")
    got = [(x.src, x.dst, x.relation) for x in statements.carried(table.repartition(3)).orderBy("owner", "place").collect()]
    assert got == [("s", "a", "succession"), ("a", "b", "succession"), ("q", "c", "succession"), ("c", "d", "flow"), ("d", "e", "succession"), ("x", "y", "connected-to"), ("p", "z", "succession"), ("w", "v", "state-transition")]
