"""Decontamination, line and near-duplicate removal and components, against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, graphs, line_dedup, near_dedup
from tests.llm.test_texts import ODD, SCHEMA


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_leaks(docs, items, size=10):
    out = Counter()
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            v = words(item)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n and name is not None else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(str(name))
        out[(i, len(w), len(hit), tuple(sorted(names)))] += 1
    return out


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "Short, item"), (3, "same same same same same same same same same same same same"), (4, None), (5, ""), (None, "x y"), (10, item), (10, item)]
    docs = [
        (1, "before " + item.upper() + " after"), (2, "one two three four five six seven eight nine"), (3, "same " * 15), (4, "short-item short ITEM item"),
        (5, None), (5, "short item"), (6, ""), (None, "short item"), (7, item), (7, item), (8, "two three four five six seven eight nine ten eleven"), (9, "É one"),
    ]
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, item_id string, pos int"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()) == brute_leaks(docs, items)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in decontaminate.drop_contaminated(table, spark.createDataFrame(items, "item_id long, text string")).collect()))) == ["2", "5", "6", "9"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(table, none).count() == len(docs)
    assert decontaminate.find_leaks(table.limit(0), none).count() == 0


def brute_lines(docs, min_words=4, near_words=8):
    def edit(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))

    first, out = {}, []
    for i, text in sorted(docs):
        for n, line in enumerate(text.split("\n")):
            w = tuple(line.lower().split())
            if len(w) >= min_words:
                first.setdefault(w, (i, n))
    order = sorted(first, key=first.get)
    near = {w for k, w in enumerate(order) if len(w) >= near_words and any(len(v) >= near_words and edit(list(v), list(w)) for v in order[:k])}
    for i, text in sorted(docs):
        lines = text.split("\n")
        keep = [x for n, x in enumerate(lines) if len(w := tuple(x.lower().split())) < min_words or (first[w] == (i, n) and w not in near)]
        out.append((i, "\n".join(keep)))
    return out


def test_lines(spark):
    base = "a quick brown fox jumps over the lazy dog today"
    docs = [
        (1, base + "\nshort\n\nfour words stand here"), (2, base.replace("lazy", "calm") + "\nshort\nFour  words stand here "), (3, base + " again\nnew line of exactly eight words here now"),
        (4, base.replace("lazy ", "") + "\n" + base.replace("quick", "slow").replace("dog", "cat")), (5, ""), (6, "x"), (7, base + "\n" + base), (8, "the a quick brown fox jumps over the lazy dog today"),
        (9, base.replace("lazy", "calm").replace("dog", "cat")), (10, "new line of exactly eight words here\n" + "w " * 3000), (11, "w " * 2999 + "v"),
    ]
    table = spark.createDataFrame([(*d, 1, "x", -1) for d in docs], "doc_id long, text string, gone int, words string, ld_removed int")
    got = line_dedup.deduplicated(table)
    assert got.columns == [*table.columns, "ld_removed_"] and {r.ld_removed for r in got.collect()} == {-1}
    assert sorted((r.doc_id, r.text) for r in got.collect()) == brute_lines(docs)


def test_lines_of_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(docs).collect())
    assert got == brute_lines([tuple(r) for r in docs.select("doc_id", "text").collect()])


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_long_lines_may_differ_in_more_words(spark):
    draw = random.Random(7)
    docs = []
    for n in [*range(17, 36), 50, 80]:
        base = [f"w{draw.randrange(12 * n)}" for _ in range(n)]
        for edits in (0, 1, 2, 2, 3, 3, 4):
            line = list(base)
            for _ in range(edits):
                at, kind = draw.randrange(len(line)), draw.randrange(3)
                line[at : at + (kind != 1)] = [f"x{draw.randrange(9)}"] * (kind != 2)
            docs.append((len(docs), " ".join(line)))
    lines = [t.split() for _, t in docs]
    near = lambda x, y: x == y or abs(len(x) - len(y)) <= 3 and distance(x, y) <= max(1, min(3, min(len(x), len(y)) // 10))
    want = [(i, "" if any(near(lines[i], lines[j]) for j in range(i)) else t) for i, t in docs]
    got = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), most_edits=3)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want


def test_parts_that_many_lines_share(spark):
    """A passage in many different lines is joined with other parts; near lines among them are still found."""
    draw = random.Random(3)
    passage, docs = [f"p{i}" for i in range(30)], []
    for k in range(60):
        own = [f"u{draw.randrange(10**6)}" for _ in range(14)]
        for line in (own + passage, own[:5] + ["new"] + own[5:] + passage[:-1]) if k % 3 == 0 else (own + passage,):
            docs.append((len(docs), " ".join(line)))
    lines = [t.split() for _, t in docs]
    want = {i for i in range(len(docs)) if any(distance(lines[i], lines[j]) <= 3 for j in range(i))}
    assert len(want) == 20
    rows = spark.createDataFrame([(False, i, 0, 0, w) for i, w in enumerate(lines)], "k_null boolean, k_id long, k_text long, ln int, words array<string>")
    assert {r.mine.k_id for r in line_dedup.near_by_parts(rows, 3, 10, 20, shared=5).collect()} == want


def test_equal_lines_go_at_every_length(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import queries

    text = "日本語のテキストです。今日はとても良い天気ですね"
    docs = [(1, f"Short\n\nIntro\n \n{text}"), (2, f"short\n\nIntro\n \n{text[:-2]}だ"), (3, f"INTRO  \na b c\n{text}\na b  c\na b d")]
    want = [(1, docs[0][1]), (2, "\n "), (3, "a b c\na b d")]
    table = spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.text) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()) == want
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_lines(spark, table, str(tmp_path)).collect()) == want


def test_banded_distance():
    draw = random.Random(5)
    for _ in range(3000):
        x, y = ([draw.choice("ab") for _ in range(draw.randrange(9))] for _ in range(2))
        assert all(line_dedup.within(x, y, k) == (distance(x, y) <= k) for k in range(4))


def test_lines_of_odd_rows(spark):
    got = line_dedup.deduplicated(spark.createDataFrame(ODD, SCHEMA))
    assert got.count() == len(ODD) and got.where("text is null").count() == 1
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_hashed_in_vectors_are_those_of_split():
    """Hashes of words, eight bytes at a time, are equal where the words are, in the lines that split() finds."""
    draw = random.Random(11)
    spaces = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    letters = "ab\u00e9\u0130\u03a3\u65e5\u0e01\U0001f600\x00" + spaces
    texts = ["", "\n", " ", "a", "x" * 63 + " " + "x" * 64 + " " + "x" * 65 + " " + "x" * 66 + "\n" + "x" * 64, *(f"a{c}b" for c in spaces), "\ud800 a"]
    texts += ["".join(draw.choice(letters if draw.random() < 0.5 else "ab ") for _ in range(draw.randrange(150))) for _ in range(400)]
    names = {}
    for unspaced in (False, True):
        for some in ([t] for t in texts), [texts]:
            for own in some:
                h, sizes, counts = line_dedup.hashed_words(own, unspaced)
                lines = [list(line_dedup.words_of(t, unspaced)) for t in own]
                assert counts.tolist() == [len(x) for x in lines] and sizes.tolist() == [len(w) for x in lines for w in x]
                for word, name in zip((w for x in lines for line in x for w in line), h.tolist(), strict=True):
                    assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names) > 500


def test_distinct_lines_travel_without_their_parts(spark, sf_dir, monkeypatch):
    """Parts of a line that a task meets again are made once; lines to compare are named by one row for each document."""
    own, staged = common.stage, {}

    def kept(df, name):
        staged[name] = out = own(df, name)
        return out

    monkeypatch.setattr(line_dedup, "stage", kept)
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine {i // 50}\n" * 3) for i in range(100)], "doc_id long, text string").coalesce(1)
    got = line_dedup.deduplicated(docs, min_words=1, most_edits=3, letters=True)
    assert got.where("text = ''").count() == 99 and got.agg(F.sum("ld_removed")).head()[0] == 299
    assert "parts" not in staged["distinct-lines"].columns and staged["distinct-lines"].count() == 2
    assert staged["lines"].where(F.size("parts") > 0).count() == 2
    assert staged["close-lines"].count() == 2 and staged["close-words"].count() == 2


def brute_groups(docs, k, percent=80):
    sets = []
    for i, text in docs:
        w = tuple((text or "").encode().lower().split())
        sets.append({w[a : a + k] for a in range(len(w) - k + 1)} or ({w} if w else set()))
    root = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = root[x], root[y]
                root = [a if r == b else r for r in root]
    least = {r: min(docs[x][0] for x in range(len(docs)) if root[x] == r) for r in set(root)}
    return sorted((docs[x][0], len(sets[x]), least[root[x]]) for x in range(len(docs)))


def test_few_lines_meet_without_moving_all(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return common.stage(df, name)

    monkeypatch.setattr(line_dedup, "stage", seen)
    base = [f"w{i}" for i in range(60)]
    far = [" ".join(base[:30] + [f"x{k}y{i}" for i in range(30)]) for k in range(12)]  # a part in common, but not near
    near = [" ".join([*base[:30], f"z{k}", *[f"x0y{i}" for i in range(1, 30)]]) for k in range(2)]
    docs = spark.createDataFrame([(k, line) for k, line in enumerate([*far, *near, "only equal", "only equal", near[1]])], "doc_id long, text string")
    got = line_dedup.removals(docs, min_words=1, most_edits=3)
    assert {(r.k_id, tuple(r.gone)) for r in got.collect()} == {(12, (0,)), (13, (0,)), (15, (0,)), (16, (0,))}
    sides = plans["touched-lines"].split("Union")[1]
    assert "(times" in sides and sides.count("Join") == 1  # of all lines only those that occur again take part, and without a join
    rows = docs.limit(12).select(F.lit(False).alias("k_null"), F.col("doc_id").alias("k_id"), F.lit(0).cast("long").alias("k_text"), F.lit(0).alias("ln"), F.split("text", " ").alias("words"))
    assert line_dedup.near_by_parts(rows, 3, 10, 20, shared=5).count() == 0
    assert "lines-of-hot-parts" in plans  # counted, and broadcast if they are few


@pytest.mark.parametrize("k", [2, 5])
def test_near_copies(spark, sf_dir, k):
    base = [f"w{i}" for i in range(100)]
    docs = [(2000 + j, " ".join([f"v{j}" if i == 9 * j % 97 else x for i, x in enumerate(base)])) for j in range(30)]
    docs += [(3000, None), (3001, ""), (3002, "one"), (3003, "ONE"), (3004, "one two"), (3005, "\n one\ttwo "), (3006, "é one")]
    docs += [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.clustered(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int"), shingle=k)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, k)


def test_near_copies_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = near_dedup.clustered(docs).collect()
    assert len(got) == len(ODD) and all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_dedup.drop_near_copies(docs).count() == len(ODD)
    assert near_dedup.clustered(docs.limit(0)).count() == 0


def test_few_agreements_prune_only_unlikely_pairs():
    least = near_dedup.least_agreements(252, 42, 0.8, 1e-6)
    assert least == sorted(least) and all(0.3 * n < m < 0.8 * n for m, n in zip(least, range(42, 253, 42), strict=True))


@pytest.mark.parametrize("edges_of_a_task", [400_000, 9])
def test_components(spark, monkeypatch, edges_of_a_task):
    monkeypatch.setattr(graphs, "TASK_EDGES", edges_of_a_task)
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in graphs.stars(spark.createDataFrame(chain, "a long, b long").repartition(6)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)} | {201: 200}
    assert graphs.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_broadcasts(spark, monkeypatch):
    """Results are the same where no table is small enough, and where the benchmark is met in blocks."""
    for module in (decontaminate, line_dedup, near_dedup):
        monkeypatch.setattr(module, "small", lambda df: df)
    monkeypatch.setattr(decontaminate, "WANTED", 3)
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item")]
    docs = [(1, "x " + items[0][1].upper()), (2, "a short item\nfour words stand here"), (3, "four words stand here"), (4, None), (5, "one two three four five six seven eight nine")]
    docs += [(10 + k, " ".join(f"w{i if i != 9 * k else 'x'}" for i in range(40))) for k in range(4)]
    table, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(table, own)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()) == brute_leaks(docs, items)
    assert sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(table.where("text is not null")).collect()) == brute_lines([d for d in docs if d[1]])
    got = near_dedup.clustered(table, shingle=2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_groups(docs, 2)


def files_of(spark, monkeypatch, run):
    """What run() returns, and the number of files of the largest table that it stages, with 64 shuffle partitions that Spark leaves as they are."""
    own, counts = common.stage, {}

    def counted(df, name):
        out = own(df, name)
        counts[name] = len(out.inputFiles())
        return out

    for module in (decontaminate, line_dedup):
        monkeypatch.setattr(module, "stage", counted)
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        return run(), counts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_leaks_of_few_rows_are_few_files(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(str, decontaminate.find_leaks(docs, items).collect()))
    want = rows()
    found, counts = files_of(spark, monkeypatch, rows)
    assert found == want and {"windows", "parts", "wanted", "prefixes", "proven"} <= set(counts) and max(counts.values()) <= 8, counts


def test_lines_of_few_rows_are_few_files(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: sorted(map(str, line_dedup.deduplicated(docs, min_words=1, most_edits=3, letters=True).collect()))
    want = rows()
    found, counts = files_of(spark, monkeypatch, rows)
    assert found == want and {"distinct-lines", "variants", "near-lines", "removals"} <= set(counts) and max(counts.values()) <= 8, counts


def test_tables_that_name_few_lines_are_single_files(spark, sf_dir, monkeypatch):
    """Each file starts processes; what has few rows of its source is not written by as many tasks as that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: sorted(map(str, line_dedup.deduplicated(docs, min_words=1, most_edits=3, letters=True).collect()))
    want = rows()
    found, counts = files_of(spark, monkeypatch, rows)
    few = ("parts-of-many", "close-lines", "near-to-first", "near-lines", "touched-lines", "removals")
    assert found == want and max(counts.get(name, 1) for name in few) == 1 and sum(counts.values()) <= 45, counts
    wide = spark.range(0, 1000, 1, 64)
    assert [common.few_files(wide, size, 8).rdd.getNumPartitions() for size in (0, (20 << 22) + 1, 1 << 40)] == [1, 3, 64]


def test_files_grow_with_the_source(spark):
    rows = spark.range(0, 1000, 1, 64)
    assert common.few_files(rows, 0).rdd.getNumPartitions() == 8 and common.few_files(rows, (20 << 22) + 1).rdd.getNumPartitions() == 21
    assert common.few_files(rows, 1 << 40).rdd.getNumPartitions() == 64 and common.few_files(rows, 0).count() == 1000
    assert common.staged_bytes(common.stage(rows, "sized")) > 1000


def test_small_is_few_rows_and_few_bytes(spark):
    from tessera.llm.common import small

    hinted = lambda df, **bounds: "broadcast" in small(df, **bounds)._jdf.queryExecution().logical().toString()
    rows = spark.createDataFrame([(k, "x" * 100, [k] * 50) for k in range(20)], "k long, t string, a array<long>")
    assert hinted(rows) and not hinted(rows, rows=19) and not hinted(rows, size=3000) and hinted(rows.select("k"), size=1)


def test_near_copies_of_the_pipeline_are_found(spark, sf_dir):
    """Of the documents that brute force links at word pairs, the stage keeps one for each group."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {i for i, _, root in brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 2) if i == root}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()} == want


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = spark.createDataFrame(after.collect(), docs.schema)
    left = {r.doc_id for r in docs.collect()}
    assert left and {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select(F.col("doc_id")).distinct().collect()} == left


def test_pipeline_of_odd_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, n_chars long, toxicity double, ld_removed int, gone int, row string, node int, s string, k_id long"
    rows = [(i, t, len(t or ""), 9.0, 1, 2, "r", 3, "s", 4) for i, t in [(1, None), (2, ""), (3, "same line here"), (3, "same line here"), (4, "same line here"), (None, "no id"), (None, None), (5, "long " * 3000)]]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        left = Counter((r.doc_id, r.text, r.n_chars, r.toxicity, r.row) for r in docs.collect())
        want = [(1, None), (2, ""), (3, "same line here"), (3, "same line here"), (4, ""), (None, "no id"), (None, None), (5, "long " * 3000)]
        assert left == (Counter((i, t, len(t or ""), 9.0, "r") for i, t in want) if table.count() else Counter())
        assert corpus_pipeline.pack(spark, docs, sf_dir).select("doc_id").distinct().count() == len({i for i, *_ in left})
