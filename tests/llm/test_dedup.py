"""Decontamination, line dedup, near duplicates."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from querymill.llm import decontaminate, line_dedup, near_dup
from querymill.llm.queries import ORACLES, QUERIES
from querymill.llm.words import NOT_ALNUM, Words, slices
import pyarrow as pa

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_duckdb(spark, sf, name):
    mine = QUERIES[name](spark, sf).toPandas()
    assert difference(mine, connect(sf).execute(ORACLES[name]).df()) is None


def test_words_equal_regex():
    texts = ["", None, "  ", "A b\x0bC", "é1-ü_x", "x" * 70, " a b", "a" * 9 + " " + "b" * 17]
    for separators, pattern in ((NOT_ALNUM, WORD), (bytes([32, *range(9, 14)]), re.compile(r"[^\x20\x09-\x0D]+"))):
        w = Words(pa.array(texts), separators)
        for i, t in enumerate(texts):
            own = [w.text(k).decode() for k in range(w.first[i], w.first[i + 1])]
            assert own == pattern.findall(lowered(t))
    assert len(set(Words(pa.array(["ab abc abcdefgh abcdefghi AB"])).hashes().tolist())) == 4
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, "b", None, "c" * 10])], names=["t"])
    assert sum(p.num_rows for p in slices(batch, 0, 20)) == 4


def brute_windows(docs, items, window=10):
    found = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            found.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes, out = {len(k) for k in found}, []
    for doc, text in docs:
        w, hit, who = WORD.findall(lowered(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := found.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    who |= own
        out.append((doc, len(w), len(hit), sorted(who)))
    return out


def test_scan_equals_brute_force_on_few_words(spark, monkeypatch):
    random.seed(5)
    text = lambda n: " ".join(random.choice("abc") for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([12, 10, 3, 14, 2, 11])] + [(2, None), (7, "!!"), (None, "a b"), (8, "zz")]
    docs = [(i, text(random.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "zz ZZ, zz"), (61, text(30))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_windows(docs, [x for x in items if x[0] is not None]))
    for limit in (decontaminate.AUTOMATON_BYTES, 20):  # one automaton, then several
        monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
        got = decontaminate.scan(d, b).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((r[0], r[1], r[2], list(r[3])) for r in got) == want
    nothing = decontaminate.scan(d, b.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert nothing == 0 and decontaminate.scan(d.limit(0), b).count() == 0


def test_clean_cuts_spans_and_drops_covered_documents(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, f"Start here, {item.title()}! and go on with other words until the end of this long text"),
        (2, item), (3, "nothing to see"), (4, None),
        (5, "a b c d e f g h i j k l one two three four five " + item + " six seven eight nine ten m n o p q r s t u v w x y"),
    ]
    d = spark.createDataFrame([(*r, len(r[1] or ""), "z") for r in docs], "doc_id long, text string, n_chars long, items string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate.clean(d, b).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1]["text"] == "Start here, ! and go on with other words until the end of this long text"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[3]["text"] == "nothing to see" and out[4]["text"] is None
    assert decontaminate.scan(d.sparkSession.createDataFrame(list(out.values()), d.schema), b).agg(F.sum("n_hit")).first()[0] == 0


def test_clean_does_not_depend_on_the_number_of_automata(spark, monkeypatch):
    rng = random.Random(8)
    w = [f"w{i}" for i in range(60)]
    items = [w[0:10], w[10:20], w[20:30], w[30:40]] + [rng.choices(w[:8], k=rng.randint(2, 12)) for _ in range(30)]
    docs = [
        " ".join([*w[0:10], "x", *w[10:20], *"abcd"]),  # 20 of 25 words, 10 of each item
        " ".join([*w[0:5], *w[10:20], *w[5:10], *("y" + str(i) for i in range(90))]),  # a cut joins an item
        "Nothing — hit\nhere", None, "",
    ]
    docs += [" ".join(rng.choices(w[:10], k=rng.randint(5, 60)) + rng.choices(w, k=20)) for _ in range(120)]
    rows = [(i % 100, t, len(t or ""), "k") for i, t in enumerate(docs)]  # some ids repeat
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string").repartition(3)
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    single = sorted(map(str, decontaminate.clean(d, b).collect()))
    automaton = next(decontaminate.automata(b))
    want = {(i, t if t is None else decontaminate.cut_text(t, [automaton], 0.5)[0]) for i, t, _, _ in rows}
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 100)
    assert len(list(decontaminate.automata(b))) > 5
    out = decontaminate.clean(d, b)
    got = out.collect()
    assert out.columns == d.columns and sorted(map(str, got)) == single
    assert {(r[0], r[1]) for r in got} == {x for x in want if x[1] is not None} | {(3, None)}
    assert 0 not in {r["doc_id"] for r in got if r["text"] and "abcd"[0] in r["text"].split()}
    assert decontaminate.scan(out, b).agg(F.sum("n_hit")).first()[0] == 0


def brute_lines(docs, least=10):
    strip, owner = " \t\n\x0b\x0c\r", {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(strip))
            owner[key] = min(owner.get(key, doc), doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = [len(k := lowered(x.strip(strip))) >= least and owner[k] != doc for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_line_dedup_over_batches(spark, batches):
    random.seed(batches)
    pool = [f"Common line number {i}" for i in range(12)] + ["short", "", "  Common LINE number 3 ", "x" * 9, "y" * 10]
    docs = [(i, "\n".join(random.choices(pool, k=random.randint(1, 8)))) for i in range(60)] + [(60, None), (61, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit(0))
    out = line_dedup.dedup(d, batches=batches)
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in out.collect())
    assert got == brute_lines(docs)
    assert out.where("n_chars <> length(text)").isEmpty() and out.columns[:4] == d.columns
    assert line_dedup.dedup(d.limit(0), batches=batches).count() == 0


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, buckets=2)
    for k in range(5):
        runs.add(spark.range(k, 10 * (k + 1), 1).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(k).cast("long").alias("owner")))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    seen = {}
    for run in runs.runs:
        for r in run.collect():
            assert r["h1"] not in seen
            seen[r["h1"]] = r["owner"]
    assert seen == {i: i // 10 for i in range(50)}
    database = Path(spark.sql(f"DESCRIBE DATABASE {runs._database}").where("info_name = 'Location'").first()[1].removeprefix("file:"))
    assert len(list(database.iterdir())) == 2  # replaced runs leave no files
    runs.close()
    assert not database.exists()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_read_in_order(spark):
    rows = lambda low: spark.range(low, low + 500).select(F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.lit(low).alias("owner"))
    runs = line_dedup.LineRuns(spark, buckets=4)
    a, b = (runs._write(rows(low).repartition(4, *line_dedup.HASH)) for low in (0, 1_000))
    batch = rows(200).repartition(4, *line_dedup.HASH)
    with line_dedup.ordered_buckets(spark):
        joined = plan_of(batch.hint("merge").join(spark.table(a), line_dedup.HASH, "left_anti"))
        merged = plan_of(runs.merged([a, b]))
    assert joined.count("SortMergeJoin") == 1 and joined.count("Sort [") == 1 and joined.count("Exchange") == 1
    assert merged.count("SortMergeJoin") == 1 and "Sort [" not in merged and "Exchange" not in merged
    assert runs.merged([a, b]).count() == 1_000
    runs._drop([a, b])
    runs.close()


def test_line_dedup_beside_clashing_columns_and_odd_rows(spark):
    line, long_ = "A line that is common enough", "long " * 400_000
    rows = [(None, line), (3, f"{line}\nown"), (1, line), (3, f"{line}\nown"), (2, None), (4, f"{long_}\n{line}\n{long_}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("_doc", "_gone", "_LINES", "n_lines", "position", "h1"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = line_dedup.dedup(docs, batches=2)
    assert out.columns == [*docs.columns, "n_dropped"]
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in out.where("_doc = 'mine' and _gone = 'mine' and h1 = 'mine'").collect()), key=str)
    assert got == [(0, line, 0), (1, line, 0), (2, None, 0), (3, "own", 1), (3, "own", 1), (4, f"{long_}\n{long_}", 1)]


def shingle_sets(docs):
    out = {}
    for doc, text in docs:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", lowered(text))]
        out[doc] = set(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(docs):
    sets = shingle_sets(docs)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((k, len(sets[k]), root(k), root(k) == k) for k in keys)


def test_near_duplicates_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_near_dup"](spark, sf).collect())) == brute_components(docs)


def test_one_id_with_several_texts_loses_none(spark):
    """Every row is a document of its own, however ids repeat."""
    text = lambda *w: " ".join(f"{x}{i}" for x in w for i in range(60))
    a, b, c, d = text("a"), text("b"), text("c"), text("d")
    near = a.replace("a7 ", "zz ")
    rows = [(3, b), (5, a), (5, b), (5, a), (9, near), (7, c), (7, d), (8, d), (1, near), (7, None), (2, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.components(docs).collect()}
    n = 56
    assert got == {(3, n, 3, True), (5, n, 1, False), (5, n, 3, False), (9, n, 1, False), (1, n, 1, True), (7, n, 7, True), (8, n, 7, False), (7, 0, 7, True), (2, 0, 2, True)}
    left = near_dup.dedup(docs)
    assert left.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(kept, key=str) == sorted([(3, b), (1, near), (7, c), (7, d), (7, None), (2, "")], key=str)
    # a second text of a kept id stays although another text of that id is a copy
    more = spark.createDataFrame([(3, b), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, near_dup.dedup(more).collect())) == sorted([(3, b), (5, a)])


def test_near_duplicates_family_chain_and_odd_rows(spark):
    random.seed(9)
    base = [f"w{i}" for i in range(120)]

    def edited(k):
        words = list(base)
        for i in random.sample(range(120), k):
            words[i] = f"n{random.random()}"
        return " ".join(words)

    docs = [(i + 10, edited(random.randint(0, 6))) for i in range(120)]
    chain = [(200 + i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 100))) for i in range(8)]
    odd = [(300, None), (301, ""), (302, "a b"), (303, "A  B\n"), (304, "a b c"), (5, " ".join(base).upper())]
    rows = docs + chain + odd
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(5)
    assert sorted(map(tuple, near_dup.components(d).collect())) == brute_components(rows)
    kept = {r["doc_id"] for r in near_dup.dedup(d).collect()}
    assert kept == {k for k, _, _, own in brute_components(rows) if own}
    again = near_dup.components(d.unionByName(d)).distinct()
    assert sorted(map(tuple, again.collect())) == brute_components(rows)
    assert near_dup.components(d.limit(0)).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    ra, rb, both = near_dup.registers([np.unique(a), np.unique(b), np.unique(np.concatenate([a, b]))])
    assert (near_dup.merge(ra, rb) == both).all()
    found = near_dup.similarity(ra[None], rb[None], np.array([900.0]), np.array([900.0]))[0]
    assert abs(found - 700 / 1100) < 0.15
    assert not near_dup.registers([np.zeros(0, np.uint64)]).any()
