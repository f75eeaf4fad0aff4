"""Exact duplicates, hard negatives, ranked lexical search."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import ball_tree, exact_dup, hard_negatives


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact duplicates


def test_marks_equal_brute_force(spark):
    random.seed(3)
    texts = [None, "", "É a", "é a", "Same", "sAME", "same ", "x" * 70 + "a", "X" * 70 + "b", "y" * 300_000, "Y" * 300_000]
    rows = [(i, random.choice(texts), "k") for i in range(80)] + [(7, "Same", "k"), (7, "Same", "k"), (None, "same", "k"), (None, "only here", "k"), (-5, "Ʞ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    got = exact_dup.mark(docs)
    assert got.columns == ["doc_id", "text", "keep_id", "group_size", "kept"]
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lowered(t), []).append(i)
    kept = {}
    for r in got.collect():
        ids = groups[lowered(r["text"])]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[lowered(r["text"])] = kept.get(lowered(r["text"]), 0) + 1
    assert kept == {t: 1 for t in groups}
    assert sorted(map(str, (r["doc_id"] for r in got.collect()))) == sorted(str(i) for i, _, _ in rows)


def test_dedup_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(1, "A", 5, 6), (2, "a", 7, 8), (3, None, 9, 9), (3, None, 9, 9), ], "doc_id long, text string, _token int, group_size int")
    assert sorted(map(tuple, exact_dup.dedup(docs).collect()), key=str) == [(2, "a", 7, 8), (3, None, 9, 9)]
    assert exact_dup.dedup(docs.limit(0)).count() == 0 and exact_dup.mark(docs.limit(0)).count() == 0


def test_only_rows_of_repeated_prefixes_are_hashed_whole(spark, monkeypatch):
    """The last step sees lengths and prefixes that occur again, nothing else."""
    stored = {}
    keep = exact_dup.store
    monkeypatch.setattr(exact_dup, "store", lambda df, name: stored.setdefault(name, keep(df, name)))
    rows = [(i, chr(97 + i) * (i + 1)) for i in range(20)] + [(20, "pq"), (21, "rs"), (22, "PQ")]
    exact_dup.mark(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["_row"]["doc_id"] for r in stored["hashed"].where("_full IS NOT NULL").orderBy("_row.doc_id").collect()] == [20, 22]
    assert stored["prefixes"].selectExpr("sum(bit_count(0)) + count(*) AS n").first()[0] == 1


def test_marks_do_not_shuffle_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = exact_dup.mark(docs, keep={"n": F.length("text")})._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


# hard negatives


def brute_negatives(rows, every=5, k=5, n=3, scale=256):
    usable = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        best = sorted((-score(a, b), b[0]) for b in usable if b[2] == a[2] and b[0] != a[0])[:k]
        for s, p in best:
            fit = sorted((-score(a, b), b[0]) for b in usable if b[2] != a[2] and 50 * -s <= 100 * score(a, b) <= 95 * -s)[:n]
            out += [(a[0], p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(512, 4096), (4, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hard_negatives, "TILE", sizes[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[1])
    random.seed(11)
    vector = lambda d=3: [random.choice([-0.5, -0.1, 0.0, 0.2, 0.25, 0.7]) for _ in range(d)]
    rows = [(i, vector(), random.randrange(3)) for i in range(90)]
    rows += [(i, [0.7, 0.7, random.choice([0.2, 0.25])], i % 3) for i in range(90, 130)]  # near copies and ties
    rows += [(200, None, 1), (205, [0.1, None, 0.2], 1), (210, [float("nan"), 0.0, 1.0], 0), (215, [float("inf"), 0.0, 1.0], 0)]
    rows += [(220, vector(), None), (None, vector(), 1), (225, [], 1), (230, [0.5], 2), (235, [0.0, 0.0, 0.0], 0), (40, vector(), 1), (40, vector(), 2), (7, rows[7][1], rows[7][2]), (-10, vector(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).repartition(4)
    got = hard_negatives.mine(table, F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_no_anchors_and_empty_tables(spark):
    table = spark.createDataFrame([(1, [0.1], 0)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(table, F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    with pytest.raises(Exception, match="2\\^53"):
        hard_negatives.mine(spark.createDataFrame([(5, [1e30], 0)], "vec_id long, embedding array<double>, label int"), F.lit(True))


def test_bounds_hold_scores_and_skip_tiles():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 16)) * 100
    x = np.floor(np.repeat(centers, 50, 0) + rng.normal(size=(300, 16)) * 5)
    x[7] = 0
    directions = hard_negatives.references(x)
    a = x[::10]
    norms, turned = np.linalg.norm(a, axis=1), hard_negatives.angles(a, directions)
    skipped = 0
    for t in range(0, 300, 25):
        tile = x[t : t + 25]
        low, high = hard_negatives.score_bounds(norms, turned, np.linalg.norm(tile, axis=1), hard_negatives.angles(tile, directions))
        scores = a @ tile.T
        assert (scores.min(1) >= low).all() and (scores.max(1) <= high).all()
        skipped += (high < 0.8 * norms * norms).sum()
    assert skipped > 0.5 * 12 * len(a)


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top=10):
    counted = [(i, TERM.findall(lowered(t))) for i, t in docs]
    counted = [(i, w) for i, w in counted if w]
    n_docs, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, words in counted:
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        if item is None:
            continue
        asked, found = set(TERM.findall(lowered(text))), []
        for i, words in counted:
            m = 10 + 90 * len(words) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * words.count(t) // (1000 * words.count(t) + 8 * m)) for t in asked if t in df)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of items, groups of items, trees and leaves
        for name, value in (("ITEM_BYTES", 60), ("ITEMS", 2), ("TERMS", 6), ("BLOCK", 24), ("LEAF", 3), ("CELLS", 40), ("PILOT", 30)):
            monkeypatch.setattr(ball_tree, name, value)
    random.seed(8)
    words = [*"abcdefghij", "Zz9", "ß", "日本", "x1"]
    text = lambda n: " ".join(random.choices(words, [2 ** -i for i in range(len(words))], k=n))
    docs = [(i, text(random.randint(0, 12))) for i in range(120)] + [(200, None), (201, "!?"), (3, "j j zz9"), (3, "j j zz9"), (None, "j x1"), (202, "i " * 20_000), (203, "J. J, ZZ9")]
    items = [(f"i{k}", text(random.randint(1, 9))) for k in range(9)] + [("i3", "zz9 j"), ("none", None), ("empty", ""), ("unseen", "nowhere"), (None, "j"), ("long", text(2000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = ball_tree.search(d, spark.createDataFrame(items, "item_id string, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_search(docs, items)
    assert ball_tree.search(d.limit(0), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert ball_tree.search(d, spark.createDataFrame([], "item_id long, text string")).columns == got.columns


def test_bounds_hold_and_subtrees_are_skipped():
    rng = np.random.default_rng(4)
    topics, per = 8, 40
    docs, terms = [], []
    for d in range(640):  # documents of eight topics with terms of their own
        own = rng.choice(per, 12, replace=False) + per * (d % topics)
        docs += [d] * 12
        terms += own.tolist()
    impacts = rng.integers(1, 500_000, len(docs))
    weights = rng.integers(500, 9000, topics * per)
    block = ball_tree.Block(np.arange(640), np.array(docs), np.array(terms), impacts)
    asked = np.zeros((topics, topics * per), bool)
    for t in range(topics):
        asked[t, per * t : per * t + 15] = True
    tree = ball_tree.BallTree(block, weights, topics * per)
    upper = tree.bounds(asked)
    inner = (1 << (len(tree.levels) - 1)) - 1
    for leaf in range(len(tree.levels[-1]) - 1):
        ids, scores = tree.scores(leaf, asked)
        assert (scores.max(1) <= upper[:, inner + leaf]).all()
    search = ball_tree.Search(asked, weights, 10)
    search.add(block)
    dense = np.zeros((640, topics * per), np.int64)
    dense[docs, terms] = impacts
    assert (search.scores == -np.sort(-((dense * weights) @ asked.T.astype(np.int64)), axis=0)[:10].T).all()
    assert search.visited < 0.5 * search.leaves
