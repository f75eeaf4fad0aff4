"""Quality rules, classifiers, personal data, licenses, the pipeline."""

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querymill.llm import decontaminate, features, licenses, near_dup, pii, quality_classifier, quality_rules, toxicity
from querymill.llm.queries import QUERIES
from querymill.llm.words import NOT_ALNUM, Words


def auc(rows):
    """Chance that a row with label 1 scores higher than one with label 0."""
    ordered = sorted(rows)
    yes = sum(y for _, y in rows)
    ranks = sum(i + 1 for i, (_, y) in enumerate(ordered) if y)
    return (ranks - yes * (yes + 1) / 2) / (yes * (len(rows) - yes))


def labelled(spark, sf, name, column):
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    return QUERIES[name](spark, sf).join(labels.select("doc_id", F.col(column).alias("label")), "doc_id")


SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark):
    rows = labelled(spark, SF, "op3_quality_classifier", "quality").where(quality_classifier.held_out()).collect()
    assert auc([(r["quality_score"], r["label"]) for r in rows]) > 0.99
    clean = [r for r in rows if r["label"] == 1]
    assert sum(r["kept"] for r in clean) > 0.98 * len(clean)
    junk = [r for r in rows if r["label"] == 0]
    assert sum(not r["kept"] for r in junk) > 0.8 * len(junk)


def test_whole_names_tell_sources_apart():
    names = [f"source_{i:03}" for i in range(1000)] + [f"https://{c}.example" for c in "abc"] + [None, "", "source_", "\u00e9" * 9]
    numbers = quality_classifier._names(pa.array([*names, *names]).slice(3))
    assert len(set(numbers.tolist())) == len(names)
    assert quality_classifier._names(pa.array(names)).tolist()[3:] == numbers[: len(names) - 3].tolist()
    assert len(quality_classifier._names(pa.array([], pa.string()))) == 0
    assert len(set(quality_classifier._names(pa.array([None, None], pa.string())).tolist())) == 1


def test_metadata_view_learns_sources_with_one_beginning(spark):
    rows = [(i, "the same text", "en", f"source_{i % 2:03}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()
    assert all(r["quality_kept"] == (r["source"] == "source_001") for r in scored)


def test_toxicity_on_held_out_labels(spark):
    rows = labelled(spark, SF, "op8_toxicity", "toxic").where("held_out").collect()
    assert auc([(r["score"], r["label"]) for r in rows]) > 0.95
    found = [r for r in rows if r["predicted"]]
    assert sum(r["label"] for r in found) > 0.85 * len(found) > 0.7 * sum(r["label"] for r in rows)


def test_held_out_labels_change_nothing(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.intercept == b.intercept


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0)], [(1, "some text", "en", "s", 3)] * 2])
def test_classifiers_on_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality_score int")
    labels = spark.createDataFrame([(1, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        scored = toxicity.digest(toxicity.score(docs, toxicity.train(docs, given)))
        assert all(0 <= r["score"] <= 1 for r in scored.collect()) and scored.count() == len(rows)
        model = quality_classifier.train(docs, given)
        out = quality_classifier.score(docs.withColumn("Quality_Kept", F.lit("mine")), model)
        assert out.columns == ["doc_id", "text", "lang", "source", *quality_classifier.ADDED]
        assert out.count() == len(rows) and out.where("quality_score IS NULL").isEmpty()


def test_bounded_takes_the_smallest_hashes(spark, monkeypatch):
    hashed = lambda rows, seed: [r[0] for r in rows.distinct().orderBy(F.xxhash64(F.lit(seed), "k"), "k").collect()]
    many = spark.range(30_000).select(F.col("id").alias("k"))
    hot = many.unionByName(spark.range(20_000).select(F.lit(hashed(many, 3)[0]).alias("k"))).unionByName(spark.sql("SELECT CAST(NULL AS long) AS k"))
    for few in (features.FEW, 1):
        monkeypatch.setattr(features, "FEW", few)
        for rows, n in ((many, 10), (many, 5_000), (many, 40_000), (hot, 500), (many.limit(0), 5)):
            expected = hashed(rows.where("k is not null"), 3)[:n]
            assert sorted(r[0] for r in features.bounded(rows, n, "k", 3).collect()) == sorted(expected)


def test_repeated_ids_are_one_training_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    again = docs.unionByName(docs).unionByName(docs.where("doc_id % 9 = 0"))
    a, b = (toxicity.train(d, labels) for d in (docs, again))
    assert a.intercept == b.intercept and (a.weights == b.weights).all()
    a, b = (quality_classifier.train(d, labels) for d in (docs, again))
    assert all((x[0] == y[0]).all() and x[1] == y[1] for x, y in zip(a.views, b.views)) and (a.mix == b.mix).all()


def test_given_prior(spark):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none, prior=0.8).intercept == pytest.approx(1.386294, abs=1e-5)
    with pytest.raises(ValueError):
        toxicity.train(docs, none, prior=1.0)


def test_nn_fit_reaches_the_least_risk():
    import numpy as np

    rng = np.random.default_rng(1)
    positive = np.arange(600) < 200
    toxic = positive | (np.arange(600) > 520)
    held = np.where(toxic[:, None], rng.random((600, 3)) < [0.7, 0.5, 0.2], rng.random((600, 3)) < [0.2, 0.5, 0.6])
    prior, numbers = 0.2, np.array([11, 12, 13])
    sample = features.Sample([numbers[row] for row in held])

    def risk(z):
        loss = lambda x: np.logaddexp(0, -x)
        negative = loss(-z[~positive]).mean() - prior * loss(-z[positive]).mean()
        return prior * loss(z[positive]).mean() + max(0.0, negative)

    weights, intercept = sample.fit(np.arange(600), lambda z: toxicity.nnpu_slope(positive, prior, z), 1500, 0.02)
    best = risk(sample.apply(weights, intercept, np.arange(600)))
    grid = np.linspace(-4, 4, 17)
    dense = min(risk(held @ np.array([a, b, c]) + d) for a in grid for b in grid for c in grid for d in np.linspace(-5, 2, 15))
    assert best < dense + 0.01


def test_nn_slope_turns_when_the_negative_risk_does():
    import numpy as np

    positive = np.array([True, False, False])
    up = toxicity.nnpu_slope(positive, 0.3, np.array([0.0, 0.0, 0.0]))
    assert up[0] < 0 < up[1]
    back = toxicity.nnpu_slope(positive, 0.5, np.array([5.0, -5.0, -5.0]))
    assert back[0] > 0 > back[1]


def test_rules_on_odd_texts(spark):
    good = "A plain sentence of words stands here. " * 2 + " ".join(f"word{i}" for i in range(60)) + "."
    rows = [
        (1, good), (2, None), (3, ""), (4, " \n\t "), (5, "a b " * 40), (6, good + "\nHome | About | Contact | Login\nClick here"),
        (7, " | ".join(f"item{i}" for i in range(80))), (8, "word"), (9, "x y z"), (1, good),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    out = {r["doc_id"]: r for r in quality_rules.rate(docs).collect()}
    assert out[1]["kept"] and out[1]["clean_text"] == good
    assert out[6]["kept"] and out[6]["clean_text"] == good and out[6]["n_failed_lines"] == 2
    assert not any(out[i]["kept"] for i in (2, 3, 4, 5, 7, 8, 9)) and out[5]["n_repeat_words"] == 80
    assert not out[7]["base_failed"] and out[2]["n_words"] == 0 and out[9]["n_repeat_words"] == 0
    assert quality_rules.rate(docs.limit(0)).count() == 0


def test_rules_beside_clashing_columns_and_long_texts(spark):
    body = "\n".join([f"a{i} b{i} c{i} d{i} e{i} stands." for i in range(40_000)] + ["Click here"] * 9_000 + ["", "end of the text"])
    docs = spark.createDataFrame([(1, body)], "doc_id long, _lines string")
    for c in ("_words", "_AT", "kept", "Clean_Text"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = quality_rules.rate(docs, text_col="_lines")
    assert out.columns[:4] == ["doc_id", "_lines", "_words", "_AT"] and len({c.lower() for c in out.columns}) == len(out.columns)
    row = out.first()
    assert row["_words"] == row["_AT"] == "mine" and row["_lines"] == body and row["kept"] is True and row["n_failed_lines"] == 9_000
    assert row["clean_text" if "clean_text" in out.columns else "Clean_Text"] == body.replace("Click here\n", "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_equal_regex(spark, sf):
    import random

    random.seed(4)
    parts = ["a@b.c", "@", "x.y@z_w@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111-1111 1111", "4111111111111111",
             "+1 (569) 555-7279", "+", "+12", "007.0.0.255", "é😀", " ", "-", ".", "12345678901234567890", "a.b.c@d-e.f.g.", "\n", "token = \"f95017526fc608ad71587f8ea5418b66\""]
    rows = [(i, "".join(random.choices(parts, k=random.randint(0, 9)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "a" * 30000), (403, "1" * 30000), (404, "a." * 8000), (405, "a@" + "b." * 8000 + "c"), (0, "dup")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    found = pii.detect(docs)
    got = found.select("doc_id", pii.written(F.col("base")).alias("b"), pii.written(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(",".join(base_spans(t)))
    for r in got:
        assert r["b"] in want[r["doc_id"]], (r, want[r["doc_id"]])
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
    assert any("secret:" in r["s"] for r in got)
    assert pii.detect(docs.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_pii"](spark, sf).collect():
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len(base)


def test_many_matches_in_one_text(spark):
    """More matches than a stride has, with contexts that reach over several of them."""
    import random

    random.seed(9)
    parts = ["a@b.org ", "10.0.0.1 ", "é ", "+1 (569) 555-7279 ", "569-555-7279 ", "mail ", "\n", "x" * 50 + " "]
    texts = ["".join(random.choices(parts, k=n)) for n in (0, 1, 63, 64, 65, 128, 1000)] + ["a@b.cd " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(pii.detect(docs)).collect():
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["n_added"] == len(list(filter(None, r["spans"].split(",")))) - len(base)
    found = docs.limit(6).select(F.explode(pii.find_spans(F.col("text"), pii.EMAIL)).alias("x"), "text").select("x.*", "text")
    for r in found.collect():
        assert r["before"] == r["text"][max(0, r["start"] - 40) : r["start"]] and r["match"] == r["text"][r["start"] : r["end"]]


def test_spans_without_overlap_equal_pairwise_tests(spark):
    import random

    random.seed(6)
    span = lambda: (0, a := random.randint(0, 400), a + random.randint(1, 30))
    rows = [(i, [span() for _ in range(random.randint(0, 150))], [span() for _ in range(random.randint(0, 12))]) for i in range(40)]
    kind = "array<struct<kind:int,start:int,end:int>>"
    got = spark.createDataFrame(rows, f"i int, s {kind}, o {kind}").select("i", pii.without_overlap(F.col("s"), F.col("o")).alias("k")).collect()
    for r in got:
        _, spans, others = rows[r["i"]]
        assert sorted(map(tuple, r["k"])) == sorted(s for s in spans if not any(o[1] < s[2] and s[1] < o[2] for o in others))


def test_written_out_emails_are_found(spark):
    texts = ["write to jane [at] example.com now", "JANE [AT] EXAMPLE [DOT] COM", "contact bob at example dot org", "look at example.com", "we met at ten. dot"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in pii.detect(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert found[0] == "email:9:30" and found[2].startswith("email:8:") and not found[3] and not found[4]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com or 1.2.3.4!"), (2, "none")], "doc_id long, text string")
    out = docs.join(pii.detect(docs), "doc_id").select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t"))
    assert dict(map(tuple, out.collect())) == {1: "mail [email] or [ip]!", 2: "none"}


def test_reliabilities_of_known_labelers():
    import random

    random.seed(1)
    counts = {}
    for _ in range(4000):
        truth = random.random() < 0.3
        votes = tuple(int(random.random() < (p if truth else q)) for p, q in ((0.95, 0.05), (0.8, 0.2), (0.75, 0.25)))
        counts[votes] = counts.get(votes, 0) + 1
    truth, rates = pii.estimate(counts.items())
    assert rates[0][0] > 0.85 and rates[0][1] < 0.15 and truth[1, 1, 1] > 0.9 > 0.1 > truth[0, 0, 0]


def test_alignment_is_a_common_subsequence():
    import random

    random.seed(2)
    for _ in range(300):
        a, b = ([random.randint(0, 6) for _ in range(random.randint(0, 12))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    words = list(range(50))
    assert len(licenses.align([99, *words[:20], 98, *words[20:], 97], words)) == 50


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    broken = mit.replace("free of charge", "at no cost").replace("sublicense, ", "")
    rows = [
        (1, f"Intro text.\n{mit}\nMore."), (2, broken), (3, "Licensed under CC BY-NC 4.0. All rights reserved."), (4, None), (5, ""),
        (6, "the software is provided as is " * 50), (7, mit + "\n" + mit), (3, "nothing"),
        (8, "Released under the MIT License. " + "filler words " * 4000 + "Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(0))
    got = [(r["doc_id"], [x["license"] for x in r["found"]], [x["coverage"] for x in r["found"]]) for r in licenses.scan(docs).collect()]
    by = {i: (names, shares) for i, names, shares in got if names or i != 3}
    assert by[1][0] == ["MIT"] and by[1][1] == [1.0]
    assert by[2][0] == ["MIT"] and 0.9 < by[2][1][0] < 1
    assert by[3][0] == ["CC-BY-NC-4.0-line", "All-rights-reserved"]
    assert by[4][0] == by[5][0] == by[6][0] == [] and by[7][0] == ["MIT", "MIT"]
    assert by[8][0] == ["MIT-line", "CC-BY-4.0-line"] and len(got) == len(rows)
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, {"none": "!!"}).where("size(found) > 0").isEmpty()


def found_names(spark, texts, templates=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(docs, templates).collect()
    return [[x["license"] for x in r["found"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_neighbouring_licenses_keep_their_names(spark):
    gpl = "This work is licensed under the GNU General Public License, version "
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"]
    numbered = bsd3.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    expected = {
        gpl + "2.": ["GPL-2.0-line"],
        gpl + "3.0 or later": ["GPL-3.0-or-later-line"],
        gpl + "4.": [],
        gpl.replace("GNU", "GNU Lesser") + "2.1.": ["LGPL-2.1-line"],
        gpl.replace("GNU", "GNU Affero") + "3": ["AGPL-3.0-line"],
        licenses.TEMPLATES["GPL-2.0-or-later-header"]: ["GPL-2.0-or-later-header"],
        licenses.TEMPLATES["LGPL-3.0-or-later-header"]: ["LGPL-3.0-or-later-header"],
        "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0-line"],
        "Licensed under CC BY 3.0": ["CC-BY-3.0-line"],
        "Licensed under CC BY-NC-ND 4.0": ["CC-BY-NC-ND-4.0-line"],
        "Licensed under CC BY 2.5, see below": ["CC-BY-2.5-line"],
        "Licensed under CC BY 7.0": [],
        "Creative Commons Attribution-NonCommercial 4.0 International License": ["CC-BY-NC-4.0-name"],
        "Creative Commons Attribution 4.0 International License": ["CC-BY-4.0-name"],
        "Licensed under CC BY 4.0 or CC BY-NC 3.0": ["CC-BY-4.0-line"],
        "Licensed under the Apache License, Version 1.1.": [],
        numbered: ["BSD-3-Clause"],
        licenses.TEMPLATES["BSD-2-Clause"]: ["BSD-2-Clause"],
        "Released under the License.": [],
    }
    assert dict(zip(expected, found_names(spark, list(expected)))) == expected


def brute_find(words, gaps, template, template_gaps, need):
    """Occurrences of one template by trying every start, on strings, without any filter."""

    def marks(ws, gs):
        digit = [w in licenses.DIGITS for w in ws]
        first = [i > 0 and digit[i] and ws[i - 1] in licenses.VERSION_LEADS for i in range(len(ws))]
        second = [i > 0 and digit[i] and first[i - 1] and gs[i] == 1 for i in range(len(ws))]
        return [ws[i] in licenses.MARKS or ((first[i] or second[i]) and ws[i] != "0") for i in range(len(ws))]

    own = {w for w, m in zip(template, marks(template, template_gaps)) if m}
    foreign = {i for i, (w, m) in enumerate(zip(words, marks(words, gaps))) if m and w not in own}
    out, at = [], 0
    while at < len(words):
        stop, pairs = at + 2 * len(template), []
        while words[at] in template:
            part = [i for i in range(at, min(stop, len(words))) if words[i] in template]
            pairs = [(part[i], j) for i, j in licenses.align([words[i] for i in part], template)]
            between = [i for i in foreign if len(pairs) >= need and pairs[0][0] < i < pairs[-1][0]]
            if not between:
                break
            stop = max(between)
        if len(pairs) >= need and own <= {template[j] for _, j in pairs}:
            last, end = pairs[-1]
            if not (last + 1 in foreign and template[end] in licenses.DIGITS):
                out.append((len(pairs), pairs[0][0], last + 1))
                at = last + 1
                continue
        at += 1
    return out


def cut(text):
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    gaps = [99] + [b.start() - a.end() for a, b in zip(found, found[1:])]
    return [x.group().lower() for x in found], gaps


def test_license_finds_equal_brute_force():
    import random

    random.seed(9)
    names = ["CC-BY-4.0-line", "CC-BY-SA-4.0-line", "CC-BY-2.5-line", "CC-BY-NC-4.0-name", "GPL-2.0-line", "GPL-3.0-or-later-line",
             "LGPL-2.1-line", "MIT-line", "ISC", "BSD-2-Clause", "BSD-3-Clause", "All-rights-reserved"]
    templates = {n: licenses.TEMPLATES[n] for n in names}
    scanner = licenses.Scanner(templates, 0.8)
    texts = []
    for _ in range(500):
        parts = []
        for _ in range(random.randint(1, 4)):
            words = re.split(r"(?<= )", random.choice(list(licenses.TEMPLATES.values())))
            for _ in range(random.randint(0, 3)):
                words[random.randrange(len(words))] = random.choice(["", "x ", "the ", "3. ", "version 2 ", "nc ", "under the "])
            parts.append("".join(words))
        texts.append(random.choice([" ", "\n", ". "]).join(parts))
    got = set(scanner.find(Words(pa.array(texts), NOT_ALNUM)))
    expected = set()
    for i, text in enumerate(texts):
        for t, template in enumerate(templates.values()):
            need = int(scanner.need[t])
            expected |= {(i, t, *x) for x in brute_find(*cut(text), *cut(template), need)}
    assert got == expected and len(got) > 50


def test_equal_templates_and_whole_license_files(spark, tmp_path):
    text = "Do with it what you like, version 1.0, and tell nobody."
    (tmp_path / "Own-1.0.txt").write_text(text)
    (tmp_path / "Copy-1.0.txt").write_text(text)
    given = licenses.read_templates(str(tmp_path))
    assert list(given) == ["Copy-1.0", "Own-1.0"]
    assert found_names(spark, [text, text.replace("1.0", "2.0")], given) == [["Copy-1.0"], []]


def test_license_lines_of_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op9_licenses"](spark, sf).collect():
        for name, line in licenses.TEMPLATES.items():
            if name.endswith("-line") and line.rstrip(".") in texts[r["doc_id"]]:
                assert name in r["licenses"].split(",")


def test_pipeline_stages(spark, sf):
    """Each stage against what its operator's rule says about its own input."""
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        before, kept[name] = docs, rows
        if name != "packing":
            assert list(rows[0].asDict()) == corpus_pipeline.COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            docs = spark.createDataFrame(rows, before.schema)
        if name == "near duplicates":
            whole = near_dup.components(before)
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in whole.where("kept").collect()}
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            assert decontaminate.scan(docs, items).where("n_hit > 0").isEmpty()
            clean = {r["doc_id"] for r in decontaminate.scan(before, items).where("n_hit = 0").collect()}
            assert clean <= {r["doc_id"] for r in rows}
    assert {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["decontamination"]}
    ran = corpus_pipeline.run(spark, sf)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in ran.collect()) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["packing"]
    )
