"""Token encoder, directly addressable codes, packing."""

import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querymill.llm import dac, ids, packing
from querymill.llm.queries import QUERIES

ODD = [
    "a  b", " a", "a ", "", "  ", "a \n b", "x\n y", None, "it's 's  ok", "a 　 b", "<|endoftext|> x", "\x1c a", "a\tb",
    "a b\n\n c d", "é 😀 ñ", "a\x85 b", "12 34 '' ! ?? 's", "\n", "\n\n", "a\n", "\na", ".a", "a.\nB", "don't I'll", "é́. x", "b \n",
]


@pytest.fixture(scope="module")
def encoder():
    return ids.Encoder(ids.vocabulary(), kept=200)


def test_pieces_equal_whole_texts(encoder):
    random.seed(3)
    letters = [*"ab '.\n\té1,", "　", " ", "́"]
    texts = ODD + ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(3000)]
    for start in range(0, len(texts), 500):  # the cache is small: it is emptied on the way
        part = texts[start : start + 500]
        flat, at = encoder.encode(pa.array(part, pa.string()))
        for i, whole in enumerate(encoder.direct([t or "" for t in part])):
            assert flat[at[i] : at[i + 1]].tolist() == whole, part[i]


def test_added_tokens_as_the_plain_tokenizer(encoder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(ids.vocabulary())
    end = "<|endoftext|>"
    random.seed(4)
    parts = [end, "<|endof", "text|>", " ", "  ", "\n", "ab", ".", "|", "é", "\u3000", "<"]
    texts = [f"abc {end} def", end, end * 2, f"{end}\n", f"\n{end}", f"a\n{end} \n b", None, "<|endof", "text|> x", f"'s{end}'s"]
    texts += ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(2000)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0][1:3] == [220, 50256]
    whole = ids.Encoder(ids.vocabulary(), kept=200)
    whole._plain = False  # as with tokens that strip white space
    for each in (encoder, whole):
        flat, at = each.encode(pa.array(texts, pa.string()))
        for i, x in enumerate(want):
            assert flat[at[i] : at[i + 1]].tolist() == x, texts[i]


def test_added_tokens_in_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(ids.vocabulary())
    rows = [(1, "abc <|endoftext|> def"), (2, "after it")]
    want = {d: plain.encode(t, add_special_tokens=False).ids for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = dac.write(docs, str(tmp_path / "files"))
    back = dac.read(spark, manifest).orderBy("start").collect()
    assert [np.frombuffer(r["ids"], "<u4").tolist()[:-1] for r in back] == [want[1], want[2]]
    assert back[1]["start"] == len(want[1]) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_give_random_access(values):
    codes = dac.Codes.encode(np.array(values, np.uint32))
    assert codes.all().tolist() == values
    at = np.random.default_rng(1).permutation(len(values))
    assert codes.get(at).tolist() == [values[i] for i in at]


def brute_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    encoded = ids.Encoder(ids.vocabulary()).direct([r["text"] or "" for r in docs])
    return [(r["doc_id"], x) for r, x in zip(docs, encoded)]


def checksum(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_token_files_against_brute_force(spark, sf):
    want, start = [], 0
    for doc, x in brute_ids(spark, sf):
        want.append((doc, start, len(x) + 1, checksum([*x, 2])))
        start += len(x) + 1
    assert sorted(map(tuple, QUERIES["op10_token_codes"](spark, sf).collect())) == want


def test_token_files_nulls_repeats_and_positions(spark, tmp_path):
    rows = [(5, "b c", "x"), (1, None, "x"), (1, "z", "x"), (None, "a", "x"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = dac.write(docs, str(tmp_path / "files"), file_ids=3)
    back = dac.read(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, 1, 1, 5, 9]
    everything = [x for r in back for x in np.frombuffer(r["ids"], "<u4").tolist()]
    assert [r["start"] for r in back] == np.cumsum([0, *[r["n_tokens"] for r in back]])[:-1].tolist()
    assert everything.count(2) == 5
    asked = dac.tokens_at(spark, manifest, spark.range(len(everything)).withColumnRenamed("id", "position"))
    assert [r["id"] for r in asked.orderBy("position").collect()] == everything
    empty = dac.write(docs.limit(0), str(tmp_path / "none"))
    assert dac.read(spark, empty).count() == 0


def expand(plan, histogram):
    """Sequences of a plan as lists of (offset, length)."""
    out = {}
    segments = sorted(plan.segments)
    for length, n in histogram.items():
        own = [s for s in segments if s[0] == length]
        for rank in range(n):
            _, first, sequence, each, offset = [s for s in own if s[1] <= rank][-1]
            number = rank - first
            out.setdefault(sequence + number // each, []).append((offset + number % each * length, length))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_plan_places_everything_without_gaps(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.make_plan(histogram, 20)
    sequences = expand(plan, histogram)
    assert len(sequences) == plan.sequences
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 20
    plain = packing.Plan(20)
    counts = [histogram.get(i, 0) for i in range(21)]
    packing.best_fit(counts, plain)
    assert -(-sum(lengths) // 20) <= plan.sequences <= max(plain.sequences, plan.sequences)


def fewest(items, capacity):
    """Optimal number of sequences by trying, for the longest item, all sets it can stand in."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for k in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), k):
            if first + sum(rest[i] for i in chosen) <= capacity:
                left = tuple(x for i, x in enumerate(rest) if i not in chosen)
                best = min(best, 1 + fewest(left, capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_fixed_sets_leave_the_optimum_reachable(lengths):
    items = tuple(sorted(lengths, reverse=True))
    plan, counts = packing.Plan(12), [0] * 13
    for x in items:
        counts[x] += 1
    packing.reduce(counts, plan)
    rest = tuple(x for x in range(12, 0, -1) for _ in range(counts[x]))
    assert plan.fixed + fewest(rest, 12) == fewest(items, 12)


def test_packing_against_brute_force(spark, sf):
    got = QUERIES["op4_best_fit_packing"](spark, sf).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc, x in brute_ids(spark, sf):
        x, at = [*x, 0], 0
        for n, r in enumerate(sorted(pieces.pop(doc), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == checksum(x[at : at + r["length"]])
            at += r["length"]
        assert at == len(x)
    assert not pieces
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        assert [o for o, _ in sorted(placed)] == np.cumsum([0, *[n for _, n in sorted(placed)]])[:-1].tolist()
        assert sum(n for _, n in placed) <= 2048
    assert len(sequences) <= 1.01 * sum(r["length"] for r in got) / 2048 + 1


def test_packing_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, 1), (1, None, 2), (2, "", 3), (3, "word " * 40, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    out = packing.pack(docs, capacity=16, keep={"ids": F.col("ids")}).collect()
    assert sum(r["length"] == 1 for r in out if r["doc_id"] in (1, 2)) == 3
    long = sorted((r["piece"], r["length"]) for r in out if r["doc_id"] == 3)
    assert [n for _, n in long][1:] == [16] * (len(long) - 1)
    assert all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack(docs.limit(0), capacity=16).count() == 0
