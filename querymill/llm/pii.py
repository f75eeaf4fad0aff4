"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Three labelers vote on each: the strict pattern of its kind, a
gazetteer (domain endings, issuer prefixes, country codes, names of secrets) and the words around
it. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
for each kind, and its posteriors train the span classifier. Spans that pass the base rules always
stay; the classifier decides on the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.storage import store

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "gazetteer", "context")

#: The base patterns. Possessive forms and the look-behinds match the same spans as the
#: plain forms and keep the search linear: a match can only begin where its run begins or where the
#: match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Looser patterns of candidates beside the base.
_DOT = r"(?: ?(?:\[dot\]|\(dot\)| dot ) ?|\.)"
LOOSE_EMAIL = (
    r"(?i)[A-Z0-9._%+-]{1,64}+(?: ?(?:\[at\]|\(at\)) ?[A-Z0-9-]{1,63}+(?:" + _DOT + r"[A-Z0-9-]{2,63}+)++"
    r"| at [A-Z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Z0-9-]{2,63}+)++)"
)
LOOSE_PHONE = r"(?<![0-9+.-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"""(?<=(?i:token|secret|password|passwd|key)["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9/+_.-]{16,}+"""
_SECRET_SIGN = r"""[=:]\s{0,3}["']?[A-Za-z0-9/+_.-]{16}"""

#: Gazetteers and context words by kind, as patterns.
GAZETTEER = {
    "email": r"(?i)(\.|dot\W{0,2})(com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|pt|br|mx|ca|au)$",
    "ip": r"^(?!0+\.)(?!127\.)(?!255\.)",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|35)",
    "phone": r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]|^\(?[2-9][0-9]{2}",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])",
}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|adresse|correo|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|client|login|from)\b",
    "card": r"(?i)\b(card|visa|master|credit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|contact|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "secret": r"(?i)\b(token|secret|password|passwd|api|key|access)\b",
}
CONTEXT_CHARS = 40
THRESHOLD = 0.5

SPAN = "struct<kind:int,start:int,end:int,base:boolean,pattern:int,gazetteer:int,context:int>"


#: Elements that one inner fold of ``scanned`` appends to an array: appending copies what is there.
_STRIDE = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(
    items: Column, zero: Column, fold: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column], kind: str,
) -> Column:
    """``emit(state, x)`` for every element, where the state is the fold of the elements before it.

    Strides are folded on their own, their states merged from left to right, and each stride is then
    gone through from its own state, so that the time is in proportion to the elements.
    """

    def whole(p: Column) -> Column:
        count = F.size(p)
        strides = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / _STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
        places = lambda b: F.sequence(b * _STRIDE, F.least((b + 1) * _STRIDE, count) - 1)
        totals = F.transform(strides, lambda b: F.aggregate(places(b), zero, lambda a, j: fold(a, F.get(p, j))))
        before = F.aggregate(totals, F.array(zero), lambda a, t: F.concat(a, F.array(merge(F.element_at(a, -1), t))))

        def one(states: Column, b: Column) -> Column:
            start = F.struct(F.get(states, b).alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
            step = lambda a, j: F.struct(
                fold(a["state"], F.get(p, j)).alias("state"), F.concat(a["out"], F.array(emit(a["state"], F.get(p, j)))).alias("out")
            )
            return F.aggregate(places(b), start, step, lambda a: a["out"])

        return _bound(before, lambda states: F.flatten(F.transform(strides, lambda b: one(states, b))))

    return _bound(items, whole)


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (match, start, end, before), in code points.

    ``before`` has the last characters in front of the match.
    """
    parts = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("match"), F.split(text, pattern, -1).alias("gap")
    )
    tail = lambda x: F.right(x, F.lit(CONTEXT_CHARS))

    def state(at: Column, before: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), before.alias("before"))

    def fold(a: Column, x: Column) -> Column:
        return state(a["at"] + F.length(x["gap"]) + F.length(x["match"]), tail(F.concat(a["before"], tail(x["gap"]), tail(x["match"]))))

    def emit(a: Column, x: Column) -> Column:
        start = (a["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.length(x["match"])).cast("int")
        return F.struct(x["match"].alias("match"), start.alias("start"), end.alias("end"), tail(F.concat(a["before"], tail(x["gap"]))).alias("before"))

    merge = lambda a, t: state(a["at"] + t["at"], tail(F.concat(a["before"], t["before"])))
    matches = F.filter(parts, lambda x: x["match"].isNotNull())
    return scanned(matches, state(F.lit(0), F.lit("")), fold, merge, emit, "struct<match:string,start:int,end:int,before:string>")


def without_overlap(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others; arrays of structs (kind, start, end)."""
    mark = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(own).alias("own"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: mark(s, True)), F.transform(others, lambda s: mark(s, False))))
    kind = "struct<start:int,end:int,kind:int,own:boolean,{}:int>"
    keep = lambda x, name, value: F.struct(*[x[c].alias(c) for c in ("start", "end", "kind", "own")], value.alias(name))
    last, first = F.lit(-1), F.lit(2**31 - 1)
    # the furthest end of others that begin before, then the nearest begin of others that come after
    reach = lambda a, x: F.greatest(a, F.when(x["own"], last).otherwise(x["end"]))
    ahead = scanned(events, last, reach, F.greatest, lambda a, x: keep(x, "reach", a), kind.format("reach"))
    free = F.filter(ahead, lambda x: ~x["own"] | (x["reach"] <= x["start"]))
    near = lambda a, x: F.least(a, F.when(x["own"], first).otherwise(x["start"]))
    back = scanned(F.reverse(free), first, near, F.least, lambda a, x: keep(x, "next", a), kind.format("next"))
    kept = F.filter(back, lambda x: x["own"] & (x["next"] >= x["end"]))
    return F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return match.startswith("+") & F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str, pattern: str, sign: Column, base: bool) -> Column:
    """Spans of a pattern with the votes of the labelers; ``sign`` is a cheap test for any."""
    number = KINDS.index(kind)

    def vote(x: Column) -> Column:
        strict = _passes(kind, x["match"]) if base else F.lit(kind == "secret")
        return F.struct(
            F.lit(number).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            (strict & F.lit(base)).alias("base"),
            strict.cast("int").alias("pattern"),
            x["match"].rlike(GAZETTEER[kind]).cast("int").alias("gazetteer"),
            x["before"].rlike(CONTEXT[kind]).cast("int").alias("context"),
        )

    return F.when(sign, F.transform(find_spans(text, pattern), vote)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and all candidate spans of each document, with votes; stored."""
    text = F.coalesce(text_col, F.lit(""))
    own = docs.select(F.col(id_col), text.alias("_text"))
    text = F.col("_text")
    has_at = text.contains("@")
    groups = [
        _candidates(text, "email", EMAIL, has_at, True),
        _candidates(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), True),
        _candidates(text, "card", CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){12}"), True),
        _candidates(text, "phone", PHONE, text.contains("+"), True),
        _candidates(text, "email", LOOSE_EMAIL, text.rlike(r"(?i)[\[(]at[\])]| at [^\n]*[\[( ]dot[\]) ]"), False),
        _candidates(text, "phone", LOOSE_PHONE, text.rlike(r"[0-9]{3}[ .-][0-9]{4}"), False),
        _candidates(text, "secret", SECRET, text.rlike(_SECRET_SIGN), False),
    ]
    found = own.select(id_col, F.concat(*groups).alias("spans"))
    return store(found, "candidates")


def estimate(counts: Iterable[tuple[tuple[int, ...], float]], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], list[tuple[float, float]]]:
    """Expectation-maximisation for one kind: posterior of each vote pattern, and for each labeler
    the chances of a vote on true and on false spans. Starts from the share of votes; every rate has
    a pseudo-count of one, so that no labeler becomes certain."""
    counts = list(counts)
    truth = {votes: (0.5 + sum(votes)) / (1 + len(votes)) for votes, _ in counts}
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        yes = sum(n * truth[v] for v, n in counts)
        no = sum(n * (1 - truth[v]) for v, n in counts)
        prior = (yes + 1) / (yes + no + 2)
        rates = []
        for i in range(len(counts[0][0]) if counts else 0):
            on_true = sum(n * truth[v] for v, n in counts if v[i])
            on_false = sum(n * (1 - truth[v]) for v, n in counts if v[i])
            # A labeler is held to be better than chance.
            rates.append((max(0.5, (on_true + 1) / (yes + 2)), min(0.5, (on_false + 1) / (no + 2))))
        for v, _ in counts:
            a, b = prior, 1 - prior
            for hit, (p, q) in zip(v, rates):
                a, b = (a * p, b * q) if hit else (a * (1 - p), b * (1 - q))
            truth[v] = a / (a + b)
    return truth, rates


def train(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 500) -> dict[int, list[float]]:
    """Weights (intercept, then one per labeler) of a logistic span classifier for each kind."""
    weights = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        truth, _ = estimate(own)
        total, w = sum(n for _, n in own), [0.0] * (len(LABELERS) + 1)
        for _ in range(rounds):
            slope = [1e-3 * x for x in w]
            for v, n in own:
                p = 1 / (1 + math.exp(-w[0] - sum(a * b for a, b in zip(w[1:], v))))
                for i, x in enumerate((1, *v)):
                    slope[i] += n / total * (p - truth[v]) * x
            w = [a - 2.0 * b for a, b in zip(w, slope)]
        weights[kind] = w
    return weights


def probability(span: Column, weights: dict[int, list[float]]) -> Column:
    """Score of the span classifier as a column."""
    score = F.lit(-10.0)
    for kind, w in weights.items():
        own = F.lit(w[0])
        for name, a in zip(LABELERS, w[1:]):
            own = own + F.lit(a) * span[name]
        score = F.when(span["kind"] == kind, own).otherwise(score)
    return 1 / (1 + F.exp(-score))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, and arrays ``base`` and ``spans`` (kind, start, end) of every document, ordered.

    A null text counts as empty. Positions are code points, ends are exclusive. Equal rows give
    equal rows; other columns are ignored; without candidates nothing is learned or found.
    """
    found = candidates(docs, id_col, text_col)
    # At most kinds x 2^labelers rows come to the driver.
    votes = found.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{x}" for x in LABELERS]).count().collect()
    weights = train([(r["kind"], tuple(r[x] for x in LABELERS), float(r["count"])) for r in votes])
    narrow = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.filter("spans", lambda s: s["base"])
    sure = F.filter("spans", lambda s: ~s["base"] & (probability(s, weights) >= THRESHOLD))
    out = found.select(id_col, F.transform(base, narrow).alias("b"), F.transform(sure, narrow).alias("s"))
    added = F.when(F.size("s") > 0, without_overlap(F.col("s"), F.col("b"))).otherwise(F.col("s"))
    # spans of a kind do not overlap, and added ones no base span: none is there twice
    return out.select(id_col, F.sort_array("b").alias("base"), F.sort_array(F.concat("b", added)).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans as the first of them."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"]))
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), kept.alias("out"))).otherwise(a)

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))


def _same(kind: int):
    return lambda k: F.when(k == kind, k)


def digest(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their checksum, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _same(k)))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    secrets = F.size(F.array_compact(F.transform(F.transform("spans", lambda s: s["kind"]), _same(KINDS.index("secret"))))).cast("long")
    added = (F.size("spans") - F.size("base")).cast("long")
    return detected.select(
        id_col, *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        secrets.alias("n_secret"), added.alias("n_added"),
    )
