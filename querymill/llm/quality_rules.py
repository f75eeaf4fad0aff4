"""Line-first quality rules, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules, failing lines go, and a
document that loses too much of its words, or fails the rules for whole texts, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.names import put_back, set_aside

#: White space between words, and symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Phrases of navigation and boilerplate lines, matched in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "subscribe to our", "sign up for", "click here", "read more", "share this", "follow us on",
    "powered by", "enable javascript", "skip to content", "back to top", "lorem ipsum",
)
NAVIGATION = r"^(home|menu|about( us)?|contact( us)?|login|log in|sign in|search|next|previous|sitemap|share|print|faq)$"

WORKING = ("_words", "_lines", "_hashes", "_judged", "_found", "_failed", "_at")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols, exclamation runs and separators per 100 words of a line beyond which it fails.
MAX_SYMBOLS_PERCENT = 30
MAX_SHOUTS_PERCENT = 20
MAX_SEPARATORS_PERCENT = 20
#: A boilerplate phrase fails a line of at most so many words.
BOILERPLATE_WORDS = 25
MAX_LOST_PERCENT = 30


def split_words(text: Column) -> Column:
    """Words of a text, empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line with words fails one of the rules."""
    low = F.lower(line)
    punctuation = (
        (F.regexp_count(line, F.lit(SYMBOLS)) * 100 > n_words * MAX_SYMBOLS_PERCENT)
        | (F.regexp_count(line, F.lit("[!?]{2,}")) * 100 > n_words * MAX_SHOUTS_PERCENT)
        | ~line.rlike(r"[\p{L}\p{N}]")
    )
    navigation = (F.regexp_count(line, F.lit(r" [|»›·•] | > ")) * 100 > n_words * MAX_SEPARATORS_PERCENT) | F.btrim(low, F.lit(SPACES)).rlike(NAVIGATION)
    boilerplate = (n_words <= BOILERPLATE_WORDS) & low.rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def rate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with all columns, counts of their texts, the verdict, and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, n_lost_words,
    base_failed, kept and clean_text (null where not kept). A null or empty text has no words and
    is rejected. Input columns named like an added one are replaced. All work is within the row;
    nothing is shuffled.
    """
    docs, moved = set_aside(docs, WORKING)
    text_col = moved.get(text_col, text_col)
    text = F.coalesce(text_col, F.lit(""))
    out = docs.withColumns({"_words": split_words(F.col(text_col)), "_lines": F.split(text, "\n", -1)})
    starts = F.sequence(F.lit(0), F.size("_words") - 3)
    enough = F.size("_words") >= 3
    word = lambda i: F.get("_words", i)
    out = out.withColumns(
        {
            "_hashes": F.when(enough, F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))),
            "_judged": F.transform(
                F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACES)) != ""),
                lambda x: F.struct(x.alias("line"), F.size(split_words(x)).alias("n")),
            ),
        }
    )
    # Equal windows have equal hashes, so distinct hashes rule out a repeated window.
    repeated = enough & (F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    window = lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2))
    found = F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("k"), i.alias("p"))))
    out = out.withColumns(
        {
            "_found": F.when(repeated, found),
            "_failed": F.filter("_judged", lambda x: line_fails(x["line"], x["n"])),
        }
    )
    near = lambda x, j: F.coalesce(F.get("_found", j)["k"] == x["k"], F.lit(False))
    twice = F.filter("_found", lambda x, j: near(x, j - 1) | near(x, j + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["p"])))
    steps = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    lines = F.size("_judged")
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (lines - F.size(F.array_distinct(F.transform("_judged", lambda x: x["line"])))).cast("long"),
            "n_repeat_words": F.coalesce(total(steps), F.lit(0)).cast("long"),
            "n_failed_lines": F.size("_failed").cast("long"),
            "n_lost_words": total(F.transform("_failed", lambda x: x["n"])).cast("long"),
        }
    )
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    kept = ~base & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT)
    stays = lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~line_fails(x, F.size(split_words(x)))
    clean = F.when(F.col("n_failed_lines") == 0, F.col(text_col)).otherwise(
        F.array_join(F.filter("_lines", stays), "\n")
    )
    out = out.withColumns({"base_failed": base, "kept": kept}).withColumn("clean_text", F.when(F.col("kept"), clean))
    return put_back(out.drop(*WORKING), moved)


VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "n_lost_words", "base_failed", "kept"]
