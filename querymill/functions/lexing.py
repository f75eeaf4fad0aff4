"""A SQL token stream from one regular expression.

SQL texts are data here. ``regexp_extract_all`` with the patterns below yields the tokens inside
the JVM; no grammar is involved. Join phrases, GROUP BY, ORDER BY, UNION ALL and NOT NULL are
single tokens. Quoted alternatives are written without nested choices, so a long literal cannot
exhaust the regex engine's stack.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import NON_WS, WS, WS_CHARS, collapse, or_empty, strip

_S = WS
_W = r"[A-Za-z0-9_\p{L}\p{N}]"
_COMMENT = r"--[^\n]*+|/\*.*?\*/"
_QUOTED = r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+`"""
_JOIN = (
    rf"(?:(?:LEFT|RIGHT|FULL){_S}++)?(?:(?:INNER|OUTER|CROSS|NATURAL){_S}++)?JOIN(?!{_W})"
)
_PHRASE = rf"{_JOIN}|(?:(?:GROUP|ORDER){_S}++BY|UNION{_S}++ALL|NOT{_S}++NULL)(?!{_W})"
# ASCII runs go by one table look-up a character (\w); other letters go on from where they end.
_REST_OF_WORD = rf"\w*+(?:[\x{{80}}-\x{{10ffff}}&&[\p{{L}}\p{{N}}]]{_W}*+)?+"
# Behind the digits \w can only be a letter or "_".
_WORD = rf"[0-9]*+[\w\p{{L}}]{_REST_OF_WORD}"
_NUMBER = r"-?[0-9]++(?:\.[0-9]++)?"
_OPERATOR = r"[<>=!~]++|[+/@#%&|^-]++"

# For upper-cased text, in group 1; a space behind a token is passed over with it. The first letters
# in front of the phrases keep other words off them.
TOKEN = (
    rf"(?s)(?! )((?=[CFGIJLNORU])(?:{_PHRASE})|{_WORD}|{_COMMENT}|{_QUOTED}|{_NUMBER}|{_OPERATOR}"
    rf"|[!-~]|{NON_WS}) ?+"
)

# A word glued to "(" or to dots is a name, unless it is one of the first five. The last
# alternative takes any character, so the pieces always add up to the text.
_NEVER_NAME = rf"(?=[AFIUVafiuv])(?i:IN|VALUES|USING|FROM|AS)(?!{_W})"
_NAME = rf"{_WORD}(?:\(|(?={_S}*+\.)(?:(?:{_S}*+\.{_S}*+{_WORD})++|{_S}*+\.))?+"
_REST = rf"{_COMMENT}|{_QUOTED}|{_NUMBER}|{_OPERATOR}|."
_PIECE = rf"(?![!-~]){_S}++|{_NEVER_NAME}|{_NAME}|{_REST}"
# A space behind a piece stays with it, which halves the pieces. For tidying, only a space that is
# kept; whitespace behind "(" or in front of ")" and "," is outside the group and extracted as "".
SPACED_TOKEN = rf"(?s)(?:{_PIECE}) ?+"
_KEPT_SPACE = rf"(?:(?<!\() (?![),])(?!(?![!-~]){_S}))?+"
TIDY_TOKEN = rf"(?s)(?![!-~])(?:(?<=\(){_S}++|{_S}++(?=[),]))|((?:{_PIECE}){_KEPT_SPACE})"

# Words written in upper case by normalisation.
KEYWORDS = (
    "ADD", "ALL", "ALTER", "AND", "ANY", "AS", "ASC", "AVG", "BEGIN", "BETWEEN", "BY", "CASCADE",
    "CASE", "CAST", "CHECK", "COALESCE", "COLUMN", "COMMIT", "CONSTRAINT", "COUNT", "CREATE",
    "CROSS", "CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "DATABASE", "DEFAULT", "DELETE",
    "DESC", "DESCRIBE", "DISTINCT", "DROP", "ELSE", "END", "ESCAPE", "EXCEPT", "EXISTS", "EXPLAIN",
    "FALSE", "FETCH", "FIRST", "FOR", "FOREIGN", "FROM", "FULL", "FUNCTION", "GRANT", "GROUP",
    "HAVING", "IF", "ILIKE", "IN", "INDEX", "INNER", "INSERT", "INTERSECT", "INTERVAL", "INTO",
    "IS", "JOIN", "KEY", "LAST", "LATERAL", "LEFT", "LIKE", "LIMIT", "MAX", "MIN", "NATURAL",
    "NOT", "NULL", "NULLIF", "NULLS", "OFFSET", "ON", "OR", "ORDER", "OUTER", "OVER", "PARTITION",
    "PRIMARY", "PROCEDURE", "RECURSIVE", "REFERENCES", "RENAME", "REPLACE", "REVOKE", "RIGHT",
    "ROLLBACK", "ROW", "ROWS", "SELECT", "SET", "SHOW", "SOME", "SUM", "TABLE", "TEMPORARY",
    "THEN", "TO", "TOP", "TRIGGER", "TRUE", "TRUNCATE", "UNION", "UNIQUE", "UPDATE", "USING",
    "VALUES", "VIEW", "WHEN", "WHERE", "WINDOW", "WITH",
)
# Type names, whose case is left alone.
TYPE_NAMES = (
    "ARRAY", "BIGINT", "BINARY", "BIT", "BLOB", "BOOLEAN", "CHAR", "CHARACTER", "DATE", "DECIMAL",
    "DOUBLE", "FLOAT", "INT", "INTEGER", "LONG", "NUMBER", "NUMERIC", "REAL", "SERIAL", "SMALLINT",
    "TEXT", "TIMESTAMP", "TINYINT", "VARCHAR", "VARYING",
)


def tokens(sql: Column) -> Column:
    """Upper-cased tokens, whitespace dropped."""
    return F.regexp_extract_all(F.upper(or_empty(sql)), F.lit(TOKEN), F.lit(1))


_OPERATOR_CHARS = tuple("<>=!~+/@#%&|^-")
_AS_WRITTEN = tuple("'\"0123456789-/")


def _with_space(words: Sequence[str]) -> list[str]:
    """Words as they come out of the text, with and without the space behind them."""
    return [*words, *[w + " " for w in words]]


def _recased(token: Column, lower_names: bool) -> Column:
    """Keywords up, names down; literals, numbers, comments and type names as written."""
    up = F.upper(token)
    named = F.when(up.isin(_with_space(KEYWORDS)), up).otherwise(token)
    if not lower_names:
        return named
    kept = F.substring(token, 1, 1).isin(*_AS_WRITTEN)
    # one look-up sends most names on
    known = up.isin(_with_space((*KEYWORDS, *TYPE_NAMES)))
    return F.when(known, named).when(kept, token).otherwise(F.lower(token))


def _spaced(token: Column) -> Column:
    """As above, with a space on either side of an operator (comments are gone by then)."""
    operator = F.substring(token, 1, 1).isin(*_OPERATOR_CHARS)
    number = F.substring(token, 2, 1).between("0", "9")
    return (
        F.when(token == " ", token)
        .when(operator & ~number, F.concat(F.lit(" "), token, F.lit(" ")))
        .otherwise(_recased(token, True))
    )


def normalise_layout(sql: Column) -> Column:
    """Upper-case keywords, lower-case names, a space around operators, literals kept."""
    parts = F.transform(F.regexp_extract_all(sql, F.lit(SPACED_TOKEN), F.lit(0)), _spaced)
    return collapse(F.array_join(parts, ""))


def tidy_case(sql: Column, lower_names: bool = True) -> Column:
    """Keyword case plus whitespace clean-up: single spaces, none inside "( )" or before ","."""
    return strip(_tidied(sql, lower_names))


def _tidied(sql: Column, lower_names: bool) -> Column:
    """``tidy_case`` with the whitespace at the ends."""
    def piece(token: Column) -> Column:
        blank = F.substring(token, 1, 1).isin(*WS_CHARS)
        return F.when(token == " ", token).when(blank, " ").otherwise(_recased(token, lower_names))

    found = F.regexp_extract_all(or_empty(sql), F.lit(TIDY_TOKEN), F.lit(1))
    return F.array_join(F.transform(found, piece), "")


def comparable(sql: Column) -> Column:
    """The form in which two SQL texts are compared for an exact match.

    Each of "=", "<" and ">" stands alone, so "<=" reads "< =" on both sides of a comparison.
    """
    out = _tidied(sql, True)
    for sign in "=<>":
        out = F.replace(out, F.lit(sign), F.lit(f" {sign} "))
    return collapse(out)


def followers(toks: Column, words: Sequence[str]) -> Column:
    """Distinct tokens that directly follow one of ``words``.

    A list without them is not gone through, nor one in which a single word stands once.
    """
    after = F.filter(
        toks, lambda t, i: (i > 0) & F.get(toks, i - 1).isin(*words)
    )
    empty = F.array().cast("array<string>")
    nothing = F.when(toks.isNotNull(), empty)
    if len(words) > 1:
        present = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in words]))
        return F.when(present, F.array_distinct(after)).otherwise(nothing)
    size, first = F.size(toks), F.array_position(toks, words[0]).cast("int")
    rest = F.slice(toks, first + 1, size)  # from the token behind the word on
    return (
        F.when(first == 0, nothing)
        .when(first == size, empty)
        .when(F.array_contains(rest, words[0]), F.array_distinct(after))
        .otherwise(F.slice(toks, first + 1, 1))
    )


def table_references(toks: Column) -> Column:
    """How many FROM / JOIN tokens have a successor."""
    leading = F.when(F.size(toks) > 1, F.slice(toks, 1, F.size(toks) - 1)).otherwise(
        F.array().cast("array<string>")
    )
    rest = F.array_remove(F.array_remove(leading, "FROM"), "JOIN")
    return F.size(leading) - F.size(rest)
