"""Building blocks of the DuckDB queries, written apart from the Spark expressions.

DuckDB matches with RE2, which has no look-around and reads ``(?U)`` as "ungreedy"; the patterns
are spelled with explicit classes.
"""

from __future__ import annotations

from checks.views import GENERATIONS_CTE, RAW_CTE
from querymill.functions.cleaning import SAMPLE_KEYWORDS
from querymill.functions.ddl import COLUMN_TYPES
from querymill.functions.extraction import OPENING_KEYWORDS
from querymill.functions.lexing import KEYWORDS, TYPE_NAMES
from querymill.functions.rubric import RUBRIC_KEYWORDS
from querymill.functions.similarity import AGGREGATES, PAIR_KEYWORDS

WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]"
)
NON_WS = "[^" + WS[1:]


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{NON_WS}+')) AS INTEGER)"


def count(x: str, word: str) -> str:
    return f"CAST(len(string_split({x}, '{word}')) - 1 AS INTEGER)"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return f"[{quoted(values)}]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


# --- cleaning -----------------------------------------------------------------------------------

_WORD = "[0-9]*[A-Za-z_][A-Za-z0-9_]*"
_SPACED = (
    r"(?i:IN|VALUES|USING|FROM|AS)\b"
    rf"|{_WORD}(?:\(|(?:\s*\.\s*{_WORD})+|\s*\.)?"
    r"|--[^\n]*|/\*.*?\*/"
    r"""|\s+|''[^'']*(?:''''[^'']*)*''|"[^"]*(?:""[^"]*)*"|`[^`]*`"""
    r"|-?[0-9]+(?:\.[0-9]+)?|[<>=!~]+|[+/@#%&|^-]+|."
)
_RECASE = f"""CASE WHEN upper(x) IN ({quoted(KEYWORDS)}) THEN upper(x)
      WHEN regexp_matches(x, '^[''"0-9/-]') OR upper(x) IN ({quoted(TYPE_NAMES)}) THEN x
      ELSE {{other}} END"""


def pieces(x: str) -> str:
    return f"regexp_extract_all({x}, '{_SPACED}', 0, 's')"


def layout(x: str) -> str:
    spaced = (
        "CASE WHEN regexp_matches(x, '^[<>=!~+/@#%&|^-]') AND NOT regexp_matches(x, '^.[0-9]')"
        f" THEN ' ' || x || ' ' ELSE {_RECASE.format(other='lower(x)')} END"
    )
    return collapse(f"array_to_string([{spaced} for x in {pieces(x)}], '')")


def tidy(x: str, lower: bool = True) -> str:
    """Blanks go before "(" is followed by text; done on the joined text (no such literals here)."""
    recased = _RECASE.format(other="lower(x)" if lower else "x")
    joined = f"array_to_string([{recased} for x in {pieces(x)}], '')"
    opened = f"regexp_replace({joined}, '\\(\\s+', '(', 'g')"
    return f"trim(regexp_replace(regexp_replace({opened}, '\\s+([),])', '\\1', 'g'), '\\s+', ' ', 'g'))"


def comparable(x: str) -> str:
    """The spacing rewrites one after the other, in their order."""
    out = tidy(x)
    for op in ("=", "!=", "<>", "<=", ">=", "<", ">"):
        out = f"regexp_replace({out}, '\\s*{op}\\s*', ' {op} ', 'g')"
    return collapse(out)


def no_comments(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '--[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')"


def clean_question(x: str) -> str:
    return f"""(SELECT CASE WHEN q = '' OR regexp_matches(q, '[.?!]$') THEN q ELSE q || '?' END
      FROM (SELECT replace(replace(replace({collapse(f"coalesce({x}, '')")}, '’', ''''), '“', '"'), '”', '"') AS q))"""


def level(up: str) -> str:
    return f"""CASE WHEN ({up} LIKE '%WITH%' AND {up} LIKE '%AS%') OR {count(up, 'JOIN')} >= 2
        OR {count(up, 'SELECT')} >= 3 THEN 'complex'
      WHEN {count(up, 'JOIN')} = 1 OR {count(up, 'SELECT')} = 2 OR {up} LIKE '%GROUP BY%'
        OR {up} LIKE '%HAVING%' OR {up} LIKE '%UNION%' THEN 'medium'
      ELSE 'simple' END"""


PREP = f"""{RAW_CTE},
  cleaned AS (
    SELECT sample_id, {clean_question('question')} AS question,
      {collapse(no_comments("coalesce(context, '')"))} AS schema,
      {collapse(no_comments("coalesce(answer, '')"))} AS bare
    FROM raw),
  normed AS (SELECT * EXCLUDE (bare), {layout('bare')} AS sql FROM cleaned),
  prepped AS (
    SELECT *, {words('question')} AS question_length, {words('schema')} AS schema_length,
      {words('sql')} AS sql_length, trim(question) <> '' AND trim(sql) <> '' AS is_valid,
      CASE WHEN trim(question) = '' THEN 'Empty question'
        WHEN trim(sql) = '' THEN 'Empty answer (SQL)' END AS validation_error,
      [k for k in {listed(SAMPLE_KEYWORDS)} if contains(upper(sql), k)] AS kws,
      {level('upper(sql)')} AS complexity,
      CASE WHEN substr(md5('42|' || CAST(sample_id AS STRING)), 1, 8) < 'cccccccd' THEN 'train'
        WHEN substr(md5('42|' || CAST(sample_id AS STRING)), 1, 8) < 'e6666667' THEN 'validation'
        ELSE 'test' END AS split
    FROM normed),
  kept AS (
    SELECT * FROM prepped WHERE is_valid AND question_length BETWEEN 1 AND 512
      AND sql_length BETWEEN 1 AND 512)"""

# --- extraction and rubric ----------------------------------------------------------------------

_SHAPES = (
    r"\bSELECT\b.*\bFROM\b", r"\bINSERT\s+INTO\b", r"\bUPDATE\b.*\bSET\b", r"\bDELETE\s+FROM\b",
    r"\bCREATE\s+(?:TABLE|DATABASE|INDEX|VIEW)\b",
)


def looks_like_sql(x: str) -> str:
    starts = "|".join(OPENING_KEYWORDS)
    shapes = "|".join(_SHAPES)
    return f"(regexp_matches({x}, '^\\s*(?:{starts})', 'i') OR regexp_matches({x}, '{shapes}', 'i'))"


def clean_extracted(x: str) -> str:
    unlabelled = f"regexp_replace({x}, '^(?:SQL:|Query:|Answer:)\\s*', '', 'i')"
    return f"trim(replace(regexp_replace({unlabelled}, '{WS}+', ' ', 'g'), ' ;', ';'))"


def until_end(x: str) -> str:
    markers = "\\n\\n|\\nExplanation:|\\nNote:|\\nThis query|\\nThe above"
    return f"regexp_extract({x}, '^(.*?)(?:{markers}|\\z)', 1, 's')"


def raw_start(x: str) -> str:
    branches = "\n".join(
        f"WHEN regexp_matches({x}, '\\b{k}\\b', 'i') THEN regexp_extract({x}, '\\b{k}\\b.*', 0, 'is')"
        for k in OPENING_KEYWORDS
    )
    return f"CASE WHEN {looks_like_sql(x)} THEN {x} {branches} ELSE '' END"


def extraction(source: str, text: str, keep: str, name: str = "found") -> str:
    """CTEs up to ``name``: ``keep`` columns plus ``t`` (stripped text) and ``x`` (SQL or null)."""
    spans = "[s for s in [{0} for m in regexp_extract_all(t, '`([^`]+)`', 1, 's')] if {1}]".format(
        strip("m"), looks_like_sql("s")
    )
    fenced = "regexp_extract(t, '```(?:sql)?\\s*\\n(.*?)```', 1, 'is')"
    return f"""
  {name}_1 AS (SELECT {keep}, {text} AS original, {strip(f"coalesce({text}, '')")} AS t FROM {source}),
  {name}_2 AS (
    SELECT *, {clean_extracted(strip(fenced))} AS x1,
      {clean_extracted(f"coalesce(({spans})[1], '')")} AS x2,
      {clean_extracted(strip(until_end(raw_start('t'))))} AS x3
    FROM {name}_1),
  {name} AS (
    SELECT * EXCLUDE (x1, x2, x3),
      CASE WHEN x1 <> '' THEN x1 WHEN x2 <> '' THEN x2 WHEN x3 <> '' THEN x3 END AS x
    FROM {name}_2)"""


def has(up: str, names) -> str:
    return "(" + " OR ".join(f"contains({up}, '{n}')" for n in names) + ")"


VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE")


def keyword_hits(up: str) -> str:
    return (
        f"[k for k in {listed(RUBRIC_KEYWORDS)} if CASE WHEN contains(k, ' ') THEN contains({up}, k)"
        f" ELSE regexp_matches({up}, '\\b' || k || '\\b') END]"
    )


def scoring(source: str, name: str = "scored", tiers: bool = True, strict: bool = False) -> str:
    """CTEs from ``t, x`` to the score columns."""
    n = f"len({keyword_hits('up')})" if tiers else "0"
    zero = " OR NOT syntax_valid" if strict else ""
    return f"""
  {name}_1 AS (SELECT *, coalesce(upper(x), '') AS up FROM {source}),
  {name}_2 AS (
    SELECT *, {n} AS n,
      x IS NOT NULL AND NOT {has('up', ('FORM ', 'SLECT ', 'WEHERE '))} AS syntax_valid
    FROM {name}_1),
  {name}_3 AS (
    SELECT *,
      CASE WHEN x IS NULL THEN 0.0 WHEN syntax_valid THEN 1.0 ELSE 0.15 END::DOUBLE AS syntax,
      CASE WHEN x IS NULL THEN 0.0 WHEN n >= 5 THEN 1.0 WHEN n >= 3 THEN 0.75 WHEN n = 2 THEN 0.6
        WHEN n = 1 THEN 0.5 WHEN {has('up', VERBS)} THEN 0.3 ELSE 0.0 END::DOUBLE AS keywords,
      CASE WHEN length(t) < 10 THEN 0.0 WHEN length(t) > 4096 THEN 0.5 WHEN x IS NULL THEN 0.0
        ELSE least(1.0, 0.4 + CASE WHEN length(x) >= 10 THEN 0.3 ELSE 0.1 END
          + CASE WHEN ends_with(x, '...') OR ends_with(x, '…') THEN 0.05 ELSE 0.15 END
          + CASE WHEN {has('up', VERBS)} AND {has('up', ('FROM', 'INTO', 'TABLE'))} THEN 0.15
              WHEN {has('up', VERBS)} OR {has('up', ('FROM', 'INTO', 'TABLE'))} THEN 0.075
              ELSE 0 END) END::DOUBLE AS format
    FROM {name}_2),
  {name} AS (
    SELECT *, CASE WHEN x IS NULL{zero} THEN 0.0
      ELSE greatest(0.0, least(1.0, 0.4::DOUBLE * syntax + 0.3::DOUBLE * keywords + 0.3::DOUBLE * format))
      END::DOUBLE AS total,
      x IS NOT NULL AND length(t) BETWEEN 10 AND 4096 AND length(x) >= 10 AS valid
    FROM {name}_3)"""


EXTRACTED = GENERATIONS_CTE + "," + extraction("gens", "response", "sample_id, candidate, model")
SCORED = EXTRACTED + "," + scoring("found")

# --- schema text --------------------------------------------------------------------------------

_Q = '[`"]?'
TABLE_RE = rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_Q}(\w+){_Q}\s*\(([^;]*)\)"
COLUMN_RE = rf"^{_Q}(\w+){_Q}\s+(?:{'|'.join(COLUMN_TYPES)})"


def definitions(source: str, context: str, name: str = "defs") -> str:
    """CTE with one row per recognised table: sample_id, pos, table_name, cols."""
    names = f"regexp_extract_all({context}, '{TABLE_RE}', 1, 'i')"
    bodies = f"regexp_extract_all({context}, '{TABLE_RE}', 2, 'i')"
    column = f"regexp_extract({strip('d')}, '{COLUMN_RE}', 1, 'i')"
    return f"""
  {name}_1 AS (
    SELECT sample_id, unnest({names}) AS table_name, unnest({bodies}) AS body,
      unnest(range(len({names}))) AS pos
    FROM {source} WHERE {context} IS NOT NULL),
  {name}_2 AS (
    SELECT sample_id, pos, table_name,
      [c for c in [{column} for d in string_split(body, ',')] if c <> ''] AS cols
    FROM {name}_1),
  {name} AS (SELECT * FROM {name}_2 WHERE len(cols) > 0)"""


REWARDED = f"""{SCORED},
  {definitions('raw', 'context')},
  known AS (SELECT sample_id, list(upper(table_name)) AS tables FROM defs GROUP BY sample_id),
  rewarded AS (
    SELECT s.*, greatest(0.0, least(1.0, total * CASE
        WHEN x IS NOT NULL AND k.tables IS NOT NULL AND NOT list_has_any(k.tables, list_concat(
          regexp_extract_all(up, '\\bFROM\\s+[`"]?(\\w+)', 1),
          regexp_extract_all(up, '\\bJOIN\\s+[`"]?(\\w+)', 1))) THEN 0.7::DOUBLE ELSE 1.0 END)) AS reward
    FROM scored s LEFT JOIN known k USING (sample_id))"""

# --- pair metrics -------------------------------------------------------------------------------

TOKEN_RE = (
    r"(?:(?:(?:LEFT|RIGHT|FULL)\s+)?(?:(?:INNER|OUTER|CROSS|NATURAL)\s+)?JOIN|(?:GROUP|ORDER)\s+BY"
    rf"|UNION\s+ALL|NOT\s+NULL)\b|{_WORD}|--[^\n]*|/\*.*?\*/"
    r"""|''[^'']*(?:''''[^'']*)*''|"[^"]*(?:""[^"]*)*"|`[^`]*`"""
    r"|-?[0-9]+(?:\.[0-9]+)?|[<>=!~]+|[+/@#%&|^-]+|[^\s\w]"
)


def tokens(x: str) -> str:
    return f"regexp_extract_all(upper({x}), '{TOKEN_RE}', 0, 's')"


def after(toks: str, word: str) -> str:
    return f"list_distinct([{toks}[i + 1] for i in range(1, len({toks})) if {toks}[i] = '{word}'])"


def features(source: str, sql: str, name: str) -> str:
    """CTEs adding the per-query features of column ``sql`` to ``source``."""
    select_part = strip("replace(string_split(up, 'FROM')[1], 'SELECT', '')")
    conditions = f"{count('up', 'WHERE')} + {count('up', 'AND')} + {count('up', 'OR')}"
    return f"""
  {name}_1 AS (
    SELECT *, upper({sql}) AS up, {tokens(sql)} AS toks, {comparable(sql)} AS norm FROM {source}),
  {name}_2 AS (
    SELECT *,
      CASE WHEN contains(up, 'SELECT') THEN list_distinct(string_split({select_part}, ','))
        ELSE [] END AS s_select,
      {after('toks', 'FROM')} AS s_from, {after('toks', 'JOIN')} AS s_join,
      [a for a in {listed(AGGREGATES)} if contains(up, a)] AS s_agg,
      [k for k in {listed(PAIR_KEYWORDS)} if contains(up, k)] AS pkws,
      CAST(len(toks) AS INTEGER) AS num_tokens,
      CAST(len([1 for i in range(1, len(toks)) if toks[i] IN ('FROM', 'JOIN')]) AS INTEGER) AS num_tables,
      {count('up', 'JOIN')} AS num_joins,
      regexp_matches(up, 'FROM.*SELECT', 's') AS has_subquery,
      {has('up', AGGREGATES)} AS has_aggregation,
      contains(up, 'GROUP BY') AS has_group_by, contains(up, 'ORDER BY') AS has_order_by,
      contains(up, 'HAVING') AS has_having, {conditions} AS num_conditions
    FROM {name}_1),
  {name}_3 AS (
    SELECT *, num_tokens * 0.1::DOUBLE + num_tables * 5 + num_joins * 10
      + CASE WHEN has_subquery THEN 20 ELSE 0 END + CASE WHEN has_aggregation THEN 10 ELSE 0 END
      + CASE WHEN has_group_by THEN 10 ELSE 0 END + num_conditions * 3 AS score
    FROM {name}_2),
  {name} AS (
    SELECT *, CASE WHEN trim(up) = '' THEN 'invalid' WHEN score < 20 THEN 'simple'
      WHEN score < 50 THEN 'medium' ELSE 'complex' END AS lvl FROM {name}_3)"""


def jaccard(kind: str) -> str:
    p, r = f"p.s_{kind}", f"r.s_{kind}"
    return (
        f"CASE WHEN len({r}) > 0 THEN len(list_intersect({p}, {r}))::DOUBLE"
        f" / len(list_distinct(list_concat({p}, {r}))) END"
    )


_KINDS = ("select", "from", "join", "agg")
_TP = "len(list_intersect(p.pkws, r.pkws))"
OVERLAP = (
    "CASE WHEN len(r.toks) = 0 THEN 0.0 ELSE list_sum([least(len(list_filter(p.toks, lambda y: y = t)),"
    " len(list_filter(r.toks, lambda y: y = t))) for t in list_distinct(r.toks)])::DOUBLE"
    " / len(r.toks) END"
)
PAIR_COLUMNS = f"""
      CASE WHEN p.norm = r.norm THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match,
      ({OVERLAP})::DOUBLE AS token_accuracy,
      coalesce(list_avg([v for v in [{', '.join(jaccard(k) for k in _KINDS)}] if v IS NOT NULL]), 0.0)::DOUBLE
        AS structural_similarity,
      CASE WHEN len(r.pkws) = 0 OR len(p.pkws) = 0 THEN 0.0 ELSE {_TP}::DOUBLE / len(p.pkws) END::DOUBLE AS keyword_precision,
      CASE WHEN len(r.pkws) = 0 THEN 0.0 ELSE {_TP}::DOUBLE / len(r.pkws) END::DOUBLE AS keyword_recall,
      p.lvl AS predicted_complexity, r.lvl AS reference_complexity,
      CASE WHEN p.lvl = r.lvl THEN 1 ELSE 0 END AS complexity_match,
      CAST(levenshtein(p.norm, r.norm) AS INTEGER) AS levenshtein"""

# Responses against the kept samples: one row per pair, all metric columns.
EVALUATED = f"""{PREP},
  gens AS (
    SELECT sample_id, candidate, 'model_' || CAST(candidate % 2 AS STRING) AS model,
      {{response}} AS response
    FROM raw CROSS JOIN (SELECT UNNEST([0, 1, 2, 3]) AS candidate) c),
  {extraction('gens', 'response', 'sample_id, candidate, model')},
  predicted AS (
    SELECT sample_id, candidate, model, coalesce(x, '') AS predicted_sql, x,
      x IS NOT NULL AND length(t) BETWEEN 10 AND 4096 AND length(x) >= 10 AS valid
    FROM found),
  {features('kept', 'sql', 'ref')},
  {features('predicted', 'predicted_sql', 'pred')},
  rated AS (
    SELECT p.sample_id, p.candidate, p.model, r.question, p.predicted_sql, r.sql AS reference_sql,
      p.valid, r.complexity, true AS paired, {PAIR_COLUMNS}
    FROM pred p JOIN ref r USING (sample_id)
    UNION ALL BY NAME
    SELECT sample_id, candidate, model, predicted_sql, valid, false AS paired
    FROM pred ANTI JOIN ref USING (sample_id)),
  results AS (
    SELECT *, CASE WHEN NOT paired THEN NULL WHEN keyword_precision + keyword_recall > 0
      THEN 2.0 * (keyword_precision * keyword_recall) / (keyword_precision + keyword_recall)
      ELSE 0.0 END::DOUBLE AS keyword_f1 FROM rated)"""


def _fill_response() -> str:
    from checks.views import RESPONSE_TEXT

    return EVALUATED.replace("{response}", RESPONSE_TEXT.strip())


EVALUATED = _fill_response()
