"""The text rules over the given texts: documents, conversations and web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as Q
from checks.prep import RAW, new_path
from checks.registry import joined, query, rounded
from checks.views import raw_samples
from querymill.functions import cleaning, extraction, similarity
from querymill.functions.text import word_count
from querymill.operators import prepare, profile, sampling
from querymill.plans import jobs
from querymill.sources import corpus


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("text_clean_turns", f"SELECT conv_id, turn, {Q.clean_question('text')} AS question FROM conversations")
def clean_turns(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", cleaning.clean_question(F.col("text")).alias("question"))


@query("text_word_counts", f"SELECT doc_id, {Q.words('text')} AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"))


@query(
    "text_bare_documents",
    f"SELECT doc_id, md5({Q.collapse(Q.no_comments('text'))}) AS bare_md5 FROM documents",
)
def bare_documents(spark, sf_dir):
    """Comments dropped and white space collapsed, over whole documents."""
    return _table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(cleaning.clean_schema(F.col("text"))).alias("bare_md5")
    )


@query(
    "text_keywords",
    f"""SELECT doc_id, array_to_string([k for k in {Q.listed(cleaning.SAMPLE_KEYWORDS)} if contains(upper(text), k)], '|') AS keywords,
  {Q.level('upper(text)')} AS complexity FROM documents""",
)
def keywords(spark, sf_dir):
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        joined(cleaning.sample_keywords(text)).alias("keywords"),
        cleaning.complexity_level(text).alias("complexity"),
    )


@query(
    "text_pair_keywords",
    f"SELECT conv_id, turn, array_to_string([k for k in {Q.listed(similarity.PAIR_KEYWORDS)} if contains(upper(text), k)], '|') AS keywords FROM conversations",
)
def pair_keywords(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", joined(similarity.pair_keywords(F.upper("text"))).alias("keywords")
    )


_LENGTHS = f"""WITH d AS (SELECT lang, {Q.words('text')} AS n FROM documents)
SELECT lang, 'sql_length' AS field, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, min(n) AS min, max(n) AS max,
  round(stddev_pop(n), 6) AS std, """ + ", ".join(
    f"round(quantile_cont(n, {p / 100}), 6)::DOUBLE AS p{p}" for p in profile.PERCENTILES
) + " FROM d GROUP BY lang"


@query("text_lengths", _LENGTHS)
def lengths(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("lang", word_count(F.col("text")).alias("sql_length"))
    return rounded(profile.length_profile(documents, ("lang",)))


@query(
    "text_inline_code",
    Q.with_(Q.extraction("(SELECT page_id, html FROM pages)", "html", "page_id"))
    + "SELECT page_id, x AS extracted_sql FROM found",
)
def inline_code(spark, sf_dir):
    """The extraction cascade over raw web pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return extraction.add_extraction(pages, "html").select("page_id", "extracted_sql")


@query(
    "text_prepared_turns",
    f"""WITH t AS (SELECT conv_id, turn, {Q.clean_question('text')} AS question, {Q.layout(Q.collapse(Q.no_comments('text')))} AS sql
  FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {Q.words('question')} AS question_length, {Q.words('sql')} AS sql_length,
  trim(question) <> '' AND trim(sql) <> '' AS is_valid, {Q.level('upper(sql)')} AS complexity FROM t""",
)
def prepared_turns(spark, sf_dir):
    """User turns through the preparation of samples, each as question and as answer."""
    turns = _table(spark, sf_dir, "conversations").where("role = 'user'")
    samples = turns.select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("answer"), F.lit("").alias("context"))
    return prepare.preprocess(samples).select(
        "conv_id", "turn", "question_length", "sql_length", "is_valid", "complexity"
    )


@query(
    "text_sample_documents",
    "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY md5('42|' || CAST(doc_id AS STRING)) LIMIT 150",
)
def sample_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("text_md5"))
    return sampling.uniform_sample(documents, 150).withColumnRenamed("sample_id", "doc_id")


@query(
    "sample_turns_by_conversation",
    "SELECT CAST(1000 AS BIGINT) AS wanted, least(1000, count(*)) AS drawn FROM conversations",
)
def sample_turns(spark, sf_dir):
    """Ids repeat, and still exactly n rows are drawn."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), "turn")
    drawn = sampling.uniform_sample(turns.dropDuplicates(["sample_id", "turn"]), 1000)
    return drawn.agg(F.lit(1000).cast("long").alias("wanted"), F.count("*").alias("drawn"))


def _through_csv(spark, sf_dir, **options):
    """All raw samples, line breaks, empty texts and nulls included, written as CSV and read again."""
    path = new_path(spark, "raw-csv")
    raw_samples(spark, sf_dir).write.options(**corpus.CSV).csv(path)
    return corpus.read_corpus(spark, path, fmt="csv", **options)


@query("scan_csv_corpus", RAW + "SELECT sample_id, question, context, answer FROM raw")
def scan_csv(spark, sf_dir):
    """One task per file, for quotes of any kind."""
    return _through_csv(spark, sf_dir, multiLine=True)


@query("scan_csv_whole_corpus", RAW + "SELECT sample_id, question, context, answer FROM raw")
def scan_csv_whole(spark, sf_dir):
    """Many tasks per file."""
    return _through_csv(spark, sf_dir)


@query(
    "prep_stratified_corpus",
    Q.with_(Q.PREP) + """, held AS (SELECT *, row_number() OVER (PARTITION BY complexity ORDER BY md5('42|' || CAST(sample_id AS STRING))) AS r,
  count(*) OVER (PARTITION BY complexity) AS n FROM kept)
SELECT sample_id, complexity, CASE WHEN r <= n - ceil(round(n * 0.2, 6)) THEN 'train'
  WHEN r <= n - ceil(round(ceil(round(n * 0.2, 6)) * 0.5, 6)) THEN 'validation' ELSE 'test' END AS split FROM held""",
)
def stratified_corpus(spark, sf_dir):
    prepared = jobs.prepare_corpus(raw_samples(spark, sf_dir), stratify_by="complexity")
    return prepared.select("sample_id", "complexity", "split")
