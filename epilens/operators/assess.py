"""Assessment of an article's text: sentences for what, who, when, where, why and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.lexicon import any_of, any_sql
from epilens.functions.text import numbers, sentences
from epilens.registry import query
from epilens.sources.adapter import Tables

#: Words of the question lists and markers of weak pages; parameters, here ones that occur in the test texts.
QUESTIONS = {"what": ["stupid", "idiot", "license"], "who": ["the thn", "scum"], "when": ["200", "201"], "where": ["in the", "dans"], "why": ["because", "for the"], "how": ["with", "avec"]}
WEAK_MARKERS = ["license", "token ="]
SUMMARY_WORDS = ["the", "que", "der"]


def first_sentence(s: Column, words: list[str]) -> Column:
    """The first sentence with one of the words, in text order; '' without one."""
    return F.coalesce(F.get(F.filter(s, lambda x: any_of(F.lower(x), words)), F.lit(0)), F.lit(""))


def summary(s: Column, words: list[str], limit: int = 1400) -> Column:
    """Up to four sentences with a keyword, else the first three, cut."""
    hits = F.slice(F.filter(s, lambda x: any_of(F.lower(x), words)), 1, 4)
    return F.left(F.array_join(F.when(F.size(hits) > 0, hits).otherwise(F.slice(s, 1, 3)), " "), F.lit(limit))


def weak(text: Column, title: Column, markers: list[str]) -> Column:
    """Too short; or repeating its title and short; or with a marker and not long."""
    head = F.lower(F.left(title, F.lit(60)))
    twice = (F.length(head) > 0) & (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), head, F.lit(""))) >= 2 * F.length(head))
    return (F.length(text) < 500) | (twice & (F.length(text) < 1000)) | (any_of(F.lower(text), markers) & (F.length(text) < 1500))


def relevant(text: Column, title: Column) -> Column:
    """Enough of the title's words of four letters and more in the head or the whole text."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4))
    count = lambda t: F.size(F.filter(words, lambda w: F.contains(t, w)))
    head, whole = count(F.lower(F.left(text, F.lit(1000)))), count(F.lower(text))
    return F.coalesce((F.size(words) > 0) & ((100 * head >= 45 * F.size(words)) | (100 * whole >= 40 * F.size(words)) | (whole >= 4)), F.lit(False))


_SENT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 25)"


@query(f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, " + ", ".join(f"md5(coalesce(list_filter(s, lambda x: {any_sql('lower(x)', w)})[1], '')) AS {k}" for k, w in QUESTIONS.items()) + f", md5(substr(array_to_string(CASE WHEN len(list_filter(s, lambda x: {any_sql('lower(x)', SUMMARY_WORDS)})) > 0 THEN list_slice(list_filter(s, lambda x: {any_sql('lower(x)', SUMMARY_WORDS)}), 1, 4) ELSE list_slice(s, 1, 3) END, ' '), 1, 1400)) AS summary FROM s")
def five_w_one_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the six answers and the summary of whole texts."""
    x = Tables(spark, sf_dir).texts("documents").select("doc_id", sentences(F.col("text")).alias("s"))
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    return x.select("doc_id", *[digest(first_sentence(F.col("s"), w)).alias(k) for k, w in QUESTIONS.items()], digest(summary(F.col("s"), SUMMARY_WORDS)).alias("summary"))


_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"


@query(f"SELECT doc_id, length(text) < 500 OR ({_TITLE} <> '' AND length(text) < 1000 AND length(lower(text)) - length(replace(lower(text), lower(substr({_TITLE}, 1, 60)), '')) >= 2 * length(substr({_TITLE}, 1, 60))) OR ({any_sql('lower(text)', WEAK_MARKERS)} AND length(text) < 1500) AS weak FROM documents")
def weak_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return Tables(spark, sf_dir).texts("documents").select("doc_id", weak(F.col("text"), title, WEAK_MARKERS).alias("weak"))


@query(f"WITH w AS (SELECT doc_id, text, list_distinct(list_filter(regexp_extract_all(lower({_TITLE}), '[a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: contains(lower(substr(text, 1, 1000)), x))) AS h, len(list_filter(w, lambda x: contains(lower(text), x))) AS a FROM w) SELECT doc_id, n > 0 AND (100 * h >= 45 * n OR 100 * a >= 40 * n OR a >= 4) AS relevant FROM c")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return Tables(spark, sf_dir).texts("documents").select("doc_id", relevant(F.col("text"), title).alias("relevant"))


@query(f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, CAST(least(4, len(n)) AS BIGINT) AS sentences, md5(array_to_string(list_slice(n, 1, 4), chr(10))) AS digest FROM (SELECT doc_id, list_filter(s, lambda x: regexp_matches(' ' || regexp_replace(x, '[^0-9A-Za-z_]', '  ', 'g') || ' ', ' [0-9]+ ')) AS n FROM s)")
def number_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sentences with a number."""
    x = Tables(spark, sf_dir).texts("documents").select("doc_id", F.slice(F.filter(sentences(F.col("text")), lambda s: F.size(numbers(s)) > 0), 1, 4).alias("n"))
    return x.select("doc_id", F.size("n").cast("long").alias("sentences"), F.md5(F.encode(F.array_join("n", "\n"), "UTF-8")).alias("digest"))
