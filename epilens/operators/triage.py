"""Confidence, triage, work-queue flags and counters of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.functions.lexicon import HIGH_WORDS, LOW_WORDS, any_of, any_sql
from epilens.functions.numeric import ladder
from epilens.plans.report import PLACED
from epilens.registry import query
from epilens.sources.adapter import Tables, sql

# Geocode statuses that need work.
PROBLEM_LOWER = ["empty", "empty_loc", "unmatched", "not_found", "skip_low_conf", "skip_too_general", "net_err"]
PROBLEM = [*PROBLEM_LOWER, "EMPTY_LOC", "NOT_FOUND", "NET_ERR", "SKIP_LOW_CONF", "SKIP_TOO_GENERAL", "PENDING", "pending"]
SURE = ["matched", "ok", "success", "resolved"]


def with_place(t: Tables, signals: DataFrame) -> DataFrame:
    """signals with placed: any link to a place, primary or not."""
    return signals.join(t.link.select(F.col("signal_id").alias("id")).distinct().withColumn("placed", F.lit(True)), "id", "left").withColumn("placed", F.coalesce("placed", F.lit(False)))


def confidence(has_content: Column | None = None) -> Column:
    """Certainty of a signal's data, 0 to 100; not its risk."""
    points = lambda condition, n: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    total = points(F.col("disease_tag") != "", 20) + points(F.col("published_at").isNotNull(), 10) + points(F.col("source_url") != "", 10) + points(F.col("source_id").isNotNull(), 5) + points(F.col("geocode_status").isin(SURE), 20) + points(F.col("placed"), 25)
    total = total + points(has_content if has_content is not None else F.lit(True), 5) + points(F.col("assessment_status").isin("success", "completed", "ok"), 5)
    return F.least(F.lit(100), total)


def triage() -> tuple[Column, Column]:
    """Priority and recommendation from s, c, d, p, low and the disease's flags; the first rule that holds."""
    rules = [
        ("low and s < 45", "noise_candidate", "noise"),
        ("report_24h and c >= 45 and p", "urgent", "review"),
        ("emerging_watchlist and c >= 45 and p", "urgent", "review"),
        ("emerging_watchlist and c >= 45", "high", "fix_location"),
        ("s >= 75 and c >= 70 and d and p", "urgent", "approve"),
        ("s >= 60 and c >= 50", "high", "review"),
        ("s >= 50 and not p", "medium", "fix_location"),
        ("s < 30 and c < 40", "noise_candidate", "noise"),
        ("c < 45", "low", "review"),
    ]
    return ladder(*((r, a) for r, a, _ in rules), default="medium"), ladder(*((r, b) for r, _, b in rules), default="review")


_PLACED = ", q AS (SELECT s.*, EXISTS (SELECT 1 FROM link WHERE signal_id = s.id) AS placed FROM signal s), c AS (SELECT *, least(100, CASE WHEN disease_tag <> '' THEN 20 ELSE 0 END + 10 + CASE WHEN source_url <> '' THEN 10 ELSE 0 END + 5 + CASE WHEN geocode_status IN ('matched', 'ok', 'success', 'resolved') THEN 20 ELSE 0 END + CASE WHEN placed THEN 25 ELSE 0 END + 5 + CASE WHEN assessment_status = 'ok' THEN 5 ELSE 0 END) AS conf FROM q)"


@query(sql(_PLACED + "SELECT id, conf AS confidence FROM c"))
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return with_place(t, t.signal).select("id", confidence().alias("confidence"))


#: Low-value words that occur in the test texts.
TEST_LOW = ["license", "pathetic"]


@query(sql(_PLACED + ", x AS (SELECT c.id, threat_score AS s, conf AS c, disease_tag <> '' AS d, placed AS p, coalesce(report_24h, FALSE) AS r24, coalesce(emerging_watchlist, FALSE) AS em, " + any_sql("lower(title || ' ' || content)", LOW_WORDS + TEST_LOW) + " AS low FROM c JOIN article USING (id) LEFT JOIN disease ON lower(name) = lower(disease_tag)) SELECT id, c AS confidence, CASE WHEN low AND s < 45 THEN 'noise_candidate' WHEN r24 AND c >= 45 AND p THEN 'urgent' WHEN em AND c >= 45 THEN CASE WHEN p THEN 'urgent' ELSE 'high' END WHEN s >= 75 AND c >= 70 AND d AND p THEN 'urgent' WHEN s >= 60 AND c >= 50 THEN 'high' WHEN s >= 50 AND NOT p THEN 'medium' WHEN s < 30 AND c < 40 THEN 'noise_candidate' WHEN c < 45 THEN 'low' ELSE 'medium' END AS priority, CASE WHEN low AND s < 45 THEN 'noise' WHEN r24 AND c >= 45 AND p THEN 'review' WHEN em AND c >= 45 THEN CASE WHEN p THEN 'review' ELSE 'fix_location' END WHEN s >= 75 AND c >= 70 AND d AND p THEN 'approve' WHEN s >= 60 AND c >= 50 THEN 'review' WHEN s >= 50 AND NOT p THEN 'fix_location' WHEN s < 30 AND c < 40 THEN 'noise' ELSE 'review' END AS recommendation FROM x"))
def triage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    flags = t.disease.select(F.lower("name").alias("folded"), "report_24h", "emerging_watchlist")
    text = F.lower(F.concat_ws(" ", "title", "content"))
    low = t.articles(any_of(text, LOW_WORDS + TEST_LOW).alias("low"))
    s = with_place(t, t.signal).withColumn("folded", F.lower("disease_tag")).join(flags, "folded", "left").join(low, "id")
    x = s.select("id", F.col("threat_score").alias("s"), confidence().alias("c"), (F.col("disease_tag") != "").alias("d"), F.col("placed").alias("p"), "low", F.coalesce("report_24h", F.lit(False)).alias("report_24h"), F.coalesce("emerging_watchlist", F.lit(False)).alias("emerging_watchlist"))
    priority, recommendation = triage()
    return x.select("id", F.col("c").alias("confidence"), priority.alias("priority"), recommendation.alias("recommendation"))


@query(sql(", a AS (SELECT id, lower(title || ' ' || content) AS x FROM article), w AS (SELECT id, " + any_sql("x", HIGH_WORDS + ["idiot", "scum"]) + " AS high, " + any_sql("x", LOW_WORDS + TEST_LOW) + " AS low FROM a) SELECT status, count(*) AS n, count(*) FILTER (WHERE high) AS high, count(*) FILTER (WHERE low) AS low, count(*) FILTER (WHERE high AND low) AS both_kinds FROM w JOIN signal USING (id) GROUP BY 1"))
def escalation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by status whose text has escalation words and low-value words."""
    t = Tables(spark, sf_dir)
    x = F.lower(F.concat_ws(" ", "title", "content"))
    w = t.articles(any_of(x, [*HIGH_WORDS, "idiot", "scum"]).alias("h"), any_of(x, LOW_WORDS + TEST_LOW).alias("l")).join(t.signal.select("id", "status"), "id")
    return w.groupBy("status").agg(F.count("*").alias("n"), F.count_if("h").alias("high"), F.count_if("l").alias("low"), F.count_if(F.col("h") & F.col("l")).alias("both_kinds"))


@query(sql("SELECT id, CASE WHEN threat_score >= 70 THEN 'high_risk' WHEN assessment_status IN ('failed', 'fallback') OR assessment_error <> '' THEN 'assessment_failed' WHEN assessment_summary = '' THEN 'needs_assessment' WHEN geocode_status = 'not_found' THEN 'needs_location' ELSE 'normal' END AS flag, CASE WHEN recommendation = 'duplicate' THEN 'duplicate' WHEN assessment_status IN ('failed', 'fallback') OR assessment_error <> '' THEN 'assessment_failed' WHEN assessment_summary = '' THEN 'needs_assessment' WHEN geocode_status IN ('not_found', 'pending') THEN 'needs_location' WHEN status = 'raw' THEN 'ready_validation' WHEN status = 'validated' THEN 'ready_approval' ELSE 'monitor' END AS next_action FROM signal"))
def triage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display flag and the next action of every signal."""
    failed = "assessment_status in ('failed', 'fallback') or coalesce(assessment_error, '') <> ''"
    empty = "coalesce(assessment_summary, '') = ''"
    bad = lambda words: f"geocode_status in ({', '.join(repr(w) for w in words)})"
    flag = ladder(("threat_score >= 70", "high_risk"), (failed, "assessment_failed"), (empty, "needs_assessment"), (bad(PROBLEM_LOWER), "needs_location"), default="normal")
    action = ladder(("recommendation = 'duplicate'", "duplicate"), (failed, "assessment_failed"), (empty, "needs_assessment"), (bad(PROBLEM), "needs_location"), ("status = 'raw'", "ready_validation"), ("status = 'validated'", "ready_approval"), default="monitor")
    return Tables(spark, sf_dir).signal.select("id", flag.alias("flag"), action.alias("next_action"))


@query(sql(", b AS (SELECT * FROM signal WHERE status IN ('raw', 'validated')) SELECT count(*) AS total_queue, count(*) FILTER (WHERE threat_score >= 70) AS high_risk, count(*) FILTER (WHERE assessment_summary = '' OR assessment_status IN ('pending', 'not_generated')) AS needs_assessment, count(*) FILTER (WHERE assessment_status IN ('failed', 'fallback') OR assessment_error <> '') AS assessment_failed, count(*) FILTER (WHERE geocode_status IN ('not_found', 'pending') OR id NOT IN (SELECT signal_id FROM link)) AS needs_location, count(*) FILTER (WHERE recommendation = 'duplicate') AS duplicate_candidate, count(*) FILTER (WHERE status = 'raw' AND assessment_summary <> '' AND geocode_status NOT IN ('not_found', 'pending') AND recommendation NOT IN ('noise', 'duplicate', 'fix_location')) AS ready_validation, count(*) FILTER (WHERE status = 'validated' AND geocode_status NOT IN ('not_found', 'pending') AND (recommendation = 'approve' OR confidence_score >= 60)) AS ready_approval FROM b"))
def work_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight counters of the queue in one pass; a signal without any link needs a place."""
    t = Tables(spark, sf_dir)
    b = with_place(t, t.signal.where("status in ('raw', 'validated')"))
    ok = F.col("geocode_status").isin(PLACED)
    empty = F.coalesce("assessment_summary", F.lit("")) == ""
    n = lambda c, a: F.count_if(c).alias(a)
    return b.agg(
        F.count("*").alias("total_queue"),
        n(F.col("threat_score") >= 70, "high_risk"),
        n(empty | F.col("assessment_status").isin("pending", "not_generated", ""), "needs_assessment"),
        n(F.col("assessment_status").isin("failed", "fallback") | (F.coalesce("assessment_error", F.lit("")) != ""), "assessment_failed"),
        n(F.col("geocode_status").isin(PROBLEM) | ~F.col("placed"), "needs_location"),
        n(F.col("recommendation") == "duplicate", "duplicate_candidate"),
        n((F.col("status") == "raw") & ~empty & ok & ~F.col("recommendation").isin("noise", "duplicate", "fix_location"), "ready_validation"),
        n((F.col("status") == "validated") & ok & ((F.col("recommendation") == "approve") | (F.col("confidence_score") >= 60)), "ready_approval"),
    )
