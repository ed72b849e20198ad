"""Phrases and needles in texts, by equi-joins on their rarest piece: the plan does not depend on how many there are.

Lists are taken apart by explode_outer, and joins drop its empty rows: for explode the optimiser puts a filter on the
list below it, so that a list made from a text would be made twice, and by item where lambdas are in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilens.functions.text import search_text


def mentions(texts: DataFrame, phrases: DataFrame, key: str, text: str | Column, form: str = "form") -> DataFrame:
    """key, form, start, end: every place where a phrase's words stand one after the other, counted in words.

    Texts and phrases are compared in their search form. Texts are taken apart once: the places of words that phrases
    have become rows. A phrase is looked up by its rarest word, that with the fewest places, and its other words are met
    by their places; a phrase with a word that no text has is out. `key` names a text; texts that share one are told apart
    no further.
    """
    parts = phrases.select(F.col(form).alias("form")).where("form <> ''").distinct().withColumn("f", F.split("form", " "))
    form_words = parts.select("form", F.size("f").alias("n"), F.posexplode("f").alias("pos", "word"))
    text = text if isinstance(text, Column) else F.col(text)
    # Words of different texts that share a key make no phrase: the text's hash tells them apart.
    words = texts.where(F.col(key).isNotNull()).select(key, F.xxhash64(text).alias("h"), F.posexplode_outer(F.split(search_text(text), " ")).alias("i", "word"))
    seen = words.join(measured(form_words.select("word").distinct()), "word").persist()  # few rows, for the counts and both kinds of places
    counts = seen.groupBy("word").agg(F.count("*").alias("places"))
    rarity = F.struct(F.coalesce("places", F.lit(0)).alias("places"), "pos")
    rarest = form_words.join(counts, "word", "left").groupBy("form").agg(F.min(rarity).alias("least"), F.min_by(F.struct("word", "pos", "n"), rarity).alias("a"))
    anchors = rarest.where("least.places > 0").select("form", "a.*")
    at = seen.join(anchors, "word").where("i >= pos").select(key, "h", "form", "n", "pos", (F.col("i") - F.col("pos")).alias("start"))
    others = form_words.select("form", F.col("pos").alias("p"), "word")
    around = at.where("n > 1").join(others, "form").where("p <> pos").withColumn("i", F.col("start") + F.col("p"))
    whole = around.join(seen, [key, "h", "i", "word"]).groupBy(key, "h", "form", "n", "start").agg(F.count_distinct("p").alias("met")).where("met = n - 1")
    met = at.where("n = 1").select(key, "form", "n", "start").unionByName(whole.select(key, "form", "n", "start"))
    return met.select(key, "form", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end"))


def leftmost_longest(found: DataFrame, key: str) -> DataFrame:
    """key, form, start, end: from the left, the longest mention that begins first and after the last one chosen."""
    longest = found.groupBy(key, "start").agg(F.max(F.struct("end", "form")).alias("m"))
    spans = longest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", F.col("m.end").alias("end"), F.col("m.form").alias("form")))).alias("spans"))
    none = F.struct(F.lit(0).cast("long").alias("end"), F.filter("spans", lambda _: F.lit(False)).alias("kept"))
    chosen = F.aggregate("spans", none, lambda a, x: F.when(x["start"] >= a["end"], F.struct(x["end"].alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return spans.select(key, F.explode_outer(chosen).alias("s")).select(key, "s.form", "s.start", "s.end")


#: Characters of a word's piece by which a needle's word meets the words that hold it.
PIECE = 3


def _tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character but white space by itself."""
    return F.regexp_extract_all(c, F.lit(r"([a-z0-9]+|[^a-z0-9\s])"), 1)


def _words(c: Column) -> Column:
    """The runs of _tokens, with repeats and perhaps an empty one: cut at the gaps, which takes a third of the time."""
    return F.split(c, "[^a-z0-9]+")


def _marks(c: Column) -> Column:
    """The other characters of _tokens, each once and perhaps an empty one: for more than MARKS different ones."""
    return F.array_distinct(F.split(F.array_join(F.array_distinct(F.split(c, r"[a-z0-9\s]+")), ""), ""))


def _pieces(c: Column, sizes: list[int]) -> Column:
    """All pieces of a word of these numbers of characters, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.concat(*[F.when(F.length(c) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in sizes], F.array().cast("array<string>")))


#: Different marks up to which each is looked for in a text; beyond, the text is cut into its marks.
MARKS = 16
#: Bytes up to which a table is broadcast; beyond, the optimiser joins it.
BROADCAST_BYTES = 16 << 20


def measured(df: DataFrame) -> DataFrame:
    """df, kept and counted: marked for broadcasting where its texts and 64 bytes a row are at most BROADCAST_BYTES."""
    df = df.persist()
    texts = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
    size = df.agg(F.sum(sum(texts, F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def needles_in(texts: DataFrame, needles: DataFrame, key: str, text: str | Column, needle: str = "needle") -> DataFrame:
    """key, needle: each needle that is somewhere in the lower-cased text, also within words, once a text.

    A needle's longest token lies within one token of a text that has the needle. The distinct tokens of all texts are met
    with these on a piece of up to PIECE characters, so that work goes with the vocabulary; needles of several tokens are
    then looked for in the texts that have their token. Needles, and the tokens that hold some, are measured: while they are
    few, neither the vocabulary's pieces nor the texts' tokens are dealt by them. Marks, characters that are no letters or
    digits, become tokens only if a needle has nothing else, and only pieces as long as some needle's are made.
    """
    low = F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))
    n = needles.select(F.col(needle).alias("needle")).where("trim(needle) <> ''").distinct().withColumn("tokens", _tokens(F.col("needle")))
    # A mark is an anchor only where there is no letter or digit: the longest token, a word first.
    longest = F.array_max(F.transform("tokens", lambda x: F.struct(F.length(x).alias("n"), x.rlike("[a-z0-9]").alias("w"), x.alias("x"))))["x"]
    n = n.withColumn("anchor", longest).where("anchor is not null").withColumn("piece", F.left("anchor", F.lit(PIECE))).drop("tokens")
    n = measured(n)
    mark = F.when(~F.col("anchor").rlike("[a-z0-9]"), F.col("anchor"))
    has = n.agg(F.collect_set(mark).alias("marks"), F.collect_set(F.length("piece")).alias("sizes")).first()
    marks = F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in sorted(has.marks)]) if len(has.marks) <= MARKS else _marks(low)
    tokens = F.concat(_words(low), marks) if has.marks else _words(low)
    vocabulary = texts.select(F.explode_outer(tokens).alias("token")).distinct().withColumn("piece", F.explode_outer(_pieces(F.col("token"), has.sizes)))
    holds = vocabulary.join(n, "piece").where(F.contains("token", F.col("anchor"))).select("token", "needle", (F.col("anchor") == F.col("needle")).alias("whole")).distinct()
    holds = measured(holds)
    pairs = texts.select(key, F.explode_outer(F.array_distinct(tokens)).alias("token"))
    met = pairs.join(holds, "token").select(key, "needle", "whole").distinct().persist()  # few rows a text, read twice
    # The needles of a text come to it as one row.
    asked = met.where("not whole").groupBy(key).agg(F.collect_list("needle").alias("asked"))
    rest = texts.select(key, low.alias("low")).join(asked, key).select(key, F.explode_outer(F.filter("asked", lambda x: F.contains("low", x))).alias("needle")).where("needle is not null")
    return met.where("whole").select(key, "needle").unionByName(rest).distinct()
