"""Quality classifier by co-training of two views.

View 1, the text: shares of character classes, word statistics, repetition and
hashed word shares, from the whole text. View 2, the page's metadata: hashed
source and lang, and the recorded length. Each view has a logistic model whose
logit is calibrated on held-out labels. In each round both models score all
documents; for each class, the documents of which a view is surest, and whose
calibrated probability of that class is a half or more, become training rows of
the other view: with the class's label at the weight of that probability, and
with the other label at the rest. A view teaches by as much as its calibration
earns, and a class that it is never sure of not at all: `taught` has no rows of
it. At the end both views are calibrated and a
logistic model on the held-out labels combines them.

The features of all documents are one written table of a few numbers a row;
fits are distributed. Labels and the pseudo-labels of a round are bounded
samples of about `max_labels` and `max_pseudo` rows, taken by hash: the surest
documents come from a histogram of all scores, those in its last cell by hash.
Scoring covers all rows.

Cases: null or empty text has zero features and a score like any row; null
source or lang hash as ''; null n_chars counts as 0; labelled rows with
quality null are ignored; a doc_id labelled twice has its larger label; where
a labelled doc_id repeats, the row with the smallest hash of its columns is
trained on; with labels of one class only, or none, every document gets the
share of good labels (1 without labels); repeated doc_ids keep a row each; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import Scratch, row_key
from epilens.llm.textbytes import NOT_SPACE, blocks, byte_class, span_hash, words

MAX_LABELS = 50_000
MAX_PSEUDO = 50_000
ROUNDS = 2
META = 32
#: Cells of the hashed word shares.
WORD_CELLS = 128
#: Weight of a pseudo-label beside a label.
TRUST = 0.3
#: A histogram of calibrated logits has cells of this width, within -30 and 30.
CELL = 1 / 64
#: A document is rejected if its probability of good quality is below this.
THRESHOLD = 0.5

_UPPER = byte_class(bytes(range(0x41, 0x5B)))
_LOWER = byte_class(bytes(range(0x61, 0x7B)))
_DIGIT = byte_class(bytes(range(0x30, 0x3A)))
_HIGH = byte_class(bytes(range(0x80, 0x100)))
_STOP = byte_class(b".,;:?'\"()-")
_MARKS = {"!": byte_class(b"!"), "|": byte_class(b"|"), "#": byte_class(b"#$%&*@^~=<>{}[]\\/_+"), "\n": byte_class(b"\n")}
NAMES = ("log_words", "upper", "lower", "digit", "high", "stop", "bang", "bar", "symbol", "newline", "distinct", "repeat", "top", "word_length", "long_words", "odd_end")


def text_features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of NAMES and WORD_CELLS hashed word shares for each text."""
    n_rows = len(bounds) - 1
    sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask[raw], dtype=np.int64)))[bounds])
    starts, ends, at = words(raw, bounds, NOT_SPACE)
    h, lens = span_hash(raw, starts, ends), ends - starts
    n_words = np.diff(at)
    per_byte = np.maximum(1, np.diff(bounds))
    per_word = np.maximum(1, n_words)
    out = np.zeros((n_rows, len(NAMES) + WORD_CELLS))
    out[:, 0] = np.log1p(n_words)
    for k, mask in enumerate((_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, *_MARKS.values())):
        out[:, 1 + k] = sums(mask) / per_byte
    doc = np.repeat(np.arange(n_rows), n_words)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 11] = np.bincount(doc[same], minlength=n_rows) / per_word
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    where = np.flatnonzero(first)
    runs = np.diff(np.append(where, len(h)))
    owner = doc[order][where] if len(h) else doc
    distinct = np.bincount(owner, minlength=n_rows)
    # Expected share of new words falls with length; the root keeps texts of all lengths comparable.
    out[:, 10] = distinct / per_word**0.85
    top = np.zeros(n_rows)
    np.maximum.at(top, owner, runs)
    out[:, 12] = top / per_word
    out[:, 13] = np.bincount(doc, weights=lens, minlength=n_rows) / per_word / 10
    out[:, 14] = np.bincount(doc[lens > 20], minlength=n_rows) / per_word
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out[:, 15] = np.bincount(doc[np.isin(last, np.frombuffer(b"!|#$%&*", np.uint8))], minlength=n_rows) / per_word
    cell = doc * WORD_CELLS + (h >> np.uint64(40)).astype(np.int64) % WORD_CELLS
    shares = np.bincount(cell, minlength=n_rows * WORD_CELLS).reshape(n_rows, WORD_CELLS) / per_word[:, None]
    out[:, len(NAMES) :] = np.sqrt(shares)
    return out


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, raw, bounds in blocks(batches):
        x = text_features(raw, bounds).astype(np.float32)
        view = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), view], ["doc_id", "row_key", "meta_view", "text_view"])


def _meta(column: str, columns: set[str]) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in columns else F.lit("")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_view, meta_view (arrays) of every document."""
    have = set(docs.columns)
    length = F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)))) if "n_chars" in have else F.lit(0.0)
    cells = [F.pmod(F.xxhash64(F.lit(c), _meta(c, have)), F.lit(META)) for c in ("source", "lang")]
    meta = F.concat(F.array(length / 10, length * length / 100), F.transform(F.sequence(F.lit(0), F.lit(META - 1)), lambda i: sum((F.when(c == i, 1.0).otherwise(0.0) for c in cells), F.lit(0.0))))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key(docs).alias("row_key"), meta.cast("array<float>").alias("meta"))
    return rows.mapInArrow(_describe, "doc_id long, row_key long, meta_view array<float>, text_view array<float>")


def _fit(rows: DataFrame, column: str, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model of y."""
    data = rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"), F.col("y").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    model = LogisticRegression(regParam=l2, maxIter=60, weightCol="weight").fit(data)
    return model.coefficients.toArray(), float(model.intercept)


def newton(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model on a few standardised columns: mean loss plus l2 / 2 times the squared weights."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], l2), 0.0)
    loss = lambda w: np.logaddexp(0, z @ w).mean() - (y * (z @ w)).mean() + 0.5 * penalty @ w**2
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) / len(y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ middle)


VIEWS = ("text_view", "meta_view")
#: Penalty of each view's weights: most of the text view's are hashed words, of which few labels say little.
PENALTY = {"text_view": 1e-2, "meta_view": 1e-3}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _scored(table: DataFrame, models: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """table with the logit of each view's model, as text_logit and meta_logit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                logits = [_matrix(batch.column(batch.schema.get_field_index(v))) @ models[v][0] + models[v][1] for v in VIEWS]
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.float64)) for x in logits)], [*batch.schema.names, "text_logit", "meta_logit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(run, f"{schema}, text_logit double, meta_logit double")


def _sure(scores: DataFrame, pool: DataFrame, logit: str, share: float, take: int) -> DataFrame:
    """The rows of pool of which the view is surest, as training rows: y, weight; none of a class that no row is likelier to have.

    scores has the calibrated logits of all of pool. For each class the cut lies in
    a cell of a histogram; of that cell's rows a share is taken by hash.
    """
    cells = {r["cell"]: r["n"] for r in scores.groupBy(F.floor(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(logit))) / CELL).alias("cell")).agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    place = F.pmod(F.xxhash64("row_key"), F.lit(1 << 30))
    cell = F.floor(F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col(logit))) / CELL)
    for down, wanted in ((True, max(1, round(take * share))), (False, max(1, round(take * (1 - share))))):
        left, confident = wanted, cell >= 0 if down else cell < 0
        for c in sorted((c for c in cells if (c >= 0) == down), reverse=down):
            if cells[c] >= left:
                beyond = cell > c if down else cell < c
                confident = beyond | ((cell == c) & (place <= F.lit(int((1 << 30) * left / cells[c]))))
                break
            left -= cells[c]
        chosen = chosen | confident
    p = 1 / (1 + F.exp(-F.col(logit)))
    both = pool.where(chosen).withColumn("lesson", F.array(F.struct(F.lit(1).alias("y"), (TRUST * p).alias("weight")), F.struct(F.lit(0).alias("y"), (TRUST * (1 - p)).alias("weight"))))
    return both.select("doc_id", *VIEWS, F.explode("lesson").alias("lesson")).select("doc_id", *VIEWS, "lesson.*")


class CoTraining:
    """The models after all rounds. `taught` lists (round, teacher, pupil, good, bad): rows that a view gave the other."""

    def __init__(self, scratch: Scratch, table: DataFrame, labels: DataFrame, rounds: int, max_labels: int, max_pseudo: int):
        self.taught: list[tuple[int, str, str, int, int]] = []
        self.prior: float | None = None
        rated = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
        n_known = rated.count()
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        bounded = scratch.table(rated.where(place < F.lit(int((1 << 30) * min(1.0, max_labels / max(1, n_known))) + 1)), "known")
        rows = table.join(F.broadcast(bounded), "doc_id")
        rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", *VIEWS), "row_key").alias("r")).select("doc_id", "r.*")
        rows = scratch.table(rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).withColumn("weight", F.lit(1.0)), "labelled")
        share = rows.agg(F.avg("y"), F.avg(F.when(F.col("held"), F.col("y"))), F.avg(F.when(~F.col("held"), F.col("y")))).first()
        if not all(s is not None and 0 < s < 1 for s in share):
            self.prior = 1.0 if share[0] is None else float(share[0])
            return
        good, seed, held = float(share[2]), rows.where("not held").drop("held"), rows.where("held").drop("held")
        # About a quarter of max_labels rows: calibration is a matter of the driver.
        pdf = held.orderBy("doc_id").toPandas()
        known = {v: np.array(pdf[v].tolist(), np.float64) for v in VIEWS} | {"y": pdf["y"].to_numpy(np.float64)}
        lessons: dict[str, DataFrame] = {}
        self.models: dict[str, tuple[np.ndarray, float]] = {}
        unlabelled = table.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_anti")
        n_pool = unlabelled.count()
        for r in range(rounds + 1):
            for view in VIEWS:
                self.models[view] = self._calibrated(seed.unionByName(lessons[view].select(seed.columns)) if view in lessons else seed, known, view)
            if r == rounds or not n_pool:
                break
            take = min(max_pseudo, max(20, n_pool // 20)) * (r + 1) // rounds
            pool = _scored(unlabelled, self.models)
            scores = scratch.table(pool.select("row_key", "text_logit", "meta_logit"), "scores")
            for teacher, pupil in (VIEWS, VIEWS[::-1]):
                lessons[pupil] = scratch.table(_sure(scores, pool, teacher.replace("view", "logit"), good, take), "lessons")
                given = lessons[pupil].groupBy("doc_id").agg((F.sum(F.when(F.col("y") == 1, F.col("weight")).otherwise(-F.col("weight"))) > 0).alias("g")).agg(F.count_if("g"), F.count_if(~F.col("g"))).first()
                self.taught.append((r, teacher, pupil, given[0], given[1]))
        self.both = newton(np.column_stack([known[v] @ self.models[v][0] + self.models[v][1] for v in VIEWS]), known["y"])

    @staticmethod
    def _calibrated(rows: DataFrame, held: dict[str, np.ndarray], view: str) -> tuple[np.ndarray, float]:
        """A model whose logit is that of the fit on rows, calibrated on the held-out labels."""
        weights, intercept = _fit(rows, view, PENALTY[view])
        slope, start = newton((held[view] @ weights + intercept)[:, None], held["y"])
        return weights * slope[0], start + intercept * slope[0]

    def score(self, table: DataFrame, threshold: float) -> DataFrame:
        if self.prior is not None:
            prior = F.lit(self.prior)
            return table.select("doc_id", prior.alias("score"), prior.alias("text_score"), prior.alias("meta_score"), (prior >= threshold).alias("kept"), "row_key")
        p = lambda x: 1 / (1 + F.exp(-x))
        (w_text, w_meta), start = self.both
        total = F.lit(start) + F.lit(float(w_text)) * F.col("text_logit") + F.lit(float(w_meta)) * F.col("meta_logit")
        scored = _scored(table, self.models)
        return scored.select("doc_id", p(total).alias("score"), p(F.col("text_logit")).alias("text_score"), p(F.col("meta_logit")).alias("meta_score"), (p(total) >= threshold).alias("kept"), "row_key")


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labels: int = MAX_LABELS, max_pseudo: int = MAX_PSEUDO, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (probability of good quality), text_score, meta_score, kept, row_key of every row."""
    scratch = Scratch(spark)
    table = scratch.table(features(docs), "features")
    return CoTraining(scratch, table, labels, rounds, max_labels, max_pseudo).score(table, threshold)
