"""Toxicity by a counterfactual-regularised logistic model on words and word starts.

A document is the set of its words (lower-cased) and of the first 5 to 9 bytes
of longer words, as 64-bit hashes. Features are chosen from the training rows
by the strength of their link with the label (`strength` standard deviations,
in `support` rows at least); identity terms are features too.

Counterfactuals: in each training text that names an identity term, the term
is swapped, in the text, for each other term of its set, and the features are
taken anew. The label is the same, so the model pays `fairness` times the
squared change of its logit. A corpus may name no group where its labels are;
therefore every term is also put into labelled neutral texts: with the term or
without it, or with another of its set, their score is to stay as it is. So
mentions of a group by themselves hardly move a score. `flips` measures it.

The fit uses about `max_rows` labelled rows at most, taken by hash, of those
whose crc32(doc_id as text) mod 4 is not 2; every document is scored from its
whole text. Labels, lang, source and doc_id are no inputs of a score. Terms are
a parameter; the default has those of the corpus's four languages.

Cases: null or empty text gets the score of no features; labelled rows with
toxic null are ignored; a doc_id labelled twice has its larger label; where a
labelled doc_id repeats, the row with the smallest hash of its columns is
trained on; without labels of both classes every score is the share of toxic
labels (0 without labels); repeated doc_ids keep a row each; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import Scratch, keep_ids, row_key
from epilens.llm.textbytes import ALNUM, LOWER, blocks, span_hash, words

MAX_ROWS = 40_000
STARTS = (5, 6, 7, 8, 9)
THRESHOLD = 0.3
#: Identity terms, each set being interchangeable in a sentence: English, French, German, Spanish. Fixed values.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrant", "citizen", "refugee"), ("old", "young", "disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"), ("noir", "blanc", "asiatique", "africain", "européen"), ("immigré", "citoyen", "réfugié"),
    ("frauen", "männer"), ("frau", "mann"), ("christ", "moslem", "jude", "hinduist", "atheistin"), ("schwarz", "weiß", "asiatisch", "afrikanisch", "europäisch"), ("einwanderer", "bürger", "flüchtling"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristiano", "musulmán", "judío", "budista", "ateo"), ("negro", "blanco", "asiático", "europeo"), ("inmigrante", "ciudadano", "refugiado"),
)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def hash_words(terms: list[str]) -> np.ndarray:
    data = [t.encode() for t in terms]
    ends = np.cumsum([len(d) for d in data])
    return span_hash(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], ends[:-1])), ends)


def document_features(raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature hashes of each text."""
    n_rows = len(bounds) - 1
    low = LOWER[raw]
    starts, ends, at = words(low, bounds, ALNUM)
    doc = np.repeat(np.arange(n_rows), np.diff(at))
    hashes, owners = [span_hash(low, starts, ends)], [doc]
    for n in STARTS:
        long = ends - starts > n
        # A start differs from a whole word of the same bytes.
        hashes.append(span_hash(low, starts[long], starts[long] + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        owners.append(doc[long])
    h, d = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    cuts = np.searchsorted(d, np.arange(n_rows + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield h[a:b]


def features_of(text: str) -> np.ndarray:
    data = text.encode()
    return next(document_features(np.frombuffer(data, np.uint8), np.array([0, len(data)])))


def swaps(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> list[str]:
    """The text once for each other term of the set of each identity term that it names, swapped wherever it stands."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    out = []
    for same in terms:
        for named in same:
            whole = re.compile(rf"(?<![0-9a-z\x80-\U0010ffff]){re.escape(named)}(?![0-9a-z\x80-\U0010ffff])")
            if named in low and whole.search(low):
                out += [whole.sub(other, low) for other in same if other != named]
    return out


def _sets(terms: tuple[tuple[str, ...], ...]):
    """Feature sets of training rows, and those of their counterfactuals."""
    named = np.unique(hash_words([t for same in terms for t in same]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, bounds in blocks(batches):
            own = list(document_features(raw, bounds))
            other = [[features_of(x).tobytes() for x in swaps(raw[a:b].tobytes().decode("utf-8", "replace"), terms)] if np.isin(named, h).any() else [] for h, a, b in zip(own, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h.tobytes() for h in own], pa.binary()), pa.array(other, pa.list_(pa.binary()))], ["doc_id", "row_key", "hashes", "others"])

    return run


def _explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, label) counts of a task's rows."""
    for batch in batches:
        label = np.array(batch.column(1).to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]
        h, y = np.concatenate(sets), np.repeat(label, [len(s) for s in sets])
        keys, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n), pa.array(np.bincount(inverse, weights=y, minlength=len(keys)).astype(np.int64))], ["feature", "n", "bad"])


class Model:
    """Sorted feature hashes, their weights, and the intercept."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(features)
        self.features, self.weights, self.intercept = features[order], weights[order], intercept

    def places(self, h: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        return at[self.features[at] == h]

    def score(self, h: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[self.places(h)].sum(), -40, 40))))


def changes(blank: Model, rows: list[np.ndarray], others: list[list[np.ndarray]], labels: np.ndarray, terms: tuple[tuple[str, ...], ...] = IDENTITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Feature changes of all counterfactuals as a sparse matrix: rows, columns, values and the number of rows.

    A counterfactual of a text that names a term is the features it gains and loses. Putting a term into a neutral text
    changes the same features in all of them, so one row stands for all, weighed by the root of their number.
    """
    row: list[np.ndarray] = []
    col: list[np.ndarray] = []
    val: list[np.ndarray] = []
    n = 0

    def add(gained: np.ndarray, lost: np.ndarray, weight: float) -> None:
        nonlocal n
        a, b = blank.places(np.setdiff1d(gained, lost)), blank.places(np.setdiff1d(lost, gained))
        row.append(np.full(len(a) + len(b), n))
        col.append(np.concatenate([a, b]))
        val.append(np.concatenate([np.full(len(a), weight), np.full(len(b), -weight)]))
        n += 1

    for own, variants in zip(rows, others, strict=True):
        for other in variants:
            add(other, own, 1.0)
    neutral = float(np.sqrt((labels == 0).sum()))
    for same in terms:
        sets = [features_of(t) for t in same]
        for i, h in enumerate(sets):
            add(h, np.zeros(0, np.uint64), neutral)
            for k in range(i):
                add(h, sets[k], neutral)
    return np.concatenate(row), np.concatenate(col), np.concatenate(val), n


class Objective:
    """Penalised logistic loss over a sparse 0/1 matrix and the counterfactual changes; the last weight is the intercept."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, labels: np.ndarray, k: int, delta: tuple, fairness: float, l2: float):
        self.doc, self.col, self.labels, self.k, self.fairness, self.l2 = doc, col, labels, k, fairness, l2
        self.d_row, self.d_col, self.d_val, self.n_delta = delta

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        n, k = len(self.labels), self.k
        z = np.bincount(self.doc, weights=x[self.col], minlength=n) + x[k]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        change = np.bincount(self.d_row, weights=self.d_val * x[self.d_col], minlength=self.n_delta)
        loss = -np.sum(self.labels * np.log(p + 1e-12) + (1 - self.labels) * np.log(1 - p + 1e-12)) + 0.5 * self.l2 * np.sum(x[:k] ** 2) + 0.5 * self.fairness * np.sum(change**2)
        g = np.zeros(k + 1)
        r = p - self.labels
        g[:k] = np.bincount(self.col, weights=r[self.doc], minlength=k) + self.l2 * x[:k] + self.fairness * np.bincount(self.d_col, weights=self.d_val * change[self.d_row], minlength=k)
        g[k] = r.sum()
        return float(loss), g


def fit(rows: list[np.ndarray], labels: np.ndarray, features: np.ndarray, others: list[list[np.ndarray]] | None = None, terms: tuple[tuple[str, ...], ...] = IDENTITY, fairness: float = 1.0, l2: float = 2.0, steps: int = 500) -> Model:
    """Penalised logistic regression by accelerated gradient steps, each coordinate scaled by its curvature."""
    blank = Model(features, np.zeros(len(features)), 0.0)
    places = [blank.places(h) for h in rows]
    doc = np.repeat(np.arange(len(rows)), [len(p) for p in places])
    col = np.concatenate(places) if places else np.zeros(0, np.int64)
    k = len(features)
    delta = changes(blank, rows, others or [[] for _ in rows], labels, terms)
    objective = Objective(doc, col, labels, k, delta, fairness, l2)
    # Curvature of each weight at most; steps are taken in units of its root.
    curve = 0.25 * np.bincount(col, minlength=k) + l2 + fairness * np.bincount(delta[1], weights=delta[2] ** 2, minlength=k)
    scale = 1 / np.sqrt(np.append(curve, 0.25 * len(labels) + 1e-9))
    w = np.zeros(k + 1)
    w[k] = np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
    u, v, t, step = w / scale, w / scale, 1.0, 1.0
    now, _ = objective(w)
    for _ in range(steps):
        loss_v, g = objective(v * scale)
        g = g * scale
        while True:  # backtracking
            new = v - step * g
            loss_new, _ = objective(new * scale)
            if loss_new <= loss_v - 0.5 * step * g @ g + 1e-9 or step < 1e-9:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - u) if loss_new <= now else new.copy()
        t = t_new if loss_new <= now else 1.0
        done = abs(now - loss_new) < 1e-7 * max(1.0, abs(now))
        u, now, step = new, loss_new, step * 1.3
        if done:
            break
    w = u * scale
    return Model(blank.features, w[:k], float(w[k]))


def flips(model: Model, texts: list[str], terms: tuple[tuple[str, ...], ...] = IDENTITY, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Over the counterfactuals of texts: the share whose prediction differs, and the mean change of the score."""
    pairs = [(model.score(features_of(t)), model.score(features_of(x))) for t in texts for x in swaps(t, terms)]
    if not pairs:
        return 0.0, 0.0
    return sum((a >= threshold) != (b >= threshold) for a, b in pairs) / len(pairs), sum(abs(a - b) for a, b in pairs) / len(pairs)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, strength: float = 5.0, support: int = 3, terms: tuple[tuple[str, ...], ...] = IDENTITY, fairness: float = 1.0) -> Model:
    """Chooses features by distributed counts over the bounded sample, then fits on those features alone."""
    scratch = Scratch(spark)
    known = labels.where("toxic in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rate = min(1.0, max_rows / max(1, known.count()))
    sample = scratch.table(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * rate) + 1)), "sample")
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("row_key"))
    sets = keep_ids(source, sample.select("doc_id"), "doc_id").select("doc_id", "text", "row_key").mapInArrow(_sets(terms), "doc_id long, row_key long, hashes binary, others array<binary>")
    sets = sets.groupBy("doc_id").agg(F.min_by(F.struct("hashes", "others"), "row_key").alias("r")).select("doc_id", "r.*")
    rows = scratch.table(sets.join(sample, "doc_id"), "rows")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    if not 0 < bad < n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if n and bad else -40.0)
    counts = rows.select("hashes", "toxic").mapInArrow(_explode, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    p = bad / n
    z = (F.col("bad") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    # At most as many as the bounded sample has.
    best = counts.where((F.col("n") >= support) & (z >= strength)).select("feature").toPandas()
    identity = np.unique(np.concatenate([features_of(t) for same in terms for t in same]))
    chosen = np.unique(np.concatenate([best["feature"].to_numpy(np.int64).astype(np.uint64), identity]))
    model = Model(chosen, np.zeros(len(chosen)), 0.0)

    def narrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = lambda x: model.features[model.places(np.frombuffer(x, np.uint64))].tobytes()
        for batch in batches:
            own = [keep(x.as_buffer()) for x in batch.column(0)]
            others = [[keep(y) for y in x.as_py()] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(others, pa.list_(pa.binary())), batch.column(2)], ["hashes", "others", "toxic"])

    pdf = rows.orderBy("doc_id").select("hashes", "others", F.col("toxic").cast("long")).mapInArrow(narrow, "hashes binary, others array<binary>, toxic long").toPandas()
    read = lambda x: np.frombuffer(x, np.uint64)
    return fit([read(h) for h in pdf["hashes"]], pdf["toxic"].to_numpy(np.float64), chosen, [[read(y) for y in x] for x in pdf["others"]], terms, fairness)


def _score(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, raw, bounds in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(h) for h in document_features(raw, bounds)], pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = source.mapInArrow(_score(spark.sparkContext.broadcast(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
