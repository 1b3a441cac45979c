"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(threshold_k - w.x): all thresholds share the weights w, so the expected severity,
the sum of k P(grade = k), rises with w.x. x says which words a text has. The features are chosen by
distributed counts over the labelled texts; the weights are fitted with an L1 penalty, which leaves those
of few words other than 0; these are broadcast and every whole text is scored in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, free_names, materialise, span_hashes, text_parts

#: The model is fitted on at most so many labelled documents, those with the least hashes of their ids.
MOST_TRAINING = 20_000
#: Words of so many training documents at least, and of these the most telling ones, are features.
LEAST_DOCUMENTS, MOST_FEATURES = 5, 4096
PENALTY, STEPS = 4e-4, 400
#: Parts of the training documents, each of which is scored by a model of the others to choose the cutoff.
FOLDS = 4
#: Grades above 0 that are derived from labels which only say toxic or not.
LEVELS = 3
_PART = 2 << 20
#: Lengths in bytes of the beginnings of longer words that are features too, and numbers that tell them from words.
STEMS = ((4, 0x5BD1E995), (6, 0x1B873593), (8, 0xCC9E2D51))
#: Letters: of ASCII, and all bytes of other characters.
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of letters, A-Z lowered, and of their beginnings, and the row of each."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    other = ~_IS_LETTER[raw]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, other[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(edge & ~other)
    edge[-1], edge[:-1] = True, other[1:]
    edge[offs[1:][offs[1:] > 0] - 1] = True
    ends = np.flatnonzero(edge & ~other) + 1
    row = np.searchsorted(offs, starts, "right") - 1
    every, rows = [span_hashes(raw, starts, ends, FOLDED)], [row]
    for n, salt in STEMS:
        long = ends - starts > n
        every.append(span_hashes(raw, starts[long], starts[long] + n, FOLDED) ^ np.uint64(salt))
        rows.append(row[long])
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return np.concatenate(every)[order], rows[order]


@dataclass
class Model:
    """Hashes of the features in order, their weights, the thresholds between the grades, and the
    probability of a grade above 0 from which on a text is called toxic."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = 0.5

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """w.x of each row."""
        out = np.zeros(len(offs) - 1)
        if not len(self.features):
            return out
        h, row = tokens(raw, offs)
        at = np.searchsorted(self.features, h)
        at[at == len(self.features)] = 0
        hit = self.features[at] == h
        seen = np.unique(row[hit] * len(self.features) + at[hit])
        np.add.at(out, seen // len(self.features), self.weights[seen % len(self.features)])
        return out

    def probabilities(self, s: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score and grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - s[:, None], -500, 500)))
        edges = np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], axis=1)
        return np.diff(edges, axis=1)


def _solve(i: np.ndarray, j: np.ndarray, n: int, d: int, grades: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient steps. Document i has feature j; there are n
    documents with grades of 0 to k, and d features."""

    def times(w):
        return np.bincount(i, weights=w[j], minlength=n)

    def back(v):
        return np.bincount(j, weights=v[i], minlength=d)

    v, norm = np.random.default_rng(3).random(d), 1.0
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v /= norm
    step = n / (0.5 * max(norm, n) + 1e-9)
    shares = np.cumsum(np.bincount(grades, minlength=k + 1))[:-1] / n
    shares = np.clip(shares, 1e-3, 1 - 1e-3)
    theta = np.log(shares / (1 - shares))
    w = np.zeros(d)
    look_w, look_t, momentum = w, theta, 1.0
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(STEPS):
        s = times(look_w)
        edges = np.concatenate([[-np.inf], look_t, [np.inf]])
        hi, lo = sig(edges[grades + 1] - s), sig(edges[grades] - s)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi), lo * (1 - lo)
        grad_w = back((dh - dl) / p) / n
        grad_t = np.array([-(dh[grades == c] / p[grades == c]).sum() + (dl[grades == c + 1] / p[grades == c + 1]).sum() for c in range(k)]) / n
        new_w = look_w - step * grad_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
        new_t = np.maximum.accumulate(look_t - min(step, 1.0) * grad_t + 1e-6 * np.arange(k))
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look_w, look_t = new_w + (momentum - 1) / after * (new_w - w), np.maximum.accumulate(new_t + (momentum - 1) / after * (new_t - theta) + 1e-9 * np.arange(k))
        w, theta, momentum = new_w, new_t, after
    return w, theta


def fit(places: list[np.ndarray], grades: np.ndarray, features: np.ndarray) -> Model:
    """Fit on the places in `features` (hashes in order) that each document has, and its grade (0 and up).

    The cutoff comes from scores of held-out documents: each of FOLDS parts is scored by a model of the
    others."""
    k, n, d = int(grades.max(initial=0)), len(places), len(features)
    if n == 0 or k == 0 or (grades == 0).sum() == 0:
        # one grade only, so nothing to tell apart: no text is called toxic
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(max(k, 1), 30.0))
    i = np.repeat(np.arange(n), [len(x) for x in places])
    j = np.concatenate(places).astype(np.int64)
    w, theta = _solve(i, j, n, d, grades, k)
    model = Model(features[w != 0], w[w != 0], theta)
    held = np.full(n, np.nan)
    fold = np.arange(n) % FOLDS
    for f in range(FOLDS):
        own, others = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        known = grades[others]
        if known.min(initial=k) > 0 or known.max(initial=0) == 0 or not len(own):
            continue
        at = np.zeros(n, np.int64)
        at[others] = np.arange(len(others))
        use = fold[i] != f
        fw, ft = _solve(at[i[use]], j[use], len(others), d, known, k)
        held[own] = 1 - Model(features, fw, ft).probabilities(np.bincount(i, weights=fw[j], minlength=n)[own])[:, 0]
    seen = ~np.isnan(held)
    if seen.any() and 0 < (grades[seen] > 0).sum() < seen.sum():
        model.cutoff = _cutoff(held[seen], grades[seen] > 0)
    return model


def _cutoff(p: np.ndarray, toxic: np.ndarray) -> float:
    """The cutoff with the fewest errors on held-out documents, in the widest gap if several have as
    few, and a third of its way up in log odds: the clean documents are many, so where they end is known
    better than where the toxic ones begin. The penalty pulls probabilities towards the common grade, so
    the cutoff is below a half; it isn't above."""
    order = np.argsort(p)
    odds = np.clip(p[order], 1e-6, 1 - 1e-6)
    q, bad = np.log(odds / (1 - odds)), toxic[order]
    missed = np.append(0, np.cumsum(bad))  # toxic ones below a cutoff at each place
    false = np.append(np.cumsum(~bad[::-1])[::-1], 0)
    wrong = (missed + false)[1:-1]  # places between two documents
    best = np.flatnonzero(wrong == wrong.min())
    at = best[np.argmax(q[best + 1] - q[best])]
    return float(min(0.5, 1 / (1 + np.exp(-(q[at] + (q[at + 1] - q[at]) / 3)))))


def _hashes(batches):
    """The distinct word hashes of each text."""
    for batch in batches:
        for at, n, raw, offs in text_parts(batch.column(2), _PART):
            h, row = tokens(raw, offs)
            bounds = np.searchsorted(row, np.arange(n + 1))
            own = [np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(own, pa.binary())], ["doc_id", "grade", "hashes"])


def _feature_counts(batches):
    """How many texts of a batch have each hash, and how many of these have a grade above 0."""
    for batch in batches:
        every = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8")
        bad = np.frombuffer(b"".join(x for x, g in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()) if g > 0), "<u8")
        hashes, n = np.unique(every, return_counts=True)
        of = np.zeros(len(hashes), np.int64)
        own, m = np.unique(bad, return_counts=True)
        of[np.searchsorted(hashes, own)] = m
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n), pa.array(of)], ["h", "n", "bad"])


def telling(rows: DataFrame, n: int, bad: int) -> np.ndarray:
    """The hashes, in order, of the features that tell grade 0 from the others best: at most MOST_FEATURES.
    rows has doc_id, grade and hashes of n texts, bad of them with a grade above 0."""
    counts = rows.mapInArrow(_feature_counts, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share = bad / n
    tell = F.abs(F.col("bad") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = counts.where(F.col("n") >= min(LEAST_DOCUMENTS, max(1, n // 20))).withColumn("tell", tell).where("tell > 1").orderBy(F.col("tell").desc(), "h").limit(MOST_FEATURES)
    return np.sort(np.array([x["h"] for x in best.select("h").collect()], np.int64).view(np.uint64))


def _places(features: np.ndarray):
    """The places in features of the hashes that a text has."""

    def run(batches):
        for batch in batches:
            held = []
            for x in batch.column(2).to_pylist():
                own = np.frombuffer(x, "<u8")
                at = np.minimum(np.searchsorted(features, own), max(0, len(features) - 1))
                held.append(at[features[at] == own].astype("<u2").tobytes() if len(features) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.binary())], ["doc_id", "grade", "places"])

    return run


def derived_grades(places: list[np.ndarray], toxic: np.ndarray, d: int, levels: int = LEVELS) -> np.ndarray:
    """Grades from labels that only say toxic or not: 0 is not toxic; toxic documents are ranked by how
    many telling words a first model finds in them, and equal shares get the grades 1 to levels."""
    if not len(places) or not 0 < (toxic > 0).sum() < len(toxic):
        return np.where(toxic > 0, 1, 0)
    i, j = np.repeat(np.arange(len(places)), [len(x) for x in places]), np.concatenate(places).astype(np.int64)
    w, _ = _solve(i, j, len(places), d, toxic, 1)
    hits = np.bincount(i, weights=w[j] > 0, minlength=len(places))
    edges = np.quantile(hits[toxic > 0], np.arange(1, levels) / levels)
    return np.where(toxic > 0, 1 + np.searchsorted(edges, hits, "left"), 0)


def _fit(value: str, levels: int, features: np.ndarray):
    """Fit on all batches of (doc_id, grade, places) of one task; yields the model as one row."""

    def run(batches):
        places, grades = [], []
        for batch in batches:
            grades += batch.column(1).to_pylist()
            places += [np.frombuffer(x, "<u2") for x in batch.column(2).to_pylist()]
        known = np.array(grades, np.int64)
        m = fit(places, known if value == "grade" else derived_grades(places, (known > 0).astype(np.int64), len(features), levels), features)
        yield pa.RecordBatch.from_pydict({"features": pa.array([m.features.astype("<u8").tobytes()], pa.binary()), "weights": [m.weights.tolist()], "thresholds": [m.thresholds.tolist()], "cutoff": [float(m.cutoff)]})

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, levels: int = LEVELS) -> Model:
    """Fit on documents and labels: (doc_id, grade) with grades of 0 and up, or (doc_id, toxic) with 0
    and 1, from which grades are derived (see derived_grades).

    At most `most` labels of documents in docs, those with the least hashes of their ids, are used. Their
    texts, of any length, are counted where they lie; the one task that fits is given a document's places
    among at most MOST_FEATURES features, so it has a fixed bound, as has the model that comes to the
    driver. Labels without an id or a value are left out; of several labels of one document the highest
    counts, and of several rows one. Without labels of two kinds the model tells nothing apart."""
    value = "grade" if "grade" in labels.columns else "toxic"
    held = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(value).cast("int").alias("grade"))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = held.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers are broadcast
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = ids.select("doc_id", "grade", "text").mapInArrow(_hashes, "doc_id long, grade int, hashes binary")
    rows = materialise(rows.groupBy("doc_id", "grade").agg(F.min("hashes").alias("hashes")), "hashes")
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.col("grade") > 0)).first()
    if not 0 < bad < n:
        return fit([], np.zeros(0, np.int64), np.zeros(0, np.uint64))
    features = telling(rows, n, bad)
    seen = rows.mapInArrow(_places(features), "doc_id long, grade int, places binary").repartition(1).sortWithinPartitions("doc_id")
    m = seen.mapInArrow(_fit(value, levels, features), "features binary, weights array<double>, thresholds array<double>, cutoff double").first()
    return Model(np.frombuffer(bytes(m["features"]), "<u8"), np.array(m["weights"], np.float64), np.array(m["thresholds"], np.float64), m["cutoff"])


def _scored(text: Column, model) -> Column:
    """A struct (grade, severity, p_toxic, toxic) of a text. Only the texts go to the Python workers."""

    @F.arrow_udf("grade int, severity double, p_toxic double, toxic boolean")
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for texts in column:
            parts = []
            for _, _, raw, offs in text_parts(texts, _PART):
                p = m.probabilities(m.scores(raw, offs))
                high = 1 - p[:, 0]
                toxic = high >= m.cutoff
                likely = np.where(toxic, 1 + p[:, 1:].argmax(axis=1), 0).astype(np.int32)
                parts.append(pa.StructArray.from_arrays([pa.array(likely), pa.array(p @ np.arange(p.shape[1])), pa.array(high), pa.array(toxic)], ["grade", "severity", "p_toxic", "toxic"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], _SCORED)

    return run(text)


_SCORED = pa.struct([("grade", pa.int32()), ("severity", pa.float64()), ("p_toxic", pa.float64()), ("toxic", pa.bool_())])


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, grade, severity (expected grade), p_toxic (probability of a grade above 0) and toxic (p_toxic
    at least the model's cutoff) of every row. grade is 0 where toxic is false, else the likeliest grade
    above 0.

    Null and empty texts have no words and are scored by the thresholds alone. Null and repeated ids
    are scored as others are; texts of any length are scored whole. Other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", _scored(F.col("text"), held).alias("r"))
    return out.select("doc_id", "r.grade", "r.severity", "r.p_toxic", "r.toxic")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns under whatever names, that a model of docs and labels doesn't call
    toxic. Rows with null or empty texts stay, as do rows without an id."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    (name,) = free_names(docs.columns, "toxicity")
    found = docs.withColumn(name, _scored(F.col("text"), held))
    return found.where(~F.col(f"{name}.toxic")).select(*[F.col(f"`{c}`") for c in docs.columns])
