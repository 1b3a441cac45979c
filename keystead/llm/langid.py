"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all training texts are taken on the executors and added up in blocks of features. They come to
the driver as a matrix of log-probabilities for at most LANGUAGES languages at a time, which is broadcast;
batches of texts are scored in numpy. More languages are scored one matrix after the other, carrying the
best language so far and the sum of all likelihoods.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_sums, text_parts

#: Size of the hashed feature space, and of the blocks in which counts are added up.
N_FEATURES, BLOCK = 1 << 16, 1 << 12
#: Languages of one matrix (N_FEATURES x LANGUAGES 4-byte numbers are broadcast), and those that a task
#: counts before it hands its counts on.
LANGUAGES, HELD = 128, 32
SMOOTHING = 0.5
_PART = 2 << 20
_chars: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point its lower-case form, or 32 for what isn't a letter."""
    if not _chars:
        out = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _chars.append(out)
    return _chars[0]


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 3-grams of the texts' letters, runs of other characters as one blank, two blanks ahead.

    Returns the features of all rows one after the other, the bounds of the rows, and whether a row
    has a letter."""
    code = _folding()[np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(lead[offs]))
    letter = code != 32
    has = np.bincount(row[letter], minlength=len(offs) - 1) > 0
    # a blank stays only where it ends a run of letters of its row; two are set ahead of each row
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])
    code, row = code[keep], row[keep]
    n = len(code)
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), has
    first = np.empty(n, bool)
    first[0], first[1:] = True, row[1:] != row[:-1]
    before = np.empty(n, np.uint32)
    before[0], before[1:] = 32, code[:-1]
    before[first] = 32
    before2 = np.empty(n, np.uint32)
    before2[0], before2[1:] = 32, before[:-1]
    before2[first] = 32
    out = code * np.uint32(0x9E3779B1)
    out += before * np.uint32(0x85EBCA77)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out += before2 * np.uint32(0xC2B2AE3D)
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x7FEB352D)
    out ^= out >> np.uint32(15)
    out &= np.uint32(N_FEATURES - 1)
    return out.astype(np.int64), np.searchsorted(row, np.arange(len(offs))), has


def _count(batches):
    """Counts of each language in this task, a row for each block of features. A task with many languages
    hands its counts on in several batches."""
    held: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def flush():
        names, blocks, counts, seen = [], [], [], []
        for name, sums in held.items():
            for b in range(N_FEATURES // BLOCK):
                names.append(name)
                blocks.append(b)
                counts.append(sums[b * BLOCK : (b + 1) * BLOCK].astype("<i8").tobytes())
                seen.append(texts[name])
        held.clear()
        texts.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary()), pa.array(seen, pa.int64())], ["lang", "block", "counts", "texts"])

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for at, n, raw, offs in text_parts(batch.column(0), _PART):
            feats, bounds, has = features(raw, offs)
            names, of = np.unique(langs[at : at + n].astype(str), return_inverse=True)
            lang_of = np.repeat(of, np.diff(bounds))
            for k, name in enumerate(names):
                held[name] = held.get(name, 0) + np.bincount(feats[lang_of == k], minlength=N_FEATURES)
                texts[name] = texts.get(name, 0) + int((has & (of == k)).sum())
                if len(held) >= HELD:
                    yield flush()
    yield flush()


def _add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The sum of one block's counts over the tasks."""
    total = np.zeros(BLOCK, np.int64)
    for x in rows.column("counts"):
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary()), "texts": pa.array([sum(rows.column("texts").to_pylist())], pa.int64())})


@dataclass
class Model:
    """The sums of the counts as a table (lang, block, counts, texts), the number of languages, and the
    texts of all."""

    sums: DataFrame
    languages: int
    texts: int

    def matrices(self):
        """For LANGUAGES languages after the other, in order of code points: their names and a matrix with
        the log-probability of each feature, and the log prior in the last row."""
        last = None
        for _ in range(0, self.languages, LANGUAGES):
            rows = self.sums if last is None else self.sums.where(F.col("lang") > last)
            names = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").limit(LANGUAGES).collect()]
            last = names[-1]
            counts, texts = {n: np.zeros(N_FEATURES) for n in names}, {}
            for x in rows.where(F.col("lang") <= last).collect():
                counts[x["lang"]][x["block"] * BLOCK : (x["block"] + 1) * BLOCK] = np.frombuffer(bytes(x["counts"]), "<i8")
                texts[x["lang"]] = x["texts"]
            out = np.zeros((N_FEATURES + 1, len(names)), np.float32)
            for k, name in enumerate(names):
                out[:-1, k] = np.log(counts[name] + SMOOTHING) - np.log(counts[name].sum() + SMOOTHING * N_FEATURES)
                out[-1, k] = np.log(texts[name] / self.texts)
            yield names, out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from all rows that have a language and a letter."""
    schema = "lang string, block int, counts binary, texts long"
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sums = materialise(rows.mapInArrow(_count, schema).groupBy("lang", "block").applyInArrow(_add, schema).where("texts > 0"), "counts")
    n, texts = sums.where("block = 0").agg(F.count(F.lit(1)), F.sum("texts")).first()
    return Model(sums, n, texts or 0)


def score(raw: np.ndarray, offs: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a part: the place of its best language, that one's tempered log-likelihood, the sum
    of all likelihoods as multiples of the best one's, and whether the text has a letter."""
    feats, bounds, has = features(raw, offs)
    total = np.empty((len(offs) - 1, matrix.shape[1]))
    for k in range(matrix.shape[1]):
        total[:, k] = row_sums(np.ascontiguousarray(matrix[:, k])[feats].astype(np.float64), bounds) + matrix[-1, k]
    # neighbouring n-grams aren't independent: the root of their number tempers the posterior
    total /= np.sqrt(np.maximum(1, np.diff(bounds)))[:, None]
    best = total.argmax(axis=1)
    top = total[np.arange(len(best)), best]
    return best, top, np.exp(total - top[:, None]).sum(axis=1), has


def _step(model, at: int, c: int):
    """Score column `at` against one matrix; the last three of the c columns hold the best language so
    far, its log-likelihood, and the sum of likelihoods."""

    def run(batches):
        names, matrix = model.value
        for batch in batches:
            for first, n, raw, offs in text_parts(batch.column(at), _PART):
                best, top, total, has = score(raw, offs, matrix)
                old = batch.column(c - 3).slice(first, n).to_pylist()
                old_top = np.nan_to_num(batch.column(c - 2).slice(first, n).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                old_total = np.nan_to_num(batch.column(c - 1).slice(first, n).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                new = np.maximum(top, old_top)
                total = total * np.exp(top - new) + old_total * np.exp(old_top - new)
                langs = [(names[b] if x > y else o) if h else None for b, x, y, o, h in zip(best, top, old_top, old, has)]
                kept = [batch.column(i).slice(first, n) for i in range(c - 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(new), pa.array(total)], batch.schema.names)

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns of `keep`, lang_pred and score (0 to 1) of every text.

    A text that is null, empty or without a letter is `und` with score 0, and so is each text where
    nothing was learned. Ties go to the language first in order. Texts of any length are read whole.
    Repeated rows and null ids are scored as any other row; other columns of docs are ignored."""
    c = len(keep)
    state = docs.select(*[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(keep)], F.col(text).alias("t"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("total"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    for i, found in enumerate(model.matrices()):
        if i:  # the texts go through once more for each further matrix
            state = materialise(state, "scores")
        state = state.mapInArrow(_step(docs.sparkSession.sparkContext.broadcast(found), c, c + 4), schema)
    known = F.col("lang").isNotNull()
    return state.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(keep)], F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(known, 1 / F.col("total")).otherwise(F.lit(0.0)).alias("score"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document. Rows whose crc32 of doc_id, as text,
    leaves 2 on division by 4 are held out of training; a null doc_id counts as an empty text and is
    not held out."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4) == 2
    base = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(base, train(base.where(~F.col("held_out"))), ("doc_id", "held_out"))
