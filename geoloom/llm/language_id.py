"""Language identification by a string kernel.

A text is described by which byte n-grams of one to three bytes occur in it (a blended spectrum of presences, hashed into
SLOTS slots), after lower-casing A-Z. The kernel of two texts is the number of slots they share over the geometric mean of their
own numbers. LANDMARKS texts span its Nyström approximation, in which one-versus-rest kernel ridge regression is
solved. Scoring is two matrix products per batch of texts.

The model learns from text and language of a bounded sample (PER_LANGUAGE rows of each language by smallest hash of the id,
MOST in all, none over LONGEST bytes), of rows whose crc32(id) modulo 5 isn't 0. Ids, sources and languages aren't inputs of a prediction.

A text that is null or holds no letter is `und` with score 0, as are all if there is nothing to learn from. Ties go to the
language first in order. Whole texts are read, in slices of bounded size. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm import arrow, words

SLOTS, LANDMARKS, PER_LANGUAGE, MOST, LONGEST, RIDGE = 4096, 192, 400, 8000, 1 << 17, 1e-3
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: Column, modulus: int = 5, remainder: int = 0) -> Column:
    """Whether a row is kept from learning; a null id is hashed as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def presences(data: np.ndarray, start: np.ndarray, slots: int = SLOTS, block: int = 1 << 22) -> np.ndarray:
    """(texts, slots) of 0 and 1 as float32 from a joined byte array."""
    n = len(start)
    low = words.LOWER[data].astype(np.uint32)
    stop = np.append(start[1:], len(data)) - 1
    out = np.zeros((n + 1) * slots, np.uint8)
    shift = np.uint32(32 - (slots - 1).bit_length())
    for lo in range(0, len(data), block):
        hi = min(lo + block, len(data))
        row = np.repeat(np.arange(n, dtype=np.int64) * slots, np.clip(stop + 1, lo, hi) - np.clip(start, lo, hi))
        gram = np.zeros(hi - lo, np.uint32)
        for size in (1, 2, 3):
            here = min(hi, len(data) - size + 1) - lo
            gram[:here] = gram[:here] * np.uint32(256) + low[lo + size - 1 : lo + size - 1 + here]
            at = row + ((gram * np.uint32(2654435761) + np.uint32(size * 0x3C6EF372)) >> shift).astype(np.int64)
            for back in range(size):  # n-grams that reach over a text's end
                over = stop - back - lo
                at[over[(over >= 0) & (over < hi - lo)]] = n * slots
            out[at] = 1
    return out.reshape(n + 1, slots)[:n].astype(np.float32)


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised numbers of shared n-grams."""
    own = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (x @ landmarks.T) / own


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.landmarks) @ self.weights + self.bias


def fit(x: np.ndarray, language: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of all rows, then ridge regression of +1 and -1 with classes weighted alike."""
    names = sorted(set(language))
    y = np.array([names.index(v) for v in language])
    # Landmarks in turn from each language, so that rare ones have theirs.
    turn = np.zeros(len(y), int)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    marks = x[np.lexsort((y, turn))[:landmarks]]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = value > 1e-6 * value.max()
    white = vector[:, good] / np.sqrt(value[good])
    phi = np.concatenate([kernel(x, marks) @ white, np.ones((len(x), 1))], axis=1)
    weight = 1.0 / np.bincount(y, minlength=len(names))[y]
    target = np.where(y[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    left = (phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) * np.append(np.ones(phi.shape[1] - 1), 1e-6)
    solved = np.linalg.solve(left, (phi * weight[:, None]).T @ target)
    return Model(names, marks, (white @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def sample_rows(rows: DataFrame, group: str, per_group: int, most: int) -> DataFrame:
    """Ids of at most `per_group` rows of each group and `most` in all, by smallest hash of the id. Only ids move.

    Rows over a limit that all chosen ones but those of an odd chance (under 1e-9) are below go before any group meets in one task, so that
    this task's rows are bounded too.
    """
    rows = rows.select("doc_id", group, F.xxhash64("doc_id").alias("h"))
    limit = (per_group + 8 * per_group**0.5 + 60) * 2.0**64
    sizes = rows.groupBy(group).agg((F.lit(limit) / F.approx_count_distinct("doc_id", 0.02) - 2.0**63).alias("limit"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("h", "doc_id"))
    few = rows.join(sizes, group).where("cast(h as double) <= limit").select("doc_id", group, "h").distinct().withColumn("rank", rank).where(f"rank <= {per_group}")
    return few.orderBy("rank", group, "doc_id").limit(most).select("doc_id", group)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    named = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.where((F.octet_length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}"))
    chosen = sample_rows(named, "lang", PER_LANGUAGE, MOST)
    texts = named.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bits", pa.binary())])

    def run(batches):
        for batch in arrow.slices(batches):
            x = presences(*words.joined(batch.column(1)))
            yield arrow.table(schema, doc_id=batch.column(0), lang=batch.column(2), bits=[r.tobytes() for r in np.packbits(x.astype(np.uint8), axis=1)])

    got = texts.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, bits binary").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(MOST).collect()
    if not got:
        return None
    x = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in got]), axis=1)[:, :SLOTS].astype(np.float32)
    return fit(x, [r.lang for r in got])


def predict_batch(model: Model | None, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """Language and score of a slice's texts (its column `text`)."""
    column = batch.column(batch.schema.get_field_index("text"))
    if model is None:
        return ["und"] * len(column), np.zeros(len(column))
    decided = model.decide(presences(*words.joined(column)))
    best = decided.argmax(axis=1)
    letters = np.array([bool(x and _LETTER.search(x)) for x in column.to_pylist()], bool)
    score = np.where(letters, np.clip((decided[np.arange(len(best)), best] + 1) / 2, 0, 1), 0.0).astype(float)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], score


def certainty(score: np.ndarray, languages: int) -> np.ndarray:
    """Scores as shares of the way from 1/languages to 1."""
    return np.maximum((score * languages - 1) / (languages - 1), 0) if languages > 1 else np.ones(len(score))


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size depends on the parameters above only
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in arrow.slices(batches):
            language, score = predict_batch(shared.value, batch)
            yield arrow.table(schema, doc_id=batch.column(0), held_out=batch.column(2), lang_pred=language, score=score)

    return arrow.documents(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_rows(df: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Rows of df, with all their columns, for whose slices (with a column `text`) keep(slice) is true."""
    arrow.prepare(df.sparkSession)
    names = df.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, names=[*(f"c{k}" for k in range(len(names))), "text"])
            for part in arrow.slices([batch]):
                kept = part.filter(pa.array(keep(part), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=names)

    return df.select("*", F.col(f"`{text_col}`").cast("string").alias("__text__")).mapInArrow(run, df.schema)


def known_language(df: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of df, with all their columns, whose language is known with at least the certainty `least`.

    Decisions for L languages add up to 2 - L for every text, so the best score is never under 1/L. Certainty is the share of
    the way from there to 1: 0 for a text that resembles all languages alike. With a single language all texts with a letter have 1.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(batch):
        language, score = predict_batch(shared.value, batch)
        return [v != "und" and c >= least for v, c in zip(language, certainty(score, len(shared.value.languages)), strict=True)]

    return keep_rows(df, keep, text_col) if model is not None else df
