"""Toxicity by two class-conditional Kneser-Ney models.

For each class, toxic and ordinary, the probability of a word after another one is interpolated from discounted counts of the pair in
this class, discounted counts of the word in this class, and continuation counts (after how many different words does this one
come?) that both classes share. Words that fewer than a share SUPPORT of the sampled texts hold are one word, and pairs as rare have no counts of their own, so that
rare expressions get about the same probability from either class and speak for neither. A text's two log-likelihoods are divided by its number of words; a logistic function of their difference,
of the same difference over the root of the length and of the strong words' share in it (log ratios over 2) is the score.

The method alone, with all counts kept and the difference by length as the only evidence, doesn't give right results: one insult in a long
text of otherwise neutral words is lost in the sum of these words' small chance differences (README has figures). Hence the support that
counts need and the two further sums of the same log ratios.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z, known by 64-bit hashes.

Learning uses rows with a label 0 or 1 whose crc32(id) modulo 5 isn't 0 and a text of 1 to LONGEST bytes, of each class the PER_CLASS
with the smallest hash of the id, as many of either; three of four train the models, the fourth fits the logistic function, weighted to the classes'
shares among all such rows. Labels, languages, sources and ids aren't inputs of a score.

A null or empty text has no words and gets the logistic function's value for no evidence. If a class has no rows to learn from, all
scores are 0. Rows with repeated ids are scored one by one; a label counts for all rows of its id, and an id with
both labels isn't learned from. Null ids are never labelled. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrow, words
from geoloom.llm.language_id import held_out, keep_rows, sample_rows

#: SUPPORT: share of the sampled texts that must hold a word or pair for it to have counts of its own (and at least LEAST of them).
PER_CLASS, LONGEST, DISCOUNT, SUPPORT, LEAST = 3000, 1 << 16, 0.75, 0.01, 16
_FIRST, _RARE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def word_ids(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin."""
    low = words.LOWER[data]
    first, last = words.word_bounds(low, words.PUNCTUATION)
    return words.word_hashes(low, first, last), np.searchsorted(first, np.append(start, len(data)))


def pair_ids(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return words.mix(before * np.uint64(0x9FB21C651E98DF25) + ids)


def before_ids(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word the one before it; a text's first word follows a mark."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[begin[:-1][begin[:-1] < begin[1:]]] = _FIRST
    return before


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of the asked values in sorted keys, len(keys) where absent."""
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, at, len(keys)) if len(keys) else np.zeros(len(asked), np.int64)


@dataclass
class Models:
    """Tables by sorted hash, each with one more row for what isn't known: column 0 ordinary, column 1 toxic.

    What isn't in `word` is the rare word.
    """

    word: np.ndarray
    word_p: np.ndarray  # probability of a word in each class
    pair: np.ndarray
    pair_p: np.ndarray  # discounted share of a pair among those with the same first word
    after: np.ndarray
    after_back: np.ndarray  # weight of the word's own probability after a word
    fit: np.ndarray

    def evidence(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Per text: mean log ratio, sum of log ratios over the root of the length, logarithm of 1 and the sum of the strong ones."""
        ids, begin = word_ids(data, start)
        n = np.diff(begin)
        out = np.zeros((len(n), 3))
        if not len(ids):
            return out
        at = _find(self.word, ids)
        ids = np.append(self.word, _RARE)[at]
        before = before_ids(ids, begin)
        p = self.word_p[at] * self.after_back[_find(self.after, before)] + self.pair_p[_find(self.pair, pair_ids(before, ids))]
        ratio = np.log(p[:, 1] / p[:, 0])
        some = n > 0
        at = begin[:-1][some]
        total = np.add.reduceat(ratio, at)
        strong = np.add.reduceat(np.where(ratio > 2.0, ratio, 0.0), at)
        out[some, 0] = total / n[some]
        out[some, 1] = total / np.sqrt(n[some])
        out[some, 2] = np.log1p(strong)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.concatenate([evidence, np.ones((len(evidence), 1))], axis=1) @ self.fit
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def build(known: np.ndarray, words_: tuple, befores: tuple, pairs: tuple, discount: float = DISCOUNT) -> Models:
    """Models from counts in which every word outside of the sorted `known` is _RARE; the logistic part is still to be fitted.

    words_: (word, counts in each class, number of different words before it); befores: (word before, counts in each class);
    pairs: (word before, word, counts in each class) of the pairs that have counts of their own.
    """
    size = len(known) + 1  # rows: known words in order, then the rare one
    at = _find(known, words_[0])
    counts, follows = np.zeros((size, 2)), np.zeros(size)
    counts[at], follows[at] = words_[1], words_[2]
    total = counts.sum(axis=0)
    shared = np.maximum(follows - discount, 0) / max(follows.sum(), 1)
    shared += (1 - shared.sum()) / size
    kinds = (counts > 0).sum(axis=0)
    word_p = np.maximum(counts - discount, 0) / total + (discount * kinds / total) * shared[:, None]
    order = np.argsort(befores[0])
    after, after_all = befores[0][order], befores[1][order]
    place = np.searchsorted(after, pairs[0])
    kept, kinds = np.zeros((len(after), 2)), np.zeros((len(after), 2))
    np.add.at(kept, place, pairs[2])
    np.add.at(kinds, place, pairs[2] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        # What pairs without counts of their own have goes back to the words' probabilities.
        back = np.where(after_all > 0, (discount * kinds + after_all - kept) / after_all, 1.0)
        pair_p = np.where(after_all[place] > 0, np.maximum(pairs[2] - discount, 0) / after_all[place], 0.0)
    keys = pair_ids(pairs[0], pairs[1])
    order = np.argsort(keys)
    return Models(known, word_p, keys[order], np.vstack([pair_p[order], np.zeros(2)]), after, np.vstack([back, np.ones(2)]), np.zeros(4))


def _columns(frame: DataFrame, keys: int) -> list[np.ndarray]:
    """Key columns as hashes, then the rest as one array of numbers."""
    got = frame.toArrow()
    numbers = [got.column(k).to_numpy().astype(float) for k in range(keys, got.num_columns)]
    return [*(got.column(k).to_numpy().view(np.uint64) for k in range(keys)), np.stack(numbers, axis=1) if numbers else None]


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> Models | None:
    """Models from at most `per_class` labelled rows of each class; None if a class has none."""
    spark, docs, stash = df.sparkSession, arrow.documents(df, id_col, text_col), arrow.Stash(df.sparkSession, "toxicity")
    known = labels.select(F.col(f"`{label_id}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).where("toxic = high").drop("high").where(~held_out(F.col("doc_id")))
    fit_for = docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= LONGEST)).select("doc_id").distinct()
    known = known.join(fit_for, "doc_id", "left_semi")
    share = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    each = min(per_class, *share.values())
    chosen = sample_rows(known, "toxic", each, 2 * each)
    picked = docs.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= LONGEST).withColumn("part", F.expr("pmod(xxhash64(doc_id, 3), 4)"))
    # Equal texts are learned from once.
    learned = picked.where("part < 3").groupBy(F.xxhash64("text"), "toxic").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "toxic")
    learned = stash.keep(learned, "learned")
    support = max(LEAST, int(SUPPORT * 1.5 * each))
    word_schema = pa.schema([("word", pa.int64()), ("texts", pa.int64())])
    pair_schema = pa.schema([("before", pa.int64()), ("word", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64()), ("texts", pa.int64())])

    def count_words(batches):
        for batch in arrow.slices(batches, most=8 << 20):
            ids, begin = word_ids(*words.joined(batch.column(1)))
            text = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            word = np.unique(np.stack([text, ids.view(np.int64)], axis=1), axis=0)[:, 1]
            word, texts = np.unique(word, return_counts=True)
            yield arrow.table(word_schema, word=word, texts=texts)

    # Bounded by the sample: no more words than its texts have in all over `support`.
    often = learned.mapInArrow(count_words, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).where(f"texts >= {support}").select("word")
    often = np.sort(_columns(often, 1)[0])
    shared_words = spark.sparkContext.broadcast(often)

    def count_pairs(batches):
        for batch in arrow.slices(batches, most=8 << 20):
            ids, begin = word_ids(*words.joined(batch.column(1)))
            if not len(ids):
                continue
            ids = np.append(shared_words.value, _RARE)[_find(shared_words.value, ids)]
            text = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            toxic = batch.column(2).to_numpy().astype(np.int64)[text]
            rows, at = np.unique(np.stack([before_ids(ids, begin).view(np.int64), ids.view(np.int64)], axis=1), axis=0, return_inverse=True)
            at = at.ravel()
            texts = np.bincount(np.unique(at * np.int64(batch.num_rows) + text) // batch.num_rows, minlength=len(rows))
            yield arrow.table(pair_schema, before=rows[:, 0], word=rows[:, 1], n0=np.bincount(at, toxic == 0, len(rows)).astype(np.int64), n1=np.bincount(at, toxic == 1, len(rows)).astype(np.int64), texts=texts)

    pairs = learned.mapInArrow(count_pairs, "before long, word long, n0 long, n1 long, texts long").groupBy("before", "word").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "texts")))
    pairs = stash.keep(pairs, "pairs")
    by_word = _columns(pairs.groupBy("word").agg(F.sum("n0"), F.sum("n1"), F.count("*")), 1)
    by_before = _columns(pairs.groupBy("before").agg(F.sum("n0"), F.sum("n1")), 1)
    if not len(by_word[0]) or (by_word[1][:, :2].sum(axis=0) == 0).any():
        return None
    models = build(often, (by_word[0], by_word[1][:, :2], by_word[1][:, 2]), tuple(by_before), tuple(_columns(pairs.where(f"texts >= {support}").select("before", "word", "n0", "n1"), 2)))
    shared = spark.sparkContext.broadcast(models)
    out = pa.schema([("toxic", pa.int32()), ("e0", pa.float64()), ("e1", pa.float64()), ("e2", pa.float64())])

    def weigh(batches):
        for batch in arrow.slices(batches):
            e = shared.value.evidence(*words.joined(batch.column(1)))
            yield arrow.table(out, toxic=batch.column(2), e0=e[:, 0], e1=e[:, 1], e2=e[:, 2])

    rest = picked.where("part = 3").select("doc_id", "text", "toxic").mapInArrow(weigh, "toxic int, e0 double, e1 double, e2 double")
    # About a quarter of the sampled ids; where these repeat, rows go by a hash that doesn't favour a class.
    rest = rest.orderBy(F.xxhash64("e0", "e1", "e2"), "e0", "e1", "e2", "toxic").limit(4 * per_class).toPandas()
    stash.drop("learned")
    stash.drop("pairs")
    y = rest["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum()))
        models.fit = _logistic(rest[["e0", "e1", "e2"]].to_numpy(), y, weight / weight.mean())
    else:
        models.fit = np.array([1.0, 0.0, 0.0, 0.0])
    return models


def _scores(models: Models | None, column: pa.Array) -> np.ndarray:
    return np.zeros(len(column)) if models is None else models.score(models.evidence(*words.joined(column)))


def score(df: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in arrow.slices(batches):
            got = _scores(shared.value, batch.column(1))
            yield arrow.table(schema, doc_id=batch.column(0), held_out=batch.column(2), score=got, predicted=(got >= threshold).astype(np.int32))

    return arrow.documents(df, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, models: Models | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df, with all their columns, whose score is under the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    return keep_rows(df, lambda batch: _scores(shared.value, batch.column(batch.schema.get_field_index("text"))) < threshold, text_col) if models is not None else df
