"""Importance resampling: draw the documents whose hashed word n-grams look most like a target collection's.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. A text's features are all its runs of 1 to `n` words,
joined by one space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. From the
counts of all texts (S in all, s in the bucket) and of the target's texts (T, t) a bucket gains floor(1000 ln((t + 1)(S + buckets) /
((s + 1)(T + buckets)))), and a document's weight is the sum over its features. With Gumbel noise from a hash of its id, the highest scores
are a sample without replacement in proportion to the weights' exponentials.

Method: texts over LONG bytes are cut at word boundaries into chunks of about CHUNK bytes with the n - 1 words that follow as carry;
a chunk owns the features that start in its own words, so each feature counts exactly once. Chunks are dealt anew over the cluster, and
their counts and weights are summed up by document. Texts below that stay where they are. Bucket counts, `buckets` whole numbers, are added up
by Spark and are all that goes to the driver and back. The draw sorts by ranges of (score, id, row) and counts ranges, so no
window holds more than one range.

Null and empty texts, and texts without words, have no features and weight 0. Rows are documents: repeated ids and rows each count. A null id
is hashed as the empty text and comes last among ties; rows that tie in score and id are ranked in an arbitrary order. An empty
target or corpus has counts of 0; an empty corpus gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import arrow
from geoloom.llm.divergence import slice_terms
from geoloom.llm.words import PUNCTUATION

#: Texts of more bytes are cut into chunks of about so many bytes.
LONG, CHUNK = 1 << 16, 1 << 15

_BREAKS = PUNCTUATION.copy()
_BREAKS[65:91] = False
_END = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_NEXT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_CUTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("chunk", pa.int64()), ("own", pa.int64()), ("text", pa.string())])


def cut(data: bytes, carry: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(bytes of its own words, those and `carry` words more) of each chunk of about `size` bytes."""
    at = 0
    while at < len(data):
        found = _END.search(data, at + size) if at + size < len(data) else None
        stop = over = found.start() if found else len(data)
        for _ in range(carry):
            if more := _NEXT.match(data, over):
                over = more.end()
        yield stop - at, data[at:over]
        at = stop


def _cutter(carry: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), arrow.texts(batch), strict=True):
                data = text.encode()
                digest = hashlib.sha256(data).hexdigest()
                for k, (own, piece) in enumerate(cut(data, carry, size)):
                    yield arrow.table(_CUTS, doc_id=[i], digest=[digest], chunk=[k], own=[own], text=[piece.decode()])

    return run


def _features(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each feature that a row owns; without a column `own` all are its own."""
    row, code, terms = slice_terms(batch.column("text"), _BREAKS)
    names = [x.encode() for x in terms.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    starts = np.ones(len(row), bool)
    if "own" in batch.schema.names:  # words are owned as far as they begin within the row's own bytes
        own = [len(re.findall(_NEXT, text.encode()[:most])) for text, most in zip(arrow.texts(batch), batch.column("own").to_pylist(), strict=True)]
        first = np.searchsorted(row, np.arange(batch.num_rows))
        starts = np.arange(len(row)) - first[row] < np.array(own, np.int64)[row]
    rows, found = [row[starts]], [crc[code[starts]] % buckets]
    grams = crc[code]
    for k in range(1, n):  # a run of k + 1 words continues the one of k
        more = np.flatnonzero(row[k:] == row[: len(row) - k])
        longer = np.zeros(len(row), np.int64)
        for i in more.tolist():
            longer[i] = zlib.crc32(names[code[i + k]], zlib.crc32(b" ", int(grams[i])))
        more = more[starts[more]]
        rows.append(row[more])
        found.append(longer[more] % buckets)
        grams = longer
    return np.concatenate(rows), np.concatenate(found)


def _counter(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in arrow.slices(batches):
            total += np.bincount(_features(batch, n, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return run


def _weigher(n: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            row, bucket = _features(batch, n, len(gains))
            count = np.bincount(row, minlength=batch.num_rows)
            total = np.concatenate([[0], np.cumsum(gains[bucket[np.argsort(row, kind="stable")]])])
            upto = np.cumsum(count)
            words = count if n == 1 else _own_words(batch)
            keep = [k for k in range(batch.num_columns) if batch.schema.names[k] not in ("text", "own")]
            columns = [batch.column(k) for k in keep] + [pa.array(count.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(total[upto] - total[upto - count])]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[k] for k in keep] + ["n_features", "n_words", "weight"])

    return run


def _own_words(batch: pa.RecordBatch) -> np.ndarray:
    return np.bincount(_features(batch, 1, 1)[0], minlength=batch.num_rows)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths of a natural logarithm, rounded down."""
    size = len(corpus)
    top, bottom = (target + 1).astype(float) * float(corpus.sum() + size), (corpus + 1).astype(float) * float(target.sum() + size)
    return np.floor(1000 * np.log(top / bottom)).astype(np.int64)


class _Texts:
    """A table's texts: short ones as they are, long ones as chunks that are stored once."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, stash: arrow.Stash, name: str) -> None:
        rows = arrow.documents(df, id_col, text_col)
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        self.short = rows.where(size <= LONG)
        chunks = rows.where(size > LONG).mapInArrow(_cutter(n - 1, CHUNK), "doc_id long, digest string, chunk long, own long, text string")
        self.long = stash.keep(chunks.repartition("doc_id", "digest", "chunk"), name)

    def counts(self, n: int, buckets: int) -> np.ndarray:
        count = lambda rows: rows.mapInArrow(_counter(n, buckets), "bucket long, n long")
        rows = count(self.short.select("text")).unionByName(count(self.long.select("own", "text"))).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        out = np.zeros(buckets, np.int64)
        for bucket, total in rows:  # at most `buckets` rows
            out[bucket] = total
        return out

    def weights(self, n: int, gain: np.ndarray) -> DataFrame:
        """(doc_id, n_features, n_words, weight) of each row."""
        figures = "n_features long, n_words long, weight long"
        short = self.short.mapInArrow(_weigher(n, gain), f"doc_id long, {figures}")
        parts = self.long.mapInArrow(_weigher(n, gain), f"doc_id long, digest string, chunk long, {figures}")
        # Rows with the same id and text are alike: their chunks are summed up together and parted again.
        copies = F.count_if(F.col("chunk") == 0)
        long = parts.groupBy("doc_id", "digest").agg(copies.alias("copies"), *[F.sum(x).alias(x) for x in ("n_features", "n_words", "weight")])
        each = [F.expr(f"{x} div copies").alias(x) for x in ("n_features", "n_words", "weight")]
        return short.unionByName(long.withColumn("copy", F.expr("explode(sequence(1, copies))")).select("doc_id", *each))


def _drawn(scored: DataFrame, count: int, stash: arrow.Stash) -> DataFrame:
    """`scored` with the rank of the `count` rows with the highest scores, ties to the smaller id; null for all others."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    rows = scored.withColumn("row", F.monotonically_increasing_id())
    ranges = stash.keep(rows.repartitionByRange(arrow.partitions(scored.sparkSession), *order).withColumn("range", F.spark_partition_id()), "ranges")
    before, base = 0, []
    for number, size in sorted(tuple(r) for r in ranges.where("eligible").groupBy("range").count().collect()):  # one row a range
        base.append((number, before))
        before += size
    base = scored.sparkSession.createDataFrame(base, "range int, base long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("base")
    inside = ranges.where("eligible").join(F.broadcast(base), "range").where(F.col("base") < count)  # one row a range
    inside = inside.withColumn("rank", rank)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= count, F.col("rank")))
    rest = ranges.where("eligible").join(F.broadcast(base), "range").where(F.col("base") >= count).unionByName(ranges.where("not eligible"), allowMissingColumns=True)
    return inside.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, n: int = 1, buckets: int = 10000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score and the rank of the `percent` of all documents of `least_words` words that are drawn."""
    stash = arrow.Stash(df.sparkSession, "resampling")
    texts = _Texts(df, id_col, text_col, n, stash, "chunks")
    like = _Texts(target.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col, n, stash, "target")
    weights = texts.weights(n, gains(texts.counts(n, buckets), like.counts(n, buckets)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights.withColumn("score", F.col("weight") + noise.cast("long")).withColumn("eligible", F.col("n_words") >= least_words)
    scored = stash.keep(scored, "scored")
    count = scored.where("eligible").count() * percent // 100
    return _drawn(scored, count, stash).select("doc_id", "n_features", "n_words", "weight", "score", F.col("rank").cast("long").alias("rank"))
