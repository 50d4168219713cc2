"""Divergence of sources: how far the words of each source stand from those of every other source of its language.

Terms are the runs of letters (a-z, A-Z lower-cased, and all characters beyond ASCII) of a text. A language keeps the terms that
occur in at least `least` of its documents. A group, one source of one language, gives each kept term p = 1 + floor(SCALE * (count +
1) / (N + V)), with N the group's kept occurrences and V the language's kept terms; two distributions differ in a term by
floor((p - q)^2 / q). Everything is whole numbers, so no order of summation shows.

Method, two-dimensional tiling over groups. Each group's counts are packed per chunk of the vocabulary into one array (count and place in
the chunk in one number). Groups of a language are dealt to blocks of BLOCK; an array goes to each tile (block, block) that its block
takes part in. A task reads its tiles' arrays chunk after chunk, holds those of one chunk only and adds up the submatrix of all its
pairs, both directions at once. A tile's vocabulary is further cut into slabs of SLAB chunks, which are tasks of their own, so that few
sources with many terms still spread over a cluster. Terms that no group of a tile has in a chunk need no work: all pairs differ there by
the same figure, which is added as often as such terms were left out.

Counting is done in Arrow batches: words are told apart by their exact bytes in slices of texts, then summed up by Spark, so a frequent
term or a source with most rows arrives pre-aggregated. Joins on the language or the group meet tables of one row per language or
group, which Spark broadcasts as far as they are small and joins by sorting, hot keys split, where they aren't.

Null texts have no terms, null languages and sources stand for ''. A group without kept terms takes part in pairs with p = 1 + floor(SCALE /
V) for every term; a language without kept terms has the value 0 for its pairs and no terms. A source that is alone in its language has no
pairs. Rows are documents: repeated ids and rows count again. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import arrow
from geoloom.llm.words import LOWER, joined

SCALE = 1_000_000_000
#: Groups a block, terms a chunk of the vocabulary (on average), chunks a slab.
BLOCK, CHUNK, SLAB = 32, 4096, 16
#: Text bytes whose words are counted at once.
COUNT_BYTES = 8 << 20
_PLACE = 16  # bits of a packed number that hold the place in the chunk

#: All ASCII bytes but letters.
_BREAK = np.ones(256, bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def slice_terms(column: pa.Array, breaks: np.ndarray = _BREAK) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, code of each word, the words by code): exact words of a slice of texts, A-Z lower-cased."""
    data, start = joined(column)
    data = LOWER[data]
    inside = ~breaks[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    first, last = edge[0::2], edge[1::2]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes())).dictionary_encode()
    text = np.searchsorted(start, first, side="right") - 1
    return text, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group in slices of texts, and a row without a term for each group."""
    for batch in arrow.slices(batches, most=COUNT_BYTES):
        keys = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"]).to_pylist()
        number: dict[tuple[str, str], int] = {}
        group = np.array([number.setdefault((k["lang"], k["source"]), len(number)) for k in keys], np.int64)
        text, code, terms = slice_terms(batch.column("text"))
        size = len(terms)
        pair, n = np.unique(text * size + code, return_counts=True)  # one row a text and term
        cell = group[pair // size] * size + pair % size if size else pair
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, at) if len(at) else n
        docs = np.diff(np.concatenate([at, [len(cell)]]))
        names, own = list(number), cell[at] // size if size else cell[at]
        lang, source = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
        yield arrow.table(_COUNTS, lang=lang.take(pa.array(own)), source=source.take(pa.array(own)), term=terms.take(pa.array(cell[at] % size if size else cell[at])).cast(pa.string()), n=total, docs=docs)
        zero = np.zeros(len(names), np.int64)
        yield arrow.table(_COUNTS, lang=lang, source=source, term=[""] * len(names), n=zero, docs=zero)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * count / total) as 64-bit numbers without overflow: long division, three digits at a time. count <= total < 2^53."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return whole + 1


def _share(count: Column, total: Column) -> Column:
    """The same as a column."""
    div = lambda a, b: F.call_function("div", a, b)
    whole, rest = div(count, total), count % total
    for _ in range(3):
        whole, rest = whole * 1000 + div(rest * 1000, total), (rest * 1000) % total
    return whole + 1


class _Tile:
    """The pairs of one tile in one slab: sums of whole numbers, kept while the chunks pass by."""

    def __init__(self, key: tuple, vocabulary: int) -> None:
        self.key, self.v = key, vocabulary
        self.names: list[list[str]] = [[], []]
        self.totals: list[list[int]] = [[], []]
        self.number: list[dict[int, int]] = [{}, {}]
        self.chunk = -1
        self.rows: list[tuple[int, int, np.ndarray]] = []

    def header(self, side: int, number: int, name: str, total: int) -> None:
        self.number[side][number] = len(self.names[side])
        self.names[side].append(name)
        self.totals[side].append(total)

    def add(self, side: int, number: int, chunk: int, packed: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.rows.append((side, self.number[side][number], packed))

    def close(self) -> None:
        if not self.rows:
            return
        if not hasattr(self, "sums"):
            a, b = len(self.names[0]), len(self.names[1])
            self.sums = [np.zeros((a, b), np.int64), np.zeros((b, a), np.int64)]
            self.used = 0
        places = np.unique(np.concatenate([packed & ((1 << _PLACE) - 1) for _, _, packed in self.rows]))
        p = [np.zeros((len(x), len(places)), np.int64) for x in self.names]
        for side, at, packed in self.rows:
            p[side][at, np.searchsorted(places, packed & ((1 << _PLACE) - 1))] = packed >> _PLACE
        for side in (0, 1):
            for at, total in enumerate(self.totals[side]):
                p[side][at] = share(p[side][at] + 1, total + self.v)
        for i, own in enumerate(p[0]):
            square = own - p[1]
            square *= square
            self.sums[0][i] += (square // p[1]).sum(axis=1)
            if self.key[1] != self.key[2]:
                self.sums[1][:, i] += (square // own).sum(axis=1)
        self.used += len(places)
        self.rows = []

    def result(self) -> pa.RecordBatch | None:
        """(lang, source, item, value) of all ordered pairs, less what they would have by terms that no group has."""
        self.close()
        if not hasattr(self, "sums"):
            return None
        lang, same = self.key[0], self.key[1] == self.key[2]
        none = [np.array([int(share(np.int64(1), t + self.v)) for t in side], np.int64) for side in self.totals]
        out: tuple[list, list, list] = ([], [], [])
        for one, other in ((0, 1),) if same else ((0, 1), (1, 0)):
            p, q = none[one][:, None], none[other][None, :]
            value = self.sums[one] - self.used * ((p - q) * (p - q) // q)
            for i, name in enumerate(self.names[one]):
                for j, item in enumerate(self.names[other]):
                    if name != item:
                        out[0].append(name)
                        out[1].append(item)
                        out[2].append(int(value[i, j]))
        return arrow.table(_SUMS, lang=[lang] * len(out[0]), source=out[0], item=out[1], value=out[2])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile, slab and chunk, each tile's headers first."""
    tile = None
    for batch in batches:
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names) if name != "packed"}
        packed = batch.column("packed")
        values, at = packed.flatten().to_numpy(zero_copy_only=False), 0
        sizes = np.diff(packed.offsets.to_numpy()).tolist()
        for i, n in enumerate(sizes):
            key = tuple(columns[k][i] for k in ("lang", "low", "high", "slab"))
            if tile is None or tile.key != key:
                if tile and (done := tile.result()):
                    yield done
                tile = _Tile(key, columns["v"][i])
            sides = [k for k, block in enumerate(key[1:3]) if block == columns["block"][i]]
            for side in sides:
                if columns["chunk"][i] < 0:
                    tile.header(side, columns["number"][i], columns["source"][i], columns["total"][i])
                else:
                    tile.add(side, columns["number"][i], columns["chunk"][i], values[at : at + n])
            at += n
    if tile and (done := tile.result()):
        yield done


def count_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group; '' stands for the group itself."""
    arrow.prepare(df.sparkSession)
    text = lambda name, to: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(to)
    rows = df.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    rows = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: distances to all other sources, and the `top` terms a source has more of than its language."""
    stash = arrow.Stash(df.sparkSession, "divergence")
    counts = stash.keep(count_terms(df, text_col, lang_col, source_col), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    kept = stash.keep(kept.select("lang", "term", "n"), "kept")
    langs = stash.keep(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total")), "langs")

    # Each kept term's chunk and place there; each group's total, number and block.
    spread = kept.join(langs, "lang").withColumn("chunk", F.expr(f"cast(pmod(xxhash64(term), ceil(v / {CHUNK})) as int)"))
    placed = spread.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    cells = counts.where("term <> ''").select("lang", "source", "term", "n").join(placed.select("lang", "term", "chunk", "place", F.col("n").alias("lang_n")), ["lang", "term"])
    cells = stash.keep(cells, "cells")
    groups = counts.where("term = ''").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"), number.alias("number"))
    groups = groups.withColumn("block", F.expr(f"cast(number div {BLOCK} as int)")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    groups = stash.keep(groups, "groups")

    terms = cells.join(groups.select("lang", "source", "total", "v", "lang_total"), ["lang", "source"])
    p, q = _share(F.col("n") + 1, F.col("total") + F.col("v")), _share(F.col("lang_n") + 1, F.col("lang_total") + F.col("v"))
    terms = terms.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    pairs = _pairs(cells, groups)
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of all ordered pairs of one language's sources."""
    key = ["lang", "low", "high", "slab"]
    fields = ["lang", "low", "high", "slab", "block", "number", "source", "total", "v", "chunk", "packed"]
    to_tiles = F.expr("explode(transform(sequence(0, blocks - 1), k -> struct(least(block, k) as low, greatest(block, k) as high)))")

    def replicate(rows: DataFrame) -> DataFrame:
        return rows.withColumn("tile", to_tiles).select("*", "tile.low", "tile.high").select(*fields)

    packed = F.expr(f"shiftleft(n, {_PLACE}) | place")
    arrays = cells.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(packed)).alias("packed"))
    arrays = arrays.join(groups, ["lang", "source"]).withColumn("slab", F.expr(f"chunk div {SLAB}").cast("int"))
    slabs = F.expr(f"explode(sequence(0, cast((greatest(ceil(v / {CHUNK}), 1) - 1) div {SLAB} as int)))")
    heads = groups.withColumn("slab", slabs).withColumn("chunk", F.lit(-1)).withColumn("packed", F.array().cast("array<bigint>"))
    rows = replicate(heads).unionByName(replicate(arrays))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "chunk")
    sums = rows.mapInArrow(_tiles, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # All pairs of a language's groups, by blocks: what all terms would add if no group had any, and what the tiles found beyond that.
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("other"))
    every = groups.join(other, "lang").where("source <> item")
    p, q = _share(F.lit(1).cast("long"), F.greatest(F.col("total") + F.col("v"), F.lit(1))), _share(F.lit(1).cast("long"), F.greatest(F.col("other") + F.col("v"), F.lit(1)))
    every = every.select("lang", "source", "item", "v", p.alias("p"), q.alias("q"))
    value = F.coalesce("value", F.lit(0)) + F.col("v") * F.expr("(p - q) * (p - q) div q")
    return every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
