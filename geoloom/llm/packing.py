"""Best-fit packing of documents into sequences of at most `capacity` tokens, planned on the histogram of lengths.

Documents are encoded, end with one end id and are cut only if they are longer than a sequence. Whole pieces fill a
sequence alone. The other pieces are planned by length alone, so the plan's size depends on the capacity and not on the
number of documents:

1. Linear grouping: large lengths (over the capacity over a cut), in descending order, form groups of equal cardinality (up to
   whole lengths), and each length is rounded up to its group's largest.
2. Configurations of these few sizes are optimised by column generation (a simplex over patterns, priced by a knapsack) and used as often
   as the solution's whole part says.
3. Actual lengths are substituted for the rounded ones. The last two of a configuration are chosen together, so that they fill the sequence to the
   last token (the last one may then be of a larger group than planned), else but for at most a 512th of the capacity, else so that the gap is one
   that small pieces fill but no large piece. A use without such a choice isn't made.
4. What is left of the large lengths is grouped anew, finer as there is less of it, until a round places nothing or pieces don't make up groups.
5. The rest and the small lengths go, in descending order, where they fit best.

CUTS gives the cuts and numbers of groups of which the one that needs the fewest sequences is taken (the first of equals). Each places four fifths or more
of the large pieces by configurations where lengths are spread like those of documents.

The plan maps (length, rank among the pieces of this length) to (sequence, offset). Ranks are counted per lane and length, and a
lane holds a bounded share of the rows, so that no length, however frequent, is ranked in one task.

A null or empty text is a document of one token, the end id. Null or repeated ids are documents like any other. An empty
table packs into nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm import arrow
from geoloom.llm.tokens import chunk_encoder, vocabulary_path

#: (what the capacity is divided by to part small from large lengths, groups)
CUTS = ((6, 40), (4, 60), (3, 60))
#: A round of grouping needs as many pieces a group.
PER_GROUP = 4
#: Gaps up to the capacity over this are taken where no substitution fills a sequence to the last token.
NEAR = 512


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes that fits and is worth most (an unbounded knapsack, one item more at a time)."""
    worth = np.zeros(capacity + 1)
    choice: list[np.ndarray] = []
    while True:
        more, pick = worth.copy(), np.full(capacity + 1, -1)
        for g in np.argsort(-values / sizes):
            s, v = int(sizes[g]), values[g]
            if v > 1e-12:
                better = worth[: capacity + 1 - s] + v
                up = better > more[s:] + 1e-12
                more[s:][up] = better[up]
                pick[s:][up] = g
        if (pick < 0).all():
            break
        choice.append(pick)
        worth = more
        if len(choice) * int(sizes.min()) > capacity:
            break
    pattern, room = np.zeros(len(sizes)), capacity
    for pick in choice[::-1]:
        g = int(pick[room])
        if g >= 0:
            pattern[g] += 1
            room -= int(sizes[g])
    return float(worth[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 600) -> list[tuple[list[int], int]]:
    """(copies of each size, whole number of uses) from the relaxed optimum of the cutting-stock problem."""
    size, need, m = np.array(sizes), np.array(demand, float), len(sizes)
    basis = np.diag((capacity // size).astype(float))
    use = need / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(m))
        worth, pattern = _best_pattern(size, price, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        use = use - step * ratio[out]
        use[out] = ratio[out]
        basis[:, out] = pattern
    return [(basis[:, k].astype(int).tolist(), int(u + 1e-9)) for k, u in enumerate(use) if u >= 1 - 1e-9]


class Plan:
    """Placements (length, first rank, number, first sequence, offset) of a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, cut: int, groups: int) -> None:
        self.capacity, self.placements, self.sequences = capacity, [], 0
        self.left, self.rank = Counter({k: v for k, v in histogram.items() if v}), Counter()
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> runs of (first sequence, number) filled alike
        self.rooms: list[int] = []
        self.large = sum(v for k, v in self.left.items() if k > capacity // cut)
        self.grouped = 0  # of the large pieces those that configurations place
        self.least = self._least_gap(capacity // cut)
        while self.left and (placed := self._group([x for x in sorted(self.left, reverse=True) if x > capacity // cut], groups)):
            self.grouped += placed
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _least_gap(self, large: int) -> int:
        """Half the median of the small lengths: a gap of this size is one that small pieces fill. Without any, gaps of all sizes are as good."""
        below = sorted(x for x in self.left if x <= large)
        half, seen = sum(self.left[x] for x in below) / 2, 0
        for length in below:
            seen += self.left[length]
            if seen >= half:
                return length // 2
        return 0

    def _place(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.placements.append((length, self.rank[length], number, sequence, offset))
        self.rank[length] += number
        self.left[length] -= number

    def _put_open(self, room: int, sequence: int, number: int) -> None:
        if room > 0 and number:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, number))

    def _group(self, large: list[int], groups: int) -> int:
        """One round of grouping, configurations and substitution over what is left; returns the number of pieces placed."""
        total = sum(self.left[x] for x in large)
        groups = min(groups, total // PER_GROUP)
        if not groups:
            return 0
        each, count = -(-total // groups), 0
        members: dict[int, list[int]] = {}  # group -> its lengths, descending
        for length in large:
            members.setdefault(count // each, []).append(length)
            count += self.left[length]
        lengths = list(members.values())
        sizes = [x[0] for x in lengths]
        for pattern, uses in configurations(sizes, [sum(self.left[x] for x in g) for g in lengths], self.capacity):
            slots = [lengths[g] for g, k in enumerate(pattern) for _ in range(k)]
            while uses and (chosen := self._substitute(slots, large[-1])):
                # As many sequences as have the same actual lengths in all slots.
                take = min(uses, *(self.left[x] // k for x, k in Counter(chosen).items()))
                offset = 0
                for length in chosen:
                    self._place(length, take, self.sequences, offset)
                    offset += length
                self._put_open(self.capacity - offset, self.sequences, take)
                self.sequences += take
                uses -= take
        return total - sum(self.left[x] for x in large)

    def _substitute(self, slots: list[list[int]], smallest: int) -> list[int] | None:
        """An actual length for each slot of a configuration. The last two are chosen together, so that the sequence is filled to the last token or
        keeps a gap that small pieces fill; the last one may be of a larger group than planned."""
        chosen: list[int] = []
        for group in slots[:-2]:
            length = next((x for x in group if self.left[x] > chosen.count(x)), None)
            if length is None:
                return None
            chosen.append(length)
        room = self.capacity - sum(chosen)
        if len(slots) == 1:
            length = next((x for x in slots[0] if self.left[x] and self.least <= room - x < smallest), None)
            return None if length is None else [length]
        for gap in range(self.capacity // NEAR + 1):
            for x in slots[-2]:
                y = room - x - gap
                if y >= slots[-1][-1] and self.left[x] > chosen.count(x) and self.left[y] > [*chosen, x].count(y):
                    return [*chosen, x, y]
        for x in slots[-2]:
            for y in slots[-1]:
                if self.least <= room - x - y < smallest and self.left[x] > chosen.count(x) and self.left[y] > [*chosen, x].count(y):
                    return [*chosen, x, y]
        return None

    def _best_fit(self, length: int) -> None:
        while self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                number, k = (self.left[length] // each, each) if self.left[length] >= each else (1, self.left[length])
                for i in range(k):
                    self._place(length, number, self.sequences, i * length)
                self._put_open(self.capacity - k * length, self.sequences, number)
                self.sequences += number
                continue
            room = self.rooms[at]
            sequence, number = self.open[room].pop()
            take = min(number, self.left[length])
            if take < number:
                self.open[room].append((sequence + take, number - take))
            if not self.open[room]:
                del self.open[room], self.rooms[at]
            self._place(length, take, sequence, self.capacity - room)
            self._put_open(room - length, sequence, take)


def best_plan(histogram: dict[int, int], capacity: int, cuts: tuple[tuple[int, int], ...] = CUTS) -> Plan:
    return min((Plan(histogram, capacity, *c) for c in cuts), key=lambda p: p.sequences)


def document_pieces(df: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", lanes: int = 64, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, lane, serial (place within its task) and, if asked for, ids."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("lane", pa.int32()), ("task", pa.int32()), ("serial", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        from pyspark import TaskContext

        coder, task, serial = chunk_encoder(path), TaskContext.get().partitionId(), 0
        for batch in arrow.slices(batches):
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(arrow.texts(batch)), strict=True):
                ids = np.append(ids, coder.type.type(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    piece = ids[at : at + capacity]
                    serial += 1
                    for n, v in zip(schema.names, (doc, k, at, len(piece), zlib.crc32(piece), (task + serial // 4096) % lanes, task, serial, piece.astype(np.int32)), strict=False):
                        out[n].append(v)
            yield arrow.table(schema, **out)

    names = "doc_id long, piece int, start long, length long, ids_crc32 long, lane int, task int, serial long" + ", ids array<int>" * with_ids
    return arrow.documents(df, id_col, text_col).mapInArrow(run, names)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, cuts: tuple[tuple[int, int], ...] = CUTS) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (see document_pieces); lane, task and serial go."""
    # At most one number for each length up to the capacity.
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    full = histogram.pop(capacity, 0)
    plan = best_plan(histogram, capacity, cuts)
    place = np.array(sorted(plan.placements), np.int64).reshape(-1, 5)
    keys = place[:, 0] << 40 | place[:, 1]
    names = [c for c in pieces.columns if c not in ("lane", "task", "serial")]
    per_lane = pieces.where(f"length < {capacity}").groupBy("lane", "length").count()
    base = per_lane.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("lane").alias("l"), F.col("length").alias("k"), F.coalesce("before", F.lit(0)).alias("before"))
    local = pieces.where(f"length < {capacity}").withColumn("rank", F.row_number().over(Window.partitionBy("lane", "length").orderBy("task", "serial")).cast("long"))
    ranked = local.join(base, (local.lane == base.l) & (local.length == base.k)).select(*names, (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def assign(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length.astype(np.int64) << 40 | rank, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place[at, 3] + rank - place[at, 1]), pa.array(place[at, 4])], names=[*names, "sequence_id", "offset"])

    planned = ranked.mapInArrow(assign, ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long")
    if not full:
        return planned
    alone = pieces.where(f"length = {capacity}").select(*names, (F.lit(plan.sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return planned.unionByName(alone)


def pack_documents(df: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cuts: tuple[tuple[int, int], ...] = CUTS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    spark = df.sparkSession
    stash = arrow.Stash(spark, "packing")
    pieces = stash.keep(document_pieces(df, path, capacity, end_id, id_col, text_col, arrow.partitions(spark), with_ids), "pieces")
    return pack_pieces(pieces, capacity, cuts)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed pieces with ids; a sequence holds at most `capacity` ids."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
