"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A byte is a path of binary decisions through a fixed prefix code (short paths for common bytes). For each decision,
predictors for several contexts (the last one and three bytes, and the current word so far) look up how often either side
was taken in the training texts, in tables of hashed slots. Their stretched probabilities are combined by
weights that the depth of the decision selects. These gates are learned from every decision of all training texts: once the tables are
finished, a second pass looks up each decision without its own count and tallies what the predictors say, rounded to LEVELS steps, against the
side taken. Tallies are whole numbers, so that gates and scores don't depend on how rows are dealt; the cheapest gates for the tally
are found by Newton steps. They are refined along each text, block by block, by the gradient of the coding cost. Adding up the costs gives the text's total bits, its end included. The end is coded like byte 0 and then told apart from one in the text,
for which NUL_BITS more are paid.

Training texts are those whose crc32(id) modulo 7 isn't 2; all of them are counted. Each predictor's table has at least one
slot for DENSITY training bytes, rounded up to a power of two, without an upper bound, so that what is learned grows with the input. The base score is a
unigram model with counts of all training tokens. Counts are gathered by parts of the hash space; tokens that are more than 1/HEAVY of all (fewer than
HEAVY can be) are sent to every worker, all others meet their texts where they are counted, so that no token's texts are too many for one
task and no table of all tokens is broadcast.

A null or empty text has one token, its end. Null ids count as the empty id text; rows are scored one by one, whether ids
repeat or not. An empty table gives no rows. Very long texts are taken alone, in blocks.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrow, words
from geoloom.llm.language_id import held_out

SLOT_BITS, BLOCK, LARGEST, RATE, START, HEAVY, GATHER = 18, 64, 2048, 1.0, 0.4, 20_000, 1_500_000
#: A table has 2^SLOT_BITS slots or more: one for so many training bytes.
DENSITY = 4096
#: Bits that tell a byte 0 of a text from the end.
NUL_BITS = 8
#: Weight of a gate's first weights against the decisions tallied.
HOLD = 50.0
#: Steps of a prediction in the tally, STEP apart with 0 in the middle, and bits of their number.
LEVELS, STEP, LEVEL_BITS = 31, 0.5, 5
#: Contexts: numbers of last bytes, then the word so far.
ORDERS = (1, 3)
INPUTS = len(ORDERS) + 1
SLICE = 1 << 20
#: What spreads a context plus a node over the slots; contexts and nodes are multiplied by it beforehand.
_SPREAD = 0x846CA68B
_END = words.mix(np.array([0x656E64], np.uint64))[0]


def prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, node, bit) by byte and depth: a Huffman code for weights that fall with a byte's rank in a fixed order."""
    order = b" etaonirshldcumfpgwybv.,k\nxjqz-'" + bytes([195, 169, 168, 164, 188, 179, 161, 177, 167, 170, 182, 159, 0])
    order += bytes(b for b in range(256) if b not in order)
    heap: list = [(1 / (rank + 2) ** 1.4, b, (b,)) for rank, b in enumerate(order)]
    heapq.heapify(heap)
    path: dict[int, list[tuple[int, int]]] = {b: [] for b in range(256)}
    node = 256
    while len(heap) > 1:
        (w0, _, s0), (w1, _, s1) = heapq.heappop(heap), heapq.heappop(heap)
        node += 1
        for bit, side in ((0, s0), (1, s1)):
            for b in side:
                path[b].append((node, bit))
        heapq.heappush(heap, (w0 + w1, node, s0 + s1))
    deep = max(map(len, path.values()))
    length, nodes, bits = np.zeros(256, np.uint8), np.zeros((deep, 256), np.uint32), np.zeros((deep, 256), np.uint8)
    for b, steps in path.items():
        length[b] = len(steps)
        for j, (n, bit) in enumerate(reversed(steps)):
            nodes[j, b], bits[j, b] = n * 0x9E3779B1 * _SPREAD & 0xFFFFFFFF, bit
    return length, nodes, bits


LENGTH, NODE, BIT = prefix_code()
GATES = len(NODE)
#: Decisions that every byte takes.
SHALLOW = int(LENGTH.min())


_LETTER = (~words.PUNCTUATION[words.LOWER]).tobytes()
_VALUE = (np.arange(256, dtype=np.uint32) + np.uint32(11)) * np.uint32(0x85EBCA6B)
_VALUE ^= _VALUE >> np.uint32(13)


def _grams(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Every byte and the three before it, the byte itself lowest (uint32); nothing before a text's start counts."""
    n = len(data)
    out, b = data.astype(np.uint32), np.empty(n, np.uint8)
    for k in (1, 2, 3):
        b[k:] = data[:-k]
        b[:k] = 0
        for i in range(k):  # the first k bytes of a text, or places of the next one that are as near to its start
            b[(start + i)[: np.searchsorted(start, n - i)]] = 0
        out |= b.astype(np.uint32) << np.uint32(8 * k)
    return out


def _word_so_far(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash (uint32) of the letters since the last other byte, before every byte."""
    # Sums from the word's first byte on, over letters before this byte only.
    n = len(data)
    fresh = np.empty(n, bool)
    np.logical_not(np.frombuffer(data[:-1].tobytes().translate(_LETTER), bool), out=fresh[1:])
    fresh[start] = True
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, n))
    place = np.resize(np.arange(64, dtype=np.uint8), n)
    place -= np.repeat((start & 63).astype(np.uint8), np.diff(np.append(start, n)))
    place &= 63
    place *= 2
    place += 1
    value = _VALUE[data]
    value *= place
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(value, out=total[1:])
    word = total[:-1]
    word -= np.repeat(total[first], size)
    word *= np.uint32(0x297A2D39)
    word ^= word >> np.uint32(15)
    word += np.arange(n, dtype=np.uint32)
    word -= np.repeat(first.astype(np.uint32), size)
    return word


def _hashed(gram: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """Context hashes (uint32) of bytes with the three before them and the word so far."""
    out, h = [], np.zeros(len(gram), np.uint32)
    for k in range(1, max(ORDERS) + 1):
        b = gram >> np.uint32(8 * k)
        b &= np.uint32(255)
        h += b
        h += np.uint32(k)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            x = h + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
            x *= np.uint32(_SPREAD)
            out.append(x)
    out.append(word * np.uint32(_SPREAD))
    return out


def contexts(data: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Context hashes (uint32) of every byte; nothing before a text's start counts."""
    return _hashed(_grams(data, start), _word_so_far(data, start))


def slot_bits(training_bytes: int, density: int = DENSITY) -> int:
    """Bits of a slot's number in tables for so many bytes to learn from."""
    return max(SLOT_BITS, (-(-training_bytes // density) - 1).bit_length())


def _slots(context: np.ndarray, node: np.ndarray, slots: int) -> np.ndarray:
    out = context + node
    out >>= np.uint32(33 - slots.bit_length())
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each occurs (uint32); sorts key in place."""
    key.sort()
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[edge], np.diff(np.append(edge, len(key))).astype(np.uint32)


def _decisions(byte: np.ndarray, ctx: list[np.ndarray], often: np.ndarray, slots: int, block: int):
    """All decisions of bytes in their contexts, by depth: (depth, for each context the place of side and slot, how often); side 1 follows all slots of side 0."""
    side = BIT.astype(np.uint32) * np.uint32(slots)
    for lo in range(0, len(byte), block):
        c, n, h = byte[lo : lo + block], often[lo : lo + block], [x[lo : lo + block] for x in ctx]
        deep = LENGTH[c]
        for j in range(GATES):
            if j >= SHALLOW:
                more = np.flatnonzero(deep > j)
                if not len(more):
                    break
                c, deep, n, h = c[more], deep[more], n[more], [x[more] for x in h]
            node, bit = NODE[j][c], side[j][c]
            yield j, [_slots(x, node, slots) + bit for x in h], n


def count_bits(data: np.ndarray, start: np.ndarray, counts: np.ndarray, block: int = SLICE // 8) -> None:
    """Adds to counts (inputs, 2 * slots) the decisions of all texts. A byte in one context decides alike, so each such case is taken once with its number."""
    gram, word = _grams(data, start), _word_so_far(data, start)
    for k in range(INPUTS):
        if k < len(ORDERS):
            cases, often = _distinct(gram & np.uint32((1 << 8 * (ORDERS[k] + 1)) - 1))
            ctx = _hashed(cases, cases)[k]
        else:
            cases, often = _distinct(word.astype(np.uint64) << np.uint64(8) | data)
            ctx = (cases >> np.uint64(8)).astype(np.uint32) * np.uint32(_SPREAD)
        for _, (at,), n in _decisions(cases.astype(np.uint8), [ctx], often, counts.shape[1] // 2, block):
            np.add.at(counts[k], at.astype(np.intp), n)


def levels(counts: np.ndarray, own: int = 1) -> np.ndarray:
    """Log odds of a 1 in steps from 0 to LEVELS - 1, by side and slot like counts (inputs, 2 * slots), after `own` decisions of that side are taken off."""
    n = counts.reshape(len(counts), 2, -1).astype(np.float32)
    out = np.empty(n.shape, np.uint8)
    for side in (0, 1):
        less = np.maximum(n[:, side] - own, 0)
        odds = np.log((less + np.float32(0.4)) / (n[:, 1 - side] + np.float32(0.4))) / np.float32(STEP if side else -STEP)
        out[:, side] = np.clip(np.rint(odds), -(LEVELS // 2), LEVELS // 2) + LEVELS // 2
    return out.reshape(counts.shape)


def tally_parts(steps: np.ndarray) -> np.ndarray:
    """What each input adds to a tally's place, from its steps by side and slot: (step of each input, side taken) in bits."""
    out = steps.astype(np.uint16)
    for k in range(INPUTS):
        out[k] <<= np.uint16(1 + LEVEL_BITS * (INPUTS - 1 - k))
    out[-1].reshape(2, -1)[1] += np.uint16(1)
    return out


def tally_bits(data: np.ndarray, start: np.ndarray, parts: np.ndarray, tally: np.ndarray, block: int = SLICE // 8) -> None:
    """Adds to tally (gates, steps of each input and side) every decision of all texts; those with equal contexts are taken once with their number."""
    cases, often = _distinct(_word_so_far(data, start).astype(np.uint64) << np.uint64(32) | _grams(data, start))
    gram = cases.astype(np.uint32)
    ctx = _hashed(gram, (cases >> np.uint64(32)).astype(np.uint32))
    for j, places, n in _decisions(gram.astype(np.uint8), ctx, often, parts.shape[1] // 2, block):
        cell = sum(parts[k].take(at) for k, at in enumerate(places))
        np.add.at(tally[j], cell.astype(np.intp), n.astype(np.int64))


TALLY = 1 << (1 + LEVEL_BITS * INPUTS)


def solve_gates(tally: np.ndarray, weights: np.ndarray, steps: int = 50) -> np.ndarray:
    """Moves weights (gates, inputs) in place to the least coding cost of the tally, held to where they were by HOLD; gives decisions by gate."""
    shift = np.arange(INPUTS - 1, -1, -1) * LEVEL_BITS
    for j, cells in enumerate(tally.reshape(GATES, -1, 2)):
        at = np.flatnonzero(cells.any(axis=1))
        x = ((at[:, None] >> shift & (1 << LEVEL_BITS) - 1) - LEVELS // 2) * STEP
        ones, n, held = cells[at, 1].astype(np.float64), cells[at].sum(axis=1).astype(np.float64), weights[j].copy()

        def cost(w, x=x, ones=ones, n=n, held=held):
            z = x @ w
            return (n * np.logaddexp(0, z) - ones * z).sum() + HOLD / 2 * ((w - held) ** 2).sum()

        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ weights[j], -30, 30)))
            curve = (x * (n * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(INPUTS)
            step = np.linalg.solve(curve, x.T @ (ones - n * p) - HOLD * (weights[j] - held))
            now = cost(weights[j])
            while cost(weights[j] + step) > now and np.abs(step).max() > 1e-9:
                step /= 2
            weights[j] += step
            if np.abs(step).max() < 1e-7:
                break
    return tally.sum(axis=1)


def fit_gates(data: np.ndarray, start: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Moves weights (gates, inputs) in place to the least coding cost of texts that counts don't hold; gives decisions by gate."""
    tally = np.zeros((GATES, TALLY), np.int64)
    tally_bits(data, start, tally_parts(levels(counts, own=0)), tally)
    return solve_gates(tally, weights)


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of a 1 by slot from counts (inputs, 2 * slots); rare slots are near 0 and weigh less."""
    n = counts.reshape(len(counts), 2, -1).astype(np.float64)
    return np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)).astype(np.float32)


#: Cost in bits and share missed of a decision by its stretched probability against it, in steps of 1/64 from -15 to 15.
_AGAINST = np.arange(-15 * 64, 15 * 64 + 1) / 64
#: What turns log odds of a 1 into those against the decision, in steps of the tables below.
_SIDE = np.array([64, -64], np.float32)[BIT]
_COST, _MISS = np.log2(1 + np.exp(_AGAINST)).astype(np.float32), (1 / (1 + np.exp(-_AGAINST))).astype(np.float32)


def _blocks(longest: int) -> list[tuple[int, int]]:
    """Places where weights are refined: often at first, then every LARGEST bytes."""
    out, at, size = [], 0, BLOCK
    while at < longest:
        out.append((at, size))
        at, size = at + size, min(size * 2 if len(out) % 2 == 0 else size, LARGEST)
    return out


def total_bits(data: np.ndarray, start: np.ndarray, tables: np.ndarray, gates: np.ndarray | None = None) -> np.ndarray:
    """Cost in bits of each text of the array, mixing weights refined block by block along each text from those of `gates`."""
    n, ctx = len(start), contexts(data, start)
    size = np.diff(np.append(start, len(data)))
    weights = np.empty((GATES, n, INPUTS), np.float32)
    weights[:] = START if gates is None else np.asarray(gates)[:, None, :]
    tables, slots = np.asarray(tables, np.float32), tables.shape[1]
    nul = data == 0
    nul[start + size - 1] = False
    cost = NUL_BITS * (np.add.reduceat(nul, start, dtype=np.float64) if n else np.zeros(0)) - math.log2(1 - 2.0**-NUL_BITS)
    for place, block in _blocks(int(size.max()) if n else 0):
        # Texts that go on come first: only their weights are refined.
        live = np.concatenate([np.flatnonzero(size > place + block), np.flatnonzero((size > place) & (size <= place + block))])
        on = np.count_nonzero(size > place + block)
        length = np.minimum(size[live] - place, block)
        begin = np.cumsum(length) - length
        at = np.repeat(start[live] + place - begin, length) + np.arange(length.sum())
        text = np.repeat(np.arange(len(live), dtype=np.int32), length)
        c = data[at]
        h = [x[at] for x in ctx]
        deep = LENGTH[c]
        for j in range(GATES):
            if j >= SHALLOW:
                more = np.flatnonzero(deep > j)
                if not len(more):
                    break
                c, deep, text, h = c[more], deep[more], text[more], [x[more] for x in h]
            node = NODE[j][c]
            edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            owner = live[text[edge]]
            count = np.diff(np.append(edge, len(text)))
            w = weights[j][owner]
            inputs = [tables[i][_slots(h[i], node, slots)] for i in range(INPUTS)]
            z = inputs[0] * np.repeat(w[:, 0], count)
            for i in range(1, INPUTS):
                z += inputs[i] * np.repeat(w[:, i], count)
            side = _SIDE[j][c]
            z *= side
            z += np.float32(960.5)
            np.clip(z, 0, 1920, out=z)
            against = z.astype(np.int16)
            cost[owner] += np.add.reduceat(_COST[against], edge, dtype=np.float64)
            more_texts = np.searchsorted(text[edge], on)
            if not more_texts:
                continue
            end = edge[more_texts] if more_texts < len(edge) else len(text)
            edge, owner, w = edge[:more_texts], owner[:more_texts], w[:more_texts]
            miss = _MISS[against[:end]]
            miss *= side[:end]
            step = (-RATE / 64 / (count[:more_texts] + 16)).astype(np.float32)
            for i in range(INPUTS):
                x = inputs[i][:end]
                x *= miss
                w[:, i] += step * np.add.reduceat(x, edge)
            weights[j][owner] = w
    return cost


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, start = words.joined(batch.column(0))
    data = data.copy()
    data[np.append(start[1:], len(data)) - 1] = 0
    return data, start


def _tokens(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = words.LOWER[data]
    ends = words.SPACE.copy()
    # Texts were closed by a 0 byte; within a text 0 belongs to a word, so the closing ones become spaces here.
    low[np.append(start[1:], len(low)) - 1] = 0x20
    first, last = words.word_bounds(low, ends)
    return words.word_hashes(low, first, last), np.searchsorted(first, np.append(start, len(low)))


def _by_part(key: np.ndarray, parts: int):
    part = ((key >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    order = np.argsort(part, kind="stable")
    part = part[order].astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    return [(int(part[a]), order[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


_GATHER = "kind int, part int, keys binary, counts binary"
_GATHER_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Slots of each table that are added up together.
_STRIPE = 1 << 14


def _gather(parts: int, slots: int):
    """From all training texts: kind 0, token counts by part; kind 1, tables of decisions by stripe, once a task."""

    def run(batches):
        tables, seen = np.zeros((INPUTS, 2 * slots), np.uint32), False
        keys, counts, waiting = [], [], 0

        def deal():
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)
            got = _by_part(unique, parts)
            return arrow.table(_GATHER_ARROW, kind=np.zeros(len(got), np.int32), part=[p for p, _ in got], keys=[unique[x].tobytes() for _, x in got], counts=[n[x].tobytes() for _, x in got])

        for batch in arrow.slices(batches, most=4 * SLICE):
            seen = True
            data, start = _bytes(batch)
            count_bits(data, start, tables)
            ids, _ = _tokens(data, start)
            unique, n = np.unique(ids, return_counts=True)
            keys.append(np.append(unique, _END))
            counts.append(np.append(n, len(start)))
            waiting += len(unique) + 1
            if waiting >= GATHER:
                yield deal()
                keys, counts, waiting = [], [], 0
        if waiting:
            yield deal()
        if seen:
            for k in range(slots // _STRIPE):
                row = tables.reshape(INPUTS, 2, slots)[:, :, _STRIPE * k : _STRIPE * (k + 1)]
                if row.any():
                    yield arrow.table(_GATHER_ARROW, kind=[1], part=[k], keys=[b""], counts=[zlib.compress(row.tobytes(), 1)])

    return run


_TALLY_ARROW = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
#: Places of the tally that are added up together.
_PIECE = 1 << 13


def _tally(shared):
    """From all training texts: the tally of their decisions by piece, once a task."""

    def run(batches):
        parts, tally = None, np.zeros((GATES, TALLY), np.int64)
        for batch in arrow.slices(batches, most=4 * SLICE):
            if parts is None:
                parts = tally_parts(shared.value)
            tally_bits(*_bytes(batch), parts, tally)
        for k, row in enumerate(tally.reshape(-1, _PIECE)):
            if row.any():
                yield arrow.table(_TALLY_ARROW, part=[k], counts=[zlib.compress(row.tobytes(), 1)])

    return run


def _added(batches, kind):
    """(part, sum of its rows' counts) from sorted rows of compressed counts."""
    total, now = None, None
    for batch in batches:
        for part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got = np.frombuffer(zlib.decompress(data), kind)
            if part != now:
                if total is not None:
                    yield now, total
                now, total = part, np.zeros(len(got), np.int64)
            total += got
    if total is not None:
        yield now, total


def _pieces(batches):
    """Sums of each piece of the tally."""
    for part, total in _added(batches, np.int64):
        yield arrow.table(_TALLY_ARROW, part=[part], counts=[total.tobytes()])


def _runs(batches):
    """Lists of (columns but the first) of rows with the same first column, from sorted batches."""
    part, rows = None, []
    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and p != part:
                yield part, rows
                rows = []
            part = p
            rows.append(row)
    if rows:
        yield part, rows


def _totals(batches):
    """Per part: number of tokens, of distinct tokens, and the counts of the commonest ones (heavy ones are among these)."""
    schema = pa.schema([("n", pa.int64()), ("v", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    for _, rows in _runs(batches):
        unique, at = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k, _ in rows]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.frombuffer(c, np.int64) for _, c in rows]), len(unique)).astype(np.int64)
        top = np.flatnonzero(n * HEAVY > n.sum())
        yield arrow.table(schema, n=[int(n.sum())], v=[len(unique)], keys=[unique[top].tobytes()], counts=[n[top].tobytes()])


def _stripes(batches):
    """Log odds and steps of each stripe of the tables, from sorted rows of counts."""
    schema = pa.schema([("stripe", pa.int32()), ("odds", pa.binary()), ("steps", pa.binary())])
    for stripe, total in _added(batches, np.uint32):
        total = total.reshape(INPUTS, -1)
        yield arrow.table(schema, stripe=[stripe], odds=[stretched(total).astype(np.float16).tobytes()], steps=[levels(total).tobytes()])


_SCORE = "kind int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, part int, keys binary, rows binary, counts binary"
_SCORE_ARROW = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()), ("part", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary()), ("counts", pa.binary())])


def _scan(parts: int, shared):
    def run(batches):
        from pyspark import TaskContext

        heavy, heavy_n, tables, n_all, v_all, gates = shared.value
        tables = tables.astype(np.float32)  # once a task
        heavy_log = np.append(np.log10(heavy_n + 1.0), 0.0)
        serial = TaskContext.get().partitionId() << 40
        keys, owners, counts, waiting = [], [], [], 0

        def deal():
            k, r, c = np.concatenate(keys), np.concatenate(owners), np.concatenate(counts)
            got = _by_part(k, parts)
            empty = pa.nulls
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(got), np.int32)), *[empty(len(got), f.type) for f in list(_SCORE_ARROW)[1:8]], pa.array([p for p, _ in got], pa.int32()), pa.array([k[x].tobytes() for _, x in got]), pa.array([r[x].tobytes() for _, x in got]), pa.array([c[x].tobytes() for _, x in got])], schema=_SCORE_ARROW)

        for batch in arrow.slices(batches, most=4 * SLICE):
            data, start = _bytes(batch)
            m = len(start)
            row = serial + np.arange(m)
            serial += m
            bits = total_bits(data, start, tables, gates)
            ids, begin = _tokens(data, start)
            text = np.repeat(np.arange(m), np.diff(begin))
            at = np.searchsorted(heavy, ids) if len(heavy) else np.zeros(len(ids), int)
            at[at == len(heavy)] = 0
            hit = heavy[at] == ids if len(heavy) else np.zeros(len(ids), bool)
            base = np.bincount(text[hit], heavy_log[at[hit]], m) if hit.any() else np.zeros(m)
            known = np.bincount(text[hit], minlength=m).astype(np.int64)
            # Other tokens meet their counts elsewhere, once a text.
            k, t = ids[~hit], text[~hit]
            order = np.lexsort((k, t))
            k, t = k[order], t[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])])) if len(k) else np.zeros(0, int)
            n = np.diff(np.append(new, len(k)))
            k, t = k[new], t[new]
            train = ~batch.column(2).to_numpy(zero_copy_only=False)
            # The sign bit of a count says whether the text is one to learn from.
            keys.append(k)
            owners.append(row[t])
            counts.append(np.where(train[t], n, -n).astype(np.int32))
            # Ends are tokens like others: they go the common way unless they are heavy.
            end = np.searchsorted(heavy, _END) if len(heavy) else 0
            if len(heavy) and end < len(heavy) and heavy[end] == _END:
                base += heavy_log[end]
                known += 1
            else:
                keys.append(np.full(m, _END, np.uint64))
                owners.append(row)
                counts.append(np.where(train, 1, -1).astype(np.int32))
            waiting += len(keys[-1]) + len(k)
            tokens = np.diff(begin) + 1
            base -= tokens * math.log10(n_all + v_all + 1)
            nulls = [pa.nulls(m, f.type) for f in list(_SCORE_ARROW)[8:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(row), batch.column(1), batch.column(2), pa.array(tokens.astype(np.int64)), pa.array(known), pa.array(base), pa.array(bits), *nulls], schema=_SCORE_ARROW)
            if waiting >= GATHER:
                yield deal()
                keys, owners, counts, waiting = [], [], [], 0
        if waiting:
            yield deal()

    return run


_PARTIAL = pa.schema([("lane", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("base", pa.binary()), ("known", pa.binary())])


def _meet(lanes: int):
    """Per part of the hash space: every light token's count, then what it adds to each text that holds it."""

    def run(batches):
        for part, got in _runs(batches):
            keys, rows, counts = (np.concatenate([np.frombuffer(x[k], t) for x in got]) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int32)))
            unique, at = np.unique(keys, return_inverse=True)
            c = np.bincount(at, np.maximum(counts, 0), len(unique))[at]
            n = np.abs(counts).astype(float)
            owner, place = np.unique(rows, return_inverse=True)
            # Sums in one order of tokens, so that they don't depend on how rows came.
            order = np.lexsort((keys, place))
            base = np.bincount(place[order], (n * np.log10(c + 1))[order], len(owner))
            known = np.bincount(place[order], (n * (c > 0))[order], len(owner)).astype(np.int64)
            lane = (words.mix(owner.view(np.uint64)) % np.uint64(lanes)).astype(np.int64)
            for k in np.unique(lane):
                x = lane == k
                yield arrow.table(_PARTIAL, lane=[int(k)], part=[part], rows=[owner[x].tobytes()], base=[base[x].tobytes()], known=[known[x].tobytes()])

    return run


def _sum(batches):
    schema = pa.schema([("row", pa.int64()), ("base", pa.float64()), ("known", pa.int64())])
    for _, got in _runs(batches):
        rows, base, known = (np.concatenate([np.frombuffer(x[k], t) for x in got]) for k, t in ((1, np.int64), (2, np.float64), (3, np.int64)))
        owner, at = np.unique(rows, return_inverse=True)
        yield arrow.table(schema, row=owner, base=np.bincount(at, base, len(owner)), known=np.bincount(at, known, len(owner)).astype(np.int64))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", density: int = DENSITY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits for every row.

    density: training bytes for each slot of a predictor's table.
    """
    spark = df.sparkSession
    docs = arrow.documents(df, id_col, text_col).select("text", "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"))
    stash, n, parts = arrow.Stash(spark, "lm"), arrow.partitions(spark), arrow.partitions(spark) * 4
    training = docs.where("not held_out").select("text")
    slots = 1 << slot_bits(training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], density)
    gathered = stash.keep(training.mapInArrow(_gather(parts, slots), _GATHER), "gathered")
    totals = gathered.where("kind = 0").select("part", "keys", "counts").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_totals, "n long, v long, keys binary, counts binary")
    # One small row per part: its sums, and tokens above its own limit, fewer than HEAVY in a part.
    totals = stash.keep(totals, "totals")
    n_all, v_all = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    pairs: list[tuple[int, int]] = []
    for r in totals.select("keys", "counts").toLocalIterator():
        pairs += [(int(k), int(c)) for k, c in zip(np.frombuffer(r.keys, np.uint64), np.frombuffer(r.counts, np.int64), strict=True) if c * HEAVY > n_all]
    pairs.sort()
    heavy, heavy_n = np.array([k for k, _ in pairs], np.uint64), np.array([c for _, c in pairs], np.int64)
    tables, steps = np.zeros((INPUTS, slots), np.float16), np.full((INPUTS, 2, slots), LEVELS // 2, np.uint8)
    stripes = gathered.where("kind = 1").select(F.col("part").alias("stripe"), "counts").repartition(n, "stripe").sortWithinPartitions("stripe")
    for r in stash.keep(stripes.mapInArrow(_stripes, "stripe int, odds binary, steps binary"), "stripes").toLocalIterator():
        here = slice(_STRIPE * r.stripe, _STRIPE * (r.stripe + 1))
        tables[:, here] = np.frombuffer(r.odds, np.float16).reshape(INPUTS, -1)
        steps[:, :, here] = np.frombuffer(r.steps, np.uint8).reshape(INPUTS, 2, -1)
    spread = spark.sparkContext.broadcast(steps.reshape(INPUTS, -1))
    pieces = stash.keep(training.mapInArrow(_tally(spread), "part int, counts binary"), "tally").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_pieces, "part int, counts binary")
    tally, gates = np.zeros((GATES * TALLY // _PIECE, _PIECE), np.int64), np.full((GATES, INPUTS), START)
    for r in pieces.toLocalIterator():  # 8 rows of 64 KB a gate at most, whatever the input
        tally[r.part] = np.frombuffer(r.counts, np.int64)
    solve_gates(tally.reshape(GATES, TALLY), gates)
    gates = gates.astype(np.float32)
    spread.destroy()
    shared = spark.sparkContext.broadcast((heavy, heavy_n, tables, n_all, v_all, gates))
    stash.drop("gathered")
    scan = stash.keep(docs.mapInArrow(_scan(parts, shared), _SCORE), "scan")
    met = scan.where("kind = 1").select("part", "keys", "rows", "counts").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_meet(n), "lane int, part int, rows binary, base binary, known binary")
    light = met.repartition(n, "lane").sortWithinPartitions("lane", "part").mapInArrow(_sum, "row long, base double, known long").select(F.col("row").alias("r"), F.col("base").alias("more"), F.col("known").alias("more_known"))
    own = scan.where("kind = 0").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "bits")
    out = own.join(light, own.row == light.r, "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * F.lit(-math.log10(2))).alias("score"),
        F.col("bits").alias("total_bits"),
    )
