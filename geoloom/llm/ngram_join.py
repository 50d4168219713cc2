"""N-gram Jaccard join by parity sketches.

A text's set holds its distinct word shingles as 64-bit hashes. Two sets of sizes a and b with Jaccard similarity of at
least p/100 differ in at most d = a + b - 2 * ceil(p * (a + b) / (100 + p)) shingles. Sizes fall into geometric bands.
For a band whose largest size allows d differences, shingles are dealt into d + 1 cells by hash and each cell keeps the
XOR of its shingles' hashes. At most d cells can differ, so two similar sets agree in at least one (pigeonhole), and
this agreement is an equi-join. A set also joins the bands of the larger sets it can be similar to. A cell without
shingles would join all sets that leave it empty, so it is joined together with a second, independent dealing, where
again one cell must agree. With many cells a third or more of them agree even at the limit, and nearly all of these hold shingles: where the
chance that a pair at the limit agrees in empty cells only (`blind`) is under BLIND, about that of a collision of two 64-bit
hashes, empty cells are left out.

Sets that agree are candidates. A second parity sketch of about one bit per shingle bounds the symmetric difference from
below by its Hamming distance and drops most wrong candidates; the rest are verified with the whole sets.

Classes are found without expanding groups into pairs: of each bucket first the links to its smallest member, then
only pairs whose ends are still in different components. A pair is left out only if both ends are connected already.

Results: a null or empty text, or one without words, has an empty set and links with nothing. A null id links with
nothing and has a null component. Rows that repeat an id are one vertex each time: every row is returned, with its own
set's size and the id's component. Equal texts always link. Very long texts are handled whole. Extra columns are
ignored and clash with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrow, words
from geoloom.llm.components import components

#: Ratio of the largest to the smallest size of a band.
RATIO = 1.4
#: Empty cells are joined through a second dealing unless a pair at the limit agrees in these alone with a smaller chance.
BLIND = 1e-15
#: Parts per shuffle partition into which keys are dealt, each sorted on its own in a worker's memory.
PARTS = 8
#: Keys that a worker gathers before it deals them out.
GATHER = 1_500_000
#: A key that occurs this often among one worker's gathered keys is sent once, and its other members link to that one.
HOT = 8
#: Sets of one bucket that are compared with each other in one task.
BLOCK = 2048
#: Keys of its own that a set brings to a comparison.
FIRST = 8


def most_different(total: int, percent: int) -> int:
    """Largest symmetric difference of sets with sizes adding up to at most `total` at the similarity percent/100."""
    return max(0, *(s - 2 * -(-percent * s // (100 + percent)) for s in range(max(0, total - 3), total + 1)))


def blind(cells: int, different: int, common: int) -> float:
    """Bound on the chance that no cell without any of the `different` shingles has one of the `common` ones.

    The shingles fall into cells at random; occupied[m] is the chance that the different ones lie in m cells.
    """
    occupied, m = np.zeros(cells + 1), np.arange(cells + 1)
    occupied[0] = 1
    for _ in range(different):
        stay, move = occupied * m / cells, occupied * (cells - m) / cells
        occupied = stay + np.append(0, move[:-1])
    return float((occupied * ((1 - 1 / cells) ** common) ** (cells - m)).sum())


def size_bands(largest: int, percent: int, ratio: float = RATIO) -> list[tuple[int, int, int, bool]]:
    """(smallest size, largest size, cells, whether empty cells count) of each band up to the one that holds `largest`."""
    out, low, dense = [], 1, True
    while low <= largest:
        high = low
        while most_different(2 * (high + 1), percent) == 0:
            high += 1
        high = max(high, int(low * ratio))
        cells = most_different(2 * high, percent) + 1
        # It falls with the size, so that one band of several cells that is under the limit decides for all larger ones.
        dense = dense and (cells == 1 or max(blind(cells, d, n - d // 2) for n in (low, high) for d in (most_different(2 * n, percent),)) > BLIND)
        out.append((low, high, cells, dense))
        low = high + 1
    return out


def shingle_sets(data: np.ndarray, start: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text of a joined byte array, the sorted distinct hashes of its shingles."""
    low = words.LOWER[data]
    first, last = words.word_bounds(low)
    hashes = words.word_hashes(low, first, last)
    at = np.searchsorted(first, np.append(start, len(data)))
    for i in range(len(start)):
        yield np.unique(words.shingle_hashes(hashes[at[i] : at[i + 1]], width))


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the cells that have shingles, and their XOR. Cells follow the order of the hashes."""
    cell = ((hashes >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[at], np.bitwise_xor.reduceat(hashes, at)


def band_keys(hashes: np.ndarray, number: int, cells: int, dense: bool) -> np.ndarray:
    """Join keys of one set for one size band."""
    salt = words.mix(np.array([number * 2 + 1], np.uint64))
    if cells == 1:
        return words.mix(np.bitwise_xor.reduce(hashes, keepdims=True) ^ salt)
    cell, value = _cells(hashes, cells)
    keys = words.mix(value ^ words.mix(cell + salt))
    if not dense or len(cell) == cells:
        return keys
    empty = np.setdiff1d(np.arange(cells, dtype=np.uint64), cell)
    other = np.zeros(cells, np.uint64)
    cell, value = _cells(np.sort(words.mix(hashes + np.uint64(0x632BE59BD9B4E019))), cells)
    other[cell.astype(np.int64)] = value
    place = np.arange(cells, dtype=np.uint64) + salt
    more = words.mix(words.mix(words.mix(empty + salt) + np.uint64(1))[:, None] ^ words.mix(other ^ words.mix(place))[None, :])
    return np.concatenate([keys, more.ravel()])


def parity_sketch(hashes: np.ndarray) -> bytes:
    """One parity bit per hash value modulo a power of two that is at least the set's size (64 at least)."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two parity sketches, the longer one folded to the shorter one's size."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


_SCAN = "kind int, doc_id long, n long, f1 long, f2 long, sketch binary, part int, keys binary, ids binary, hot binary"
_SCAN_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary()), ("part", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("hot", pa.binary())])


def _rows(count: int, /, **columns) -> pa.RecordBatch:
    return arrow.table(_SCAN_ARROW, **{f.name: columns.get(f.name, pa.nulls(count, f.type)) for f in _SCAN_ARROW})


def _deal(keys: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Keys and ids by part; of a key that many sets here share, one member goes on and the others link to it (kind 2).

    `hot` holds the places of members that stand for others.
    """
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keys)))
    run = np.repeat(np.arange(len(at)), size)
    extra = (size[run] >= HOT) & ~new
    if extra.any():
        yield _rows(1, kind=[2], keys=[keys[extra].tobytes()], ids=[np.stack([ids[at[run[extra]]], ids[extra]]).tobytes()])
    stands = ((size[run] >= HOT) & new)[~extra]
    keys, ids = keys[~extra], ids[~extra]
    part = (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    pairs = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
    yield _rows(len(pairs), kind=np.ones(len(pairs), np.int32), part=part[edge[:-1]].astype(np.int32), keys=[keys[a:b].tobytes() for a, b in pairs], ids=[ids[a:b].tobytes() for a, b in pairs], hot=[np.flatnonzero(stands[a:b]).astype(np.int32).tobytes() for a, b in pairs])


def _scan(width: int, percent: int, parts: int):
    bands = [size_bands(1 << 12, percent)]

    def keys_of(hashes: np.ndarray) -> list[np.ndarray]:
        n, reach = len(hashes), 100 * len(hashes) // percent
        if bands[0][-1][1] < reach:
            bands[0] = size_bands(2 * reach, percent)
        return [band_keys(hashes, b, cells, dense) for b, (low, high, cells, dense) in enumerate(bands[0]) if low <= reach and high >= n]

    def run(batches):
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: dict[tuple, int] = {}
        waiting = 0
        for batch in arrow.slices(batches):
            data, start = words.joined(batch.column(1))
            doc_ids, out = batch.column(0).to_pylist(), []
            for doc, hashes in zip(doc_ids, shingle_sets(data, start, width), strict=True):
                n = len(hashes)
                f1 = int(np.bitwise_xor.reduce(words.mix(hashes)).view(np.int64)) if n else 0
                f2 = int(hashes.sum(dtype=np.uint64).view(np.int64)) if n else 0
                out.append((n, f1, f2, parity_sketch(hashes)))
                if not n or doc is None:
                    continue
                # Sets equal to one gathered here already only link to it; all sets also share a key of their own.
                other = seen.setdefault((n, f1, f2), doc)
                own = words.mix(np.array([f1, f2 ^ n], np.int64).view(np.uint64))
                found = [words.mix(own[:1] + own[1:])] + (keys_of(hashes) if other == doc else [])
                for k in found:
                    keys.append(k)
                    ids.append(np.full(len(k), doc, np.int64))
                    waiting += len(k)
            yield _rows(len(out), kind=np.zeros(len(out), np.int32), doc_id=batch.column(0), n=[x[0] for x in out], f1=[x[1] for x in out], f2=[x[2] for x in out], sketch=[x[3] for x in out])
            if waiting >= GATHER:
                yield from _deal(np.concatenate(keys), np.concatenate(ids), parts)
                keys, ids, waiting = [], [], 0
                seen.clear()
        if waiting:
            yield from _deal(np.concatenate(keys), np.concatenate(ids), parts)

    return run


_STAR = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])


def _buckets(batches):
    """Rows sorted by part. For each key with several ids: its smallest id with each other one."""
    part, keys, ids, stands = None, [], [], []

    def stars():
        k, d, s = np.concatenate(keys), np.concatenate(ids), np.concatenate(stands)
        order = np.lexsort((d, k))
        k, d, s = k[order], d[order], s[order]
        hidden = np.maximum.reduceat(s, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])))
        keep = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        k, d = k[keep], d[keep]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(k)))
        run = np.repeat(np.arange(len(at)), size)
        rest = np.flatnonzero(~new)
        if len(rest):
            a, b, more = d[at[run[rest]]], d[rest], (size[run[rest]] > 2) | hidden[run[rest]]
            # A bucket of two needs no key: it is one pair, and the same pair is found in many of them. Where one of the
            # two stands for others, the key leads the other one to these.
            pairs = np.unique(np.stack([a[~more], b[~more]]), axis=1)
            yield arrow.table(_STAR, key=np.concatenate([np.zeros(pairs.shape[1], np.int64), k[rest][more].view(np.int64)]), a=np.concatenate([pairs[0], a[more]]), b=np.concatenate([pairs[1], b[more]]), more=np.concatenate([np.zeros(pairs.shape[1], bool), np.ones(int(more.sum()), bool)]))

    for batch in batches:
        for p, k, d, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part and keys:
                yield from stars()
                keys, ids, stands = [], [], []
            part = p
            keys.append(np.frombuffer(k, np.uint64))
            ids.append(np.frombuffer(d, np.int64))
            stands.append(np.zeros(len(ids[-1]), bool))
            stands[-1][np.frombuffer(h, np.int32)] = True
    if keys:
        yield from stars()


def _local_stars(batches):
    for batch in batches:
        for k, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = np.frombuffer(k, np.int64)
            a, b = np.frombuffer(d, np.int64).reshape(2, -1)
            yield arrow.table(_STAR, key=key, a=a, b=b, more=np.ones(len(key), bool))


def _sketch_filter(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("equal", pa.bool_()), ("distance", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for a, b, na, nb, sa, sb, same in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if same:
                    out.append((a, b, True, 0))
                    continue
                most = na + nb - 2 * -(-percent * (na + nb) // (100 + percent))
                if abs(na - nb) <= most and (d := sketch_distance(sa, sb)) <= most:
                    out.append((a, b, False, d))
            if out:
                yield arrow.table(schema, **{n: [x[i] for x in out] for i, n in enumerate(schema.names)})

    return run


def _fold(sketches: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, size), axis=1)


def _compare(percent: int, nearest: bool):
    """Rows sorted by (key, i, j): pairs of one bucket's sets in different components that the sketches don't rule out.

    nearest: of each set only its nearest such partner. Two sets often share many buckets. Each brings the FIRST smallest of
    its keys; if these have common ones, only the bucket of the smallest of those gives the pair.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int64())])

    def pairs(group: list[tuple]) -> pa.RecordBatch | None:
        key, i, j = group[0][:3]
        doc, comp, n, salt = (np.array([x[k] for x in group], np.int64) for k in (3, 4, 5, 6))
        if (comp == comp[0]).all():
            return None
        length = np.array([len(x[7]) for x in group])
        # A set that has fewer keys fills up with values that no other set has.
        keys = -1 - np.arange(len(group) * FIRST).reshape(-1, FIRST)
        for row, x in zip(keys, group, strict=True):
            row[: len(x[8])] = x[8]

        def here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.ones(len(x), bool)
            for at in range(0, len(x), 1 << 15):
                a, b = keys[x[at : at + (1 << 15)]], keys[y[at : at + (1 << 15)]]
                common = (a[:, :, None] == b[:, None, :]).any(axis=2)
                out[at : at + (1 << 15)] = ~common.any(axis=1) | (a[np.arange(len(a)), common.argmax(axis=1)] == key)
            return out
        found: list[np.ndarray] = []
        for size in np.unique(length):
            short, all_ = np.flatnonzero(length == size), np.flatnonzero(length >= size)
            left = _fold(np.frombuffer(b"".join(group[x][7] for x in short), np.uint8).reshape(len(short), -1), size).view(np.uint64)
            right = np.concatenate([_fold(np.frombuffer(b"".join(group[x][7] for x in all_ if length[x] == big), np.uint8).reshape(-1, big), size) for big in np.unique(length[all_])]).view(np.uint64)
            all_ = np.concatenate([all_[length[all_] == big] for big in np.unique(length[all_])])
            step = max(1, (1 << 20) // (len(all_) * max(right.shape[1], 4)))  # bounds the arrays of pairs below
            for at in range(0, len(short), step):
                x = short[at : at + step]
                total = n[x][:, None] + n[all_][None, :]
                most = total - 2 * -(-percent * total // (100 + percent))
                ok = (comp[x][:, None] != comp[all_][None, :]) & (np.abs(n[x][:, None] - n[all_][None, :]) <= most)
                if i != j:
                    ok &= salt[x][:, None] != salt[all_][None, :]
                r, c = np.nonzero(ok)
                if len(r):
                    d = np.bitwise_count(left[at + r] ^ right[c]).sum(axis=1, dtype=np.int64)
                    good = d <= most[r, c]
                    good[good] = here(x[r[good]], all_[c[good]])
                    found.append(np.stack([x[r[good]], all_[c[good]], d[good]]))
        if not found:
            return None
        x, y, d = np.concatenate(found, axis=1)
        if nearest and len(d):
            x, y, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d])
            order = np.lexsort((doc[y], d, x))
            x, y, d = x[order], y[order], d[order]
            keep = np.concatenate([[True], x[1:] != x[:-1]])
            x, y, d = x[keep], y[keep], d[keep]
        got = np.unique(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), d]), axis=1)
        return arrow.table(schema, a=got[0], b=got[1], distance=got[2])

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if (out := pairs(group)) is not None:
                        yield out
                    group = []
                group.append(row)
        if group and (out := pairs(group)) is not None:
            yield out

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            if out:
                yield arrow.table(schema, a=[x[0] for x in out], b=[x[1] for x in out])

    return run


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])

    def run(batches):
        for batch in arrow.slices(batches):
            data, start = words.joined(batch.column(1))
            yield arrow.table(schema, doc_id=batch.column(0), hashes=[x.tobytes() for x in shingle_sets(data, start, width)])

    return run


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, log=None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links lead to, itself included)."""
    spark = df.sparkSession
    docs, stash, say = arrow.documents(df, id_col, text_col), arrow.Stash(spark, "ngram-join"), log or (lambda *x: None)
    parts = arrow.partitions(spark) * PARTS
    scan = stash.keep(docs.mapInArrow(_scan(width, percent, parts), _SCAN), "scan")
    dealt = scan.where("kind = 1").select("part", "keys", "ids", "hot").repartition(arrow.partitions(spark), "part").sortWithinPartitions("part")
    star = "key long, a long, b long, more boolean"
    stars = stash.keep(dealt.mapInArrow(_buckets, star).unionByName(scan.where("kind = 2").select("keys", "ids").mapInArrow(_local_stars, star)), "stars")
    about = stash.keep(scan.where("kind = 0").select("doc_id", "n", "f1", "f2", "sketch"), "about")
    stash.drop("scan")
    one = about.where("doc_id is not null and n > 0").dropDuplicates(["doc_id", "n", "f1", "f2"])

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that the sketches don't rule out."""
        a, b = (one.select(*(F.col(c).alias(f"{c}_{side}") for c in one.columns)) for side in "ab")
        got = pairs.join(a, pairs.a == a.doc_id_a).join(b, F.col("b") == b.doc_id_b).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", F.expr("n_a = n_b and f1_a = f1_b and f2_a = f2_b").alias("same"))
        return stash.keep(got.mapInArrow(_sketch_filter(percent), "a long, b long, equal boolean, distance long"), name)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b, equal) that are links."""
        open_, x, y = pairs.where("not equal").select("a", "b").distinct(), sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y"))
        got = open_.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")
        return stash.keep(pairs.where("equal").select("a", "b").unionByName(got), name)

    first = near(stars.select("a", "b").distinct(), "near")
    needed = first.where("not equal").select(F.explode(F.array("a", "b")).alias("doc_id"))
    wide = stars.where("more")
    needed = needed.unionByName(wide.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    sets = stash.keep(docs.join(needed, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, hashes binary"), "sets")
    # The nearest candidate of each set first: most others then are in one component already.
    nearest = first.where("not equal").groupBy("b").agg(F.min_by("a", F.struct("distance", "a")).alias("a"))
    links = linked(first.where("equal").select("a", "b", "equal").unionByName(nearest.select("a", "b", F.lit(False).alias("equal"))), "links-0")
    found = stash.keep(components(links, stash, "c0"), "of-0")

    def of(col: str) -> DataFrame:
        return found.select(F.col("vertex").alias(col), F.col("component").alias(f"c{col}"))

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")

    rest = stash.keep(apart(first.where("not equal").join(nearest, ["a", "b"], "left_anti")).select("a", "b", "equal"), "rest")
    links = links.unionByName(linked(rest, "links-1"))
    tried = first.select("a", "b")
    # Buckets of three or more whose members are in several components yet: each member's nearest set in another one,
    # then all that are still apart. Sketches are compared in blocks; large buckets are split into pairs of blocks.
    for k, only_nearest in ((1, True), (2, False)):
        found = stash.keep(components(links, stash, f"c{k}"), f"of-{k}")
        at = wide.join(of("a"), "a", "left").join(of("b"), "b", "left").select("key", "a", "b", F.expr("coalesce(ca, a)").alias("ca"), F.expr("coalesce(cb, b)").alias("cb"))
        mixed = at.groupBy("key").agg(F.min(F.least("ca", "cb")).alias("low"), F.max(F.greatest("ca", "cb")).alias("high"), F.count("*").alias("rows")).where("low <> high").select("key", F.expr(f"cast(rows div {BLOCK} + 1 as int)").alias("blocks"))
        member = at.join(mixed, "key").select("key", "blocks", F.expr("stack(2, a, ca, b, cb) as (id, c)")).distinct()
        firsts = member.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST).alias("firsts"))
        own = one.select("doc_id", "n", "sketch").join(firsts.withColumnRenamed("id", "doc_id"), "doc_id")
        dealt = member.join(own, member.id == own.doc_id).withColumn("salt", F.expr("pmod(xxhash64(id), blocks)"))
        dealt = dealt.select("key", "id", "c", "n", "salt", "sketch", "firsts", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        dealt = dealt.select("key", F.expr("least(salt, other)").alias("i"), F.expr("greatest(salt, other)").alias("j"), "id", "c", "n", "salt", "sketch", "firsts")
        dealt = dealt.repartition(arrow.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        pairs = dealt.mapInArrow(_compare(percent, only_nearest), "a long, b long, distance long").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        pairs = stash.keep(pairs.withColumn("equal", F.lit(False)), f"near-{k}")
        links, tried = links.unionByName(linked(pairs, f"links-{k + 1}")), tried.unionByName(pairs.select("a", "b"))
        say(k, "pairs", pairs.count(), "links", links.count()) if log else None
    found = stash.keep(components(links, stash, "c3"), "of-3")
    for name in ("stars", "near", "sets", "rest", "near-1", "near-2", *(f"links-{k}" for k in range(4)), *(f"of-{k}" for k in range(3))):
        stash.drop(name)
    return about.join(found, about.doc_id == found.vertex, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
