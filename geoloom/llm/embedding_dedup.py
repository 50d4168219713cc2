"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a fast Hadamard transform; the axis nearest to the result, with
its sign, is the hash. A table's key joins HASHES such hashes with the label, and a vector also probes the keys in which one
hash is replaced by the second nearest axis. Vectors that share a key are compared in blocks by their cosine in
double precision, and only pairs that reach the threshold are links.

Equal vectors of one label form a class first, so copies are compared once and never expanded. A pair of classes counts in the
first table in which they share keys, at the smallest key that they share there, so that neither its order nor that of its bucket's rows
matters. Links are counted and spanned by a forest where they are found; pairs aren't
emitted. Large buckets are split into pairs of blocks.

A vector that is null, zero, or holds null or non-finite components, one without a label and one without an id link with nothing; the
last has a null component. Vectors of different lengths don't link. Rows that repeat an id are links of each other only if
their vectors are. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import arrow
from geoloom.llm.components import components

TABLES, HASHES, BLOCK, SEED = 10, 2, 1024, 7
#: Linked pairs whose keys are compared at once.
PAIRS = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows transformed by the (unscaled) Hadamard matrix; the width is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    x = x.copy()
    while step < width:
        v = x.reshape(n, width // (2 * step), 2, step)
        a, b = v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]
        x = np.stack([a, b], axis=2).reshape(n, width)
        step *= 2
    return x


def cross_polytope(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each rotated row. signs: (3, width)."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    two = np.argpartition(-size, 1, axis=1)[:, :2] if x.shape[1] > 1 else np.zeros((len(x), 2), int)
    rows = np.arange(len(x))
    swap = size[rows, two[:, 0]] < size[rows, two[:, 1]]
    two[swap] = two[swap][:, ::-1]
    return tuple(2 * two[:, k] + (x[rows, two[:, k]] < 0) for k in (0, 1))


def probe_keys(x: np.ndarray, label: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + hashes) keys: the own one, then those with one hash replaced."""
    from geoloom.llm.words import mix

    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rnd = np.random.default_rng(seed)
    out = np.empty((len(x), tables, 1 + hashes), np.uint64)
    for t in range(tables):
        near, next_ = zip(*(cross_polytope(padded, rnd.choice([-1.0, 1.0], (3, width))) for _ in range(hashes)), strict=True)
        for p in range(1 + hashes):
            key = mix(label.astype(np.int64).view(np.uint64) + np.uint64(t * 1_000_003 + x.shape[1] * 97))
            for k in range(hashes):
                key = mix(key ^ (next_ if p == k + 1 else near)[k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, t, p] = key
    return out.view(np.int64)


def _keys(batches):
    schema = pa.schema([("rep", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for batch in batches:
        rep, label, vec = (batch.column(k) for k in range(3))
        if not batch.num_rows:
            continue
        rows, label = vec.to_pylist(), label.to_numpy()
        size = np.array([len(v) for v in rows])
        keys = [None] * len(rows)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            x = np.array([rows[i] for i in at], np.float64)
            # Scaled by the largest component first: squares of very large or small ones must stay finite.
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i, k in zip(at, probe_keys(x, label[at]).reshape(len(at), -1), strict=True):
                keys[i] = k
        yield arrow.table(schema, rep=rep, keys=keys)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("count", pa.int64())])


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    open_, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not open_[root]:
            continue
        open_[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & open_)
            open_[new] = False
            edges += [(at, int(x)) for x in new]
            queue += new.tolist()
    return edges


def _links(threshold: float):
    """Rows sorted by (key, i, j). Gives (a, null, count) for links counted here and (a, b, null) for a forest's edges."""
    probes = 1 + HASHES

    def pairs(group: list[tuple]) -> pa.RecordBatch | None:
        key, i, j = group[0][:3]
        if len({len(x[6]) for x in group}) > 1:  # keys of different widths can only meet by a collision of hashes
            size = max({len(x[6]) for x in group}, key=[len(x[6]) for x in group].count)
            group = [x for x in group if len(x[6]) == size]
        rep, copies, salt, label = (np.array([x[k] for x in group], np.int64) for k in (3, 4, 5, 8))
        x = np.array([y[6] for y in group], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= salt[:, None] != salt[None, :]
        if not linked.any():
            return None
        keys = np.array([y[7] for y in group], np.int64).reshape(len(group), -1, probes)
        left, right = np.nonzero(np.triu(linked))
        count = np.zeros(len(group), np.int64)
        for at in range(0, len(left), PAIRS):
            r, c = left[at : at + PAIRS], right[at : at + PAIRS]
            for t in range(keys.shape[1]):
                if not len(r):
                    break
                same = (keys[r, t][:, :, None] == keys[c, t][:, None, :]).any(axis=2)
                common = same.any(axis=1)
                least = np.where(same, keys[r, t], np.iinfo(np.int64).max).min(axis=1)
                mine = common & (least == key)
                np.add.at(count, r[mine], copies[c[mine]])
                np.add.at(count, c[mine], copies[r[mine]])
                r, c = r[~common], c[~common]
        edges, some = _forest(linked), np.flatnonzero(count)
        return arrow.table(_FOUND, a=[*rep[some].tolist(), *(int(rep[a]) for a, _ in edges)], b=pa.array([*[None] * len(some), *(int(rep[b]) for _, b in edges)], pa.int64()), count=pa.array([*count[some].tolist(), *[None] * len(edges)], pa.int64()))

    def run(batches):
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    if len(group) > 1 and (out := pairs(group)) is not None:
                        yield out
                    group = []
                group.append(row)
        if len(group) > 1 and (out := pairs(group)) is not None:
            yield out

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    spark = df.sparkSession
    arrow.prepare(spark)
    stash = arrow.Stash(spark, "embeddings")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"), F.col(f"`{label_col}`").cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    # -0.0 equals 0.0, but not by its bits.
    good = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("vec", F.when(good, F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))))
    rows = rows.select("vec_id", "vec", "label", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")).alias("h1"), F.when(F.col("vec").isNotNull(), F.xxhash64("vec", F.lit(1), "label")).alias("h2"))
    classes = stash.keep(rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")), "classes")
    keyed = stash.keep(classes.select("rep", "label", "vec").mapInArrow(_keys, "rep long, keys array<long>"), "keyed")
    single = keyed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    shared = single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.expr(f"cast(n div {BLOCK} + 1 as int)").alias("blocks"))
    member = single.join(shared, "key").join(keyed, "rep").join(classes.select("rep", "copies", "label", "vec"), "rep")
    member = member.withColumn("salt", F.expr("pmod(xxhash64(rep), blocks)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = member.select("key", F.expr("least(salt, other)").alias("i"), F.expr("greatest(salt, other)").alias("j"), "rep", "copies", "salt", "vec", "keys", "label")
    dealt = dealt.repartition(arrow.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    found = stash.keep(dealt.mapInArrow(_links(threshold), "a long, b long, count long"), "found")
    links = found.where("b is null").groupBy("a").agg(F.sum("count").alias("links"))
    of = components(found.where("b is not null").select("a", "b"), stash)
    known = classes.select("h1", "h2", "rep", "copies").join(links, F.col("rep") == F.col("a"), "left").join(of, F.col("rep") == F.col("vertex"), "left")
    known = stash.keep(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    for name in ("classes", "keyed", "found"):
        stash.drop(name)
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
