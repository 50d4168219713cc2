"""Operators on texts against brute force, round trips and the libraries' own answers."""

import hashlib
import io
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from geoloom.llm import bpe, license_scan, media_columns, ngram_join, packing, token_shards, tokens

SCHEMA = "doc_id long, text string, n_shingles string, start string, word string"
WORDS = "the of and river stone Light, cloud. don't naïve straße 12 MIT License open".split()


def sample(n=60, seed=3):
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) * rnd.randint(0, 1) for _ in range(rnd.randint(1, 160))) for _ in range(n // 3)]
    texts = list(base)
    while len(texts) < n:
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 1, 1, 2, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        texts.append(" ".join(words))
    return texts


SPECIAL = [None, "", "   ", "one", "One two", "one two three", "a b c d", "A  b\tc\nd", "one two three four five", "x" * 5000, "ΑΣ ΟΔΟΣ İ <|endoftext|> y's", "a\x1cb \x1f c\x85d"]


@pytest.fixture(scope="module")
def rows():
    texts = sample() + SPECIAL + sample(30, 5)[:10] * 12
    return [(i, t, "clash", "clash", None) for i, t in enumerate(texts)] + [(7, "a repeated id", None, None, None), (None, "no id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_classes(pairs, width, percent):
    sets = []
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join_equals_brute_force(docs, rows, width, percent):
    got = ngram_join.similar_classes(docs, width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes([r[:2] for r in rows], width, percent)


def test_ngram_join_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "GATHER", 200)
    rnd = random.Random(1)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(90)] = f"x{rnd.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows, 4, 85)


def test_ngram_join_hot_key_meets_one_outsider(spark):
    """The outsider links with the last of eight sets only, and all keys these two share are held by all eight."""
    rows = [(i, f"w0 w1 w2 x{k}") for i, k in enumerate((1, 3, 5, 8, 13, 14, 17, 0))] + [(100, "o7 w1 w2 x0")]
    frame = spark.createDataFrame(spark.sparkContext.parallelize([rows[:-1], rows[-1:]], 2).flatMap(lambda x: x), "doc_id long, text string")
    want = brute_classes(rows, 1, 60)
    assert all(component == 0 for _, _, component in want)
    got = ngram_join.similar_classes(frame, width=1, percent=60).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_ngram_join_empty(empty):
    assert ngram_join.similar_classes(empty).collect() == []


def test_bands_keep_every_pair_at_the_limit():
    rnd = np.random.default_rng(0)
    for percent in (60, 80, 85):
        bands = ngram_join.size_bands(5000, percent)
        assert [b[0] for b in bands[1:]] == [b[1] + 1 for b in bands[:-1]]
        for n in (1, 3, 6, 7, 8, 11, 20, 60, 150, 700):
            for _ in range(20):
                a = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
                most = ngram_join.most_different(2 * n, percent) // 2
                b = np.concatenate([a[: n - most], rnd.integers(0, 1 << 63, most, dtype=np.uint64)])
                k = next(i for i, x in enumerate(bands) if x[0] <= n <= x[1])
                x, y = (ngram_join.band_keys(np.unique(s), k, *bands[k][2:]) for s in (a, b))
                assert len(np.intersect1d(x, y)) or len(np.unique(b)) < n


def test_few_pairs_could_agree_in_empty_cells_only():
    """Where empty cells are left out, chance is bounded; it falls with the size, and the bound holds in a simulation."""
    for percent in (60, 70, 80, 85):
        worst = []
        for low, high, cells, dense in ngram_join.size_bands(2000, percent):
            found = max(ngram_join.blind(cells, d, n - d // 2) for n in (low, high) for d in [ngram_join.most_different(2 * n, percent)])
            assert dense or found <= ngram_join.BLIND
            worst.append(found)
        late = worst[-8:]
        assert late == sorted(late, reverse=True)
    rnd = np.random.default_rng(8)
    missed = 0
    for _ in range(4000):
        differ, common = np.unique(rnd.integers(0, 6, 5)), np.unique(rnd.integers(0, 6, 7))
        missed += not len(np.setdiff1d(common, differ))
    assert missed / 4000 <= 1.1 * ngram_join.blind(6, 5, 7)


@pytest.mark.parametrize("parts,width,percent", [(2, 4, 85), (7, 1, 70)])
def test_ngram_join_of_short_texts_on_several_partitions(spark, parts, width, percent, monkeypatch):
    """Few words and many shared keys: what one worker gathers must meet what others do, however rows are dealt."""
    monkeypatch.setattr(ngram_join, "GATHER", 150)
    rnd = random.Random(parts)
    rows = []
    for i in range(220):
        n = rnd.choice([1, 2, 3, 4, 5, 9, 10, 11])
        rows.append((i, " ".join(rnd.choice(["w", "x", "y"] if rnd.random() < 0.1 else [f"w{k}"]) for k in range(n))))
    rows += [(500 + k, f"filler {k} same words for all of these rows") for k in range(12)] + [(50_000, "a b c d e f g h i"), (400, "a b c d e f g h i j")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
    got = ngram_join.similar_classes(frame, width=width, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows, width, percent)


def test_sketch_distance_bounds_the_difference():
    rnd = np.random.default_rng(1)
    for n, m in ((5, 9), (60, 70), (500, 900)):
        a, b = rnd.integers(0, 1 << 63, n, dtype=np.uint64), rnd.integers(0, 1 << 63, m, dtype=np.uint64)
        b[: n // 2] = a[: n // 2]
        d = ngram_join.sketch_distance(ngram_join.parity_sketch(np.unique(a)), ngram_join.parity_sketch(np.unique(b)))
        assert d <= len(np.setxor1d(a, b))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def odd_texts():
    rnd = random.Random(5)
    letters = "abcéàßÉÑñöÖ́̈ςΣAB' .,!'\"<|endoftext|>1²½\x1c\x85　​日本🤗"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]


def test_prefix_encoder_equals_library(library, rows):
    coder = bpe.encoder(bpe.vocabulary_path())
    for text in [r[1] or "" for r in rows] + odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_chunk_encoder_equals_library(library):
    texts = odd_texts() + ["", "Straße, Don't (stop) naïve!"]
    assert [x.tolist() for x in tokens.chunk_encoder(bpe.vocabulary_path()).encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_digest(docs, rows, empty, library):
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip_digest(docs).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digest(empty).collect() == []
    back = bpe.decode_documents(bpe.encode_documents(docs))
    assert {r.doc_id: r.text for r in back.collect() if r.doc_id == 0} == {0: library.decode(library.encode(rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False)}


def test_token_file(spark, docs, rows, empty, library, tmp_path):
    got = sorted(map(tuple, token_shards.token_file_digest(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i))
    ids = {(i, t): [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    at = 0
    for doc, start, n, crc in got:
        assert start == at
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in ids.items() if i == doc]
        at += n
    target = "file://" + str(tmp_path / "file")
    token_shards.write_tokens(docs, target)
    assert token_shards.find_document(spark, target, 3) == ids[3, rows[3][1]]
    assert token_shards.find_document(spark, target, 10**9) is None
    assert sum(len(r.ids) for r in token_shards.read_tokens(spark, target, with_ids=True).collect()) == at
    assert token_shards.token_file_digest(empty).collect() == []


def test_block_needs_its_dictionary():
    samples = [np.random.default_rng(k).integers(0, 50, 300).astype("<u2").tobytes() for k in range(60)]
    dictionary = token_shards.train_dictionary(samples, 4096)
    assert dictionary
    block = token_shards.pack_block(2, dictionary, 5, [(1, 2, b"")])
    with pytest.raises(ValueError):
        token_shards.Block(block, b"other")


def test_packing(spark, docs, rows, empty, library):
    for capacity in (16, 2048):
        got = packing.pack_documents(docs, capacity=capacity, with_ids=True).collect()
        want = []
        for i, t, *_ in rows:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        by_sequence = {}
        for r in got:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in by_sequence.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        least = -(-sum(r.length for r in got) // capacity)
        assert len(by_sequence) <= 1.15 * least + 1
        joined = packing.sequences(spark.createDataFrame(got, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"))
        assert sum(len(r.ids) for r in joined.collect()) == sum(r.length for r in got)
    assert packing.pack_documents(empty).collect() == []


def best_fit_decreasing(histogram, capacity):
    """Number of sequences by the plain rule, one document at a time."""
    from bisect import bisect_left, insort

    rooms, n = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            at = bisect_left(rooms, length)
            n += at == len(rooms)
            room = rooms.pop(at) if at < len(rooms) else capacity
            insort(rooms, room - length)
    return n


@pytest.mark.parametrize("times", [1, 40])
def test_plan_needs_no_more_sequences_than_best_fit(times):
    """Lengths spread like those of documents: configurations place most large pieces, many of them behind others, whichever cut is taken."""
    rnd = np.random.default_rng(4)
    lengths = np.minimum(np.exp(rnd.normal(6.2, 0.8, 1500)).astype(int) + 1, 2047)
    histogram = {int(k): int(n) * times for k, n in zip(*np.unique(lengths, return_counts=True))}
    assert packing.best_plan(histogram, 2048).sequences <= best_fit_decreasing(histogram, 2048)
    for cut, groups in packing.CUTS:
        plan = packing.Plan(histogram, 2048, cut, groups)
        behind = sum(number for length, _, number, _, offset in plan.placements if offset and length > 2048 // cut)
        assert plan.large == sum(n for k, n in histogram.items() if k > 2048 // cut)
        assert plan.grouped >= 0.8 * plan.large and behind >= 0.3 * plan.large


def test_plan_of_even_lengths():
    """Lengths from 1 to 2047 alike, of which a third fit with small ones only: within a 200th of best fit."""
    histogram = {int(k): int(n) for k, n in zip(*np.unique(np.random.default_rng(1).integers(1, 2048, 30000), return_counts=True))}
    plan = packing.best_plan(histogram, 2048)
    assert plan.sequences <= 1.005 * best_fit_decreasing(histogram, 2048) and plan.grouped >= 0.8 * plan.large


@pytest.mark.parametrize("lengths", [[1] * 5000, [700, 800, 548] * 300, list(range(1, 2048)), [1025] * 40 + [1023] * 41])
def test_plan_places_every_length(lengths):
    from collections import Counter

    histogram = Counter(lengths)
    plan = packing.best_plan(dict(histogram), 2048)
    got, rooms = Counter(), Counter()
    for length, rank, number, first, offset in sorted(plan.placements, key=lambda p: (p[0], p[1])):
        assert rank == got[length]
        got[length] += number
        for k in range(number):
            rooms[first + k] += length
            assert offset + length <= 2048
    assert got == histogram and max(rooms.values()) <= 2048 and len(rooms) == plan.sequences
    assert plan.sequences <= 1.02 * -(-sum(lengths) // 2048) + 1


LICENSES = ["MIT License mit LICENSE", "see the Apache-License, Version 2.0!", "cc by-nc 4.0 and CC BY NC", "Licensed under the Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: MIT", "This work is licensed under the GNU General Public License, version 3.", "permit licenses summit license", "mitélicense", "Released under the MIT License.\nAll rights reserved"]


def test_license_scan(spark, docs, rows, empty):
    extra = [(1000 + k, t, None, None, None) for k, t in enumerate(LICENSES)]
    both = rows + extra
    got = sorted((tuple(r) for r in license_scan.scan_licenses(docs.unionByName(spark.createDataFrame(extra, SCHEMA))).collect()), key=str)
    want = []
    for i, t, *_ in both:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append((i, len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))))
    assert [r[:6] for r in got] == sorted(want, key=str)
    assert all(set(r[5].split(",")) <= set(r[6].split(",")) or not r[5] for r in got) and all(0 <= r[7] <= 1 for r in got)
    labels = {r[0]: r[6] for r in got}
    assert [labels[1000 + k] for k in range(10)] == ["mit", "apache-2", "cc-by-nc", "apache-2", "mit", "mit", "gpl-3", "", "", "mit,proprietary"]
    assert license_scan.scan_licenses(empty).collect() == []
    assert len(license_scan.rules()) > 500


def test_license_gate_holds_for_every_rule():
    """Whatever a rule can match must pass the gate: the shortest text of each rule does."""
    from re import _parser as sre_parse

    def shortest(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            elif name == "SUBPATTERN":
                out += shortest(arg[-1])
            elif name == "BRANCH":
                out += min((shortest(x) for x in arg[1]), key=len)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += shortest(arg[2]) * arg[0]
        return out

    gate = re.compile(license_scan.GATE.replace(r"\x{10FFFF}", "\U0010ffff"))
    for rule in license_scan.rules():
        text = shortest(sre_parse.parse(rule.regex))
        assert gate.search(text) and all(k in text for k in rule.keywords), (rule.keywords, text)
        assert all(len(k) > 1 for k in rule.keywords) and len(text.split()) <= license_scan.OVER
    for _, keyword, names in license_scan.NAMES:
        for name in names:
            text = shortest(sre_parse.parse(name))
            assert gate.search(text) and keyword in text, (keyword, text)
    for key, phrase, *_ in license_scan.PHRASINGS:
        assert key in shortest(sre_parse.parse(phrase.format("x")))


def test_license_suppression_equals_brute_force(spark):
    """All matches of all rules on random runs of their words; each pair of detections compared; blocks of 50 words and whole texts agree."""
    rnd = random.Random(7)
    phrases = ["licensed under the", "see the", "mit license", "apache license version 2 0", "gnu general public license", "version 3", "cc by nc sa 4 0", "license", "under the terms of", "released", "all rights reserved", "mozilla public license 2 0", "gpl v2", "bsd 3 clause license", "this is", "the public domain", "spdx license identifier mit", "public domain dedication and license 1 0", "word"]
    rows = [(i, " ".join(rnd.choice(phrases) for _ in range(rnd.choice([3, 12, 60, 400])))) for i in range(60)]
    every = [(re.compile(r.regex), r) for r in license_scan.rules()]
    want = []
    for i, text in rows:
        words = f" {text} "
        found = [(m.start(), m.end(), r.priority, k, r) for k, (regex, r) in enumerate(every) for m in regex.finditer(words)]
        kept = [d for d in found if not any(e[0] <= d[0] and d[1] <= e[1] and (e[:2] != d[:2] and e[2] >= d[2] or e[:2] == d[:2] and (-e[2], e[3]) < (-d[2], d[3])) for e in found)]
        base = {label for phrase, label in license_scan.BASE if f" {phrase} " in words}
        want.append((i, ",".join(sorted(base | {d[4].label for d in kept})), max([d[4].confidence for d in kept] + [0.6] * bool(base), default=0.0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (50, 2000):
        assert sorted((r.doc_id, r.labels, r.score) for r in license_scan.scan_licenses(frame, block=block).collect()) == want


def slow_difference_hash(image, size=8):
    """Means of the target samples' areas by exact fractions."""
    height, width = image.shape
    shares = lambda n, parts: [[max(Fraction(0), min(Fraction((k + 1) * n, parts), i + 1) - max(Fraction(k * n, parts), i)) for i in range(n)] for k in range(parts)]
    rows, columns = shares(height, size), shares(width, size + 1)
    across = [[sum(int(v) * s for v, s in zip(line, c) if s) for c in columns] for line in image]
    small = [[sum(across[i][k] * s for i, s in enumerate(r) if s) for k in range(size + 1)] for r in rows]
    bits = "".join("1" if line[k] * size * (size + 1) / (height * width) + Fraction(1, 10**9) < line[k + 1] * size * (size + 1) / (height * width) else "0" for line in small for k in range(size))
    return f"{int(bits, 2):0{size * size // 4}x}"


def test_media(docs, rows, empty):
    got = {r.doc_id: r for r in media_columns.text_media_digest(docs).collect() if r.doc_id not in (None, 7)}
    for i, t, *_ in rows:
        if i in (None, 7):
            continue
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        files = []
        for k in range(0, len(image), media_columns.TILE):
            buffer = io.BytesIO()
            np.save(buffer, image[k : k + media_columns.TILE])
            files.append(buffer.getvalue())
        assert (r.media_bytes, r.media_sha256) == (sum(map(len, files)), hashlib.sha256(b"".join(files)).hexdigest())
        assert r.feature == slow_difference_hash(image)
    assert media_columns.text_media_digest(empty).collect() == []


def test_pictures_round_trip(spark):
    rnd = np.random.default_rng(2)
    for shape in ((1, 1), (5, 7), (9, 4, 3), (64, 64), (3, 2, 3)):
        image = rnd.integers(0, 256, shape, dtype=np.uint8)
        assert (media_columns.decode_netpbm(media_columns.encode_netpbm(image)) == image).all()
        assert (media_columns.decode_bmp(media_columns.encode_bmp(image)) == image).all()
        assert (media_columns.from_npy(media_columns.to_npy(image)) == image).all()
    tall = rnd.integers(0, 256, (50_000, 64), dtype=np.uint8)
    assert np.allclose(media_columns.area_resize(tall, 8, 9), media_columns.area_resize(tall, 8, 9, block=1 << 20), rtol=1e-12)
    exact = media_columns.area_resize(np.arange(64.0).reshape(8, 8), 4, 4)
    assert np.allclose(exact, np.arange(64.0).reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    frame = spark.createDataFrame([(1, bytearray(media_columns.encode_bmp(tall[:64]))), (2, None), (3, bytearray(b"no picture"))], "id long, pic binary")
    got = media_columns.tile_pictures(frame, "id", "pic").collect()
    assert sorted((r.id, r.row, r.col) for r in got if r.id == 1) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)]
    assert [r.npy for r in got if r.id != 1] == [None, None]
    tiles = {(r.row, r.col): media_columns.from_npy(bytes(r.npy)) for r in got if r.id == 1}
    assert (np.block([[tiles[0, 0], tiles[0, 1]], [tiles[1, 0], tiles[1, 1]]]) == tall[:64]).all()
