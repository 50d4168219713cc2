"""Source divergence, importance resampling and personal data against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoloom.llm import divergence, personal_data, resampling

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, weight string, kind string"
WORDS = "the of river Stone straße niño e-mail over 12 light3house again Light".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for i in range(400):
        lang, source = rnd.choice(["en", "en", "en", "de", None]), f"s{int(rnd.random() ** 2 * 9)}"
        text = " ".join(rnd.choice(WORDS) + rnd.choice("abcdefg") * rnd.randint(0, 3) for _ in range(rnd.randint(0, 60)))
        out.append((i, text, lang, source, "clash", "clash", None, "x"))
    out += [(i, out[5][1], "en", "hot", None, None, None, None) for i in range(400, 520)]
    out += [(600, None, "en", "s1", None, None, None, None), (601, "", "fr", None, None, None, None, None), (602, "12 34 ...", "fr", "s2", None, None, None, None)]
    out += [(603, "once only", "it", "a", None, None, None, None), (None, "no id here", "en", None, None, None, None, None), (7, out[7][1], "en", "s3", None, None, None, None), (7, out[7][1], "en", "s3", None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_divergence(rows, least, top):
    docs, counts, df = [], defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        docs.append((r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))))
    for lang, source, words in docs:
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = set()
    for lang in df:
        kept = {t for t, n in df[lang].items() if n >= least}
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        total = {s: sum(c.values()) for s, c in groups.items()}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        for s in groups:
            found = {"pair": {}, "term": {}}
            for o in groups:
                if o != s:
                    found["pair"][o] = sum((share(groups[s][t], total[s]) - share(groups[o][t], total[o])) ** 2 // share(groups[o][t], total[o]) for t in kept)
            for t in kept:
                p, q = share(groups[s][t], total[s]), share(whole[t], sum(whole.values()))
                if groups[s][t] and p > q:
                    found["term"][t] = (p - q) ** 2 // q
            for part, values in found.items():
                for k, (item, v) in enumerate(sorted(values.items(), key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item, v, k))
    return out


@pytest.mark.parametrize("block,chunk,slab", [(32, 4096, 16), (3, 8, 2)])
def test_divergence_equals_brute_force(docs, rows, monkeypatch, block, chunk, slab):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "SLAB", slab)
    got = [tuple(r) for r in divergence.audit(docs, least=3, top=20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, 3, 20)


def test_divergence_of_one_source_and_of_nothing(spark, empty):
    assert divergence.audit(empty).collect() == []
    one = spark.createDataFrame([(1, "a b a", "en", "s"), (2, "a b", "en", "s"), (3, "a c", "en", "s")], "doc_id long, text string, lang string, source string")
    assert divergence.audit(one).collect() == []


def test_shares_are_exact_for_large_counts():
    rnd = random.Random(2)
    for _ in range(300):
        total = rnd.randint(1, 1 << 52)
        count = rnd.randint(0, total)
        assert int(divergence.share(np.int64(count), total)) == 1 + 10**9 * count // total


def words12(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_resample(rows, target, percent, least, n, buckets, seed):
    def features(text):
        w = words12(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1]))
    for x in target:
        t.update(features(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (ss + buckets) / ((s[k] + 1) * (tt + buckets))))
    out = []
    for r in rows:
        f = features(r[1])
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([r[0], len(f), len(words12(r[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = k
    return sorted(map(str, map(tuple, out)))


@pytest.mark.parametrize("n,long,chunk", [(1, 1 << 16, 1 << 15), (1, 100, 37), (3, 100, 37), (2, 60, 5)])
def test_resampling_equals_brute_force(spark, docs, rows, monkeypatch, n, long, chunk):
    monkeypatch.setattr(resampling, "LONG", long)
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    target = ["the river again", None, "", "niño stone over the light3house"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs, frame, percent=10, least_words=20, n=n, buckets=500, seed=11).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_resample(rows, target, 10, 20, n, 500, 11)


def test_resampling_of_empty_tables(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, none).collect() == []
    got = resampling.resample(docs, none, percent=50, least_words=5).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_resample(rows, [], 50, 5, 1, 10000, 2024)


def test_chunks_own_every_word_once():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "bc", "ß", " ", ", ", "日本", "9"]) for _ in range(rnd.randint(1, 60))).encode()
        for size, carry in ((1, 0), (4, 2), (9, 1), (1000, 3)):
            own, at = [], 0
            for n, piece in resampling.cut(text, carry, size):
                assert text[at : at + n] == piece[:n] and text[at:].startswith(piece)
                own += words12(piece[:n].decode())
                rest = words12(text[at + n :].decode())
                assert words12(piece.decode()) == words12(piece[:n].decode()) + rest[:carry]
                at += n
            assert at == len(text) and own == words12(text.decode())


EMAIL, IP, CARD, PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, form in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and max(map(int, m[0].split("."))) <= 255 or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def listed(spans):
    order = {"email": 0, "ip": 1, "card": 2, "phone": 3}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


SIGNS = ["a@b.c", "x.y+z@mail-1.example.com", "a@b.c_x@d.e.f", "@", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436468", "12 34 56", "+1 (244) 555-4688", "+49 30 1234 567 8.", "+1-2", "+12345678901234567", "日本", "𝒳𝒴", "ñ", "word", "x" * 40, ".", ",", "\u0001", "\n", "00", "7"]


def test_base_spans_equal_the_plain_forms(spark):
    rnd = random.Random(9)
    texts = [None, "", "@" * 50, "1." * 60, "+1" * 50, "a@a" + ".a" * 3000, "5 " * 2000] + ["".join(rnd.choice(SIGNS) + rnd.choice(["", " ", " ", "-", "(", "."]) for _ in range(rnd.randint(1, 25))) for _ in range(600)]
    frame = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, email string, slots string").repartition(4)
    for r in personal_data.digest(frame).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest(), repr(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone")]
        spans = [x for x in r.spans.split(",") if x]
        assert set(listed(base).split(",")) - {""} <= set(spans)
        for kind, a, b in (x.split(":") for x in set(spans) - set(listed(base).split(","))):
            assert all(not (int(a) < stop and start < int(b)) for _, start, stop in base), kind


def planted():
    """Phone numbers after the words 'please call', four of which have no base form; order numbers after other words."""
    rnd = random.Random(5)
    filler = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rnd.randint(4, 9)))
    rows = [(k, f"{filler()} please call +1 (555) 010-{1000 + k} {filler()}") for k in range(30)]
    rows += [(100 + k, f"{filler()} please call (555) 010-77{k}1, {filler()}") for k in range(4)]
    rows += [(200 + k, f"{filler()} order number 5550{k}0{k}1234 {filler()}") for k in range(30)]
    rows += [(300 + k, f"{filler()} reach us under (555) 010-77{k % 4}1 or {filler()}") for k in range(8)]
    return rows


def test_patterns_find_numbers_without_a_base_form(spark):
    rows = planted()
    rows += [rows[31]] * 40 + [(None, rows[31][1]), (101, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = personal_data.digest(frame).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    for r in got:
        texts[r.doc_id].add(r.spans)
    for k in range(4):
        text = rows[30 + k][1]
        at = text.index("(555)")
        assert f"phone:{at}:{at + 14}" in texts[100 + k]
    assert all(texts[200 + k] == {""} for k in range(30))
    assert sum(len(x) for r in got for x in [r.spans] if r.doc_id == 101) == 41 * len(next(iter(texts[101] - {""})))


def test_one_group_of_copies_raises_no_pattern(spark):
    text = "reference please note +1 (555) 010-2000 and please note AB-77123-9 at the end"
    frame = spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string")
    assert {r.spans for r in personal_data.digest(frame).collect()} == {"phone:22:39"}


def test_personal_data_of_empty_tables(empty):
    assert personal_data.digest(empty).collect() == []


def test_long_texts(spark):
    head, part = "x" * 1_000_000 + " ", "a1b2 please mail me@site.org now, 10.0.0.1 "
    text = head + part * 5_000 + "y@" * 50_000 + "1" * 300_000
    base = [(kind, len(head) + k * len(part) + a, len(head) + k * len(part) + b) for kind, a, b in brute_base(part) for k in range(5_000)]
    frame = spark.createDataFrame([(1, text), (2, text), (3, "a b")], "doc_id long, text string")
    want = hashlib.sha256(listed(base).encode()).hexdigest()
    got = {r.doc_id: r for r in personal_data.digest(frame).collect()}
    assert got[1].base_sha256 == got[2].base_sha256 == want and got[1].n_email == got[1].n_ip == 5_000 and got[3].spans == ""
    target = spark.createDataFrame([(1, "mail me")], "item_id long, text string")
    scored = {r.doc_id: r for r in resampling.resample(frame, target).collect()}
    assert scored[1].n_features == len(words12(text)) and scored[1].weight == scored[2].weight
