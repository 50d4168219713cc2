"""Registered queries against their oracles, the pipeline against its stages done by hand, and very long texts in every operator."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from geoloom.llm import bpe, language_id, license_scan, lm_mixing, media_columns, ngram_join, packing, queries, token_shards, tokens, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    frame = queries.queries()[name](spark, DATA)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


WORDS = {"en": "the of and to in is that was for with river stone house".split(), "de": "der die und das ist nicht mit von auf für Haus Fluss Stein".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows with null, repeated and clashing columns, near copies, toxic texts and texts without a letter."""
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(260):
        lang = rnd.choice(["en", "en", "de"])
        text = [rnd.choice(WORDS[lang]) + str(rnd.randrange(30)) * (k % 3 == 0) for k in range(rnd.randint(25, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                text[rnd.randrange(len(text))] = rnd.choice(["idiot", "scum"])
        rows.append((i, " ".join(text), lang, "web" if i % 3 else None, len(text), "clash"))
        labels.append((i, int(toxic)))
    for k in range(40):
        i, text, lang, source, n, _ = rows[1 + 4 * (k % 6)]
        words = text.split()
        words[0] = rnd.choice(["Other", words[0]])
        rows.append((1000 + k, " ".join(words), lang, source, n, None))
    rows += [(None, "the end of the river and the house in the stone", "en", None, 1, None), (2000, None, None, None, None, None), (2001, "", "en", "web", 0, None), (2002, "12 345 ...", "en", "web", 3, None), (1, "again the river of the stone and that was for the house with it", "en", "web", 9, "x"), (3, rows[3][1], *rows[3][2:])]
    folder = tmp_path_factory.mktemp("corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows


def test_pipeline_equals_its_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    models = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {(r.doc_id, r.score) for r in toxicity.score(docs, models).where("predicted = 1").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len(bad)
    assert {i for i, _ in bad} >= {i for i in range(0, 260, 4) if zlib.crc32(str(i).encode()) % 5 == 0} and sum(i is not None and i % 4 > 0 for i, _ in bad) <= 3
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    known = corpus_pipeline.keep_known_languages(spark, docs, folder)
    assert known.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()}
    assert {2000, 2001, 2002} <= gone and len(gone) <= 3 + 0.03 * len(rows)
    docs = spark.createDataFrame(known.collect(), docs.schema)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, folder)
    assert one.columns == docs.columns
    sets, parent = [(i, shingles(t, 5)) for i, t in texts if i is not None], {i: i for i, _ in texts if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                p, q = sorted((top(i), top(j)))
                parent[q] = p
    want = sorted(str((i, t)) for i, t in texts if i is None or top(i) == i)
    assert sorted(str((r.doc_id, r.text)) for r in one.collect()) == want and len(want) < len(texts) - 20
    final = corpus_pipeline.run(spark, folder)
    coder = tokens.chunk_encoder(bpe.vocabulary_path())
    pieces = sorted(str((r.doc_id, r.length)) for r in final.collect())
    assert pieces == sorted(str((r.doc_id, len(coder.encode([r.text])[0]) + 1)) for r in one.collect())


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{corpus[0]}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


@pytest.fixture(scope="module")
def long(spark):
    """A text of over 5 MB, beyond every block and slice, beside short ones."""
    rnd = random.Random(2)
    names = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rnd.choice(names) for _ in range(850_000)) + " MIT License, cc by-nc; 日本 Straße" + " MIT License" * 3000
    assert len(text.encode()) > 5 << 20
    rows = [(1, text, "en"), (2, "a short text of few words, by all means", "en"), (3, None, None), (4, "ein kurzer Text mit wenigen Wörtern", "de"), (5, text, "en")]
    return rows, spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string, lang string")


def test_long_texts_as_shingles_licenses_and_media(long):
    rows, docs = long
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.similar_classes(docs).collect()}
    assert got == {i: (len(shingles(t, 4)), 1 if i == 5 else i) for i, t, _ in rows}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for i, t, _ in rows}
    for r in license_scan.scan_licenses(docs).collect():
        places = [k for k, x in enumerate(words[r.doc_id]) if x == "mit" and words[r.doc_id][k + 1 : k + 2] == ["license"] or words[r.doc_id][k : k + 3] == ["cc", "by", "nc"]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words[r.doc_id]), len(places), min(places, default=None), max(places, default=None))
        assert r.labels == ("cc-by-nc,mit" if places else "")
    for r in media_columns.text_media_digest(docs).collect():
        raw = (rows[r.doc_id - 1][1] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_long_texts_as_tokens(long):
    from tokenizers import Tokenizer

    rows, docs = long
    library = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows[:4]}
    ids[5] = ids[1]
    for r in bpe.round_trip_digest(docs).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest())
        if r.doc_id in (1, 2):
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_shards.token_file_digest(docs).collect()}
    assert got == {i: (len(x) + 1, crc([*x, 1])) for i, x in ids.items()}
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs).collect()}
    assert pieces == {(i, k): (at, len(x[at : at + 2048]), crc(x[at : at + 2048])) for i, x in ((i, [*x, 0]) for i, x in ids.items()) for k, at in enumerate(range(0, len(x), 2048))}


def test_long_texts_in_models(spark, long):
    rows, docs = long
    got = {r.doc_id: r for r in lm_mixing.score_texts(docs).collect()}
    assert got[1].n_tokens == len(rows[0][1].split()) + 1 and got[1].score == got[5].score < 0 and got[3].n_tokens == 1
    predicted = {r.doc_id: r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert len(predicted) == 5 and predicted[3] == "und" and predicted[1] == predicted[5] != "und"
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 5
