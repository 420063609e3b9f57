import os
import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordgauge.llm import window_packing as w
from recordgauge.llm.word_tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", "  a\x1cb\x85c d e　 ", "don't DON'T it's,'s", "é. éx İx İstanbul ΑΣ. ΑΣ, Σ”.", "Éa. ŸſK ß", "a.b.c,,..' '' '.",
    "<|endoftext|> x<|endoftext|>.", "½. ²,x ١٢. ９,", "日本語。、text!", "!!!a!!!", "x'll. we'Ve! '", "𝔘𝔫𝔦. 😀. ﻿a\x00b", "A" * 20_000,
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text(plain):
    encoder = WordEncoder(PATH)
    rng = random.Random(2)
    mixed = ["".join(rng.choice("İÉŸſµaAé'.,! 1½́ ßΣ<|>-s") for _ in range(rng.randrange(1, 30))) for _ in range(5_000)]
    for text in TEXTS + mixed:
        ids = encoder.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain(text), text


def restored(rows, ids_of):
    """Documents put together from pieces, after checking the layout of the sequences."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= w.LENGTH
    for r in rows:
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids_of(r)))
    padding = sum(w.LENGTH - n for n in (sum(x for _, x in p) for p in sequences.values()) if n & (n - 1))
    return documents, padding


def test_round_trip(spark, plain):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("the", "Word,", "été", "x9")) for _ in range(rng.randrange(1, 3_000))) for _ in range(150)]
    rows = list(enumerate([*texts, None, "", "long words here " * 9_000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("mine")).repartition(9)
    packed = w.pack(docs).collect()
    documents, padding = restored(packed, lambda r: bytes(r.ids))
    for i, text in rows:
        ids = [*plain(text), w.END_TOKEN]
        pieces = sorted(documents[i, len(ids)])
        assert [p[0] for p in pieces] == [sum(len(b) // 4 for _, b in pieces[:k]) for k in range(len(pieces))]
        joined = b"".join(b for _, b in pieces)
        assert list(struct.unpack(f"<{len(ids)}I", joined)) == ids
    assert padding < w.LENGTH
    for r, d in zip(packed, w.digest(w.pack(docs)).collect(), strict=False):
        assert d.length >= 1
    one = w.digest(spark.createDataFrame([packed[0]])).first()
    assert one.ids_crc32 == zlib.crc32(bytes(packed[0].ids))


def test_many_merging_rounds(spark, monkeypatch):
    monkeypatch.setattr(w, "MERGED", 2)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text")).repartition(9)
    rows = w.pack(docs, length=64, open_windows=3).collect()
    assert sum(r.length for r in rows) == 400 * 8
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sum(n < 64 for n in filled.values()) <= 1


def test_rounds_end_whatever_the_number_of_partitions(spark, monkeypatch):
    """A session may deal rows to more partitions than are asked for."""
    monkeypatch.setattr(w, "MERGED", 2)
    docs = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g").alias("text")).repartition(9)
    for name in ("repartition", "repartitionById"):
        asked = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda self, n, *by, asked=asked: asked(self, max(n, 9), *by))
    rows = w.pack(docs, length=61, open_windows=3).collect()
    assert sum(r.length for r in rows) == 90 * 8
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sum(n < 61 for n in filled.values()) <= 1


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.length, r.doc_tokens) for r in w.pack(docs).collect()) == [("1", 3, 3), ("1", 3, 3), ("None", 2, 2)]
    assert w.pack(docs.limit(0)).count() == 0


def test_query_is_whole(spark, plain):
    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from recordgauge.llm.queries import queries

    rows = queries()["op3_window_packing"](spark, sf).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*plain(r.text), w.END_TOKEN]
        at = 0
        for p in sorted(pieces.pop(r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            part = ids[at : at + p.length]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    assert not pieces
