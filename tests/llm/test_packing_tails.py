"""Packing: few short sequences however many partitions there are; white space of every kind."""

import random
from collections import Counter

import numpy as np
import public_tokenizers

from relaylens.llm import packing, word_bpe

from helpers import words as some_words
from test_text_operators import check_packing

BPE = public_tokenizers.path("word_bpe_49k.json")


def test_many_partitions_give_few_short_sequences(spark):
    texts = {i: some_words(random.Random(i).randint(0, 900), i % 90) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(64)
    found = packing.pack(docs, BPE).collect()
    assert check_packing(found, texts) == 0
    filled = Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    assert sum(n < packing.CAPACITY for n in filled.values()) <= 11


def test_small_blocks_keep_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 5000)
    texts = {i: some_words(random.Random(i).randint(0, 5000), i) for i in range(60)} | {99: None, 100: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert check_packing(packing.pack(docs, BPE).collect(), texts) == 0


def test_what_is_left_has_no_sequence():
    lengths = [100, 700, 600, 500, 148, 900]
    pieces = packing.assign(lengths, 1024, last=False)
    filled = Counter()
    for _, _, n, s, _ in pieces:
        filled[s] += n
    assert filled == {0: 1024, 1: 1024, -1: sum(lengths) - 2048}
    assert packing.assign([3, 4], 1024, last=False) == [(1, 0, 4, -1, 0), (0, 0, 3, -1, 0)]


def test_repeated_ids_are_packed_as_often_as_they_come(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (None, "e"), (None, None)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BPE).collect()
    assert Counter(r.doc_id for r in found if r.start == 0) == {1: 3, None: 2}
    assert sum(r.length for r in found) == 4 + 4 + 2 + 2 + 1


def test_all_white_space_splits_words(monkeypatch):
    rng = random.Random(3)
    encoder = word_bpe.Encoder(BPE)
    alphabet = ["a", "Be", "don't", "<|endoftext|>", "<|", "É", "é", "1", ",", ".", "ß", "\x1c", " "]
    for k in range(300):
        if k == 150:
            monkeypatch.setattr(word_bpe, "REMEMBERED", 2000)
        texts = ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\t", "\r\n", "\x0b", "\x0c"])
                         for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(
                text, add_special_tokens=False).ids, text
