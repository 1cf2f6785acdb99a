"""Merge-dropout: every occurrence of a segment has draws of its own, whatever is remembered."""

import numpy as np
import public_tokenizers
import pytest

from relaylens.llm import merge_dropout

from helpers import words as some_words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["internationalisation " * 300, some_words(400, 1), some_words(400, 1), " a  b\n\tc 日本語😀 ▁x",
         "", "ab" * 300 + " ab", "the the the " * 100]


def by_segment(encoder, text, doc_id):
    key, out = encoder.key(doc_id), []
    for place, word in enumerate(merge_dropout.split(text) if text else []):
        own = merge_dropout.mixed(key + (place + 1) * merge_dropout._STEP & merge_dropout._MASK)
        out.append(encoder.segment(f" {word}", own)[0])
    return out


def test_a_word_has_more_than_eight_forms(spark):
    docs = spark.createDataFrame([(i, "internationalisation") for i in range(400)], "doc_id long, text string")
    encoded = merge_dropout.encode(docs, PIECES)
    assert len({tuple(r.ids) for r in encoded.collect()}) > 8
    text = "internationalisation " * 300
    one = [tuple(ids) for ids in by_segment(merge_dropout.Encoder(merge_dropout.pieces_of(PIECES)), text, 1)]
    assert len(set(one)) > 8
    whole = merge_dropout.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES)
    assert list(whole.first().ids) == [i for ids in one for i in ids]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("bound", [0, 50, 1_000_000])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, rate, bound):
    monkeypatch.setattr(merge_dropout, "REMEMBERED", bound)
    monkeypatch.setattr(merge_dropout, "NODES", bound)
    monkeypatch.setattr(merge_dropout, "_CHUNK", 97)
    encoder = merge_dropout.Encoder(merge_dropout.pieces_of(PIECES), rate=rate)
    ids, ends = encoder.encode_all(TEXTS * 2, [encoder.key(i) for i in range(2 * len(TEXTS))])
    for i, (text, found) in enumerate(zip(TEXTS * 2, np.split(ids, ends[:-1]), strict=True)):
        assert found.tolist() == [x for one in by_segment(encoder, text, i) for x in one]
        assert merge_dropout.decoded(encoder.pieces, found) == text


def test_a_candidate_is_skipped_at_the_rate():
    encoder = merge_dropout.Encoder(merge_dropout.pieces_of(PIECES))
    draws = [x for doc in range(3000) for x in encoder.segment(" the", encoder.key(doc))[1]]
    assert abs(np.mean(draws) - merge_dropout.RATE) < 0.02
