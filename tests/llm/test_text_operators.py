"""Packing, language, digests, passages, merge-dropout: odd rows and brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from relaylens.llm import catalog, cross_parsing, merge_dropout, packing, quartile_digest
from relaylens.llm import superkmer_dedup, word_bpe, words

from helpers import clashing, empty, odd_documents, rows
from helpers import words as some_words

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


# --- words ---


def test_spans_and_hashes_follow_the_words():
    text = "  ab c\tab\n\x0bé ab\x1cx "
    data = text.encode()
    starts, ends = words.spans(data)
    found = [data[s:e].decode() for s, e in zip(starts, ends)]
    assert found == re.findall("[^\x20\x09-\x0d]+", text)
    h = words.hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == len(set(found))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data = some_words(500, 1).encode()
    whole = words.hashes(data, *words.spans(data))
    monkeypatch.setattr(words, "_BLOCK", 64)
    assert (words.hashes(data, *words.spans(data)) == whole).all()


# --- op1 ---


def check_packing(found, texts, capacity=packing.CAPACITY):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(catalog.QUERIES["op1_cost_balanced_packing"](spark, SF).collect(), docs) == 0


def test_packing_odd_rows(spark, odd):
    once = odd.dropDuplicates(["doc_id"])
    found = packing.pack(once, BPE).collect()
    assert check_packing(found, {r.doc_id: r.text for r in once.collect()}) == 0
    assert packing.pack(empty(spark), BPE).count() == 0
    assert packing.pack(clashing(spark), BPE).select("doc_id").distinct().count() == 6


def test_packing_takes_the_lowest_cost_sequence():
    pieces = packing.assign([100, 700, 600, 500, 148], 1024)
    assert sorted(p[2] for p in pieces if p[0] == 1) == [700]
    assert {p[3] for p in pieces if p[0] == 1} != {p[3] for p in pieces if p[0] == 2}
    sizes = defaultdict(int)
    for p in pieces:
        sizes[p[3]] += p[2]
    assert sorted(sizes.values()) == [1024, 1024]


@pytest.mark.parametrize("text", [
    "It's Σίσυφος İstanbul don't <|endoftext|>x <|ENDOFTEXT|> 12,34% ﬁ éa Å Ŋ naïve!!?",
    "Ü'LL ab'sd \x1c\x1d x \u2028y \xa0z  \t\n a\x85b", "日本語 text 😀x ß ẞ ÿŸ", "", " ",
    "a" * 100 + " " + "(" * 30 + "word" + ")" * 30,
])
def test_word_ids_equal_the_library(text):
    encoder = word_bpe.Encoder(BPE)
    (got,) = encoder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(
        text, add_special_tokens=False).ids


def test_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(word_bpe, "SLICE", 50)
    text = some_words(200, 9).replace(" k", "\nk")
    assert "".join(word_bpe.slices(text)) == text
    encoder = word_bpe.Encoder(BPE)
    (got,) = encoder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(
        text, add_special_tokens=False).ids


# --- op8 ---


def test_automaton_gives_longest_matches():
    text, query = "abcabxabcd", "abcdabxzzab"
    count = i = 0
    while i < len(query):
        n = 1
        while i + n < len(query) and query[i:i + n + 1] in text:
            n += 1
        count, i = count + 1, i + n
    assert cross_parsing.phrases(cross_parsing.linked(text), query)[0] == count


def test_language_accuracy_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = catalog.QUERIES["op8_cross_parsing_language"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in found)
    held = [r.lang == r.lang_pred for r in found if r.held_out]
    assert sum(held) > 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(spark, odd):
    training = cross_parsing.training_texts(odd)
    found = dict(rows(cross_parsing.identify(odd.where("doc_id is not null"), training),
                      "doc_id", "lang_pred"))
    assert {i for i, lang in found.items() if lang == "und"} == {3, 4, 5, 11}
    assert set(rows(cross_parsing.identify(odd, ()), "lang_pred", "score")) == {("und", 0.0)}
    assert cross_parsing.training_texts(empty(spark)) == ()
    assert cross_parsing.identify(empty(spark), training).count() == 0


# --- op4 ---


def test_digest_query_and_odd_rows(spark, odd):
    def expected(docs):
        n = len(docs)
        for k, (i, text) in enumerate(docs):
            after = docs[(k + 1) % n][1]
            new = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
            digests = [quartile_digest.fingerprint(t) for t in (text, new, after)]
            yield (i, len(text), hashlib.sha256(new.encode()).hexdigest(), *digests[:2],
                   quartile_digest.likeness(*digests[:2]), quartile_digest.likeness(digests[0], digests[2]))

    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
               "near_next")
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert rows(catalog.QUERIES["op4_quartile_digest"](spark, SF), *columns) == sorted(
        expected(docs), key=repr)
    small = sorted(((r.doc_id, r.text or "") for r in odd.collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert rows(quartile_digest.with_edited(odd), *columns) == sorted(expected(small), key=repr)
    assert quartile_digest.with_edited(empty(spark)).count() == 0
    assert quartile_digest.with_edited(clashing(spark)).count() == 6
    assert rows(quartile_digest.fingerprints(odd.where("doc_id = 3")), "doc_id") == [(3,)]


def test_digest_is_bounded():
    texts = ["", "a", "abc", some_words(400, 1), some_words(400, 2)]
    prints = [quartile_digest.fingerprint(t) for t in texts]
    for a in prints:
        assert quartile_digest.likeness(a, a) == 1
        for b in prints:
            assert 0 <= quartile_digest.likeness(a, b) == quartile_digest.likeness(b, a) <= 1


# --- op9 ---


def brute_passages(docs):
    first, out = {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s:s + 50]), i) < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 1])
def test_passages_equal_brute_force(spark, odd, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr(superkmer_dedup, "HOT", hot)

    def found(docs):
        return rows(superkmer_dedup.remove_repeats(docs).withColumn(
            "sha", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "sha")

    known = odd.where("doc_id is not null")
    assert found(known) == brute_passages([(r.doc_id, r.text) for r in known.collect()])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == brute_passages([(r.doc_id, r.text) for r in docs.collect()])


def test_passages_odd_tables(spark, odd):
    assert rows(superkmer_dedup.remove_repeats(odd.where("doc_id is null")), "n_words", "n_removed") == [
        (80, 0)]
    assert superkmer_dedup.remove_repeats(empty(spark)).count() == 0
    kept = superkmer_dedup.remove_repeats(clashing(spark), keep=("key", "rep", "range", "kept"))
    assert rows(kept, "doc_id", "n_removed") == [
        (0, 0), (1, 0), (2, 0), (3, 70), (4, 70), (5, 70)]
    assert kept.select("kept.key", "kept.rep", "kept.range").distinct().count() == 1


def test_super_kmers_cover_all_windows(monkeypatch):
    data = (some_words(400, 1) + " " + "same " * 200).encode()
    h = words.hashes(data, *words.spans(data))
    first, count, mins = superkmer_dedup.super_kmers(h)
    assert first[0] == 0 and (first[1:] == np.cumsum(count)[:-1]).all()
    assert count.sum() == len(h) - superkmer_dedup.WINDOW + 1
    by_window = np.repeat(mins, count)
    monkeypatch.setattr(superkmer_dedup, "_CHUNK", 37)
    _, count, mins = superkmer_dedup.super_kmers(h)
    assert (np.repeat(mins, count) == by_window).all()


# --- op10 ---


ODD_TEXTS = [" ", "  a", "a ", "a  b ", "\n\t x", "日本語😀 ▁x▁", "ab" * 300, "<s> </s> <0x0A> <unk>", "",
             "\x00 \x01é", "a" * 5000]


def test_rate_zero_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    encoder = merge_dropout.Encoder(merge_dropout.pieces_of(PIECES), rate=0.0)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in [*texts, *(t for t in ODD_TEXTS if "▁" not in t)]:
        assert np.frombuffer(encoder.encode(text, 0), np.int32).tolist() == library.encode(text)


def test_dropout_is_lossless_seeded_and_varied(spark, odd):
    pieces = merge_dropout.pieces_of(PIECES)
    for text in ODD_TEXTS:
        for variant in range(3):
            for rate in (0.1, 1.0):
                encoder = merge_dropout.Encoder(pieces, rate=rate)
                ids = np.frombuffer(encoder.encode(text, variant), np.int32)
                assert merge_dropout.decoded(pieces, ids) == text
    text = some_words(50, 1)
    forms = {merge_dropout.Encoder(pieces).encode(text, v) for v in range(8)}
    assert len(forms) == 8
    assert merge_dropout.Encoder(pieces).encode(text, 0) in forms
    assert merge_dropout.Encoder(pieces, seed=8).encode(text, 0) not in forms
    whole = merge_dropout.decode(merge_dropout.encode(odd, PIECES), PIECES, ("doc_id",))
    assert rows(whole, "doc_id", "text") == sorted(
        ((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    assert merge_dropout.encode(empty(spark), PIECES).count() == 0
    assert merge_dropout.encode(clashing(spark), PIECES).count() == 6


def test_dropout_query(spark):
    found = catalog.QUERIES["op10_merge_dropout"](spark, SF).collect()
    assert found and all(r.text_sha256 == r.decoded_sha256 for r in found)
