"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if a window that covers
it also starts in a document with a smaller id, judged on the input.

* The minimiser of a window is its run of ``RUN`` words with the smallest hash.  Consecutive windows
  that share a minimiser form a super-k-mer and travel as one packed string of words to the
  bucket of that minimiser.  Equal windows have equal minimisers, so they meet there, and sorting the
  windows of a bucket counts them exactly, by their words.
* Equal texts are folded first: the smallest id stands for all; the other copies lose every word
  that a window covers.  A text is named by its id and a 128-bit digest, so that rows of one id with
  different texts are not taken for each other.
* A first pass counts in how many different texts each minimiser occurs (map-side combined).  Only
  super-k-mers of minimisers that occur in two texts or more are packed and shuffled.
* Minimisers of more than ``HOT`` occurrences would make large buckets.  Their windows travel
  one by one as 128-bit digests and are counted by an ordinary aggregation, which combines before
  the shuffle; the join back is left to the adaptive skew join.  Nothing is dropped.
* Texts are shuffled by id once; both joins that need them read the same exchange.

Defined cases: a null or empty text has no words; a text of fewer than ``WINDOW`` words loses none;
of equal ids none is smaller, whatever their texts; a null id is smaller than none and no id is smaller than it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm import words
from relaylens.llm.common import arrow_rows, written

WINDOW = 50
RUN = 16
HOT = 1000
_SPAN = WINDOW - RUN + 1  # runs in a window
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 22  # windows at a time; places fit in 24 bits
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def split(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def super_kmers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser hash of each super-k-mer of word hashes."""
    firsts, counts, hashes = [], [], []
    for low in range(0, max(0, len(h) - WINDOW + 1), _CHUNK):
        runs = words.runs(h[low:low + _CHUNK + WINDOW - 1], RUN)
        key = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
        size = 1
        while 2 * size <= _SPAN:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < _SPAN:
            key = np.minimum(key[:size - _SPAN], key[_SPAN - size:])
        place = (key & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        firsts.append(first + low)
        counts.append(np.diff(np.append(first, len(place))))
        hashes.append(runs[place[first]].view(np.int64))
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)


def profile(ids: list, bodies: list) -> list[tuple]:
    out = []
    for i, body in zip(ids, bodies, strict=True):
        data = (body or "").encode()
        starts, ends = words.spans(data)
        found = super_kmers(words.hashes(data, starts, ends))[2] if len(starts) >= WINDOW else ()
        out.append((i, hashlib.sha256(data).digest()[:16], len(starts), np.unique(found)))
    return out


def _packed(names: list[str]):
    """mapInArrow: the packed super-k-mers, or single windows, that a document sends to buckets."""
    schema = pa.schema([("bucket", pa.int64()), ("digest", pa.binary()), ("rep", pa.int64()),
                        ("key", pa.binary()), ("starts", pa.list_(pa.int64())), ("windows", pa.int32()),
                        ("packed", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(names.index(n)) for n in ("doc_id", "key", "text", "cold", "hot")}
            rows: list[tuple] = []
            held = 0
            for i, key, body, cold, hot in zip(*(c.to_pylist() for c in at.values()), strict=True):
                data = (body or "").encode()
                starts, ends = words.spans(data)
                first, count, mins = super_kmers(words.hashes(data, starts, ends))
                is_hot = np.isin(mins, hot)
                chosen = np.flatnonzero(is_hot | np.isin(mins, cold)).tolist()
                if not chosen:
                    continue
                parts = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                # What a document repeats travels once, with all its places.
                strings: dict[tuple[int, int, bytes], list[int]] = {}
                digests: dict[bytes, list[int]] = {}
                for k in chosen:
                    f, n = int(first[k]), int(count[k])
                    if not is_hot[k]:
                        packed = b" ".join(parts[f:f + n + WINDOW - 1])
                        strings.setdefault((int(mins[k]), n, packed), []).append(f)
                        continue
                    for w in range(f, f + n):
                        window = hashlib.blake2b(b" ".join(parts[w:w + WINDOW]), digest_size=16)
                        digests.setdefault(window.digest(), []).append(w)
                rows += [(b, None, i, key, places, n, packed) for (b, n, packed), places in strings.items()]
                rows += [(None, d, i, key, places, 1, None) for d, places in digests.items()]
                held += sum(len(packed) for _, _, packed in strings) + 60 * len(digests)
                if held > 1 << 24:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            yield _batch(rows, schema)

    return send


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def repeated(rows: list[tuple[int, bytes, list[int], int, bytes]]) -> list[tuple[int, bytes, int, int]]:
    """(rep, key, first, last) of the windows in one bucket that also start in a smaller document.

    ``rows`` are (rep, key, starts, windows, packed) of one bucket.
    """
    kinds: dict[bytes, list[tuple[int, bytes, list[int], int]]] = {}
    for rep, key, starts, n, packed in rows:
        kinds.setdefault(packed, []).append((rep, key, starts, n))
    if len(kinds) == 1:
        (places,) = kinds.values()
        least = min(place[0] for place in places)
        return [(rep, key, start, start + n - 1) for rep, key, starts, n in places if rep > least
                for start in starts]
    windows: list[tuple[bytes, int, int, int]] = []
    for k, (packed, places) in enumerate(kinds.items()):
        s, e = words.spans(packed)
        s, e, least = s.tolist(), e.tolist(), min(place[0] for place in places)
        windows += [(packed[s[w]:e[w + WINDOW - 1]], least, k, w) for w in range(places[0][3])]
    windows.sort()
    least_at: list[list[int]] = [[0] * places[0][3] for places in kinds.values()]
    before, least = None, 0
    for window, rep, k, w in windows:
        if window != before:
            before, least = window, rep
        least_at[k][w] = least
    out = []
    for places, leasts in zip(kinds.values(), least_at, strict=True):
        for rep, key, starts, n in places:
            w = 0
            while w < n:
                if leasts[w] < rep:
                    first = w
                    while w < n and leasts[w] < rep:
                        w += 1
                    out += [(rep, key, start + first, start + w - 1) for start in starts]
                w += 1
    return out


_RANGES = pa.schema([("rep", pa.int64()), ("key", pa.binary()), ("first", pa.int64()), ("last", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted, one after the other; one is held at a time."""
    bucket, held = None, []
    for batch in batches:
        found: list[tuple[int, bytes, int, int]] = []
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                if len(held) > 1:
                    found += repeated(held)
                bucket, held = b, []
            held.append(tuple(row))
        yield _batch(found, _RANGES)
    yield _batch(repeated(held) if len(held) > 1 else [], _RANGES)


def _cutter(join_untouched: bool):
    def cut(ids, bodies, kept, whole, ranges) -> list[tuple]:
        out = []
        for i, body, k, all_, spans in zip(ids, bodies, kept, whole, ranges, strict=True):
            parts = split(body or "")
            n = len(parts)
            if all_ and n >= WINDOW:
                parts = []
            elif spans:
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, [s["first"] for s in spans], 1)
                np.add.at(change, [s["last"] + WINDOW for s in spans], -1)
                parts = list(compress(parts, (np.cumsum(change[:-1]) == 0).tolist()))
            text = " ".join(parts) if join_untouched or len(parts) < n else body
            out.append((i, n, n - len(parts), text, k))
        return out

    return cut


def _text_key(text: Column) -> Column:
    """The first half of the digest that ``profile`` takes."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _same(rep: str, key: str) -> Column:
    return (F.col("doc_id") == F.col(rep)) & (F.col("key") == F.col(key))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   keep: tuple[str, ...] = (), join_untouched: bool = True) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words, one space apart) and the
    struct ``kept`` of the columns ``keep``.

    Without ``join_untouched`` a text that loses no word is kept as it is.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"), _text_key(F.col(f"`{text}`")).alias("key"),
                       F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("kept"))
    schema = "doc_id long, key binary, n_words int, minimisers array<long>"
    rows = written(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(
        arrow_rows(profile, schema), schema).where(F.col("n_words") >= WINDOW), "minimisers")
    reps = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("minimisers").alias("minimisers"))
    places = reps.select("rep", "key", F.explode("minimisers").alias("bucket"))
    counts = places.groupBy("bucket").agg(
        F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n")).where(
        F.col("least") < F.col("most")).select(F.col("bucket").alias("_bucket"), "n")
    shared = places.join(counts, F.col("bucket") == F.col("_bucket")).groupBy(
        F.col("rep").alias("_rep"), F.col("key").alias("_key")).agg(
        F.collect_set(F.when(F.col("n") <= HOT, F.col("bucket"))).alias("cold"),
        F.collect_set(F.when(F.col("n") > HOT, F.col("bucket"))).alias("hot"))
    sending = docs.join(shared, _same("_rep", "_key"))
    sent = written(sending.mapInArrow(
        _packed(sending.columns), "bucket long, digest binary, rep long, key binary, starts array<long>, "
                                  "windows int, packed binary"), "windows")
    cold = sent.where(F.col("packed").isNotNull()).select("bucket", "rep", "key", "starts", "windows", "packed")
    ranges = cold.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _count, "rep long, key binary, first long, last long")
    hot = sent.where(F.col("digest").isNotNull()).select("digest", "rep", "key", "starts")
    least = hot.groupBy("digest").agg(F.min("rep").alias("least")).withColumnRenamed("digest", "_digest")
    single = hot.join(least, F.col("digest") == F.col("_digest")).where(F.col("least") < F.col("rep")) \
        .select("rep", "key", F.explode("starts").alias("first")).withColumn("last", F.col("first"))
    copies = rows.join(reps.select(F.col("key").alias("_key"), "rep"), F.col("key") == F.col("_key")) \
        .where(F.col("doc_id") > F.col("rep")).select(F.col("doc_id").alias("rep"), "key")
    removed = ranges.unionByName(single).withColumn("whole", F.lit(False)).unionByName(
        copies.withColumn("whole", F.lit(True)), allowMissingColumns=True).groupBy(
        F.col("rep").alias("_rep"), F.col("key").alias("_key")).agg(
        F.max("whole").alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.struct("first", "last"))).alias("ranges"))
    joined = docs.join(removed, _same("_rep", "_key"), "left").select(
        "doc_id", "text", "kept", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")
    schema = ("doc_id long, n_words long, n_removed long, kept_text string, "
              f"kept {docs.schema['kept'].dataType.simpleString()}")
    return joined.mapInArrow(arrow_rows(_cutter(join_untouched), schema), schema)
