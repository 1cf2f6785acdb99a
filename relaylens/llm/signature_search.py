"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature is a Bloom filter of its terms, one entry for each power of two up to which a
term occurs.  Signatures of up to ``SHARD`` documents of like size are stored bit by bit: one
bitmap over the documents (a slice) for each bit.  The slices of a term, and-ed, mark every document that
holds it, and some that do not.  So the slices, weighted by what the term can add at most, sum
to an upper bound of each score.  Documents are scored exactly, from their own terms, in descending
order of the bound, until it falls below the tenth score found; no other document can rank.

* ``index`` reads the documents once and writes one row per shard: slices, ids, lengths and the
  folded texts for exact scores.  The index holds nothing of the queries and can serve many searches.
* A search reads the index twice: once for the document frequencies of its terms, once for the scores.
  A hashed sixteenth of the shards is searched before; its tenth score of each item is a lower bound of
  the final tenth score and starts every task.  Nothing but the best rows of a task is shuffled.
* Items are searched in blocks of about ``ITEMS`` items or ``ITEM_BYTES`` bytes, so a block's terms and
  weights, which go to every task, are bounded.
* Bounds never fall short of the score: a hash that two terms share only raises a count.

Defined cases: a null or empty text has no terms and never ranks; an item without terms has no rows; rows
of one item id are one item; rows of one document id are documents of their own; a null document id comes
after all others of equal score; empty tables give no rows.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaylens.llm import words
from relaylens.llm.common import written
from relaylens.session import remove_folder, shared_dir

TOP = 10
LEVELS = 5  # occurrences 1, 2, 4, 8, 16
HASHES = 4
BITS_PER_ENTRY = 8  # at least; the number of bits is a power of two
SHARD = 512
SHARD_BYTES = 3 << 17  # rows stay below half a heap region of a small executor
SHARD_CELLS = 1 << 25
TERMS = 4096  # terms whose bitmaps are unpacked at a time
ITEMS, ITEM_BYTES = 512, 1 << 18
PROBE = 16  # one shard in so many is searched first
_SALTS = [np.uint64((0xD6E8FEB86659FD93 * (j + 1)) % (1 << 64)) for j in range(LEVELS)]
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_LAST = 1 << 63  # in the place of a null id
INDEX = ("shard long, bits int, ids array<long>, lengths array<long>, slices binary, "
         "texts array<binary>")
_INDEX = pa.schema([
    ("shard", pa.int64()), ("bits", pa.int32()), ("ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("slices", pa.binary()), ("texts", pa.list_(pa.binary()))])


def folded(text: bytes) -> bytes:
    """A-Z lower-cased, every byte outside of terms a space; ``split()`` gives the terms."""
    return text.translate(_FOLD)


def entries(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash per term and level that its count reaches."""
    with np.errstate(over="ignore"):
        return np.concatenate([words.mix(hashes[counts >= 1 << j] + _SALTS[j]) for j in range(LEVELS)])


def slots(entry: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each entry in a signature of 2**bits bits."""
    step = (entry >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        all_ = entry[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (all_ & np.uint64((1 << bits) - 1)).astype(np.int64)


def sliced(documents: list[np.ndarray], bits: int) -> bytes:
    """Signatures of documents, given by their entries, as 2**bits bitmaps over the documents."""
    width = -(-len(documents) // 8) * 8
    cells = np.zeros((1 << bits, width), np.bool_)
    for d, entry in enumerate(documents):
        cells[slots(entry, bits).ravel(), d] = True
    return np.packbits(cells, axis=1).tobytes()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def row(bits: int, docs: list[tuple]) -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, lengths, entry, texts = zip(*docs, strict=True)
        values = [number, bits, list(ids), list(lengths), sliced(entry, bits), list(texts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, _INDEX, strict=True)], schema=_INDEX)

    for batch in batches:
        classes: dict[int, list[tuple]] = {}
        held: Counter = Counter()
        for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = folded(text)
            starts, ends = words.spans(data)
            if not len(starts):
                continue
            entry = entries(*np.unique(words.hashes(data, starts, ends), return_counts=True))
            bits = max(6, (BITS_PER_ENTRY * len(entry) - 1).bit_length())
            docs = classes.setdefault(bits, [])
            if docs and (held[bits] + len(data) > SHARD_BYTES or len(docs) >= SHARD
                         or (len(docs) + 1) << bits > SHARD_CELLS):
                yield row(bits, docs)
                docs.clear()
                held[bits] = 0
            docs.append((i, len(starts), entry, data))
            held[bits] += len(data)
        for bits, docs in classes.items():
            if docs:
                yield row(bits, docs)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard of documents with terms (INDEX); not yet written."""
    return docs.select(F.col(f"`{doc_id}`").cast("long"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).mapInArrow(_shards, INDEX)


def gain(count, mass):
    """What a term adds per unit of weight, by its occurrences and the document's mass."""
    return 1_000_000_000 * count // (1000 * count + 8 * mass)


def mass(length: int, documents: int, total: int) -> int:
    return 100 - 90 + 90 * length * documents // total


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Searcher:
    """Best documents of a block of items among the shards shown to it."""

    terms: list[bytes]
    weights: list[int]
    items: list[list[int]]  # of each item its terms, ascending
    documents: int
    total: int
    #: Of each item its documents so far: (-score, id), ascending.
    best: list[list[tuple[int, int]]]
    #: Of each item a (-score, id) that TOP documents of the table are known to reach.
    reached: list[tuple[int, int]]
    scored: int = 0
    hashes: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.place = {t: k for k, t in enumerate(self.terms)}
        data = b" ".join(self.terms)
        plain = words.hashes(data, *words.spans(data))
        with np.errstate(over="ignore"):
            self.hashes = [words.mix(plain + salt) for salt in _SALTS]
        self.of_item = [np.asarray(t, np.int64) for t in self.items]
        self.factor = [np.asarray([self.weights[k] for k in t], np.float64) for t in self.items]

    def bounds(self, bits: int, slices: bytes, lengths: list[int], masses: list[int]) -> np.ndarray:
        """Upper bounds of the scores, items by documents."""
        n = len(lengths)
        rows = np.frombuffer(slices, np.uint8).reshape(1 << bits, -1)
        most = [[gain(min(2 ** (j + 1) - 1, c) if j + 1 < LEVELS else c, m)
                 for c, m in zip(lengths, masses, strict=True)] for j in range(LEVELS)]
        steps = np.diff(np.asarray(most, np.float64), axis=0, prepend=0)
        out = np.zeros((len(self.items), n))
        for low in range(0, len(self.terms), TERMS):
            high = min(low + TERMS, len(self.terms))
            worth = np.zeros((high - low, n))
            held, marks = np.arange(high - low), None
            for j in range(LEVELS):
                at = slots(self.hashes[j][low + held], bits)
                found = rows[at[:, 0]]
                for k in range(1, HASHES):
                    found &= rows[at[:, k]]
                if marks is not None:
                    found &= marks
                some = found.any(axis=1)
                held, marks = held[some], found[some]
                if not len(held):
                    break
                worth[held] += np.unpackbits(marks, axis=1, count=n) * steps[j]
            for q, (terms, factor) in enumerate(zip(self.of_item, self.factor, strict=True)):
                a, b = np.searchsorted(terms, (low, high))
                if a < b:
                    out[q] += factor[a:b] @ worth[terms[a:b] - low]
        return out * (1 + 1e-12) + 0.5  # above all rounding

    def score(self, item: int, counts: dict[int, int], m: int) -> int:
        return sum(self.weights[k] * gain(counts[k], m) for k in self.items[item] if k in counts)

    def shard(self, bits: int, ids: list, lengths: list[int], slices: bytes, texts: list[bytes]) -> None:
        masses = [mass(n, self.documents, self.total) for n in lengths]
        bounds = self.bounds(bits, slices, lengths, masses)
        counted: dict[int, dict[int, int]] = {}
        worst = np.asarray([max(1, -r[0]) for r in self.reached], np.float64)
        for q in np.flatnonzero((bounds >= worst[:, None]).any(axis=1)).tolist():
            best = self.best[q]
            for d in np.argsort(-bounds[q], kind="stable").tolist():
                if bounds[q, d] < max(1, -self.reached[q][0]):
                    break
                if d not in counted:
                    counted[d] = Counter(k for k in map(self.place.get, texts[d].split()) if k is not None)
                value = self.score(q, counted[d], masses[d])
                self.scored += 1
                found = (-value, _LAST if ids[d] is None else ids[d])
                if value > 0 and found <= self.reached[q]:
                    bisect.insort(best, found)
                    if len(best) >= TOP:
                        del best[TOP:]
                        self.reached[q] = min(self.reached[q], best[-1])


def _frequencies(shards: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    wanted = set(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for row in batch.column(0):
                for text in row.as_py():
                    found.update(wanted.intersection(text.split()))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary()),
                                          "n": pa.array(list(found.values()), pa.int64())})

    rows = shards.select("texts").mapInArrow(count, "term binary, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()  # at most the terms of one block of items
    return {bytes(r["term"]): r["n"] for r in rows}


def _best(shards: DataFrame, items: list[tuple], searcher: dict) -> DataFrame:
    """item (place in the block), doc_id and score: the best of each task."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Searcher(**searcher, best=[[] for _ in items])
        for batch in batches:
            for k in range(batch.num_rows):
                found.shard(*(c[k].as_py() for c in batch.columns))
        rows = [(q, None if i == _LAST else i, -s) for q, b in enumerate(found.best) for s, i in b]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = shards.select("bits", "ids", "lengths", "slices", "texts").mapInArrow(
        search, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _search_block(shards: DataFrame, items: list[tuple], documents: int, total: int) -> DataFrame:
    """``items``: (item_id, its terms) of one block."""
    spark = shards.sparkSession
    terms = sorted(set().union(*(t for _, t in items)))
    holding = _frequencies(shards, terms)
    terms = [t for t in terms if t in holding]
    place = {t: k for k, t in enumerate(terms)}
    searcher = {
        "terms": terms, "weights": [weight(documents, holding[t]) for t in terms],
        "items": [sorted(place[t] for t in own if t in place) for _, own in items],
        "documents": documents, "total": total, "reached": [(0, _LAST)] * len(items)}
    probe = _best(shards.where(F.pmod(F.xxhash64("shard"), F.lit(PROBE)) == 0), items, searcher)
    reached = list(searcher["reached"])
    for r in probe.where(F.col("rank") == TOP).collect():  # one row per item
        reached[r["item"]] = (-r["score"], _LAST if r["doc_id"] is None else r["doc_id"])
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return _best(shards, items, {**searcher, "reached": reached}).join(F.broadcast(ids), "item").select(
        "item_id", "rank", "doc_id", "score")


def search(shards: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the best documents of a written index."""
    spark = shards.sparkSession
    sums = shards.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    queries = queries.select(F.col(f"`{item_id}`").cast("long").alias("item_id"),
                             F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // ITEMS), -(-(size["bytes"] or 0) // ITEM_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks if sums["n"] else 0):
        own: dict[int | None, set[bytes]] = {}
        for r in queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect():
            own.setdefault(r["item_id"], set()).update(folded(bytes(r["text"])).split())
        items = [(i, t) for i, t in own.items() if t]
        if items:
            out = out.unionByName(_search_block(shards, items, sums["n"], sums["terms"]))
    return out


def rank(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index, search and removal of the index; the result is a table of at most TOP rows per item."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_dir(spark)}/signatures-{uuid.uuid4().hex}"
    index(docs, doc_id, text).write.option("parquet.block.size", 32 << 20).parquet(path)
    out = written(search(spark.read.parquet(path), queries, item_id, item_text), "ranked")
    remove_folder(spark, path)
    return out
