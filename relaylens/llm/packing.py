"""Cost-balanced packing of tokenised documents into training sequences.

A document of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n``.  Documents go in descending
order of cost to the sequence of lowest cost that has room for them.  Where no sequence has room
for the whole rest, the document is cut at the room of the lowest-cost sequence that is not full.

* Each input partition packs its own documents in blocks of at most ``BLOCK_TOKENS`` tokens, so
  no text is shuffled, memory is bounded and a lost task is simply run again.
* A block fills whole sequences; what is left, fewer than ``capacity`` tokens of its smallest documents,
  goes to the partition's next block.
* The tails of the partitions, fewer than ``capacity`` tokens each, meet in a second, small shuffle, about
  ``TAILS`` of them in a group, and are packed by the same routine.  At the end of a group the rest
  goes to one sequence per power of two in its binary form, so nothing is padded at all.
* Documents of ``capacity`` tokens or more first fill whole sequences; the rest is packed.
* Words are tokenised once per worker and then looked up (a bounded table): the tokenizer drops
  white space and no token crosses it, so splitting at white space changes no id.

Defined cases: a null or empty text is the end token alone; a null id stays null; repeated rows
are packed as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.common import texts, written
from relaylens.llm.word_bpe import encoder_of

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 512
BLOCK_TOKENS = 1 << 21
TAILS = 1024
ROWS = 1000  # of a batch whose words are numbered together
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, cost double")


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], capacity: int, last: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of the given lengths.

    The sequences have ``capacity`` tokens or a power of two, and all are full.  If more documents follow,
    all have ``capacity`` tokens, and what is left has sequence -1.
    """
    pieces, rest = [], []
    opened = 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for i in range(whole):
            pieces.append((d, i * capacity, capacity, opened, 0))
            opened += 1
        if n % capacity:
            rest.append((n % capacity, d))
    total = sum(n for n, _ in rest)
    sizes = [capacity] * (total // capacity)
    if last:
        sizes += [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, spent = np.asarray(sizes, np.int64), np.zeros(len(sizes))
    size = room.copy()
    left = int(room.sum())
    for n, d in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[d] - n
        while n:
            if not left:
                pieces.append((d, start, n, -1, 0))
                break
            fits = np.where(room >= n, spent, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, spent, np.inf).argmin())
            part = min(n, int(room[s]))
            pieces.append((d, start, part, opened + s, int(size[s] - room[s])))
            room[s] -= part
            left -= part
            spent[s] += cost(part)
            start, n = start + part, n - part
    return pieces


class _Packer:
    """Packs pieces in blocks; ``base`` is the first sequence number."""

    def __init__(self, base: int, capacity: int):
        self.base, self.capacity = base, capacity
        self.pieces: list[tuple] = []  # doc_id, start, tokens of the document, ids as bytes
        self.held = 0

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: bytes) -> None:
        self.pieces.append((doc_id, start, doc_tokens, ids))
        self.held += len(ids) // 4

    def flush(self, last: bool) -> pa.RecordBatch:
        """The rows of whole sequences; what is left stays held."""
        rows, costs, kept = [], {}, []
        for d, at, n, s, offset in assign([len(p[3]) // 4 for p in self.pieces], self.capacity, last):
            doc_id, start, doc_tokens, ids = self.pieces[d]
            own = memoryview(ids)[4 * at:4 * (at + n)]
            if s < 0:
                kept.append((doc_id, start + at, doc_tokens, bytes(own)))
                continue
            costs[s] = costs.get(s, 0.0) + cost(n)
            rows.append((doc_id, start + at, n, zlib.crc32(own), doc_tokens, s, offset))
        out = [(*r[:5], self.base + r[5], r[6], costs[r[5]], None) for r in rows]
        self.base += len(costs)
        self.pieces, self.held = kept, sum(len(p[3]) for p in kept) // 4
        return _batch(out)


_ROWS = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64())
                   for c in SCHEMA.split(", ")] + [("ids", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ROWS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document; ``sequence_id`` is unique over the whole result."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        packer, encoder = _Packer(partition << 40, capacity), encoder_of(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                which, bodies = (c.to_pylist() for c in batch.slice(at, ROWS).columns)
                for i, data in zip(which, encoder.encode(bodies), strict=True):
                    packer.add(i, 0, len(data) // 4 + 1, data + end)
                    if packer.held >= BLOCK_TOKENS:
                        yield packer.flush(last=False)
        encoder.rest()
        yield packer.flush(last=False)
        yield _batch([(i, start, len(ids) // 4, None, n, partition, None, None, ids)
                      for i, start, n, ids in packer.pieces])

    def packed_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer((1 << 62) + (TaskContext.get().partitionId() << 40), capacity)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packer.add(*row)
                if packer.held >= BLOCK_TOKENS:
                    yield packer.flush(last=False)
        yield packer.flush(last=True)

    schema = f"{SCHEMA}, ids binary"
    first = written(texts(docs, doc_id, text).mapInArrow(packed, schema), "pieces")
    whole, tails = first.where(F.col("ids").isNull()), first.where(F.col("ids").isNotNull())
    groups = -(-tails.agg(F.count_distinct("sequence_id")).first()[0] // TAILS)
    if groups:
        dealt = tails.select("doc_id", "start", "doc_tokens", "ids", F.pmod(
            F.xxhash64("sequence_id"), F.lit(groups)).alias("group")).repartition(groups, "group")
        whole = whole.unionByName(dealt.sortWithinPartitions("doc_id", "start").drop("group").mapInArrow(
            packed_tails, schema))
    return whole.drop("ids")
