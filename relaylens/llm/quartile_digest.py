"""Document fingerprints: a digest of the quartiles of hashed byte triplets.

Every run of three bytes of the UTF-8 text is hashed into one of ``BUCKETS`` counters.  A counter is
encoded by the quartile of all counters in which it lies (two bits); length and the ratios of the
quartiles go into a header of two bytes.  Two digests differ by the sum of their bucket steps (three
steps count six) plus bounded header differences; ``likeness`` maps that to 0..1, where 0 stands
for what two unrelated digests differ by on average, or more.

Each document is also compared with an edited text that takes its second half from the next document
in ascending order of id.  Documents are dealt to ranges of ids; the document at which a range begins is
sent to the range before it as well, so neighbours meet without any global sort in one task.  Each
range is streamed, two documents at a time, and each text is shuffled once.

Defined cases: a null text is empty, with all counters in the lowest quartile; texts of fewer than three
bytes have no triplets; rows of equal id follow in the order of their texts; null ids come first; a
single row is followed by itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.functions.ranges import range_of
from relaylens.llm.common import texts

BUCKETS = 256
RECORDS_PER_RANGE = 20_000
LEAST_RANGES = 96
_STEPS = np.array([0, 1, 2, 6])
#: Average difference of two independent digests: the mean step, 1.625, per bucket.
BOUND = BUCKETS * 13 // 8
HEADER_BOUND = 24
_BLOCK = 1 << 20


def counts(data: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for low in range(0, max(0, len(data) - 2), _BLOCK):
        b = np.frombuffer(data, np.uint8, min(_BLOCK + 2, len(data) - low), low).astype(np.uint32)
        triplet = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        out += np.bincount(triplet * np.uint32(0x9E3779B1) >> np.uint32(24), minlength=BUCKETS)
    return out


def fingerprint(text: str) -> str:
    """Two header bytes and two bits per bucket, in hexadecimal digits."""
    data = text.encode()
    n = counts(data)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    length = min(255, int(8 * math.log2(len(data) + 1)))
    ratios = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return (bytes([length, ratios]) + packed.tobytes()).hex()


def _codes(digest: str) -> tuple[int, int, np.ndarray]:
    raw = bytes.fromhex(digest)
    b = np.frombuffer(raw, np.uint8, offset=2)
    return raw[0], raw[1], np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6]).astype(np.int8)


def difference(one: str, other: str) -> int:
    """0 for equal digests; at most 6 per bucket plus HEADER_BOUND."""
    (la, ra, a), (lb, rb, b) = _codes(one), _codes(other)
    header = min(abs(la - lb) // 2, HEADER_BOUND // 2) + min(
        abs((ra >> 4) - (rb >> 4)) + abs((ra & 15) - (rb & 15)), HEADER_BOUND // 2)
    return int(_STEPS[np.abs(a - b)].sum()) + header


def likeness(one: str, other: str) -> float:
    return max(0.0, 1.0 - difference(one, other) / BOUND)


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row; no shuffle."""
    from relaylens.llm.common import arrow_rows

    schema = "doc_id long, fingerprint string"
    return texts(docs, doc_id, text).mapInArrow(arrow_rows(
        lambda ids, bodies: [(i, fingerprint(b)) for i, b in zip(ids, bodies, strict=True)],
        schema), schema)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ahead, doc_id, text) in order; those ahead only follow the range's last."""
    before = None  # range, id, text, fingerprint of the row that waits for the next one
    for batch in batches:
        rows = []
        for r, ahead, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            print_ = None
            if before is not None and before[0] == r:
                _, who, own, digest = before
                new = edited(own, text)
                print_, new_print = fingerprint(text), fingerprint(new)
                rows.append((who, len(own), hashlib.sha256(new.encode()).hexdigest(), digest, new_print,
                             likeness(digest, new_print), likeness(digest, print_)))
            before = None if ahead else (r, i, text, print_ or fingerprint(text))
        columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likenesses."""
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    whole = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("known"),
                    F.min("doc_id").alias("least")).first()
    ranges = max(LEAST_RANGES, -(-whole["n"] // RECORDS_PER_RANGE))
    found = ids.agg(F.percentile_approx(
        "doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first()["q"]
    # Splitters are ids of the table; the first range has no splitter.
    splitters = sorted(set(found or []) - {whole["least"]})
    first = None if whole["known"] < whole["n"] else whole["least"]
    docs = texts(docs, doc_id, text).withColumn(
        "range", F.coalesce(range_of(F.col("doc_id"), splitters), F.lit(0)))

    def to(r, ahead):
        return F.struct(r.alias("range"), F.lit(ahead).alias("ahead"))

    places = [to(F.col("range"), 0),
              # A range other than the first begins with its splitter.
              F.when(F.get(F.lit(splitters).cast("array<bigint>"), F.col("range") - 1) == F.col("doc_id"),
                     to(F.col("range") - 1, 1)),
              F.when(F.col("doc_id").eqNullSafe(F.lit(first)), to(F.lit(len(splitters)), 1))]
    dealt = docs.withColumn("to", F.explode(F.array_compact(F.array(*places)))).select(
        "to.range", "to.ahead", "doc_id", "text")
    # One range a task: hashing the numbers would put several into one.
    ordered = dealt.repartitionById(len(splitters) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "ahead", "doc_id", "text")
    return ordered.mapInArrow(_neighbours, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"))
