"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosines, components.

* ``bits`` hyperplanes per table give a vector's bucket.  Bits grow with the logarithm of the number of
  vectors, so buckets stay small; the number of tables follows from the wanted recall of a pair at
  the threshold.  Pairs above it are found with greater certainty.
* Equal vectors are folded first and counted, so a common vector costs one row.
* A bucket of more than ``BLOCK`` vectors is dealt to blocks, and every pair of blocks is a task of
  its own; each is one matrix product in double precision.
* A pair is counted only in the first table in which it meets.  A task returns, for each of its
  vectors, how many others it is linked to and the smallest vector of its component there: rows in
  proportion to the vectors, not to the links.
* Components are closed by distributed rounds of large-star and small-star.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with
nothing; huge and tiny numbers are scaled before they are squared; vectors of different length do not link; equal vectors link with each other; repeated rows
are vectors like others; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from relaylens.llm.common import arrow_rows, written
from relaylens.llm.components import components

COSINE = 0.9
RECALL = 0.999
PER_BUCKET = 128
BLOCK = 1024
SEED = 20240229


def settings(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and tables for ``n`` vectors."""
    bits = max(2, round(math.log2(max(4, n / PER_BUCKET))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _vector(values: list | None, kind: str) -> bytes | None:
    """The numbers of a usable vector, else null."""
    if not values or None in values:
        return None
    v = np.asarray(values, kind)
    return v.tobytes() if np.isfinite(v).all() and v.any() else None


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest number of each is about one.

    That changes no bit of ordinary numbers, and the squares of huge and tiny ones stay in range.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as scaled rows of doubles."""
    x = np.frombuffer(b"".join(vectors), kind).astype(np.float64)
    return scaled(x.reshape(len(vectors), -1))


def _codes(vectors: list[bytes], bits: int, tables: int, kind: str) -> np.ndarray:
    """Bucket codes, one row per vector and one column per table."""
    out = np.empty((len(vectors), tables), np.int64)
    sizes = np.array([len(v) // np.dtype(kind).itemsize for v in vectors])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        x = _matrix([vectors[i] for i in at], kind)
        planes = np.random.default_rng(SEED + size).standard_normal((size, bits * tables))
        signs = (x @ planes > 0).reshape(len(at), tables, bits)
        out[at] = signs @ (1 << np.arange(bits)) * 65536 + size % 65536
    return out


def links(x: np.ndarray, norm: np.ndarray, codes: np.ndarray, table: int, left: np.ndarray,
          right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of ``left`` x ``right`` that are linked and meet first in ``table``."""
    i, j = np.nonzero((x[left] @ x[right].T) >= cosine * norm[left][:, None] * norm[right][None, :])
    i, j = left[i], right[j]
    fresh = i != j
    for t in range(table):
        fresh &= codes[i, t] != codes[j, t]
    return i[fresh], j[fresh]


def _least(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of the component of each of ``n`` rows, by links i, j (both ways)."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            return label
        label = new


def _compare(bits: int, tables: int, cosine: float, kind: str):
    schema = pa.schema([("rep", pa.int64()), ("linked", pa.int64()), ("least", pa.int64())])

    def found(rows: list[tuple]) -> list[tuple]:
        table, one, other = rows[0][0], rows[0][2], rows[0][3]
        vectors = [r[7] for r in rows]
        if len({len(v) for v in vectors}) > 1:
            sizes = sorted({len(v) for v in vectors})
            return [x for s in sizes for x in found([r for r in rows if len(r[7]) == s])]
        x = _matrix(vectors, kind)
        norm = np.sqrt((x * x).sum(axis=1))
        ids, copies = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
        block = np.array([r[4] for r in rows])
        codes = _codes(vectors, bits, tables, kind)
        if one == other:
            everything = np.arange(len(rows))
            i, j = links(x, norm, codes, table, everything, everything, cosine)
            keep = i < j
            i, j = i[keep], j[keep]
        else:
            i, j = links(x, norm, codes, table, np.flatnonzero(block == one),
                         np.flatnonzero(block == other), cosine)
        if not len(i):
            return []
        linked = np.zeros(len(rows), np.int64)
        np.add.at(linked, i, copies[j])
        np.add.at(linked, j, copies[i])
        least = _least(len(rows), i, j, ids)
        at = np.flatnonzero(linked)
        return list(zip(ids[at].tolist(), linked[at].tolist(), least[at].tolist(), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    out += found(held) if len(held) > 1 else []
                    key, held = row[:4], []
                held.append(row)
            yield _batch(out, schema)
        yield _batch(found(held) if len(held) > 1 else [], schema)

    return compare


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def dedup(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for each row."""
    schema = "vec_id long, v binary"
    # Vectors of floats travel as floats and are compared as doubles.
    single = vectors.schema[embedding].dataType == ArrayType(FloatType(), True)
    kind = "<f4" if single else "<f8"
    rows = written(vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("e")).mapInArrow(
        arrow_rows(lambda ids, es: [(i, _vector(e, kind)) for i, e in zip(ids, es, strict=True)], schema),
        schema), "vectors")
    reps = written(rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).groupBy("v").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    bits, tables = settings(reps.count(), cosine)

    def hashed(vs, ids, copies):
        codes = _codes(vs, bits, tables, kind).tolist() if vs else []
        return [(v, i, n, c) for v, i, n, c in zip(vs, ids, copies, codes, strict=True)]

    schema = "v binary, rep long, copies long, codes array<long>"
    dealt = reps.select("v", "rep", "copies").mapInArrow(arrow_rows(hashed, schema), schema).select(
        "v", "rep", "copies", F.posexplode("codes").alias("table", "code"))
    sizes = dealt.groupBy(F.col("table").alias("_table"), F.col("code").alias("_code")).agg(
        F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("members")).where(
        F.col("members") > 1)
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    blocked = dealt.join(sizes, (F.col("table") == F.col("_table")) & (F.col("code") == F.col("_code"))) \
        .withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "table", "code", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "rep", "copies", "v")
    group = ["table", "code", "one", "two"]
    found = written(blocked.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        _compare(bits, tables, cosine, kind), "rep long, linked long, least long"), "links")
    counts = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("linked").alias("linked"))
    parts = components(found.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    known = reps.join(counts, F.col("rep") == F.col("_rep"), "left").join(
        parts, F.col("rep") == F.col("node"), "left").select(
        F.col("v").alias("_v"), F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(known, F.col("v") == F.col("_v"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
