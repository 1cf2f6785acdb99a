"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words of smallest period ``q`` and at least ``max(LEAST, TIMES * q)``
words that no neighbouring word extends.  The dictionary names every factor of 1, 2, 4 ... words, so
that equal factors have equal names; a name of the next length is a pair of names.

* Per length ``f``, an occurrence whose successor (the next occurrence of the same name) starts at most
  ``2 * f`` words later proposes that distance as a period.  Neighbouring occurrences that propose one
  period form an arithmetic progression of factors, and the stretch they cover has that period.
* A run of period ``q`` is proposed whole by the first ``f >= q``: a factor of ``q`` words or more occurs
  again after exactly ``q`` words, as the first ``q`` words of a run are no power of a shorter word.
  Proposals that cover enough words are extended to both sides, and equal ones are kept once.
* A factor enters the next length only if both its halves occur again in the same document within the
  longest period that fits there, so past the first lengths the dictionary holds little but repeats.
* Documents are worked off ``BATCH_WORDS`` words or one document at a time, with a word of its own between
  two documents, in numpy.  Nothing is shuffled; time is n log n and memory linear in one document.

Defined cases: a null or empty text has no words and no runs; ids and repeated rows play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm import words
from relaylens.llm.superkmer_dedup import split

LEAST, TIMES = 6, 4
BATCH_WORDS = 1 << 18
RUN = "start: bigint, length: bigint, period: bigint"
SCHEMA = (f"n_words long, runs array<struct<{RUN}>>, strongest struct<{RUN}>, collapsed string")


def word_ids(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts, each text followed by a word of its own; number of words of each."""
    names, _, n = words.numbered(datas)
    out = np.empty(len(names) + len(n), np.int64)
    ends = np.cumsum(n + 1) - 1
    apart = np.zeros(len(out), bool)
    apart[ends] = True
    out[~apart] = names
    out[apart] = len(names) + np.arange(len(n))
    return out, n


def successors(names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distance from each place to the next one of the same name; 0 if there is none."""
    order = np.argsort(names, kind="stable")  # places ascend, so they ascend within a name
    same = names[order[1:]] == names[order[:-1]]
    out = np.zeros(len(names), np.int64)
    out[order[:-1][same]] = places[order[1:][same]] - places[order[:-1][same]]
    return out


def proposals(ids: np.ndarray, longest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per factor length: first word, words and period of the stretches that progressions cover.

    ``longest`` is the longest period that a run at each word can have.
    """
    names, places, size = ids, np.arange(len(ids)), 1
    while len(places):
        gap = successors(names, places)
        near = (gap > 0) & (gap <= 2 * size)
        at, step = places[near], gap[near]
        if len(at):
            first = np.flatnonzero(np.concatenate(
                [[True], (at[1:] != at[:-1] + 1) | (step[1:] != step[:-1])]))
            many = np.diff(np.append(first, len(at)))
            period = step[first]
            length = many - 1 + size + period
            enough = length >= np.maximum(LEAST, TIMES * period)
            yield at[first][enough], length[enough], period[enough]
        again = np.flatnonzero((gap > 0) & (gap <= longest[places]))
        follows = np.zeros(len(places), bool)
        follows[again] = True
        follows[np.searchsorted(places, places[again] + gap[again])] = True
        names, places = names[follows], places[follows]
        second = np.searchsorted(places, places + size)
        whole = second < len(places)
        whole[whole] = places[second[whole]] == places[whole] + size
        pairs = names[whole] * (np.int64(names.max(initial=0)) + 1) + names[second[whole]]
        names, places = np.unique(pairs, return_inverse=True)[1], places[whole]
        size *= 2


def extended(ids: np.ndarray, start: int, length: int, period: int) -> tuple[int, int]:
    """The longest stretch of the period around a stretch of it."""
    low, high, step = start, start + length, 64
    while low > 0:
        n = min(step, low)
        same = ids[low - n:low] == ids[low - n + period:low + period]
        tail = n if same.all() else int(same[::-1].argmin())
        low -= tail
        if tail < n:
            break
        step *= 2
    step = 64
    while high < len(ids):
        n = min(step, len(ids) - high)
        same = ids[high:high + n] == ids[high - period:high + n - period]
        head = n if same.all() else int(same.argmin())
        high += head
        if head < n:
            break
        step *= 2
    return low, high - low


def runs(ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period, of the texts of ``word_ids``."""
    found: set[tuple[int, int, int]] = set()
    for starts, lengths, periods in proposals(ids, np.repeat(counts // TIMES, counts + 1)):
        for start, length, period in zip(starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
            if (start, length, period) not in found:
                found.add((*extended(ids, start, length, period), period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones the first, then the one of least period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(parts: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run covers after its first period."""
    change = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [parts[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text (as struct ``row``), ``n_words``, ``runs``, the ``strongest``
    run and ``collapsed``: the text's words that remain, one space apart."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    docs = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != text))
                       .alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def work(rows: pa.Array, bodies: list[str]) -> pa.RecordBatch:
        ids, n = word_ids([b.encode() for b in bodies])
        own: list[list[tuple[int, int, int]]] = [[] for _ in bodies]
        ends = np.cumsum(n + 1)
        for start, length, period in runs(ids, n):
            d = int(np.searchsorted(ends, start, "right"))
            own[d].append((start - int(ends[d] - n[d] - 1), length, period))
        out = []
        for body, mine, count in zip(bodies, own, n.tolist(), strict=True):
            named = [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine]
            best = strongest(mine)
            out.append((count, named, best and named[mine.index(best)],
                        " ".join(collapsed(split(body), mine) if mine else split(body))))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), found, strict=True)]
        return pa.RecordBatch.from_arrays([rows, *columns], names=["row", *found.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, low, held = batch.column(1).to_pylist(), 0, 0
            for k, body in enumerate(bodies):
                held += len(body)
                if held >= 6 * BATCH_WORDS or k + 1 == len(bodies):
                    yield work(batch.column(0).slice(low, k + 1 - low), bodies[low:k + 1])
                    low, held = k + 1, 0

    return docs.mapInArrow(search, f"row {docs.schema['row'].dataType.simpleString()}, {SCHEMA}")
