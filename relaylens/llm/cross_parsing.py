"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language yields the longest match at any position, so a
text can be parsed greedily into phrases that occur in that language's text.  The language that
needs the fewest phrases per character wins.

* Training: the different labelled texts in the order of their hash, at most ``CHARS_PER_DOCUMENT``
  characters from a hashed place of each, until a language has ``CHARS_PER_LANGUAGE``.  This bound is the
  only limit; it makes the automata a broadcast of fixed size (languages x characters).
* Prediction reads every whole text, in lower case.  The segments that are parsed are the runs of
  letters with one space on either side (runs of over 64 letters are cut), so a word's phrase
  counts are a pure function of the word and are remembered in a bounded table per worker.
* Nothing is shuffled but a hash and a length of each labelled text, and the training sample.

Defined cases: a null text or a text without a letter gets ``und`` and score 0; equal phrase
counts go to the language with the larger sum of squared match lengths, then to the smaller
name; without any labelled document every text gets ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.common import arrow_rows
from relaylens.llm.worker import held

UNDECIDED = "und"
CHARS_PER_LANGUAGE = 12_000
CHARS_PER_DOCUMENT = 600
LONGEST_SEGMENT = 64
REMEMBERED = 400_000

LETTERS = re.compile(r"[^\W\d_]+")



def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the empty match."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in step[p]:
            step[p][ch] = new
            p = link[p]
        if p >= 0:
            q = step[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def linked(text: str) -> dict[str, dict]:
    """The automaton as nested dicts: each state maps a character straight to the next state."""
    numbered = automaton(text)
    states: list[dict] = [{} for _ in numbered]
    for state, step in zip(states, numbered, strict=True):
        state.update((ch, states[to]) for ch, to in step.items())
    return states[0]


def phrases(root: dict[str, dict], segment: str) -> tuple[int, int]:
    """Number of greedy phrases of ``segment`` and the sum of their squared lengths.

    A phrase is the longest match from where the one before ended; a character that the
    language's text lacks is a phrase of its own that adds nothing to the squares.
    """
    count = squares = start = 0
    state = root
    for i, ch in enumerate(segment):
        to = state.get(ch)
        if to is None:
            if i > start:
                count += 1
                squares += (i - start) * (i - start)
            start = i
            to = root.get(ch)
            if to is None:
                count += 1
                start, to = i + 1, root
        state = to
    n = len(segment) - start
    return (count + 1, squares + n * n) if n else (count, squares)


class Model:
    """Automata of the languages and what they gave for the words met so far."""

    def __init__(self, training: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in training]
        self.automata = [linked(normalised(text)) for _, text in training]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.costs = np.zeros((1024, 2 * len(self.langs)), np.int64)

    def _learn(self, word: str) -> int:
        if len(self.known) == len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        parts = [f" {run[at:at + LONGEST_SEGMENT]} " for run in LETTERS.findall(word)
                 for at in range(0, len(run), LONGEST_SEGMENT)]
        row = self.known[word] = len(self.known)
        if len(parts) == 1:
            self.costs[row] = [x for root in self.automata for x in phrases(root, parts[0])]
        elif parts:
            self.costs[row] = np.sum([[x for root in self.automata for x in phrases(root, part)]
                                      for part in parts], axis=0)
        return row

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNDECIDED, 0.0
        if len(self.known) > REMEMBERED:
            self._clear()
        words = text.lower().split()
        rows = list(map(self.known.get, words))
        if None in rows:
            rows = [self._learn(w) if (r := self.known.get(w)) is None else r for w in words]
        total = self.costs[rows].sum(axis=0).tolist()
        counts, squares = total[::2], total[1::2]
        order = sorted(range(len(counts)), key=lambda i: (counts[i], -squares[i], self.langs[i]))
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], 1.0 - counts[order[0]] / counts[order[1]]


def normalised(text: str) -> str:
    """Lower case, letters only, words one space apart."""
    return " ".join(LETTERS.findall(text.lower()))


def model_of(training: tuple[tuple[str, str], ...]) -> Model:
    return held(("languages", training), lambda: Model(training))


def training_texts(labelled: DataFrame, chars: int = CHARS_PER_LANGUAGE) -> tuple[tuple[str, str], ...]:
    """(language, text) pairs from a bounded sample of ``labelled`` (lang, text).

    Texts are drawn by a hash, about four times as many as are wanted, so copies of one text count
    once.  Each gives at most ``CHARS_PER_DOCUMENT`` characters from a hashed place on, so a wrong label,
    a very long document or a common beginning weighs little and what reaches the driver is bounded
    whatever the size of the input.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    draw = F.pmod(F.xxhash64("text", F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    part = F.least(F.length("text"), F.lit(CHARS_PER_DOCUMENT))
    place = F.pmod(F.xxhash64("text", F.lit("place")), (F.length("text") - part + 1).cast("long")).cast("int")
    different = usable.groupBy("lang", F.xxhash64("text").alias("_text")).agg(F.max(part).alias("_part"))
    sizes = different.groupBy("lang").agg(F.sum("_part").alias("chars"))
    rates = {r["lang"]: 4.0 * chars / r["chars"] for r in sizes.collect()}
    if not rates:
        return ()
    rate = F.lit(0.0)
    for lang, r in rates.items():
        rate = F.when(F.col("lang") == lang, F.lit(r)).otherwise(rate)
    sample = usable.where(draw < rate).select(
        "lang", draw.alias("draw"), (place > 0).alias("inside"),
        F.col("text").substr(place + 1, F.lit(CHARS_PER_DOCUMENT)).alias("text")).distinct()
    taken: dict[str, list[str]] = {lang: [] for lang in rates}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        piece = row["text"]
        if row["inside"] and piece.strip():  # begins within a word
            piece = piece.split(None, 1)[-1]
        taken[row["lang"]].append(piece.rsplit(None, 1)[0] if piece.strip() else "")
    return tuple((lang, " ".join(parts)[:chars]) for lang, parts in sorted(taken.items()) if parts)


def identify(docs: DataFrame, training: tuple[tuple[str, str], ...],
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for each row; the score is the relative lead in phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(training)

    def rows(ids, bodies):
        model = model_of(shared.value)
        return [(i, *model.judge(body)) for i, body in zip(ids, bodies, strict=True)]

    schema = "doc_id long, lang_pred string, score double"
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")) \
        .mapInArrow(arrow_rows(rows, schema), schema)


def with_language(docs: DataFrame, training: tuple[tuple[str, str], ...],
                  text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``lang_score`` (which replace columns of
    these names), row by row and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(training)

    @F.pandas_udf("struct<lang: string, score: double>")
    def judged(bodies: pd.Series) -> pd.DataFrame:
        model = model_of(shared.value)
        return pd.DataFrame([model.judge(b) for b in bodies], columns=["lang", "score"])

    # Not to be evaluated once for a filter and once more for the columns.
    once = judged.asNondeterministic()
    return docs.withColumn("_found", once(F.col(f"`{text}`"))).withColumns({
        "lang_pred": F.col("_found.lang"), "lang_score": F.col("_found.score")}).drop("_found")
