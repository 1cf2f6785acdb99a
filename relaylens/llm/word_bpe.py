"""Ids of words by byte-pair merges with a word-end mark, many words at a time.

The words of many texts are numbered by Arrow; each different word is encoded or looked up once, and
the ids of the texts are gathered by these numbers.  Runs of letters are merged as one numpy matrix, one
merge per word and step, with the ranks of the tokenizer file; every other word goes to the
tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
from relaylens.llm import words
from relaylens.llm.pair_merges import PAD, PairTable, cut, merge
from relaylens.llm.worker import held, release

REMEMBERED = 3 << 25  # bytes of words, ids and table entries in one period
KEPT = 200_000  # words that stay in the worker between two tasks
SLICE = 1 << 20
TOGETHER = 1 << 22  # characters whose words are numbered together
#: After an ASCII letter these begin a token, whatever follows.
_MARK = np.zeros(256, np.bool_)
_MARK[list(b".,!?;:")] = True
_ENTRY = 180  # bytes of a table entry besides word and ids
LONGEST = 24  # bytes of a run of letters in the matrix
_LETTERS = "a-zß-öø-ɏ"  # lower case, stable under NFC, and letters in every sense
#: Letters with other ASCII marks around; digits and the apostrophe have rules of their own.
_PLAIN = re.compile(f"([!-&(-/:-@\\[-`{{-~]*)([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.uint32)
        self.last = np.array([vocab[s + end] for s in symbols], np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs],
                               list(range(len(pairs))), [vocab[a + b] for a, b in pairs])

    def encode(self, runs: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit bytes, of runs of letters of at most LONGEST bytes."""
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        grid = np.full((len(runs), int(length.max()) + 1), PAD, np.uint32)
        data = np.frombuffer(b"".join(runs), np.uint8)
        grid[np.arange(grid.shape[1]) < length[:, None]] = self.inner[data]
        grid[np.arange(len(runs)), length - 1] = self.last[data[np.cumsum(length) - 1]]
        return cut(merge(self.table, grid))


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, by a tokenizer whose tokens hold no space.

    Words are encoded once and then looked up; the table keeps the words of the last two periods.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.size += len(word) + len(ids) + _ENTRY

    def rest(self) -> None:
        """Between tasks only the words met first, the frequent ones, stay: idle workers hold little."""
        self.older = {}
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))
            self.size = sum(len(w) + len(ids) + _ENTRY for w, ids in self.known.items())
        release()

    def _by_library(self, names: list[str]) -> None:
        for i in range(0, len(names), 4096):
            part = names[i:i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False),
                            strict=True):
                self._keep(w.encode(), array("I", e.ids).tobytes())

    def _new(self, word: bytes) -> bool:
        """Whether the word is still unknown; a word of the older period moves to this one."""
        if word in self.known:
            return False
        ids = self.older.get(word)
        if ids is not None:
            self._keep(word, ids)
        return ids is None

    def _learn(self, unknown: list[bytes]) -> None:
        plain, other, runs = [], set(), {}
        for word in unknown:
            if word.isalpha():  # ASCII letters alone
                data = word.lower()
                if data not in runs and (data == word or self._new(data)):
                    if len(data) > LONGEST:
                        other.add(data.decode())
                    else:
                        runs[data] = None
                if word != data:
                    plain.append((word, b"", data, b""))
                continue
            w = word.decode()
            found = _PLAIN.fullmatch(w.lower())
            if not found or "<|" in w:
                other.add(w)
                continue
            before, run, after = found.groups()
            data = run.encode()
            if data not in runs and self._new(data):
                if len(data) > LONGEST:
                    other.add(run)
                else:
                    runs[data] = None
            other.update(x for x in (before, after) if x and self._new(x.encode()))
            if word != data:
                plain.append((word, before.encode(), data, after.encode()))
        self._by_library(list(other))
        names = sorted(runs, key=len)  # rows of one matrix have about the same length
        for i in range(0, len(names), 8192):
            part = names[i:i + 8192]
            for data, ids in zip(part, self.merges.encode(part), strict=True):
                self._keep(data, ids)
        known = self.known
        for word, before, run, after in plain:
            self._keep(word, (known[before] if before else b"") + known[run] + (known[after] if after else b""))

    def ids_of(self, names: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if self.size > REMEMBERED:
            self.older, self.known, self.size = self.known, {}, 0
        found = list(map(self.known.get, names))
        unknown = [w for w, ids in zip(names, found, strict=True) if ids is None and self._new(w)]
        if unknown:
            self._learn(unknown)
        return [self.known[w] if ids is None else ids for w, ids in zip(names, found, strict=True)]

    def _together(self, bodies: list[str]) -> list[bytes]:
        """Ids of each body: words numbered over all bodies, ids gathered by number."""
        datas = [folded(b).encode() for b in bodies]
        numbers, names, counts = words.numbered(datas, _MARK)
        if not len(numbers):
            return [b""] * len(bodies)
        ids = self.ids_of(names)
        flat = np.frombuffer(b"".join(ids), "<u4")
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.cumsum(length) - length
        many = length[numbers]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(first[numbers] - (ends - many), many)
        out = flat[at].tobytes()
        cuts = [0, *(4 * np.concatenate([[0], ends])[np.cumsum(counts)]).tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, bodies: list[str]) -> Iterator[bytes]:
        """Ids of each body; long texts are cut into slices at white space."""
        few: list[str] = []
        size = 0
        for body in bodies:
            if len(body) > SLICE:
                yield from self._together(few)
                few, size = [], 0
                yield b"".join(x for part in slices(body) for x in self._together([part]))
                continue
            few.append(body)
            size += len(body)
            if size > TOGETHER:
                yield from self._together(few)
                few, size = [], 0
        yield from self._together(few)


def encoder_of(path: str) -> Encoder:
    """The worker's encoder: what it has learned serves the worker's later tasks too."""
    return held(("words", path), lambda: Encoder(path))


def folded(body: str) -> str:
    """Lower case where that changes no id: the tokenizer does it too, but not to special tokens."""
    return body.lower() if body.isascii() and "<|" not in body else body


def slices(body: str) -> Iterator[str]:
    """Parts of at least SLICE characters that end before a space or line end."""
    at = 0
    while at < len(body):
        ends = [e for e in (body.find(" ", at + SLICE), body.find("\n", at + SLICE)) if e >= 0]
        end = min(ends, default=len(body))
        yield body[at:end]
        at = end
