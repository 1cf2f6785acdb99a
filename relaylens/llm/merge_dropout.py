"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A segment (spaces and the word after them) starts as characters.  An agenda holds the adjacent pairs that
form a piece, best score first, leftmost first among equals.  Each candidate taken from the agenda is
skipped if a hash of (seed, document id, place of the segment in the document, number of candidates taken
before) falls under the dropout rate, else merged.  So the same document is always segmented alike, and
every occurrence of a word, in one document or in many, has draws of its own.  With rate 0 the
ids are those of the sentencepiece library.

* Row by row, without a shuffle.  The agendas of many segments advance together, as rows of a matrix.
* A segment's ids depend on the segment and its draws alone.  Each worker remembers them as a tree per
  segment, with a branch for each draw: an occurrence follows its draws, and where it leaves what is known its
  agenda runs and adds the branch.  The trees are bounded in size and forgotten beyond it;
  segments met once or longer than ``LONGEST`` are not remembered.  No result depends on what is remembered.
* Characters without a piece become their UTF-8 bytes, also the mark that stands for a space, so
  decoding gives back every text.

Defined cases: a null text is empty and has no ids; a null id draws by its text; rows of one id share their
draws; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm.common import texts
from relaylens.llm.pair_merges import PAD, PairTable, merge
from relaylens.llm.words import mix

RATE = 0.1
SEED = 7
REMEMBERED = 200_000  # segments
NODES = 3_000_000  # draws in all their trees
LONGEST = 32  # characters of a segment in the matrix
_MET = 1 << 22
_GROUP = 1 << 21
_CHUNK = 1 << 18
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


class Pieces:
    """The vocabulary of a model file, with a space in place of its mark."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes = [0] * 256
        self.ids: dict[str, int] = {}
        self.ranks: dict[str, tuple[float, int]] = {}
        parts: list[bytes] = []  # what each id stands for; nothing for a control symbol
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                parts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                parts.append(b"")
            else:
                piece = piece.replace("▁", " ")
                self.ids[piece] = i
                self.ranks[piece] = (-model.get_score(i), i)
                parts.append(piece.encode())
        self.bytes_of = np.frombuffer(b"".join(parts), np.uint8)
        self.size_of = np.fromiter(map(len, parts), np.int32, len(parts))
        self.start_of = np.cumsum(self.size_of, dtype=np.int32) - self.size_of
        # Symbol of each character: its piece, or its byte; PAD if it takes several bytes.
        self.symbols = np.full(0x110000, PAD, np.uint32)
        self.symbols[:128] = self.bytes[:128]
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        order = {score: k for k, score in enumerate(sorted({score for score, _ in self.ranks.values()}))}
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], order[score], i) for p, (score, i) in self.ranks.items()
                 for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.table = PairTable(*map(list, zip(*pairs, strict=True)))


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """``array`` with place for ``n`` values at least; new ones are 0."""
    if len(array) >= n:
        return array
    return np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Encoder:
    def __init__(self, pieces: Pieces, rate: float = RATE, seed: int = SEED):
        self.pieces, self.base = pieces, mixed(seed + 1)
        self.limit = int(rate * (1 << 64))
        self.met, self.n_met = bytearray(_MET), 0
        self._forget()

    def _forget(self) -> None:
        # Node k has the values 2k (merged) and 2k + 1 (skipped): the next node, ~leaf, or 0 if not
        # known.  The tree of a segment starts at a value of its own.
        self.starts: dict[str, int] = {}
        self.refs, self.n_nodes = np.zeros(1 << 12, np.int32), 1
        self.leaf_start, self.leaf_size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.n_leaves, self.n_ids = np.zeros(1 << 12, np.int32), 0, 0

    def key(self, doc_id: int | None, digest: bytes = b"") -> int:
        """The key of all draws of a document."""
        if doc_id is None:
            return mixed(mixed(self.base + 1 & _MASK) ^ int.from_bytes(digest[:8], "big"))
        return mixed(self.base ^ doc_id & _MASK)

    def _skipped(self, keys: np.ndarray, step: int) -> np.ndarray:
        if self.limit > _MASK:
            return np.ones(len(keys), bool)
        with np.errstate(over="ignore"):
            return mix(keys + np.uint64((step + 1) * _STEP & _MASK)) < np.uint64(self.limit)

    def segment(self, segment: str, key: int) -> tuple[list[int], list[bool]]:
        """Ids of a segment, and whether each candidate taken was skipped."""
        ranks, limit = self.pieces.ranks, self.limit
        symbols: list[str] = list(segment)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        draws: list[bool] = []
        for at in range(n - 1):
            pair = symbols[at] + symbols[at + 1]
            rank = ranks.get(pair)
            if rank is not None:
                agenda.append((rank[0], at, pair))
        heapify(agenda)
        while agenda:
            _, at, pair = heappop(agenda)
            right = after[at]
            if right >= n or not symbols[at] or symbols[at] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            draws.append(mixed(key + (len(draws) + 1) * _STEP & _MASK) < limit)
            if draws[-1]:
                continue
            symbols[at], symbols[right] = pair, ""
            after[at] = right = after[right]
            if right < n:
                before[right] = at
                new = pair + symbols[right]
                rank = ranks.get(new)
                if rank is not None:
                    heappush(agenda, (rank[0], at, new))
            left = before[at]
            if left >= 0:
                new = symbols[left] + pair
                rank = ranks.get(new)
                if rank is not None:
                    heappush(agenda, (rank[0], left, new))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.pieces.ids.get(s)
                if i is None:
                    out += [self.pieces.bytes[b] for b in s.encode()]
                else:
                    out.append(i)
        return out, draws

    def _agendas(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segments under their draws; short ones of known characters as one matrix.

        In the order of the first array, which has the numbers of the words: the new leaf and the number of
        draws of each, and all draws.
        """
        order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
        rows, sizes, ids, taken, draws = [], [], [], [], []
        for low in range(0, len(order), 8192):
            part = order[low:low + 8192]
            segments = [f" {words[k]}" for k in part.tolist()]
            length = np.fromiter(map(len, segments), np.int64, len(segments))
            symbols = self.pieces.symbols[np.frombuffer(
                "".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
            plain = np.minimum.reduceat(symbols != PAD, np.cumsum(length) - length) & (length <= LONGEST)
            for k in np.flatnonzero(~plain).tolist():
                found, drawn = self.segment(segments[k], int(keys[part[k]]))
                rows.append(part[k:k + 1])
                sizes.append(np.array([len(found)]))
                ids.append(np.array(found, np.int32))
                taken.append(np.array([len(drawn)]))
                draws.append(np.array(drawn, bool))
            if not plain.any():
                continue
            symbols = symbols[np.repeat(plain, length)]
            part, length = part[plain], length[plain]
            grid = np.full((len(part), int(length.max()) + 1), PAD, np.uint32)
            grid[np.arange(grid.shape[1]) < length[:, None]] = symbols
            own, log = keys[part], []

            def skip(at, own=own, log=log):
                log.append((at, self._skipped(own[at], len(log))))
                return log[-1][1]

            grid = merge(self.pieces.table, grid, skip)
            drawn, steps = np.zeros((len(part), len(log)), bool), np.zeros(len(part), np.int64)
            for step, (at, skipped) in enumerate(log):
                drawn[at, step] = skipped
                steps[at] = step + 1
            rows.append(part)
            sizes.append((grid != PAD).sum(axis=1))
            ids.append(grid[grid != PAD].astype(np.int32))
            taken.append(steps)
            draws.append(drawn[np.arange(len(log)) < steps[:, None]])
        size, new = np.concatenate(sizes), np.concatenate(ids)
        leaves = np.arange(self.n_leaves, self.n_leaves + len(size))
        self.leaf_start = _room(self.leaf_start, self.n_leaves + len(size))
        self.leaf_size = _room(self.leaf_size, self.n_leaves + len(size))
        self.ids = _room(self.ids, self.n_ids + len(new))
        self.leaf_start[leaves] = self.n_ids + np.cumsum(size) - size
        self.leaf_size[leaves] = size
        self.ids[self.n_ids:self.n_ids + len(new)] = new
        self.n_leaves += len(size)
        self.n_ids += len(new)
        return np.concatenate(rows), leaves, np.concatenate(taken), np.concatenate(draws)

    def _grow(self, words: list[str], keys: np.ndarray, edges: np.ndarray, depths: np.ndarray) -> None:
        """Adds the rest of the way of each word below its edge, a value that is not known yet."""
        rows, leaves, taken, draws = self._agendas(words, keys)
        edges, depths = edges[rows], depths[rows]
        new = taken - depths
        ends = np.cumsum(new)
        first, total = self.n_nodes, int(new.sum())
        self.refs = _room(self.refs, 2 * (first + total))
        nodes = np.arange(first, first + total)
        self.refs[edges] = np.where(new > 0, first + ends - new, ~leaves)
        values = nodes + 1
        values[ends[new > 0] - 1] = ~leaves[new > 0]
        self.refs[2 * nodes + draws[_spread(np.cumsum(taken) - taken + depths, new)]] = values
        self.n_nodes += total

    def _walk(self, words: list[str], keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The leaf of each word whose tree starts at a place of its own."""
        out, todo = np.empty(len(starts), np.int64), np.arange(len(starts))
        while len(todo):
            who, at, step, lost = todo, starts[todo], 0, []
            while len(who):
                ref = self.refs[at]
                done, miss = ref < 0, ref == 0
                out[who[done]] = ~ref[done]
                if miss.any():
                    lost.append((who[miss], at[miss], np.full(int(miss.sum()), step)))
                go = ref > 0
                who = who[go]
                at = 2 * ref[go].astype(np.int64) + self._skipped(keys[who], step)
                step += 1
            if not lost:
                break
            todo, edges, depths = map(np.concatenate, zip(*lost, strict=True))
            edges, one = np.unique(edges, return_index=True)
            chosen = todo[one]
            self._grow([words[k] for k in chosen.tolist()], keys[chosen], edges, depths[one])
        return out

    def _start(self, word: str) -> int:
        """Where the tree of a word starts; -1 if the word is not remembered."""
        start = self.starts.get(word, -1)
        if start >= 0 or len(word) >= LONGEST:
            return start
        at = hash(word) % _MET
        if not self.met[at]:
            self.met[at] = 1
            self.n_met += 1
            return -1
        start = self.starts[word] = 2 * self.n_nodes
        self.n_nodes += 1
        return start

    def _chunk(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if len(self.starts) > REMEMBERED or self.n_nodes > NODES:
            self._forget()
        if self.n_met > _MET // 2:
            self.met, self.n_met = bytearray(_MET), 0
        starts = np.fromiter(map(self.starts.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(starts < 0)
        starts[new] = [self._start(words[k]) for k in new.tolist()]
        self.refs = _room(self.refs, 2 * self.n_nodes)
        leaves = np.empty(len(words), np.int64)
        kept, once = np.flatnonzero(starts >= 0), np.flatnonzero(starts < 0)
        leaves[kept] = self._walk([words[k] for k in kept.tolist()] if len(once) else words,
                                  keys[kept], starts[kept])
        n_leaves, n_ids = self.n_leaves, self.n_ids
        if len(once):
            rows, found, _, _ = self._agendas([words[k] for k in once.tolist()], keys[once])
            leaves[once[rows]] = found
        sizes = self.leaf_size[leaves]
        out = self.ids[_spread(self.leaf_start[leaves], sizes)]
        self.n_leaves, self.n_ids = n_leaves, n_ids
        return out, sizes

    def encode_all(self, texts_: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts under the keys of their documents, and the end of each text."""
        ids, counts = [np.empty(0, np.int32)], np.zeros(len(texts_), np.int64)
        low = 0
        while low < len(texts_):
            high, size, words, lengths = low, 0, [], []
            while high < len(texts_) and (high == low or size < _GROUP):
                found = split(texts_[high]) if texts_[high] else []
                words += found
                lengths.append(len(found))
                size += len(texts_[high])
                high += 1
            n = np.array(lengths, np.int64)
            with np.errstate(over="ignore"):
                own = mix(np.repeat(np.array(keys[low:high], np.uint64), n) + np.uint64(_STEP) * (
                    _spread(np.ones(len(n), np.int64), n).astype(np.uint64)))
            texts = np.repeat(np.arange(low, high), n)
            for at in range(0, len(words), _CHUNK):
                part = slice(at, at + _CHUNK)
                found, sizes = self._chunk(words[part], own[part])
                ids.append(found)
                counts += np.bincount(texts[part], sizes, len(texts_)).astype(np.int64)
            low = high
        return np.concatenate(ids), np.cumsum(counts)

    def encode(self, text: str, doc_id: int | None) -> bytes:
        key = self.key(doc_id, hashlib.sha256(text.encode()).digest())
        return self.encode_all([text], [key])[0].tobytes()


def split(text: str) -> list[str]:
    """Segments of the text behind one more space, each without its first space."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, spaces = [], -1
    for word in words:
        spaces += 1
        if word:
            out.append(" " * spaces + word)
            spaces = -1
    return out + [" " * spaces] if spaces >= 0 else out


def decoded(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of some ids, without the space that encoding put before it."""
    out = []
    for low in range(0, len(ids), _CHUNK):
        part = ids[low:low + _CHUNK]
        size = pieces.size_of[part]
        first = pieces.start_of[part] - (np.cumsum(size, dtype=np.int32) - size)
        out.append(pieces.bytes_of[np.repeat(first, size) + np.arange(size.sum(), dtype=np.int32)].tobytes())
    return b"".join(out)[1:].decode()


_pieces: dict[str, Pieces] = {}
_encoders: dict[tuple[str, float, int], Encoder] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def encoder_of(path: str, rate: float, seed: int) -> Encoder:
    """The encoder of this worker, with what it remembers from earlier tasks."""
    if (path, rate, seed) not in _encoders:
        _encoders.clear()
        _encoders[path, rate, seed] = Encoder(pieces_of(path), rate, seed)
    return _encoders[path, rate, seed]


def encode(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``variant``, ``ids`` and the digests ``ids_crc32`` and ``text_sha256``.

    The variant is the key of the document's draws, a 64-bit hash of seed and id.
    """
    names = ["doc_id", "variant", "ids", "ids_crc32", "text_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, rate, seed)
        for batch in batches:
            who, bodies = (c.to_pylist() for c in batch.columns)
            digests = [hashlib.sha256(b.encode()) for b in bodies]
            keys = [encoder.key(i, d.digest()) for i, d in zip(who, digests, strict=True)]
            ids, ends = encoder.encode_all(bodies, keys)
            offsets, data = [0, *ends.tolist()], memoryview(ids).cast("B")
            yield pa.RecordBatch.from_arrays([
                pa.array(who, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)),
                pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])], pa.int64()),
                pa.array([d.hexdigest() for d in digests])], names)

    return texts(docs, doc_id, text).mapInArrow(
        run, "doc_id long, variant long, ids array<int>, ids_crc32 long, text_sha256 string")


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``text``, decoded from ``ids`` (null: an empty text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = batch.column(0)
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            bodies = [decoded(pieces, ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(bodies, pa.string())], [*keep, "text"])

    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep),
                        "text string"])
    return encoded.select("ids", *keep).mapInArrow(run, schema)
