"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file:

* the normaliser N, a deterministic transducer that reads a text after a sign for its beginning and writes the model's
  symbols: the dummy prefix, U+2581 for spaces, and, where the model says so, one for a run of them;
* the lexicon L, a trie of the pieces, closed at its root. The arcs that end a piece write its id and weigh minus its
  score; byte fallback arcs write the byte ids of any one symbol, and weigh more than all pieces of a path together;
* the grammar G over ids. Of a byte-pair model, whose segmentation is made by ranked merges and isn't the path of least
  summed weight, it lets piece b follow piece a only where ranked merges of their joint text give back a and b. Of a
  unigram model it lets any follow any.

An input is composed with N, L and G as far as the search goes, and the path of least weight in the tropical semiring
(weights add up along a path, the least path counts) gives the ids. States of the composition are (place, last piece).
The fallback arcs are there at every symbol, so it's the minimum that keeps them out where pieces do. With G, no path of
pieces is left for a byte-pair model but the merges' own: the first merge across any border of a path would happen in the
joint text of the two pieces as well, and without one the path is the segmentation.

Texts are cut into units before spaces, and between characters that stand together in no piece of the model: no piece
could reach over such a cut, and no merge. Each distinct unit is composed and searched once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cuts, short_batches, slices, text_buffer, word_hasher
from .packing import Encoder

#: Field numbers and kinds of the public model format: a piece has text 1, score 2 and type 3.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
#: The last piece of a state at the start, and after a byte fallback; nothing borders on either.
_START, _FALLBACK = -1, -2
#: The byte that stands for the beginning of a text; UTF-8 has no such byte.
BEGIN = 0xFF
#: Pairs of pieces that a grammar remembers; beyond it starts anew.
KNOWN_PAIRS = 1_000_000


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", raw, at)[0], at + 4
        else:
            value, at = raw[at : at + 8], at + 8
        yield tag >> 3, value


class Normaliser:
    """A deterministic transducer: an arc reads one character and may write SPACE before the character's own symbol, or nothing."""

    START, INSIDE, AFTER_SPACE = range(3)

    def __init__(self, dummy: bool, squeeze: bool):
        prefix = SPACE if dummy else ""
        inside = (self.INSIDE, "", True)
        #: (state, whether a space is read) -> (next state, what is written before, whether the symbol itself is written)
        self.arcs = {(self.START, False): (self.INSIDE, prefix, True), (self.START, True): (self.INSIDE, prefix, True), (self.INSIDE, False): inside, (self.INSIDE, True): inside}
        if squeeze:  # a space is written only when something follows it
            self.arcs |= {(self.START, True): (self.START, "", False), (self.INSIDE, True): (self.AFTER_SPACE, "", False), (self.AFTER_SPACE, True): (self.AFTER_SPACE, "", False), (self.AFTER_SPACE, False): (self.INSIDE, SPACE, True)}

    def compose(self, text: str, begins: bool) -> str:
        """The symbols of the one path of a text, or of a part of one that no space precedes."""
        state, out, arcs = self.START if begins else self.INSIDE, [], self.arcs
        for c in text:
            state, before, own = arcs[state, c == " "]
            out.append(before)
            if own:
                out.append(SPACE if c == " " else c)
        return "".join(out)


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, raw: bytes):
        pieces, normal, trainer = [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                one = dict(fields(value))
                pieces.append((one[1].decode(), one.get(2, 0.0), one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if normal.get(2):
            raise ValueError("models with a character map are not supported")
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        if any(kind == USER_DEFINED for _, _, kind in pieces) or trainer.get(24):
            raise ValueError("user-defined pieces and white space as a suffix are not supported")
        self.dummy, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.normaliser = Normaliser(self.dummy, self.squeeze)
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.text = [t for t, _, _ in pieces]
        self.score = {t: s for t, s, kind in pieces if kind == NORMAL}
        self.weight = [-s for _, s, _ in pieces]
        low, high = min([0.0, *self.score.values()]), max([0.0, *self.score.values()])
        self.lift = max(high, 0.0)  # weights are made positive by as much for each symbol, so every path gets the same more
        self.fallback_weight, self.span = 10.0 - low, high - low + 1
        self.trie: dict = {}  # a node has its children by symbol, and under "" the piece that ends there
        for i, (t, _, kind) in enumerate(pieces):
            if kind == NORMAL:
                node = self.trie
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = i
        held = [t for t, _, kind in pieces if kind == NORMAL]
        self.inner = {pair for t in held for pair in zip(t, t[1:], strict=False)}
        self.cut_spaces = {a for a, b in self.inner if b == SPACE} <= {SPACE}
        # pairs of ASCII characters that stand together in no piece, so nothing can reach over a cut between them
        self.cuts = np.zeros((256, 256), bool)
        self.cuts[:128, :128] = True
        for a, b in self.inner:
            if (a.isascii() or a == SPACE) and (b.isascii() or b == SPACE):
                self.cuts[ord(a.replace(SPACE, " ")), ord(b.replace(SPACE, " "))] = False
        self.cuts[0x20, :] = False  # the normaliser's state is known only after another character
        self.pairs: dict[int, dict[int, bool]] = {}
        self.known = 0
        # what each id decodes to
        self.bytes = [b"" if kind in (CONTROL,) else bytes([int(t[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else t.replace(SPACE, " ").encode() for t, _, kind in pieces]

    def merged(self, text: str) -> list[str]:
        """Ranked merges: again and again the pair whose joint piece has the highest score, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """G: whether piece b may follow piece a; found by ranked merges once and remembered."""
        if not self.bpe:
            return True
        after = self.pairs.setdefault(max(a, _START), {})
        found = after.get(b)
        if found is None:
            if self.known >= KNOWN_PAIRS:
                self.pairs, self.known = {}, 0
                after = self.pairs.setdefault(max(a, _START), {})
            want = [self.text[a], self.text[b]] if a >= 0 else [self.text[b]]
            found = after[b] = self.merged("".join(want)) == want
            self.known += 1
        return found

    def segments(self, symbols: str) -> Iterator[str]:
        """Parts between symbols that stand together in no piece."""
        first, inner = 0, self.inner
        for k, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1):
            if pair not in inner:
                yield symbols[first:k]
                first = k
        if symbols:
            yield symbols[first:]

    def path(self, symbols: str) -> tuple[float, list[int]]:
        """Weight and ids of the shortest path of normalised symbols."""
        total, ids = 0.0, []
        for part in self.segments(symbols):
            weight, own = self.shortest_path(part)
            total += weight
            ids += own
        return total, ids

    def shortest_path(self, symbols: str) -> tuple[float, list[int]]:
        """Least weight first through the states of the composition, until one at the end is reached."""
        n, size = len(symbols), len(self.text) + 2
        far = self.span * (n + 1) if self.bpe else self.fallback_weight
        lift, weight, trie, follows = self.lift, self.weight, self.trie, self.follows
        came: dict[int, int] = {}  # state -> the state before it; a state is place * size + last piece + 2
        heap = [(0.0, 0, _START + 2, -1)]  # weight, minus the number of pieces pushed before, state, the state before
        pushed = 0
        while heap:
            total, _, state, before = heappop(heap)
            if state in came:
                continue
            came[state] = before
            place, last = divmod(state, size)
            last -= 2
            if place == n:
                break
            node, j = trie, place
            while j < n:
                node = node.get(symbols[j])
                if node is None:
                    break
                j += 1
                b = node.get("")
                if b is not None and follows(last, b):
                    pushed += 1
                    heappush(heap, (total + weight[b] + lift * (j - place), pushed, j * size + b + 2, state))
            pushed += 1
            heappush(heap, (total + far + lift, pushed, (place + 1) * size + _FALLBACK + 2, state))
        ids: list[int] = []
        while came[state] >= 0:
            before = came[state]
            last = state % size - 2
            ids += [last] if last >= 0 else self.fallback(symbols[before // size])
            state = before
        return total - lift * n, ids[::-1]

    def fallback(self, char: str) -> list[int]:
        """Byte ids of a character, last first; without byte pieces the unknown id."""
        return [self.byte_ids[b] for b in reversed(char.encode())] if self.byte_ids else [self.unknown]

    def encode(self, text: str) -> list[int]:
        return self.path(self.normaliser.compose(text, True))[1]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.bytes[i] for i in ids)
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


class PieceEncoder(Encoder):
    """Ids of many texts; each distinct unit is composed and searched once. A unit at the beginning of a text starts with BEGIN."""

    cached = 128 << 20  # a search costs more than a place in memory

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.machine = Transducer(f.read())
        self.by_unit, self.hasher = True, word_hasher()
        self.clear()
        sizes = np.array([len(b) for b in self.machine.bytes], np.int64)
        self.piece_first, self.piece_size = np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes
        self.piece_bytes = np.frombuffer(b"".join(self.machine.bytes), np.uint8)

    def borders(self, part: np.ndarray) -> np.ndarray:
        """Places in front of which a text may be cut."""
        left, right = part[:-1], part[1:]
        good = self.machine.cuts[left, right]
        if self.machine.cut_spaces:  # not after the beginning or a sign that may be written as U+2581
            good |= (right == 0x20) & (left != 0x20) & (left != BEGIN) & (left != 0x81)
        return np.flatnonzero(good) + 1

    def units(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(part)
        first = np.zeros(n + 1, bool)
        first[own] = True
        first[self.borders(part)] = True
        first[n] = False
        starts = np.flatnonzero(first)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, own), np.zeros(len(starts), bool)

    def bounds(self, part: np.ndarray) -> list[int]:
        return cuts(part, lambda low, high: self.borders(part[low - 1 : high]) + low - 1)

    def _learn(self, units: list[bytes], decided: np.ndarray) -> np.ndarray:
        machine, found = self.machine, []
        for raw in units:
            begins = raw[0] == BEGIN
            found.append(machine.path(machine.normaliser.compose(raw[begins:].decode(), begins))[1])
        self._keep(units, found)
        return np.arange(len(units))

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """As the Encoder's; every text that isn't empty gets the byte BEGIN in front."""
        data, offsets = text_buffer(column)
        for a, b in slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            full = np.diff(own) > 0
            part = np.insert(part, own[:-1][full], BEGIN)
            own = own + np.concatenate([[0], np.cumsum(full)])
            if len(part) > SLICE_BYTES and b - a == 1:
                bounds = self.bounds(part)
                ids = np.concatenate([self.encoded(part[x:y], np.array([0, y - x]))[0] for x, y in zip(bounds, bounds[1:], strict=False)])
                yield a, b, ids, np.array([0, len(ids)])
            else:
                yield a, b, *self.encoded(part, own)

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes that ids stand for, with the dummy prefix still on, and the n + 1 offsets of the rows."""
        sizes, firsts = self.piece_size[ids], self.piece_first[ids]
        until = np.concatenate([[0], np.cumsum(sizes)])
        return self.piece_bytes[np.repeat(firsts - until[:-1], sizes) + np.arange(until[-1])], until[offsets]

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """What the ids of each row stand for, with the dummy prefix still on; long rows are decoded part by part."""
        step = 1 << 18
        if len(ids) <= 2 * step:
            back, at = self.decoded(ids, offsets)
            yield from (back[x:y].tobytes() for x, y in zip(at, at[1:], strict=False))
            return
        for x, y in zip(offsets, offsets[1:], strict=False):
            yield b"".join(self.decoded(ids[k : min(k + step, y)], np.array([0]))[0].tobytes() for k in range(x, y, step))


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of each whole text; a null or empty text has no ids. model is the path of a model file.

    Texts are encoded one by one, so repeated rows get equal ids and an empty table gives no rows. Only the two named
    columns are read. Bytes of characters without a piece come as byte pieces.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for a, b, ids, offsets in own(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) of the ids of encode(), row by row: null and no ids give an empty text, equal ids equal texts, a null id_col
    is kept, and an empty table gives no rows. An id that the model doesn't have is an error. Other columns aren't read.
    """
    short_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(model).machine
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_ids, n_bytes, n_distinct_ids, ids_crc32, decoded_sha256, exact): ids of each text, and what they decode to.

    n_bytes counts byte pieces; ids_crc32 is over little-endian unsigned 32-bit ids; exact tells whether decoding gives the
    text back, as it does unless the text holds the normaliser's own space sign or spaces that the model drops. Null and
    empty texts have no ids; repeated rows come as often as they are there; an empty table gives no rows.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        is_byte = np.zeros(len(own.machine.text), bool)
        is_byte[list(own.machine.byte_ids.values())] = True
        for batch in batches:
            data, at = text_buffer(batch.column(1))
            for a, b, ids, offsets in own(batch.column(1)):
                rows: list[tuple] = []
                for i, text in zip(range(a, b), own.texts(ids, offsets), strict=True):
                    mine = ids[offsets[i - a] : offsets[i - a + 1]].astype("<u4", copy=False)
                    text = text[1:] if own.machine.dummy and text[:1] == b" " else text
                    same = text == data[at[i] : at[i + 1]].tobytes()
                    if not same:
                        text = text.decode(errors="replace").encode()
                    rows.append((len(mine), int(is_byte[mine].sum()), len(np.unique(mine)), zlib.crc32(mine.tobytes()), hashlib.sha256(text).hexdigest(), same))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "n_ids", "n_bytes", "n_distinct_ids", "ids_crc32", "decoded_sha256", "exact"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_ids long, n_bytes long, n_distinct_ids long, ids_crc32 long, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_col)
