"""Packing documents into training sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so the lengths of all pieces are a histogram of at most `capacity` rows,
however large the corpus. The driver plans over that histogram alone: each bin starts with the longest length left, a
bitset holds the sums that the lengths left can reach, and the fullest feasible combination is taken out. A combination
is used as often as its lengths allow, so the plan has few combinations, not few bins. Executors then give every piece
the slot of its rank among pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_batches, cuts, short_batches, slices, staged, text_buffer, word_bounds, word_hasher



def minimum_bin_slack(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies), ...]), ...]: all pieces, counts[length] of each, in bins of the capacity."""
    left = [int(c) for c in counts]
    lengths = [k for k in range(len(left) - 1, 0, -1) if left[k]]
    plan = []
    while lengths:
        anchor = lengths[0]
        room = capacity - anchor
        mask, goal = (1 << (room + 1)) - 1, 1 << room
        reach, steps = 1, []
        for length in lengths:
            if reach & goal:
                break
            if length > room:
                continue
            for _ in range(min(left[length] - (length == anchor), room // length)):
                wider = (reach | reach << length) & mask
                if wider == reach:
                    break
                steps.append((length, reach))
                reach = wider
                if reach & goal:
                    break
        total = reach.bit_length() - 1
        taken = {anchor: 1}
        for length, before in reversed(steps):
            if not before >> total & 1:
                taken[length] = taken.get(length, 0) + 1
                total -= length
        bins = min(left[length] // copies for length, copies in taken.items())
        for length, copies in taken.items():
            left[length] -= bins * copies
        plan.append((bins, sorted(taken.items(), reverse=True)))
        lengths = [k for k in lengths if left[k]]
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks with the sequence and the place that they get."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for bins, combination in plan:
        offset = 0
        for length, copies in combination:
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += bins * copies
            offset += length * copies
        sequence += bins
    rows.sort()
    at = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": at[:, 0], "rank": at[:, 1], "sequence": at[:, 2], "copies": at[:, 3], "offset": at[:, 4]}


_LETTER, _DIGIT, _OTHER = 1, 2, 3
#: Classes of printable ASCII bytes; 0 is undecided: an apostrophe may begin a contraction, other bytes need the tokenizer's own rules.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASS[0x27] = 0


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + others.index(b)) for b in range(256)]


#: How a tokenizer file must cut texts for units to be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_into_words(raw: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and sets letters, single digits and others apart."""
    before = (raw.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split, model, added = before[0], raw["model"], raw.get("added_tokens") or []
    plain = all(not t[k] for t in added for k in ("normalized", "lstrip", "rstrip", "single_word"))
    return (
        raw.get("normalizer") == WORD_NORMALIZER
        and len(before) == 2
        and (split.get("type"), split.get("pattern"), split.get("invert")) == ("Split", {"Regex": WORD_SPLIT}, True)
        and (before[1].get("type"), before[1].get("add_prefix_space"), before[1].get("use_regex")) == ("ByteLevel", False, False)
        and (model.get("type"), model.get("dropout"), model.get("byte_fallback"), raw.get("truncation")) == ("BPE", None, False, None)
        and plain
        and not any(c.isspace() for t in added for c in t["content"])
    )


def distinct(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct unit is first, and which of these every unit equals, byte by byte."""
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = ends - starts, where[back]
    same = bool((size == size[model]).all())
    if same:
        at = np.flatnonzero((size > 8) & (model != np.arange(len(model))))  # up to eight bytes, equal hashes and sizes mean equal bytes
        until = np.concatenate([[0], np.cumsum(size[at])])
        place = np.arange(until[-1]) + np.repeat(starts[at] - until[:-1], size[at])
        same = bool((part[place] == part[place + np.repeat(starts[model[at]] - starts[at], size[at])]).all())
    if same:
        return where, back
    raw, seen = part.tobytes(), {}
    number = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(number, return_index=True)[1], number


class Pool:
    """Lists of numbers one after another, by the number of the list."""

    def __init__(self, kind: type):
        self.values, self.filled, self.count = np.zeros(1 << 16, kind), 0, 0
        self.first, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(sizes), len(values)
        while self.filled + total > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.count + n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.values[self.filled : self.filled + total] = values
        self.first[self.count : self.count + n] = self.filled + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + n] = sizes
        self.filled += total
        self.count += n


class Encoder:
    """Token ids of texts by a tokenizer file, as its own library gives them without added special tokens.

    A file that cuts texts into words, as cuts_into_words() says, is read unit by unit: texts are cut where it cuts them for
    certain, at ASCII white space and between decided classes of bytes, and each distinct unit is encoded once. A unit of one
    class goes straight to the vocabulary; one with undecided bytes, or with the string of a special token, takes the whole way
    through the tokenizer, whose rules then cut it further. Texts of any other file take the whole way as they are.
    """

    #: Bytes of units and ids that a worker remembers, about; beyond it starts anew.
    cached = 96 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on every core
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            raw = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_unit = cuts_into_words(raw)
        self.special = [t["content"].encode() for t in raw.get("added_tokens") or []]
        self.symbols = byte_symbols()
        self.hasher = word_hasher()
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the units that have them
        self.ids, self.raw = Pool(np.uint32), Pool(np.uint8)

    @property
    def held(self) -> int:
        return 4 * self.ids.filled + self.raw.filled + 64 * self.ids.count

    def _find(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The numbers of units that are remembered, compared byte by byte; -1 for others."""
        out = np.full(len(starts), -1)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == hashes)
        number, size = self.numbers[at[hit]], (ends - starts)[hit]
        same = self.raw.size[number] == size
        hit, number, size = hit[same], number[same], size[same]
        if len(hit):
            until = np.cumsum(size) - size
            step = np.arange(until[-1] + size[-1])
            equal = part[step + np.repeat(starts[hit] - until, size)] == self.raw.values[step + np.repeat(self.raw.first[number] - until, size)]
            same = np.logical_and.reduceat(equal, until)
            out[hit[same]] = number[same]
        return out

    def _keep(self, units: list[bytes], found: list[list[int]]) -> None:
        """Append units and their ids."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids.extend(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)
        self.raw.extend(np.frombuffer(b"".join(units), np.uint8), np.fromiter(map(len, units), np.int64, len(units)))

    def _remember(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Make units findable; of units that share a hash the first one is."""
        hashes, first = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.keys, hashes)
        new = np.append(self.keys, np.uint64(0))[at] != hashes if len(self.keys) else np.ones(len(hashes), bool)
        new |= at == len(self.keys)
        self.keys = np.insert(self.keys, at[new], hashes[new])
        self.numbers = np.insert(self.numbers, at[new], numbers[first][new])

    def _learn(self, units: list[bytes], decided: np.ndarray) -> np.ndarray:
        """Encode units and append them; the places among `units` in the order in which they were appended."""
        plain, whole = np.flatnonzero(decided), np.flatnonzero(~decided)
        tokenize, symbols, found = self.tokenizer.model.tokenize, self.symbols, []
        own = [units[k] for k in plain.tolist()]
        for raw in own:
            text = raw.decode().lower()
            found.append([t.id for t in tokenize(text if text.isascii() else "".join([symbols[b] for b in text.encode()]))])
        self._keep(own, found)
        other = [units[k] for k in whole.tolist()]
        for a in range(0, len(other), 4096):
            part = other[a : a + 4096]
            self._keep(part, [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)])
        return np.concatenate([plain, whole])

    def hashed(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.hasher(part, starts, ends, lower=False)  # the strings of special tokens are told apart by case

    def units(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, the rows' offsets among them, and which units are of one decided class."""
        starts, ends, _ = word_bounds(part, own)
        kind = _CLASS[part]
        lead = np.flatnonzero(part[:-1] == 0xC3)  # U+00C0 to U+00FF are letters, but for the signs of times and division
        lead = lead[(part[lead + 1] != 0x97) & (part[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        raw = part.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                kind[at : at + len(mark)] = 0
                at = raw.find(mark, at + 1)
        cut = np.flatnonzero((kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))) + 1
        inside = np.zeros(len(part) + 1, bool)
        inside[starts] = inside[cut] = True
        own_starts = np.flatnonzero(inside)
        inside[:] = False
        inside[ends] = inside[cut] = True
        # where rows or words meet without white space, a cut is both a start and an end already
        own_ends = np.flatnonzero(inside)
        unsure = np.concatenate([[0], np.cumsum(kind == 0, dtype=np.int32)])
        return own_starts, own_ends, np.searchsorted(own_starts, own), unsure[own_ends] == unsure[own_starts]

    def bounds(self, part: np.ndarray) -> list[int]:
        """Bounds of the segments of a long text that are encoded one after another."""
        return cuts(part)

    def encoded(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's rows one after another, and the offsets of the rows."""
        starts, ends, at, decided = self.units(part, own) if len(part) else (np.zeros(0, np.int64),) * 4
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(own), np.int64)
        hashes = self.hashed(part, starts, ends)
        where, back = distinct(part, starts, ends, hashes)
        if self.held > self.cached:
            self.clear()
        first, last, key = starts[where], ends[where], hashes[where]
        number = self._find(part, first, last, key)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw, before = part.tobytes(), self.ids.count
            order = new[self._learn([raw[x:y] for x, y in zip(first[new].tolist(), last[new].tolist(), strict=True)], decided[where[new]])]
            number[order] = np.arange(before, before + len(order))
            self._remember(key[order], number[order])
        place = number[back]
        sizes, firsts = self.ids.size[place], self.ids.first[place]
        until = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids.values[np.repeat(firsts - until[:-1], sizes) + np.arange(until[-1])], until[at]

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, their ids one after another, n + 1 offsets of the rows)."""
        data, offsets = text_buffer(column)
        for a, b in slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not self.by_unit:
                texts = [part[x:y].tobytes().decode() for x, y in zip(own, own[1:], strict=False)]
                found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield a, b, np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
            elif b - a == 1 and len(part) > SLICE_BYTES:
                bounds = self.bounds(part)
                ids = np.concatenate([self.encoded(part[x:y], np.array([0, y - x]))[0] for x, y in zip(bounds, bounds[1:], strict=False)])
                yield a, b, ids, np.array([0, len(ids)])
            else:
                yield a, b, *self.encoded(part, own)


_ENCODERS: dict[str, Encoder] = {}

_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("rank", pa.int64()), ("ids", pa.list_(pa.int32()))])


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Token pieces of at most `capacity` ids. `rank` counts the pieces of a length in the task that wrote them, `part`."""
    schema = _PIECES if keep_ids else _PIECES.remove(7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer)
        encode, part, seen = _ENCODERS[tokenizer], TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, ids, offsets in encode(batch.column(1)):
                rows: dict[str, list] = {f.name: [] for f in schema}
                for i in range(a, b):
                    own = np.append(ids[offsets[i - a] : offsets[i - a + 1]], np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        n = len(piece)
                        for name, value in (("id", keys[i]), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(piece.tobytes())), ("part", part), ("rank", seen[n])):
                            rows[name].append(value)
                        if keep_ids:
                            rows["ids"].append(piece.astype(np.int32))
                        seen[n] += 1
                yield as_batches(rows, schema)

    types = "id long, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, types)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each document.

    A document is the ids of its text and `end_id`; null, empty and blank texts are that id alone. Only documents longer
    than the capacity are cut, into pieces of the capacity and a shorter last one. Repeated documents are packed as often
    as they come, and a null id is kept. tokenizer is the path of a `tokenizers` file; strings of its special tokens in a text
    count as these tokens. Columns other than the two named ones aren't read. An empty table packs into nothing.
    """
    short_batches(docs.sparkSession)
    cut = staged(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    per_part = staged(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("k")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, k in per_part.groupBy("length").agg(F.sum("k")).collect():  # at most `capacity` rows
        counts[length] = k
    at = slots(minimum_bin_slack(counts, capacity), capacity)
    before = per_part.select("part", "length", F.coalesce(F.sum("k").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    shift = 1 << 42

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = at["length"] * shift + at["rank"]
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            k = np.searchsorted(keys, length * shift + rank, side="right") - 1
            turn, copy = np.divmod(rank - at["rank"][k], at["copies"][k])
            held = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(at["sequence"][k] + turn), pa.array(at["offset"][k] + copy * length)], names=[*held, "sequence_id", "offset"])

    kept = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    # what came before grows with the tasks, so it is merged, not broadcast; a task's rows have many lengths, so no key is hot
    ranked = cut.join(before.hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with keep_ids; a sequence has at most `capacity` ids, so its group is small.

    Null ids of documents and repeated documents are pieces like others; no pieces make no sequences.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x.ids)).alias("ids"))
