"""Language-model scores of whole texts: add-one unigrams as a base, and a log-bilinear model trained by NCE.

Training reads every training text. Texts are cut into slices of about SLICE_TEXT bytes, each with its own list of distinct
words, so what is shuffled is a row for each word of a slice, not for each token. Word counts are summed over all slices
and joined back to them once; what is left of a slice are the classes of its tokens and each text's sums that need no model.
Training and scoring run over those, without a shuffle.

Every word belongs to a class: the end, which also stands before a text, and each of the TOP most frequent words are classes
of their own, all others share the hashed classes of their last ENDING bytes. The model is

    P(w | g, h) = P(class of w | classes of g and h) * P(w | class of w)

with g and h the two words before. The second factor is add-one smoothed counts within the class, over the whole vocabulary,
which grows with the corpus; one more place in each class is for words that training never saw. The first is log-bilinear,
s(k | g, h) = q_k . (c_1 * r_h + c_2 * r_g) + b_k, trained by noise-contrastive estimation over all training tokens: in
each of the ROUNDS, every task trains a copy on its slices, from the average of the round before, and the copies are averaged
by their tokens, in a tree of fan-in FAN. As the score is a sum over the two places, exp(s) summed over k is a product of two matrices, so one batched
product gives the normaliser of every context, and probabilities sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_batches, cuts, lowered, mixed, short_batches, slices, staged, text_buffer, word_bounds, word_hasher

SLICE_TEXT = 16 << 20
CLASSES, TOP, ENDING = 2048, 1023, 3
WIDTH, NOISE, SHARED_NOISE, STEP_TOKENS, RATE, SEED = 32, 10, 64, 4096, 0.1, 11
#: Rounds of training and averaging: the first one reads all slices, the second one every other. A round passes once over its
#: tokens at any size of the corpus or of a task's share; READ tokens are held at a time.
ROUNDS, READ, FAN = (1, 2), 1 << 19, 16
END = 0
HELD_OUT_OF, HELD_OUT = 7, 2

#: A row of a slice is one of its words with its hashed class and training count, or some of its texts with their tokens.
_SLICE = pa.schema([("slice", pa.int64()), ("pos", pa.int32()), ("word", pa.int64()), ("kind", pa.int16()), ("k", pa.int32()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
_SLICE_TYPES = "slice long, pos int, word long, kind short, k int, ids array<long>, train array<boolean>, ends array<int>, tokens array<int>"
#: Texts with the classes of their tokens, the ends among them, and what is summed over a text without the model.
_CLASSED = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("size", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("kinds", pa.list_(pa.int16()))])
_CLASSED_TYPES = "slice long, ids array<long>, train array<boolean>, size array<int>, known array<int>, base array<double>, inside array<double>, kinds array<short>"
#: Tokens in a row of texts; a longer text is a row alone.
ROW_TOKENS = 1 << 17


def endings(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashed class of each word, by its last ENDING bytes in lower case."""
    eight = np.ndarray(len(part) + 1, "<u8", np.concatenate([np.zeros(8, np.uint8), lowered(part)]), strides=(1,))[ends]
    last = eight >> (np.uint64(64) - np.uint64(8) * np.minimum(ends - starts, ENDING).astype(np.uint64))
    return (TOP + 1 + mixed(last + np.uint64(1)) % np.uint64(CLASSES - TOP - 1)).astype(np.int16)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, words of each row, hashes, hashed classes), for runs of rows, a long row segment by segment."""
    hasher = word_hasher()
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        bounds = cuts(part) if b - a == 1 and len(part) > SLICE_BYTES else [0, len(part)]
        size, hashes, kinds = np.zeros(b - a, np.int64), [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
        for x, y in zip(bounds, bounds[1:], strict=False):
            now = part[x:y]
            starts, ends, at = word_bounds(now, own if len(bounds) == 2 else np.array([0, y - x]))
            if len(starts):
                size += np.diff(at)
                hashes.append(hasher(now, starts, ends))
                kinds.append(endings(now, starts, ends))
        yield a, b, size, np.concatenate(hashes), np.concatenate(kinds)


def sliced(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of _SLICE: the distinct words of each slice, and its texts with their tokens as places among these."""

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SLICE], schema=_SLICE)

    def packed(number: int, ids: list, train: list, sizes: list, hashes: list, kinds: list) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        words, first, back = np.unique(tokens, return_index=True, return_inverse=True)
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        k = np.bincount(back[np.repeat(np.array(train, bool), size)], minlength=len(words)).astype(np.int32)
        kind, place, back = np.concatenate([*kinds, np.zeros(0, np.int16)])[first], np.arange(len(words), dtype=np.int32), back.astype(np.int32)
        for a in range(0, len(words), 1 << 16):
            b = slice(a, a + (1 << 16))
            n = len(place[b])
            yield rows(n, slice=np.full(n, number), pos=place[b], word=words[b].view(np.int64), kind=kind[b], k=k[b])
        until = np.concatenate([[0], np.cumsum(size)])
        x = 0
        while x < len(ids):
            y = max(x + 1, int(np.searchsorted(until, until[x] + ROW_TOKENS, side="right")) - 1)
            yield rows(1, slice=[number], ids=[ids[x:y]], train=[train[x:y]], ends=[(until[x + 1 : y + 1] - until[x]).astype(np.int32)], tokens=[back[until[x] : until[y]]])
            x = y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, sizes, hashes, kinds, held = [], [], [], [], [], 0
        for batch in batches:
            keys, learnt = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_buffer(batch.column(2))
            for a, b, size, found, kind in words_of(data, offsets):
                ids += keys[a:b]
                train += learnt[a:b]
                sizes.append(size)
                hashes.append(found)
                kinds.append(kind)
                held += int(offsets[b] - offsets[a])
                if held >= SLICE_TEXT or len(ids) >= 1 << 16:
                    yield from packed(number, ids, train, sizes, hashes, kinds)
                    ids, train, sizes, hashes, kinds, held, number = [], [], [], [], [], 0, number + 1
        if ids:
            yield from packed(number, ids, train, sizes, hashes, kinds)

    held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT
    return docs.select(F.col(id_col).cast("long").alias("id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text_col).alias("text")).mapInArrow(run, _SLICE_TYPES)


@dataclass
class Weights:
    """What is trained: q and r by class, c of the two places, b by class, and the sums of squared slopes of each (AdaGrad)."""

    q: np.ndarray
    r: np.ndarray
    c: np.ndarray
    b: np.ndarray
    held: list[np.ndarray]

    @classmethod
    def first(cls, share: np.ndarray) -> Weights:
        rng = np.random.default_rng(SEED)
        size = len(share)
        q, r = (rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32) for _ in range(2))
        c = np.stack([np.ones(WIDTH), np.full(WIDTH, 0.5)]).astype(np.float32)
        return cls(q, r, c, np.log(share).astype(np.float32), [np.full(x, v, np.float32) for x, v in (((size, WIDTH), 0.01), ((size, WIDTH), 0.01), ((2, WIDTH), 0.01), ((size,), 1.0))])

    def parts(self) -> list[np.ndarray]:
        return [self.q, self.r, self.c, self.b, *self.held]

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.parts())

    def from_bytes(self, raw: bytes) -> Weights:
        """Weights of the shapes of these."""
        flat, out, at = np.frombuffer(raw, np.float32), [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).copy())
            at += x.size
        return Weights(*out[:4], out[4:])


def tokens_before(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; before a text stands the end."""
    before = np.concatenate([[END], values[:-1]]).astype(values.dtype)
    before[first] = END
    earlier = np.concatenate([[END], before[:-1]]).astype(values.dtype)
    earlier[first] = END
    return before, earlier


def train_nce(w: Weights, share: np.ndarray, tokens: np.ndarray, first: np.ndarray, learnt: np.ndarray, rng: np.random.Generator) -> None:
    """Train w in place, in one pass, on the classes of some texts: tokens of which `learnt` count, `first` the places of the texts' first ones.

    A step's tokens share SHARED_NOISE noise classes, drawn by their share of the corpus, and each stands for NOISE /
    SHARED_NOISE draws. All scores of a step are one product of matrices.
    """
    tokens = tokens.astype(np.int16)  # short keys sort faster
    before, earlier = tokens_before(tokens, first)
    at = np.flatnonzero(learnt)
    drawn, log_k, weight = np.cumsum(share), np.log(NOISE * share).astype(np.float32), np.float32(NOISE / SHARED_NOISE)

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by class, where each class begins in it, and the classes."""
        order = np.argsort(rows, kind="stable")
        starts = np.flatnonzero(np.diff(rows[order], prepend=np.int16(-1)))
        return order, starts, rows[order][starts]

    def move(value: np.ndarray, held: np.ndarray, by: tuple, slope: np.ndarray) -> None:
        order, starts, to = by
        total = np.add.reduceat(slope[order], starts, axis=0)
        held[to] += total * total
        value[to] += RATE * total / np.sqrt(held[to])

    for k in range(0, len(at), STEP_TOKENS):
        i = at[k : k + STEP_TOKENS]
        j = np.searchsorted(drawn, rng.random(SHARED_NOISE) * drawn[-1]).astype(np.int16)
        word, h, g = (x[i] for x in (tokens, before, earlier))
        near, far = w.r[h], w.r[g]
        u = near * w.c[0] + far * w.c[1]
        up = 1 / (1 + np.exp(np.einsum("ij,ij->i", u, w.q[word]) + w.b[word] - log_k[word]))
        down = weight / (1 + np.exp(log_k[j] - w.b[j] - u @ w.q[j].T))
        by_u = up[:, None] * w.q[word] - down @ w.q[j]
        by_c = np.stack([(by_u * near).sum(axis=0), (by_u * far).sum(axis=0)])
        rows = grouped(np.concatenate([word, j]))
        move(w.q, w.held[0], rows, np.concatenate([up[:, None] * u, -(down.T @ u)]))
        move(w.b, w.held[3], rows, np.concatenate([up, -down.sum(axis=0)]))
        move(w.r, w.held[1], grouped(np.concatenate([h, g])), np.concatenate([by_u * w.c[0], by_u * w.c[1]]))
        w.held[2] += by_c * by_c
        w.c += 0.1 * RATE * by_c / np.sqrt(w.held[2])


@dataclass
class Model:
    """Trained weights, and what the corpus holds in all and by class."""

    weights: Weights | None
    open: np.ndarray  # classes that any word may belong to
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def share(self) -> np.ndarray:
        """Smoothed share of each class among the training tokens; nothing for classes without a word."""
        held = np.where(self.open, self.class_tokens + 1.0, 1e-9)
        return held / held.sum()

    def inside(self, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 P(word | its class); each hashed class has one more place, for all words that training never saw."""
        shared = np.log10((c + 1.0) / (self.class_tokens + self.class_words + 1.0)[kind])
        return np.where(kind > TOP, shared, 0.0)


class Tables:
    """Log scores of all pairs of classes at the two places, and the normaliser of every context by one product of matrices."""

    def __init__(self, model: Model):
        w = model.weights
        self.b = np.where(model.open, w.b, np.float32(-1e4))
        self.near, self.far = (w.r * w.c[0]) @ w.q.T, (w.r * w.c[1]) @ w.q.T
        shift = self.near[:, model.open].max(axis=1, keepdims=True), self.far[:, model.open].max(axis=1, keepdims=True)
        top = self.b.max()
        left = np.exp(np.minimum(self.near - shift[0], 0))
        right = np.exp(np.minimum(self.far - shift[1], 0)) * np.exp(self.b - top)
        self.normaliser = np.log(left @ right.T) + shift[0] + shift[1].T + top

    def log10(self, word: np.ndarray, before: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """log10 P(class | the classes before and earlier)."""
        s = self.near[before, word] + self.far[earlier, word] + self.b[word]
        return (s - self.normaliser[before, earlier]).astype(np.float64) / np.log(10)


_TABLES: dict[bytes, Tables] = {}


def tables(model: Model) -> Tables:
    """A worker makes the tables of a model once."""
    key = model.weights.to_bytes()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(model)
    return _TABLES[key]


def averaged(texts: DataFrame, model: Model, number: int) -> Weights:
    """Weights after a round: every task trains a copy on its slices of the round, and copies are averaged, at most FAN in a group at a time."""
    start, share = model.weights, model.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        w, rng, total = start.from_bytes(start.to_bytes()), np.random.default_rng([SEED, number, task]), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def train() -> int:
            if not held:
                return 0
            kinds, size, learnt = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            learnt = np.repeat(learnt, size)
            n = int(learnt.sum())
            train_nce(w, share, kinds, np.cumsum(size) - size, learnt, rng)
            return n

        for batch in batches:
            for k in range(batch.num_rows):
                at = batch.column(0)[k].as_py()
                if ((at >> 32) + at) % ROUNDS[number]:
                    continue
                learnt, size, kinds = (batch.column(j)[k].values.to_numpy(zero_copy_only=False) for j in range(1, 4))
                held.append((kinds.copy(), size.astype(np.int64), learnt.astype(bool)))
                if sum(len(x[0]) for x in held) >= READ:
                    total += train()
        total += train()
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task], pa.int64()), "n": pa.array([total], pa.int64()), "raw": pa.array([w.to_bytes()], pa.binary())})

    def mean(key: tuple, rows: pa.Table) -> pa.Table:
        n = np.array(rows["n"].to_pylist(), np.float64)
        total = np.zeros(sum(x.size for x in start.parts()))
        for share_of, raw in zip(n / n.sum(), rows["raw"], strict=True):
            total += share_of * np.frombuffer(raw.as_py(), np.float32)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "raw": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    types = "part long, n long, raw binary"
    copies = staged(texts.select("slice", "train", "size", "kinds").mapInArrow(run, types), "copies")
    last = copies.agg(F.max("part")).first()[0]  # null if no slice of the round had anything to learn from
    while last:  # numbers of tasks get smaller by FAN each time
        copies = staged(copies.groupBy(F.floor(F.col("part") / FAN).cast("long").alias("to")).applyInArrow(mean, types), "copies")
        last //= FAN
    found = copies.select("raw").first()
    return start if found is None else start.from_bytes(bytes(found[0]))


def with_ends(values: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a slice with an end after each text, and the number of the first token of each text."""
    ends = ends.astype(np.int64)
    return np.insert(values, ends, end), np.concatenate([[0], (ends + np.arange(1, len(ends) + 1))[:-1]]).astype(np.int64)


def totals(parts: DataFrame, counted: DataFrame) -> tuple[Model, DataFrame]:
    """A model with first weights, and (word, top) of the words that are classes of their own.

    From all slices and all word counts (word, kind, c); what comes to the driver is bounded by CLASSES.
    """
    texts = parts.select(F.explode("train").alias("train")).filter("train").count()
    seen = counted.filter("c > 0")
    by_class = {r["kind"]: (r["c"], r["n"]) for r in seen.groupBy("kind").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    top = seen.orderBy(F.col("c").desc(), "word").limit(TOP).collect()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for kind, (c, n) in by_class.items():
        class_tokens[kind], class_words[kind] = c, n
    tokens, distinct = int(class_tokens.sum()) + texts, int(class_words.sum()) + (texts > 0)
    class_tokens[END], class_words[END] = texts, 1
    for k, r in enumerate(top, 1):
        class_tokens[k], class_words[k] = r["c"], 1
        class_tokens[r["kind"]] -= r["c"]
        class_words[r["kind"]] -= 1
    known = np.ones(CLASSES, bool)
    known[len(top) + 1 : TOP + 1] = False
    model = Model(None, known, tokens, distinct, class_tokens, class_words)
    model.weights = Weights.first(model.share)
    own = parts.sparkSession.createDataFrame([(r["word"], k) for k, r in enumerate(top, 1)], "word long, top int")
    return model, own


def classed(parts: DataFrame, counted: DataFrame, model: Model, own: DataFrame) -> DataFrame:
    """Rows of _CLASSED: the counts and classes of a slice's words are joined back to it, by its number."""
    all_tokens, all_words, end_count = model.tokens, model.distinct, int(model.class_tokens[END])

    def run(part: pa.Table, known: pa.Table) -> pa.Table:
        n = known.num_rows  # every word of the slice, at its place
        place = known["pos"].to_numpy()
        c, kinds = np.zeros(n + 1, np.int64), np.full(n + 1, END, np.int16)
        c[place], kinds[place] = known["c"].to_numpy(), known["kind"].to_numpy()
        c[-1] = end_count
        base, inside = np.log10((c + 1) / (all_tokens + all_words + 1)), model.inside(c, kinds)
        out = []
        for row in range(part.num_rows):
            number, ids, train, ends, local = (part[name][row] for name in ("slice", "ids", "train", "ends", "tokens"))
            tokens, first = with_ends(local.values.to_numpy(zero_copy_only=False), ends.values.to_numpy(zero_copy_only=False), n)
            add = lambda x: np.add.reduceat(x[tokens], first)  # noqa: B023, E731
            size = np.diff(np.append(first, len(tokens))).astype(np.int32)
            values = [[number.as_py()], [ids.values], [train.values], [size], [add((c > 0).astype(np.int32))], [add(base)], [add(inside)], [kinds[tokens]]]
            out.append(as_batches(dict(zip(_CLASSED.names, values, strict=True)), _CLASSED))
        return pa.Table.from_batches(out, _CLASSED)

    kinds = counted.join(F.broadcast(own), "word", "left").select("word", "c", F.coalesce("top", "kind").cast("short").alias("kind"))
    places = parts.filter("word IS NOT NULL").select(F.col("slice").alias("of"), "pos", "word").join(kinds, "word").select("of", "pos", "c", "kind")
    body = parts.filter("tokens IS NOT NULL").select("slice", "ids", "train", "ends", "tokens")
    return body.groupBy("slice").cogroup(places.groupBy("of")).applyInArrow(run, _CLASSED_TYPES)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, Model]:
    """(word counts, texts by class, model) of a corpus."""
    short_batches(docs.sparkSession)
    parts = staged(sliced(docs, id_col, text_col), "slices", "zstd")
    counted = staged(parts.filter("word IS NOT NULL").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("k").alias("c")), "counts", "zstd")
    model, own = totals(parts, counted)
    texts = staged(classed(parts, counted, model, own), "classed", "zstd")
    for number in range(len(ROUNDS)):
        model.weights = averaged(texts, model, number)
    model.weights.held = []
    return counted, texts, model


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text, scores in log10.

    Texts whose crc32(id as text) modulo 7 is 2 are held out, all others are learnt from; a text's tokens are its words, A-Z
    in lower case, and one end. A null, empty or blank text has only the end. Ties among the most frequent words go to the
    smaller hash. Repeated rows are learnt as often as they come; an empty table gives no rows. A null id counts as
    training. Only the two named columns are read. score, not base_score, depends a little on how texts fall into tasks.
    """
    _, texts, model = fitted(docs, id_col, text_col)
    return scored_by(texts, model).withColumnRenamed("id", id_col)


def scored_by(texts: DataFrame, model: Model) -> DataFrame:
    """The rows of scored() for texts by class."""
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = tables(model)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, train, size, known, base, inside, kinds = (batch.column(j)[k].values for j in range(7))
                size, kind = size.to_numpy().astype(np.int64), kinds.to_numpy()
                first = np.cumsum(size) - size
                before, earlier = tokens_before(kind, first)
                full = np.add.reduceat(at.log10(kind, before, earlier), first) + inside.to_numpy()
                values = [ids, pa.array(~train.to_numpy(zero_copy_only=False).astype(bool)), size, known, np.full(len(size), model.tokens), base, full]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    types = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.select("ids", "train", "size", "known", "base", "inside", "kinds").mapInArrow(run, types)
