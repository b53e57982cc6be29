"""Valid-time enrichment of sales: a stateful stream in which each version of a client owns the sales of its validity span.

A version of a client is valid from its valid_at until the client's next one. Its segment owns the waiting sales of that
span: inserting a version splits the segment of the one before it, the watermark H drains the sales that it has passed,
and pruning deletes the segments of versions that no sale can reach any more, which are empty by then.

Segments live in a MapState by pages: a page holds the segments that begin in one period of validity, as two Arrow tables
(versions, and waiting sales). A page that nothing touched isn't written again, and an emptied one is removed. One entry
for each segment would be 1.5 million puts and as many removals for 4 million rows; PySpark takes about 0.3 ms for each.

The state's key is a slot of many clients, so that a call has much to do. A client with more than HOT rows is cut into
spans of time, each a key of its own. Such a span needs three things that only the others know: the last version before
it (which owns the sales up to its own first version), the client's last version that H has passed (what comes before it
is pruned), and how many versions the client holds. Every batch takes them from notes that the spans left at the end of
the one before, and from its own changes; that is a row for each span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BATCHES, FIRST_DAY, DAYS, DELAY_US = 8, 19723, 152, 12 * 3_600_000_000
#: Rows of a slot and of a span of a hot client over the whole stream; a client with more than HOT rows is hot.
SLOT_ROWS, SPAN_ROWS, HOT = 8192, 2048, 16_384
#: A page is a period of validity of so many microseconds.
PAGE_US = 8 * 86_400_000_000
#: Stands for null in columns of longs, and for minus infinity in times; it sorts first.
NONE = -(1 << 63)
VERSION, SALE, TICK = 0, 1, 2

INPUT = "key string, kind int, client long, known boolean, at long, seq long, id long, op string, cents long, span int, n_held long, a_at long, a_seq long, a_id long"
OUTPUT = "rec string, id long, batch long, n_held long, change_id long, balance_cents long, op string, client long, t_at long, t_seq long, l_at long, l_seq long, l_id long"
VERSIONS = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("seq", pa.int64()), ("id", pa.int64()), ("cents", pa.int64()), ("op", pa.string())])
SALES = pa.schema([("client", pa.int64()), ("known", pa.bool_()), ("at", pa.int64()), ("id", pa.int64())])

Rows = dict[str, np.ndarray]


def _packed(rows: Rows, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type, from_pandas=True) for f in schema], schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(held: list[bytes], schema: pa.Schema) -> Rows:
    rows = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in held]) if held else schema.empty_table()
    return {f.name: rows[f.name].to_numpy() for f in schema}


def _taken(rows: Rows, at: np.ndarray) -> Rows:
    return {k: v[at] for k, v in rows.items()}


def _joined(a: Rows, b: Rows) -> Rows:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


def inserted(versions: Rows, new: Rows) -> Rows:
    """Versions by client in the order in which they follow each other: (valid_at, seq, change_id)."""
    both = _joined(versions, new)
    return _taken(both, np.lexsort((both["id"], both["seq"], both["at"], both["client"])))


def owners(versions: Rows, sales: Rows) -> np.ndarray:
    """The segment of each sale: the place of its client's last version with valid_at <= sold_at, or -1."""
    n = len(versions["at"])
    kind = np.repeat([0, 1], [n, len(sales["at"])])
    client = np.concatenate([versions["client"], sales["client"]])
    order = np.lexsort((kind, np.concatenate([versions["at"], sales["at"]]), client))
    last = np.maximum.accumulate(np.where(kind[order] == 0, order, -1)) if len(order) else order
    own = np.empty(len(order), np.int64)
    own[order] = last
    own = own[n:]
    hit = (own >= 0) & sales["known"] & (sales["at"] != NONE)
    hit[hit] = versions["client"][own[hit]] == sales["client"][hit]
    return np.where(hit, own, -1)


def pruned(versions: Rows, h: int) -> Rows:
    """Versions without those that another one of the client follows at H or before."""
    passed = versions["at"] <= h
    followed = np.zeros(len(passed), bool)
    followed[:-1] = passed[1:] & (versions["client"][1:] == versions["client"][:-1])
    return _taken(versions, ~(passed & followed)) if h != NONE else versions


def held(versions: Rows, sales: Rows) -> np.ndarray:
    """How many versions there are of each sale's client."""
    count = np.searchsorted(versions["client"], sales["client"], "right") - np.searchsorted(versions["client"], sales["client"], "left")
    return np.where(sales["known"], count, 0)


def _longs(values: object) -> pd.array:
    values = np.asarray(values, np.int64)
    return pd.arrays.IntegerArray(values, values == NONE)


class Segments(StatefulProcessor):
    """One batch of one start of the query: batch is its number, h the watermark (NONE: minus infinity), last drains all."""

    def __init__(self, batch: int, h: int, last: bool):
        self.batch, self.h, self.last = batch, h, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("segments", "period long", "versions binary, sales binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        new = pd.concat(list(rows))
        kinds = new["kind"].to_numpy()
        part = lambda kind, schema: {f.name: new[f.name].to_numpy()[kinds == kind] for f in schema}
        stored = {k[0]: (bytes(v[0]), bytes(v[1])) for k, v in self.pages.iterator()}
        versions = inserted(_unpacked([v for v, _ in stored.values()], VERSIONS), part(VERSION, VERSIONS))
        waiting = _joined(_unpacked([s for _, s in stored.values()], SALES), part(SALE, SALES))
        ticks = new[kinds == TICK]
        span = ticks.iloc[0] if len(ticks) and ticks["span"].iloc[0] >= 0 else None
        passed = np.ones(len(waiting["at"]), bool) if self.last else (waiting["at"] == NONE) | (waiting["at"] < self.h)
        out = _taken(waiting, passed)
        if len(out["at"]):
            yield self.emitted(versions, out, span)
        versions, waiting = pruned(versions, self.h), _taken(waiting, ~passed)
        self.store(stored, versions, waiting)
        if span is not None:
            yield self.note(versions, span)

    def emitted(self, versions: Rows, out: Rows, span: pd.Series | None) -> pd.DataFrame:
        own = owners(versions, out)
        n_held, found = held(versions, out), own >= 0
        picked = lambda name: np.where(found, versions[name][own], NONE) if len(versions["at"]) else np.full(len(own), NONE)
        at, seq, ids, cents = (picked(x) for x in ("at", "seq", "id", "cents"))
        op = np.where(found, versions["op"][own], None) if len(versions["at"]) else np.full(len(own), None)
        if span is not None:
            n_held = np.full(len(own), span["n_held"])
            if span["at"] != NONE:  # the version before this span owns what precedes its own first one
                head = ~found & (out["at"] != NONE)
                at, seq, ids, cents = (np.where(head, span[c], x) for c, x in (("at", at), ("seq", seq), ("id", ids), ("cents", cents)))
                op, found = np.where(head, span["op"], op), found | head
            anchor = span["a_at"], span["a_seq"], span["a_id"]
            gone = found & ((at < anchor[0]) | ((at == anchor[0]) & ((seq < anchor[1]) | ((seq == anchor[1]) & (ids < anchor[2])))))
            ids, cents, op = np.where(gone, NONE, ids), np.where(gone, NONE, cents), np.where(gone, None, op)
        return self.rows("sale", out["id"], n_held, ids, cents, op)

    def note(self, versions: Rows, span: pd.Series) -> pd.DataFrame:
        """What other spans need: how many versions H hasn't passed, the last one, and the last one that H has passed."""
        at = versions["at"]
        n = int((at <= self.h).sum()) if self.h != NONE else 0
        last = [versions[c][-1] if len(at) else NONE for c in ("at", "seq", "id", "cents")]
        low = [versions[c][n - 1] if n else NONE for c in ("at", "seq", "id")]
        more = dict(zip(("client", "t_at", "t_seq", "l_at", "l_seq", "l_id"), (span["client"], *last[:2], *low), strict=True))
        return self.rows("note", [span["span"]], [len(at) - n], [last[2]], [last[3]], [versions["op"][-1] if len(at) else None], **{k: [v] for k, v in more.items()})

    def rows(self, rec: str, ids: object, n_held: object, change: object, cents: object, op: object, **more: object) -> pd.DataFrame:
        n = len(ids)
        none = {k: [NONE] * n for k in ("client", "t_at", "t_seq", "l_at", "l_seq", "l_id")}
        longs = {"id": ids, "batch": [self.batch] * n, "n_held": n_held, "change_id": change, "balance_cents": cents} | none | more
        found = {"rec": [rec] * n, "op": op} | {k: _longs(v) for k, v in longs.items()}
        return pd.DataFrame(found)[[c.split()[0] for c in OUTPUT.split(", ")]]

    def store(self, stored: dict[int, tuple[bytes, bytes]], versions: Rows, waiting: Rows) -> None:
        """Each segment goes to the page in which its version begins; sales before any version have a page of their own."""
        own = owners(versions, waiting)
        period = versions["at"] // PAGE_US
        owned = np.where(own >= 0, period[own], NONE) if len(period) else np.full(len(own), NONE)
        pages = np.union1d(period, owned).tolist()
        for page in pages:
            value = _packed(_taken(versions, period == page), VERSIONS), _packed(_taken(waiting, owned == page), SALES)
            if stored.get(page) != value:
                self.pages.updateValue((page,), value)
        for page in stored.keys() - set(pages):
            self.pages.removeKey((page,))

    def close(self) -> None:
        pass
