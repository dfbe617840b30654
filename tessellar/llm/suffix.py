"""Exact removal of repeated 200-byte strings, with suffix arrays by induced sorting (sais.py) in shards.

A window is WINDOW bytes of one document. Equal windows hold the same GRAM-byte string of least hash
(the leftmost of equals) at the same place, their anchor, so windows need to meet only where anchors are equal.

1. A first pass keeps, for each anchor occurrence, the anchor's hash and that of its context: the
   bytes of all windows that it stands for. A grouped count says which anchors occur once (their
   windows are unique), always in the same context, or in different contexts. The last two sets become
   Bloom filters sized by their keys (at most 128 MB each); false positives only let unneeded rows pass.
2. A second pass writes what the filters let through, a context's bytes once for each task that meets it. Contexts
   are counted by anchor and hash (128 bits together): all windows of one that occurs again repeat. What is left
   are anchors with different contexts, each context once. They go, with their bytes, to shards by
   anchor. Contexts of one anchor are one string of the shard; suffixes are
   classified, leftmost smaller substrings sorted recursively and all suffixes induced from them, and
   the permuted common prefix of each window with its predecessor tells which ones repeat.
   An anchor with more than CONTEXTS different contexts is cut finer first: into halves of its
   windows' range, each by the bytes common to that half. Contexts of anchors that occur more than HOT
   times (a third filter says which) are cut into ranges of STRETCH windows instead, which are counted by the
   bytes common to the range: once, and all its windows are unique; always in the same context, and all
   repeat; the few others, at the ends of a common passage, are counted window by window. So no task
   ever holds a whole hot group.
3. Runs of repeated windows are joined to their documents, which remove the bytes they cover.

Null texts count as empty; texts shorter than WINDOW lose nothing. Repeated rows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import Filter, stored
from tessellar.llm.sais import suffix_arrays

WINDOW, GRAM = 200, 100
REACH = WINDOW - GRAM + 1  # windows that can share an anchor
PIECE = 1 << 20
CONTEXTS = 64
HOT = 20_000
STRETCH = 8
SYMBOLS = 2_000_000  # of the strings that one call sorts

_MULT = 0x9E3779B97F4A7C15
_BYTE = np.frombuffer(b"".join(hashlib.sha256(b"byte %d" % i).digest()[:8] for i in range(256)), "<u8")


def rolling(data: np.ndarray, width: int, mult: int = _MULT) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each run of width bytes, put together from runs of powers of two."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    n = len(data) - width + 1
    out, done, run, size = np.zeros(n, np.uint64), 0, _BYTE[data], 1
    while True:
        if width & size:
            out = out * np.uint64(pow(mult, size, 1 << 64)) + run[done : done + n]
            done += size
        if size * 2 > width:
            break
        run = run[:-size] * np.uint64(pow(mult, size, 1 << 64)) + run[size:]
        size *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, place, first window, windows) of each anchor of a document, in pieces of bounded size; every window once."""
    for at in range(0, max(1, len(raw) - WINDOW + 1), PIECE - WINDOW):
        data = np.frombuffer(raw, np.uint8)[at : at + PIECE - 1]
        if len(data) < WINDOW:
            return
        h = rolling(data, GRAM)
        low = np.uint64(PIECE - 1)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), REACH)[: PIECE - WINDOW] & low
        cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = least[cut].astype(np.int64)
        yield h[place], place + at, cut + at, np.diff(np.append(cut, len(least)))


def repeated_windows(groups: list[list[tuple[bytes, int, int]]]) -> list[np.ndarray]:
    """For each group of different contexts (bytes, anchor's place in them, windows): a row for each context, a column for
    each distance from window to anchor, true where that window occurs again in the group."""
    out = [np.zeros((len(g), REACH), bool) for g in groups]
    order = sorted(range(len(groups)), key=lambda k: -sum(len(c[0]) + 1 for c in groups[k]))
    at = 0
    while at < len(order):
        to, size = at, 0
        while to < len(order) and (to == at or size < SYMBOLS):
            size += sum(len(c[0]) + 1 for c in groups[order[to]])
            to += 1
        _sort_shard([groups[k] for k in order[at:to]], [out[k] for k in order[at:to]])
        at = to
    return out


def _sort_shard(groups: list[list[tuple[bytes, int, int]]], out: list[np.ndarray]) -> None:
    joined = [b"\x00".join(c[0] for c in g) for g in groups]  # a place holder between contexts, and one for the end
    sizes = np.array([len(j) + 1 for j in joined])
    off = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"\x00".join(joined) + b"\x00", np.uint8)
    t = raw.astype(np.int32) + 2
    lens = np.array([len(c[0]) + 1 for g in groups for c in g])
    begins = np.cumsum(lens) - lens
    t[begins + lens - 1] = 1
    t[off[1:] - 1] = 0
    sa = suffix_arrays(t, off)
    # Which places are windows, of which context, how far before the anchor.
    windows = np.array([c[2] for g in groups for c in g])
    place = np.repeat(begins, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window = np.zeros(len(t), bool)
    is_window[place] = True
    # Permuted prefixes: of each window with the suffix before it in order, as far as they matter.
    a, b = sa[:-1], sa[1:]
    live = np.flatnonzero(is_window[a] & is_window[b])
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    for s in (WINDOW - 8, 0, *range(8, WINDOW - 8, 8)):
        live = live[(words[a[live] + s] == words[b[live] + s]).all(axis=1)]
    again = np.zeros(len(t), bool)
    again[a[live]] = True
    again[b[live]] = True
    # Groups' shards meet in sa only at a shard's end marker, which is no window.
    hits = place[again[place]]
    context = np.searchsorted(begins, hits, side="right") - 1
    first = np.cumsum([0, *(len(g) for g in groups)])
    group = np.searchsorted(first, context, side="right") - 1
    anchor = np.array([c[1] for g in groups for c in g])
    for k, c, d in zip(group.tolist(), (context - first[group]).tolist(), (anchor[context] - (hits - begins[context])).tolist(), strict=True):
        out[k][c, d] = True


class _Shards:
    """Contexts of anchors, cut until groups are small, then sorted together; finds repeated windows of rows."""

    def __init__(self):
        self.groups: list[list[tuple[bytes, int, int]]] = []
        self.members: list[list[list[int]]] = []

    def add(self, mask: np.ndarray, rows: list[tuple[bytes, int, int, list[int]]], low: int = 0, high: int = REACH) -> None:
        """rows: different contexts (bytes, anchor's place, windows, rows of mask) whose windows are low to high - 1 bytes before the anchor."""
        for data, place, n, own in rows:
            if len(own) > 1:
                for r in own:
                    mask[r, place - n + 1 : place + 1] = True
        if len(rows) < 2:
            return
        if len(rows) <= CONTEXTS:
            self.groups.append([r[:3] for r in rows])
            self.members.append([r[3] for r in rows])
            return
        for x, y in ((low, (low + high) // 2), ((low + high) // 2, high)):
            cores: dict[bytes, dict[tuple[bytes, int], list]] = {}
            for data, place, n, own in rows:
                far, near = min(place, y - 1), max(place - n + 1, x)  # distances of its windows in this half
                if far >= near and y > x:
                    part = data[place - far : place - near + WINDOW]
                    core = data[place - x : place - y + 1 + WINDOW]
                    entry = cores.setdefault(core, {}).setdefault((part, far), [part, far, far - near + 1, []])
                    entry[3].extend(own)
            for same in cores.values():
                self.add(mask, [tuple(e) for e in same.values()], x, y)

    def finish(self, mask: np.ndarray) -> None:
        for members, found in zip(self.members, repeated_windows(self.groups), strict=True):
            for own, row in zip(members, found, strict=True):
                mask[own] |= row


#: Contexts of which one task remembers that it has written their bytes.
WRITTEN = 500_000
NAMES = ("h", "ctx", "kind", "doc_id", "th", "start", "n", "place", "data")
TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
SCHEMA = "h long, ctx long, kind int, doc_id long, th long, start long, n int, place int, data binary"


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range of windows of each context, cut at fixed distances from the anchor: hashes of its common bytes and of all, and all bytes."""
    for b in batches:
        out: list = [[] for _ in range(7)]
        for d, th, start, n, place, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            for h, ctx, first, m, part in _ranges(data, place, n):
                for c, v in zip(out, (h, ctx, d, th, start + first, m, part), strict=True):
                    c.append(v)
        kinds = (pa.int64(),) * 6 + (pa.binary(),)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "ctx", "doc_id", "th", "start", "n", "data"])


def _ranges(raw: bytes, place: int, n: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    near, far = place - n + 1, place
    for g in range(near // STRETCH, far // STRETCH + 1):
        low, high = max(near, g * STRETCH), min(far, g * STRETCH + STRETCH - 1)
        core = raw[place - g * STRETCH : place - g * STRETCH - STRETCH + 1 + WINDOW]
        data = raw[place - high : place - low + WINDOW]
        yield _signed(xxhash.xxh64_intdigest(core, g + 1)), _signed(xxhash.xxh64_intdigest(data, high)), place - high, high - low + 1, data


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each stretch with two hashes of it."""
    for b in batches:
        out: list = [[], [], [], [], [], []]
        for d, th, start, n, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            for k in range(n):
                w = data[k : k + WINDOW]
                for c, v in zip(out, (_signed(xxhash.xxh64_intdigest(w)), _signed(xxhash.xxh64_intdigest(w, 1)), d, th, start + k, 1), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h", "ctx", "doc_id", "th", "start", "n"])


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, start, end): covered stretches (bytes, end exclusive) of the text with that id and hash; they may overlap."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(F.octet_length("text") >= WINDOW)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, cs = [np.zeros(0, np.uint64)], []
            for t in b.column(2).to_pylist():
                raw = t.encode()
                for h, _, first, n in anchors(raw):
                    hs.append(h)
                    cs += [xxhash.xxh64_intdigest(raw[s : s + k + WINDOW - 1]) for s, k in zip(first.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.array(cs, np.uint64).view(np.int64))], names=["h", "ctx"])

    seen = rows.mapInArrow(keys, "h long, ctx long").groupBy("h").agg(F.count("*").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"))
    known = stored(seen.where("n > 1"), "anchors")
    sets = (F.col("low") == F.col("high"), F.col("low") != F.col("high"), (F.col("low") != F.col("high")) & (F.col("n") > HOT))
    total, *counts = (x or 0 for x in known.agg(F.sum("n"), *(F.count_if(c) for c in sets)).first())
    shared = df.sparkSession.sparkContext.broadcast(tuple(Filter(known.where(c), "h", n) for c, n in zip(sets, counts, strict=True)))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, mixed, hottest = shared.value
        written: set = set()
        for b in batches:
            out: list = [[] for _ in NAMES]
            for d, th, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode()
                for h, place, first, n in anchors(raw):
                    in_mixed = mixed.has(h)
                    at = np.flatnonzero(in_mixed | same.has(h))
                    if not len(at):
                        continue
                    starts, windows, places = first[at], n[at], place[at] - first[at]
                    kinds = np.where(in_mixed[at], 1 + hottest.has(h[at]), 0)
                    parts = [raw[s : s + m + WINDOW - 1] for s, m in zip(starts.tolist(), windows.tolist(), strict=True)]
                    ctx = [xxhash.xxh64_intdigest(part, p) for part, p in zip(parts, places.tolist(), strict=True)]
                    data = [None] * len(at)
                    for k in np.flatnonzero(kinds).tolist():
                        if ctx[k] not in written:
                            written.add(ctx[k])
                            data[k] = parts[k]
                    if len(written) > WRITTEN:
                        written.clear()
                    own = (h[at].view(np.int64).tolist(), map(_signed, ctx), kinds.tolist(), [d] * len(at), [th] * len(at), starts.tolist(), windows.tolist(), places.tolist(), data)
                    for c, v in zip(out, own, strict=True):
                        c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, TYPES, strict=True)], names=list(NAMES))

    passed = stored(rows.mapInArrow(sent, SCHEMA), "contexts")
    one = F.first(F.when(F.col("data").isNotNull(), F.struct("doc_id", "th", "start", "n", "place", "data")), ignorenulls=True)
    contexts = stored(passed.groupBy("h", "ctx").agg(F.count("*").alias("times"), F.max("kind").alias("kind"), one.alias("one")).where("times > 1 or kind > 0"), "counted", partition_by=["kind"])
    again = contexts.where("times > 1").select("h", "ctx")
    settled = passed.select("h", "ctx", "doc_id", "th", "start", F.col("n").cast("long").alias("n")).join(again, ["h", "ctx"], "left_semi").drop("h", "ctx")
    cut = stored(contexts.where("kind = 2").select("one.*").mapInArrow(_stretches, "h long, ctx long, doc_id long, th long, start long, n long, data binary"), "ranges")
    ranges = cut.groupBy("h").agg(F.count("*").alias("times"), (F.min("ctx") == F.max("ctx")).alias("same")).where("times > 1").select("h", "same")
    cut = stored(cut.join(ranges, "h").select("doc_id", "th", "start", "n", F.when(~F.col("same"), F.col("data")).alias("data")), "stretches")
    each = cut.where("data is not null").mapInArrow(_single, "h long, ctx long, doc_id long, th long, start long, n long")
    twice = each.groupBy("h", "ctx").agg(F.count("*").alias("times")).where("times > 1").select("h", "ctx")
    known_runs = each.join(twice, ["h", "ctx"], "left_semi").drop("h", "ctx").unionByName(cut.where("data is null").drop("data")).unionByName(settled)
    exact = known_runs.select("doc_id", "th", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end"))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts come by anchor; as many anchors as make a good shard are sorted together."""
        held: list[tuple] = []  # hash, times, id and hash of the text, first window, windows, anchor's place, bytes
        size = 0

        def flush(held: list[tuple]) -> pa.RecordBatch:
            mask = np.zeros((len(held), REACH), bool)
            shards = _Shards()
            at = 0
            while at < len(held):
                to = at
                while to < len(held) and held[to][0] == held[at][0]:
                    to += 1
                shards.add(mask, [(held[k][7], held[k][6], held[k][5], [k]) for k in range(at, to)])
                at = to
            shards.finish(mask)
            out: list = [[], [], [], []]
            mask[[k for k, r in enumerate(held) if r[1] > 1]] = False  # all of theirs are known to repeat
            edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            for (r, near), (_, past) in zip(np.argwhere(edges == 1).tolist(), np.argwhere(edges == -1).tolist(), strict=True):
                _, _, d, th, start, _, place, _ = held[r]
                for c, v in zip(out, (d, th, start + place - past + 1, start + place - near + WINDOW), strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "th", "start", "end"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > 4 * SYMBOLS and held[-1][0] != r[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[-1])
        if held:
            yield flush(held)

    mixed_rows = contexts.where("kind = 1").select("h", "times", "one.*")
    parts = max(12, -(-total // 40_000))
    ordered = mixed_rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(sort, "doc_id long, th long, start long, end long")
    return exact.unionByName(ordered)


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept for each row of df."""
    cover = repeats(df, doc_id, text).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one text
    cover = cover.select(F.col("doc_id").alias("__d"), F.col("th").alias("__th"), "spans")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = docs.join(cover, docs["doc_id"].eqNullSafe(cover["__d"]) & (F.xxhash64("text") == cover["__th"]), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [[], [], [], [], [], []]
            for d, t, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = t.encode()
                runs: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                gone = sum(e - s for s, e in runs)
                for c, v in zip(out, (d, len(raw), gone, len(runs), kept.hexdigest(), len(raw) - gone), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long")
