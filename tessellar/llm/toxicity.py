"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word is embedded by the sum of hashed rows: two by independent hashes of the word (a rare word
seldom shares both with a telling one) and one by each of its prefixes of PREFIXES bytes, which words
of one stem share. Filters of several widths slide over the words; each
filter's highest response in the document, rectified, feeds a logistic layer. The rows start from
smoothed log odds of the words' documents, and everything is then trained by gradient descent.

Training reads every labelled row whole, one row of each id (the shortest). The rows' word hashes lie in shards of about SHARD_ROWS
rows, dealt by a hash of the id. The log odds count all rows; then in each of EPOCHS passes every shard descends from
the common model over all of its rows, and the shards' changes are averaged (parameter mixing): of a table's row over the shards that
moved it. The driver holds the model and its step sizes (42 MB), never rows. A fifth of the labelled rows does not train but calibrates:
scores are shifted so that 0.3 is where flagging gives the best F1 over all of them, and each language with at least MIN_LANG_ROWS
such rows has its own best threshold; they are counted by log odds in steps of 1 / STEPS. The score itself sees words only.

Scoring is a map over whole texts: long ones run in windows that overlap by the widest filter, and
take the maximum. Null and empty texts are scored as a document of padding. With no usable labels
every score is 0. Repeated rows are scored alike; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellar.llm.common import bucketed, discard, free, in_filter
from tessellar.llm.words import word_hash_groups

SHARD_ROWS = 4096
ROWS = 1 << 16
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
TABLES = 2 + len(PREFIXES)
EPOCHS = 6
BATCH = 64
RATE = 0.05
MIN_LANG_ROWS = 60
BLOCK_WORDS = 150_000
STEPS = 256
SLICES = 16  # of the tables' rows, when changes are averaged
PAD = ROWS  # the row of padding, held at zero
FLAG = 0.3


@dataclass
class Model:
    tables: list[np.ndarray]  # (ROWS + 1, DIM) each: by two hashes of the word, by one of each prefix
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray
    shift: float
    thresholds: dict = field(default_factory=dict)
    threshold: float = FLAG


def word_rows(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the row of each table (columns) of its words (rows), as 16-bit numbers: two of the word's hash, one of each prefix's."""
    for _, h, n in word_hash_groups(texts, PREFIXES):
        rows = np.concatenate([h[:, :1], h[:, :1] >> np.uint64(32), h[:, 1:]], axis=1).astype(np.uint16)
        yield from np.split(rows, np.cumsum(n)[:-1])


def _padded(docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each table's rows of all words, each document followed by padding; where documents start; their padded sizes."""
    gap = max(WIDTHS)
    sizes = np.array([len(d) + gap for d in docs])
    starts = np.cumsum(sizes) - sizes
    rows = [np.full(sizes.sum(), PAD, np.int64) for _ in range(TABLES)]
    flat = np.concatenate(docs)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(docs)) * gap, sizes - gap)
    for r, own in zip(rows, flat.T, strict=True):
        r[at] = own
    return rows, starts, sizes


def _embedded(m: Model, rows: list[np.ndarray]) -> np.ndarray:
    x = m.tables[0][rows[0]]
    for t, r in zip(m.tables[1:], rows[1:], strict=True):
        x += t[r]
    return x


def _responses(m: Model, x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each width the filters' responses at each place from which they do not reach into the next document."""
    out = []
    for w, f in zip(WIDTHS, m.filters, strict=True):
        n = len(x) - w + 1
        z = x[:n] @ f[0]
        for j in range(1, w):
            z += x[j : n + j] @ f[j]
            z[starts[1:] - j] = -np.inf
        out.append(z)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _blocks(docs: list[np.ndarray]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(owners, pieces): blocks of bounded size; longer documents in pieces that overlap by the widest filter."""
    step = BLOCK_WORDS - max(WIDTHS) + 1
    owner, pieces, words = [], [], 0
    for i, d in enumerate(docs):
        for k in range(0, max(len(d), 1), step):
            piece = d[k : k + BLOCK_WORDS]
            if pieces and words + len(piece) > BLOCK_WORDS:
                yield owner, pieces
                owner, pieces, words = [], [], 0
            owner.append(i)
            pieces.append(piece)
            words += len(piece)
    if pieces:
        yield owner, pieces


def _log_odds(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    best = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    for owner, pieces in _blocks(docs):
        rows, starts, _ = _padded(pieces)
        zs = _responses(m, _embedded(m, rows), starts)
        np.maximum.at(best, owner, np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in zs], axis=1))
    return np.maximum(best + m.bias, 0) @ m.out + m.shift


def score(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    """A score for each document's word rows, in blocks of bounded size."""
    return _sigmoid(_log_odds(m, docs))


def _tops(m: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The filters' highest responses, and for each width the table rows under them: (document, filter, word, table)."""
    best = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    spots = [np.full((len(docs), FILTERS, w, TABLES), PAD, np.int64) for w in WIDTHS]
    for owner, pieces in _blocks(docs):
        rows, starts, sizes = _padded(pieces)
        flat = np.stack(rows, axis=1)
        for i, (w, z) in enumerate(zip(WIDTHS, _responses(m, _embedded(m, rows), starts), strict=True)):
            own = best[:, i * FILTERS : (i + 1) * FILTERS]
            for d, s, n in zip(owner, starts.tolist(), sizes.tolist(), strict=True):
                p = z[s : min(s + n, len(z))].argmax(0) + s
                top = z[p, np.arange(FILTERS)]
                better = top > own[d]
                own[d, better] = top[better]
                spots[i][d, better] = flat[p[better][:, None] + np.arange(w)]
    return best, spots


def _seen(docs: Iterable[np.ndarray], y: Iterable[int]) -> np.ndarray:
    """(table, label, row): how many documents of the label hold the row."""
    seen = np.zeros((TABLES, 2, ROWS), np.int64)
    for d, label in zip(docs, y, strict=True):
        for k in range(TABLES):
            seen[k, int(label), np.unique(d[:, k])] += 1
    return seen


def _start(seen: np.ndarray, n0: int, n1: int, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    tables = []
    for k in range(TABLES):
        odds = np.log((seen[k, 1] + 1) / (n1 + 2)) - np.log((seen[k, 0] + 1) / (n0 + 2))
        odds -= np.log((n0 + 2) / (n1 + 2))  # a word that was never seen says nothing
        e = rng.normal(0, 0.02, (ROWS + 1, DIM)).astype(np.float32)
        e[:ROWS, 0] += np.clip(odds, -1, 4) / TABLES
        e[PAD] = 0
        tables.append(e)
    filters = []
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32)
        f[:, 0, : FILTERS // 2] += 1 / w
        filters.append(f)
    return Model(tables, filters, np.full(len(WIDTHS) * FILTERS, -0.5, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -2.0)


def _small(m: Model) -> list[np.ndarray]:
    """All that is not a table, as arrays."""
    return [*m.filters, m.bias, m.out, np.array([m.shift], np.float32)]


def _with_small(m: Model, small: list[np.ndarray]) -> Model:
    *filters, bias, out, shift = (a.astype(np.float32) for a in small)
    return Model(m.tables, filters, bias, out, float(shift[0]))


def _sums(m: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Squared gradients so far, by which steps get shorter: of the tables, and of the rest."""
    return [np.full_like(t, 1e-4) for t in m.tables], [np.full_like(a, 1e-4) for a in _small(m)]


def _epoch(m: Model, sums: tuple, docs: list[np.ndarray], y: np.ndarray, seed: tuple[int, ...]) -> tuple[Model, np.ndarray]:
    """(the model after one pass over docs, (table, row): which rows moved). m.tables and sums are changed in place.

    Gradient descent (with per-weight step sizes) on the logistic loss; only each filter's best word carries gradient.
    """
    small = [a.copy() for a in _small(m)]
    moved = np.zeros((TABLES, ROWS + 1), bool)

    def move(value: np.ndarray, s: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        s[at] += grad * grad
        value[at] -= RATE * grad / np.sqrt(s[at])

    order = np.random.default_rng(seed).permutation(len(docs))
    for k in range(0, len(order), BATCH):
        pick = order[k : k + BATCH]
        m = _with_small(m, small)
        tops, spots = _tops(m, [docs[i] for i in pick])
        f = np.maximum(tops + m.bias, 0)
        d = (_sigmoid(f @ m.out + m.shift) - y[pick].astype(np.float32))[:, None].astype(np.float32) / len(pick)
        df = d * m.out * (f > 0)
        grads, places = [], []
        for i, spot in enumerate(spots):
            g = df[:, i * FILTERS : (i + 1) * FILTERS]
            x = sum(t[spot[..., n]] for n, t in enumerate(m.tables))
            has = g != 0
            grads.append((g[has][:, None, None] * np.broadcast_to(m.filters[i].transpose(2, 0, 1), spot.shape[:3] + (DIM,))[has]).reshape(-1, DIM))
            places.append(spot[has].reshape(-1, TABLES))
            move(small[i], sums[1][i], np.einsum("nf,nfjd->jdf", g, x) + 1e-4 * m.filters[i])
        rest = (df.sum(0), (f * d).sum(0) + 1e-4 * m.out, d.sum(0))
        for n, grad in enumerate(rest, len(WIDTHS)):
            move(small[n], sums[1][n], grad)
        grad, place = np.concatenate(grads), np.concatenate(places)
        for n, table in enumerate(m.tables):
            own, inverse = np.unique(place[:, n], return_inverse=True)
            total = np.zeros((len(own), DIM), np.float32)
            np.add.at(total, inverse, grad)
            move(table, sums[0][n], total, own)
            table[PAD] = 0
            moved[n, own] = True
    return _with_small(m, small), moved


def _best_threshold(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score from which flagging gives the best F1, halfway to the next lower score."""
    order = np.argsort(-s)
    s, y, weight = s[order], y[order], weight[order]
    hit, said = np.cumsum(y * weight), np.cumsum(weight)
    f1 = 2 * hit / (said + (y * weight).sum())
    last = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], share: float) -> Model | None:
    """What fit does, for all rows in one place. docs: word rows; share: how many rows are toxic where scores are to be probabilities."""
    if not 0 < y.sum() < len(y):
        return None
    part = np.arange(len(docs)) % 5 == 4
    fit = np.flatnonzero(~part) if 0 < y[~part].sum() < (~part).sum() else np.arange(len(docs))
    own, yy = [docs[i] for i in fit], y[fit]
    m = _start(_seen(own, yy), int((yy == 0).sum()), int(yy.sum()))
    sums = _sums(m)
    for epoch in range(EPOCHS):
        m, _ = _epoch(m, sums, own, yy, (11, epoch, 0))
    prior = yy.mean()
    m.shift += float(np.log(share / (1 - share)) - np.log(prior / (1 - prior)))
    held = np.flatnonzero(part)
    if len(held) and 0 < y[held].sum() < len(held):
        yy = y[held]
        weight = np.where(yy == 1, share / yy.mean(), (1 - share) / (1 - yy.mean()))
        _calibrate(m, _steps(m, [docs[i] for i in held]), yy, weight, np.ones(len(held)), [langs[i] for i in held])
    return m


def _steps(m: Model, docs: list[np.ndarray]) -> np.ndarray:
    return np.rint(np.clip(_log_odds(m, docs), -40, 40) * STEPS).astype(np.int32)


def _calibrate(m: Model, steps: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, langs: list[str | None]) -> None:
    """Sets thresholds from rows that did not train: each entry stands for so many rows of a label, at so many steps of log odds."""
    s = _sigmoid(steps / STEPS)
    m.threshold = _best_threshold(s, y, weight)
    lang = np.array([x or "" for x in langs])
    for name in set(lang.tolist()) - {""}:
        own = lang == name
        n, toxic = rows[own].sum(), (rows[own] * y[own]).sum()
        if n >= MIN_LANG_ROWS and 0 < toxic < n:
            m.thresholds[name] = _best_threshold(s[own], y[own], weight[own])
    move = _logit(FLAG) - _logit(m.threshold)
    m.shift, m.threshold = m.shift + move, FLAG
    m.thresholds = {name: float(_sigmoid(_logit(t) + move)) for name, t in m.thresholds.items()}


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [r.tobytes() for r in word_rows(batch.column(2).to_pylist())]
        rest = [batch.column(k) for k in (0, 1, 3, 4)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(words, pa.binary())], names=["shard", "doc_id", "lang", "toxic", "words"])


def _words(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, TABLES) for x in column]


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, doc_id, lang, toxic, words, calibrates) of every labelled row that is not held out, stored by shard; of each id the shortest text."""
    spark = documents.sparkSession
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = usable.count()
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-count // SHARD_ROWS)))).cast("int").alias("shard")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    texts = in_filter(texts, "doc_id", usable.select("doc_id"), count, "wanted").where("wanted")  # other texts do not move
    texts = texts.select(shard, "doc_id", F.struct(F.length("text").alias("n"), "text", "lang").alias("r"), F.lit(None).cast("int").alias("toxic"))
    both = texts.unionByName(usable.select(shard, "doc_id", F.lit(None).cast(texts.schema["r"].dataType).alias("r"), "toxic"))
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    rows = both.groupBy("shard", "doc_id").agg(F.min("r").alias("r"), F.max("toxic").alias("toxic")).where("r is not null and toxic is not null")
    rows = rows.select("shard", "doc_id", "r.text", "r.lang", "toxic").select("shard", "doc_id", "text", "lang", "toxic")
    rows = rows.mapInArrow(_hashed, "shard int, doc_id long, lang string, toxic int, words binary")
    return bucketed(rows.withColumn("calibrates", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4), "toxic_words", "shard")


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Trains on all labelled rows, none of them held out."""
    table = labelled(documents, labels)
    try:
        return _fit(table)
    finally:
        discard(table)


def _fit(table: DataFrame) -> Model | None:
    spark = table.sparkSession
    n = {(r["calibrates"], r["toxic"]): r["n"] for r in table.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}
    of = lambda label, *parts: sum(n.get((p, label), 0) for p in parts)
    if not of(0, True, False) or not of(1, True, False):
        return None
    parts = (False,) if of(0, False) and of(1, False) else (True, False)
    rows = table.where(F.col("calibrates").isin(*parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((TABLES, 2, ROWS), np.int64)
        for b in batches:
            seen += _seen(_words(b.column(1)), b.column(0).to_pylist())
        own = np.split(seen, SLICES, axis=2)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], names=["slice", "seen"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("seen"))
        return pa.table({"slice": t.column("slice")[:1], "seen": pa.array([total.tobytes()], pa.binary())})

    counted = rows.select("toxic", "words").mapInArrow(count, "slice int, seen binary").groupBy("slice").applyInArrow(summed, "slice int, seen binary").toArrow()
    own = dict(zip(counted.column("slice").to_pylist(), counted.column("seen").to_pylist(), strict=True))
    seen = np.concatenate([np.frombuffer(own[k], np.int64).reshape(TABLES, 2, -1) for k in range(SLICES)], axis=2)
    m = _start(seen, of(0, *parts), of(1, *parts))
    sums = _sums(m)
    for epoch in range(EPOCHS):
        m, sums = _mixed(m, sums, rows, epoch)
    if parts == (False,) and of(0, True) and of(1, True):
        _calibrate(m, *_counted(spark, m, table.where("calibrates")))
    return m


def _mixed(m: Model, sums: tuple, rows: DataFrame, epoch: int) -> tuple[Model, tuple]:
    """The model after each shard's pass over its rows, their changes averaged in the order of the shards."""
    shared = rows.sparkSession.sparkContext.broadcast((m, sums))

    def descend(t: pa.Table) -> pa.Table:
        before, (table_sums, small_sums) = shared.value
        shard = t.column("shard")[0].as_py()
        t = t.sort_by("doc_id")
        after = Model([x.copy() for x in before.tables], before.filters, before.bias, before.out, before.shift)
        steps = ([x.copy() for x in table_sums], [x.copy() for x in small_sums])
        after, moved = _epoch(after, steps, _words(t.column("words")), t.column("toxic").to_numpy(), (11, epoch, shard))
        out = []
        for k in range(SLICES):
            keys = np.flatnonzero(moved[:, ROWS * k // SLICES : ROWS * (k + 1) // SLICES])
            table, row = np.divmod(keys, ROWS // SLICES)
            row = row + ROWS * k // SLICES
            values = [np.concatenate([after.tables[n][own] - before.tables[n][own], steps[0][n][own]], axis=1) for n in range(TABLES) for own in (row[table == n],)]
            out.append((k, (table * ROWS + row).astype(np.int32), np.concatenate(values)))
        flat = np.concatenate([x.ravel() for x in (*_small(after), *steps[1])]).astype(np.float32)
        out.append((SLICES, np.zeros(1, np.int32), flat))
        return pa.table({"slice": pa.array([k for k, _, _ in out], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "at": pa.array([a.tobytes() for _, a, _ in out], pa.binary()), "value": pa.array([v.astype(np.float32).tobytes() for _, _, v in out], pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        at = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in t.column("at")])
        value = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in t.column("value")]).reshape(len(at), -1 if len(at) else 1)
        order = np.argsort(at, kind="stable")
        own, first, n = np.unique(at[order], return_index=True, return_counts=True)
        got = np.add.reduceat(value[order].astype(np.float64), first, axis=0) / n[:, None] if len(own) else value
        return pa.table({"slice": t.column("slice")[:1], "at": pa.array([own.astype(np.int32).tobytes()], pa.binary()), "value": pa.array([got.astype(np.float32).tobytes()], pa.binary())})

    moved = rows.select("shard", "doc_id", "toxic", "words").groupBy("shard").applyInArrow(descend, "slice int, shard int, at binary, value binary")
    got = moved.groupBy("slice").applyInArrow(mean, "slice int, at binary, value binary").toArrow()
    shared.destroy()
    table_sums, small_sums = sums
    for k, at, value in zip(got.column("slice").to_pylist(), got.column("at").to_pylist(), got.column("value").to_pylist(), strict=True):
        at, value = np.frombuffer(at, np.int32), np.frombuffer(value, np.float32)
        if k < SLICES:
            value = value.reshape(len(at), 2 * DIM)
            for n in range(TABLES):
                own = at // ROWS == n
                m.tables[n][at[own] % ROWS] += value[own, :DIM]
                table_sums[n][at[own] % ROWS] = value[own, DIM:]
        else:
            shapes = [x.shape for x in _small(m)] * 2
            flat = [x.reshape(s) for x, s in zip(np.split(value, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes, strict=True)]
            small, small_sums = flat[: len(flat) // 2], [x.copy() for x in flat[len(flat) // 2 :]]
    return _with_small(m, small), (table_sums, small_sums)


def _counted(spark: SparkSession, m: Model, rows: DataFrame) -> tuple:
    """What _calibrate needs of rows: how many there are of each language, label and step of log odds."""
    shared = spark.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = _steps(shared.value, _words(b.column(2))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(steps, pa.int32())], names=["lang", "toxic", "step"])

    got = rows.select("lang", "toxic", "words").mapInArrow(run, "lang string, toxic int, step int").groupBy("lang", "toxic", "step").agg(F.count("*").alias("n")).toPandas()
    shared.destroy()
    got = got.sort_values(["step", "toxic", "lang"], ignore_index=True)
    n = got["n"].to_numpy(float)
    return got["step"].to_numpy(), got["toxic"].to_numpy(), n, n, [x if isinstance(x, str) else None for x in got["lang"]]


def apply(documents: DataFrame, model: Model | None, score_name: str, threshold_name: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """documents' own columns and two more (double): the score and the threshold of the row's language. A map over whole texts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = documents.columns
    at, lang_at = names.index(text), names.index(lang)
    schema = T.StructType([*documents.schema.fields, T.StructField(score_name, T.DoubleType()), T.StructField(threshold_name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                s, t = np.zeros(batch.num_rows), np.full(batch.num_rows, 2.0)
            else:
                s = score(m, list(word_rows(batch.column(at).to_pylist()))) if batch.num_rows else np.zeros(0)
                t = np.array([m.thresholds.get(x, m.threshold) for x in batch.column(lang_at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s.astype(float)), pa.array(t)], names=[*names, score_name, threshold_name])

    return documents.mapInArrow(run, schema)


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more), and flagged: by the language's own threshold."""
    scored = apply(documents.select("doc_id", "text", "lang"), fit(documents, labels), "score", "threshold")
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= FLAG).cast("int").alias("predicted"),
        (F.col("score") >= F.col("threshold")).cast("int").alias("flagged"),
    )


def reject(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those whose score reaches their language's threshold."""
    s, t = free(documents, "__score", "__threshold")
    return apply(documents, fit(documents, labels), s, t).where(F.col(s) < F.col(t)).drop(s, t)
