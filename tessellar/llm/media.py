"""Media columns: payloads in content-defined chunks, stored once, and rebuilt from ordered chunk lists.

A text's UTF-8 bytes, filled up with spaces to a positive multiple of UNIT, are the samples of an
8-bit mono WAV file (44 bytes of header). The file is cut where the gear hash of the last 32 bytes
has its top bits zero, at least LEAST and at most MOST bytes apart; equal content is cut alike
wherever it stands.

1. A first pass keeps each row's recipe: the digests and lengths of its chunks.
2. Digests that occur more than once are found by a grouped count. They go into a Bloom filter sized
   by their number (at most 128 MB); false positives only send a chunk the longer way.
3. A second pass writes the store: chunks that occur once stay together in their file's pack, the
   others become rows that are deduplicated by digest. What will be shuffled is compressed first.
4. Reading back, packs that miss no chunk are read as they are; for the others a join on the digest
   brings the shared chunks, and the ordered list puts the file together. Every chunk's digest and
   the file's digest are verified before features are computed, once for each different file; the
   rows then take them by the file's digest. Features of the few files that very many rows share, and
   the few chunks that very many files share, are broadcast instead, so no task holds a hot group.

Null texts count as empty. Equal texts have equal values; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import Filter, hot_join, stored

UNIT = 192
LEAST, MASK_BITS, MOST = 512, 10, 16_384
RATE = 8000

_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear %d" % i).digest()[:4] for i in range(256)), "<u4").astype(np.uint32)


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(samples: bytes) -> bytes:
    n = len(samples)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this writer")
    n = struct.unpack("<I", media[40:44])[0]
    if len(media) != 44 + n:
        raise ValueError("a WAV file of another length than it says")
    return media[44:]


def gear(data: bytes) -> np.ndarray:
    """At each byte the rolling gear hash (shift by one, add the byte's number, 32 bits) of all bytes up to it."""
    h, n = _GEAR[np.frombuffer(data, np.uint8)], 1
    while n < 32:
        h[n:] += h[:-n].copy() << np.uint32(n)
        n *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    ends = (np.flatnonzero((gear(data) >> np.uint32(32 - MASK_BITS)) == 0) + 1).tolist()
    out, last = [], 0
    for e in [*ends, len(data)]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == len(data):
            out.append(e)
            last = e
    return out


def digest(chunk: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(chunk, digest_size=16).digest())


def chunked(media: bytes) -> list[tuple[int, int, bytes]]:
    at, out = 0, []
    for e in cuts(media):
        out.append((*digest(media[at:e]), media[at:e]))
        at = e
    return out


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            p, n = payload(text)
            media = to_wav(p)
            chunks = chunked(media)
            rows.append((n, hashlib.sha256(media).digest(), [c[0] for c in chunks], [c[1] for c in chunks]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "media", "hi", "lo"])


def features(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    mid = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((mid[1:] < 0) != (mid[:-1] < 0)))
    return f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((mid * mid).mean()):.4f};min={x.min()};max={x.max()};crossings={crossings}"


FEATURES = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_back(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    out = []
    for name, media in rows:
        if hashlib.sha256(media).digest() != name:
            raise ValueError("a stored file differs from the one that was written")
        p = from_wav(media)
        out.append((name, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), name.hex(), features(p)))
    cols = list(zip(*out, strict=True)) if out else [[]] * 7
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split(" ")[0] for f in FEATURES.split(", ")])


def store(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Writes recipes, whole files, packs that miss chunks, and shared chunks; returns the four tables as they are stored."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    recipes = stored(rows.mapInArrow(_recipes, "doc_id long, n_bytes long, media binary, hi array<long>, lo array<long>"), "recipes")
    each = recipes.select(F.explode(F.arrays_zip("hi", "lo")).alias("c")).select("c.hi", "c.lo")
    repeated = each.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").select("hi", "lo")
    repeated = stored(repeated, "repeated")
    shared = df.sparkSession.sparkContext.broadcast(Filter(repeated, "lo", repeated.count()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = shared.value
        pack = zstandard.ZstdCompressor(level=3).compress
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        names = ["kind", "media", "hi", "lo", "his", "los", "sizes", "data"]
        for b in batches:
            out, seen, texts = [], set(), set()
            for text in b.column(1).to_pylist():
                if text in texts:  # the same file within the batch
                    continue
                texts.add(text)
                media = to_wav(payload(text)[0])
                name, chunks = hashlib.sha256(media).digest(), chunked(media)
                his, los = [c[0] for c in chunks], [c[1] for c in chunks]
                again = repeated.has(np.array(los).view(np.uint64))
                if not again.any():
                    out.append((0, name, None, None, None, None, None, media))
                    continue
                # Sizes: of a chunk in the pack; -1: the chunk is a row of its own.
                sizes = [-1 if a else len(c[2]) for a, c in zip(again, chunks, strict=True)]
                out.append((1, name, None, None, his, los, sizes, pack(b"".join(c[2] for a, c in zip(again, chunks, strict=True) if not a))))
                for a, c in zip(again, chunks, strict=True):
                    if a and c[:2] not in seen:
                        seen.add(c[:2])
                        out.append((2, None, c[0], c[1], None, None, None, pack(c[2])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    schema = "kind int, media binary, hi long, lo long, his array<long>, los array<long>, sizes array<int>, data binary"
    written = stored(rows.mapInArrow(split, schema), "packs", partition_by=["kind"])
    whole = written.where("kind = 0").select("media", "data")
    packs = written.where("kind = 1").groupBy("media").agg(*(F.first(c).alias(c) for c in ("his", "los", "sizes", "data")))
    chunks = stored(written.where("kind = 2").groupBy("hi", "lo").agg(F.first("data").alias("data")), "chunks")
    return recipes, whole, stored(packs, "parts"), chunks


def read_back(whole: DataFrame, packs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Features of every stored file, put together from the store alone."""

    def from_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_back(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))

    def from_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for r in b.to_pylist():
                lent, own = {c["at"]: unpack(c["data"]) for c in r["lent"]}, unpack(r["data"])
                at, pieces = 0, []
                for i, (hi, lo, size) in enumerate(zip(r["his"], r["los"], r["sizes"], strict=True)):
                    piece = lent[i] if size < 0 else own[at : at + size]
                    at += max(size, 0)
                    if digest(piece) != (hi, lo):
                        raise ValueError("a stored chunk differs from its digest")
                    pieces.append(piece)
                out.append((r["media"], b"".join(pieces)))
            yield _read_back(out)

    wanted = packs.select("media", F.posexplode(F.arrays_zip("his", "los", "sizes")).alias("at", "c")).where("c.sizes < 0").select("media", "at", F.col("c.his").alias("hi"), F.col("c.los").alias("lo"))
    lent = hot_join(wanted, chunks, ["hi", "lo"], 1000).groupBy("media").agg(F.collect_list(F.struct("at", "data")).alias("lent"))  # of one file
    parts = packs.join(lent, "media").select("media", "his", "los", "sizes", "data", "lent")
    return whole.mapInArrow(from_whole, FEATURES).unionByName(parts.mapInArrow(from_parts, FEATURES))


def report(df: DataFrame) -> DataFrame:
    recipes, whole, packs, chunks = store(df)
    found = stored(read_back(whole, packs, chunks).dropDuplicates(["media"]), "features")
    rows = recipes.select("doc_id", "n_bytes", "media")
    return hot_join(rows, found, ["media"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
