"""Media columns as ISO base media files.

``to_media`` stores each payload as 8-bit mono PCM in one file image: ``ftyp``, ``moov`` (track headers
and sample tables) and ``mdat``. ``probe_media`` walks the nested boxes of any such image, decodes the
sample tables and gives codec, duration and the byte ranges of the keyframes; payload bytes are located
by the tables and never decoded.

Edge cases: a null text is the empty text, stored as one block of zeros; texts of a multiple of 64 bytes
get no padding; repeated rows give repeated results; an empty table gives no rows; a null or broken media
value (tables that contradict each other or the file, samples outside the media data, boxes nested deeper
than DEPTH, no samples) gives its size and digest and null features from ``probe_media``, never an error and
never bytes from outside ``mdat``; of several tracks the first is read; fragmented files (``moof``) are not
read and count as broken; other columns are not carried along."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import raw_texts, ship, slices, table, tidied

#: 64 samples of one byte make a media sample; every 16th is marked as a sync sample; 32 make a chunk.
BLOCK, SYNC_EVERY, PER_CHUNK, RATE = 64, 16, 32, 8000
#: Boxes that hold boxes, and how deep.
DEPTH = 16
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex"}
#: The identity matrix of movie and track headers.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def write_media(payload: bytes) -> bytes:
    """An image whose samples are the payload's blocks; the payload is a positive multiple of BLOCK bytes."""
    n = len(payload) // BLOCK
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp42")
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    url = full_box(b"url ", flags=1)
    runs = [(1, PER_CHUNK, 1)] if n % PER_CHUNK == 0 else [(1, n, 1)] if chunks == 1 else [(1, PER_CHUNK, 1), (chunks, n % PER_CHUNK, 1)]
    sync = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * BLOCK)
        wide = bool(at[-1] >= 1 << 32)
        tables = (
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">3I", 1, n, BLOCK)),
            full_box(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">2I", BLOCK, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        ticks = n * BLOCK
        mdia = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, ticks, 0x55C4, 0)),
            full_box(b"hdlr", struct.pack(">4x4s12x", b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), url)), box(b"stbl", *tables)),
        )
        tkhd = full_box(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, struct.pack(">2I", 0, 0), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">4IIH10x", 0, 0, RATE, ticks, 0x10000, 0x100), MATRIX, struct.pack(">24xI", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    return b"".join((ftyp, moov(len(ftyp) + len(moov(0)) + head), box(b"mdat", payload)))


def walk(data: memoryview) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, first byte, end) of every box's content, depth first; boxes nest DEPTH deep at most."""
    todo: list[tuple[tuple, int, int]] = [((), 0, len(data))]
    while todo:
        path, start, end = todo.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError(f"box {kind!r} has no room for its size")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        here = (*path, kind)
        if len(here) > DEPTH:
            raise ValueError("boxes nest too deep")
        yield here, start + head, start + size
        todo.append((path, start + size, end))
        if kind in NESTED:
            todo.append((here, start + head, start + size))


def entries(view: memoryview, a: int, b: int, kind: str, columns: int = 1) -> np.ndarray:
    """A counted table that fills the box at a..b; a count that the box has no room for is an error."""
    n, width = struct.unpack_from(">I", view[a:b], 4)[0], np.dtype(kind).itemsize * columns
    if a + 8 + n * width > b:
        raise ValueError("a table leaves its box")
    out = np.frombuffer(view[a + 8 : a + 8 + n * width], kind).reshape(-1, columns)
    if kind == ">u8" and (out >= 1 << 63).any():
        raise ValueError("an offset beyond any file")
    return out.astype(np.int64)


def probe(data: bytes) -> dict:
    """Codec, timescale, duration, sample offsets and sizes, sync samples of the first track: from headers and
    tables alone. Tables that contradict each other or the file raise an error; nothing is allocated before
    its count is held against the bytes that there are."""
    view, out, t, tracks, stored = memoryview(data), {}, {}, 0, []
    for path, a, b in walk(view):
        kind, box_ = path[-1], view[a:b]
        tracks += path == (b"moov", b"trak")
        if path == (b"mdat",):
            stored.append((a, b))
        elif kind == b"moof":
            raise ValueError("fragments are not read")
        elif tracks != 1:
            continue
        elif kind == b"mdhd":
            v1 = bytes(box_[:1]) == b"\1"
            out["timescale"], out["duration"] = struct.unpack_from(">IQ" if v1 else ">II", box_, 20 if v1 else 12)
        elif kind == b"stsd":
            out["codec"] = struct.unpack_from("4s", box_, 12)[0].decode("latin-1")
        elif kind in (b"stco", b"co64"):
            t["chunks"] = entries(view, a, b, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stsc":
            t["runs"] = entries(view, a, b, ">u4", 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", box_, 4)
            if n * (same or 4) > len(data):
                raise ValueError("more samples than bytes")
            t["sizes"] = np.full(n, same, np.int64) if same else entries(view, a + 4, b, ">u4")[:, 0]
        elif kind == b"stts":
            t["times"] = entries(view, a, b, ">u4", 2)
        elif kind == b"stss":
            t["sync"] = entries(view, a, b, ">u4")[:, 0] - 1
    sizes, chunks, runs, times = t["sizes"], t["chunks"], t["runs"], t["times"]
    n = len(sizes)
    upto = np.append(runs[1:, 0] - 1, len(chunks))
    in_run = upto - (runs[:, 0] - 1)
    if n == 0 or len(runs) == 0 or runs[0, 0] != 1 or (in_run <= 0).any() or int((in_run * runs[:, 1]).sum()) != n or int(times[:, 0].sum()) != n or out["duration"] >= 1 << 63:
        raise ValueError("tables of different samples")
    per = np.repeat(runs[:, 1], in_run)
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    at = chunks[chunk] + before - np.repeat(before[np.minimum(np.cumsum(per) - per, n - 1)], per)
    sync = t.get("sync", np.arange(n))
    first, end = np.array(stored or [(0, 0)], np.int64).T
    inside = np.searchsorted(first, at, "right") - 1
    if int(sizes.sum()) > len(data) or (at < first[0]).any() or (at + sizes > end[inside]).any():
        raise ValueError("samples outside the stored bytes")
    if len(sync) and (sync[0] < 0 or sync[-1] >= n or (np.diff(sync) <= 0).any()):
        raise ValueError("sync samples that are none")
    return out | {"offsets": at, "sizes": sizes, "sync": sync, "decode_ticks": int((times[:, 0] * times[:, 1]).sum()), "codec": out["codec"], "timescale": out["timescale"]}


def stored_bytes(data: bytes, found: dict) -> bytes:
    """The payload, put together from the sample tables; neighbouring samples are read as one range."""
    at, sizes = found["offsets"], found["sizes"]
    cut = np.flatnonzero(at[1:] != at[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    view = memoryview(data)
    return b"".join(view[a:b] for a, b in zip(at[first].tolist(), (at[last] + sizes[last]).tolist(), strict=True))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, media)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts = raw_texts(part.column(1))
                media = pa.array([write_media(payload_of(x)) for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, media binary")


PROBED = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,length:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _row(media: bytes | None) -> dict:
    if media is None:
        return {}
    try:
        found = probe(media)
        payload = stored_bytes(media, found)
    except (ValueError, KeyError, struct.error):
        return {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    at, sizes, sync = found["offsets"], found["sizes"], found["sync"]
    ranges = np.stack([at[sync], sizes[sync]], 1)
    ms = found["duration"] * 1000 // max(1, found["timescale"])
    feature = f"{found['codec'].strip()};ms={ms};samples={len(sizes)};keys={len(sync)};first={at[0]}+{sizes[0]};last_key={'+'.join(map(str, ranges[-1].tolist())) if len(ranges) else '-'};ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    return {
        "codec": found["codec"], "timescale": found["timescale"], "duration": found["duration"], "n_samples": len(sizes),
        "keyframes": [{"start": a, "length": b} for a, b in ranges.tolist()],
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
    }


def probe_media(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> doc_id, n_bytes and what the image's boxes tell."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    names = [f.name for f in StructType.fromDDL(PROBED)]
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(PROBED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                rows = [_row(x) for x in part.column(2).to_pylist()]
                made = [pa.array([r.get(k) for r in rows], kind) for k, kind in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "n_bytes", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, {PROBED}")


def op8_media_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe_media(to_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_samples")
