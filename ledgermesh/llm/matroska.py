"""Matroska media columns: a writer for 8-bit mono PCM and a parser that yields packet tables.

The parser reads variable-length EBML ids and sizes, clusters, simple blocks and block
groups, the three lacings (Xiph, EBML, fixed) and cues. It knows nothing of the writer.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.text import texts_of, tidy

# Element ids of the Matroska and EBML specifications (RFC 9559, RFC 8794).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

# The elements that end a segment and a cluster of unknown size (besides those above: seek head, chapters, attachments, tags).
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
MAY_BE_OPEN = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, ATTACHMENTS, TAGS}}

#: The padded length of a payload is a multiple of this: one frame of 8 kHz samples lasts 24 ms.
FRAME = 192
FRAME_MS = 24
SAMPLE_RATE = 8000
#: Frames of one laced block, and blocks of one cluster.
LACED = 8
BLOCKS_A_CLUSTER = 32


# ---------------------------------------------------------------- writing


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(n: int, body: bytes) -> bytes:
    return _id(n) + _size(len(body)) + body


def _uint(n: int, value: int) -> bytes:
    return _element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(n: int, value: float) -> bytes:
    return _element(n, np.array(value, ">f8").tobytes())


def lace(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """Flag bits and body (count, sizes, frames) of a laced block; how: 'none', 'xiph', 'ebml' or 'fixed'."""
    sizes = [len(f) for f in frames]
    body = b"".join(frames)
    if how == "none":
        if len(frames) != 1:
            raise ValueError("a block without lacing holds one frame")
        return 0, body
    count = bytes([len(frames) - 1])
    if how == "fixed":
        if len(set(sizes)) != 1:
            raise ValueError("fixed lacing needs frames of one size")
        return 0x04, count + body
    if how == "xiph":
        return 0x02, count + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + body
    head = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, count + head + body


def write_audio(payload: bytes, lacing: str = "ebml") -> bytes:
    """The payload as unsigned 8-bit mono samples of 8 kHz, in laced blocks of 24 ms frames, with cues."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"ledgermesh") + _element(WRITING_APP, b"ledgermesh") + _float(DURATION, len(payload) / FRAME * FRAME_MS))
    audio = _element(AUDIO, _float(SAMPLING_FREQUENCY, SAMPLE_RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts, at, points = [info, _element(TRACKS, track)], 0, []
    at = sum(map(len, parts))
    step = FRAME * LACED
    for first in range(0, len(payload), step * BLOCKS_A_CLUSTER):
        time = first // FRAME * FRAME_MS
        blocks = [_uint(TIMESTAMP, time)]
        for a in range(first, min(len(payload), first + step * BLOCKS_A_CLUSTER), step):
            frames = [payload[b : b + FRAME] for b in range(a, min(len(payload), a + step), FRAME)]
            flags, body = lace(frames, "none" if len(frames) == 1 else lacing)
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + (a // FRAME * FRAME_MS - time).to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + body))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        points.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(parts[-1])
    parts.append(_element(CUES, b"".join(points)))
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
    return head + _element(SEGMENT, b"".join(parts))


# ---------------------------------------------------------------- reading


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are ones) of a variable-length integer; marker: keep the length bit, as in ids."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"a variable-length integer is cut at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    bare = raw & ((1 << 7 * width) - 1)
    return raw if marker else bare, at + width, bare == (1 << 7 * width) - 1


def _open_end(data: bytes, n: int, at: int, end: int) -> int:
    """Where a segment or cluster of unknown size ends: at the next element that it cannot hold."""
    if n not in MAY_BE_OPEN:
        raise ValueError(f"element {n:#x} at byte {at} may not be of unknown size")
    while at < end:
        child, body, _ = read_vint(data, at, marker=True)
        if child in MAY_BE_OPEN[n]:
            return at
        size, body, unknown = read_vint(data, body)
        at = _open_end(data, child, body, end) if unknown else body + size
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of each element; a segment or cluster of unknown size ends before the next element that it cannot hold."""
    while at < end:
        n, at, _ = read_vint(data, at, marker=True)
        size, at, unknown = read_vint(data, at)
        stop = _open_end(data, n, at, end) if unknown else at + size
        if stop > end:
            raise ValueError(f"element {n:#x} at byte {at} is cut")
        yield n, at, stop
        at = stop


#: Columns of a packet table, all of 64-bit integers; cluster: its number in the file; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML.
Packet = namedtuple("Packet", ["track", "timestamp_ns", "start", "end", "keyframe", "cluster", "lacing"])


@dataclass
class Media:
    timestamp_scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # (position in the segment, timestamp)
    table: dict[str, array] = field(default_factory=lambda: {c: array("q") for c in Packet._fields})
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (timestamp, track, position in the segment)

    def __len__(self) -> int:
        return len(self.table["track"])

    @property
    def packets(self) -> Iterator[Packet]:
        return map(Packet._make, zip(*self.table.values(), strict=True))

    def column(self, name: str) -> np.ndarray:
        return np.array(self.table[name], np.int64)

    def payload(self, data: bytes) -> bytes:
        """The bytes of all packets, one after another."""
        return b"".join(data[a:b] for a, b in zip(self.table["start"], self.table["end"], strict=True))

    def cued(self) -> set[int]:
        """Numbers of the clusters that a cue points at."""
        at = {p for _, _, p in self.cues}
        return {i for i, (p, _) in enumerate(self.clusters) if p in at}

    def cues_hold(self) -> bool:
        """Whether each cue points at a cluster with the cue's own timestamp or an earlier one."""
        at = dict(self.clusters)
        return all(p in at and at[p] <= t for t, _, p in self.cues)


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return float(np.frombuffer(data[a:b], ">f8" if b - a == 8 else ">f4")[0]) if b > a else 0.0


def frame_ranges(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of uneven frames")
        sizes = [(end - at) // count] * (count - 1)
    elif lacing == 1:
        for _ in range(count - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    elif count > 1:
        s, at, _ = read_vint(data, at)
        sizes.append(s)
        for _ in range(count - 2):
            before = at
            d, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + d - ((1 << 7 * (at - before) - 1) - 1))
    if min(sizes, default=0) < 0 or at + sum(sizes) > end:
        raise ValueError("the frames of a lace don't fit its block")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return [*out, (at, end)]


def read(data: bytes) -> Media:
    """The packet table of a Matroska file: timestamps, tracks and byte ranges, with clusters and cues."""
    out = Media()
    for n, a, b in elements(data, 0, len(data)):
        if n == SEGMENT:
            _read_segment(data, a, b, out)
    return out


def _read_segment(data: bytes, first: int, last: int, out: Media) -> None:
    at = first
    for n, a, b in elements(data, first, last):
        if n == INFO:
            for m, c, d in elements(data, a, b):
                if m == TIMESTAMP_SCALE:
                    out.timestamp_scale = _number(data, c, d)
                elif m == DURATION:
                    out.duration = _real(data, c, d)
        elif n == TRACKS:
            for m, c, d in elements(data, a, b):
                if m == TRACK_ENTRY:
                    _read_track(data, c, d, out)
        elif n == CLUSTER:
            _read_cluster(data, a, b, at - first, out)
        elif n == CUES:
            for m, c, d in elements(data, a, b):
                if m == CUE_POINT:
                    _read_cue(data, c, d, out)
        at = b


def _read_track(data: bytes, a: int, b: int, out: Media) -> None:
    track: dict = {"number": 0, "type": 0, "codec": "", "default_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    for n, c, d in elements(data, a, b):
        if n == TRACK_NUMBER:
            track["number"] = _number(data, c, d)
        elif n == TRACK_TYPE:
            track["type"] = _number(data, c, d)
        elif n == CODEC_ID:
            track["codec"] = data[c:d].rstrip(b"\0").decode("ascii", "replace")
        elif n == DEFAULT_DURATION:
            track["default_ns"] = _number(data, c, d)
        elif n == AUDIO:
            for m, e, f in elements(data, c, d):
                if m == SAMPLING_FREQUENCY:
                    track["rate"] = _real(data, e, f)
                elif m == CHANNELS:
                    track["channels"] = _number(data, e, f)
                elif m == BIT_DEPTH:
                    track["bits"] = _number(data, e, f)
    out.tracks[track["number"]] = track


def _read_cluster(data: bytes, a: int, b: int, position: int, out: Media) -> None:
    time = 0
    for n, c, d in elements(data, a, b):
        if n == TIMESTAMP:
            time = _number(data, c, d)
            out.clusters.append((position, time))
        elif n == SIMPLE_BLOCK:
            _read_block(data, c, d, time, bool(data[_after_track(data, c) + 2] & 0x80), out)
        elif n == BLOCK_GROUP:
            inner = {m: (e, f) for m, e, f in elements(data, c, d)}
            if BLOCK in inner:
                _read_block(data, *inner[BLOCK], time, 0xFB not in inner, out)  # 0xFB: ReferenceBlock


def _after_track(data: bytes, at: int) -> int:
    return read_vint(data, at)[1]


def _read_block(data: bytes, a: int, b: int, cluster_time: int, keyframe: bool, out: Media) -> None:
    track, at, _ = read_vint(data, a)
    time = (cluster_time + int.from_bytes(data[at : at + 2], "big", signed=True)) * out.timestamp_scale
    lacing = data[at + 2] >> 1 & 3
    step = out.tracks.get(track, {}).get("default_ns", 0)
    frames = frame_ranges(data, at + 3, b, lacing)
    n, own = len(frames), out.table
    for name, value in (("track", track), ("keyframe", int(keyframe)), ("cluster", len(out.clusters) - 1), ("lacing", lacing)):
        own[name].extend([value] * n)
    own["timestamp_ns"].extend(range(time, time + n * step, step) if step else [time] * n)
    own["start"].extend(s for s, _ in frames)
    own["end"].extend(e for _, e in frames)


def _read_cue(data: bytes, a: int, b: int, out: Media) -> None:
    time, places = 0, []
    for n, c, d in elements(data, a, b):
        if n == CUE_TIME:
            time = _number(data, c, d)
        elif n == CUE_TRACK_POSITIONS:
            inner = {m: _number(data, e, f) for m, e, f in elements(data, c, d)}
            places.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER_POSITION, 0)))
    out.cues.extend((time, track, position) for track, position in places)


# ---------------------------------------------------------------- columns


def padded(text: bytes) -> bytes:
    """The bytes with spaces appended up to a positive multiple of FRAME."""
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def features(media: Media, samples: np.ndarray) -> str:
    """Figures of the packet table and of the samples, as key=value by commas."""
    n = len(media)
    centred = samples.astype(np.float64) - 128.0
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    return (
        f"tracks={len(media.tracks)},clusters={len(media.clusters)},packets={n},cues={len(media.cues)},cues_hold={int(media.cues_hold())},"
        f"laced={np.count_nonzero(media.column('lacing'))},last_ns={media.table['timestamp_ns'][-1] if n else 0},"
        f"mean={centred.mean():.4f},rms={np.sqrt((centred**2).mean()):.4f},peak={np.abs(centred).max():.0f},crossings={crossings}"
    )


def media_documents(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Each text stored as a Matroska file, read back by the parser, with figures of both.

    A null text counts as an empty one, whose payload is one frame of spaces; rows are handled one by one,
    so equal texts give equal values and repeated rows repeat. Other columns are left out.
    with_media: the files themselves too, in column media.
    """
    rows = texts_of(docs, "doc_id")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "duration_ms"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, duration_ms long" + ", media binary" * with_media

    def row(text: str) -> tuple:
        raw = text.encode()
        stored = write_audio(padded(raw))
        media = read(stored)
        back = media.payload(stored)
        samples = np.frombuffer(back, dtype=np.uint8)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, samples), len(media), int(media.duration), *([stored] if with_media else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns = zip(*(row(x.as_py()) for x in part.column("text")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=False))], names=names + ["media"] * with_media)

    return rows.mapInArrow(tidy(run), schema)


PACKET_SCHEMA = "packet long, track long, timestamp_ns long, start long, end long, keyframe boolean, cluster long, cluster_position long, cluster_timestamp_ns long, cued boolean, lacing int, error string"
#: Packets of one Arrow batch.
PACKETS_AT_ONCE = 100_000


def packet_batches(data: bytes) -> Iterator[list[pa.Array]]:
    """The packet table of a file in the columns of PACKET_SCHEMA; what cannot be read is one row with the error."""
    try:
        media = read(data)
    except ValueError as error:
        yield [pa.nulls(1, k) for k in (pa.int64(),) * 5 + (pa.bool_(),) + (pa.int64(),) * 3 + (pa.bool_(), pa.int32())] + [pa.array([str(error)])]
        return
    clusters = np.array([*media.clusters, (0, 0)], np.int64).reshape(-1, 2)
    cued = np.isin(np.arange(len(clusters)), list(media.cued()))
    table = {c: media.column(c) for c in Packet._fields}
    for a in range(0, len(media), PACKETS_AT_ONCE):
        own = {c: x[a : a + PACKETS_AT_ONCE] for c, x in table.items()}
        k = own["cluster"]
        yield [
            pa.array(np.arange(a, a + len(k))),
            *(pa.array(own[c]) for c in ("track", "timestamp_ns", "start", "end")),
            pa.array(own["keyframe"] > 0),
            pa.array(k),
            pa.array(clusters[k, 0]),
            pa.array(clusters[k, 1] * media.timestamp_scale),
            pa.array(cued[k]),
            pa.array(own["lacing"].astype(np.int32)),
            pa.nulls(len(k), pa.string()),
        ]


def packet_table(files: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """A row for each packet of each Matroska file: key, its number, track, timestamp, byte range, keyframe, cluster with position and time, whether a cue points there, and lacing.

    files: key and the files' bytes. A null file has no rows; one that cannot be parsed has one row with its error and nulls, and a file
    without packets none. Repeated rows repeat. Other columns are left out.
    """
    rows = files.select(key, column).filter(F.col(column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                for columns in packet_batches(data.as_py()):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(columns[0]), i))), *columns], names=[key, *(x.split()[0] for x in PACKET_SCHEMA.split(", "))])

    return rows.mapInArrow(tidy(run), f"`{key}` {rows.schema[0].dataType.simpleString()}, {PACKET_SCHEMA}")


def media_packets(docs: DataFrame) -> DataFrame:
    """The packet tables of the files that media_documents stores for the texts."""
    return packet_table(media_documents(docs, with_media=True))
