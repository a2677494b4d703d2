"""Media columns: texts kept as AVI files of motion-JPEG frames, read back as clips.

A payload is cut into frames of 576 bytes. Each byte is the DC term of one 8 x 8
block of a grey baseline JPEG of 192 x 192 pixels (DC quantiser 8, no AC terms), so
the block is one flat colour, the byte, and the file is lossless and plain baseline
JPEG. The AVI has an ``idx1`` index. Reading parses the RIFF tree and the index,
decodes every frame (all are intra frames) and compares the grey histograms of
neighbours; a difference above an adaptive limit, taken from the differences around
it, starts a new clip.

Frames whose blocks have only DC terms are decoded side by side in numpy; any other
grey baseline frame goes through the block decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME, SIDE, FPS = 576, 24, 25
#: Bytes of chunks, padding and index that 32-bit sizes can name; texts up to 1 GB stay below.
MOST_BYTES = (1 << 32) - 4096
#: Frames coded or decoded at once.
TOGETHER = 4096
BINS, NEAR, FACTOR, FLOOR = 16, 4, 2.0, 0.2
#: The scan order of the coefficients of a block, as the JPEG standard has it.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(quantiser: list[int], dc: tuple[bytes, bytes], ac: tuple[bytes, bytes], height: int = 8 * SIDE, width: int = 8 * SIDE) -> bytes:
    """Everything before the coded data of a grey baseline frame; dc, ac: code counts by length, symbols."""
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\0" + bytes(quantiser))
        + segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
        + segment(0xC4, b"\0" + dc[0] + dc[1])
        + segment(0xC4, b"\x10" + ac[0] + ac[1])
        + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


#: Nine categories of four bits each; the only AC symbol, end of block, is one bit.
HEAD = jpeg_head([8] + [1] * 63, (bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))), (bytes([1] + [0] * 15), b"\0"))
_DIFF = np.arange(-255, 256)
_CATEGORY = np.ceil(np.log2(np.abs(_DIFF) + 1)).astype(np.int64)
_CODE = ((_CATEGORY << _CATEGORY) + np.where(_DIFF < 0, _DIFF + (1 << _CATEGORY) - 1, _DIFF)) << 1
_BITS = _CATEGORY + 5


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """A JPEG for each row of 576 samples."""
    out = []
    for k in range(0, len(frames), TOGETHER):
        part = frames[k : k + TOGETHER].astype(np.int64) - 128
        diff = np.diff(part, axis=1, prepend=0) + 255
        bits, code = _BITS[diff], _CODE[diff]
        ends = np.cumsum(bits, axis=1)
        total = ends[:, -1]
        sizes = (total + 7) >> 3
        starts = np.cumsum(sizes) - sizes
        at = (ends - bits + (starts << 3)[:, None]).ravel()
        code = (code << (24 - (at & 7).reshape(code.shape) - bits)).ravel()
        data, byte = np.zeros(int(sizes.sum()) + 3, np.uint8), at >> 3
        for shift in (16, 8, 0):
            np.add.at(data, byte + (2 - shift // 8), (code >> shift & 255).astype(np.uint8))
        data[starts + sizes - 1] += ((1 << (-total & 7)) - 1).astype(np.uint8)
        raw = data.tobytes()
        out += [HEAD + raw[a : a + n].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for a, n in zip(starts.tolist(), sizes.tolist())]
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], side: int = 8 * SIDE, fps: int = FPS) -> bytes:
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, side, side)
    picture = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    if sum(len(f) + 25 for f in frames) > MOST_BYTES:
        raise ValueError("an AVI file holds 4 GB at most")
    body, index, at = [b"movi"], [], 4
    for frame in frames:
        body.append(chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(body[-1])
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames that the index names, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, entries, fps = None, b"", float(FPS)
    spans = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while spans:
        at, end = spans.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = at + 8
                else:
                    spans.append((at + 12, at + 8 + size))
            elif name == b"avih":
                fps = 1e6 / max(1, struct.unpack_from("<I", data, at + 8)[0])
            elif name == b"idx1":
                entries = data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", entries):
        if name[2:] in (b"dc", b"db"):
            place = movi + offset if data[movi + offset : movi + offset + 4] == name else offset  # some writers count from the file's start
            frames.append(data[place + 8 : place + 8 + size])
    return frames, fps


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((length, code, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(64)
def tables(head: bytes) -> dict:
    """What the segments before the coded data say, and tables indexed by 16 bits of it."""
    at, quant, huffman, size = 2, {}, {}, None
    while at < len(head):
        marker, length = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body, at = head[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisers are not baseline")
                quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(float), body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]], body = codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack(">BHHB", body[:6])
            if parts != 1:
                raise ValueError("only grey frames")
            size, table = (height, width), body[8]
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart markers are not supported")
        elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB):
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            dc, ac = huffman[body[2] >> 4], huffman[0x10 | body[2] & 15]
    look = []
    for table_codes in (dc, ac):
        length, symbol = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        for n, code, s in table_codes:
            a = code << (16 - n)
            length[a : a + (1 << (16 - n))], symbol[a : a + (1 << (16 - n))] = n, s
        look.append((length, symbol))
    # a block of a DC term and end of block only, in 16 bits: its length (0: not one) and difference
    word = np.arange(65536, dtype=np.int64)
    used, category = look[0][0].astype(np.int64), look[0][1].astype(np.int64)
    after = used + category
    value = (word >> np.maximum(16 - after, 0)) & ((1 << np.minimum(category, 16)) - 1)
    diff = np.where((category > 0) & (value < (1 << np.maximum(category - 1, 0))), value - (1 << np.minimum(category, 16)) + 1, value)
    rest = (word << np.minimum(after, 16)) & 65535
    ending = look[1][0][rest].astype(np.int64)
    plain = (used > 0) & (after < 16) & (ending > 0) & (look[1][1][rest] == 0) & (after + ending <= 16)
    return {"size": size, "quant": quant[table], "dc": look[0], "ac": look[1], "step": np.where(plain, after + ending, 0), "diff": diff}


def split_frame(frame: bytes) -> tuple[bytes, bytes]:
    """Head and coded data (without stuffing) of a JPEG."""
    if frame.startswith(HEAD):
        cut = len(HEAD)
    else:
        cut = 2
        while True:
            if cut + 4 > len(frame) or frame[cut] != 0xFF:
                raise ValueError("broken JPEG")
            marker, cut = frame[cut + 1], cut + 2 + struct.unpack_from(">H", frame, cut + 2)[0]
            if marker == 0xDA:
                break
    end = frame.rindex(b"\xff\xd9")
    return frame[:cut], frame[cut:end].replace(b"\xff\0", b"\xff")


def decode_block_frame(head: bytes, data: bytes) -> np.ndarray:
    """Grey pixels of any baseline frame, block by block."""
    t = tables(head)
    height, width = t["size"]
    down, across = -(-height // 8), -(-width // 8)
    stream, size, at = int.from_bytes(data + b"\0" * 8, "big"), 8 * (len(data) + 8), 0

    def bits(n: int) -> int:
        return (stream >> (size - at - n)) & ((1 << n) - 1)

    def signed(n: int) -> int:
        v = bits(n)
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1

    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    image, last = np.zeros((8 * down, 8 * across)), 0
    for k in range(down * across):
        block = np.zeros(64)
        length, symbol = (int(v[bits(16)]) for v in t["dc"])
        at += length
        last += signed(symbol)
        at += symbol
        block[0], i = last * t["quant"][0], 1
        while i < 64:
            length, symbol = (int(v[bits(16)]) for v in t["ac"])
            if not length:
                raise ValueError("broken JPEG data")
            at += length
            if symbol == 0:
                break
            i += symbol >> 4
            if symbol & 15:
                block[ZIGZAG[i]] = signed(symbol & 15) * t["quant"][i]
                at += symbol & 15
            i += 1
        r, c = divmod(k, across)
        image[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = basis @ block.reshape(8, 8) @ basis.T
    return np.clip(np.rint(image + 128), 0, 255).astype(np.uint8)[:height, :width]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The first pixel of each block, one row a frame (frames of one size)."""
    split = [split_frame(f) for f in frames]
    t = tables(split[0][0])
    n = -(-t["size"][0] // 8) * -(-t["size"][1] // 8)
    out, odd = np.zeros((len(split), n), np.int64), np.zeros(len(split), bool)
    for head in dict.fromkeys(h for h, _ in split):
        t, of = tables(head), np.array([k for k, (h, _) in enumerate(split) if h == head])
        if -(-t["size"][0] // 8) * -(-t["size"][1] // 8) != n:
            raise ValueError("frames differ in size")
        for a in range(0, len(of), TOGETHER):
            part = of[a : a + TOGETHER]
            coded = [split[k][1] for k in part]
            sizes = np.array([len(x) for x in coded]) + 4
            data = np.frombuffer(b"\0\0\0\0".join([*coded, b""]), np.uint8).astype(np.int64)
            window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            at, stop = (np.cumsum(sizes) - sizes) << 3, (np.cumsum(sizes) - 4) << 3
            last, bad = np.zeros(len(part), np.int64), np.zeros(len(part), bool)
            scale = t["quant"][0] / 8
            for k in range(n):
                word = (window[np.minimum(at, stop) >> 3] >> (8 - (at & 7))) & 65535
                step = t["step"][word]
                bad |= step == 0
                last += t["diff"][word]
                at += step
                out[part, k] = last
            out[part] = np.clip(np.rint(out[part] * scale + 128), 0, 255)
            odd[part] = bad | (at > stop)
    for k in np.flatnonzero(odd):
        out[k] = decode_block_frame(*split[k])[::8, ::8].ravel()
    return out.astype(np.uint8)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """First and last-plus-one frame of each clip."""
    n = len(frames)
    cells = (frames >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    histograms = np.bincount(cells.ravel(), minlength=BINS * n).reshape(n, BINS)
    difference = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    m = len(difference)
    if not m:
        return [(0, n)]
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (difference, difference**2)]
    low, high = np.maximum(np.arange(m) - NEAR, 0), np.minimum(np.arange(m) + NEAR + 1, m)
    others = np.maximum(high - low - 1, 1)
    mean = (sums[0][high] - sums[0][low] - difference) / others
    spread = np.sqrt(np.maximum((sums[1][high] - sums[1][low] - difference**2) / others - mean**2, 0))
    cuts = np.flatnonzero(difference > np.maximum(mean + FACTOR * spread, FLOOR)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges, edges[1:]))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (FRAME - len(text) if len(text) < FRAME else -len(text) % FRAME)


def media_of(values: list[bytes]) -> Iterator[tuple[bytes, bytes, np.ndarray, float]]:
    """Stored file, payload read back, its frames and their rate, for each text."""
    payloads = [padded(v) for v in values]
    coded = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
    files, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        files.append(write_avi(coded[at : at + n]))
        at += n
    read = [read_avi(f) for f in files]
    decoded, at = decode_frames([f for frames, _ in read for f in frames]), 0
    for file, (frames, fps) in zip(files, read):
        own = decoded[at : at + len(frames)]
        at += len(frames)
        yield file, own.tobytes(), own, fps


KIND = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,fps:double,clips:array<struct<first:int,end:int>>,media:binary>"


def store_text(keep: bool):
    """Column function: text -> struct KIND; ``media`` is null unless ``keep``."""

    @F.arrow_udf(KIND)
    def stored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        clip = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "fps": pa.float64(), "clips": clip, "media": pa.binary()}
        for batch in batches:
            rows = []
            for part in common.pieces(batch, 1 << 20):
                values = common.texts(part)
                for value, (file, payload, frames, fps) in zip(values, media_of(values)):
                    sums = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest()
                    rows.append((len(value), len(payload), *sums, fps, [{"first": a, "end": b} for a, b in shots(frames)], file if keep else None))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return stored


def with_media(docs: DataFrame, name: str = "media", keep: bool = True) -> DataFrame:
    """``docs`` with a struct of the stored file of each whole text and what reading it gives.

    Null counts as empty; an empty text is one frame of padding. Equal texts, repeated or
    tied, have equal files. Very long texts are stored whole; beyond 1 GB, where a file
    would pass the 4 GB that its sizes can name, that is an error. An empty table gives an
    empty one. Where ``docs`` has a column ``name``, the new one gets underscores.
    """
    return docs.withColumn(common.free_name(docs, name), store_text(keep)(F.coalesce("text", F.lit(""))))


def clip_rows(docs: DataFrame) -> DataFrame:
    """A row a clip: doc_id, clip, first_frame, end_frame, start_s, end_s."""
    clips = with_media(docs.select("doc_id", "text"), keep=False).select("doc_id", "media.fps", F.posexplode("media.clips").alias("clip", "c"))
    return clips.select("doc_id", "clip", F.col("c.first").alias("first_frame"), F.col("c.end").alias("end_frame"), (F.col("c.first") / F.col("fps")).alias("start_s"), (F.col("c.end") / F.col("fps")).alias("end_s"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, digests and clips of each text's file, read back; see ``with_media`` for awkward rows."""
    found = with_media(common.table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    timed = F.transform("media.clips", lambda c: F.format_string("%.2f-%.2f", c["first"] / F.col("media.fps"), c["end"] / F.col("media.fps")))
    return found.select("doc_id", *[f"media.{c}" for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")], F.array_join(timed, ";").alias("feature"))
