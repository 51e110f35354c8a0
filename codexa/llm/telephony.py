"""Telephony audio: mu-law, A-law and IMA ADPCM as WAV files, expanded to resampled PCM.

The companded bytes are kept as they are in a WAV container, so storage is lossless. Reading expands mu-law and A-law by
256-entry tables made from the companding rules; ADPCM is decoded by numpy with one lane for each block, so each of a
block's few sample steps is one operation over all blocks of a slice. PCM at the file's rate is resampled to the target
rate: by linear interpolation upwards, by the mean over each target sample's span downwards.

Defined results: a null text is an empty one; a null media value decodes to null PCM; an empty payload to empty PCM; equal
bytes give equal results, repeated rows a row each; texts of any length are whole files, in a slice of their own; an empty
table gives an empty result; damaged containers raise ValueError. Other columns stay in `decode_column`, where one of the
name it writes is replaced, and are not read by `store_texts` and `describe`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices, tidy

#: Samples a second of the files and, by default, of the PCM that is stored. PCM of the same rate takes twice the bytes of
#: companded samples and four times those of ADPCM.
RATE, TARGET_RATE = 8000, 2000
#: zstd level of the table of files and PCM.
LEVEL = 9
UNIT = 576
#: Data bytes of an ADPCM block behind its four header bytes; divides 576, so payloads fill whole blocks.
BLOCK = 36
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
NAMES = {v: k for k, v in TAGS.items()}


def mulaw_table() -> np.ndarray:
    c = ~np.arange(256) & 255
    m = (((c & 15) << 3) + 132 << ((c >> 4) & 7)) - 132
    return np.where(c & 128, -m, m).astype(np.int16)


def alaw_table() -> np.ndarray:
    c = np.arange(256) ^ 0x55
    e, m = (c >> 4) & 7, (c & 15) << 4
    v = np.where(e == 0, m + 8, (m + 264) << np.maximum(e - 1, 0))
    return np.where(c & 128, v, -v).astype(np.int16)


def adpcm_steps() -> np.ndarray:
    """Step sizes of IMA ADPCM: fixed values of the format."""
    return np.array(
        """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253
        279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660
        4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794
        32767""".split(),
        np.int32,
    )


MULAW, ALAW, STEPS = mulaw_table(), alaw_table(), adpcm_steps()
#: Change of the step index by a code's three low bits: fixed values of the format.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A one-channel WAV file. ADPCM payloads are cut to blocks of BLOCK bytes behind a zero header."""
    if codec == "adpcm":
        if len(payload) % BLOCK:
            raise ValueError("an ADPCM payload is a multiple of the block")
        rows = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
        rows[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
        data, align, bits, extra = rows.tobytes(), BLOCK + 4, 4, struct.pack("<HH", 2, 1 + 2 * BLOCK)
    else:
        data, align, bits, extra = payload, 1, 8, struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // (1 + 2 * BLOCK) if codec == "adpcm" else rate, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and data of a WAV file."""
    if len(media) < 44 or media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt ":
        raise ValueError("not a WAV file")
    size = struct.unpack_from("<I", media, 16)[0]
    tag, channels, rate = struct.unpack_from("<HHI", media, 20)
    at = 20 + size
    while media[at : at + 4] != b"data":
        if at + 8 > len(media):
            raise ValueError("no data in the WAV file")
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    n = struct.unpack_from("<I", media, at + 4)[0]
    data = media[at + 8 : at + 8 + n]
    if tag not in NAMES or channels != 1 or len(data) != n:
        raise ValueError("a damaged WAV file, or one of another kind")
    return NAMES[tag], rate, data


def payload_of(codec: str, data: bytes) -> bytes:
    """The bytes that `wav` was given."""
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)[:, 4:].tobytes() if codec == "adpcm" else data


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks x (4 + n) bytes -> blocks x (1 + 2 n) samples; one lane for each block."""
    n = blocks.shape[1] - 4
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * n, len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(2 * n):
        code = codes[k >> 1] >> 4 if k & 1 else codes[k >> 1] & 15
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[k + 1] = value
    return out.T


def expand(files: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
    """PCM of parsed files; ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(files)
    lanes = []
    for i, (codec, _, data) in enumerate(files):
        if codec == "adpcm":
            lanes.append((i, np.frombuffer(data, np.uint8).reshape(-1, BLOCK + 4)))
        else:
            out[i] = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)]
    if lanes:
        pcm, at = decode_adpcm(np.concatenate([b for _, b in lanes])), 0
        for i, b in lanes:
            out[i] = pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def resample(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """PCM at the target rate. Upwards: linear interpolation, the last sample is held. Downwards: sample k is the mean of the
    wave from k to k + 1 target spans, with parts of samples counted as such; a last span that is not whole is left out."""
    if rate == target or not len(pcm):
        return pcm
    n = len(pcm) * target // rate
    if target < rate:
        edge = np.arange(n + 1) * rate
        whole, rest = edge // target, edge % target
        sums = np.append(0, np.cumsum(pcm, dtype=np.int64))
        held = sums[whole] * target + rest * np.append(pcm, 0)[whole]
        return ((held[1:] - held[:-1]) // rate).astype(np.int16)
    if target == 2 * rate:
        out = np.empty(2 * len(pcm), np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    return np.rint(np.interp(np.arange(n) * (rate / target), np.arange(len(pcm)), pcm)).astype(np.int16)


def decode_column(df: DataFrame, column: str = "media", to: str = "pcm", target: int = TARGET_RATE) -> DataFrame:
    """Adds the resampled 16-bit PCM of WAV files as little-endian bytes; write the result to store it."""
    kept = [c for c in df.columns if c != to]
    place = kept.index(column)

    def run(batches):
        for batch in batches:
            for x in slices(batch, column):
                media = x.column(place).to_pylist()
                files = [parse(m) if m is not None else None for m in media]
                pcm = iter(expand([f for f in files if f]))
                made = [resample(next(pcm), f[1], target).astype("<i2").tobytes() if f else None for f in files]
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(made, pa.binary())], [*kept, to])

    schema = df.select(*kept).schema.add(to, "binary")
    return df.select(*kept).mapInArrow(tidy(run), schema)


def codec_of(payload: bytes) -> str:
    return ("mulaw", "alaw", "adpcm")[zlib.crc32(payload) % 3]


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text's bytes, filled with 255 to a multiple of 576, as a WAV file."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for x in slices(batch):
                raw = [(t or "").encode() for t in x.column(1).to_pylist()]
                full = [r + b"\xff" * (UNIT - len(r) if not r else -len(r) % UNIT) for r in raw]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([wav(p, codec_of(p)) for p in full], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary")


def describe(media: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """Digests of the stored bytes and features of their PCM: that in the column pcm, else what they give at the target rate."""
    kind = media.schema["doc_id"].dataType.simpleString()
    media = media if "pcm" in media.columns else decode_column(media, target=target)

    def run(batches):
        for batch in batches:
            for x in slices(batch, "media"):
                rows = []
                for m, pcm in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                    codec, rate, data = parse(m)
                    p, y = payload_of(codec, data), np.frombuffer(pcm, "<i2")
                    rms = float(np.sqrt(np.mean(y.astype(np.float64) ** 2))) if len(y) else 0.0
                    crossings = int(np.count_nonzero(np.diff(np.signbit(y))))
                    feature = f"{codec}:{target}:{len(y)}:{rms:.3f}:{crossings}:{zlib.crc32(pcm):08x}"
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4]), pa.array(cols[5])], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_telephony(spark, sf_dir: str) -> DataFrame:
    """Stores the WAV files and their resampled PCM in one table of the shared folder, and describes what it reads back."""
    from .store import Scratch, table

    return describe(Scratch(spark).keep(decode_column(store_texts(table(spark, sf_dir, "documents"))), "media", LEVEL))
