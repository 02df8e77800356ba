"""Telephony audio: texts as 8-bit companded samples, expanded, decoded and resampled with numpy.

A document's bytes are the samples of an 8 kHz mu-law (or A-law) WAV file. Reading one back expands the
companded samples by a 256-entry table, decodes the same bytes as ADPCM blocks (every block of a batch at once, sample by
sample), and resamples the linear signal to 16 kHz PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_small_batches, slices, table, text_bytes, text_column

RATE, BLOCK = 8000, 64
FORMATS = {"mulaw": 7, "alaw": 6}

# Fixed values of the IMA ADPCM format.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def expansion(codec: str) -> np.ndarray:
    """The linear 16-bit value of each companded byte (ITU-T G.711)."""
    byte = np.arange(256)
    if codec == "mulaw":
        inv = ~byte & 0xFF
        size = ((((inv & 0x0F) << 3) + 0x84) << ((inv >> 4) & 7)) - 0x84
        return np.where(inv & 0x80, -size, size).astype(np.int16)
    x = byte ^ 0x55
    segment, low = (x >> 4) & 7, (x & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(x & 0x80, size, -size).astype(np.int16)


TABLES = {codec: expansion(codec) for codec in FORMATS}


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV file whose data chunk is the payload, one companded sample a byte."""
    fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) % 2) for k, v in ((b"fmt ", fmt), (b"fact", struct.pack("<I", len(payload))), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_payload(media: bytes) -> tuple[str, bytes]:
    """The codec and the samples of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    tag = struct.unpack_from("<H", found[b"fmt "])[0]
    return next(k for k, v in FORMATS.items() if v == tag), found[b"data"]


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode IMA ADPCM blocks (one a row: predictor, step index, reserved byte, then two samples a byte) all at once."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * codes.shape[0], len(blocks)), np.int16)
    for k in range(out.shape[0]):
        code = (codes[k // 2] >> (4 * (k % 2))) & 15
        step = STEPS[index]
        size = (step * (2 * (code & 7).astype(np.int32) + 1)) >> 3
        head = np.clip(np.where(code & 8, head - size, head + size), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[k] = head
    return out.T


def doubled(pcm: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Twice the sampling rate by linear interpolation; the last sample of each signal is held."""
    after = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
    after[off[1:] - 1] = pcm[off[1:] - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def payloads(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's bytes with zeros up to a positive multiple of BLOCK."""
    sizes = np.diff(off)
    padded = np.maximum(BLOCK, -(-sizes // BLOCK) * BLOCK)
    ends = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(ends[-1], np.uint8)
    out[np.arange(len(raw)) + np.repeat(ends[:-1] - off[:-1], sizes)] = raw
    return out, ends


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def telephony(docs: DataFrame, codec: str = "mulaw", keep: bool = False) -> DataFrame:
    """Store each text as telephony audio, read it back and describe the signal.

    keep adds the stored file (media) and the resampled 16-bit PCM at 16 kHz (pcm). A null text is empty, and an
    empty one is one block of zeros; a null doc_id stays null; repeated rows give repeated rows. One task holds one
    slice of texts (common.SLICE_BYTES) or one document.
    """
    schema = SCHEMA + (", media binary, pcm binary" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield convert(part, codec, keep)

    return in_small_batches(docs).select("doc_id", text_column()).mapInArrow(run, schema)


def convert(part: pa.RecordBatch, codec: str, keep: bool) -> pa.RecordBatch:
    raw, off = text_bytes(part.column("text"))
    joined, ends = payloads(raw, off)
    media = [wav(joined[a:b].tobytes(), codec) for a, b in zip(ends[:-1], ends[1:])]
    back = [wav_payload(m) for m in media]
    data = np.frombuffer(b"".join(p for _, p in back), np.uint8)
    linear = TABLES[codec][data]
    pcm = doubled(linear, ends)
    decoded = adpcm(data.reshape(-1, BLOCK))
    power = np.add.reduceat(linear.astype(np.int64) ** 2, ends[:-1])
    changes = np.add.reduceat(np.append((linear[1:] ^ linear[:-1]) < 0, False).astype(np.int64), ends[:-1])
    coded = np.add.reduceat((decoded.astype(np.int64) ** 2).sum(axis=1), ends[:-1] // BLOCK)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    features, pcms = [], []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        pcms.append(pcm[2 * a : 2 * b].tobytes())
        crossings = int(changes[i]) - int(b < len(linear) and (int(linear[b - 1]) ^ int(linear[b])) < 0)
        features.append(f"{codec};rms={isqrt(int(power[i]) // (b - a))};crossings={crossings};adpcm_rms={isqrt(int(coded[i]) // ((b - a) // BLOCK * decoded.shape[1]))};pcm16k={zlib.crc32(pcms[-1]):08x}")
    columns = [
        part.column("doc_id"), pa.array(np.diff(off)), pa.array([len(p) for _, p in back], pa.int64()), pa.array([sha(p) for _, p in back]),
        pa.array([zlib.crc32(p[-BLOCK:]) for _, p in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([sha(m) for m in media]), pa.array(features),
    ]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if keep:
        columns += [pa.array(media, pa.binary()), pa.array(pcms, pa.binary())]
        names += ["media", "pcm"]
    return pa.RecordBatch.from_arrays(columns, names)


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony(table(spark, sf_dir, "documents"))
