"""Texts stored as WAV media columns, with spectral-peak pair fingerprints.

Each text becomes 8-bit mono samples (UTF-8, padded with 255 to whole frames of 576), stored by the wave module. The stored
bytes are read back by the wave module, cut into overlapping frames, transformed (short-time Fourier transform), and peaks of
the spectrogram are paired with following peaks: a pair is a code (two frequencies and their distance in time) at a time.

Nulls: a null text counts as empty (one frame of 255); a null id stays null. Equal texts give equal values. Very long texts are
transformed block by block. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatfold.llm import common

UNIT, FILL, RATE = 576, 255, 8000
HOP, BLOCK = 288, 2048
EDGES = (1, 12, 28, 56, 112, 200, 289)  # frequency bands; each may have one peak in a frame
FAN, REACH = 3, 15
SCHEMA = "n_bytes long, media binary, payload binary, fingerprint array<struct<t:int,code:long>>"
_HANN = np.hanning(UNIT + 1)[:UNIT]


def to_wav(data: bytes) -> bytes:
    """WAV of 8-bit samples: the data, padded with FILL to a positive multiple of UNIT."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data + bytes([FILL]) * (-len(data) % UNIT or (0 if data else UNIT)))
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per frame and band: the strongest bin and its power."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    bins, powers = [], []
    for at in range(0, len(frames), BLOCK):
        x = (frames[at : at + BLOCK].astype(np.float64) - 128.0) * _HANN
        z = np.fft.rfft(x, axis=1)
        p = z.real**2 + z.imag**2
        best = np.stack([p[:, a:b].argmax(1) + a for a, b in zip(EDGES, EDGES[1:], strict=False)], 1)
        bins.append(best)
        powers.append(np.take_along_axis(p, best, 1))
    return np.concatenate(bins), np.concatenate(powers)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs. A peak is at least as strong as its band's in the frame before, and stronger than in the next."""
    bins, power = band_peaks(np.frombuffer(payload, np.uint8))
    edge = np.full((1, power.shape[1]), -1.0)
    t, band = np.nonzero((power >= np.vstack([edge, power[:-1]])) & (power > np.vstack([power[1:], edge])))
    f = bins[t, band]
    times, codes = [], []
    for k in range(1, FAN + 1):
        a, b = slice(0, max(len(t) - k, 0)), slice(k, None)
        gap = t[b] - t[a]
        ok = gap <= REACH
        times.append(t[a][ok])
        codes.append((f[a][ok] << 20) | (f[b][ok] << 8) | gap[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int64)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded), media (WAV bytes), payload (samples read back from them), fingerprint (time-coded pair codes)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.pick(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in common.slices(batches, text_col, 4 << 20):
            data = [(x or "").encode() for x in b.column(1).to_pylist()]
            media = [to_wav(x) for x in data]
            payload = [from_wav(x) for x in media]
            prints = [fingerprint(x) for x in payload]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in prints])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in prints])) for i in (0, 1)], ["t", "code"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pairs)], [id_col, "n_bytes", "media", "payload", "fingerprint"])

    return docs.mapInArrow(run, f"{id_col} {id_type}, {SCHEMA}")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = media_columns(common.table(spark, sf_dir, "documents"))
    pairs = F.array_join(F.transform("fingerprint", lambda x: F.concat_ws(":", x["t"], x["code"])), ",")
    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.substring(F.sha2(pairs, 256), 1, 32)).alias("feature"),
        "fingerprint",
    )
