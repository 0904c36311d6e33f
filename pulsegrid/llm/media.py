"""Media columns: lossless 8-bit audio, log-mel features and segments with time spans.

A payload of bytes is stored as the samples of a mono 8-bit WAV file, without loss, and read back from the
stored bytes. Features come from what was read: a polyphase filter resamples to half the rate, overlapped
frames give log-mel filterbank energies, and a hysteresis on the frame energies (it opens above a high
threshold and closes below a low one) gives the segments. Features are cut into clips of a fixed number of
frames; each clip's tensor has the fixed shape (CLIP, BANDS) and lies, row by row, in an Arrow list beside the
clip's time span, as tables of Spark know no tensors. ``tensors`` views such a column as Arrow's tensor type.

A payload is handled in fixed steps of samples, so a long one needs no more memory than a short one, and
equal payloads give equal values whatever else a batch holds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import STEP_ROWS, arrow_schema, ship, utf8

ALIGN = 64
RATE = 8000
HALF_RATE = RATE // 2
#: Taps of the resampling filter on each side, frame and hop in samples at half rate, mel bands.
TAPS = 12
FRAME = 256
HOP = 128
BANDS = 20
#: Frames of a clip: the tensor's fixed shape is (CLIP, BANDS).
CLIP = 64
#: Frames whose spectra are computed at once, and bytes of texts after which a worker hands its rows on.
STEP = 2048
GROUP_BYTES = 1 << 22
#: Standard deviations above the mean at which a segment opens, and below it at which it closes.
OPEN, CLOSE = 0.5, -0.25


def payload(text: str | None) -> bytes:
    """A text's UTF-8 bytes with zero bytes up to a positive multiple of 64."""
    data = utf8(text)
    return data + bytes(max(ALIGN, -(-len(data) // ALIGN) * ALIGN) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file: a header of 44 bytes, the samples, and a pad byte where they are odd."""
    pad = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + bytes(pad)


def from_wav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a stored file, by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            if rate is None or at + 8 + size > len(data):
                raise ValueError("a WAV file that is cut short")
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples in the WAV file")


@lru_cache(maxsize=1)
def _half_band() -> np.ndarray:
    """A windowed-sinc low-pass filter at half the band, of unit gain."""
    n = np.arange(-TAPS, TAPS + 1)
    taps = 0.5 * np.sinc(n / 2) * np.hamming(len(n))
    return (taps / taps.sum()).astype(np.float32)


def resample_half(x: np.ndarray) -> np.ndarray:
    """Every second sample of the filtered signal, by the filter's two phases on the two half signals.

    Only the samples that are kept are computed. x holds TAPS samples before and after the wanted range.
    """
    taps = _half_band()
    n = (len(x) - 2 * TAPS + 1) // 2
    even, odd = x[0::2], x[1::2]
    out = np.zeros(n, np.float32)
    for k, tap in enumerate(taps):
        if tap:
            part = (even if k % 2 == 0 else odd)[k // 2 : k // 2 + n]
            out[: len(part)] += tap * part
    return out


@lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(HALF_RATE / 2), BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / HALF_RATE)
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel energies of 8-bit samples as 1/16 steps, and the frames' energies.

    The last frame is filled up with silence. Values are rounded to steps, so they compare exactly.
    """
    raw = np.frombuffer(samples, np.uint8)
    half = -(-len(raw) // 2)
    frames = max(1, -(-(half - FRAME) // HOP) + 1)
    bands = np.empty((frames, BANDS), np.int16)
    energy = np.empty(frames, np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    mel = _mel()
    for first in range(0, frames, STEP):
        n = min(STEP, frames - first)
        start, stop = first * HOP * 2 - TAPS, ((first + n - 1) * HOP + FRAME) * 2 + TAPS
        x = np.zeros(stop - start, np.float32)
        lo, hi = max(0, start), min(len(raw), stop)
        x[lo - start : hi - start] = (raw[lo:hi].astype(np.float32) - 128) / 128
        y = resample_half(x)[: (n - 1) * HOP + FRAME]
        view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
        energy[first : first + n] = np.einsum("ij,ij->i", view, view)
        spectrum = np.fft.rfft(view * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ mel
        bands[first : first + n] = np.rint(16 * np.log(power + 1e-6))
    return bands, np.round(np.log(energy + 1e-6) * 64) / 64


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) in frames of the loud segments, by hysteresis."""
    mean, spread = float(np.mean(energy, dtype=np.float64)), float(np.std(energy, dtype=np.float64))
    high, low = mean + OPEN * spread, mean + CLOSE * spread
    mark = np.where(energy >= high, 1, np.where(energy < low, -1, 0))
    if spread == 0:
        return [(0, len(energy))]
    decided = np.flatnonzero(mark)
    last = np.zeros(len(mark), np.int64)
    last[decided] = decided
    state = mark[np.maximum.accumulate(last)] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state.view(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def clips(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, tensor) of each clip: seconds, and (clips, CLIP, BANDS) with silence after the last frame."""
    count = -(-len(bands) // CLIP)
    full = np.zeros((count * CLIP, BANDS), np.int16)
    full[: len(bands)] = bands
    number = np.arange(count)
    ends = np.minimum((number + 1) * CLIP, len(bands))
    return number * CLIP * HOP / HALF_RATE, ((ends - 1) * HOP + FRAME) / HALF_RATE, full.reshape(count, CLIP, BANDS)


def tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """A column of clips' log_mel lists as one array of tensors of the shape (CLIP, BANDS)."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.FixedShapeTensorArray.from_numpy_ndarray(whole.flatten().to_numpy(zero_copy_only=False).astype(np.int16, copy=False).reshape(-1, CLIP, BANDS))


def _nested(rows: list[list[np.ndarray]], names: list[str]) -> pa.ListArray:
    """A list column of structs: rows holds, for each row, one array for each name; tensors become lists of numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
    fields = []
    for k in range(len(names)):
        flat = np.concatenate([r[k] for r in rows])
        one = pa.array(flat.reshape(-1))
        fields.append(one if flat.ndim == 1 else pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * (CLIP * BANDS), one))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=names))


def describe(text: str | None) -> tuple[tuple, bytes, tuple, tuple]:
    """The digests of one text, its media file, clips and segments."""
    size = len(utf8(text))
    media = to_wav(payload(text))
    rate, samples = from_wav(media)
    bands, energy = log_mel(samples)
    spans = np.array(segments(energy), np.float64).reshape(-1, 2)
    found = clips(bands)
    means = "/".join(str(round(float(m))) for m in bands.mean(axis=0, dtype=np.float64))
    feature = f"{len(bands)}f;{len(spans)}s;{means};{hashlib.sha256(found[2]).hexdigest()[:16]}"
    seconds = (spans[:, 0] * HOP / HALF_RATE, ((spans[:, 1] - 1) * HOP + FRAME) / HALF_RATE)
    head = (size, rate, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature)
    return head, media, found, seconds


_DIGESTS = "doc_id long, n_bytes long, rate int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SPAN = "start_s: double, end_s: double"
_MEDIA = f", media binary, clips array<struct<{_SPAN}, log_mel: array<smallint>>>, segments array<struct<{_SPAN}>>"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: digests, its media file, clips and segments.

    media is the WAV file; clips are the time spans with their tensors, of CLIP * BANDS numbers each (see
    ``tensors``); segments are the loud time spans. Null and empty texts are 64 zero bytes; long ones are encoded
    whole, their spectra in steps. Null ids and repeated rows pass through; equal texts give equal values. Other
    columns, whatever their names, are not read. An empty table gives an empty result; nothing is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = _DIGESTS + _MEDIA
    arrow = arrow_schema(spark, schema)

    def batch(ids: list, found: list) -> pa.RecordBatch:
        heads = zip(*((i, *f[0]) for i, f in zip(ids, found, strict=True)), strict=True)
        columns = [pa.array(values, type=field.type) for values, field in zip(heads, arrow, strict=False)]
        columns.append(pa.array([f[1] for f in found], pa.binary()))
        columns.append(_nested([f[2] for f in found], ["start_s", "end_s", "log_mel"]))
        columns.append(_nested([f[3] for f in found], ["start_s", "end_s"]))
        return pa.RecordBatch.from_arrays([c.cast(field.type) for c, field in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, room = [], [], GROUP_BYTES
        for rows in batches:
            for at in range(rows.num_rows):
                ids.append(rows.column(0)[at].as_py())
                found.append(describe(rows.column(1)[at].as_py()))
                room -= found[-1][0][0]
                if room <= 0 or len(ids) == STEP_ROWS:
                    yield batch(ids, found)
                    ids, found, room = [], [], GROUP_BYTES
        if ids:
            yield batch(ids, found)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
