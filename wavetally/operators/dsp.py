"""Audio kernels over binary columns: fingerprints, alert-tone test and decoding, alert synthesis, WAV and dumps.

Arrays of frames are handled at once with numpy; each row is one segment, so memory is bounded by its length.
"""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from wavetally.operators.folds import digest

# Sample rate, spectrum, mel bands, time bins, and the alert's modulation.
RATE, FFT, MELS, TIME_BINS = 16000, 512, 32, 32
LOW_HZ, HIGH_HZ = 100.0, 4000.0
BAUD, MARK_HZ, SPACE_HZ = 520.833, 2083.333, 1562.5
PREAMBLE, PREAMBLE_BYTES = 0xAB, 16
PHASES = (0.5, 0.4, 0.6, 0.3, 0.7)
TONE_RATIO, TONE_WIDTH_HZ = 0.35, 60
HEADER = re.compile(r"ZCZC-[A-Z]{3}-[A-Z0-9]{3}(?:-\d{6})+\+\d{4}-\d{7}-[\w/ ]{1,8}-?")
DUMP_STAMP = 24
# Fixed values of the enhancement: mains and cut-off frequencies, how much noise goes and how much of a bin stays, filter qualities.
HUM_HZ, CUTOFF_HZ, SUBTRACTED, FLOOR = 60.0, 3800.0, 2.0, 0.12
NOTCH_Q, LOW_PASS_Q = 30.0, 0.707


def mel_bands(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """[band, bin] triangular weights on the mel scale."""
    to_mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    points = np.linspace(to_mel(LOW_HZ), to_mel(min(rate / 2, HIGH_HZ)), mels + 2)
    edges = np.clip(np.floor((fft + 1) * 700.0 * (10.0 ** (points / 2595.0) - 1.0) / rate), 0, fft // 2)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bins = np.arange(fft // 2 + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = np.where((bins >= low) & (bins < mid), (bins - low) / (mid - low), 0.0)
        fall = np.where((bins >= mid) & (bins < high), (high - bins) / (high - mid), 0.0)
    return rise + fall


_BANDS = mel_bands()


def fingerprint(pcm: np.ndarray) -> tuple[np.ndarray, str]:
    """Unit vector of pooled mel energies, and its short digest."""
    x = np.zeros(max(len(pcm), FFT))
    x[: len(pcm)] = pcm / 32768.0
    frames = sliding_window_view(x, FFT)[:: FFT // 2] * np.hanning(FFT)
    mel = np.log1p((np.abs(np.fft.rfft(frames, axis=1)) ** 2) @ _BANDS.T)
    edge = np.linspace(0, len(mel), TIME_BINS + 1).astype(int)
    pooled = np.stack([mel[a : max(a + 1, b)].mean(axis=0) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    vector = pooled.ravel().astype(np.float32)
    if (norm := np.linalg.norm(vector)) > 0:
        vector = vector / norm
    return vector, digest((vector > np.median(vector)).astype(np.uint8))


def is_tone_burst(pcm: np.ndarray, rate: int = RATE, ratio: float = TONE_RATIO) -> bool:
    """Whether most energy lies around the two alert tones."""
    if len(pcm) < rate // 8 or not np.any(pcm):
        return False
    power = np.abs(np.fft.rfft(pcm.astype(np.float64) * np.hanning(len(pcm)))) ** 2
    hz = np.fft.rfftfreq(len(pcm), 1.0 / rate)
    near = np.minimum(np.abs(hz - MARK_HZ), np.abs(hz - SPACE_HZ)) < TONE_WIDTH_HZ
    return bool(power[near].sum() / (power.sum() + 1e-12) > ratio)


def decode_headers(pcm: np.ndarray, rate: int = RATE) -> list[str]:
    """Every distinct alert header in the audio, over a few bit phases and all byte alignments."""
    if len(pcm) < rate // 4:
        return []
    x = pcm.astype(np.float64)
    x = x / (np.abs(x).max() or 1.0)
    per_bit = rate / BAUD
    width = max(4, round(per_bit))
    turn = 2j * np.pi * np.arange(len(x)) / rate
    box = np.ones(width) / width
    mark, space = (np.abs(np.convolve(x * np.exp(turn * hz), box, mode="same")) ** 2 for hz in (MARK_HZ, SPACE_HZ))
    soft = mark - space
    count = int(len(soft) / per_bit)
    found: dict[str, None] = {}
    for phase in PHASES:
        at = np.round((np.arange(count) + phase) * per_bit).astype(int)
        bits = (soft[at[at < len(soft)]] > 0).astype(np.uint8)
        for shift in range(8):
            whole = bits[shift : shift + (len(bits) - shift) // 8 * 8]
            data = np.packbits(whole, bitorder="little")
            text = np.where((data >= 32) & (data < 127), data, 0).astype(np.uint8).tobytes().decode("ascii")
            found |= dict.fromkeys(HEADER.findall(text))
    return list(found)


def encode_header(header: str, rate: int = RATE, amplitude: float = 0.7) -> np.ndarray:
    """The audio of a header with its preamble, phase-continuous."""
    data = np.frombuffer(bytes([PREAMBLE] * PREAMBLE_BYTES) + header.encode("ascii"), np.uint8)
    bits = np.unpackbits(data, bitorder="little")
    n = round(len(bits) * rate / BAUD)
    hz = np.where(bits[np.minimum(len(bits) - 1, (np.arange(n) * BAUD / rate).astype(int))], MARK_HZ, SPACE_HZ)
    return (amplitude * np.sin(np.cumsum(2 * np.pi * hz / rate))).astype(np.float32)


def wav_bytes(pcm: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.astype("<i2").tobytes())
    return out.getvalue()


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2"), w.getframerate()


def dump_record(stamp: str, vector: np.ndarray) -> bytes:
    """A fixed-width record: the stamp in 24 bytes, then the vector as 32-bit floats."""
    return stamp.encode("ascii")[:DUMP_STAMP].ljust(DUMP_STAMP, b"\0") + vector.astype("<f4").tobytes()


def read_dump(data: bytes, size: int = MELS * TIME_BINS) -> list[tuple[str, np.ndarray]]:
    width = DUMP_STAMP + 4 * size
    return [(data[a : a + DUMP_STAMP].rstrip(b"\0").decode("ascii"), np.frombuffer(data, "<f4", size, a + DUMP_STAMP)) for a in range(0, len(data) // width * width, width)]


def _biquad(frequency: float, rate: int, q: float, low_pass: bool) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order notch or low-pass filter, a[0] = 1."""
    w = 2 * np.pi * frequency / rate
    c, alpha = np.cos(w), np.sin(w) / (2 * q)
    b = np.array([(1 - c) / 2, 1 - c, (1 - c) / 2]) if low_pass else np.array([1.0, -2 * c, 1.0])
    return b / (1 + alpha), np.array([1.0, -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)])


def _filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The recursive filter's output: its impulse response in closed form, by its poles, convolved with the signal."""
    n = np.arange(len(x))
    pole = np.roots(a)[0]
    g = np.imag(pole ** (n + 1)) / np.imag(pole)
    response = b[0] * g
    response[1:] += b[1] * g[:-1]
    response[2:] += b[2] * g[:-2]
    size = 1 << (2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(response, size), size)[: len(x)]


def enhance(pcm: np.ndarray, rate: int = RATE, hum_hz: float = HUM_HZ, cutoff_hz: float = CUTOFF_HZ, strength: float = SUBTRACTED, floor: float = FLOOR) -> np.ndarray:
    """Speech made clearer: hum harmonics notched, highs cut, the quietest frames' spectrum subtracted; the level stays.

    A segment that is too short to tell its noise stays as it is.
    """
    step = max(rate // 10, FFT)
    count = len(pcm) // step
    if len(pcm) < 2 * FFT or count < 2:
        return pcm
    x = pcm.astype(np.float64)
    x = x - x.mean()
    window = np.hanning(FFT)
    parts = x[: count * step].reshape(count, step)
    level = np.sqrt((parts**2).mean(axis=1))
    noise = np.abs(np.fft.rfft(parts[level <= np.percentile(level, 25), :FFT] * window, axis=1)).mean(axis=0)
    y = x
    for k in range(2, 7):
        if k * hum_hz < rate / 2:
            y = _filtered(y, *_biquad(k * hum_hz, rate, NOTCH_Q, False))
    y = _filtered(y, *_biquad(cutoff_hz, rate, LOW_PASS_Q, True))
    hop = FFT // 2
    starts = np.arange(0, len(y) - FFT, hop)
    spectrum = np.fft.rfft(sliding_window_view(y, FFT)[starts] * window, axis=1)
    size = np.abs(spectrum)
    spectrum *= np.maximum(size - strength * noise, floor * size) / np.maximum(size, 1e-300)
    frames = np.fft.irfft(spectrum, FFT, axis=1) * window
    out, weight = np.zeros(len(y) + FFT), np.zeros(len(y) + FFT)
    at = starts[:, None] + np.arange(FFT)
    np.add.at(out, at, frames)
    np.add.at(weight, at, np.broadcast_to(window**2, frames.shape))
    out = (out / np.where(weight < 1e-6, 1.0, weight))[: len(y)]
    out *= np.sqrt((x**2).mean()) / max(np.sqrt((out**2).mean()), 1e-9)
    return np.clip(np.round(out), -32768, 32767).astype("<i2")


def fingerprints(df: DataFrame) -> DataFrame:
    """df with vector and digest of its column pcm (16-bit little-endian samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(np.frombuffer(p or b"", "<i2")) for p in batch.column("pcm").to_pylist()]
            yield batch.append_column("vector", pa.array([v.tolist() for v, _ in got], pa.list_(pa.float32()))).append_column("digest", pa.array([d for _, d in got], pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, vector array<float>, digest string")


def headers(df: DataFrame) -> DataFrame:
    """df with raw: the alert headers in its column pcm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode_headers(np.frombuffer(p or b"", "<i2")) for p in batch.column("pcm").to_pylist()]
            yield batch.append_column("raw", pa.array(got, pa.list_(pa.string())))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, raw array<string>")


def frame_levels(pcm: np.ndarray, frame: int = 320) -> np.ndarray:
    """Level of each whole frame against full scale."""
    whole = pcm[: len(pcm) // frame * frame].reshape(-1, frame) / 32768.0
    rms = np.sqrt((whole**2).mean(axis=1))
    return np.where(rms > 1e-9, 20 * np.log10(np.maximum(rms, 1e-9)), -120.0)


def int16(values) -> bytes:
    return struct.pack(f"<{len(values)}h", *values)
