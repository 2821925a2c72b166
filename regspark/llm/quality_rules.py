"""Quality rules by compression bands.

The zstandard ratio (compressed / raw bytes) of a whole text, and of its fixed chunks,
tells repetitive text (low) and incompressible text (high) from prose.  A short text
compresses less well than a long one, so the whole-text limits depend on the length.
The chunks cover every byte: the tail after the last full chunk is a chunk of its own with
the limits of its length, and one below the shortest band belongs to the chunk before it.

Defined cases: a null text counts as empty; an empty text has no words, ratio null and
is rejected by the base rule; a text below the shortest band is not judged by its ratio;
repeated rows are judged alike; an empty table gives an empty result.  Input columns named
like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, with_fields
from regspark.llm.words import _ship_by_value, binary_list, window_hashes, word_hashes

# From this many bytes on, the lowest and highest ratio of a whole text.
# Low limits lie about four standard deviations under the median of clean prose of that
# length, high limits well over its maximum (base64 and random bytes are above them).
BANDS = [
    (256, 0.48, 0.86),
    (512, 0.47, 0.82),
    (1024, 0.455, 0.78),
    (2048, 0.435, 0.74),
    (4096, 0.415, 0.70),
    (8192, 0.40, 0.68),
    (16384, 0.385, 0.67),
    (32768, 0.375, 0.66),
    (65536, 0.36, 0.66),
]
CHUNK_BYTES = 4096
CHUNK_BAND = (0.30, 0.74)
MAX_ODD_CHUNKS = 0.25
LEVEL = 3
MIN_WORDS = 50

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "ratio double, odd_chunks double, base_failed boolean, reason string, kept boolean")
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def repeat_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    import numpy as np
    if len(words) < 3:
        return 0
    _, where, count = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
    twice = count[where] > 1
    hit = np.zeros(len(words), bool)
    for shift in range(3):
        hit[shift:shift + len(twice)] |= twice
    return int(hit.sum())


def base_features(data: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), len(b"".join(words).decode("utf-8", "replace")),
            len(data) - len(data.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(words))


def band_of(n_bytes: int, bands: list) -> tuple | None:
    fit = None
    for start, low, high in bands:
        if n_bytes >= start:
            fit = (low, high)
    return fit


def chunks_of(data: bytes, bands: list, chunk_bytes: int, chunk_band: tuple) -> list:
    """[(chunk, its limits)], end to end over the whole text; none if it is below one chunk,
    where the whole-text limits judge the same bytes."""
    cuts = list(range(0, len(data) - chunk_bytes + 1, chunk_bytes))
    limits = [chunk_band] * len(cuts)
    tail = len(data) % chunk_bytes
    if cuts and tail and (band := band_of(tail, bands)):
        # the chunk's limits, moved as those of a text of that length are
        cuts.append(len(data) - tail)
        limits.append((chunk_band[0] + band[0] - band_of(chunk_bytes, bands)[0], max(chunk_band[1], band[1])))
    return [(data[a:b], x) for a, b, x in zip(cuts, [*cuts[1:], len(data)], limits)]


def judge(data: bytes, ratio_of, bands: list, chunk_bytes: int, chunk_band: tuple, max_odd: float) -> tuple:
    """(whole ratio, share of the bytes in chunks outside their limits, reason or None)."""
    if not data:
        return None, 0.0, None
    ratio = ratio_of(data)
    low = high = 0
    for chunk, (least, most) in chunks_of(data, bands, chunk_bytes, chunk_band):
        r = ratio_of(chunk)
        low += len(chunk) * (r < least)
        high += len(chunk) * (r > most)
    odd = (low + high) / len(data)
    limits = band_of(len(data), bands)
    if limits and ratio < limits[0]:
        return ratio, odd, "repetitive"
    if limits and ratio > limits[1]:
        return ratio, odd, "incompressible"
    if odd > max_odd:
        return ratio, odd, "repetitive chunks" if low >= high else "incompressible chunks"
    return ratio, odd, None


def _judger(bands: list, chunk_bytes: int, chunk_band: tuple, max_odd: float, level: int):
    def run(column):
        import pyarrow as pa
        import zstandard
        press = zstandard.ZstdCompressor(level=level).compress
        out = {n: [] for n in NAMES}
        for data in binary_list(column):
            base = base_features(data)
            failed = base[0] < MIN_WORDS or 100 * base[4] > 50 * base[0]
            ratio, odd, reason = judge(data, lambda x: len(press(x)) / len(x), bands, chunk_bytes, chunk_band, max_odd)
            if failed:
                reason = "base"
            for n, v in zip(NAMES, (*base, ratio, odd, failed, reason, reason is None)):
                out[n].append(v)
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_(), pa.string(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(out[n], k) for n, k in zip(NAMES, kinds)], NAMES)
    return run


def compression_bands(docs: DataFrame, text: str = "text", bands: list = BANDS, chunk_bytes: int = CHUNK_BYTES,
                      chunk_band: tuple = CHUNK_BAND, max_odd: float = MAX_ODD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """Every row of ``docs`` with its features, ratios, ``reason`` of rejection and ``kept``."""
    run = F.arrow_udf(_judger(bands, chunk_bytes, chunk_band, max_odd, level), FIELDS)
    return with_fields(docs, run(F.col(text).cast("string")), NAMES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base features, base rule and compression verdict of every document."""
    return compression_bands(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "ratio", "odd_chunks", "reason")


_ship_by_value(__name__)
