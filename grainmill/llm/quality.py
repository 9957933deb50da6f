"""Quality rules with compression bands.

A text that repeats itself shrinks far more than prose does; noise hardly shrinks at all. The whole text and
each of its chunks of fixed length are compressed with zstandard, and the ratio (bytes before : bytes after)
must stay inside a band for texts of that length: longer texts find more to refer back to, so both limits rise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from grainmill.llm.shelf import numbered
from grainmill.llm.text import INNER, SPACE, mix, per_text, span_hashes, steps, word_spans

LEVEL = 3
CHUNK = 4096
#: (bytes at least, lowest ratio, highest ratio); the last row that a text reaches holds. Texts below the first
#: row are too short for a ratio to say anything. The lowest ratios lie between noise (base64, words of random
#: letters and digits, random CJK) and prose of that length.
WHOLE_BANDS = ((256, 1.1, 5.0), (512, 1.3, 5.0), (1024, 1.4, 6.0), (4096, 1.5, 8.0), (65536, 1.5, 10.0))
#: Chunks of CHUNK bytes share one band; a text fails if more than this share of them lies outside.
CHUNK_BAND = (1.5, 6.0)
CHUNK_SHARE = 0.5
MIN_WORDS = 50
MOST_REPEATED = 50

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, chunks_outside double, base_failed boolean, kept boolean"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text, counted by text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    stop = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    inner = np.searchsorted(offsets, starts, "right") - 1
    stop = np.minimum(stop, offsets[inner + 1])
    full = np.searchsorted(word_start, stop) > np.searchsorted(word_start, starts)
    starts, stop, inner = starts[full], stop[full], inner[full]
    keys = span_hashes(data, starts, stop)
    order = np.lexsort((keys, inner))
    again = (keys[order][1:] == keys[order][:-1]) & (inner[order][1:] == inner[order][:-1])
    return np.bincount(inner[order][1:][again], minlength=len(offsets) - 1)


def _repeated_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words that lie in a three-word window found at least twice in their text, counted by text."""
    out = np.zeros(len(bounds) - 1, np.int64)
    k = np.uint64(0x9E3779B97F4A7C15)
    if len(words) < 3:
        return out
    windows = mix(mix(mix(words[:-2]) * k + words[1:-1]) * k + words[2:])
    for i in range(len(out)):
        a, b = bounds[i], bounds[i + 1] - 2
        if b - a < 2:
            continue
        own = windows[a:b]
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(b - a + 2, bool)
            hit = np.zeros(b - a, bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            twice[:-2] |= hit
            twice[1:-1] |= hit
            twice[2:] |= hit
            out[i] = twice.sum()
    return out


def _band(n: int, bands) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if n >= least:
            found = (low, high)
    return found


def compression_verdict(text: bytes, zip_, bands, chunk: int, chunk_band, chunk_share) -> tuple[float, float, bool]:
    """(ratio of the whole, share of full chunks outside their band, whether the text passes)."""
    if not text:
        return 1.0, 0.0, True
    ratio = len(text) / len(zip_.compress(text))
    outside = [
        not chunk_band[0] <= chunk / len(zip_.compress(text[i : i + chunk])) <= chunk_band[1]
        for i in range(0, len(text) - chunk + 1, chunk)
    ]
    share = sum(outside) / len(outside) if outside else 0.0
    band = _band(len(text), bands)
    return ratio, share, share <= chunk_share and (band is None or band[0] <= ratio <= band[1])


def _measure(texts: pa.Array, settings: tuple) -> list[pa.Array]:
    zip_ = zstandard.ZstdCompressor(level=settings[0])
    cols: list[list] = [[] for _ in range(7)]
    for _, data, offsets in steps(texts):
        start, end = word_spans(data, offsets)
        bounds = np.searchsorted(start, offsets)
        solid = ~SPACE[data] & ~INNER[data]
        at = np.arange(len(data))
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        verdicts = [compression_verdict(x, zip_, *settings[1:]) for x in parts]
        for col, values in zip(
            cols,
            (
                np.diff(bounds),
                per_text(solid, at, offsets),
                per_text(_SYMBOL[data], at, offsets),
                _repeated_lines(data, offsets, start),
                _repeated_words(span_hashes(data, start, end), bounds),
                [v[0] for v in verdicts],
                [v[1] for v in verdicts],
            ),
        ):
            col.extend(values)
        cols.append([v[2] for v in verdicts])
    *whole, ratio, share = cols[:7]
    fine = [x for part in cols[7:] for x in part]
    words, repeats = np.array(whole[0], np.int64), np.array(whole[4], np.int64)
    failed = (words < MIN_WORDS) | (100 * repeats > MOST_REPEATED * words)
    kept = ~failed & np.array(fine, bool)
    return [
        *(pa.array(np.array(x, np.int64)) for x in whole),
        pa.array(np.array(ratio, float)),
        pa.array(np.array(share, float)),
        pa.array(failed),
        pa.array(kept),
    ]


def quality(
    docs: DataFrame,
    level: int = LEVEL,
    whole_bands=WHOLE_BANDS,
    chunk: int = CHUNK,
    chunk_band=CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
) -> DataFrame:
    """`docs` with word and repetition counts, compression ratios, base_failed and kept. No shuffle.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words; ratio of the whole
    text and the share of full chunks outside their band; base_failed by the count rules; kept if neither
    the counts nor the bands reject it.

    Null or empty text: all counts 0, ratio 1, base_failed. Repeated rows are judged alike. Other columns stay;
    those named like a result are replaced. An empty table gives an empty result.
    """
    added = [x.split()[0] for x in COLUMNS.split(", ")]
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    at, settings = docs.columns.index("text"), (level, whole_bands, chunk, chunk_band, chunk_share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measure(batch.column(at), settings)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names)

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return numbered(docs).mapInArrow(judge, f"{fields}, {COLUMNS}")
