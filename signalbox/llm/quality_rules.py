"""Quality rules: word and line rules, and bands for zstandard ratios of whole texts and fixed chunks.

A text that compresses far better than prose of its length repeats itself; one that hardly compresses isn't prose.
How well prose compresses depends on its length, so every length class has its own band, and chunks of one fixed
length find a bad stretch that the rest of a long text would hide.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame

from signalbox.llm.common import map_texts

#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"
#: Compression bands: from this many bytes on, the ratio (compressed by plain) must lie between low and high.
BANDS = ((0, 0.40, 20.0), (40, 0.35, 1.40), (100, 0.32, 1.15), (200, 0.30, 0.95), (500, 0.28, 0.88), (1000, 0.25, 0.82), (2000, 0.22, 0.76), (5000, 0.18, 0.72), (20000, 0.12, 0.70))
#: Bytes of every chunk (the last one ends with the text), their band, and the share of a text's chunks that may lie outside.
CHUNK_BYTES, CHUNK_BAND, MAX_BAD_CHUNKS = 2048, (0.22, 0.76), 0.5
LEVEL = 3
_BLANK = str.maketrans("", "", " \t\n\r\x0b\x0c")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs without ASCII white space."""
    raw = text.encode()
    words = raw.split()
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    covered = 0
    if len(count) < len(windows):
        upto = 0  # words before this one are counted
        for i, w in enumerate(windows):
            if count[w] > 1:
                covered += i + 3 - max(upto, i)
                upto = i + 3
    return len(words), len(text.translate(_BLANK)), symbols, len(lines) - len(set(lines)), covered


def band_verdict(text: str, compressor) -> tuple[float | None, int, int, str | None]:
    """Whole ratio, chunks outside their band, chunks, and the reason of a rejection or None."""
    raw = text.encode()
    if not raw:
        return None, 0, 0, "empty"
    size = lambda piece: len(compressor.compress(piece)) / len(piece)
    ratio = size(raw)
    low, high = next((lo, hi) for least, lo, hi in reversed(BANDS) if len(raw) >= least)
    starts = range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)
    if len(raw) > CHUNK_BYTES and len(raw) % CHUNK_BYTES:
        starts = [*starts, len(raw) - CHUNK_BYTES]  # of full length too, so that every ratio is of one length
    chunks = [size(raw[at : at + CHUNK_BYTES]) for at in starts]
    bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "chunks" if chunks and bad > MAX_BAD_CHUNKS * len(chunks) else None
    return round(ratio, 6), bad, len(chunks), reason


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, n_bad_chunks,
    n_chunks, reason (of the bands, null if they hold) and kept.

    Null and empty texts have no words, a null ratio and fail the base rules. Input columns of these names are
    replaced; repeated rows are judged each for itself; an empty table stays empty. A text shorter than a chunk has no
    chunks; a long one is compressed as a whole and in all its chunks.
    """
    fields = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
        "ratio double, n_bad_chunks bigint, n_chunks bigint, reason string, kept boolean"
    )

    def work() -> Callable[[list[str]], list]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

        def judge(text: str) -> tuple:
            counts = base_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            bands = band_verdict(text, compressor)
            return *counts, failed, *bands, not failed and bands[3] is None

        return lambda texts: [list(c) for c in zip(*map(judge, texts), strict=True)]

    return map_texts(df, text, fields, work)
