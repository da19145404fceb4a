"""Content-chosen anchors of byte windows, in numpy.

Every window of ``width`` bytes has as its anchor the leftmost of its ``gram``-byte substrings with the least hash. That
depends on the window's bytes alone, so equal windows have equal anchors wherever they stand, and neighbouring windows
mostly share one. A run is a stretch of neighbouring windows with the same anchor; there are about 2 / (width - gram)
runs a byte, which is all that has to be compared across documents.
"""

import numpy as np

from caretide.llm.textbytes import BASE, BYTE_VALUE, INVERSE, cached_powers, mixed

U64 = np.uint64
#: Bytes worked on at a time: the arrays stay within the cache.
STEP = 1 << 17


def rolling(data: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Hash of every n-byte substring (unmixed), by doubling."""
    full, have, out, done = BYTE_VALUE[data], 1, None, 0
    while True:
        if n & have:
            if out is None:
                out, done = full, have
            else:  # ``done`` bytes, then ``have`` more
                size = len(out) - have
                out = out[:size] * U64(pow(base, have, 1 << 64)) + full[done : done + size]
                done += have
        if have * 2 > n:
            return out
        full = full[: len(full) - have] * U64(pow(base, have, 1 << 64)) + full[have:]
        have *= 2


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of all texts: text (its index), start (first window, from the text's start), count (windows), anchor (hash of
    the anchor) and region (hash of all bytes of the run, of its length and of the anchor's place in it)."""
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "start", "count", "anchor", "region")}
    lengths = np.diff(offsets)
    long_enough = np.flatnonzero(lengths >= width)
    window_ends = offsets[1:] - width  # last window of each text
    if not len(long_enough):
        return {k: np.zeros(0, np.uint64 if k in ("anchor", "region") else np.int64) for k in found}
    total = len(data) - width + 1
    for at in range(0, total, STEP):
        windows = min(STEP, total - at)
        part = data[at : at + windows + width - 1]
        h = mixed(rolling(part, gram))
        key = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        best = (sliding_min(key, width - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
        # texts that have windows here
        lo, hi = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + windows, "left")
        texts = np.arange(max(lo, 0), min(hi, len(lengths)))
        texts = texts[lengths[texts] >= width]
        begin, end = np.maximum(offsets[texts], at) - at, np.minimum(window_ends[texts] + 1, at + windows) - at
        some = end > begin
        texts, begin, end = texts[some], begin[some], end[some]
        if not len(texts):
            continue
        change = np.zeros(windows + 1, bool)
        change[1:windows] = best[1:] != best[:-1]
        change[begin] = True
        change[end] = True
        cut = np.flatnonzero(change[:windows])
        owner = np.searchsorted(begin, cut, "right") - 1
        inside = (owner >= 0) & (cut < end[owner])
        stop = np.append(cut[1:], windows)
        cut, owner = cut[inside], owner[inside]
        stop = np.minimum(stop[inside], end[owner])
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE_VALUE[part] * cached_powers(INVERSE, len(part)), out=sums[1:])
        region = (sums[stop + width - 1] - sums[cut]) * cached_powers(BASE, len(part))[cut]
        place = best[cut]
        found["text"].append(texts[owner])
        found["start"].append(cut + at - offsets[texts[owner]])
        found["count"].append(stop - cut)
        found["anchor"].append(h[place])
        found["region"].append(mixed(region + ((stop - cut) * 4096 + place - cut).astype(np.uint64)))
    return {k: np.concatenate(v) for k, v in found.items()}
