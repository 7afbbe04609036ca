"""Sets of word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ np.uint64((salt * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


LONG = 256  # bytes from which a word is hashed by itself


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, mixed eight bytes at a time; long ones by BLAKE2."""
    size = end - start
    out = mix(size.astype(np.uint64), 17)
    lanes = np.ndarray(len(data), dtype="<u8", buffer=np.concatenate([data, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    at = np.arange(len(start))
    for done in range(0, LONG, 8):
        at = at[(size[at] > done) & (size[at] < LONG)]
        if not len(at):
            break
        left = np.minimum(size[at] - done, 8).astype(np.uint64)
        lane = lanes[start[at] + done] & (~np.uint64(0) >> (np.uint64(64) - left * np.uint64(8)))
        out[at] = mix((out[at] * STEP) ^ mix(lane, done + 1))
    for i in np.flatnonzero(size >= LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and the number of the text each is in. Null: no words."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])]
    first = offsets - offsets[0]
    data = data + ((data - 65 < 26) * np.uint8(32)).astype(np.uint8)  # uint8 wraps below 65
    inside = (data != 32) & (data - 9 > 4)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at_border = first[:-1][first[:-1] < size]
    begins[at_border] = inside[at_border]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = first[1:-1]
    before = before[before > 0] - 1
    stops[before] = inside[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return _hashed(data, start, end), np.searchsorted(first, start, side="right") - 1


def shingle_sets(texts: pa.StringArray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles in ascending order; with fewer words the whole sequence is one."""
    words, doc = word_hashes(texts)
    n = len(texts)
    per = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])
    h = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width):
        h = h * STEP + mix(words[i : i + len(h)], i + 1)
    whole = doc[: len(h)] == doc[width - 1 :] if len(h) else np.zeros(0, dtype=bool)
    h, owner = mix(h[whole], width), doc[: len(whole)][whole]
    short = np.flatnonzero((per > 0) & (per < width))
    extra = np.zeros(len(short), dtype=np.uint64)
    for i in range(width - 1):
        has = per[short] > i
        extra[has] = extra[has] * STEP + mix(words[first[short[has]] + i], i + 1)
    extra = mix(extra, 0) + per[short].astype(np.uint64)
    counts = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(counts)])
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    alone = dict(zip(short.tolist(), extra, strict=True))
    for i in range(n):
        if counts[i]:
            got = np.sort(h[at[i] : at[i + 1]])
            got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif i in alone:
            got = np.array([alone[i]], dtype=np.uint64)
        else:
            continue
        parts.append(got)
        sizes[i] = len(got)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def folded(values: np.ndarray, offsets: np.ndarray, ufunc) -> np.ndarray:
    """ufunc.reduce of each span; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out
