"""Cutting of whole batches of texts into pieces with numpy, each distinct piece named once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
#: ASCII characters that are neither white space, letter nor control character.
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK &= ~LETTER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its values (nulls are empty)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def letter_ends(data: np.ndarray) -> np.ndarray:
    """For each byte whether a letter ends there that every Unicode version knows (ASCII or Latin-1)."""
    out = LETTER[data]
    if len(data) > 1:
        out[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return out


def name_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code of each piece ``data[start:end]`` and the distinct pieces, by code.

    Pieces are ascending and do not overlap; bytes between them are left out.
    """
    if not len(starts):
        return np.zeros(0, np.int32), []
    lengths = ends - starts
    if len(starts) > 1 and (ends[:-1] != starts[1:]).any():
        step = np.zeros(len(data) + 1, np.int8)
        step[starts] += 1
        step[ends] -= 1
        body = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    else:
        body = data[starts[0] : ends[-1]]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    named = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    return named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()


def gather(values: list[bytes], codes: np.ndarray, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the packed numbers ``values[c]`` for all codes, and how many each code adds."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width.itemsize
    flat = np.frombuffer(b"".join(values), width)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    added = sizes[codes]
    stops = np.cumsum(added)
    total = int(stops[-1]) if len(stops) else 0
    where = np.repeat(first[codes] - (stops - added), added)
    where += np.arange(total)
    return flat[where], added


def sums_between(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive edges."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[edges[1:]] - total[edges[:-1]]


def texts_holding(data: np.ndarray, edges: np.ndarray, strings: list[bytes]) -> list[int]:
    """Numbers of the texts that hold one of some byte strings."""
    whole, out = data.tobytes(), set()
    for s in strings:
        at = whole.find(s)
        while at >= 0:
            k = int(np.searchsorted(edges, at, side="right")) - 1
            if at + len(s) <= edges[k + 1]:
                out.add(k)
                at = whole.find(s, int(edges[k + 1]))
            else:  # stands across two texts
                at = whole.find(s, at + 1)
    return sorted(out)
