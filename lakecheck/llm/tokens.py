"""Runs of bytes out of text columns, as dictionaries of distinct strings with one number per run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lakecheck.llm.arrow import ragged


def byte_set(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, text)`` of the maximal runs of true bytes; ``offsets`` bound the texts, no run crosses them."""
    if not len(inside):
        return (np.empty(0, np.int64),) * 3
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def strings_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as strings."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)])])


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings of the runs, and the place of each run's string among them."""
    coded = strings_of(data, starts, ends).dictionary_encode()
    return coded.dictionary.cast(pa.string()), np.asarray(coded.indices, np.int64)


def counted(*keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct combinations of equally long non-negative ``keys`` and how often each occurs (or the sum of ``weights``)."""
    one = keys[0].astype(np.int64)
    tops = [int(k.max(initial=0)) + 1 for k in keys]
    for k, top in zip(keys[1:], tops[1:]):
        one = one * top + k
    if weights is None:
        each, n = np.unique(one, return_counts=True)
    else:
        each, back = np.unique(one, return_inverse=True)
        n = np.bincount(back, weights=weights, minlength=len(each)).astype(np.int64)
    out = []
    for top in reversed(tops[1:]):
        each, part = np.divmod(each, top)
        out.append(part)
    return (each, *reversed(out), n)
