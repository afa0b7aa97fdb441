"""Words of a slice of documents as numbers: flat codes, the distinct words and where documents begin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def coded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """White-space separated words: code of each, distinct words, first word of each text (and the end).

    Null texts have no words; empty words beside white space at an end are left out.
    """
    lists = pc.utf8_split_whitespace(texts.fill_null(""))
    begins = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes, words = np.asarray(flat.indices), flat.dictionary.to_pylist()
    begins = begins - begins[0]
    if "" in words:
        keep = codes != words.index("")
        begins = np.concatenate([[0], np.cumsum(keep)])[begins]
        codes = codes[keep]
    return codes, words, begins


def lengths(begins: np.ndarray) -> np.ndarray:
    return np.diff(begins)


def sums_by_text(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (words x any) over each text; zero for texts without words."""
    out = np.zeros((len(begins) - 1, *values.shape[1:]), dtype=np.float64)
    some = np.flatnonzero(np.diff(begins))
    if len(some):
        out[some] = np.add.reduceat(values, begins[some], axis=0, dtype=np.float64)
    return out
