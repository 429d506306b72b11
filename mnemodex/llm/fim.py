r"""Operator 13, fill-in-middle: a text is cut at two places between units and its parts change places.

Units are runs of letters A-Z, a-z and single other code points. A text is stored as its maximal runs of one class with
cumulative counts of units (a run of letters is one unit, a run of n others is n) and of code points, so a cut is found by a binary
search among the runs, and its offset in its run by subtraction; no list of units is made. Many texts share the arrays: their
runs lie one after another, and a cut's number is counted from the first unit of its text.

Cuts and forms are drawn by SHA-256 of seed and id: `plain` keeps the text, `psm` gives prefix, suffix, middle, `spm` gives
suffix, prefix, middle, each behind its mark. As no text that holds a mark is changed, splitting at marks gives
the parts back (`restored`).

Defined cases: a null text is empty; an empty text, or one that holds a mark, is plain; a null id draws as the empty string;
rows of one id draw alike, each cut in its own text; extra columns, whatever their names, are left out; texts of any length are
cut whole, one at a time where they are long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, trim, utf8

#: The marks.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Runs:
    """The class runs of texts that lie one after another: `units` and `chars` before each run, and at the end."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        #: The first byte of each code point, and the end.
        self.byte = np.append(lead, len(buf))
        text_at = np.searchsorted(lead, off)  # a text's first code point
        letter = _LETTER[buf[lead]]
        new = np.zeros(len(lead) + 1, bool)
        new[1:-1] = letter[1:] != letter[:-1]
        new[text_at] = True  # of empty texts at the end too
        new[-1] = False
        head = np.flatnonzero(new)
        self.letters = letter[head]
        self.chars = np.append(head, len(lead))
        size = np.diff(self.chars)
        self.units = np.append(0, np.cumsum(np.where(self.letters, 1, size)))
        #: Units before each text, and all.
        self.first = self.units[np.searchsorted(self.chars, text_at)]

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def cut(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The code point behind so many units of the texts."""
        at = self.first[text] + units
        run = np.searchsorted(self.units, at, side="right") - 1
        # a run of letters is one unit, so a cut meets it at its start alone
        return self.chars[run] + (at - self.units[run])


def _draws(ids: list, seed: str) -> np.ndarray:
    """The first four 32-bit numbers of each id's hash."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(len(ids), 4).astype(np.int64)


def _fim(seed: str, plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            whole, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                buf, off = whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                runs, h = Runs(buf, off), _draws(ids.slice(a, b - a).to_pylist(), seed)
                n, text = runs.counts(), np.arange(b - a)
                x, y = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                lo, hi = runs.cut(text, np.minimum(x, y)), runs.cut(text, np.maximum(x, y))
                start = np.searchsorted(runs.byte, off[:-1])
                p, m, e = runs.byte[lo].tolist(), runs.byte[hi].tolist(), off.tolist()
                view, forms, out = buf.tobytes(), [], []
                for i in range(b - a):
                    t = view[e[i] : e[i + 1]]
                    prefix, middle, suffix = view[e[i] : p[i]], view[p[i] : m[i]], view[m[i] : e[i + 1]]
                    if not t or h[i, 2] % 100 >= plain_from or PREFIX in t or SUFFIX in t or MIDDLE in t:
                        forms.append("plain")
                        out.append(t)
                    elif h[i, 3] % 100 < spm_below:
                        forms.append("spm")
                        out.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                    else:
                        forms.append("psm")
                        out.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n), pa.array(forms, pa.string()), pa.array(lo - start, mask=plain), pa.array(hi - lo, mask=plain), pa.array(out, pa.binary()).view(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
            trim()

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row per row: doc_id, n (units), form, prefix_chars and middle_chars (null if plain), output.

    plain_from: of a hundred draws those from here on stay plain; spm_below: of the others those below are spm.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(_fim(seed, plain_from, spm_below), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
