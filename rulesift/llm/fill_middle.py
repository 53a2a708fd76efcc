"""Fill-in-middle transformation by a sparse checkpoint index.

A text is a sequence of units: tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched left to right,
so a unit ends where a word does, and blanks at the end are one more. It is read once to count them, in slices of
``SLICE`` bytes; every ``STEP`` units the index notes a checkpoint: units, bytes and code points so far. The cuts are
known once the units are counted. Each is found by binary search among the checkpoints and by reading on from there, over
less than ``STEP`` units. So memory beyond the text is one checkpoint for ``STEP`` units, and nothing is read twice but
for two short stretches.

The cuts and the form are drawn by hashes of the seed and the id alone, so a row's result depends on nothing else.

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle. A text
that is empty or holds a mark stays plain. ``restore`` gives the text back from the output and its form.

Cases: a null text is the empty text. A null id is drawn for like an empty one. Parts may be empty. Rows with equal ids
and texts get equal results, a row each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesift.llm.common import map_pieces, utf8

#: Units from one checkpoint to the next, and bytes that are looked at together.
STEP, SLICE = 64, 1 << 16
#: Per cent of the texts that are cut, per cent of those whose suffix comes first, and the seed.
RATE, SPM, SEED = 50, 80, 42
#: The marks before the parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Checkpoints:
    """Units of a text, and where each ``step``-th of them ends."""

    def __init__(self, text: bytes, step: int = STEP, size: int = SLICE):
        self.text, self.units, self.chars = text, 0, 0
        self.at_unit, self.at_byte, self.at_char = [0], [0], [0]
        whole = np.frombuffer(text, np.uint8)
        for start in range(0, len(whole), size):
            part = whole[start : start + size]
            blank = _BLANK[whole[start : start + size + 1]]
            if len(blank) == len(part):  # the text's end ends a unit, blank or not
                ends = np.concatenate((np.flatnonzero(~blank[:-1] & blank[1:]), [len(part) - 1])) + 1
            else:
                ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            marks = ends[-(self.units + 1) % step :: step].tolist()
            before = 0
            for i, end in enumerate(marks):
                self.chars += _chars(part[before:end])
                self.at_unit.append((self.units // step + 1 + i) * step)
                self.at_byte.append(start + end)
                self.at_char.append(self.chars)
                before = end
            self.chars += _chars(part[before:])
            self.units += len(ends)

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and code points of the first ``unit`` units."""
        k = bisect_right(self.at_unit, unit) - 1
        at = self.at_byte[k]
        for _ in range(unit - self.at_unit[k]):
            at = _UNIT.match(self.text, at).end()
        return at, self.at_char[k] + _chars(np.frombuffer(self.text, np.uint8, at - self.at_byte[k], self.at_byte[k]) if at > self.at_byte[k] else _BLANK[:0])


def _chars(part: np.ndarray) -> int:
    """Code points: bytes that don't continue one."""
    return len(part) - int(np.count_nonzero(part & 0xC0 == 0x80)) if len(part) else 0


def draws(row: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if row is None else row}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut_text(text: bytes, row: int | None, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    index = Checkpoints(text)
    h1, h2, h3, h4 = draws(row, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return index.units, "plain", None, None, text
    first, second = sorted((h1 % (index.units + 1), h2 % (index.units + 1)))
    (a, a_chars), (b, b_chars) = index.cut(first), index.cut(second)
    if h4 % 100 < spm:
        form, out = "spm", b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    else:
        form, out = "psm", b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return index.units, form, a_chars, b_chars - a_chars, out


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of every row."""
    kept = docs.select("doc_id", utf8())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            found = [cut_text(t or b"", row, rate, spm, seed) for t, row in zip(batch.column("text").to_pylist(), ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(types))], names)

    made = map_pieces(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` has cut: no part holds a mark, so the marks tell the parts."""
    parts = F.split(output, "<[PSM]>")
    first, second, third = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def report(docs: DataFrame) -> DataFrame:
    """``transform`` with digests of the output and of the restored text in place of the output."""
    digest = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
