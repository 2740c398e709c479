"""Fill-in-the-middle: a text's middle goes behind its suffix, so that a left-to-right model learns to fill gaps.

A wavelet matrix over the classes of a text's bytes counts each class in front of any place. The counts of the classes
that begin a unit add up to the units begun there, and bisection on them finds the place where a unit ends. The counts of
bytes that continue a code point turn places into numbers of characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, small_batches, text_chunks

#: Classes of bytes: first of a code point that is no ASCII letter, first letter of a run, further letter, rest of a code point.
OTHER, FIRST, FURTHER, REST = range(4)
LEVELS = 2
#: Units and the classes that begin one: [A-Za-z]+|[^A-Za-z], runs of letters, code points.
UNITS = {"token": (OTHER, FIRST), "word": (FIRST,), "character": (OTHER, FIRST, FURTHER)}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Per cent of the texts that stay plain, and of the others those that begin with their suffix.
PLAIN_SHARE, SPM_SHARE = 10, 20


class Bits:
    """A bit array that counts the ones in front of any place."""

    def __init__(self, bits: np.ndarray):
        raw = np.zeros(len(bits) // 64 * 8 + 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, mask = i >> 6, (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Symbols of `levels` bits, kept as one bit array a level, highest bit first; each level deals zeros before ones."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.planes, self.zeros = [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            self.planes.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often `symbol` stands in front of each place."""
        low, high = np.zeros(1, dtype=np.int64), np.asarray(i, dtype=np.int64)
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            if symbol >> (len(self.planes) - 1 - k) & 1:
                low, high = zeros + plane.ones(low), zeros + plane.ones(high)
            else:
                low, high = low - plane.ones(low), high - plane.ones(high)
        return high - low

    def ranks(self, symbols: tuple[int, ...], i: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, i) for s in symbols)


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8 text."""
    letter = np.zeros(len(data) + 1, dtype=bool)
    letter[1:] = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    out = np.where(letter[1:], np.where(letter[:-1], FURTHER, FIRST), OTHER)
    return np.where(data & 0xC0 == 0x80, REST, out).astype(np.uint8)


class Texts:
    """Texts in one array of bytes: text d lies from begin[d] to end[d]."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, unit: str):
        self.begin, self.end, self.starts = begin, end, UNITS[unit]
        self.matrix = WaveletMatrix(classes(data))
        self.units = self.begun(end)

    def begun(self, place: np.ndarray) -> np.ndarray:
        """Units of each text that begin in front of `place`."""
        return self.matrix.ranks(self.starts, place) - self.matrix.ranks(self.starts, self.begin)

    def after(self, n: np.ndarray) -> np.ndarray:
        """The place where each text's unit number n (from 0) begins, or its end: the last place with at most n units begun before it."""
        low, high = self.begin.copy(), self.end.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.begun(middle) <= n
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low

    def characters(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b - a - (self.matrix.rank(REST, b) - self.matrix.rank(REST, a))


def _cut(unit: str, inputs: list[str], out: str):
    """inputs: the names of the two draws and of the form."""

    def cut(batches):
        import pyarrow as pa

        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            for part, data, at in text_chunks(batch):
                texts = Texts(data, at[:-1], at[1:] - 1, unit)
                draws = [part.column(c).to_numpy(zero_copy_only=False) % (texts.units + 1) for c in inputs[:2]]
                form = part.column(inputs[2]).to_pylist()
                a, b = texts.after(np.minimum(*draws)), texts.after(np.maximum(*draws))
                raw, made = data.tobytes(), []
                for f, s, i, j, e in zip(form, texts.begin.tolist(), a.tolist(), b.tolist(), texts.end.tolist(), strict=True):
                    prefix, suffix, middle = raw[s:i], raw[j:e], raw[i:j]
                    if f == PLAIN:
                        made.append(raw[s:e])
                    elif f == PSM:
                        made.append(b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle]))
                    else:
                        made.append(b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle]))
                plain = np.array([f == PLAIN for f in form], dtype=bool)
                fields = {
                    "n": pa.array(texts.units, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(texts.characters(texts.begin, a), pa.int64(), mask=plain),
                    "middle_chars": pa.array(texts.characters(a, b), pa.int64(), mask=plain), "output": pa.array(made, pa.binary()).view(pa.string()),
                }
                kept = [c for c in part.schema.names if c not in inputs]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.StructArray.from_arrays(list(fields.values()), list(fields))], [*kept, out])

    return cut


_RESULT = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


def draw(doc_id: Column, which: int, seed: int = 1) -> Column:
    """The number in the group `which` (from 1) of eight hexadecimal digits of sha256("seed:doc_id"); a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, which * 8 - 7, 8), 16, 10).cast("long")


def infill(docs: DataFrame, keep: tuple[str, ...] | list[str] = ("doc_id",), out: str = "infill", unit: str = "token", plain: int = PLAIN_SHARE, spm: int = SPM_SHARE, seed: int = 1) -> DataFrame:
    """The columns `keep` of `docs` (doc_id, text) and a struct `out`: n (units of the text), form, prefix_chars, middle_chars, output.

    Two draws from the seed and doc_id say after how many units the prefix and the middle end; what stands before a text's
    first unit is its prefix's. Form psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle, and plain the
    text: of empty texts, of those that contain a mark, and of `plain` per cent of the others; `spm` per cent of the rest
    are spm. The characters are code points, null for plain. A null text is empty, a null doc_id draws as one of no
    digits, repeated rows are cut alike, an empty table gives no rows. Rows move nowhere: no shuffle.
    """
    if fresh(out, list(keep)) != out:
        raise ValueError(f"{out} is a column already")
    small_batches(docs.sparkSession)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    marked = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    h = [draw(docs["doc_id"], i, seed) for i in range(1, 5)]
    form = F.when(marked | (h[2] % 100 >= 100 - plain), PLAIN).when(h[3] % 100 < spm, SPM).otherwise(PSM)
    names = list(dict.fromkeys([*keep, "text"]))
    inputs = []
    for name in ("first", "second", "form"):
        inputs.append(fresh(name, [*names, *inputs, out]))
    rows = docs.select(*[docs[c].alias(c) for c in names], *[x.alias(c) for x, c in zip((h[0], h[1], form), inputs, strict=True)])
    done = rows.mapInArrow(_cut(unit, inputs, out), StructType([*[f for f in rows.schema if f.name not in inputs], StructField(out, _RESULT)]))
    return done.select(*[done[c] for c in keep], out)


def restore(output: Column, form: Column) -> Column:
    """The text that `output` was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    prefix, suffix = F.when(form == PSM, parts[1]).otherwise(parts[2]), F.when(form == PSM, parts[2]).otherwise(parts[1])
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, parts[3], suffix))
