"""Substring dedup by recompression.

A text is a row of words, each named by a hash of its bytes. Recompression rounds shorten the row: one kind of round
gives every run of a symbol one name, the other gives every pair of a left and a right symbol one name, where a bit of
a symbol's own name says on which side it stands in that round. A name is a hash of what it stands for, so that all
tasks give equal parts equal names without asking each other, and equal stretches of text get equal symbols inside;
only near the ends of a stretch can they differ. Each symbol knows how far it looked: the words on which its name and
borders depend. A symbol whose dependence fits into a window is the same wherever that window stands.

Spark gathers the documents of each high-level symbol. A window that holds a symbol of one document only can't repeat
elsewhere; windows left are candidates. They are verified across all documents by 128 bits of their 50 words: two
hashes, each built from a naming of its own of the words' bytes, by scrambled pairs of halves and not by a polynomial,
so that no pattern of words or letters makes different windows meet. Exact copies of whole texts are found by a digest
of their words before that; only the eldest copy's windows are compared, as they are first wherever the others' are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, mix64, small_batches, split_words, text_chunks, word_hashes, written

WINDOW = 50
#: r: a round that names runs; p: a round that names pairs. After these a symbol spans eight words, and nearly all depend on less than a window.
ROUNDS = "rppppppp"
FAR = 1 << 40
_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_HALVES = (np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def recompress(name: np.ndarray, doc: np.ndarray, rounds: str = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, documents and dependence (first word, behind the last word) of the symbols that `rounds` leave of a row of words.

    `doc` says to which document each word belongs; nothing is joined across documents. A dependence that reaches over
    a document's edge is given as far away.
    """
    low = np.arange(len(name), dtype=np.int64)
    high = low + 1
    for number, kind in enumerate(rounds):
        n = len(name)
        if n < 2:
            break
        same_doc = doc[1:] == doc[:-1]
        if kind == "r":
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | ~same_doc])
            length = np.diff(np.r_[first, n])
            last = first + length - 1
            # A run ends where the symbol next to it differs, and depends on that symbol.
            before = np.where(np.r_[False, same_doc][first], low[np.maximum(first - 1, 0)], -FAR)
            behind = np.where(np.r_[same_doc, False][last], high[np.minimum(last + 1, n - 1)], FAR)
            low, high = np.minimum(np.minimum.reduceat(low, first), before), np.maximum(np.maximum.reduceat(high, first), behind)
            name = np.where(length > 1, mix64(name[first] * _RUN + length.astype(np.uint64)), name[first])
            doc = doc[first]
        else:
            left = (mix64(name + np.uint64(number * 0x9E3779B1 + 1)) >> np.uint64(17) & np.uint64(1)).astype(bool)
            joined = np.r_[left[:-1] & ~left[1:] & same_doc, False]
            before = np.r_[-FAR, np.where(same_doc, low[:-1], -FAR)]
            behind = np.r_[np.where(same_doc, high[1:], FAR), FAR]
            wide_low, wide_high = np.where(left, low, np.minimum(low, before)), np.where(left, np.maximum(high, behind), high)
            # What a left symbol needs of its right neighbour, and a right symbol of its left one, is that symbol's own dependence.
            wide_low[:-1] = np.where(left[:-1] & same_doc, np.minimum(wide_low[:-1], low[1:]), wide_low[:-1])
            wide_high[1:] = np.where(~left[1:] & same_doc, np.maximum(wide_high[1:], high[:-1]), wide_high[1:])
            pair = np.flatnonzero(joined)
            name = name.copy()
            name[pair] = mix64(mix64(name[pair]) * _PAIR + name[pair + 1])
            keep = np.r_[True, ~joined[:-1]]
            name, doc, low, high = name[keep], doc[keep], wide_low[keep], wide_high[keep]
    return name, doc, low, high


def window_hash(name: np.ndarray, odd: np.uint64) -> np.ndarray:
    """A hash of each window's words, put together from blocks of 1, 2, 4, ... words."""
    n, out, at, level, step = len(name) - WINDOW + 1, None, 0, name, 1
    while True:
        if WINDOW & step:
            part = level[at : at + n]
            out = part if out is None else mix64(out * odd + part)
            at += step
        if 2 * step > WINDOW:
            return out.view(np.int64)
        level = mix64(level[:-step] * odd + level[step:])
        step *= 2


def _packed(batches):
    """The texts compressed, so that they take less room when dealt out."""
    import pyarrow as pa
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text")
        packed = pa.array([pack(texts[i].as_buffer()) if texts[i].is_valid else None for i in range(len(texts))], pa.binary())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", packed)


def _unpacked(batches, size: int = 1 << 22):
    """The batches with their texts back, in slices of about `size` bytes."""
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, out, total, begin = batch.column("text"), [], 0, 0
        for i in range(len(texts)):
            out.append(unpack(texts[i].as_buffer()) if texts[i].is_valid else None)
            total += len(out[-1] or b"")
            if total >= size or i + 1 == len(texts):
                part = batch.slice(begin, len(out))
                yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.binary()).cast(pa.large_string()))
                out, total, begin = [], 0, i + 1


def _facts(batches):
    """Of every document a digest of its words, their number, and its high-level symbols that can lie inside a window, each once."""
    import pyarrow as pa

    for batch in batches:
        for part, data, at in text_chunks(batch):
            data, starts, ends, first = split_words(data, at)
            raw, size = data.tobytes(), np.diff(first)
            digests = [hashlib.blake2b(raw[starts[i] : ends[j - 1]] if j > i else b"", digest_size=16).digest() for i, j in zip(first[:-1], first[1:], strict=True)]
            root = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            name, doc, low, high = recompress(word_hashes(data, starts, ends), np.repeat(np.arange(len(size)), size))
            fit = (high - low <= WINDOW) & (low >= 0) & (size[doc] >= WINDOW)
            pairs = np.unique(np.stack([doc[fit], name[fit].view(np.int64)]), axis=1)
            names = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(len(size) + 1)), pa.int32()), pa.array(pairs[1]))
            columns = [part.column("doc_id"), part.column("th"), pa.array(root[:, 0]), pa.array(root[:, 1]), pa.array(size.astype(np.int64)), names]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "root", "root2", "n_words", "names"])


def _candidates(batches):
    """(doc_id, th, span, h, h2) of every window of which all inner symbols are shared. Equal windows in a row, as in a run of one
    word, are one row; span is the first one's place times 2**32, plus their number."""
    import pyarrow as pa

    for batch in _unpacked(batches):
        for part, data, at in text_chunks(batch):
            data, starts, ends, first = split_words(data, at)
            words = word_hashes(data, starts, ends)
            name, of, low, high = recompress(words, np.repeat(np.arange(part.num_rows), np.diff(first)))
            shared, whole = part.column("shared"), part.column("whole")
            fit = (high - low <= WINDOW) & (low >= 0)
            name, of, low, high = name[fit].view(np.int64), of[fit], low[fit], high[fit]
            edge = np.searchsorted(of, np.arange(part.num_rows + 1))
            docs, spans, hashes = [], [], []
            for k in range(part.num_rows):
                n = first[k + 1] - first[k]
                if whole[k].as_py() or n < WINDOW:
                    continue
                mine = slice(edge[k], edge[k + 1])
                known = np.array(shared[k].values) if shared[k].is_valid else np.zeros(0, dtype=np.int64)
                alone = ~np.isin(name[mine], known)
                no = np.zeros(n + 2, dtype=np.int64)
                begin = np.clip(high[mine][alone] - WINDOW - first[k], 0, n)
                end = np.clip(low[mine][alone] + 1 - first[k], 0, n)
                np.add.at(no, begin, 1)
                np.add.at(no, np.maximum(end, begin), -1)
                place = np.flatnonzero(np.cumsum(no)[: n - WINDOW + 1] == 0)
                if len(place):
                    own, begin = slice(first[k], first[k + 1]), starts[first[k]]
                    second = word_hashes(data[begin : ends[first[k + 1] - 1]], starts[own] - begin, ends[own] - begin, 1)
                    h, h2 = window_hash(words[own], _HALVES[0])[place], window_hash(second, _HALVES[1])[place]
                    new = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
                    docs.append(np.full(len(new), k))
                    spans.append(place[new] << 32 | np.diff(np.r_[new, len(place)]))
                    hashes.append((h[new], h2[new]))
            if docs:
                at = pa.array(np.concatenate(docs))
                columns = [part.column("doc_id").take(at), part.column("th").take(at), pa.array(np.concatenate(spans))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(x)) for x in zip(*hashes, strict=True))], ["doc_id", "th", "span", "h", "h2"])


def _cut(batches):
    """The documents without the words of the windows in `spans` (all words if `whole`)."""
    import pyarrow as pa

    for batch in _unpacked(batches):
        for part, data, at in text_chunks(batch):
            data, starts, ends, first = split_words(data, at)
            spans, whole = part.column("spans"), part.column("whole").to_pylist()
            n_removed, kept = [], []
            for k in range(part.num_rows):
                n, a = int(first[k + 1] - first[k]), int(first[k])
                gone = np.full(n, bool(whole[k]))
                if not whole[k] and spans[k].is_valid:
                    edge, span = np.zeros(n + 1, dtype=np.int64), np.array(spans[k].values)
                    np.add.at(edge, span >> 32, 1)
                    np.add.at(edge, (span >> 32) + (span & 0xFFFFFFFF) - 1 + WINDOW, -1)
                    gone = np.cumsum(edge)[:n] > 0
                if gone.all():
                    text = b""
                elif not gone.any():
                    text = data[starts[a] : ends[a + n - 1]].tobytes()
                else:
                    span = np.repeat(~gone, ends[a : a + n] + 1 - starts[a : a + n])
                    text = data[starts[a] : starts[a] + len(span)][span].tobytes()[:-1]
                n_removed.append(int(gone.sum()))
                kept.append(text.decode())
            columns = [part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, n_removed, text (the kept words, one blank between).

    A word goes if a window of 50 words that covers it also begins in a document with a smaller doc_id. Windows are
    judged on the input. Null and empty texts have no words. Texts under 50 words lose nothing. Repeated rows of one
    doc_id don't count against each other; with different texts they are documents of their own with one rank, told apart
    by a hash. A row with a null doc_id is before or behind no other: it loses nothing and takes nothing. An empty table
    gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.hash(docs["text"]).alias("th"), docs["text"].alias("text"))
    known = rows.where("doc_id is not null")
    facts = written(known.mapInArrow(_facts, "doc_id long, th int, root long, root2 long, n_words long, names array<long>"), "facts")
    long_ = facts.where(F.col("n_words") >= WINDOW).select("doc_id", "th", "root", "root2")
    eldest = written(long_.groupBy("root", "root2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "eldest")
    copies = join_groups(long_, eldest, ["root", "root2"], "n", facts.count()).where("doc_id > least").select("doc_id", "th").distinct()

    symbols = facts.select("doc_id", "th", F.explode("names").alias("name"))
    common = symbols.groupBy("name").agg(F.min(F.struct("doc_id", "th")).alias("a"), F.max(F.struct("doc_id", "th")).alias("b")).where("a < b").select("name")
    shared = symbols.join(common, "name").groupBy("doc_id", "th").agg(F.collect_set("name").alias("shared"))
    marks = shared.join(copies.withColumn("whole", F.lit(True)), ["doc_id", "th"], "full_outer")
    marks = written(marks.select("doc_id", "th", F.when(F.col("whole").isNull(), F.col("shared")).alias("shared"), F.coalesce("whole", F.lit(False)).alias("whole")), "marks")
    discard(facts, eldest)

    dealt = known.mapInArrow(_packed, "doc_id long, th int, text binary")
    windows = dealt.join(marks.hint("merge"), ["doc_id", "th"], "left").mapInArrow(_candidates, "doc_id long, th int, span long, h long, h2 long")
    windows = written(windows, "windows")
    least = windows.groupBy("h", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    least = written(least.where("least < last").drop("last"), "first-windows")
    repeats = join_groups(windows, least, ["h", "h2"], "n", windows.count()).where("doc_id > least")
    spans = repeats.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans"))
    gone = spans.withColumn("whole", F.lit(False)).unionByName(marks.where("whole").select("doc_id", "th", F.lit(None).cast("array<long>").alias("spans"), "whole"))
    gone = written(gone, "gone")
    discard(windows, least, marks)
    alone = rows.where("doc_id is null").mapInArrow(_packed, "doc_id long, th int, text binary").withColumns({"spans": F.lit(None).cast("array<long>"), "whole": F.lit(False)})
    texts = dealt.join(gone.hint("merge"), ["doc_id", "th"], "left").unionByName(alone)
    return texts.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")
