"""SimHash near-dedup by anchor-point covering.

A fingerprint's first 46 bits are two words of 23 bits. The binary Golay code covers such words with radius 3:
each is within 3 bits of exactly one of 4,096 code words. Anchors are the pairs of code words. Of two fingerprints
within 3 bits of each other, some point on the way is at most 1 from the first and 2 from the second, and that point
has an anchor within the radius. So each fingerprint goes to every anchor it is within the radius of after at most
2 more bits in all (61 of 16.8 million on average), which is the covering radius plus what the threshold can add on
one side; any two that link meet at an anchor, where all 64 bits are compared.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, split_words, text_chunks, written
from .components import components

THRESHOLD = 3
_GENERATOR = 0b110001110101
_SLACK = 2
_SMALL = 64


def _hashes(buffer: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join([xxh64_digest(buffer[s:e], 42) for s, e in zip(starts, ends, strict=True)]), dtype=np.uint8)


def fingerprint_bytes(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The 64-bit SimHash, big-endian, of single-spaced words: XXH64 (seed 42) of 3-word shingles, majority of each bit."""
    if not len(starts):
        return bytes(8)
    starts, ends = (starts[:-2], ends[2:]) if len(starts) > 2 else (starts[:1], ends[-1:])
    count, n = np.zeros(64, dtype=np.int64), len(starts)
    for i in range(0, n, 1 << 16):
        part = _hashes(buffer, starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist())
        count += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > n).tobytes()


def _fingerprints(batches):
    import pyarrow as pa

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        for part, data, at in text_chunks(batch):
            data, starts, ends, first = split_words(lower[data], at)
            buffer = data.tobytes()
            found = b"".join(fingerprint_bytes(buffer, starts[i:j], ends[i:j]) for i, j in zip(first[:-1], first[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(np.frombuffer(found, dtype=">i8").astype(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) of whole texts; null and empty texts have fingerprint 0. `row` may number the rows."""
    small_batches(docs.sparkSession)
    row = F.lit(None) if row is None else row
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), row.cast("long").alias("row"), docs["text"].alias("text")).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where((x >> bit) & 1, _GENERATOR << (bit - 11), 0)
    return x


@lru_cache(1)
def _cosets() -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0, 1 and 2 bits beyond the radius: the error patterns of so many bits in order of their syndrome, and where each syndrome begins."""
    out = []
    for weights in (range(4), (4,), (5,)):
        patterns = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(23), w)], dtype=np.int64)
        of = _syndrome(patterns)
        order = np.argsort(of, kind="stable")
        out.append((patterns[order], np.searchsorted(of[order], np.arange(2049))))
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of each fingerprint: positions in `fp`, and anchor numbers."""
    words = [(fp >> np.int64(23 * k)) & np.int64((1 << 23) - 1) for k in (0, 1)]
    of = [_syndrome(w) for w in words]
    rows, out = [], []
    for a in range(_SLACK + 1):
        for b in range(_SLACK + 1 - a):
            (pa_, at_a), (pb, at_b) = _cosets()[a], _cosets()[b]
            na, nb = at_a[of[0] + 1] - at_a[of[0]], at_b[of[1] + 1] - at_b[of[1]]
            n = na * nb
            row = np.repeat(np.arange(len(fp)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            i, j = k // nb[row], k % nb[row]
            first = (words[0][row] ^ pa_[at_a[of[0][row]] + i]) >> 11
            second = (words[1][row] ^ pb[at_b[of[1][row]] + j]) >> 11
            rows.append(row)
            out.append(first << 12 | second)
    return np.concatenate(rows), np.concatenate(out)


def _replicas(batches):
    import pyarrow as pa

    for batch in batches:
        fp = batch.column("fp").to_numpy()
        for i in range(0, len(fp), 4096):
            row, anchor = anchors(fp[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(fp[i : i + 4096][row])], ["anchor", "fp"])


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)) <= THRESHOLD


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked among distinct fingerprints, at most one a fingerprint: a search that compares each once with those not yet reached."""
    left, out = fp, []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = _close(left, x)
            if near.any():
                out += [(y, x) for y in left[near]]
                reached += list(left[near])
                left = left[~near]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _compare(anchor: np.ndarray, fp: np.ndarray):
    """Links within whole anchors, given in order of anchor."""
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[begin, len(anchor)])
    inside = np.repeat(size <= _SMALL, size)
    a, b = [], []
    for lag in range(1, min(int(size.max()), _SMALL)):
        near = np.flatnonzero((anchor[lag:] == anchor[:-lag]) & inside[lag:])
        near = near[_close(fp[near], fp[near + lag])]
        a.append(fp[near])
        b.append(fp[near + lag])
    for i in np.flatnonzero(size > _SMALL):
        x, y = forest(fp[begin[i] : begin[i] + size[i]])
        a.append(x)
        b.append(y)
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def _links(batches):
    """Reads a partition in order of anchor; what is held is a batch and the unfinished anchor."""
    import pyarrow as pa

    def out(anchor, fp):
        x, y = _compare(anchor, fp)
        pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut or (held and held[-1][0][-1] != anchor[0]):
            done = [*held, (anchor[:cut], fp[:cut])]
            held = []
            if sum(len(x) for x, _ in done):
                yield out(*map(np.concatenate, zip(*done, strict=True)))
        held.append((anchor[cut:], fp[cut:]))
    if held:
        yield out(*map(np.concatenate, zip(*held, strict=True)))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint, component_id.

    Documents whose fingerprints differ in at most 3 bits link; component_id is the smallest doc_id that can be
    reached, itself included. Copies share a fingerprint and meet once. Empty and null texts all have fingerprint
    zero and link like any other. Rows with a null doc_id take part, but name no component unless nothing else is in
    it (then component_id is null). Repeated rows come back as often as they went in, an empty table gives no rows.
    """
    out = near_groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp, root, component_id) for every row of `docs`, root being a fingerprint that names its group."""
    rows = written(fingerprints(docs, row), "fingerprints")
    kinds = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    replicas = kinds.select("fp").mapInArrow(_replicas, "anchor int, fp long")
    links = replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "u long, v long")
    roots = components(links)
    kinds = kinds.join(roots, kinds["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "smallest")
    kinds = written(kinds, "kinds")
    named = kinds.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return rows.join(kinds.join(named, "root").select("fp", "root", "component_id"), "fp")
