"""Best-fit packing of token pieces by bin completion with branch and bound.

Around the largest piece left, the undominated fillings of its sequence are enumerated, those of the least waste first.
The incumbent is the best-fit packing. Waste bounds the search: a packing of one sequence less than the incumbent leaves
so much room in all, and a branch that has wasted more is cut. It ends when the incumbent needs no more sequences
than the pieces' lengths do.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

CAPACITY = 2048
#: Pieces packed together in one task, by shards of a hash; each shard leaves one sequence partly filled.
SHARD_PIECES = 16384
#: Fillings that a shard's search looks at, beside one for each sequence, before it keeps the incumbent. None searches until the packing is proved best.
NODES = 2000
#: Texts that are cut into words here: of printable ASCII, tab, line feed and Latin letters, which all libraries class alike.
LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
PLAIN = rf"[\t\n\x20-\x7E{LETTERS}]*"
#: Words that a worker remembers, and how long one may be.
WORDS, LONG_WORD = 500_000, 40


class Words(dict):
    """The ids of words, as unsigned 32-bit integers: each goes through the tokenizer once while it is remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(2)
def encoder(vocabulary: str):
    """text -> ids (little-endian unsigned 32-bit) of the tokenizer file `vocabulary`, without added special tokens.

    A byte-level tokenizer merges inside words alone, and corpora repeat their words: so texts of plain characters are cut
    at its own boundaries, and each word goes through its merges once while it is remembered, for the length of a task at most. Any other text, any that
    spells a special token, and all texts where the file says that it works otherwise, go through it whole.
    """
    import json
    import os
    import re
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    by_words = spec["model"]["type"] == "BPE" and not spec["model"].get("ignore_merges") and spec.get("normalizer") is None and spec.get("post_processor") is None
    by_words &= all((spec.get("pre_tokenizer") or {}).get(k) == v for k, v in (("type", "ByteLevel"), ("add_prefix_space", False), ("use_regex", True)))
    # The public pattern with the classes that plain texts have of letters and digits.
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{LETTERS}0-9]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")
    plain, cut = re.compile(PLAIN).fullmatch, re.compile(pattern).findall

    # A byte-level model reads bytes as characters: those that show as themselves, the others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    characters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    merges = own.model.tokenize

    def whole(text: str) -> bytes:
        return np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(word: str) -> bytes:
        ids = array("I", [t.id for t in merges(word.encode().decode("latin-1").translate(characters))])
        return ids.tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    known = Words(merged)

    def encode(text: str) -> bytes:
        if not by_words or not plain(text) or any(s in text for s in special):
            return whole(text)
        return b"".join(map(known.__getitem__, cut(text)))

    encode.words = known
    return encode


def _pieces(vocabulary: str, capacity: int):
    def cut(batches):
        import pyarrow as pa

        encode = encoder(vocabulary)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = memoryview(encode(text.as_py() or "") + bytes(4))
                n = len(raw) // 4
                first = (n - 1) % capacity + 1
                for k, (a, b) in enumerate([(0, first), *((s, s + capacity) for s in range(first, n, capacity))]):
                    for column, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.words.clear()  # a worker that waits for its next task holds no words

    return cut


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The documents' ids, each document's followed by id 0, cut into pieces of `capacity`; only the first may be shorter."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def reachable(sizes: list[int], count: dict[int, int], room: int) -> list[int]:
    """For each number of the smallest sizes, the sums up to `room` that they reach, as the bits of an integer."""
    out, every = [1], (1 << (room + 1)) - 1
    for x in sizes:
        sums, rest, some = out[-1], min(count[x], room // x), 1
        while rest:
            some = min(some, rest)
            sums |= sums << (some * x) & every
            rest, some = rest - some, 2 * some
        out.append(sums)
    return out


def exact_fillings(sizes: list[int], count: dict[int, int], reach: list[int], space: int) -> Iterator[list[int]]:
    """All multisets of the sizes that sum to `space`, those with the largest pieces first. Every branch taken ends in one."""
    stack: list[tuple[int, int, list[int]]] = [(len(sizes), space, [])]
    while stack:
        i, left, chosen = stack.pop()
        if not left:
            yield chosen
            continue
        x = sizes[i - 1]
        most = min(count[x], left // x)
        stack += [(i - 1, left - n * x, chosen + [x] * n) for n in range(most + 1) if reach[i - 1] >> (left - n * x) & 1]


def dominated(filling: list[int], sizes: list[int], count: dict[int, int], waste: int) -> bool:
    """Whether a piece left over could join the filling, or take the place of one or two of its pieces and fill no less."""
    used = Counter(filling)

    def spare(low: int, high: int) -> bool:
        i = bisect_left(sizes, low)
        while i < len(sizes) and sizes[i] <= high:
            if count[sizes[i]] > used[sizes[i]]:
                return True
            i += 1
        return False

    kinds = sorted(used)
    if spare(1, waste) or any(spare(x + 1, x + waste) for x in kinds):
        return True
    pairs = ((x, y) for k, x in enumerate(kinds) for y in kinds[k:] if x != y or used[x] > 1)
    return any(spare(x + y, x + y + waste) for x, y in pairs)


def fillings(sizes: list[int], count: dict[int, int], room: int, allowed: int) -> Iterator[tuple[int, list[int] | None]]:
    """(waste, pieces) of the undominated fillings of `room` that waste at most `allowed`, the least waste first; pieces is None for a dominated one.

    Best fit (the largest that fits, again and again) comes first if it wastes nothing; it is undominated then. The
    others come from the exact sums that the sizes reach, so that the enumeration has no dead ends.
    """
    fit: list[int] = []
    taken, waste = Counter(), room
    i = bisect_right(sizes, waste)
    while i and waste:
        x = sizes[i - 1]
        n = min(count[x] - taken[x], waste // x)
        fit += [x] * n
        taken[x] += n
        waste -= n * x
        i = min(i - 1, bisect_right(sizes, waste))
    if not waste:
        yield 0, fit
    fitting = sizes[: bisect_right(sizes, room)]
    reach = reachable(fitting, count, room)
    for lost in range(min(room, allowed) + 1):
        if reach[-1] >> (room - lost) & 1:
            for filling in exact_fillings(fitting, count, reach, room - lost):
                if waste or filling != fit:
                    yield lost, None if dominated(filling, sizes, count, lost) else filling


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in order of decreasing length: each piece goes into the fullest sequence that has room for it."""
    rooms: list[int] = []
    open_: dict[int, list[list[int]]] = {}
    out = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        if i == len(rooms):
            room, own = capacity, []
            out.append(own)
        else:
            room = rooms[i]
            own = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
        own.append(x)
        if room > x:
            if room - x not in open_:
                insort(rooms, room - x)
            open_.setdefault(room - x, []).append(own)
    return out


def least_bins(lengths: list[int], capacity: int) -> int:
    """A number of sequences that no packing can be below: pieces over half a sequence need one each, and those of at least `a` need the room that is left beside them."""
    count = Counter(lengths)
    sizes, out = sorted(count), -(-sum(lengths) // capacity)
    over = [x for x in sizes if 2 * x > capacity]
    for a in [x for x in sizes if 2 * x <= capacity]:
        alone = sum(count[x] for x in over if x > capacity - a)
        beside = [x for x in over if x <= capacity - a]
        pairs = sum(count[x] for x in beside)
        free = pairs * capacity - sum(x * count[x] for x in beside)
        small = sum(x * count[x] for x in sizes if a <= x and 2 * x <= capacity)
        out = max(out, alone + pairs + max(0, -(-(small - free) // capacity)))
    return max(out, sum(count[x] for x in over))


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = NODES) -> tuple[list[list[int]], bool]:
    """The lengths of each sequence, by branch and bound over the fillings around the largest piece left; and whether no packing needs fewer."""
    best, least = best_fit(lengths, capacity), least_bins(lengths, capacity)
    nodes = None if nodes is None else nodes + len(best)
    count = Counter(lengths)
    sizes, seen = sorted(count), 0

    def take(pieces: list[int]) -> None:
        for x in pieces:
            count[x] -= 1
            if not count[x]:
                sizes.remove(x)

    def give(pieces: list[int]) -> None:
        for x in pieces:
            if not count[x]:
                insort(sizes, x)
            count[x] += 1

    def branch(lost: int):
        """The largest piece left and the fillings around it, within what may be wasted if a sequence is to be saved."""
        largest = sizes[-1]
        take([largest])
        return largest, lost, fillings(sizes, count, capacity - largest, (len(best) - 1) * capacity - sum(lengths) - lost)

    path: list[list[int]] = []
    stack = [branch(0)] if len(best) > least else []
    while stack and (nodes is None or seen < nodes):
        largest, lost, rest = stack[-1]
        if len(path) == len(stack):  # back from below: undo what was filled in here
            give(path.pop()[1:])
        found = next(rest, None)
        if found is None:
            give([largest])
            stack.pop()
            continue
        seen += 1
        waste, pieces = found
        if pieces is None:
            continue
        if lost + waste > (len(best) - 1) * capacity - sum(lengths):
            give([largest])
            stack.pop()
            continue
        take(pieces)
        path.append([largest, *pieces])
        if sizes:
            stack.append(branch(lost + waste))
        else:
            if len(path) < len(best):
                best = [list(x) for x in path]
            if len(best) == least:
                break
    # The search is at its end, or a sequence less is less than the pieces need.
    return best, not stack or len(best) == least


def complete_bins(lengths: np.ndarray, capacity: int, nodes: int | None = NODES) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sequence number and offset of each item, and whether no packing needs fewer sequences."""
    slots: dict[int, list[int]] = {}
    for i, x in reversed(list(enumerate(lengths.tolist()))):
        slots.setdefault(x, []).append(i)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    found, proved = bin_completion(lengths.tolist(), capacity, nodes)
    for number, pieces in enumerate(found):
        place = 0
        for x in pieces:
            i = slots[x].pop()
            sequence[i], offset[i] = number, place
            place += x
    return sequence, offset, proved


def _pack(capacity: int, nodes: int | None):
    def pack(table):
        import pyarrow as pa

        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])
        sequence, offset, proved = complete_bins(table.column("length").to_numpy(), capacity, nodes)
        number = table.column("shard").to_numpy() * (1 << 32) + sequence
        packed = table.drop_columns(["shard"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        return packed.append_column("proved", pa.array(np.full(len(packed), proved)))

    return pack


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, nodes: int | None = NODES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, proved.

    A null text is an empty one, whose only id is the closing 0. Pieces of full length are sequences of their own. The
    others are dealt to shards of about `shard_pieces` by a hash and packed by bin completion in each; a shard reads
    lengths, never ids. `nodes` bounds a shard's search, None searches to its end; `proved` says whether the piece's shard
    can't do with fewer sequences. Repeated rows and null ids are packed as documents of their own; an empty table gives
    no rows.
    """
    rows = written(pieces(docs, vocabulary, capacity).withColumn("number", F.monotonically_increasing_id()), "pieces")
    short = rows.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard_pieces))
    # By the rows' numbers, so that rows that repeat don't fall into one shard.
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards))).drop("number")
    packed = dealt.groupBy("shard").applyInArrow(_pack(capacity, nodes), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, proved boolean")
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("number")).withColumn("offset", F.lit(0).cast("long")).drop("number")
    return packed.unionByName(full.withColumn("proved", F.lit(True)))
