"""Best-fit packing by linear grouping.

Every text is tokenised once, where it is read; only lengths and checksums move.
A document longer than the capacity is cut: its first piece may be shorter, all
others are full.  Pieces are then dealt by hash to shards of bounded size, and each
shard is packed on its own:

1. Large pieces are sorted and put in groups of equal cardinality; each is rounded
   up to the longest of its group, so few sizes remain.
2. Configurations (how many of each size share a sequence) are taken greedily: a
   bounded knapsack over the sizes that are left finds the fullest one, and it is
   used as often as the counts allow.
3. Actual documents take the places of their group's size, longest first; what
   rounding gave away is free again.
4. Small pieces follow by best fit, longest first, in the sequence with the least
   room that suffices.

A shard of 20,000 pieces has thousands of sequences and wastes at most part of one,
so sharding costs a small fraction of a percent.

Ids: a document's chunks between spaces are looked up in a bounded cache; unknown
chunks are encoded once.  A boundary before a space that a non-space follows is
always a boundary between the tokenizer's own pieces, so the ids are those of the
whole text; texts with other runs of white space are encoded whole.

Defined results: doc_id is cast to a long (other ids are an error); null or empty text is the single id 0; null doc_ids are packed
too; identical rows are packed each; an empty table gives an empty result; only
doc_id and text are read, so other columns cannot clash.
"""
from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneta.llm.common import written

#: Chunks in the cache, pieces of a shard, groups of large pieces; pieces up to capacity / SMALL are small.
CACHE, SHARD, GROUPS, SMALL = 400_000, 20_000, 400, 3
_ODD_SPACE = re.compile(r" (?=\s|\Z)")


def byte_encoder(path: str) -> Callable[[str], bytes]:
    """text -> little-endian 32-bit ids by the tokenizer file, then id 0."""
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    cache: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return array("I", own.encode(text, add_special_tokens=False).ids).tobytes()

    fast = _same_as_ranks(path) or whole
    odd = _ODD_SPACE.search

    def encode(text: str | None) -> bytes:
        if not text:
            return b"\0\0\0\0"
        if any(t in text for t in special):
            return whole(text) + b"\0\0\0\0"
        if odd(text):
            return fast(text) + b"\0\0\0\0"
        first, *rest = text.split(" ")
        out = [fast(first)]
        for chunk in rest:
            ids = cache.get(chunk)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[chunk] = fast(" " + chunk)
            out.append(ids)
        out.append(b"\0\0\0\0")
        return b"".join(out)

    return encode


def _same_as_ranks(path: str) -> Callable[[str], bytes] | None:
    """The same vocabulary through tiktoken, where its rank file lies beside the tokenizer's."""
    import base64
    import os

    try:
        import public_tokenizers
        import tiktoken
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, OSError):
        return None
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: array("I", own(text)).tobytes()


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_encoder(path)
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"]):
                ids = memoryview(encode(text))
                n = len(ids) // 4
                start, stop = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((i, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop = stop, stop + capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})
    return run


def _fullest(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[int]:
    """How many of each size the fullest sequence holds, one of the largest first: a bounded
    knapsack with one bit per total."""
    first = int(np.flatnonzero(counts)[-1])
    room = capacity - int(sizes[first])
    left = counts.copy()
    left[first] -= 1
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for s in range(first, -1, -1):
        size, n, part = int(sizes[s]), int(min(left[s], room // sizes[s])), 1
        while n > 0:
            take = min(part, n)
            grown = (reach | reach << take * size) & mask
            if grown != reach:
                steps.append((s, take, reach))
                reach = grown
            n, part = n - take, part * 2
    total, use = reach.bit_length() - 1, [0] * len(sizes)
    use[first] = 1
    for s, take, before in reversed(steps):
        if not before >> total & 1:
            use[s] += take
            total -= take * int(sizes[s])
    return use


def pack(lengths: np.ndarray, capacity: int, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []

    def place(item: int, b: int) -> None:
        bins[item], offsets[item] = b, used[b]
        used[b] += int(lengths[item])

    large = order[lengths[order] * small > capacity]
    # linear grouping: equal cardinality, rounded up to the longest (the first) of a group
    waiting: dict[int, list[int]] = defaultdict(list)
    for part in np.array_split(large, min(groups, len(large))) if len(large) else []:
        waiting[int(lengths[part[0]])] += part.tolist()
    sizes = np.array(sorted(waiting), np.int64)
    counts = np.array([len(waiting[s]) for s in sizes.tolist()], np.int64)
    for items in waiting.values():
        items.reverse()  # the longest at the end
    while counts.any():
        use = np.array(_fullest(sizes, counts, capacity))
        had = use > 0
        times = int((counts[had] // use[had]).min())
        # leave some of each size for other configurations, while there are many
        times = max(1, times // 2) if times > 8 else 1
        counts -= use * times
        for _ in range(times):
            used.append(0)
            for s in np.flatnonzero(had)[::-1]:
                for _ in range(use[s]):
                    place(waiting[int(sizes[s])].pop(), len(used) - 1)
    rooms: dict[int, list[int]] = defaultdict(list)
    for b, u in enumerate(used):
        rooms[capacity - u].append(b)
    levels = sorted(rooms)
    for item in order[lengths[order] * small <= capacity].tolist():
        n = int(lengths[item])
        at = bisect_left(levels, n)
        if at < len(levels):
            room = levels[at]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], levels[at]
        else:
            used.append(0)
            room, b = capacity, len(used) - 1
        place(item, b)
        room -= n
        if room not in rooms:
            insort(levels, room)
        rooms[room].append(b)
    return bins, offsets


def _packed(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins, offsets = pack(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["shard"] * (1 << 32) + bins, offset=offsets)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]
    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = written(docs.mapInPandas(_pieces(tokenizer, capacity), schema), "pieces")
    full = F.col("length") == capacity  # a full piece is a sequence of its own
    rest = pieces.where(~full)
    shards = max(1, -(-rest.count() // shard))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.rand(17)), F.lit(shards)))
    rest = written(rest, "shards")
    packed = rest.groupBy("shard").applyInPandas(_packed(capacity), schema + ", sequence_id long, offset long")
    # numbers of their own for full pieces: partition and place in it, below zero
    alone = pieces.where(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(written(alone, "full"))
