"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: every fingerprint is within the code's radius of its home anchor. Two fingerprints
that differ in at most t bits meet at the home of either, if each is also sent to all anchors within radius plus t. The code
is a product of perfect codes on blocks of the fingerprint (Golay on 23 bits, Hamming on 7), so a home is found by decoding
and the excess t is shared out among the blocks. At each anchor only its own fingerprints are compared with those sent to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

SEED, BITS = 42, 64
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(common.WORD)
#: Generator polynomials of the perfect codes, by length; and their radius.
GENERATOR = {23: 0b101011100011, 15: 0b10011, 7: 0b1011}
RADIUS = {23: 3, 15: 1, 7: 1}
#: Own fingerprints of an anchor that one task holds; those of an anchor with more are split, and so are those sent to it.
HELD = 1 << 16


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of width words, one space between, A-Z lowered, repeats included; of fewer words the whole; of none nothing."""
    words = WORDS.findall(text.translate(UPPER))
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = len(words) - width + 1
    return [joined[i:j] for i, j in zip(start[:n].tolist(), end[width - 1 :].tolist(), strict=True)]


def fingerprint(hashed: np.ndarray) -> int:
    """Of 64-bit hashes: the bits that are set in more than half of them. None: zero."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashed), 1 << 16):
        part = hashed[i : i + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashed), bitorder="little").view("<u8")[0])


def simhash(text: bytes, width: int) -> int:
    found = shingles(text, width)
    return fingerprint(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), np.uint64, len(found)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs; only doc_id and text are read."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    make = lambda batch: {"doc_id": batch["doc_id"], "fp": [signed(simhash(x, width)) for x in common.encoded(batch["text"])]}
    return common.own_columns(docs, ["doc_id", "text"]).mapInArrow(common.per_batch(schema, make), "doc_id long, fp long")


@cache
def perfect_code(n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of the cyclic perfect code of length n: for each syndrome the error to flip, and, for each syndrome of a word and each
    excess e, the differences to all code words at distance RADIUS + e exactly (at e = 0: up to RADIUS)."""
    g, r = GENERATOR[n], RADIUS[n]
    check = g.bit_length() - 1

    def syndrome(x: int) -> int:
        for i in range(n - 1, check - 1, -1):
            if x >> i & 1:
                x ^= g << (i - check)
        return x

    of_bit = [syndrome(1 << i) for i in range(n)]
    near: list[list[list[int]]] = [[[] for _ in range(1 << check)] for _ in range(3)]
    for size in range(r + 3):
        for bits in combinations(range(n), size):
            s = flips = 0
            for b in bits:
                s ^= of_bit[b]
                flips |= 1 << b
            near[max(0, size - r)][s].append(flips)
    return np.array([x[0] for x in near[0]], np.int64), near


@cache
def syndromes(n: int) -> np.ndarray:
    """The syndrome of each value of the low and of the high 12 bits of a block."""
    g = GENERATOR[n]
    check = g.bit_length() - 1
    out = np.zeros((2, 1 << 12), np.int64)
    for half in range(2):
        for x in range(1 << 12):
            v = x << (12 * half)
            if v >> n:
                continue
            for i in range(n - 1, check - 1, -1):
                if v >> i & 1:
                    v ^= g << (i - check)
            out[half, x] = v
    return out


def decode(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest code word of each block value, and the value's syndrome."""
    table = syndromes(n)
    s = table[0][x & 0xFFF] ^ table[1][x >> 12]
    return x ^ perfect_code(n)[0][s], s


def homes(fp: np.ndarray, blocks: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The home anchor of each fingerprint (uint64); blocks are (first bit, length)."""
    out = np.zeros(len(fp), np.int64)
    for first, n in blocks:
        x = ((fp >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)
        out = (out << n) | decode(x, n)[0]
    return out


def anchors(fp: int, blocks: tuple[tuple[int, int], ...], threshold: int) -> list[int]:
    """All anchors within the radius plus the threshold of a fingerprint, the excess shared out among the blocks."""
    found = [(0, 0)]  # anchor so far, excess so far
    for first, n in blocks:
        x = (fp >> first) & ((1 << n) - 1)
        s = int(decode(np.array([x]), n)[1][0])
        near = perfect_code(n)[1]
        found = [((a << n) | (x ^ flips), used + e) for a, used in found for e in range(threshold - used + 1) for flips in near[e][s]]
    return [a for a, _ in found]


def widened(fps: np.ndarray, blocks: tuple[tuple[int, int], ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For many fingerprints at once: which fingerprint, and its anchors, as in anchors()."""
    who, anchor, used = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    for first, n in blocks:
        x = ((fps[who] >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype(np.int64)
        s = decode(x, n)[1]
        parts = []
        for e in range(threshold + 1):
            flips, start = flat(n, e)
            can = np.flatnonzero(used + e <= threshold)
            count = start[s[can] + 1] - start[s[can]]
            row = np.repeat(can, count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[s[can]], count)
            parts.append((who[row], (anchor[row] << n) | (x[row] ^ flips[at]), used[row] + e))
        who, anchor, used = (np.concatenate(c) for c in zip(*parts, strict=True))
    return who, anchor


@cache
def flat(n: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    near = perfect_code(n)[1][e]
    return np.array([x for row in near for x in row], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in near])])


PLACED = pa.schema([("anchor", pa.int64()), ("own", pa.bool_()), ("fp", pa.int64())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def place(blocks, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                fps = batch["fp"].slice(i, 1024).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                who, anchor = widened(fps, blocks, threshold)
                own = anchor == homes(fps, blocks)[who]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(own), pa.array(fps.view(np.int64)[who])], schema=PLACED)

    return run


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Which own fingerprints of an anchor are already linked, so that links stay fewer than fingerprints."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def compare(threshold: int):
    """Over rows sorted by anchor, cell and sent (own ones first): links of a spanning forest of all pairs within threshold.

    Holds the own fingerprints of one cell, HELD of them or so; those sent to it stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fps, forest = None, [], np.zeros(0, np.uint64), Forest(0)
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            anchor, cell, sent = (batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "cell", "sent"))
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(cell) != 0) | (np.diff(sent.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)], strict=True):
                if i == j:
                    continue
                if (anchor[i], cell[i]) != key:
                    key, held = (anchor[i], cell[i]), []
                if not sent[i]:
                    held.append(fp[i:j])
                    continue
                if not held:
                    continue
                if held is not None and (len(held) > 1 or fps is not held[0]):
                    fps = np.concatenate(held)
                    held, forest = [fps], Forest(len(fps))
                step = max(1, (1 << 19) // len(fps))
                for k in range(i, j, step):
                    part = fp[k : min(j, k + step)]
                    y, x = np.nonzero(differ(part[:, None], fps[None, :]) <= threshold)
                    link(part, fps, y, x, forest, out)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in out], schema=LINK)

    return run


def link(part: np.ndarray, fps: np.ndarray, y: np.ndarray, x: np.ndarray, forest: Forest, out: tuple[list[int], list[int]]) -> None:
    """Links each fingerprint of part to one of its partners, and the partners among themselves where they aren't yet."""
    last = -1
    for i, j in zip(y.tolist(), x.tolist(), strict=True):
        if i != last:
            last, head = i, j
            if part[i] != fps[j]:
                out[0].append(int(part[i]))
                out[1].append(int(fps[j]))
        elif forest.join(head, j):
            out[0].append(int(fps[head]))
            out[1].append(int(fps[j]))


def blocks_for(many: int) -> tuple[tuple[int, int], ...]:
    """The covering code for so many distinct fingerprints; what is linked is the same with each."""
    return TWO_GOLAY if many < MANY else WITH_HAMMING


def links(fps: DataFrame, threshold: int, blocks: tuple[tuple[int, int], ...]) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect whatever differs in at most threshold bits.

    Every pair within the threshold is compared and ends up connected. A hot anchor is a square of cells: its own fingerprints
    are dealt out by one side, those sent to it by the other, so no task holds an unbounded group.
    """
    n = common.partitions(fps.sparkSession)
    fps = fps.repartition(n, F.xxhash64("fp"))  # few bytes in, many out: not to be coalesced
    placed = fps.mapInArrow(common.giving_back(place(blocks, threshold)), "anchor long, own boolean, fp long")
    sizes = fps.mapInArrow(home_of(blocks), "anchor long").groupBy("anchor").count().filter(F.col("count") > HELD)
    sides = sizes.select("anchor", F.ceil(F.col("count") / HELD).cast("int").alias("side"))
    sides, _ = common.written(sides, "sides")  # so that its size is known and the many rows need no exchange for it
    placed = placed.join(sides, "anchor", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    each = F.sequence(F.lit(0), F.col("side") - 1)
    own = F.pmod(F.xxhash64("fp"), "side").cast("int")
    sent = F.pmod(F.xxhash64("fp", F.lit(1)), "side").cast("int")
    held = F.transform(each, lambda j: F.struct((own * F.col("side") + j).alias("cell"), F.lit(False).alias("sent")))
    past = F.transform(each, lambda i: F.struct((i * F.col("side") + sent).alias("cell"), F.lit(True).alias("sent")))
    spread = placed.withColumn("to", F.explode(F.when(F.col("own"), F.concat(held, past)).otherwise(past))).select("anchor", "fp", "to.cell", "to.sent")
    return spread.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell", "sent").mapInArrow(common.giving_back(compare(threshold)), "a long, b long")


def home_of(blocks):
    schema = pa.schema([("anchor", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(homes(fps, blocks))], schema=schema)

    return run


#: Blocks by how many distinct fingerprints they are for. With more blocks a fingerprint goes to more anchors and fewer
#: fingerprints share one; what is linked stays the same. Bits outside the blocks count in the comparison only.
TWO_GOLAY = ((0, 23), (23, 23))
WITH_HAMMING = (*TWO_GOLAY, (46, 15))
MANY = 1 << 26


def groups(docs: DataFrame, width: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, itself included) of each row of docs.

    Documents with equal fingerprints are one class, and links go between classes. A null or empty text has fingerprint zero
    and is linked like any other. Among equal doc_ids each row keeps its own fingerprint; null doc_ids count as larger than
    all others. No rows give no rows; of the columns only doc_id and text are read.
    """
    fps, _ = common.written(fingerprints(docs, width), "fingerprints")
    classes, _ = common.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    pairs = links(classes.select("fp"), threshold, blocks_for(classes.count()))
    reach = components(pairs)
    rooted = classes.join(reach.select(F.col("id").alias("fp"), F.col("component").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
