"""Near-duplicate groups for a corpus: all pairs whose sets of word shingles have a Jaccard similarity of SIMILAR or more.

Texts with the same words in order are one class. Classes whose SimHash fingerprints (of the shingles) differ in few bits are
linked by ``simhash``, as far as their similarity bears that out. The rest is found without loss: a class's distinct WIDTH-word shingles are put in one order for all classes (those often met in a sample
last, else by hash). Two sets of n shingles or so that are similar share one of their first n - SIMILAR n + 1, so classes are
gathered by each of these. Sizes and places in the order rule out most pairs, sketches (the parities of how many shingles fall
into each of some buckets, which can't differ in more places than the sets do) most others; what is left is decided by the
shingles themselves. No pair is passed over but those that verified links have connected already.

Candidates come in turns: first classes that are next to each other among those with a shingle, then ones further apart, each
turn only pairs that the turns before haven't connected. So a group that is connected early makes no square of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, repeats, simhash
from .components import components
from .simhash import UPPER, shingles

WIDTH, SIMILAR = 5, 0.8
#: The same similarity in whole numbers.
PART, WHOLE = 4, 5
#: Documents sampled for shingles that are met often, and how many of these are put last. Neither changes what is found.
SAMPLED, OFTEN = 10_000, 100_000
#: Bits in which fingerprints of a first link differ at most.
CLOSE = 2
#: Rows of a shingle, in order of size, are compared in turns: those fewer than so many rows apart, each turn from where the one
#: before ended. The rest, NEAR rows apart or more, comes last; rows of a shingle that one task holds then.
TURNS = (4, 16, 64)
NEAR, HELD = TURNS[-1], 2048
#: Bits of a sketch at least and at most; in between twice as many as shingles or more.
SKETCH = (1024, 1 << 16)
#: Keys of texts (24 bytes each) that are sent to all tasks; with more, the texts go to the keys.
TOLD = 50_000

PRINT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int32()), ("first", pa.binary()), ("fp", pa.int64()), ("sketch", pa.binary())])
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(9, 14)]] = True
LOWER = np.frombuffer(UPPER, np.uint8)
#: Bytes of texts that are hashed together.
TOGETHER = 1 << 19


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the 64-bit hashes of its words (A-Z lowered): the sum of a hash of each byte and its place in the word."""
    joined = b" ".join([*texts, b""])
    bounds = np.cumsum([0, *[len(x) + 1 for x in texts]])
    hashes, ends = [], []
    i = 0
    while i < len(joined):
        j = min(len(joined), i + TOGETHER)
        while j < len(joined) and not BLANK[joined[j - 1]]:  # no word is cut
            j += 1
        raw = LOWER[np.frombuffer(joined, np.uint8, j - i, i)]
        inside = ~BLANK[raw]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(start):
            size = end - start
            first = np.cumsum(size) - size
            place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
            x = (raw[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= (place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(32)
            hashes.append(np.add.reduceat(x, first))
            ends.append(start + i)
        i = j
    if not hashes:
        return [np.zeros(0, np.uint64)] * len(texts)
    every, at = np.concatenate(hashes), np.searchsorted(np.concatenate(ends), bounds)
    return [every[i:j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Of the distinct shingles (see ``simhash.shingles``) of words given by their hashes, sorted."""
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(WIDTH, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : len(words) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def first_shingles(hashed: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of sorted hashes the first in the order of all classes, as many as a similar set must share one of."""
    n = len(hashed)
    many = n - (PART * n + WHOLE - 1) // WHOLE + 1 if n else 0
    if not len(often) or not n:
        return hashed[:many]
    at = np.minimum(np.searchsorted(often, hashed), len(often) - 1)
    late = np.where(often[at] == hashed, rank[at], 0)
    return hashed[np.argsort(late, kind="stable")[:many]]


def sketch(hashed: np.ndarray) -> bytes:
    """The parity of how many hashes fall into each bucket, a bit each."""
    bits = SKETCH[0]
    while bits < min(2 * len(hashed), SKETCH[1]):
        bits *= 2
    return np.packbits(np.bincount((hashed & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(x: bytes, size: int) -> int:
    """The sketch as it would be with the buckets of one of size bytes."""
    number, have = int.from_bytes(x, "little"), len(x)
    while have > size:
        have //= 2
        number = (number >> (8 * have)) ^ (number & ((1 << (8 * have)) - 1))
    return number


def may_be_similar(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sets of n and m shingles differ in few enough buckets: similar ones differ in a ninth of n + m at most."""
    size = min(len(x), len(y))
    return (PART + WHOLE) * (folded(x, size) ^ folded(y, size)).bit_count() <= (WHOLE - PART) * (n + m)


def met_often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles (sorted) that several of the sampled documents have, and their rank: the most frequent last."""
    n = docs.count()
    picked = docs.filter(F.pmod(F.xxhash64("k2", F.lit(7)), F.lit(1_000_000)) < 1 + 1_000_000 * SAMPLED // max(1, n)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.rows_of(batch, TOGETHER):
                found = [shingle_hashes(x) for x in word_hashes(common.encoded(part["text"]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["s"])

    rows = picked.mapInArrow(common.giving_back(run), "s long").groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(OFTEN).collect()
    hashes = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array([r["count"] for r in rows], np.int64)[order]


def prints(docs: DataFrame) -> DataFrame:
    """k1, k2, a hash of the words in order (A-Z lowered), the number of shingles, the first ones, their SimHash and sketch, of keyed docs."""
    shared = docs.sparkSession.sparkContext.broadcast(met_often(docs))

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"h1": [], "h2": [], "n": [], "first": [], "fp": [], "sketch": []}
        for words in word_hashes(common.encoded(batch["text"])):
            h = xxhash.xxh3_128_digest(words.tobytes())
            hashed = shingle_hashes(words)
            out["h1"].append(int.from_bytes(h[:8], "little", signed=True))
            out["h2"].append(int.from_bytes(h[8:], "little", signed=True))
            out["n"].append(len(hashed))
            out["first"].append(first_shingles(hashed, *shared.value).tobytes())
            out["fp"].append(simhash.signed(simhash.fingerprint(hashed)))
            out["sketch"].append(sketch(hashed))
        return out | {"k1": batch["k1"], "k2": batch["k2"]}

    return docs.select("k1", "k2", "text").mapInArrow(common.per_batch(PRINT, make, TOGETHER), "k1 long, k2 long, h1 long, h2 long, n int, first binary, fp long, sketch binary")


PLACED = pa.schema([("s", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each first shingle of a class: its hash, the class, the class's number of shingles, the shingle's place."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            first = part["first"].to_pylist()
            count = np.array([len(x) // 8 for x in first], np.int64)
            total = int(count.sum())
            at = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            ids, n = (np.repeat(part[c].to_numpy(zero_copy_only=False), count) for c in ("id", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(first), np.int64)), pa.array(ids), pa.array(n), pa.array(at.astype(np.int32))], schema=PLACED)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=EDGE)


def near_pairs(low: int, high: int):
    """Over rows s, id, n, place, rank, chunk, root sorted by s, chunk and rank: pairs of low to high - 1 rows apart that may be
    similar and aren't connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "chunk", "id", "n", "place", "root")]
            old = 0 if held is None else len(held[0])
            s, chunk, ids, n, at, root = now if held is None else (np.concatenate(c) for c in zip(held, now, strict=True))
            for d in range(low, min(high, len(s))):
                first = max(0, old - d)  # pairs whose second row is new
                i = np.flatnonzero((s[first : len(s) - d] == s[first + d :]) & (chunk[first : len(s) - d] == chunk[first + d :])) + first
                if not len(i):
                    break  # then none are further apart either
                i = i[(root[i] != root[i + d]) & can_be(n[i], at[i], n[i + d], at[i + d])]
                if len(i):
                    yield edges(ids[i], ids[i + d])
            held = [c[max(0, len(s) - high + 1) :] for c in (s, chunk, ids, n, at, root)]

    return run


def can_be(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be similar by their sizes and by what is behind the shingle they share, which has the
    places at and to in their orders, if it's their first."""
    sizes = (WHOLE * n >= PART * m) & (WHOLE * m >= PART * n)
    return sizes & ((PART + WHOLE) * np.minimum(n - at, m - to) >= PART * (n + m))


def far_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows s, chunk, sent, id, n, place, rank, root, big, small (a sketch of SKETCH[0] bits) sorted by s, chunk and sent: pairs of a
    row that is held and one that is sent past, NEAR or more rows apart, that may be similar and aren't connected."""
    key, parts, held = None, [], None
    for batch in batches:
        s, chunk, sent = (batch[c].to_numpy(zero_copy_only=False) for c in ("s", "chunk", "sent"))
        columns = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "n", "place", "rank", "root", "big")]
        columns.append(np.frombuffer(b"".join(batch["small"].to_pylist()), np.uint64).reshape(len(s), -1))
        cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(chunk) != 0) | (np.diff(sent.astype(np.int8)) != 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
            if i == j:
                continue
            if (s[i], chunk[i]) != key:
                key, parts, held = (s[i], chunk[i]), [], None
            if not sent[i]:
                parts.append([c[i:j] for c in columns])
                continue
            if held is None:
                held = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
            if not held:
                continue
            ids, n, at, rank, root, big, small = held
            step = max(1, (1 << 17) // len(ids))
            for k in range(i, j, step):
                ids2, n2, at2, rank2, root2, _, small2 = (c[k : min(j, k + step)] for c in columns)
                apart = rank2[:, None] - rank[None, :]
                y, x = np.nonzero((root2[:, None] != root[None, :]) & (((apart <= -NEAR)) | ((apart >= NEAR) & (root == big)[None, :])))
                keep = can_be(n2[y], at2[y], n[x], at[x])
                y, x = y[keep], x[keep]
                for p in range(0, len(y), 1 << 14):
                    v, u = y[p : p + (1 << 14)], x[p : p + (1 << 14)]
                    differ = np.bitwise_count(small2[v] ^ small[u]).sum(1, dtype=np.int64)
                    keep = (PART + WHOLE) * differ <= (WHOLE - PART) * (n2[v] + n[u])
                    if keep.any():
                        yield edges(ids2[v[keep]], ids[u[keep]])


def similar(x: bytes, y: bytes) -> bool:
    a, b = set(shingles(x, WIDTH)), set(shingles(y, WIDTH))
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        keep = [similar(unpack.decompress(x.as_py()), unpack.decompress(y.as_py())) for x, y in zip(batch["left"], batch["right"], strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*[batch[c].to_pylist() for c in ("n", "x", "m", "y")], strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*r) for r in rows], pa.bool_()))


def tested(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b of ids of classes whose texts are similar."""
    own = lambda *names: classes.select(*[F.col(c).alias(name) for c, name in zip(("id", "n", "sketch"), names, strict=True)])
    likely = pairs.distinct().join(own("a", "n", "x"), "a").join(own("b", "m", "y"), "b").mapInArrow(common.giving_back(sketched), "a long, b long")
    likely, _ = common.written(likely, "candidates")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    wanted, _ = common.written(classes.select("id", "k1", "k2").join(ids, "id"), "wanted")
    if wanted.count() <= TOLD:
        found = repeats.packed(docs.join(F.broadcast(wanted.select("id", "k1", "k2")), ["k1", "k2"]).withColumn("doc_id", F.col("id")))
        texts = found.select(F.col("doc_id").alias("id"), "packed")
    else:
        texts = repeats.packed(docs).select("k1", "k2", "packed").join(wanted, ["k1", "k2"]).select("id", "packed")
    texts, _ = common.written(texts.dropDuplicates(["id"]), "texts")
    both = likely.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("left")), "a").join(texts.select(F.col("id").alias("b"), F.col("packed").alias("right")), "b")
    links, _ = common.written(both.select("a", "b", "left", "right").mapInArrow(common.giving_back(verified), "a long, b long"), "similar")
    return links


def close(classes: DataFrame) -> DataFrame:
    """Pairs a, b of ids of classes that connect those whose fingerprints differ in CLOSE bits or fewer."""
    fps, _ = common.written(classes.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("many")), "fingerprints")
    equal = classes.join(fps.filter("many > 1"), "fp").filter("id != least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = simhash.links(fps.select("fp"), CLOSE, simhash.blocks_for(fps.count()))
    named = lambda fp, name: fps.select(F.col("fp").alias(fp), F.col("least").alias(name))
    other = found.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(named("fa", "a"), "fa").join(named("fb", "b"), "fb").select("a", "b")
    return equal.union(other)


def within(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs a, b of ids in near_pairs of all rows s, id, n, place, rank, chunk, root."""
    behind = rows.filter((F.col("chunk") > 0) & ((F.col("rank") - 1) % HELD < high)).withColumn("chunk", F.col("chunk") - 1)  # a chunk sees the first rows of the next
    dealt = rows.unionByName(behind).repartition(common.partitions(rows.sparkSession), "s", "chunk").sortWithinPartitions("s", "chunk", "rank")
    return dealt.mapInArrow(common.giving_back(near_pairs(low, high)), "a long, b long")


def connected(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id and component of the classes (id, k1, k2, n, first, fp, sketch) that similar pairs connect to others."""
    spark = classes.sparkSession
    n = common.partitions(spark)
    placed = classes.select("id", "n", "first").repartition(n, "id").mapInArrow(common.giving_back(place), "s long, id long, n int, place int")  # not to be coalesced
    of_shingle = Window.partitionBy("s").orderBy("n", "id")
    rows = placed.withColumn("rank", F.row_number().over(of_shingle)).withColumn("more", F.lead("id").over(of_shingle).isNotNull()).filter("rank > 1 OR more").drop("more")
    rows, _ = common.written(rows, "shared")
    rows = rows.withColumn("chunk", ((F.col("rank") - 1) / HELD).cast("int"))
    found = tested(docs, classes, close(classes).union(within(rows.withColumn("root", F.col("id")), 1, TURNS[0])))
    large, _ = common.written(rows.groupBy("s").agg(F.max("rank").alias("many")).filter(F.col("many") > TURNS[0]), "large")
    for low, high in zip(TURNS, (*TURNS[1:], None), strict=True):
        more = large.filter(F.col("many") > low)
        if more.isEmpty():
            return components(found)
        reach = components(found).withColumnRenamed("component", "root")
        hot = rows.join(more, "s", "left_semi").join(reach, "id", "left").withColumn("root", F.coalesce("root", "id"))
        hot, _ = common.written(hot, "hot")
        if high:
            apart = hot.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("s")
            found = found.union(tested(docs, classes, within(hot.join(apart, "s", "left_semi"), low, high)))
    small = classes.select("id", "sketch").mapInArrow(folded_small, "id long, small binary")
    big = hot.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    hot = hot.join(big, "s").join(small, "id")
    chunks = hot.groupBy("s", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    sent = hot.filter("root != big").drop("chunk").join(chunks, "s").filter((WHOLE * F.col("n") >= PART * F.col("low")) & (WHOLE * F.col("high") >= PART * F.col("n")))
    names = ["s", "chunk", "sent", "id", "n", "place", "rank", "root", "big", "small"]
    both = hot.withColumn("sent", F.lit(False)).select(*names).union(sent.withColumn("sent", F.lit(True)).select(*names))
    far = both.repartition(n, "s", "chunk").sortWithinPartitions("s", "chunk", "sent").mapInArrow(common.giving_back(far_pairs), "a long, b long")
    return components(found.union(tested(docs, classes, far)))


def folded_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = SKETCH[0] // 8
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([folded(x, size).to_bytes(size, "little") for x in batch["sketch"].to_pylist()], pa.binary())], names=["id", "small"])


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when of each group of near-duplicates the one with the smallest doc_id is kept.

    Texts with the same words in the same order (white space and A-Z case aside) are copies; so are all without a word, null
    included. Rows that repeat doc_id and text count once; null doc_ids come first. All columns of docs pass through.
    """
    names = docs.columns
    apart = common.numbered_columns(docs)
    doc_id, text = (apart[f"c{names.index(n)}"] for n in ("doc_id", "text"))
    # null comes first, as the least number; k2 tells it from a doc_id of that value
    whole = apart.withColumns({"k1": F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))), "k2": F.xxhash64(doc_id, text), "text": text})
    keyed = whole.select("k1", "k2", F.col("k1").alias("doc_id"), "text")
    least = F.min(F.struct("k1", "k2", "n", "first", "fp", "sketch")).alias("r")
    classes = prints(keyed).groupBy("h1", "h2").agg(least).select(F.col("r.k2").alias("id"), "r.k1", "r.k2", "r.n", "r.first", "r.fp", "r.sketch")
    classes, _ = common.written(classes, "classes")
    grouped = connected(keyed, classes).withColumnRenamed("component", "root")
    rooted = classes.select("id", "k1", "k2").join(grouped, "id", "left").withColumn("root", F.coalesce("root", "id"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("r")).select("r.k1", "r.k2")
    stay, _ = common.written(stay, "stay")
    chosen = whole.join(stay, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])  # by the same columns, so dealt out once
    return chosen.select(*apart.columns).toDF(*names)
