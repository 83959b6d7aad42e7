"""Suffix-array deduplication: removes every byte that lies in a string of some length which starts anywhere else as well.

One suffix array over a corpus has no place on a cluster, so suffixes are gathered by content first. In each window of the
length sought, the smallest hash of a short gram marks an anchor; equal windows have their anchor at the same offset and with
the same gram, so each window can be judged among the occurrences of its anchor's gram alone, and grams that occur once drop
out. An anchor's context is all its windows. Of each gram the distinct contexts (two copies of one that is there more than
once) are laid out as two strings, onwards from the anchor and backwards, in symbols of BLOCK bytes; ``suffixes.suffix_array``
orders them, and neighbours in the array give the longest match of each context to the right and to the left. These bound
which windows can be repeated; where one neighbour bears out all of them that settles it, and else windows at the offsets left
open are compared exactly.

A gram with many distinct contexts is split before that: the offsets of the anchor in its windows are halved, and each half of
a context goes to the group of its core, the bytes that all windows of these offsets share. Equal windows have equal cores,
and contexts that are equal once they are halved become one. Halves of halves follow until no group has more than HOT; with one
offset left the core is the whole window, so it always ends.

Where a text repeats itself in place, its anchors follow one another at equal distance with equal contexts; such a run is one
row, so texts of any length and kind take memory by the part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffixes import suffix_array

#: Bytes of a symbol; symbols of one suffix array; distinct contexts of a group that aren't split.
BLOCK, SYMBOLS, HOT = 16, 60_000, 256
#: Windows of a text that are looked at together; anchors that are handed on together.
PART, ROWS = 1 << 19, 1 << 15
#: Places of the position in a packed hash.
PLACE = 24

ANCHOR = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("step", pa.int32()), ("times", pa.int32())])
ANCHOR_DDL = "k1 long, k2 long, p int, a int, b int, g long, c long, step int, times int"
SPANS = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("spans", pa.list_(pa.int32()))])


def gram_length(length: int) -> int:
    """The largest power of two up to a sixth of the length and up to 64."""
    k = 1
    while 2 * k <= min(64, length // 6):
        k *= 2
    return k


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (a power of two) from each place."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    n, factor = 1, 0xD6E8FEB86659FD93
    while n < k:
        h = h[:-n] * np.uint64(factor) + h[n:]
        h ^= h >> np.uint64(29)
        factor = (factor * 0xBF58476D1CE4E5B9 + 2) % (1 << 64)
        n *= 2
    return h * np.uint64(0x94D049BB133111EB)


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of width values, by minima of blocks from the front and from the back."""
    n = len(x)
    pad = -n % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    front = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def anchors(text: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each anchor, part by part: place, first and last window start (windows of one anchor in a part follow one another),
    gram hash, context hash, distance to the next one and how many there are at that distance with the same context."""
    if len(text) < length:
        return
    k = gram_length(length)
    raw = np.frombuffer(text, np.uint8)
    width = length - k + 1
    for begin in range(0, len(raw) - length + 1, PART):  # parts overlap
        h = gram_hashes(raw[begin : begin + PART + length - 1], k)
        packed = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        at = (window_minima(packed, width) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        place, a, b = at[first] + begin, first + begin, np.append(first[1:], len(at)) - 1 + begin
        grams = np.frombuffer(b"".join([hashlib.blake2b(text[p : p + k], digest_size=8).digest() for p in place.tolist()]), "<i8")
        contexts_ = np.frombuffer(b"".join([context_hash(text, *z, length) for z in zip(place.tolist(), a.tolist(), b.tolist(), strict=True)]), "<i8")
        step = np.diff(place, append=0)
        alike = np.zeros(len(place), bool)  # this one and the next have one context
        alike[:-1] = (grams[1:] == grams[:-1]) & (contexts_[1:] == contexts_[:-1]) & (step[:-1] <= length)
        goes_on = np.zeros(len(place), bool)  # this one belongs to the run of the one before
        goes_on[1:] = alike[:-1]
        goes_on[2:] &= step[1:-1] == step[:-2]
        head = np.flatnonzero(~goes_on)
        times = np.diff(np.append(head, len(place)))
        yield place[head], a[head], b[head], grams[head], contexts_[head], np.where(times > 1, step[head], 0), times


def context_hash(text: bytes, p: int, a: int, b: int, length: int) -> bytes:
    return hashlib.blake2b(text[a : b + length], digest_size=8, salt=(p - a).to_bytes(8, "little")).digest()


def anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in common.rows_of(batch):
                for x, y, text in zip(part["k1"].to_pylist(), part["k2"].to_pylist(), common.encoded(part["text"]), strict=True):
                    for found in anchors(text, length):
                        held.append((np.full(len(found[0]), x), np.full(len(found[0]), y), *found))
                        n += len(found[0])
                    if n > ROWS:
                        yield batch_of(held)
                        held, n = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held, strict=True), ANCHOR, strict=True)], schema=ANCHOR)

    return run


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and the text, compressed, as it crosses exchanges."""
    fields = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("packed", pa.binary())])

    def make(batch: pa.RecordBatch) -> dict:
        press = zstandard.ZstdCompressor(level=3)
        return {"doc_id": batch["doc_id"], "k1": batch["k1"], "k2": batch["k2"], "packed": [press.compress(x) for x in common.encoded(batch["text"])]}

    return docs.select(F.col("doc_id").cast("long"), "k1", "k2", "text").mapInArrow(common.per_batch(fields, make), "doc_id long, k1 long, k2 long, packed binary")


CONTEXT = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary())])


def contexts(length: int):
    """The bytes of wanted contexts: offsets low to high are those of the anchor in its windows, last window first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in common.rows_of(batch, 2 << 20):
                rows = []
                for data, wanted in zip(part["packed"], part["wanted"].to_pylist(), strict=True):
                    text = unpack.decompress(data.as_py())
                    for w in wanted:
                        rows.append((w["g"], w["c"], w["n"], w["m"], w["p"] - w["b"], w["p"] - w["a"], text[w["a"] : w["b"] + length]))
                columns = list(zip(*rows, strict=True)) or [()] * len(CONTEXT)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, CONTEXT, strict=True)], schema=CONTEXT)

    return run


def same_front(x: bytes, y: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")).bit_length() + 7) // 8


def in_order(groups: list[int], strings: list[bytes]) -> list[int]:
    """The strings' numbers, by group and then by bytes, from the suffix array of all of them laid out in symbols."""
    size = np.array([-(-len(x) // BLOCK) for x in strings], np.int64)
    raw = b"".join([x + bytes(-len(x) % BLOCK) for x in strings])
    blocks = ranks(raw)
    n = len(strings)
    start = np.concatenate([[0], np.cumsum(size + 2)])  # a group's symbol, the blocks, an end that no other string has
    symbols = np.zeros(start[-1], np.int64)
    symbols[start[1:] - 1] = np.arange(n)
    symbols[start[:-1]] = n + np.asarray(groups)
    inner = np.ones(len(symbols), bool)
    inner[start[1:] - 1] = inner[start[:-1]] = False
    symbols[inner] = n + max(groups) + 1 + blocks
    array = np.asarray(suffix_array(symbols))
    number = np.full(len(symbols), -1, np.int64)
    number[start[:-1]] = np.arange(n)
    found = number[array]
    return found[found >= 0].tolist()


def ranks(raw: bytes) -> np.ndarray:
    """The rank of each block among the distinct blocks, by bytes."""
    both = np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((both[:, 1], both[:, 0]))
    ordered = both[order]
    new = np.ones(len(both), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    out = np.empty(len(both), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def longest(order: list[int], groups: list[int], strings: list[bytes], twins: list[int]) -> tuple[list[int], list[int]]:
    """Of each string: its longest match at the front with another of its group, and which one that is (-1: none; the twin
    where it is as long)."""
    best, who = [0] * len(strings), [-1] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        if groups[i] == groups[j]:
            same = same_front(strings[i], strings[j])
            for x, y in ((i, j), (j, i)):
                if same > best[x] or who[x] < 0 or (same == best[x] and twins[x] == y):
                    best[x], who[x] = same, y
    return best, who


def settle(rows: list[tuple], length: int) -> list[list[int]]:
    """Of contexts (gram, n, low, high, bytes), whole grams of them: the offsets of repeated windows as [first, last, ...].

    A context that is there more than once is laid out twice, so that its copies meet in the array like any others.
    """
    at = [i for i, r in enumerate(rows) for _ in range(1 + (r[1] > 1))]
    twins = [k - 1 if k and at[k - 1] == i else k + 1 if k + 1 < len(at) and at[k + 1] == i else -1 for k, i in enumerate(at)]
    number: dict[int, int] = {}
    groups = [number.setdefault(rows[i][0], len(number)) for i in at]
    right, left = [rows[i][4][rows[i][3] :] for i in at], [rows[i][4][: rows[i][3]][::-1] for i in at]
    r_best, r_who = longest(in_order(groups, right), groups, right, twins)
    l_best, l_who = longest(in_order(groups, left), groups, left, twins)
    bounds = [(max(rows[i][2], length - r_best[k]), min(rows[i][3], l_best[k])) for k, i in enumerate(at)]
    out: list[list[int]] = []
    asked: list[tuple[int, int]] = []
    for k, i in enumerate(at):
        if k and at[k - 1] == i:
            continue
        first, last = bounds[k]
        sure: set[int] = set()
        if first <= last:
            for j in {r_who[k], l_who[k]}:
                low, high = max(first, length - same_front(right[k], right[j])), min(last, same_front(left[k], left[j]))
                sure.update(range(low, high + 1))
                if len(sure) > last - first:
                    break
        out.append(sorted(sure))
        asked += [(k, o) for o in range(first, last + 1) if o not in sure]
    if asked:
        open_: dict[int, set[int]] = {}
        for k, o in asked:
            open_.setdefault(groups[k], set()).add(o)
        window = lambda k, o: hashlib.blake2b(rows[at[k]][4][rows[at[k]][3] - o : rows[at[k]][3] - o + length], digest_size=16).digest()
        seen: dict[tuple[int, int, bytes], int] = {}
        for k, (first, last) in enumerate(bounds):
            for o in open_.get(groups[k], ()):
                if first <= o <= last:
                    w = (groups[k], o, window(k, o))
                    seen[w] = seen.get(w, 0) + 1
        for k, o in asked:
            if seen[groups[k], o, window(k, o)] > 1:
                out[at[k]].append(o)
    return [runs(x) for x in out]


def runs(offsets: list[int]) -> list[int]:
    """Numbers as first and last of their runs."""
    out: list[int] = []
    for o in sorted(offsets):
        if out and o == out[-1] + 1:
            out[-1] = o
        else:
            out += [o, o]
    return out


def settled(length: int):
    """Over contexts sorted by gram: the spans of each. Grams are gathered until their strings fill a suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names: list[tuple[int, int]] = []
        symbols = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, names, symbols
            columns = [[g for g, _ in names], [c for _, c in names], settle(rows, length)]
            rows, names, symbols = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SPANS, strict=True)], schema=SPANS)

        for batch in batches:
            for g, c, n, _, low, high, context in zip(*[batch[f.name].to_pylist() for f in CONTEXT], strict=True):
                if symbols > SYMBOLS and rows and rows[-1][0] != g:
                    yield flush()
                rows.append((g, n, low, high, context))
                names.append((g, c))
                symbols += (len(context) // BLOCK + 4) * (1 + (n > 1))
        if rows:
            yield flush()

    return run


HALF = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("g2", pa.int64()), ("c2", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("context", pa.binary())])


def halves(length: int, size: int):
    """Contexts cut by offsets in blocks of size; g2 tells the block and its core, c2 what is left of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda *x: int.from_bytes(hashlib.blake2b(b"".join([y if isinstance(y, bytes) else y.to_bytes(8, "little", signed=True) for y in x]), digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            rows = []
            for g, c, n, _, low, high, context in zip(*[batch[f.name].to_pylist() for f in CONTEXT], strict=True):
                for block in range(low // size, high // size + 1):
                    a, b = max(low, block * size), min(high, block * size + size - 1)
                    core, left = context[high - block * size : high - block * size - size + 1 + length], context[high - b : high - a + length]
                    rows.append((g, c, n, number(g, size, block, core), number(a, b, left), a, b, left))
            columns = list(zip(*rows, strict=True)) or [()] * len(HALF)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, HALF, strict=True)], schema=HALF)

    return run


Kept = Callable[[DataFrame, str], DataFrame]


def with_sizes(once: DataFrame, kept: Kept) -> DataFrame:
    """Adds m, how many rows have a row's g, written apart so that a hot one's rows can be split."""
    return once.join(kept(once.groupBy("g").agg(F.count("*").alias("m")), "sizes"), "g")


def spans_of(once: DataFrame, length: int, size: int, kept: Kept) -> DataFrame:
    """g, c and spans of the distinct contexts in once (a written table) whose offsets lie within blocks of size; groups with
    more than HOT are halved first. A context may have several rows, of different offsets."""
    n = common.partitions(once.sparkSession)
    few = once.filter(F.col("m") <= HOT).repartition(n, "g").sortWithinPartitions("g", "c").mapInArrow(common.giving_back(settled(length)), "g long, c long, spans array<int>")
    many = once.filter(F.col("m") > HOT)
    if size == 1 or many.isEmpty():
        return few
    half = -(-size // 2)
    parts = kept(many.mapInArrow(common.giving_back(halves(length, half)), "g long, c long, n long, g2 long, c2 long, low int, high int, context binary"), "halves")
    each = parts.groupBy(F.col("g2").alias("g"), F.col("c2").alias("c")).agg(F.sum("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("context").alias("context"))
    each = kept(with_sizes(each, kept).select(*[f.name for f in CONTEXT]), "contexts")
    found = spans_of(each, length, half, kept).filter(F.size("spans") > 0).select(F.col("g").alias("g2"), F.col("c").alias("c2"), "spans")
    return few.unionByName(parts.select("g", "c", "g2", "c2").join(found, ["g2", "c2"]).select("g", "c", "spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2, which tell rows apart by doc_id and text. Rows that repeat both are copies of one another."""
    return docs.withColumn("k1", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("k2", F.xxhash64("doc_id", "text"))


def repeated(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """k1, k2 and covered (a list of runs of anchors with spans of offsets) of the rows of keyed docs with repeated strings;
    and the packed texts."""
    spark, paths = docs.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = common.written(df, name)
        paths.append(path)
        return table

    every = kept(docs.select("k1", "k2", "text").mapInArrow(common.giving_back(anchor_rows(length)), ANCHOR_DDL), "anchors")
    often = kept(every.groupBy("g").agg(F.sum("times").alias("n")).filter("n > 1").select("g"), "often")  # so that a hot gram's rows can be split
    some = kept(every.join(often, "g", "left_semi"), "repeated")
    common.drop_path(spark, paths.pop(0))
    classes = kept(some.groupBy("g", "c").agg(F.sum("times").cast("long").alias("n"), F.min(F.struct("k1", "k2", "p", "a", "b")).alias("r")), "classes")
    texts = packed(docs)
    wanted = with_sizes(classes, kept).groupBy("r.k1", "r.k2").agg(F.collect_list(F.struct("g", "c", "n", "m", "r.p", "r.a", "r.b")).alias("wanted"))
    once = kept(texts.join(wanted, ["k1", "k2"]).mapInArrow(common.giving_back(contexts(length)), "g long, c long, n long, m long, low int, high int, context binary"), "contexts")
    spans = spans_of(once, length, length - gram_length(length) + 1, kept).filter(F.size("spans") > 0)
    covered = some.join(spans, ["g", "c"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "step", "times", "spans")).alias("covered"))
    covered, _ = common.written(covered, "covered")
    for path in paths:
        common.drop_path(spark, path)
    return covered, texts


def cover(size: int, covered: list[dict] | None, length: int) -> np.ndarray:
    """Which of a text's bytes lie in a repeated window."""
    edge = np.zeros(size + 1, np.int32)
    for x in covered or ():
        reach = (x["times"] - 1) * x["step"] + length  # the windows of a run overlap
        for first, last in zip(x["spans"][::2], x["spans"][1::2], strict=True):
            edge[x["p"] - last] += 1
            edge[x["p"] - first + reach] -= 1
    return np.cumsum(edge[:-1]) > 0


def left_over(text: bytes, gone: np.ndarray, edges: np.ndarray) -> str:
    """What is left as text; characters that a cut splits go whole."""
    at = np.flatnonzero(edges)
    return "".join([text[i:j].decode("utf-8", "ignore") for i, j in zip([0, *at.tolist()], [*at.tolist(), len(text)], strict=True) if i < j and not gone[i]])


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def report(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text (what is left) of each row of docs when repeated strings of
    length bytes are removed.

    Texts count as UTF-8 bytes, null as empty; a string never crosses documents, overlapping ones all count, and all are judged
    on the input. Rows that repeat doc_id and text are copies of each other, so their long passages go in all of them. Texts
    shorter than length stay whole; very long ones are looked at part by part. The digest is of the bytes left; in text,
    characters that a cut splits go whole. No rows give no rows; of the columns only doc_id and text are read.
    """
    own = keyed(common.own_columns(docs, ["doc_id", "text"]))
    covered, texts = repeated(own, length)

    def make(batch: pa.RecordBatch) -> dict:
        unpack, out = zstandard.ZstdDecompressor(), {f.name: [] for f in KEPT}
        for data, spans in zip(batch["packed"], batch["covered"].to_pylist(), strict=True):
            text = left = unpack.decompress(data.as_py())
            edges = np.zeros(0, np.int8)
            if spans:
                gone = cover(len(text), spans, length)
                edges = np.diff(gone.astype(np.int8), prepend=0)
                left = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(left))
            out["n_spans"].append(int((edges == 1).sum()))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            out["text"].append(left_over(text, gone, edges) if spans else text.decode())
        return out | {"doc_id": batch["doc_id"]}

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    return texts.join(covered, ["k1", "k2"], "left").mapInArrow(common.per_batch(KEPT, make), ddl)


def cleaned(docs: DataFrame, length: int) -> DataFrame:
    """docs with the repeated strings cut out of text and n_chars counted anew; rows of which no word is left are dropped.

    Characters that a cut splits go whole. All other columns pass through, and untouched rows stay as they are, null texts
    included. Rows that repeat doc_id and text are copies of each other. See report() for the rest.
    """
    names = docs.columns
    apart = common.numbered_columns(docs)
    text, chars = f"c{names.index('text')}", f"c{names.index('n_chars')}" if "n_chars" in names else None
    own = apart.withColumns({"k1": F.coalesce(apart[f"c{names.index('doc_id')}"].cast("long"), F.lit(-1)), "k2": F.xxhash64(f"c{names.index('doc_id')}", text)})
    covered, _ = repeated(own.select("k1", "k2", F.col(text).alias("text"), F.lit(None).cast("long").alias("doc_id")), length)
    both = own.join(covered, ["k1", "k2"], "left").select(*apart.columns, "covered")
    schema = apart.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = batch[text].to_pylist(), []
            for i, spans in enumerate(batch["covered"].to_pylist()):
                if spans:
                    raw = texts[i].encode()
                    gone = cover(len(raw), spans, length)
                    texts[i] = left_over(raw, gone, np.diff(gone.astype(np.int8), prepend=0))
                stays.append(not spans or bool(texts[i].strip()))
            columns = [pa.array(texts, batch.schema.field(text).type) if c == text else batch[c] for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(stays, pa.bool_()))

    done = both.mapInArrow(common.giving_back(run), schema)
    if chars:
        done = done.withColumn(chars, F.length(text).cast(schema[chars].dataType))
    return done.toDF(*names)
