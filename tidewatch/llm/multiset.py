"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A paragraph (a line with a word in it, trimmed) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo 2^32 in each lane. So the order of paragraphs doesn't matter, and one is inserted or deleted by
adding or subtracting its vector. A vector has two parts: EQUAL lanes of a digest, which tell multisets of paragraphs apart,
and LIKE lanes that are themselves a sum over the paragraph's word triples of a sign in one lane each, so that the angle
between two fingerprints follows what share of triples the documents have in common.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lanes of 32 bits. A text would need more than 2^31 triples for a lane of the second kind to wrap.
EQUAL, LIKE = 32, 256
WORD = re.compile(common.WORD)


def paragraphs(text: bytes) -> list[bytes]:
    return [x for x in (line.strip(b" \t\r\x0b\x0c") for line in text.split(b"\n")) if x]


def add(total: np.ndarray, paragraph: bytes, times: int = 1) -> None:
    """Inserts a paragraph into a fingerprint (deletes it with times = -1)."""
    total += vector(paragraph) * np.uint32(times % (1 << 32))


def vector(paragraph: bytes) -> np.ndarray:
    return vectors([paragraph])[0]


def vectors(texts: list[bytes]) -> np.ndarray:
    """The summed vectors of each text's paragraphs: texts x (EQUAL + LIKE) lanes."""
    out = np.zeros((len(texts), EQUAL + LIKE), np.uint32)
    every: list[bytes] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        own = paragraphs(text)
        if own:
            lanes = np.frombuffer(b"".join([hashlib.shake_128(p).digest(4 * EQUAL) for p in own]), "<u4").reshape(-1, EQUAL)
            out[i, :EQUAL] = lanes.sum(0, dtype=np.uint32)
            every += own
            owner += [i] * len(own)
    if every:
        lane, sign, of = triples(every)
        at = np.asarray(owner)[of] * LIKE + lane
        sums = np.bincount(at, weights=sign, minlength=len(texts) * LIKE).astype(np.int64)
        out[:, EQUAL:] = (sums.reshape(len(texts), LIKE) & 0xFFFFFFFF).astype(np.uint32)
    return out


def triples(paragraphs_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of three words within a paragraph (all words of a shorter one): lane, sign and paragraph."""
    joined = b"\n".join([b"", *paragraphs_, b""])
    raw = np.frombuffer(joined, np.uint8)
    inside = (raw > 0x20) | ((raw < 9) & (raw > 0)) | ((raw > 13) & (raw < 0x20)) | (raw == 0)
    edge = np.diff(inside.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    mixed = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    # a word's hash: its bytes' hashes, each by its place in the word, summed
    place = np.arange(len(raw))
    first = np.zeros(len(raw), np.int64)
    first[start] = start
    place -= np.maximum.accumulate(first)
    mixed ^= mixed >> np.uint64(31)
    mixed *= (place.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    word = np.add.reduceat(mixed, np.stack([start, end], 1).ravel())[::2] if len(start) else np.zeros(0, np.uint64)
    ends = np.cumsum([1, *[len(p) + 1 for p in paragraphs_]])
    of = np.searchsorted(ends, start, side="right") - 1
    per = np.bincount(of, minlength=len(paragraphs_))
    h = word.copy()
    for k in (1, 2):
        h[:-k or None] = (h[:-k] ^ (word[k:] * np.where(of[k:] == of[:-k], np.uint64(0x94D049BB133111EB), np.uint64(0)))) * np.uint64(0xD6E8FEB86659FD93) if len(h) > k else h[:-k]
        h ^= h >> np.uint64(32)
    rank = np.arange(len(of)) - np.concatenate([[0], np.cumsum(per)])[of]
    use = (rank < np.maximum(1, per[of] - 2))
    h, of = h[use], of[use]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(40)) % np.uint64(LIKE)).astype(np.int64), np.where(h & np.uint64(1 << 33), 1.0, -1.0), of


def shown(fingerprints: np.ndarray) -> list[str]:
    return [base64.b64encode(x.astype("<u4").tobytes()).decode() for x in fingerprints]


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of fingerprints: 1 where equal, else the cosine of the LIKE lanes (as signed numbers), 0 where under 0."""
    x, y = a[:, EQUAL:].copy().view(np.int32).astype(float), b[:, EQUAL:].copy().view(np.int32).astype(float)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(a)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0, 1))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


COMPARED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs.

    A null or empty text, or one of white space, has the zero fingerprint; equal texts have equal ones. Repeated rows each get
    their row; of the columns only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
    make = lambda batch: {"doc_id": batch["doc_id"], "fingerprint": shown(vectors(common.encoded(batch["text"])))}
    return common.own_columns(docs, ["doc_id", "text"]).mapInArrow(common.per_batch(schema, make), "doc_id long, fingerprint string")


def ranges(docs: DataFrame, n: int) -> DataFrame:
    """docs in n ranges of doc_id, and once more the first row of each range behind the range before it (cyclic; tail tells).

    Ranges are cut at quantiles of doc_id; the driver holds the cuts and one key per range, however many rows there are.
    """
    spark = docs.sparkSession
    splits = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = F.array(*[F.lit(x) for x in sorted(set(splits or []))]).cast("array<long>")
    docs = docs.withColumn("range", F.coalesce(F.size(F.filter(cuts, lambda x: x < F.col("doc_id"))), F.lit(-1))).withColumn("hash", F.xxhash64("text"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash")).alias("first")
    firsts = sorted((r["range"], r["first"]["doc_id"], r["first"]["hash"]) for r in docs.groupBy("range").agg(first).collect())
    heads = spark.createDataFrame([(*x, firsts[i - 1][0]) for i, x in enumerate(firsts)], "r int, d long, h long, before int")
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))
    places = F.when(F.col("before").isNotNull(), F.array(here, F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(here))
    on = (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h"))
    told = docs.join(F.broadcast(heads), on, "left")  # n rows
    laid = told.withColumn("place", F.explode(places)).select("doc_id", "text", "place.range", "place.tail", "hash")
    return laid.withColumn("slot", F.element_at(F.array(*[F.lit(x) for x in slots(spark, n + 1)]), F.col("range") + 2))


def slots(spark, n: int) -> list[int]:
    """n numbers that a repartition by them into n parts puts into one part each."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, 50 * n + 500, 1, 1).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    own = {r["part"]: r["id"] for r in found}
    return [int(own.get(i, i)) for i in range(n)]


def compare(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its text after an edit, and their likeness, with the next document's as well.

    The next document is the one with the next doc_id, after the last the first; among rows with one doc_id (null comes first)
    the order is by a hash of the text. A null text counts as empty; two empty fingerprints are alike (1). Texts of any length
    and any number of repeats count in full.
    Repeated rows each get their row; of the columns only doc_id and text are read.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    docs = common.own_columns(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    laid = ranges(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its next: range, doc_id, text, its fingerprint
        for batch in batches:
            for part in common.rows_of(batch, 4 << 20):
                texts = part["text"].to_pylist()
                own = vectors([x.encode() for x in texts])
                rows = list(zip(part["range"].to_pylist(), part["doc_id"].to_pylist(), texts, own, part["tail"].to_pylist(), strict=True))
                pairs = []
                for row in rows:
                    if last is not None and last[0] == row[0] and not last[4]:
                        pairs.append((last, row))
                    last = row
                if pairs:
                    changed = [edited(a[2], b[2]).encode() for a, b in pairs]
                    f, g, e = np.stack([a[3] for a, _ in pairs]), np.stack([b[3] for _, b in pairs]), vectors(changed)
                    columns = [[a[1] for a, _ in pairs], [len(a[2]) for a, _ in pairs], [hashlib.sha256(x).hexdigest() for x in changed], shown(f), shown(e), likeness(f, e), likeness(f, g)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, COMPARED, strict=True)], schema=COMPARED)

    ordered = laid.repartition(n + 1, F.col("slot").cast("int")).sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), "hash")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
