"""Language identification by a linear-chain conditional random field over words.

Each word's emission scores come from its character n-grams (those with a word edge are its prefixes and suffixes) and from
lexicons of words that the training rows use in one language almost alone. Transitions are learned with the emissions on
sequences that switch language, and forward-backward gives each word's marginals; a document's language is the label with the
highest mean. A text is one chain, however long: it is worked on in blocks of CHAIN words at once, whose messages are carried
on from block to block (a block's transfer matrix gives what it makes of any message).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Hashed n-grams of each length; most words of a lexicon; words of a block.
BUCKETS, LEXICON, CHAIN = 1 << 15, 20_000, 64
GRAMS = (2, 3, 4)
UNKNOWN = "und"
#: Bounds of the training sample: pieces of a language's texts (all pieces are as likely), characters of a piece. More
#: languages than LANGS are an error, not left out.
SAMPLE_PIECES, SAMPLE_CHARS, LANGS = 300, 1500, 1000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


class Words:
    """The words of some texts: runs of letters, with hashed n-grams by place."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([b"", *texts, b"    "])
        raw = LOWER[np.frombuffer(joined, np.uint8)]
        self.bytes = np.where(LETTER[raw], raw, 0).astype(np.uint32)
        inside = self.bytes > 0
        edges = np.diff(inside.astype(np.int8))
        self.start, self.end = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
        bounds = np.cumsum([1, *[len(t) + 1 for t in texts]])
        self.of_text = np.searchsorted(bounds, self.start, side="right") - 1

    def grams(self):
        """For each length: the bucket of the n-gram that starts at each byte, BUCKETS where none does.

        An n-gram has letters, with a word's edge at either end or not. One that starts at an edge belongs to the next word.
        """
        b = self.bytes
        inside = b > 0
        for n in GRAMS:
            size = len(b) - n
            h = np.full(size, 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h ^= b[k : k + size]
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            h &= np.uint32(BUCKETS - 1)
            valid = inside[:size] | inside[1 : size + 1]
            for k in range(1, n - 1):
                valid &= inside[k : k + size]
            h[~valid] = BUCKETS
            yield h

    def sums(self, at_bytes: np.ndarray) -> np.ndarray:
        """What stands at the bytes, summed for each word."""
        spans = np.stack([self.start - 1, self.end], 1).ravel()
        return np.add.reduceat(at_bytes, spans, axis=0)[::2]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        b = self.bytes.astype(np.uint64) + np.uint64(7)
        out = np.zeros(len(self.start), np.uint64)
        size = self.end - self.start
        live = np.arange(len(self.start))
        for k in range(int(size.max(initial=0))):
            live = live[size[live] > k]
            if not len(live):
                break
            h = (out[live] ^ b[self.start[live] + k]) * np.uint64(0x9E3779B97F4A7C15)
            out[live] = h ^ (h >> np.uint64(29))
        return out


class Model:
    """Weights of emissions (by n-gram and by lexicon) and of transitions."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.gram = np.zeros((len(GRAMS), BUCKETS + 1, n), np.float32)  # the last: no n-gram
        self.lexicon = np.zeros(0, np.uint64)
        self.lexicon_label = np.zeros(0, np.int64)
        self.lex = np.zeros((n + 1, n), np.float32)  # the last row: in no lexicon
        self.move = np.zeros((n, n), np.float32)

    def in_lexicon(self, words: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(words.start), len(self.labels))
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, self.lexicon_label[at], len(self.labels))

    def emissions(self, words: Words) -> np.ndarray:
        out = self.lex[self.in_lexicon(words)].astype(np.float32)
        if not len(out):
            return out
        total = np.zeros((len(words.bytes), len(self.labels)), np.float32)
        for table, bucket in zip(self.gram, words.grams(), strict=True):
            total[: len(bucket)] += table.take(bucket, axis=0)
        return out + words.sums(total)

    def marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains of one length; what mask leaves out has no effect. Scores: chain, word, label.

        Returns the words' marginals and the expected transitions, summed.
        """
        s = np.exp(scores - scores.max(axis=2, keepdims=True))
        s[~mask] = 1
        move = np.exp(self.move - self.move.max())
        n, length, k = s.shape
        forward, backward = np.empty_like(s), np.empty_like(s)
        forward[:, 0] = s[:, 0] / s[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            x = np.where(mask[:, t, None], (forward[:, t - 1] @ move) * s[:, t], forward[:, t - 1])
            forward[:, t] = x / x.sum(1, keepdims=True)
        backward[:, -1] = 1
        for t in range(length - 2, -1, -1):
            x = np.where(mask[:, t + 1, None], (backward[:, t + 1] * s[:, t + 1]) @ move.T, backward[:, t + 1])
            backward[:, t] = x / x.sum(1, keepdims=True)
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        if length == 1:
            return p, np.zeros((k, k), np.float32)
        pairs = forward[:, :-1, :, None] * move * (s[:, 1:] * backward[:, 1:])[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        return p, pairs[mask[:, 1:]].sum(0)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        words = Words(texts)
        scores = self.emissions(words)
        counts = np.bincount(words.of_text, minlength=len(texts))
        total = np.zeros((len(texts), len(self.labels)))
        if len(scores):
            blocks = -(-counts // CHAIN)
            offset = np.concatenate([[0], np.cumsum(blocks)])
            place = np.arange(len(scores)) - np.concatenate([[0], np.cumsum(counts)])[words.of_text]
            block, at = offset[words.of_text] + place // CHAIN, place % CHAIN
            laid = np.zeros((offset[-1], CHAIN, len(self.labels)), np.float32)
            mask = np.zeros(laid.shape[:2], bool)
            laid[block, at], mask[block, at] = scores, True
            before, behind = self.messages(laid, mask, blocks)
            for i in range(0, len(laid), 2048):
                part = slice(i, i + 2048)
                laid[part] = self.marginals_only(laid[part], mask[part], before[part], behind[part])
            p = laid[block, at]
            for k in range(len(self.labels)):
                total[:, k] = np.bincount(words.of_text, weights=p[:, k], minlength=len(texts))
        best = total.argmax(1) if len(texts) else []
        out, score = [], []
        for i, text in enumerate(texts):
            if not counts[i] or not has_letter(text):
                out.append(UNKNOWN)
                score.append(0.0)
            else:
                out.append(self.labels[best[i]])
                score.append(float(min(1.0, total[i, best[i]] / counts[i])))
        return out, score

    def messages(self, scores: np.ndarray, mask: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What reaches each block from the blocks of its text before it (negative: it is the first) and behind it."""
        n, length, k = scores.shape
        before, behind = np.full((n, k), -1, np.float32), np.ones((n, k), np.float32)
        if (blocks < 2).all():
            return before, behind
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        inner = np.flatnonzero(np.repeat(blocks > 1, blocks))  # of texts of several blocks
        where = np.full(n, -1)
        where[inner] = np.arange(len(inner))
        transfer = np.empty((len(inner), k, k), np.float32)
        move = np.exp(self.move - self.move.max())
        for i in range(0, len(inner), 2048):
            rows = inner[i : i + 2048]
            s, live = np.exp(scores[rows] - scores[rows].max(axis=2, keepdims=True)), mask[rows]
            made = np.broadcast_to(np.eye(k, dtype=np.float32), (len(rows), k, k))
            for t in range(length):
                x = np.where(live[:, t, None, None], (made @ move) * s[:, t, None, :], made)
                made = x / x.max((1, 2), keepdims=True)
            transfer[i : i + 2048] = made
        texts = np.flatnonzero(blocks > 1)
        start = np.exp(scores[first[texts], 0] - scores[first[texts], 0].max(1, keepdims=True))
        # a first block has no transition into its first word: its message comes from its own words
        now = np.zeros((len(texts), k), np.float32)
        for i in range(0, len(texts), 2048):
            rows = first[texts[i : i + 2048]]
            s, x = np.exp(scores[rows] - scores[rows].max(axis=2, keepdims=True)), start[i : i + 2048]
            for t in range(1, length):
                x = np.where(mask[rows, t, None], (x @ move) * s[:, t], x)
                x = x / x.sum(1, keepdims=True)
            now[i : i + 2048] = x
        for step in range(1, int(blocks.max())):
            live = blocks[texts] > step
            texts, now = texts[live], now[live]
            at = first[texts] + step
            now = now / now.sum(1, keepdims=True)
            before[at] = now
            now = np.matmul(now[:, None, :], transfer[where[at]])[:, 0]
        for step in range(int(blocks.max()) - 1, 0, -1):
            at = first[blocks > step] + step
            x = np.matmul(transfer[where[at]], behind[at][:, :, None])[:, :, 0]
            behind[at - 1] = x / x.sum(1, keepdims=True)
        return before, behind

    def marginals_only(self, scores: np.ndarray, mask: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The words' marginals in blocks, given the messages that reach these."""
        s = np.exp(scores - scores.max(axis=2, keepdims=True))
        s[~mask] = 1
        move = np.exp(self.move - self.move.max())
        length = s.shape[1]
        forward, back = np.empty_like(s), behind
        x = np.where(before[:, :1] < 0, s[:, 0], (before @ move) * s[:, 0])
        forward[:, 0] = x / x.sum(1, keepdims=True)
        for t in range(1, length):
            x = np.where(mask[:, t, None], (forward[:, t - 1] @ move) * s[:, t], forward[:, t - 1])
            forward[:, t] = x / x.sum(1, keepdims=True)
        for t in range(length - 1, -1, -1):
            p = forward[:, t] * back
            forward[:, t] = p / p.sum(1, keepdims=True)
            x = np.where(mask[:, t, None], (back * s[:, t]) @ move.T, back)
            back = x / x.sum(1, keepdims=True)
        return forward


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "ignore"))) if not text.isascii() else any(65 <= x <= 90 or 97 <= x <= 122 for x in text)


def train(rows: list[tuple[str, str]], rounds: int = 4, rate: float = 0.15, seed: int = 7) -> Model:
    """A model of (text, language) rows. Order of rows doesn't matter beyond rounding; no rows: every text is unknown."""
    rows = sorted((lang, text.encode()) for text, lang in rows if text)
    model = Model(sorted({lang for lang, _ in rows}))
    if not rows:
        return model
    label_of = {x: i for i, x in enumerate(model.labels)}
    words = Words([text for _, text in rows])
    if not len(words.start):
        return model
    label = np.array([label_of[lang] for lang, _ in rows])[words.of_text]
    k = len(model.labels)
    seen, inverse = np.unique(words.hashes(), return_inverse=True)
    use = np.zeros((len(seen), k))
    np.add.at(use, (inverse, label), 1)
    use /= np.maximum(1, use.sum(0))  # languages have samples of different sizes
    share, often = use.max(1) / use.sum(1), np.bincount(inverse)
    at = np.flatnonzero((share >= 0.9) & (often >= 3))
    at = np.sort(at[np.argsort(-often[at], kind="stable")][:LEXICON])
    model.lexicon, model.lexicon_label = seen[at], use[at].argmax(1)
    lexicon = model.in_lexicon(words)
    grams = []
    for bucket in words.grams():
        place = np.flatnonzero(bucket < BUCKETS)
        grams.append((bucket[place], np.searchsorted(place, np.append(words.start - 1, words.end[-1:]))))
    rng = np.random.default_rng(seed)
    # sequences of pieces of 4 to 16 words; in each, pieces of one language or of several
    cuts, i = [], 0
    while i < len(label):
        size = int(rng.integers(4, 17))
        cuts.append((i, min(len(label), i + size)))
        i += size
    by_label = [[c for c in cuts if label[c[0]] == x] for x in range(k)]
    length, square = 48, {"gram": np.full(model.gram.shape, 1e-6, np.float32), "lex": np.full(model.lex.shape, 1e-6, np.float32), "move": np.full((k, k), 1e-6, np.float32)}
    for _ in range(rounds):
        order = rng.permutation(len(cuts))
        sequences, taken = [], []
        for c in order:
            piece = cuts[c]
            if taken and rng.random() < 0.7:  # go on in the language, most of the time
                own = by_label[label[taken[-1]]]
                piece = own[int(rng.integers(len(own)))]
            taken += range(*piece)
            if len(taken) >= length:
                sequences.append(taken[:length])
                taken = []
        for b in range(0, len(sequences), 48):
            at = np.array(sequences[b : b + 48])
            flat = at.ravel()
            scores = model.lex[lexicon[flat]].copy()
            parts = []
            for g, (bucket, first) in enumerate(grams):
                size = first[flat + 1] - first[flat]
                rows_ = np.repeat(np.arange(len(flat)), size)
                place = bucket[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[flat], size)]
                parts.append((place, rows_))
                for x in range(k):
                    scores[:, x] += np.bincount(rows_, weights=model.gram[g][place, x], minlength=len(flat))
            truth = label[at]
            p, pairs = model.marginals(scores.reshape(*at.shape, k), np.ones(at.shape, bool))
            wrong = p.reshape(-1, k).copy()
            wrong[np.arange(len(flat)), truth.ravel()] -= 1
            moved = pairs.copy()
            np.subtract.at(moved, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
            for g, (place, rows_) in enumerate(parts):
                hit, inverse = np.unique(place, return_inverse=True)
                step = np.stack([np.bincount(inverse, weights=wrong[rows_, x]) for x in range(k)], 1) / len(flat) + 1e-6 * model.gram[g][hit]
                square["gram"][g][hit] += step**2
                model.gram[g][hit] -= rate * step / np.sqrt(square["gram"][g][hit])
            step = np.zeros_like(model.lex)
            np.add.at(step, lexicon[flat], wrong / len(flat))
            square["lex"] += step**2
            model.lex -= rate * step / np.sqrt(square["lex"])
            step = moved / len(flat) + 1e-4 * model.move
            square["move"] += step**2
            model.move -= rate * step / np.sqrt(square["move"])
    return model


def fold(doc_id) -> F.Column:
    """The remainder by 5 of a document's crc32; 0: held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """The training rows: of each language about SAMPLE_PIECES pieces, picked by a hash from the whole texts of all documents
    outside the held-out fold. More than LANGS languages raise ValueError."""
    usable = common.own_columns(docs, ["doc_id", "text", "lang"]).filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    pieces = F.ceil(F.length("text") / SAMPLE_CHARS).cast("int")
    counts = usable.groupBy("lang").agg(F.sum(pieces).alias("n")).limit(LANGS + 1).collect()
    if len(counts) > LANGS:
        raise ValueError(f"more than {LANGS} values of lang")
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1_000_000, 1 + 1_000_000 * SAMPLE_PIECES // r["n"])))])
    picked = F.filter(F.sequence(F.lit(0), pieces - 1), lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(1_000_000)) < share[F.col("lang")])
    texts = F.transform(picked, lambda i: F.substring(F.col("text"), i * SAMPLE_CHARS + 1, F.lit(SAMPLE_CHARS)))
    rows = usable.select(F.explode(texts).alias("text"), "lang").limit(2 * SAMPLE_PIECES * len(counts)).collect()
    return [(r["text"], r["lang"]) for r in rows]


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; other columns pass through.

    A null text or one without a letter is ``und`` with score 0; repeated rows each get their row; a very long text is one
    chain like any other. Columns of docs that are named lang_pred or score are replaced. Predictions use the text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names, apart = docs.columns, common.numbered_columns(docs)
    at = names.index("text")
    schema = T.StructType([*apart.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in common.rows_of(batch, 1 << 19):
                if part.num_rows:
                    lang, score = shared.value.predict(common.encoded(part.column(at)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return apart.mapInArrow(common.giving_back(run), schema).toDF(*names, "lang_pred", "score")
