"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens; a sequence of tokens is accepted exactly if it is what the merges make of its bytes. It starts
as one state with a loop for each byte. Each merge (a, b) -> c, in order, is composed as a gadget:

* the state behind ``a`` loses its arc ``b`` (states are copied on write, so tokens that shared that state keep theirs);
* each state that has an arc ``a`` gets an arc ``c``, and the state behind ``c`` is the one behind ``b`` at that moment.

So the state depends on the last token alone. A full table would have vocabulary x vocabulary arcs; the compiled form keeps
the gadget log (which merge took which arc from which state, which state a token's state was copied from and when), and an
arc is expanded from the log when it is first asked for and kept in the transition table from then on.

All states accept, so each prefix of a word has one accepted path. A word is encoded by two tables in one pass over its bytes,
without going back: the byte table (a trie of all tokens with its failure links) gives the tokens that end at a byte, and the
transition table tells which of them continues the path of what is before it; exactly one does. The distinct words of some
texts take their steps together, column by column, and the texts' ids and labels are then taken from those of the words.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common

#: The split pattern and the byte alphabet of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

#: Expanded arcs and byte transitions that a worker keeps.
KEPT_ARCS = 1 << 18
#: Characters of texts that are encoded together; a longer text goes in parts. Bytes of texts whose results are held at once.
TOGETHER, SLICE = 1 << 19, 1 << 20
#: With fewer words that are still under way, each is finished by itself.
FEW = 16
#: The ends that the split pattern cuts off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, BLANK, OTHER = range(4)
INSIDE = regex.compile(r"\p{L} \p{L}")


@cache
def classes() -> np.ndarray:
    """The split pattern's class of each code point."""
    every = "".join([chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000)])
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def word_starts(points: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where the split pattern's words begin in texts laid end to end, as code points; texts begin at the places in cut."""
    kind = classes()[points]
    starts = np.ones(len(points), bool)
    starts[1:] = kind[1:] != kind[:-1]
    starts[cut[cut < len(points)]] = True
    run = np.flatnonzero(starts)
    end = np.append(run[1:], len(points))
    last = np.zeros(len(points) + 1, bool)
    last[cut] = last[-1] = True  # a run that ends here ends its text
    of, goes_on = kind[run], ~last[end]
    blank = (of == BLANK) & goes_on
    starts[end[blank & (end - run > 1)] - 1] = True  # the last blank before a word is apart from those before it
    joined = end[blank][points[end[blank] - 1] == ord(" ")]
    starts[joined] = False  # and a space belongs to the word
    quote = run[(of == OTHER) & goes_on & (end - run == 1) & (points[run] == ord("'"))]
    quote = quote[starts[quote]]
    if len(quote):
        text_end = np.append(np.flatnonzero(last[1:]) + 1, len(points))
        left = text_end[np.searchsorted(text_end, quote, "right")] - quote - 1
        at = lambda k: np.where(left >= k, points[np.minimum(quote + k, len(points) - 1)], 0)
        size = np.zeros(len(quote), np.int64)
        for x in ENDINGS:
            hit = at(1) == ord(x[0])
            if len(x) == 2:
                hit &= at(2) == ord(x[1])
            size[hit] = len(x)
        quote, size = quote[size > 0], size[size > 0]
        starts[quote + 1] = False
        behind = quote + 1 + size
        starts[behind[behind < len(points)]] = True
    return np.flatnonzero(starts)


class Transitions:
    """A table from whole numbers to whole numbers that many look things up in at once: open addressing, half full at most."""

    def __init__(self, most: int):
        self.bits, self.most = (2 * most - 1).bit_length(), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 where there is none."""
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            out[left] = np.where(found == keys[left], self.values[at[left]], -1)
            left = left[(found != keys[left]) & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there; what is there goes if it gets too much."""
        if self.n + len(keys) > self.most:
            self.clear()
            keys, values = keys[: self.most], values[: self.most]
        self.n += len(keys)
        at = self._first(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable bytes for themselves, the rest from 256 on."""
    shown = set(PRINTABLE)
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled automaton of a byte-level BPE vocabulary."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels = labels
        self.special = special
        self.id_of = {}
        for i, label in enumerate(labels):
            if i not in special.values():
                self.id_of.setdefault(label, i)
        n = len(labels)
        self.made = [-1] * n  # when the token's arc was made; bytes were there from the start
        self.left, self.right = [-1] * n, [-1] * n
        self.taken: dict[int, int] = {}  # state * n + arc -> when that state lost that arc
        self.merged = len(merges)
        for when, (a, b, c) in enumerate(merges):
            self._compose(when, a, b, c)
        self.arcs: dict[int, bool] = {}
        self._byte_table()
        self.arc_table = Transitions(KEPT_ARCS)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.shown = pa.array([b"%d," % i for i in range(n)], pa.large_binary())
        self.label_column = pa.array(labels, pa.large_binary())
        self.sizes = np.fromiter(map(len, labels), np.int64, n)

    def _compose(self, when: int, a: int, b: int, c: int) -> None:
        if (self.made[c] < 0 and len(self.labels[c]) > 1) and self._live(a) and self._live(b) and self._expand(a, b, when):
            self.taken[a * len(self.labels) + b] = when
            self.made[c], self.left[c], self.right[c] = when, a, b

    def _live(self, token: int) -> bool:
        return self.made[token] >= 0 or len(self.labels[token]) == 1

    @classmethod
    def load(cls, path: str) -> Automaton:
        """Of a tokenizer file with a byte-level pre-tokenizer and no normalizer."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without a normalizer or added space is known")
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = [b""] * (max([*model["vocab"].values(), *special.values()]) + 1)
        for token, i in model["vocab"].items():
            labels[i] = bytes(letters[x] for x in token)
        for token, i in special.items():
            labels[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind a token has an arc for the next one, once all merges are composed."""
        n = len(self.labels)
        known = self.arcs.get(state * n + token)
        if known is None:
            if len(self.arcs) > KEPT_ARCS >> 3:
                self.arcs.clear()
            known = self.arcs[state * n + token] = self._live(token) and self._expand(state, token, self.merged)
        return known

    def _expand(self, state: int, token: int, now: int) -> bool:
        """The arc as it was at a time, from the log."""
        n = len(self.labels)
        while True:
            lost = self.taken.get(state * n + token)
            if lost is not None and lost < now:
                return False
            if self.made[token] >= self.made[state] >= 0 or self.made[token] >= 0 > self.made[state]:
                token, now = self.left[token], self.made[token] + 1  # the arc came where its left half still had one
            elif self.made[state] >= 0:  # the state was copied with the arcs that it had before its own gadget
                state, now = self.right[state], self.made[state]
            else:
                return True

    def _byte_table(self) -> None:
        """Nodes of a trie of all tokens: the node behind each node and byte, and the tokens that end at each, longest first."""
        self.nodes: dict[int, int] = {}
        own, above = [-1], [(0, 0)]
        for label, token in self.id_of.items():
            if not self._live(token):
                continue
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = self.nodes.get(key, 0)
                if not node:
                    node = self.nodes[key] = len(own)
                    own.append(-1)
                    above.append((key >> 8, byte))
            own[node] = token
        depth = [0] * len(own)
        for node in range(1, len(own)):  # a node is numbered after the one above it
            depth[node] = depth[above[node][0]] + 1
        self.fail, ends = [0] * len(own), [()] * len(own)
        for node in sorted(range(1, len(own)), key=depth.__getitem__):
            parent, byte = above[node]
            if parent:
                self.fail[node] = self._behind(self.fail[parent], byte)
            mine = ((own[node], depth[node]),) if own[node] >= 0 else ()
            ends[node] = mine + ends[self.fail[node]]
        self.node_table = Transitions(len(self.nodes) + KEPT_ARCS // 2)
        self.node_table.put(*(np.fromiter(x, np.int64, len(self.nodes)) for x in (self.nodes.keys(), self.nodes.values())))
        self.ends_of = np.fromiter(map(len, ends), np.int64, len(own))
        self.ends_at = np.cumsum(self.ends_of) - self.ends_of
        flat = [x for each in ends for x in each]
        self.end_token, self.end_size = (np.fromiter((x[k] for x in flat), np.int32, len(flat)) for k in (0, 1))

    def _behind(self, node: int, byte: int) -> int:
        """The node of the longest end of what was read, the byte included, that begins a token."""
        while True:
            found = self.nodes.get(node << 8 | byte)
            if found is not None or not node:
                return found or 0
            node = self.fail[node]

    def encode_word(self, word: bytes) -> list[int]:
        """One pre-split word: of the tokens that end at each byte, the one that continues the accepted path."""
        wide, arcs, arc = len(self.labels), self.arcs, self.arc
        last, node, at = [-1], 0, 0  # of each prefix: the last token of its path
        for byte in word:
            node = self._behind(node, byte)
            at += 1
            where = slice(self.ends_at[node], self.ends_at[node] + self.ends_of[node])
            for token, size in zip(self.end_token[where].tolist(), self.end_size[where].tolist(), strict=True):
                if size == at:
                    break
                state = last[at - size]
                open_ = arcs.get(state * wide + token)
                if open_ or (open_ is None and arc(state, token)):
                    break
            else:
                raise ValueError(f"no token ends at byte {at} of {word!r}")
            last.append(token)
        ids, labels = [], self.labels
        while at:
            ids.append(last[at])
            at -= len(labels[last[at]])
        return ids[::-1]

    def _nodes(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The byte table's next nodes."""
        keys = node << 8 | byte
        found = self.node_table.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            values = np.array([self._behind(k >> 8, k & 255) for k in new.tolist()])
            self.node_table.put(new, values)
            found[found < 0] = values[np.searchsorted(new, keys[found < 0])]
        return found.astype(np.int64)

    def _open(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The transition table's arcs."""
        keys = state * len(self.labels) + token
        found = self.arc_table.get(keys)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            values = np.array([self._live(k % len(self.labels)) and self._expand(k // len(self.labels), k % len(self.labels), self.merged) for k in new.tolist()], np.int64)
            self.arc_table.put(new, values)
            found[found < 0] = values[np.searchsorted(new, keys[found < 0])]
        return found > 0

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (bytes, and where each begins and ends): all ids, and where each word's begin and end."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[order[min(FEW, len(order)) - 1]]) if len(order) else 0
        alone = order[: int((sizes[order] > longest).sum())]
        order = order[len(alone) :]
        begin, n = offsets[order], len(order)
        under_way = n - np.searchsorted(sizes[order][::-1], np.arange(longest), "right")  # words longer than each place
        last = np.full((longest + 1) * n, -1, np.int32)
        node = np.zeros(n, np.int64)
        for at in range(longest):
            many = int(under_way[at])
            node = self._nodes(node[:many], data[begin[:many] + at].astype(np.int64))
            which, nth = np.arange(many), 0
            while len(which):
                here = node[which]
                if (self.ends_of[here] <= nth).any():
                    raise ValueError("a byte that no token has")
                where = self.ends_at[here] + nth
                token, size = self.end_token[where].astype(np.int64), self.end_size[where]
                state = last[(at + 1 - size) * n + which]
                taken = size == at + 1
                ask = np.flatnonzero(~taken)
                taken[ask] = self._open(state[ask].astype(np.int64), token[ask])
                last[(at + 1) * n + which[taken]] = token[taken]
                which, nth = which[~taken], nth + 1
        # back from each word's end along its path
        place, which, found = sizes[order].copy(), np.flatnonzero(sizes[order] > 0), []
        counts = np.zeros(len(sizes), np.int64)
        while len(which):
            token = last[place[which] * n + which]
            found.append((which, token))
            counts[order[which]] += 1
            place[which] -= self.sizes[token]
            which = which[place[which] > 0]
        apart = {int(i): self.encode_word(data[offsets[i] : offsets[i + 1]].tobytes()) for i in alone}
        for i, ids in apart.items():
            counts[i] = len(ids)
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], np.int32)
        for step, (which, token) in enumerate(found):
            out[ends[order[which] + 1] - 1 - step] = token
        for i, ids in apart.items():
            out[ends[i] : ends[i + 1]] = ids
        return out, ends

    def pieces(self, text: str) -> list[str]:
        """The text's special tokens and what is between them; long parts are cut in front of a space between two letters."""
        out = []
        for part in self.parts.split(text) if self.parts and any(x in text for x in self.special) else [text]:
            i = 0
            while len(part) - i > TOGETHER:
                cut = next((m.start() + 1 for m in INSIDE.finditer(part, i + TOGETHER // 2)), len(part))
                out.append(part[i:cut])
                i = cut
            out.append(part[i:])
        return [x for x in out if x]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, memoryview, memoryview]]:
        """For the texts in order, each in one or more parts: its number, ids, the ids in decimal with a comma behind each,
        and the labels of the ids' arcs. Empty texts have no part."""
        held, size = [], 0
        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                if held and size + len(piece) > TOGETHER:
                    yield from self._together(held)
                    held, size = [], 0
                held.append((i, piece))
                size += len(piece)
        if held:
            yield from self._together(held)

    def _together(self, pieces: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, memoryview, memoryview]]:
        joined = "".join([x for _, x in pieces])
        cut = np.cumsum([0, *[len(x) for _, x in pieces]])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = word_starts(points, cut)
        special = {x for x in self.special if any(piece == x for _, piece in pieces)}
        for k, (_, piece) in enumerate(pieces):
            if special and piece in special:  # a word of its own, which no other word can equal
                starts = starts[(starts <= cut[k]) | (starts >= cut[k + 1])]
        edges = np.searchsorted(starts, cut)
        if not joined.isascii():
            width = np.ones(len(points) + 1, np.int64)
            width[:-1] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            starts = (np.cumsum(width) - width)[starts]
        data = joined.encode()
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        _, where, held = words.dictionary.buffers()
        where = np.frombuffer(where, np.int64, len(words.dictionary) + 1)
        ids, ends = self.encode_words(np.frombuffer(held, np.uint8), where)
        for x in special:
            i = pc.index(words.dictionary, pa.scalar(x.encode(), pa.large_binary())).as_py()
            ids = np.concatenate([ids[: ends[i]], [self.special[x]], ids[ends[i + 1] :]]).astype(np.int32)
            ends = ends + np.where(np.arange(len(ends)) > i, 1 - (ends[i + 1] - ends[i]), 0)
        taken = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids)).take(words.indices)
        ids, ends = taken.values, taken.offsets.to_numpy()[edges]
        columns = [(ids.to_numpy(), ends)]
        for column in (self.shown.take(ids), self.label_column.take(ids)):
            _, where, data = column.buffers()
            columns.append((memoryview(data or b""), np.frombuffer(where, np.int64, len(column) + 1)[ends]))
        for k, (i, _) in enumerate(pieces):
            yield i, *[data[int(at[k]) : int(at[k + 1])] for data, at in columns]

    def encode(self, text: str) -> tuple[int, str]:
        """How many ids the text has, and the ids in decimal with commas."""
        parts = list(self.encode_all([text]))
        return sum(len(ids) for _, ids, _, _ in parts), b"".join([shown for _, _, shown, _ in parts]).decode().removesuffix(",")

    def decode(self, ids: Iterable[int]) -> str:
        """The arc labels one after the other; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """Compiled once in each worker; its size is the vocabulary's."""
    if path not in _loaded:
        _loaded[path] = Automaton.load(path)
    return _loaded[path]


FIELDS = {"doc_id": (pa.int64(), "long"), "source": (pa.string(), "string"), "ids": (pa.list_(pa.int32()), "array<int>"), "n_tokens": (pa.int64(), "long"), "decoded": (pa.string(), "string"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}


class Total:
    """What the parts of one text add up to."""

    def __init__(self, columns: tuple[str, ...]):
        self.n_tokens, self.all_ids, self.labels = 0, [], []
        self.ids_sha, self.decoded_sha = hashlib.sha256(), hashlib.sha256()
        self.whole, self.text = "ids" in columns, "decoded" in columns

    def add(self, ids: np.ndarray, shown: memoryview, labels: memoryview) -> None:
        if len(ids):
            self.ids_sha.update(b"," if self.n_tokens else b"")
            self.ids_sha.update(shown[:-1])
            self.decoded_sha.update(bytes(labels).decode("utf-8", "replace").encode())  # words are whole characters
            self.n_tokens += len(ids)
            if self.whole:
                self.all_ids.append(ids)
            if self.text:
                self.labels.append(bytes(labels))

    ids = property(lambda self: np.concatenate(self.all_ids) if self.all_ids else [])
    decoded = property(lambda self: b"".join(self.labels).decode("utf-8", "replace"))
    ids_sha256 = property(lambda self: self.ids_sha.hexdigest())
    decoded_sha256 = property(lambda self: self.decoded_sha.hexdigest())


def tokenized(docs: DataFrame, path: str, *columns: str) -> DataFrame:
    """Of each row of docs the named columns of FIELDS (source only where docs have it)."""
    schema = pa.schema([(c, FIELDS[c][0]) for c in columns])
    read = [c for c in columns if c in ("doc_id", "source")]

    def make(batch: pa.RecordBatch) -> dict:
        auto, texts = automaton(path), [x or "" for x in batch["text"].to_pylist()]
        totals = [Total(columns) for _ in texts]
        for i, *part in auto.encode_all(texts):
            totals[i].add(*part)
        return {c: batch[c] if c in read else [getattr(x, c) for x in totals] for c in columns}

    return common.own_columns(docs, [*read, "text"]).mapInArrow(common.per_batch(schema, make, SLICE), ", ".join(f"{c} {FIELDS[c][1]}" for c in columns))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens and decoded of each document.

    A null or empty text has no ids and decodes to the empty string; repeated rows each get their row; a long text is encoded
    in parts of TOGETHER characters or so; of the columns only doc_id and text are read.
    """
    return tokenized(docs, path, "doc_id", "ids", "n_tokens", "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The same documents, with SHA-256 digests in place of ids and decoded text. Same defined cases as encode."""
    return tokenized(docs, path, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, source, ids, n_tokens, ids_sha256 and decoded_sha256. Same defined cases as encode; docs need source."""
    return tokenized(docs, path, "doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")
