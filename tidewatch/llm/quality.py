"""Quality rules on tokenizer fertility: how a public vocabulary cuts a text tells prose from junk.

Prose takes few tokens for its characters, falls back to parts of characters seldom and spreads its tokens widely; strings of
symbols, tables and machine text do not. The bands are per script, as a vocabulary serves scripts unequally.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from . import common
from .bpe import SPLIT, word_starts

#: Per script (by most letters): characters a token at least and at most, share of tokens that are parts of a character at
#: most, bits of token entropy (of order two, so that a separator between all cells shows) at least. Set on labelled rows:
#: no labelled good Latin text that passes the base rules has under 2.12 characters a token or under 4.8 bits.
BANDS = {"latin": (2.1, 8.0, 0.25, 4.6), "greek_cyrillic": (0.9, 8.0, 0.6, 3.6), "cjk": (0.3, 4.0, 0.95, 3.6), "other": (0.3, 8.0, 0.95, 3.0)}

#: First code points of runs of letters, and the script of each run.
RUNS = [(0x41, "latin"), (0x370, "greek_cyrillic"), (0x530, "other"), (0x1E00, "latin"), (0x1F00, "greek_cyrillic"), (0x2000, "none"), (0x2E80, "cjk"), (0xA4D0, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x1F000, "none"), (0x20000, "cjk")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A short text can't reach a band's entropy; so much of what its number of tokens allows will do.
SHORT = 0.85
NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")
LETTERS = re.compile(r"[^\W\d_]+")

RULES = pa.schema([("doc_id", pa.int64())] + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("script", pa.string())] + [(x, pa.float64()) for x in ("chars_per_token", "fallback_share", "token_entropy")])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, fallback_share double, token_entropy double"

_loaded: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def vocabulary(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and which ids are not whole characters by themselves. Loaded once in each worker."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        part = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            part[i] = token.decode("utf-8", "ignore").encode() != token
        _loaded[path] = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), part
    return _loaded[path]


def pieces(text: str, most: int = 1 << 16) -> Iterator[str]:
    """The text in parts of about most characters, cut where the split pattern begins a word, so that no token is."""
    if len(text) <= most:
        yield text
        return
    starts = np.append(word_starts(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)])), len(text))
    i = 0
    while i < len(text):
        j = int(starts[max(np.searchsorted(starts, i + most, "right") - 1, np.searchsorted(starts, i, "right"))])
        yield text[i:j]
        i = j


def fertility(text: str, path: str) -> tuple[float, float, float, int]:
    """Characters a token, share of tokens that are parts of a character, bits of token entropy of order two, tokens."""
    encoding, part = vocabulary(path)
    ids = np.array([i for x in pieces(text) for i in encoding.encode_ordinary(x)], np.int64)
    if not len(ids):
        return 0.0, 0.0, 0.0, 0
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    return len(text) / len(ids), float(part[ids].mean()), float(-np.log2((counts * counts).sum())), len(ids)


def script(text: str) -> str:
    """The script that most letters are in; other where there is no letter."""
    letters = "".join(LETTERS.findall(text))
    if letters.isascii():
        return "latin" if letters else "other"
    at = np.searchsorted([x for x, _ in RUNS], np.frombuffer(letters.encode("utf-32-le"), np.uint32), side="right") - 1
    counts = {}
    for (_, name), n in zip(RUNS, np.bincount(at[at >= 0], minlength=len(RUNS)), strict=True):
        counts[name] = counts.get(name, 0) + int(n)
    counts.pop("none", None)
    return max(counts, key=counts.get) if any(counts.values()) else "other"


def repeated(words: list[str], width: int = 8) -> int:
    """Words in windows that the text has twice or more, the first included."""
    if len(words) <= width:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n = len(ids) - width + 1
    known = np.unique(ids[:n], return_inverse=True)[1]
    for k in range(1, width):  # windows one word longer, numbered anew: equal numbers are equal windows
        known = np.unique(known * (len(seen) + 1) + ids[k : k + n], return_inverse=True)[1]
    twice = np.bincount(known)[known] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str, path: str, bands: dict | None = None) -> dict:
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(NOT_SYMBOL.sub("", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated(words)}
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    out["script"] = script(text)
    out["chars_per_token"], out["fallback_share"], out["token_entropy"], n = fertility(text, path)
    least, most, parts, bits = (bands or BANDS)[out["script"]]
    out["kept"] = not out["base_failed"] and least <= out["chars_per_token"] <= most and out["fallback_share"] <= parts and out["token_entropy"] >= min(bits, SHORT * np.log2(max(1, n)))
    out["kept"] = bool(out["kept"])
    return out


def rules(docs: DataFrame, path: str, bands: dict | None = None) -> DataFrame:
    """One row per row of docs: the base counts, the fertility measures and the verdict.

    A null or empty text has no words, so it fails the base rules; repeated rows each get their row; a very long text counts
    whole, in parts that cut no token; of the columns only doc_id and text are read. ``path`` is a rank file of a byte-level vocabulary.
    """

    def make(batch: pa.RecordBatch) -> dict:
        found = [judge(x or "", path, bands) for x in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"]} | {f.name: [x[f.name] for x in found] for f in RULES if f.name != "doc_id"}

    return common.own_columns(docs, ["doc_id", "text"]).mapInArrow(common.per_batch(RULES, make), DDL)
