"""Each operator against a brute-force version on small tables, with the cases that every operator must stand."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import bpe, components, html, language, mixing, multiset, neardup, quality, queries, repeats, simhash, suffixes, urls, warc
from tidewatch.llm.queries import URL_RULES, vocabulary

BPE = vocabulary("byte_bpe_50k.json")
RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")
DDL = "doc_id long, text string, lang string, source string, n_chars long, k1 string, fp string, code int, position string, ids string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, words=40):
    r = random.Random(seed)
    syllables = "tha ren ti on er ing est ous ly and of um".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


PASSAGE = prose(99, 120)
LONG = prose(5, 30_000)


def texts():
    return [None, "", " \n\t ", "one", "123 ###", prose(1, 60), prose(1, 60), prose(1, 59) + " changed", prose(2, 50) + "\n" + PASSAGE + "\n" + prose(3, 30), "é" * 50 + PASSAGE + " 日本語 🙂", LONG, "ab" * 900, prose(7, 30).upper(), "\x00 nul \r\n<|endoftext|> it's"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with the operators' own names."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", 1, "z", "w") for i, t in enumerate(texts())]
    rows += [rows[5], rows[5], (5, "another text with the same id", "de", "s1", None, None, None, None, None, None), (None, prose(4, 30), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# suffix arrays and repeated strings


def test_suffix_arrays_of_random_strings():
    r = random.Random(1)
    for _ in range(3000):
        x = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 20))]
        array = suffixes.suffix_array(np.array(x, np.int64))
        assert array == sorted(range(len(x)), key=lambda i: x[i:])
        for i, n in enumerate(suffixes.common_prefixes(x, array)):
            if i:
                a, b = x[array[i - 1] :], x[array[i] :]
                assert n == next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def brute_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        left = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        edges = np.flatnonzero(np.diff(gone.astype(int)))  # where runs begin and end
        fragments = [b[i:j] for i, j in zip([0, *edges[1::2]], [*edges[::2], len(b)], strict=True)]
        out.append((d, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(left).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in fragments)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "part"), [(400, 1 << 19), (60, 64), (17, 7)])
def test_repeats(docs, length, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    small = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 20_000)
    assert sorted(map(tuple, repeats.report(small, length).collect()), key=repr) == brute_repeats(pairs(small), length)


@pytest.mark.parametrize("hot", [512, 3])
def test_repeats_of_partial_overlaps(spark, monkeypatch, hot):
    """Windows shared with one text on the left and another on the right; and groups with many contexts, which are halved."""
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(3)
    core = prose(50, 40)
    rows = [(i, prose(100 + i % 4, r.randint(0, 12)) + core[r.randint(0, 40) : 200 + r.randint(0, 40)] + prose(200 + i % 3, r.randint(0, 12))) for i in range(40)]
    got = repeats.report(spark.createDataFrame(rows, "doc_id long, text string"), 90).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 90)


@pytest.mark.parametrize("hot", [512, 2])
def test_repeats_of_texts_that_repeat_themselves(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PART", 100)
    texts_ = ["a" * 700, "b" * 59, "b" * 60, "c" * 61, "ab" * 200, "x" + "ab" * 40 + "y", "abc\n" * 90, "é" * 45, "è" * 45, "d" * 61 + prose(1, 9), prose(1, 30), "日本語" * 30 + "z"]
    rows = list(enumerate(texts_))
    got = repeats.report(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows, 60)


def test_anchors_of_a_uniform_text_are_few():
    found = list(repeats.anchors(b"a" * 3_000_000, 400))
    assert sum(len(x[0]) for x in found) < 30 and sum(int(x[6].sum()) for x in found) >= 3_000_000 - 400


def test_cleaned_keeps_columns_and_whole_characters(docs, none):
    got = repeats.cleaned(docs, 400)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert PASSAGE not in rows[8]["text"] and rows[8]["text"].startswith(prose(2, 50)) and rows[8]["n_chars"] == len(rows[8]["text"])
    assert rows[10]["text"] == LONG and rows[0]["text"] is None and 11 not in rows
    assert rows[9]["text"].endswith("日本語 🙂")
    assert repeats.cleaned(none, 400).count() == 0 and repeats.report(none).count() == 0


# fingerprints


def test_multiset_hash_is_homomorphic():
    a, b, c = (prose(i, 20).encode() for i in range(3))
    whole = multiset.vectors([b"\n".join([a, b, c, b])])[0]
    assert (whole == multiset.vectors([b"\n".join([b, c, b, a])])[0]).all()
    total = np.zeros_like(whole)
    for p in (a, b, c, b, b):
        multiset.add(total, p)
    assert (total != whole).any()
    multiset.add(total, b, -1)
    assert (total == whole).all() and (multiset.read(multiset.shown(total[None])[0]) == whole).all()


def test_compare(docs, none):
    rows = pairs(docs)
    key = {(d, t): n for d, t, n in ((r[0], r[1], r[2]) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect())}
    ordered = [(d, t or "") for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, key[x]))]
    want = []
    for i, (d, t) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        n = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    got = multiset.compare(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want) and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    equal = {}
    for r in multiset.fingerprints(docs).collect():
        equal.setdefault(r["fingerprint"], set()).add(r["doc_id"])
    assert {0, 1, 2} in equal.values() and any({5, 6} <= x for x in equal.values())
    assert multiset.compare(none).count() == multiset.fingerprints(none).count() == 0
    likeness = {r["doc_id"]: r["near_edited"] for r in got}
    assert 0.3 < likeness[10] < 0.7


def test_likeness_of_texts_that_repeat_themselves():
    """The cosine of the lanes against sums in whole numbers, however often a triple is there."""
    texts_ = [b"a b c\n" * 40_000, b"a b c\n" * 20_000 + b"x y z w\n" * 15_000, prose(1, 200).encode(), prose(1, 199).encode(), b"", b"a b c\n" * 400]
    found = multiset.vectors(texts_)
    for i, j in combinations(range(len(texts_)), 2):
        lanes = []
        for text in (texts_[i], texts_[j]):
            sums = [0] * multiset.LIKE
            for paragraph in multiset.paragraphs(text):
                lane, sign, _ = multiset.triples([paragraph])
                for x, y in zip(lane.tolist(), sign.tolist(), strict=True):
                    sums[x] += int(y)
            lanes.append(sums)
        dot, norm = sum(x * y for x, y in zip(*lanes, strict=True)), np.sqrt(float(sum(x * x for x in lanes[0])) * sum(x * x for x in lanes[1]))
        assert np.isclose(multiset.likeness(found[i : i + 1], found[j : j + 1])[0], max(0, dot / norm) if norm else 0.0)
    assert multiset.likeness(found[:1], found[1:2])[0] > 0.5 and multiset.likeness(found[:1], found[5:6])[0] > 0.99


def test_slots_deal_ranges_out_one_by_one(spark):
    rows = spark.createDataFrame([(x,) for x in multiset.slots(spark, 37)], "slot int").repartition(37, "slot")
    assert rows.select(F.spark_partition_id()).distinct().count() == 37


# mixing


def test_shares_that_add_up_to_too_much_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(Exception, match="slots"):
        mixing.mixed(docs, spark.createDataFrame([("a", 20_000)], "source string, share long")).collect()


def test_mixture_deviates_by_less_than_a_block(spark):
    shares = {"a": 5, "b": 3, "c": 1, None: 2}
    rows = [(i, s) for i, s in enumerate(["a"] * 200 + ["b"] * 90 + ["c"] * 45 + [None] * 33)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mixed(docs, spark.createDataFrame(list(shares.items()), "source string, share long")).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, len(rows) + 1)) and sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    active, used, total = dict(shares), Counter(), Counter(s for _, s in rows)
    for t, r in enumerate(got, 1):
        used[r["source"]] += 1
        if t < 33 // 2 * 11:  # while all sources last
            for s, w in active.items():
                assert abs(used[s] - w * t / 11) < 1
    assert used == total


@pytest.mark.parametrize("block_rows", [1, 4])
def test_every_row_is_mixed_once(docs, none, spark, block_rows):
    shares = mixing.tempered(docs.groupBy("source").agg(F.count("*").alias("n")), frame=10)
    got = mixing.mixed(docs, shares, block_rows).collect()
    assert sorted(r["position"] for r in got) == list(range(1, docs.count() + 1))
    arranged = mixing.arranged(docs, shares, block_rows)
    assert arranged.columns == docs.columns and sorted(map(repr, arranged.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mixed(none, shares).count() == mixing.arranged(none, shares).count() == 0


def test_a_schedule_meets_release_times_and_deadlines(spark):
    shares = [("a", 7), ("b", 4), ("c", 4), ("d", 1)]
    df = spark.createDataFrame([(shares, 16)], "shares array<struct<source:string,share:long>>, frame long")
    slots = df.select(mixing.schedule(F.col("shares"), F.col("frame"))).first()[0]
    for t, at in enumerate(slots):
        w = dict(shares)[at["source"]]
        assert (at["j"] - 1) * 16 // w <= t < -(-at["j"] * 16 // w)


# quality rules


def brute_quality(t):
    words = WORD.findall(t or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none, spark):
    more = ["a b c d e f g h " * 4, "same line\nother\nsame line\n\n\n", "x*** y&&& z||| " * 30, prose(8, 25) + "\n" + prose(8, 25)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = quality.rules(both, RANKS).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got), key=repr) == sorted(((d, *brute_quality(t)) for d, t in pairs(both)), key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.rules(none, RANKS).count() == 0


def test_fertility_by_hand(docs):
    """Measures and verdict from the vocabulary's tokens, counted one by one."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    byte_of = {i: token for token, i in ranks.items()}
    seen = set()
    for r in quality.rules(docs, RANKS).collect():
        for t in [x or "" for d, x in pairs(docs) if d == r["doc_id"]]:
            ids = encoding.encode_ordinary(t)
            n, counts = len(ids), Counter(ids)
            whole = lambda x: x.decode("utf-8", "ignore").encode() == x
            want = (len(t) / n, sum(not whole(byte_of[i]) for i in ids) / n, -np.log2(sum((c / n) ** 2 for c in counts.values()))) if n else (0, 0, 0)
            least, most, parts, bits = quality.BANDS[r["script"]]
            if np.allclose(want, (r["chars_per_token"], r["fallback_share"], r["token_entropy"])):
                seen.add(r["doc_id"])
                good = n > 0 and least <= want[0] <= most and want[1] <= parts and want[2] >= min(bits, quality.SHORT * np.log2(n))
                assert r["kept"] == (good and not r["base_failed"])
    assert seen == {d for d, _ in pairs(docs)}


def test_long_texts_are_cut_between_words():
    text = "it's 12 words,  and\n\nsome  more é日本 " * 60 + "x" * 500 + " end"
    whole = quality.vocabulary(RANKS)[0].encode_ordinary(text)
    for most in (1, 7, 64, 300):
        parts = list(quality.pieces(text, most))
        assert "".join(parts) == text and [i for x in parts for i in quality.vocabulary(RANKS)[0].encode_ordinary(x)] == whole


def test_prose_is_kept_and_symbols_are_not():
    junk = " ".join(w + random.Random(i).choice(["***", "###", "$$$", "%%%"]) for i, w in enumerate(prose(3, 80).split()))
    assert quality.judge("the quick brown fox jumps over the lazy dog while seven bright stars shine above a quiet town near old hills", RANKS)["kept"]
    assert not quality.judge(junk, RANKS)["kept"]
    assert quality.script("абв где") == "greek_cyrillic" and quality.script("日本語") == "cjk" and quality.script("éa") == "latin" and quality.script("12") == "other"


# urls


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rules = [*URL_RULES, ("a.example.org", "/", "block"), ("example.org", "", "allow"), ("net", "/x", "block"), ("net", "/x/y", "allow")]
    r = random.Random(4)
    hosts = ["org", "example.org", "A.Example.ORG", "b.a.example.org", "notexample.org", "example.com", "net", "x.net", "", "a..org", ".org", "exa mple.org", "nul\x00.org"]
    paths = ["", "/", "/es/1", "/en/12?q=/es/", "/fr/#x", "/de/", "/x", "/x/yz", "/EN/1", "?/es/", "#"]
    urls_ = [None, "", "no scheme", "http:/x", "a://b://c/d", "http://\nexample.org/es/"] + [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i // 2, u, "h", "p") for i, u in enumerate(urls_)], "page_id long, url string, host string, path string")
    got = urls.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i // 2, *brute_url(u, rules)) for i, u in enumerate(urls_)), key=repr)
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judged(pages.limit(0), empty).count() == 0 and {x["verdict"] for x in urls.judged(pages, empty).collect()} == {"allow"}


def test_equal_rules_and_very_long_urls(spark):
    rules = spark.createDataFrame([("org", "/a", "block"), ("org", "/a", "allow"), (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    long = "http://" + "x." * 2000 + "org/a" + "b" * 100_000
    got = urls.judged(spark.createDataFrame([(1, long), (2, "http://org/b")], "page_id long, url string"), rules).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"], len(r["path"])) for r in got} == {1: ("org/a", "allow", 100_002), 2: (None, "allow", 2)}


# byte-pair encoding


def test_bpe_equals_the_library(docs, none, spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(BPE)
    want = []
    for d, x in pairs(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, BPE).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(none, BPE).count() == bpe.encode(none, BPE).count() == bpe.encoded(none, BPE).count() == 0
    assert all(r["decoded"] == (x or "") for r, x in zip(bpe.encode(docs.select("doc_id", "text").coalesce(1), BPE).collect(), [x for _, x in pairs(docs.coalesce(1))], strict=True))


def test_the_automaton_on_random_bytes(monkeypatch):
    """Texts encoded together (words by columns), one by one (each word by itself) and in parts."""
    tokenizers = pytest.importorskip("tokenizers")
    t, auto, r = tokenizers.Tokenizer.from_file(BPE), bpe.Automaton.load(BPE), random.Random(2)
    letters = "aabcdehiorstn  \n.,'$$=-éß日🙂\u0301\x00\u00a0\r\t٣"
    texts_ = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["".join(r.choice("日本語é") for _ in range(300)) for _ in range(30)]
    texts_ += ["'s", " 's", "it's", "'sound", "x'll'd", "?'s", "''s", "'", "a'", "'\ns", "don't'", "'re've", "<|endoftext|>'s<|endoftext|>", " <|endoftext|> ", "<|endoftext", "  ", "a  ", "\n\nb", "ab " * 3000]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts_]
    for size in (1 << 22, 64):
        monkeypatch.setattr(bpe, "TOGETHER", size)
        totals = [bpe.Total(("ids", "decoded")) for _ in texts_]
        for i, *part in auto.encode_all(texts_):
            totals[i].add(*part)
        assert [list(x.ids) for x in totals] == want and [x.decoded for x in totals] == texts_ == [t.decode(x, skip_special_tokens=False) for x in want]
    for x, ids in zip(texts_[:300] + texts_[-30:], want[:300] + want[-30:], strict=True):
        assert auto.encode(x) == (len(ids), ",".join(map(str, ids))) and auto.decode(ids) == x


def test_long_words_of_the_automaton():
    tokenizers = pytest.importorskip("tokenizers")
    t, auto = tokenizers.Tokenizer.from_file(BPE), bpe.Automaton.load(BPE)
    for x in ("ab" * 20_000, "=" * 5_000, "xyz" * 3_000 + " " + "é" * 3_000):
        assert auto.encode(x)[1] == ",".join(map(str, t.encode(x, add_special_tokens=False).ids))


def test_transitions():
    r = np.random.default_rng(1)
    known, held = bpe.Transitions(1000), {}
    for _ in range(20):
        keys = np.unique(r.integers(0, 1 << 40, 40))
        keys = keys[known.get(keys) < 0]
        known.put(keys, keys % 1000)
        held |= dict.fromkeys(keys.tolist())
    found = known.get(np.array(list(held)))
    assert known.n == len(held) and (found == np.array(list(held)) % 1000).all() and (known.get(np.arange(50)) == -1).all()
    known.put(np.arange(1 << 41, (1 << 41) + 900), np.arange(900))
    assert known.n == 900 and (known.get(np.array(list(held))) == -1).all()


def test_a_small_automaton_accepts_only_what_merges_make():
    labels = [b"a", b"b", b"ab", b"aa", b"aab", b"bab"]
    merges = [(0, 1, 2), (0, 0, 3), (3, 1, 4), (1, 2, 5)]
    auto = bpe.Automaton(labels, merges, {})

    def merged(word):
        ids = [labels.index(bytes([c])) for c in word]
        for a, b, c in merges:
            i = 0
            while i < len(ids) - 1:
                if ids[i : i + 2] == [a, b]:
                    ids[i : i + 2] = [c]
                i += 1
        return ids

    for n in range(1, 9):
        for x in range(1 << n):
            word = bytes(97 + (x >> i & 1) for i in range(n))
            assert auto.encode_word(word) == merged(word)


# language


def samples():
    vocab = {"en": "the and of to in that with for was this from they have are".split(), "de": "der die und das nicht mit von ist ein auch sich für über wir".split(), "es": "el los que y en de para una por con está niño también más".split()}
    r = random.Random(6)
    return [(i, " ".join(r.choice(vocab[lang]) for _ in range(r.randint(5, 60))), lang) for i in range(600) for lang in [("en", "de", "es")[i % 3]]]


def test_languages(spark, docs, none):
    rows = samples()
    model = language.train([(t, lang) for i, t, lang in rows if i % 5])
    got, score = model.predict([t.encode() for i, t, _ in rows if i % 5 == 0])
    truth = [lang for i, _, lang in rows if i % 5 == 0]
    assert np.mean([a == b for a, b in zip(got, truth, strict=True)]) > 0.97 and all(0 <= s <= 1 for s in score)
    found = {r["doc_id"]: r for r in language.identify(docs.withColumn("score", F.lit("old")), model).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2, 4)) and found[10]["lang_pred"] in model.labels
    assert language.identify(none, model).count() == 0 and language.identify(docs, model).count() == docs.count()
    assert language.identify(docs, model).columns == [*docs.columns, "lang_pred", "score"]
    empty = language.train([])
    assert empty.predict([b"abc", b""])[0] == ["und", "und"]


def test_code_switched_words_are_labelled():
    model = language.train([(t, lang) for _, t, lang in samples()])
    words = language.Words([b"the and of to in that with der die und das nicht mit von"])
    p, _ = model.marginals(model.emissions(words)[None], np.ones((1, len(words.start)), bool))
    assert [model.labels[i] for i in p[0].argmax(1)] == ["en"] * 7 + ["de"] * 7


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(3)
    model = language.Model(["a", "b", "c"])
    model.move = r.normal(size=(3, 3)).astype(np.float32)
    scores = r.normal(size=(1, 4, 3)).astype(np.float32)
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(scores[0, i, x] for i, x in enumerate(path)) + sum(model.move[x, y] for x, y in zip(path, path[1:], strict=False)))
        for i, x in enumerate(path):
            want[i, x] += w
    mask = np.ones((1, 4), bool)
    assert np.allclose(model.marginals(scores, mask)[0][0], want / want.sum(1, keepdims=True), atol=1e-4)
    alone = np.full((1, 3), -1, np.float32), np.ones((1, 3), np.float32)
    assert np.allclose(model.marginals_only(scores.copy(), mask, *alone)[0], want / want.sum(1, keepdims=True), atol=1e-4)


def test_messages_carry_a_chain_over_blocks(monkeypatch):
    model = language.train([(t, lang) for _, t, lang in samples()])
    r = random.Random(2)
    vocab = [w for _, t, _ in samples()[:9] for w in t.split()] + ["xu", "qe", "i"]
    texts_ = [" ".join(r.choice(vocab) for _ in range(n)).encode() for n in (1, 6, 7, 8, 14, 15, 40, 100)] + [b"", b"1 2"]
    whole = []
    for size in (1000, 7):
        monkeypatch.setattr(language, "CHAIN", size)
        whole.append(model.predict(texts_))
    assert whole[0][0] == whole[1][0] and np.allclose(whole[0][1], whole[1][1], atol=1e-4)
    long = model.predict([" ".join(r.choice(vocab) for _ in range(200_000)).encode()])
    assert long[0][0] in model.labels


def test_held_out_documents_of_the_test_data(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = queries.op7_crf_language(spark, data).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(found) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.97


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGS", 2)
    with pytest.raises(ValueError):
        language.sample(spark.createDataFrame(samples(), "doc_id long, text string, lang string"))


def test_the_sample_holds_no_held_out_rows(spark):
    df = spark.createDataFrame(samples(), "doc_id long, text string, lang string")
    held = {r["text"] for r in df.filter(language.fold(F.col("doc_id")) == 0).collect()}
    picked = language.sample(df)
    assert picked and not held & {t for t, _ in picked}
    assert language.sample(df.limit(0)) == []


# archives


def test_archives(spark, tmp_path):
    big = "<p>" + prose(1, 60) + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, "http://a/2\r\nX: y", "short"), (4, None, None), (5, "", "short"), (6, "http://é/", big + "é🙂"), (7, "http://b", "x" * 99), (8, "http://c", "x" * 99), (1, "http://a/1", big), (None, "http://n", big)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, type string")
    path = str(tmp_path / "warc")
    warc.write(pages, path)
    records = warc.read(spark, path, payloads=True)
    assert records.count() == 3 * len(rows) and records.filter("type = 'response'").count() == 8
    assert {bytes(r["payload"]) for r in records.filter("type = 'response'").collect()} == {(h or "").encode() for _, _, h in rows}
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = len(b) >= 100 and i != first
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    got = warc.captures(warc.assemble(records)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    nested = warc.assemble(records).filter("main.uri = 'http://é/'").first()
    assert nested["request"]["head"].startswith("GET http://é/ HTTP/1.1") and nested["metadata"]["head"] == "pageId: 6\r\n"
    empty = str(tmp_path / "none")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0 and warc.captures(warc.assemble(warc.read(spark, empty))).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse([b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"], False))


def test_archives_in_any_chunks(spark, tmp_path):
    """Blocks that hold separators, or end in half of one; in chunks of any size, packed by the record or not at all."""
    import gzip

    blocks = [b"", b"abc\r\n", b"\r\n\r\n", b"x\r\n\r\nWARC/1.1\r\n", b"\xff\xfe\x00" * 50, b"y" * 300_000]
    records = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n%s\r\n\r\n" % (i, len(b) + 19, b) for i, b in enumerate(blocks)]
    data = b"".join(records)
    for size in (1, 3, 1000, len(data)):
        got = list(warc.parse((data[i : i + size] for i in range(0, len(data), size)), True))
        assert [x[-1] for x in got] == blocks
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(data))
    got = warc.read(spark, str(tmp_path), payloads=True).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted(blocks * 3)
    with pytest.raises(ValueError):
        list(warc.parse([data[:-100]], False))


# near-duplicates


def brute_simhash(t, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(simhash.UPPER))
    found = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_groups(docs, none):
    rows = pairs(docs)
    prints = [brute_simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = [(d, simhash.signed(p), least.get(top(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))]
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.groups(none).count() == 0


@pytest.mark.parametrize(("held", "blocks"), [(4096, simhash.TWO_GOLAY), (5, simhash.TWO_GOLAY), (4096, simhash.WITH_HAMMING)])
def test_links_connect_all_that_is_close(spark, monkeypatch, held, blocks):
    monkeypatch.setattr(simhash, "HELD", held)
    r = random.Random(8)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 12)):
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            up[top(a)] = top(b)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = simhash.links(df, 2, blocks).collect()
    assert all(bin((x["a"] ^ x["b"]) & (1 << 64) - 1).count("1") <= 4 for x in found)
    near = {x: x for x in fps}

    def root(x):
        while near[x] != x:
            x = near[x]
        return x

    for x in found:
        near[root(x["a"] % (1 << 64))] = root(x["b"] % (1 << 64))
    assert len({top(x) for x in fps}) == len({root(x) for x in fps})
    assert all((root(a) == root(b)) == (top(a) == top(b)) for a, b in combinations(sorted(fps), 2))


def test_codes_cover():
    r = random.Random(1)
    for n in (23, 15, 7):
        for _ in range(300):
            x = r.getrandbits(n)
            home = int(simhash.decode(np.array([x]), n)[0][0])
            assert (home ^ x).bit_count() <= simhash.RADIUS[n] and int(simhash.decode(np.array([home]), n)[1][0]) == 0
    x = r.getrandbits(64)
    who, anchor = simhash.widened(np.array([x], np.uint64), simhash.TWO_GOLAY, 2)
    assert sorted(anchor.tolist()) == sorted(simhash.anchors(x, simhash.TWO_GOLAY, 2)) and len(set(anchor.tolist())) == len(anchor)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {(x, top(x)) for e in edges for x in e if e[0] != e[1]}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs, none, spark):
    base = prose(20, 300).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (0, 50, 150, 299)]
    far = " ".join(w if i % 7 else "other" for i, w in enumerate(base))
    more = spark.createDataFrame([(50 + i, t, "en", "s", 1, *[None] * 5) for i, t in enumerate([" ".join(base).upper(), *near, far])], DDL)
    got = neardup.representatives(docs.union(more))
    assert got.columns == docs.columns
    ids = sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)
    assert [i for i in ids if i >= 50] == [50, 55]
    assert [i for i in ids if i < 3] == [0] and ids.count(5) == 2 and 6 not in ids and 7 not in ids and {3, 4, 8, 9, 10} <= set(ids)
    assert neardup.representatives(none).count() == 0


@pytest.mark.parametrize("told", [50_000, 0])
def test_near_copies_of_a_text_without_an_id(spark, monkeypatch, told):
    monkeypatch.setattr(neardup, "TOLD", told)
    near = prose(40, 200) + " end"
    rows = [(None, prose(40, 200)), (3, near), (-1, near), (4, prose(41, 100)), (None, "x y z"), (5, "x y z")]
    got = neardup.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)


def test_word_hashes(monkeypatch):
    texts_ = [(t or "").encode() for t in texts()] + [b"A b  a B\tab", b"x" * 300]
    for size in (1 << 19, 1, 50):
        monkeypatch.setattr(neardup, "TOGETHER", size)
        found, known = neardup.word_hashes(texts_), {}
        for text, hashes in zip(texts_, found, strict=True):
            words = simhash.WORDS.findall(text.translate(simhash.UPPER))
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes.tolist(), strict=True):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)
    assert neardup.word_hashes([]) == [] and [len(x) for x in neardup.word_hashes([b"", b" "])] == [0, 0]


def test_sketches_never_rule_a_similar_pair_out():
    r = np.random.default_rng(5)
    for n in (1, 5, 40, 300, 3000):
        base = r.integers(0, 1 << 63, n).astype(np.uint64)
        for changed in range(0, n // 3 + 1, max(1, n // 30)):
            other = np.concatenate([base[changed:], r.integers(0, 1 << 63, changed + n // 9).astype(np.uint64)])
            a, b = set(base.tolist()), set(other.tolist())
            may = neardup.may_be_similar(len(a), neardup.sketch(np.unique(base)), len(b), neardup.sketch(np.unique(other)))
            if len(a & b) >= neardup.SIMILAR * len(a | b):
                assert may
            elif n >= 40 and len(a & b) < 0.6 * len(a | b):
                assert not may


def reduced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in neardup.representatives(rows).collect())


def least_of_groups(texts):
    """By comparing all pairs."""
    sets = [set(simhash.shingles(t.lower().encode(), neardup.WIDTH)) for t in texts]
    up = simhash.Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= neardup.SIMILAR * len(a | sets[j]):
                up.join(i, j)
    return [i for i in range(len(texts)) if up.top(i) == i]


def test_near_duplicates_in_a_dense_cluster(spark):
    base, r = prose(31, 300).split(), random.Random(4)
    texts = []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(300), r.randint(4, 9)):
            words[at] = f"new{r.randrange(10**9)}"
        texts.append(" ".join(words))
    expected = least_of_groups(texts)
    assert 1 < len(expected) < 150 and reduced(spark, texts) == expected


def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch):
    """Not with its square: 90 texts have 4,005 pairs, all similar."""
    base, asked, tested = prose(33, 300).split(), [], neardup.tested

    def counted(docs, classes, pairs):
        asked.append(pairs.distinct().count())
        return tested(docs, classes, pairs)

    monkeypatch.setattr(neardup, "tested", counted)
    assert reduced(spark, [" ".join(base[: 3 * i] + [f"new{i}"] + base[3 * i + 1 :]) for i in range(90)]) == [0]
    assert sum(asked) <= 12 * 90


def test_near_pairs_of_a_turn():
    r = np.random.default_rng(8)
    s, root = np.sort(r.integers(0, 4, 200)), r.integers(0, 3, 200)
    rows = pa.table({"s": s, "chunk": s * 0, "id": np.arange(200), "n": s * 0 + 10, "place": s * 0, "root": root})
    for low, high in [(1, 4), (4, 16), (16, 64), (1, 64)]:
        want = {(i, j) for i in range(200) for j in range(i + low, min(200, i + high)) if s[i] == s[j] and root[i] != root[j]}
        for size in (1, 7, 50, 200):
            found = [p for b in neardup.near_pairs(low, high)(iter(rows.to_batches(size))) for p in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
            assert len(found) == len(want) and set(found) == want


def test_near_duplicates_of_few_distinct_words(spark):
    r, texts = random.Random(5), []
    for i in range(20):
        words = [f"w{r.randrange(60)}" for _ in range(800)]
        texts += [" ".join(words), " ".join(words + [f"new{i}x{k}" for k in range(120)])]
    assert reduced(spark, texts) == least_of_groups(texts) == list(range(0, 40, 2))


# pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li>About</li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy now</div><article><header><h1>Head &amp; line</h1></header><p>First   para\ngraph with <b>bold</b>ed text &copy; and &#233;.<p>Short.
<div class="share-buttons">Share</div><blockquote>A quote<br>in two lines</blockquote><!-- no --><form>Mail <input></form><p hidden>secret</p><p>Last one.</p></article>
<section id="comments"><p>A reader's long comment that goes on and on and says quite a lot about everything.</p></section>
<aside><p>Side</p></aside><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & line\n\nFirst para graph with bolded text © and é.\n\nShort.\n\nA quote in two lines\n\nLast one."
    titled = "<body><div><a>x</a><a>y</a></div><div><h1>Title</h1>" + "".join(f"<p>{prose(i, 30)}</p>" for i in range(3)) + "</div>"
    assert html.main_text(titled).startswith("Title\n\n" + prose(0, 30))
    plain = "<body><div id=menu><a>x</a><a>y</a></div>" + "".join(f"<p>{prose(i, 30)}</p>" for i in range(3)) + "<p>end</p><div class='footer'>f</div>"
    assert html.main_text(plain).startswith(prose(0, 30)) and "x" not in html.main_text(plain).split("\n\n")[0][:1]


def test_ratios_and_clusters_by_hand():
    r = random.Random(3)
    sizes, tags = np.array([r.choice([0, 3, 40, 400]) for _ in range(60)], float), np.array([r.randint(0, 5) for _ in range(60)])
    ratio = [s / max(1, t) for s, t in zip(sizes, tags, strict=True)]
    kernel = [np.exp(-0.5 * (d / html.SIGMA) ** 2) for d in range(-3, 4)]
    smooth = [sum(k * ratio[min(59, max(0, i + d))] for d, k in zip(range(-3, 4), kernel, strict=True)) / sum(kernel) for i in range(60)]
    assert np.allclose(html.smooth(np.array(ratio)), smooth)
    want = [s > 0 and x >= html.LEAST * sum(smooth) / 60 for s, x in zip(sizes, smooth, strict=True)]
    assert html.clusters(sizes, tags).tolist() == want


def test_recall_and_noise_over_layouts():
    """Pages of many layouts whose main text is known: words found of it, and words found that aren't of it."""
    r, right, missed, wrong = random.Random(7), 0, 0, 0
    for i in range(120):
        word = lambda: prose(r.random(), 1)
        text = ["Head " + prose(i, 4), *[prose(1000 * i + k, r.randint(3, 90)) for k in range(r.randint(2, 9))]]
        blocks = f"<h1>{text[0]}</h1>" + "".join(f"<p>{x}</p>" if r.random() < 0.8 else f"<blockquote>{x}</blockquote>" for x in text[1:])
        menu = "".join(f"<li><a href='/'>zz{word()}</a></li>" for _ in range(r.randint(3, 8)))
        menu = r.choice([f"<nav><ul>{menu}</ul></nav>", f"<ul class='menu'>{menu}</ul>", f"<ul>{menu}</ul>"])
        side = r.choice([f"<aside><p>zz{word()}</p></aside>", f"<div class='sidebar'><p>zz{word()}</p></div>", ""])
        notes = r.choice(["<section class='comments'><p>zz comment zz that is long</p></section>", "<div id='cookie-notice'>zz cookies</div>", ""])
        core = r.choice(["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<main><p></p><article>{}</article></main>"]).format(blocks)
        page = f"<html><head><title>zz</title><script>zz</script></head><body>{menu}{core}{side}{notes}<footer>zz footer</footer></body></html>"
        want, got = Counter(" ".join(text).split()), Counter(html.main_text(page).split())
        right += sum((want & got).values())
        missed += sum((want - got).values())
        wrong += sum((got - want).values())
    assert right / (right + missed) > 0.995 and wrong / (right + wrong) < 0.005


def test_unmarked_menus_of_an_article_go_and_single_links_stay():
    menu, one = "".join(f"<li><a href='/'>Link {i}</a></li>" for i in range(4)), "<p><a href='/'>One link</a></p>"
    found = html.main_text(f"<article><ul>{menu}</ul><p>{prose(1, 60)}</p>{one}<p>{prose(2, 60)}</p></article>")
    assert found == "\n\n".join([prose(1, 60), "One link", prose(2, 60)])


@pytest.mark.parametrize("deep", ["<b>", "<div>", "<b><div></div>", "<p><b>", "<i><article>"])
def test_deep_pages_take_time_in_proportion(deep):
    import time

    began = time.perf_counter()
    assert html.main_text(deep * 60_000 + "deep" + "</i>" * 60_000).endswith("deep")
    assert time.perf_counter() - began < 20


def test_short_blocks_at_the_ends_of_the_main_text():
    long, menu = [prose(i, 60) for i in range(4)], "<div id=menu><a>x</a><a>y</a></div>"
    whole = ["Lead.", *long, "Two short.", "End."]
    blocks = "".join(f"<p>{x}</p>" for x in whole)
    assert html.main_text(f"<body>{menu}{blocks}<div class=footer>f</div>") == "\n\n".join(whole)
    assert html.main_text(f"<body><div><a>x</a></div><div>{blocks}</div><div><a>y</a></div>") == "\n\n".join(whole)
    assert html.main_text(f"<main><h1>Title</h1><p>Lead</p><article>{blocks}</article></main>") == "\n\n".join(["Title", "Lead", *whole])


def test_names_that_tell_of_other_blocks():
    assert html.main_text("<div class='post has-sidebar no-comments'><p>" + prose(1, 40) + "</p></div>") == prose(1, 40)
    assert html.main_text("<div class='adSlot'>x</div><p>" + prose(1, 40)) == prose(1, 40)


def test_a_disclaimer_is_a_notice():
    body = "".join(f"<p>{prose(i, 30)}</p>" for i in range(4))
    text = html.main_text(f"<div class='post'>{body}</div><div class='disclaimer'><p>{prose(9, 20)}</p></div>")
    assert text == "\n\n".join(prose(i, 30) for i in range(4))


@pytest.mark.parametrize("broken", ["", " ", "no markup at all", "<", "<p", "<!--", "&am", "<article><p>x", "</p></article>", "<article></article>", "\x00<p>é", "<b>" * 3000 + "deep"])
def test_broken_pages(broken):
    assert isinstance(html.main_text(broken), str)


def test_pages(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", None), (3, "w", "<article><p>" + "&amp; word " * 20_000 + "</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[3] == 20_000 * 7 - 1 and [r["text"] for r in got if r["page_id"] in (2, None)] == ["", ""]
    assert html.extract(pages.limit(0)).count() == 0
