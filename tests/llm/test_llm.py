"""The training-data operators against brute force, on documents with every oddity, and on the sample tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagwright.llm import ann, bpe, chat, components, jaccard, langid, lines, media, mixing, quality, queries, textscan, toxicity
from bagwright.llm.common import READ_ROWS, held_out
from tests.conftest import bag, table

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(60))
TEXTS = [
    BASE,
    BASE,
    BASE.replace("tok30", "other"),
    BASE.upper(),
    None,
    "",
    " \t\r\n ",
    "one",
    "One",
    "one two three",
    "ÉTÉ été straße\nline\n\n line \nLINE",
    LONG,
    LONG + " tail",
    "a\x1cb\x85c\xa0d \x0b e",
    "<|endoftext|> x <|endoftext|>",
    "🎉 日本語\n\nline",
    "!!! $$$ ###",
    "same line\nbody one",
    "same line\nbody two",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string, score string, t string, node int, batch int, n int, h int"


def rows():
    out = []
    for i, t in enumerate(TEXTS):
        out.append((i + 1, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 7 == 3 else f"s{i % 3}", None, 1, "x", "y", "z", 2, 3, 4, 5))
    return [*out, out[0], (None, BASE, "en", "s0", 3, *out[0][5:]), (None, None, None, None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# -- scans ---------------------------------------------------------------------------------------


@given(st.lists(st.text(alphabet="aAbB é\n\t\x0b\x1c\x85漢", max_size=12), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    column = pa.array(texts, pa.string())
    got: list[list[int]] = [[] for _ in texts]
    for lo, _, offs, data in textscan.chunks(column, 9):  # longer texts come in pieces
        h, at = textscan.words(data, offs)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            got[lo + i] += h[a:b].tolist()
    want = [words(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    ids: dict = {}
    for g, w in zip(got, want, strict=True):
        for x, y in zip(g, w, strict=True):
            assert ids.setdefault(y, x) == x
    assert len(set(ids.values())) == len(ids)


def test_colliding_strings_have_hashes_of_their_own():
    word = "a"
    while len(word) < 4096:
        word += word.translate({97: "b", 98: "a"})
    texts = [w for n in (1024, 2048, 4096) for w in (word[:n], word[:n].translate({97: "b", 98: "a"}))]
    texts += ["x" * n for n in range(1, 40)] + ["x" * n + "y" for n in range(40)] + ["ab" * 8 + "cd" * 8, "cd" * 8 + "ab" * 8]
    h = [textscan.words(d, o)[0][0] for t in texts for _, _, o, d in textscan.chunks(pa.array([t]))]
    assert len(set(h)) == len(set(texts))


@given(st.lists(st.lists(st.sampled_from(["a", "Bcd", "x" * 30, "é" * 9, "\n", "A.b", " ", "$%", "hate", "z\n\n"]), max_size=60).map(" ".join), min_size=1, max_size=5), st.sampled_from([1, 7, 50]))
@settings(max_examples=60, deadline=None)
def test_pieces_of_a_text_give_what_the_whole_gives(texts, most):
    column = pa.array([*texts, None], pa.string())

    def everything():
        scanned = list(lines.scan(column))
        return (
            [x.tolist() for x in textscan.sets(column, 3)],
            quality.features(column).round(9).tolist(),
            [x.tolist() for x in toxicity.features(column)],
            np.concatenate([x.h for x in scanned]).tolist(),
            sum(([x.lo + i] * int(n) for x in scanned for i, n in enumerate(np.diff(x.at))), []),
        )

    whole = everything()
    before = textscan.CHUNK
    try:
        textscan.CHUNK = most
        assert everything() == whole
    finally:
        textscan.CHUNK = before


def test_memory_for_a_very_long_text():
    """A text of 60 MB takes a small multiple of its size in each scan."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from bagwright.llm import jaccard, lines, quality, textscan, toxicity
word = np.random.default_rng(1).integers(97, 123, (10_000_000, 6), dtype=np.uint8)
word[:, 5] = 32
word[::12, 5] = 10
column = pa.array([word.tobytes().decode()])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
what = sys.argv[1]
if what == "lines":
    print(sum(len(x.h) for x in lines.scan(column)))
else:
    print(len({"sets": lambda: next(textscan.sets(column, 4)), "quality": lambda: quality.features(column), "toxicity": lambda: list(toxicity.buckets(column))[0]}[what]()))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    for what, most in (("lines", 200), ("sets", 500), ("quality", 400), ("toxicity", 900)):
        out = subprocess.run([sys.executable, "-c", code, what], capture_output=True, text=True, check=True).stdout.split()
        assert int(out[1]) < most, (what, out)


# -- 10: media -----------------------------------------------------------------------------------


@given(st.binary(min_size=64, max_size=640).map(lambda b: b[: len(b) // 64 * 64]), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_png_round_trip_and_all_filters(data, kind):
    assert media.decode_png(media.encode_png(data)).tobytes() == data
    grid = np.frombuffer(data, np.uint8).reshape(-1, 64).astype(int)
    left = np.pad(grid, ((0, 0), (1, 0)))[:, :-1]
    up = np.pad(grid, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(grid, ((1, 0), (1, 0)))[:-1, :-1]
    p = left + up - corner
    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    guess = (0 * grid, left, up, (left + up) // 2, paeth)[kind]
    coded = ((grid - guess) % 256).astype(np.uint8)
    assert (media._unfilter(np.full(len(grid), kind), coded) == grid).all()


def test_feature_against_a_plain_cosine_transform():
    rng = np.random.default_rng(5)
    for height in (1, 5, 32, 100, 333):
        pixels = rng.integers(0, 256, (height, 64)).astype(np.uint8)
        bands = [(i * height // 32, max((i + 1) * height // 32, i * height // 32 + 1)) for i in range(32)]
        small = [[float(pixels[a:b, 2 * x : 2 * x + 2].mean()) for x in range(32)] for a, b in bands]
        low = []
        for u in range(8):
            for v in range(8):
                low.append(sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)))
        middle = sorted(round(x, 6) for x in low[1:])[31]
        bits = "".join("1" if i and round(x, 6) > middle else "0" for i, x in enumerate(low))
        assert media.cosine_hash(pixels) == f"{int(bits, 2):016x}"


def test_png_checks_fail():
    good = media.encode_png(bytes(64))
    for bad in (b"x" + good[1:], good[:40] + bytes([good[40] ^ 1]) + good[41:], good[:-3], good[:33] + good[-12:][:0]):
        with pytest.raises(ValueError):
            media.decode_png(bad)


def test_media(spark, docs, empty):
    got = media.media_features(media.encode_media(docs)).collect()
    assert len(got) == len(rows())
    want = Counter()
    for r in rows():
        b = (r[1] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want[(r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in got}) == len({r["payload_sha256"] for r in got})
    assert media.media_features(media.encode_media(empty)).count() == 0


# -- 9: lines ------------------------------------------------------------------------------------


def brute_lines(data, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter()
    for r in data:
        seen.update({key(x) for x in (r[1] or "").split("\n")} - {""})
    out = Counter()
    for r in data:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if not (key(x) and seen[key(x)] >= least)]
        out[(r[0], len(all_lines), len(all_lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("most", [1 << 20, 0])
def test_lines(docs, empty, least, most, monkeypatch):
    monkeypatch.setattr(lines.drop_lines, "__defaults__", ("text", 1, most))
    got = lines.dedup_lines(docs, min_docs=least, batches=3)
    assert got.columns == [*docs.columns, lines.N_LINES, lines.N_DROPPED]
    named = docs.withColumnsRenamed({"n": "_n_lines", "h": "_gone", "t": "_digest"})
    assert lines.dedup_lines(named, min_docs=least, batches=1).columns == [*named.columns, "__n_lines", "_n_dropped"]
    assert Counter((r["doc_id"], r[lines.N_LINES], r[lines.N_DROPPED], r["text"] or "") for r in got.collect()) == brute_lines(rows(), least)
    assert lines.dedup_lines(empty, min_docs=least).count() == 0


def test_lines_that_a_weak_hash_confuses(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate({97: "b", 98: "a"})
    data = [(i, (word if i < 5 else word.translate({97: "b", 98: "a"})) + f"\nown {i}") for i in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["_n_dropped"] for r in lines.dedup_lines(df).collect()} == {0}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df.withColumn("text", F.substring("text", 1, 2048)), 4, 85).collect()} == {i: 0 if i < 5 else 5 for i in range(10)}


def test_runs_are_levelled(spark):
    runs = lines.LineRuns(spark, min_docs=3, fanout=2)
    total = Counter()
    for k in range(7):
        part = {(h // 2, h): 1 + (h + k) % 2 for h in range(k, k + 5)}  # keys that share h
        total.update(part)
        runs.add(spark.createDataFrame([(*key, n) for key, n in part.items()], "h long, g long, n_docs long"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    assert sorted((r["h"], r["g"]) for r in runs.settled().collect()) == sorted(key for key, n in total.items() if n >= 3)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    more = spark.table(runs.write(spark.createDataFrame([(2, 5, 1), (2, 6, 1)], "h long, g long, n_docs long")))
    joined = more.join(runs.settled().toDF("h2", "g2").hint("merge"), lines._same(), "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bagwright_run")]


def test_min_points(docs):
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs.filter("doc_id IN (11, 18, 19)"), min_docs=1, min_points=5).collect()}
    assert kept[11] == "line\n\n line \nLINE"


# -- 1: mixing -----------------------------------------------------------------------------------


def water(sizes, weights, cap):
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in open_}
        out |= {s: float(cap * sizes[s]) for s in over}
        open_ -= over
    return out


def test_mixing(spark, docs, empty):
    got = mixing.mix_table(docs).collect()
    assert len(got) == len(rows())
    sizes = Counter()
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 3
    assert bag(mixing.mix_table(docs)) == bag(mixing.mix_table(docs.repartition(3)))
    assert mixing.mix_table(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


def test_mixing_takes_its_target_of_tied_rows(spark):
    """Rows without ids, rows that repeat an id, and equal rows: each source's words come within one document of its target."""
    texts = {None: [f"w{i % 50} " * (1 + i % 9) for i in range(300)] + ["same words here"] * 200, "a": ["one"] * 1000, "b": [f"long {i} " * 20 for i in range(200)], "c": ["x y"] * 3}
    data = [(None if i % 3 else 7, t, s) for s, some in texts.items() for i, t in enumerate(some)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_table(df).collect()
    taken, target, longest = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s, n in target.items():
        assert int(n) == taken[s], s
    assert bag(mixing.mix_table(df.repartition(7))) == bag(mixing.mix_table(df.coalesce(1)))
    plenty = Counter(r["source"] for r in mixing.mixed_rows(df).collect())
    assert plenty == Counter(r["source"] for r in got for _ in range(-(-r["taken"] // max(r["size"], 1))))


def test_mixing_orders_within_buckets(spark, monkeypatch):
    data = [(i, " ".join(["w"] * (1 + i % 9)) + (" $$$" * (i % 4)), None if i % 10 == 0 else f"s{i % 10 % 3}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    whole = bag(mixing.mix_table(df))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    assert bag(mixing.mix_table(df)) == whole
    by_source = defaultdict(int)
    target = {}
    for r in mixing.mix_table(df).collect():
        by_source[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by_source[s] - target[s]) < 1.5 for s in target)
    mixed = Counter(r["doc_id"] for r in mixing.mixed_rows(df).collect())
    for r in mixing.mix_table(df).collect():
        assert mixed[r["doc_id"]] == -(-r["taken"] // r["size"])


# -- 2: chats ------------------------------------------------------------------------------------


def test_chat(spark):
    convs = {1: [("u", "hi")], 2: [("u", "hi"), ("a", "yo")], 3: [("u", "hi"), ("a", "yo")], 4: [("u", None), ("a", "")], 5: [("u", "")], 6: [("u", None)], 7: [("u", "hi"), ("a", "yo"), ("u", "z" * 50_000)], None: [("u", "hi"), ("a", "yo")]}
    data = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, pos string")
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["chat"]) for r in chat.format_chats(df).collect()}
    assert set(got) == {4, 5, 7} and got[7][0] == 3 and got[4] == (2, 1, "<|u|>\n<|end|>\n<|a|>\n<|end|>\n")
    only = df.filter("conv_id IS NULL OR conv_id IN (2, 3)")
    assert [(r["conv_id"], r["n_equal"]) for r in chat.format_chats(only).collect()] == [(2, 3)]
    assert [r["conv_id"] for r in chat.format_chats(df.filter("conv_id IS NULL")).collect()] == [None]
    assert chat.format_chats(df.limit(0)).count() == 0
    twice = chat.format_chats(spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in twice] == [(1, 2)]
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 5: near duplicates --------------------------------------------------------------------------


def brute_groups(data, k, percent):
    sets = []
    for r in data:
        w = words(r[1])
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(data))


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, empty, k, percent):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, k, percent, cells=1 << 12).collect())
    assert got == brute_groups(rows(), k, percent)
    assert jaccard.join(empty, k, percent, cells=1 << 12).count() == 0


@pytest.mark.parametrize("percent,block", [(85, 4096), (80, 8), (60, 16)])
def test_jaccard_near_copies_and_frequent_passages(spark, percent, block, monkeypatch):
    """Groups of near copies at all distances, passages in many texts, tiny sketches: nothing is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(percent)
    data, passage = [], [f"p{i}" for i in range(25)]
    for g in range(6):
        base = [f"g{g}v{int(x)}" for x in rng.integers(0, 400, 30 + 25 * g)]
        for _ in range(18):
            w = list(base)
            for _ in range(int(rng.integers(0, 5 + g))):
                w[int(rng.integers(0, len(w)))] = f"e{int(rng.integers(0, 50))}"
            data.append((len(data) + 1, " ".join(w + (passage if rng.random() < 0.5 else []))))
    for i in range(30):
        data.append((len(data) + 1, " ".join([f"solo{i}"] * (i % 3) + passage)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 3, percent, cells=1 << 8).collect())
    assert got == brute_groups(data, 3, percent)


@given(st.sets(st.integers(0, 60), min_size=1, max_size=40), st.sets(st.integers(0, 60), max_size=8), st.sampled_from([60, 80, 85]), st.integers(0, 255))
@settings(max_examples=400, deadline=None)
def test_linking_sets_share_an_index_entry(a, flips, percent, frequent_from):
    b = a ^ flips
    if not b or a == b or 100 * len(a & b) < percent * len(a | b):
        return
    token = lambda s: np.sort(textscan.mix(np.array(sorted(s), np.uint64)))
    classes = (np.arange(1 << 8) * 37 % 256).astype(np.uint8)
    x, y = (set(jaccard.signatures(token(s), classes, 56, frequent_from, percent).tolist()) for s in (a, b))
    assert x & y
    p, q = (np.frombuffer(jaccard.bitmap(token(s)), np.uint64)[None] for s in (a, b))
    p, q = (p, q) if p.size <= q.size else (q, p)
    while q.size > p.size:
        q = jaccard._fold(q)
    assert int(np.bitwise_count(p ^ q).sum()) <= len(a ^ b)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n for n, x in got.items() if x == 0} == set(range(41)) and got[150] == got[200] == 100


# -- 6: BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def encoder(tokenizer):
    vocabulary = bpe.Vocabulary(open(tokenizer[0], "rb").read())
    common = [b" the", b"the", b"them", b" then", b"straight", "é".encode(), b"hen"]
    lexicon = bpe.build_transducer({w: np.frombuffer(i, np.int32).tolist() for w, i in zip(common, vocabulary.merge(common), strict=True)})
    return bpe.Encoder(vocabulary, bpe.Transducer(lexicon))


PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "12", "½", "é", "ß", "漢", "!", "$", "\x1c", "\x1f", "\x85", "\xa0", "<|endoftext|>", "<|", "The", " the", "ing", "\r\n", "_", "Ⅳ", "́", "᠎", " ", "　", "🎉", "\x00"]


@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_bpe_equals_the_library(encoder, tokenizer, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = tokenizer[1].encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert encoder.vocabulary.decode(ids).decode("utf-8", "replace") == tokenizer[1].decode(want, skip_special_tokens=False)


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=100, deadline=None)
def test_transducer(entries, others):
    t = bpe.Transducer(bpe.build_transducer(entries))
    asked = [*entries, *others]
    for w, at in zip(asked, t.find(asked).tolist(), strict=True):
        assert (at >= 0) == (w in entries)
        if at >= 0:
            assert t.ids[t.first[at] : t.first[at + 1]].tolist() == entries[w]


def test_transducer_shares_suffixes():
    t = bpe.Transducer(bpe.build_transducer({a + b"ation": [1] for a in (b"n", b"st", b"r")}))
    assert len(t.final) == 8  # root, one after s, the shared suffix


def test_bpe_query(docs, empty, tokenizer):
    model = bpe.Bpe(tokenizer[0]).fit(docs, size=50)
    ids = model.encode(docs)
    got = Counter(tuple(r) for r in model.digests(ids).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for r in rows():
        e = tokenizer[1].encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(e), sha(",".join(map(str, e))), sha(tokenizer[1].decode(e, skip_special_tokens=False)))] += 1
    assert got == want
    assert Counter(r["text"] for r in model.decode(ids).collect()) == Counter(r[1] or "" for r in rows())
    none = bpe.Bpe(tokenizer[0]).fit(empty)
    assert none.digests(none.encode(empty)).count() == 0


def test_bpe_digests_in_one_worker(spark, docs, empty, tokenizer):
    model = bpe.Bpe(tokenizer[0]).fit(docs, size=50)
    got = model.encoded_digests(docs)
    want = model.digests(model.encode(docs))
    assert got.schema == want.schema
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert model.encoded_digests(empty).count() == 0
    # Python workers of one task run side by side and each holds the vocabulary, so one a task has to do.
    import corpus_pipeline

    plan = corpus_pipeline.encode(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_memo_keeps_what_comes_again(tokenizer, monkeypatch):
    vocabulary = bpe.Vocabulary(open(tokenizer[0], "rb").read())
    once, again = [f"once{i}x" for i in range(20_000)], [f"again{i}x" for i in range(50)]
    texts = [" ".join([*once[k : k + 200], *again, "<|endoftext|>", "long" * 40]) for k in range(0, len(once), 200)]
    want = [tokenizer[1].encode(t, add_special_tokens=False).ids for t in texts]
    e = bpe.Encoder(vocabulary, bpe.Transducer(bpe.build_transducer({})))
    assert [e.encode([t])[0].tolist() for t in texts] == want
    assert set(again[1:-1]) <= set(e.memo) and len(e.memo) < 1000 and max(map(len, e.memo)) <= bpe.LONG
    monkeypatch.setattr(bpe, "MEMO", 20)  # halved again and again
    assert [e.encode([t])[0].tolist() for t in texts] == want
    assert len(e.memo) < 1000


def test_counting_drops_the_encoders_of_earlier_fits(spark, docs, tokenizer):
    def held(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(bpe._workers)], pa.int64())})

    many = spark.range(40).repartition(40)
    bpe.Bpe(tokenizer[0]).encoded_digests(docs.repartition(40)).collect()
    assert max(r["n"] for r in many.mapInArrow(held, "n long").collect()) == 1
    bpe.count_words(docs.repartition(40)).collect()
    assert max(r["n"] for r in many.mapInArrow(held, "n long").collect()) == 0


def test_words_are_counted_exactly(spark, monkeypatch):
    texts = [*TEXTS, *(f"thin{i % 40} two  spaces, {'long' * 20},tail{i % 3}" for i in range(160))]
    want = Counter(w for t in texts for w in bpe.PATTERN.findall(t or "") if len(w) <= bpe.LONG)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(40)
    assert {r["word"]: r["n"] for r in bpe.count_words(df).collect()} == want
    assert {r["word"]: r["n"] for r in bpe.count_words(df.coalesce(1)).collect()} == want
    monkeypatch.setattr(bpe, "MEMO", 10)
    assert {r["word"]: r["n"] for r in bpe.count_words(df).collect()} == want


def test_long_words(encoder, tokenizer):
    for text in ("x" * 5000, "ab" * 3000, "é" * 1000 + "!" * 700):
        assert encoder.encode([text])[0].tolist() == tokenizer[1].encode(text, add_special_tokens=False).ids


# -- 7: neighbours -------------------------------------------------------------------------------


def brute_neighbours(data, k):
    ok = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if len(w) == len(v) and j != i)
            out[i] = near[:k]
    return out


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 2.0]
    data = [(i, same) for i in range(100, 130)] + [(0, [0.0, 0.0, 0.0]), (200, None), (300, [1.0, None, 2.0]), (400, [nan, 1.0, 1.0]), (500, [inf, 1.0, 1.0]), (600, [1e300, 1.0, 0.0]), (700, [5.0]), (701, [7.0]), (800, []), (None, [1.0, 1.0, 1.0]), (900, [1.0, 2.0, 2.5]), (901, [-0.0, 0.0, 3.0]), (1000, [0.0, 0.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<double>, shard string")
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = brute_neighbours(data, 10)
    assert set(got) == set(want)
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_neighbours_recall_over_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    data = [(i, (centres[i % 20] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    want = brute_neighbours(data, 10)
    got = defaultdict(set)
    for r in ann.search(df, F.col("id") % 100 == 0, shard_rows=600).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.95 * 10 * len(want)


def test_neighbours_recall_on_the_sample(spark, data):
    vectors = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute_neighbours(vectors, 10)
    got = defaultdict(set)
    for r in queries.op7_neighbours(spark, data).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_neighbours_recall_beside_a_tight_group():
    rng = np.random.default_rng(1)
    sizes = [1500, *[100] * 15, *[12] * 130]  # a third of all rows, and groups that link only themselves
    centres = rng.normal(size=(len(sizes), 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    of = np.repeat(np.arange(len(sizes)), sizes)
    vectors = centres[of] + 0.02 * rng.normal(size=(len(of), 64))
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True))[rng.permutation(len(of))]
    ids, asked = np.arange(len(of)), np.arange(0, len(of), 7)
    found = defaultdict(set)
    for q, v, _ in zip(*ann.Graph.build(vectors, np.arange(len(of) + 1), ids).search(asked, vectors[asked], 10), strict=True):
        found[q].add(v)
    hits = 0
    for q in asked:
        d = ((vectors - vectors[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.99 * 10 * len(asked)


# -- 3, 4, 8: models -----------------------------------------------------------------------------


def test_models_take_every_row(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2, "x") for i in range(1, 20)] + [(None, 1, 1, "x"), (3, None, None, "x")], "doc_id long, quality int, toxic int, y string")
    for kind in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            model = kind.learn(docs, some, ~held_out(F.col("doc_id"), 5, 0))
            got = kind.score(docs, model).collect()
            assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
            by_id = defaultdict(set)
            for r in got:
                by_id[r["doc_id"]].add(r["score"])
            assert len(by_id[1]) == 1
        assert kind.score(empty, kind.learn(empty, labels, F.lit(True))).count() == 0
    filters = langid.learn(docs, ~held_out(F.col("doc_id"), 3, 1))
    got = langid.identify(docs, filters).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r[langid.LANG] == "und") == (not r["text"] or not re.search(r"[^\W\d_]", r["text"]))
        assert 0 <= r[langid.SCORE] <= 1
    assert langid.identify(docs, filters, only_known=True).columns == docs.columns
    none = langid.learn(empty, F.lit(True))
    assert {r[langid.LANG] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, filters).count() == 0


def test_sampled_rows_and_bytes_are_bounded(spark):
    from bagwright.llm import labelled

    labels = spark.createDataFrame([(i % 500, int(i % 500 > 400)) for i in range(5000)], "doc_id long, quality int")
    texts = [(i, f"text {i}") for i in range(500)] + [(3, f"copy {i}") for i in range(3000)] + [(450, "same")] * 2000
    df = spark.createDataFrame(texts, "doc_id long, text string")

    def features(column):
        return pa.array([b"0" * (1000 if len(x.as_py()) < 7 else 10) for x in column], pa.binary())

    rows = labelled.sample(df, labels, F.lit(True), "quality", 200, features, "binary", 1 << 30).to_pylist()
    n = Counter(r["y"] for r in rows)
    assert 150 < n[0] <= 200 and 90 <= n[1] <= 102
    assert all(math.isclose(sum(r["weight"] for r in rows if r["y"] == y), total, rel_tol=0.1) for y, total in ((0, 401), (1, 99)))
    few = labelled.sample(df, labels, F.lit(True), "quality", 200, features, "binary", 2000).to_pylist()
    assert 0 < sum(len(r["x"]) for r in few) <= 2000
    assert labelled.sample(df, labels.limit(0), F.lit(True), "quality", 200, features, "binary", 2000).num_rows == 0
    assert sorted(map(str, labelled.sample(df.repartition(5), labels, F.lit(True), "quality", 200, features, "binary", 1 << 30).to_pylist())) == sorted(map(str, rows))


def test_quality_writes_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, the sample's scratch table has no more files than there are cores, and all its rows."""
    from bagwright.llm import labelled

    files, sizes, write = [], [], labelled.materialize

    def counted(df, tag):
        out = write(df, tag)
        files.append(len(out.inputFiles()))
        sizes.append(out.count())
        return out

    monkeypatch.setattr(labelled, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
        df = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
        quality.learn(df, labels, F.lit(True))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sizes == [400]
    assert len(files) == 1 and 0 < files[0] <= spark.sparkContext.defaultParallelism


def test_quality_reads_few_rows_at_once(spark, docs):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        for held, bound in (("4096", READ_ROWS), ("7", 7)):
            spark.conf.set(key, held)
            assert quality.score(docs, 0.5).count() == len(rows())
            assert int(spark.conf.get(key)) == bound
    finally:
        spark.conf.set(key, before)


def test_quality_against_a_plain_loop():
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=400), rng.integers(0, 4, 400).astype(float), np.ones(400)], 1)
    y = (x[:, 0] + (x[:, 1] == 2) + rng.normal(size=400) * 0.3 > 0.5).astype(float)
    weight = np.where(y > 0, 2.0, 1.0)
    model = quality.Additive(x, y, weight)

    def place(edges, v):
        return sum(1 for e in edges if e <= v)

    def leaf(rows, g, h):
        return -sum(g[i] for i in rows) / (sum(h[i] for i in rows) + quality.RIDGE)

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + quality.RIDGE)

    def tree(rows, bins, n, g, h, depth, lo, hi):
        """Leaf value of each bin from lo to hi."""
        best, at = 0.0, None
        for cut in range(lo + 1, hi):
            a, b = [i for i in rows if bins[i] < cut], [i for i in rows if bins[i] >= cut]
            new = gain(a, g, h) + gain(b, g, h) - gain(rows, g, h)
            if new > best + 1e-12:
                best, at = new, cut
        if depth == 0 or best <= 1e-9:
            return [leaf(rows, g, h)] * (hi - lo)
        a, b = [i for i in rows if bins[i] < at], [i for i in rows if bins[i] >= at]
        return tree(a, bins, n, g, h, depth - 1, lo, at) + tree(b, bins, n, g, h, depth - 1, at, hi)

    tables = [[0.0] * len(t) for t in model.tables]
    bins = [[place(e, v) for v in x[:, k]] for k, e in enumerate(model.edges)]
    total = [model.base] * len(y)
    small = quality.Additive.__new__(quality.Additive)
    for _ in range(2):  # the first rounds decide as the plain loop does; further ones repeat them
        for k in range(3):
            p = [1 / (1 + math.exp(-t)) for t in total]
            g, h = [w * (q - v) for w, q, v in zip(weight, p, y, strict=True)], [w * q * (1 - q) for w, q in zip(weight, p, strict=True)]
            found = tree(range(len(y)), bins[k], len(tables[k]), g, h, 2, 0, len(tables[k]))
            tables[k] = [a + quality.RATE * b for a, b in zip(tables[k], found, strict=True)]
            total = [t + quality.RATE * found[b] for t, b in zip(total, bins[k], strict=True)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "ROUNDS", 2)
        patch.setattr(quality, "PAIR_ROUNDS", 0)
        small.__init__(x, y, weight)
    assert all(np.allclose(a, b) for a, b in zip(small.tables, tables, strict=True))
    for i in (0, 7, 99):  # a score is the sigmoid of table entries
        s = model.base + sum(model.tables[k][place(model.edges[k], x[i, k])] for k in range(3))
        s += sum(t[place(model.coarse[a], x[i, a]), place(model.coarse[b], x[i, b])] for (a, b), t in model.pairs.items())
        assert math.isclose(model.score(x[i : i + 1])[0], 1 / (1 + math.exp(-s)))


def test_quality_features_by_hand():
    text = "Ab ab, 12!\n\nÉé {x}"
    got = dict(zip(quality.NAMES, quality.features(pa.array([text]))[0], strict=True))
    size = len(text.encode())
    assert math.isclose(got["words"], math.log1p(5)) and math.isclose(got["length"], (2 + 3 + 3 + 4 + 3) / 5)
    assert math.isclose(got["digit"], 2 / size) and math.isclose(got["wide"], 4 / size) and math.isclose(got["break"], 2 / size)
    assert math.isclose(got["distinct"], 5 / 5**0.9) and math.isclose(got["longest"], math.log1p(4)) and math.isclose(got["lines"], math.log1p(size / 3))


def test_ftrl_against_a_scalar_one():
    rng = np.random.default_rng(4)
    model = toxicity.Ftrl(50)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == 50 else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(600):
        found = np.append(np.flatnonzero(rng.random(50) < 0.2), 50)
        y, w = int(found[0] < 3), 1.0 + (found[0] % 2)
        model.update(found, y, w)
        old = {i: weight(i) for i in found.tolist()}
        g = w * (1 / (1 + math.exp(-sum(old.values()))) - y)
        for i, v in old.items():
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * v
            n[i] += g * g
    assert np.allclose(model.z, [z[i] for i in range(51)]) and np.allclose(model.n, [n[i] for i in range(51)])
    at, w, base = model.sparse()
    assert 0 < len(at) < 50 and at.tolist() == [i for i in range(50) if weight(i)] and np.allclose(w, [weight(i) for i in at]) and math.isclose(base, weight(50))


def test_toxicity_features_by_hand():
    text = "Hate you, YOU hateful-é"
    w = ["hate", "you", "you", "hateful", "é"]
    one = lambda s: textscan.span_hashes(np.frombuffer(s.encode(), np.uint8), np.array([0]), np.array([len(s.encode())]))[0]
    pair = lambda a, b, gap: textscan.mix(one(a) * np.uint64(3) + textscan.mix(np.array([one(b)]) + np.uint64(gap)))[0]
    want = {one(x) for x in w} | {one("hateful"[:k]) ^ np.uint64(k) for k in (4, 5, 6)}
    with np.errstate(over="ignore"):
        want |= {pair(a, b, gap) for gap in (1, 2) for a, b in zip(w, w[gap:], strict=False)}
    assert toxicity.features(pa.array([text]))[0].tolist() == sorted({int(x) >> 42 for x in want})


def test_filters_hold_what_they_learned(spark):
    own = {"aa": "alba casa nova verde", "bb": "wald haus neu gruen", "cc": "casa haus piccolo"}
    data = [(i, f"{t} {t.split()[i % 3]}", x) for i in range(12) for x, t in own.items()]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    filters = langid.learn(df, F.lit(True))

    def plain(text):
        t = "".join(c if "a" <= c <= "z" else " " for c in text)
        return [g for n in langid.SIZES for p in [f" {t} "] for i in range(len(p) - n + 1) for g in [p[i : i + n]] if " " not in g[1:-1]]

    counts = {x: Counter(g for _, t, y in data if y == x for g in plain(t)) for x in own}
    seen = {x: Counter() for x in own}
    distinct = {x: {t for _, t, y in data if y == x} for x in own}
    times = Counter(t for _, t, _ in data)
    for x, texts in distinct.items():
        for t in texts:
            for g in plain(t):
                seen[x][g] += 1 + int(math.log2(times[t]))
    assert all(set(seen[x]) == set(counts[x]) for x in own)
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in seen.items()}
    kept = {x: {g for g, n in c.items() if n >= langid.SEEN and share[x][g] >= langid.SHARE * max(share[y].get(g, 0) for y in own)} for x, c in seen.items()}
    texts = [t for _, t, _ in data]
    for lo, hi, offs, raw in textscan.chunks(pa.array(texts)):
        hit, n = filters.hits(raw, offs)
        for i in range(lo, hi):
            want = [sum(g in kept[x] for g in plain(texts[i])) for x in filters.langs]
            assert n[i - lo] == len(plain(texts[i]))
            assert all(a >= b for a, b in zip(hit[i - lo], want, strict=True))  # no false negatives
            assert hit[i - lo].tolist() == want  # and in so empty filters no false positives either


def test_many_languages(spark):
    own = [f"{a}{b}{a}zq" for a in "bcdfghjklm" for b in "aeiouyw"]
    data = [(i, f"{own[i % 70]}ord and {own[i % 70]}ore", f"l{i % 70:02d}") for i in range(420)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    filters = langid.learn(df, F.lit(True))
    assert filters.bits.shape[1] == 2
    assert sum(r["lang"] == r[langid.LANG] for r in langid.identify(df, filters).collect()) > 350


def accuracy(spark, data, name, column, threshold=None):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/{column[0]}.parquet").collect()}
    good = total = 0
    for r in queries.QUERIES[name](spark, data).collect():
        if r["held_out"] and r["doc_id"] in labels and labels[r["doc_id"]][column[1]] is not None:
            total += 1
            good += labels[r["doc_id"]][column[1]] == r[column[2]]
    return good / total


def test_held_out_accuracy(spark, data):
    data = os.path.join(os.path.dirname(data), "sf0.1")
    assert accuracy(spark, data, "op8_langid", ("documents", "lang", "lang_pred")) > 0.99
    assert accuracy(spark, data, "op3_quality", ("labels", "quality", "predicted")) > 0.97
    assert accuracy(spark, data, "op4_toxicity", ("labels", "toxic", "predicted")) > 0.97


# -- queries and pipeline ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    expected = duck.sql(queries.ORACLES[name])
    assert bag(df) == table(expected.columns, expected.fetchall())


def test_sql_of_odd_documents(spark, docs, tmp_path):
    """The SQL holds on the odd documents too, rows without ids and rows that repeat one among them."""
    import duckdb

    again = spark.createDataFrame([(i % 2 or None, f"shared line\nown line {i % 4} " + "w " * (i % 5), "en", "s1", None) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(again)
    some.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op1_mix", "op9_lines"):
        expected = con.sql(queries.ORACLES[name])
        assert bag(queries.QUERIES[name](spark, str(tmp_path))) == table(expected.columns, expected.fetchall()), name


def test_pipeline(spark, docs, empty, tokenizer):
    import corpus_pipeline as pipe

    source = docs.withColumn("text", F.concat(F.col("text"), F.lit("\nshared LINE"))).unionAll(docs.limit(0))
    more = spark.createDataFrame([(1000 + i, f"shared line \nunique words {i} here and there and everywhere {i * 7}", "en", f"s{i % 3}", 0, *[None] * 8) for i in range(12)], SCHEMA)
    source = source.unionAll(more)
    given = [tuple(r) for r in source.collect()]
    one = pipe.language_id(spark, source, "")
    assert one.columns == source.columns
    kept = [r for r in given if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert Counter(r["text"] for r in one.collect()) == Counter(r[1] for r in kept)
    two = pipe.line_dedup(spark, one, "")
    assert two.columns == source.columns
    lined = Counter((a, d) for (a, _, _, d), n in brute_lines(kept, 10).items() for _ in range(n))
    assert Counter((r["doc_id"], r["text"]) for r in two.collect()) == lined
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = pipe.near_duplicates(spark, two, "")
    assert three.columns == source.columns
    groups = brute_groups([(a, d) for a, d in lined.elements()], 5, 80)
    assert Counter(r["doc_id"] for r in three.collect()) == Counter({a: 1 for a, _, c in groups if a == c and a is not None})
    four = pipe.mix(spark, three, "")
    assert four.columns == source.columns
    times = Counter(r["doc_id"] for r in four.collect())
    for r in mixing.mix_table(three).collect():
        assert times[r["doc_id"]] == (-(-r["taken"] // r["size"]) if r["size"] else 0)
    five = pipe.encode(spark, four, "")
    texts = {r["doc_id"]: r["text"] for r in three.collect()}
    for r in five.collect():
        e = tokenizer[1].encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(e), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    nothing = empty
    for _, stage in pipe.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as pipe

    names = ["_h", "_id", "_n_lines", "_n_dropped", "_digest", "_gone", "_times", "_row", "row", "i", "t", "i2", "t2", "key", "tie", "no", "first", "copy", "_lang_pred"]
    data = [(i % 20, f"shared line\nwords of {i % 15} that are all its own {i % 15}", "en", f"s{i % 2}", *range(len(names))) for i in range(30)]
    docs = spark.createDataFrame(data, ["doc_id", "text", "lang", "source", *names])
    for name, stage in pipe.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, "")
        got = docs.collect()
        assert docs.columns == columns and got, name
        assert all(tuple(r)[4:] == tuple(range(len(names))) for r in got), name
    assert pipe.STAGES[-1][1](spark, docs, "").count() == len(got)


def test_one_document_stays_of_groups_without_or_with_one_id(spark):
    import corpus_pipeline as pipe

    def near(name):
        words = [f"{name}{i}" for i in range(80)]
        return [" ".join([*words[:-1], f"{name}end{i}"]) for i in range(3)]

    data = [*((None, t) for t in near("a")), *((5, t) for t in near("b")), (None, near("c")[0]), (8, near("c")[1]), (8, near("c")[2]), (9, near("c")[0]), (None, "few words"), (None, "few words"), (None, "more")]
    df = spark.createDataFrame([(d, t, "s0") for d, t in data], "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"].split()[0]) for r in pipe.near_duplicates(spark, df, "").collect()]
    assert Counter(kept) == Counter([(None, "a0"), (5, "b0"), (8, "c0"), (None, "few"), (None, "more")])
    assert bag(pipe.near_duplicates(spark, df.repartition(3), "")) == bag(pipe.near_duplicates(spark, df, ""))
