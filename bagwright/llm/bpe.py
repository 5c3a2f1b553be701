"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus's most frequent words of at most LONG characters (counted exactly, over all texts; taken in
whole classes of like counts, LEXICON at most; added tokens count as the text they are) are compiled with their ids into a minimal acyclic transducer: an
automaton that shares suffixes and whose arcs carry numbers that add up to the word's place in the list
of id outputs. It is flat arrays in one block of bytes, which each worker maps from memory; lookups walk
all words of a batch in step. Words that it lacks are merged exactly: the pair of the least rank first,
the leftmost of equals. Results equal those of the tokenizer file's own
library without special tokens added: added tokens within a text count as such.

Texts are cut before each space that no white space follows, which never cuts a word of the
pre-tokenizer's pattern. Null texts are empty ones; an empty text has no ids. Whole texts of any length
are encoded, long ones in parts that begin at such cuts; equal rows give equal results, empty tables empty ones, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwright.llm.common import discard, map_batches, materialize, small_batches, trim

#: Words in the lexicon.
LEXICON = 1 << 16
#: Distinct pieces a counter or a worker's memo holds before it is passed on or halved; longer pieces are not kept in the memo.
MEMO, LONG = 1 << 18, 64
#: Cells, a power of two, that tell a worker which pieces it has met.
MET = 1 << 22
#: Characters of a text that are cut into pieces at once.
PART = 1 << 20
#: Characters of text after which a counter is passed on too, as its pieces may be long.
COUNTED = 1 << 26
#: Fixed value: the pre-tokenizer's pattern.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_NONE = 1 << 62
_CUT = re.compile(r" (?=\S)")
_PLAIN = re.compile(r" (?:\s|$)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and length, joined."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def cut(text: str) -> list[str]:
    """A text's pieces without the space before each; a first one that has none is marked by a line feed, an empty one is a space."""
    pieces = text.split(" ") if not _PLAIN.search(text) else _CUT.split(text)
    pieces[0] = "\n" + pieces[0] if pieces[0] else " "
    return pieces


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about PART characters that cut() would cut apart too."""
    lo = 0
    while len(text) - lo > PART:
        found = _CUT.search(text, lo + PART)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def plain(piece: str) -> bool:
    """A piece of cut() that is one word with its space: letters of blocks that all versions of Unicode have alike."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "\u0250")


def spelt(piece: str) -> str:
    """The text of a piece of cut()."""
    return "" if piece == " " else piece[1:] if piece[0] == "\n" else " " + piece


class Vocabulary:
    """Merges, token bytes and added tokens of a tokenizer file of the byte-level kind."""

    def __init__(self, text: bytes):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is read")
        ids: dict[str, int] = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = ids[c]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.added.values()])
        tokens = [b""] * self.size
        for t, i in ids.items():
            tokens[i] = bytes(alphabet[c] for c in t)
        for t, i in self.added.items():
            tokens[i] = t.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [b"%d," % i for i in range(self.size)]
        self.digit_lengths = np.array([len(t) for t in digits], np.int64)
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        found = np.array(list(self.rank.values()), np.int64)[order]
        # A pair's code orders as its rank does and holds what it merges to.
        self.bits = self.size.bit_length()
        self.pair_codes = found[:, 0] << self.bits | found[:, 1]
        self.byte_codes = self._codes(self.byte_ids[:, None], self.byte_ids[None, :]).ravel()
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap of pairs, for words of any length."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := self.rank.get((a, b)))]
        heap = [(rank, i, a, b, new) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y], r[1]))
        return [i for i in ids if i >= 0]

    def _codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes of pairs of ids; _NONE for pairs that do not merge."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_codes[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact merging of many words in step, as bytes of 32-bit ids.

        Words of one length go together: each round merges the best pair of every word that has one, so
        that all words left are one id shorter.
        """
        out = [b""] * len(words)
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.merge_long(w), np.int32).tobytes()
            elif w:
                lengths.setdefault(len(w), []).append(i)
        for width, members in lengths.items():
            for lo in range(0, len(members), 20_000):
                part = np.array(members[lo : lo + 20_000])
                letters = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).reshape(len(part), width)
                grid, code = self.byte_ids[letters], self.byte_codes[letters[:, :-1].astype(np.int64) << 8 | letters[:, 1:]]
                while len(part):
                    n = grid.shape[1]
                    best = code.argmin(1) if n > 1 else np.zeros(len(part), np.int64)
                    least = code[np.arange(len(part)), best] if n > 1 else np.full(len(part), _NONE)
                    live = least < _NONE
                    done = grid[~live].astype(np.int32).tobytes()
                    for k, i in enumerate(part[~live].tolist()):
                        out[i] = done[4 * n * k : 4 * n * (k + 1)]
                    if not live.any():
                        break
                    part, grid, code, best = part[live], grid[live], code[live], best[live]
                    grid[np.arange(len(part)), best] = least[live] & ((1 << self.bits) - 1)
                    # The pair goes with its right end; only the pairs on both sides of the new id have another rank.
                    grid = grid[np.arange(n) != (best + 1)[:, None]].reshape(len(part), n - 1)
                    code = code[np.arange(n - 1) != best[:, None]].reshape(len(part), n - 2)
                    for at in (best - 1, best):
                        r = np.flatnonzero((at >= 0) & (at < n - 2))
                        code[r, at[r]] = self._codes(grid[r, at[r]], grid[r, at[r] + 1])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.starts[ids], self.lengths[ids]).tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        return ragged(self.digits, self.digit_starts[ids], self.digit_lengths[ids]).tobytes()[:-1]


def build_transducer(entries: dict[bytes, list[int]]) -> bytes:
    """Compiles words with id outputs. Sorted insertion; a state that can change no more is shared with its equal."""
    words = sorted(w for w in entries if w)
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path, before = [0], b""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((final[state], *arcs[state].items()), state)
            arcs[path[-1]][before[len(path) - 1]] = same

    for word in words:
        common = len(os.path.commonprefix([before, word]))
        settle(common)
        for b in word[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        before = word
    settle(0)
    # Number the words below each state, then each arc's output: the words that sort before those through it.
    places, below, stack = {0: 0}, {}, [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
        elif state not in below:
            stack += [(state, True), *((t, False) for t in arcs[state].values() if t not in below)]
    for state in below:
        places.setdefault(state, len(places))
    key, to, add = [], [], []
    for state, place in sorted(places.items(), key=lambda x: x[1]):
        n = int(final[state])
        for b, t in sorted(arcs[state].items()):
            key.append(place << 8 | b)
            to.append(places[t])
            add.append(n)
            n += below[t]
    ends = np.zeros(len(places), np.uint8)
    for state, place in places.items():
        ends[place] = final[state]
    outputs = [entries[w] for w in words]
    counts = np.array([len(o) for o in outputs], np.int64)
    parts = [np.array(key, np.int64), np.array(to, np.int32), np.array(add, np.int32), ends, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([i for o in outputs for i in o], np.int32)]
    head, body, at = [], b"", 8 * 2 * len(parts)
    for p in parts:
        body += bytes(-(at + len(body)) % 8)
        head += [at + len(body), len(p)]
        body += p.tobytes()
    return np.array(head, np.int64).tobytes() + body


class Transducer:
    """A compiled lexicon, mapped from memory."""

    def __init__(self, block: bytes):
        if hasattr(os, "memfd_create"):
            fd = os.memfd_create("lexicon")
            os.write(fd, block) if len(block) < 1 << 30 else os.fdopen(os.dup(fd), "wb").write(block)
            self.map = mmap.mmap(fd, len(block), access=mmap.ACCESS_READ)
            os.close(fd)
        else:
            self.map = memoryview(block)
        head = np.frombuffer(self.map, np.int64, 12).reshape(6, 2)
        kinds = [np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32]
        self.key, self.to, self.add, self.final, self.first, self.ids = (np.frombuffer(self.map, k, n, at) for k, (at, n) in zip(kinds, head.tolist(), strict=True))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the outputs, or -1."""
        place = np.full(len(words), -1, np.int64)
        if not len(self.key):
            return place
        size = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        row = np.flatnonzero(size)
        state, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        j = 0
        while len(row):
            key = state << 8 | flat[start[row] + j]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            on = self.key[at] == key
            row, at = row[on], at[on]
            state, total = self.to[at].astype(np.int64), total[on] + self.add[at]
            j += 1
            end = size[row] == j
            done = end & (self.final[state] > 0)
            place[row[done]] = total[done]
            row, state, total = row[~end], state[~end], total[~end]
        return place


class Encoder:
    """Texts to ids: a worker's memo of pieces over the lexicon over exact merging.

    The memo keeps what is met a second time: most distinct pieces of a corpus occur once, and would fill it.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memo: dict[str, bytes] = {}
        self.met = bytearray(MET)

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as bytes of 32-bit integers."""
        place = self.lexicon.find(words)
        first, ids = self.lexicon.first, self.lexicon.ids
        out = [b""] * len(words)
        for i in np.flatnonzero(place >= 0).tolist():
            out[i] = ids[first[place[i]] : first[place[i] + 1]].tobytes()
        unseen = np.flatnonzero(place < 0).tolist()
        for i, found in zip(unseen, self.vocabulary.merge([words[i] for i in unseen]), strict=True):
            out[i] = found
        return out

    def piece_ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids, as bytes of 32-bit integers, of distinct pieces of cut()."""
        whole, split = [], {}
        for p in pieces:
            if plain(p):
                whole.append(p)
            else:
                split[p] = PATTERN.findall(spelt(p))
        words = list(dict.fromkeys(itertools.chain([" " + p for p in whole], itertools.chain.from_iterable(split.values()))))
        by_word = dict(zip(words, self.word_ids([w.encode() for w in words]), strict=True))
        out = {p: by_word[" " + p] for p in whole}
        out.update((p, by_word[s[0]] if len(s) == 1 else b"".join([by_word[w] for w in s])) for p, s in split.items())
        return out

    def segments(self, text: str) -> list:
        """The text's stretches of ordinary text, and the ids of added tokens between them."""
        special = self.vocabulary.special
        if special is None or not special.search(text):
            return [text]
        out, at = [], 0
        for m in special.finditer(text):
            out += [text[at : m.start()], self.vocabulary.added[m.group()]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts go together as long as they have PART characters, a longer one in parts."""
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for text in texts:
            if held and size + len(text) > PART:
                out += self._together(held)
                held, size = [], 0
            if len(text) <= PART:
                held.append(text)
                size += len(text)
                continue
            ids = [np.zeros(0, np.int32)]
            for part in self.segments(text):
                ids += [np.array([part], np.int32)] if isinstance(part, int) else [self._together([p])[0] for p in parts(part)]
            out.append(np.concatenate(ids))
        return out + self._together(held)

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Memo keys of pieces that follow a cut have no leading space; `\\n` marks a text's first piece."""
        memo = self.memo
        if len(memo) > MEMO:  # what came first comes often
            kept = list(itertools.islice(memo.items(), MEMO // 2))
            memo.clear()
            memo.update(kept)
            self.met = bytearray(MET)
        plans, wanted = [], set()
        for text in texts:
            plan = []
            for part in self.segments(text):
                if isinstance(part, int):
                    plan.append(part)
                elif part:
                    pieces = cut(part)
                    plan.append(pieces)
                    wanted.update(pieces)
            plans.append(plan)
        here = self.piece_ids([p for p in wanted if p not in memo])
        memo.update(here)
        find = memo.__getitem__
        out = []
        for plan in plans:
            ids = b"".join(int(p).to_bytes(4, "little") if isinstance(p, int) else b"".join(map(find, p)) for p in plan)
            out.append(np.frombuffer(ids, np.int32))
        met = self.met
        for p in here:
            cell = hash(p) % MET
            if not met[cell] or len(p) > LONG:
                del memo[p]
            met[cell] = 1
        return out


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of the pre-tokenizer of at most LONG characters occurs.

    A task passes its counts on whenever MEMO pieces or COUNTED characters are reached; their sums are exact.
    """
    small_batches(df.sparkSession)

    def words_of(seen: Counter) -> pa.RecordBatch:
        words: dict[str, int] = {}
        find = words.get
        for piece, n in seen.items():
            for w in (" " + piece,) if plain(piece) else PATTERN.findall(spelt(piece)):
                words[w] = find(w, 0) + n
        some = [w for w in words if len(w) <= LONG]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([words[w] for w in some], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: Counter = Counter()
        read = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts(text or ""):
                    seen.update(cut(part))
                    read += len(part)
                    if len(seen) > MEMO or read > COUNTED:
                        yield words_of(seen)
                        seen.clear()
                        read = 0
        yield words_of(seen)
        seen.clear()
        trim()

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_workers: dict[str, Encoder] = {}


def _worker(name: str, vocabulary: bytes, lexicon: bytes) -> Encoder:
    """One encoder for a Python worker, kept for its later tasks."""
    if name not in _workers:
        _workers.clear()
        _workers[name] = Encoder(Vocabulary(vocabulary), Transducer(lexicon))
    return _workers[name]


def forget() -> None:
    """Drops the encoder of an earlier fit from a Python worker, which outlives the query it was made for."""
    if _workers:
        _workers.clear()
        trim()


def _digest_columns(vocabulary: Vocabulary, doc_id: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    texts = (vocabulary.decode(i).decode("utf-8", "replace").encode() for i in ids)
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(vocabulary.decimals(i)) for i in ids], pa.string()), pa.array([sha(t) for t in texts], pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """A tokenizer file with a lexicon. The file (a few MB) and the lexicon (LEXICON words) are broadcast."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        with open(path, "rb") as f:
            self.text = f.read()
        self.lexicon = lexicon or build_transducer({})
        self.name = hashlib.sha256(self.text + self.lexicon).hexdigest()

    def fit(self, df: DataFrame, text_col: str = "text", size: int = LEXICON) -> Bpe:
        """Compiles the most frequent words of df, of those seen twice, in whole classes of like counts (64 a doubling)."""
        counts = materialize(count_words(df, text_col).filter("n > 1").withColumn("class", F.floor(64 * F.log2("n")).cast("int")), "bpe-words")
        room, least = size, None
        for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):
            room -= r["count"]
            if room < 0:
                break
            least = r["class"]
        top = counts.filter(F.col("class") >= F.lit(least)).select("word").toArrow().column(0).to_pylist()  # at most size
        discard(counts)
        words = [w.encode() for w in top]
        ids = Vocabulary(self.text).merge(words)
        self.lexicon = build_transducer({w: np.frombuffer(i, np.int32).tolist() for w, i in zip(words, ids, strict=True)})
        self.name = hashlib.sha256(self.text + self.lexicon).hexdigest()
        return self

    def encode(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, ids) of each row."""

        def columns(vocabulary, doc_id, ids):
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

        return self._encoded(df, id_col, text_col, columns, "ids array<int>")

    def encoded_digests(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """digests(encode(df)) by one Python worker a task instead of two: the ids are decoded where they are made."""
        return self._encoded(df, id_col, text_col, _digest_columns, _DIGESTS)

    def _encoded(self, df: DataFrame, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
        shared, name = df.sparkSession.sparkContext.broadcast((self.text, self.lexicon)), self.name

        def make():
            encoder = _worker(name, *shared.value)

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                return columns(encoder.vocabulary, batch.column(0), encoder.encode([t or "" for t in batch.column(1).to_pylist()]))

            return f

        return map_batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, f"doc_id {df.schema[id_col].dataType.simpleString()}, {schema}")

    def _decoded(self, df: DataFrame, columns, schema: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.text, self.lexicon))
        name = self.name

        def make():
            vocabulary = _worker(name, *shared.value).vocabulary

            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                lists = batch.column(1)
                at, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                return columns(vocabulary, batch.column(0), [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])

            return f

        return map_batches(df.select("doc_id", "ids"), make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {schema}")

    def decode(self, df: DataFrame) -> DataFrame:
        """(doc_id, text) of (doc_id, ids)."""

        def columns(vocabulary, doc_id, ids):
            return pa.RecordBatch.from_arrays([doc_id, pa.array([vocabulary.decode(i).decode("utf-8", "replace") for i in ids], pa.string())], names=["doc_id", "text"])

        return self._decoded(df, columns, "text string")

    def digests(self, df: DataFrame) -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids)."""
        return self._decoded(df, _digest_columns, _DIGESTS)
