"""BPE encoding with a minimal acyclic transducer of frequent words, and exact merges for all others.

The most frequent words of the corpus, counted over all documents, are encoded once and compiled into a minimal
acyclic automaton in which words share prefixes and suffixes. Each arc carries a number; the numbers on a word's path
add up to its place in the lexicon, and that place has the word's ids as output. The compiled arrays are broadcast
(their size is bounded by ``lexicon_words``), and each Python worker maps them from a file into memory. A batch's
distinct words walk the automaton together; those that it does not hold are merged exactly, all at once, a merge for
each word in a step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, settle, sliced
from joulegrid.llm.tokens import Splitter, byte_alphabet

#: Longer words are neither compiled nor merged in step with others.
LONG = 64


class Merges:
    """The merges of a BPE with word ends, over ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = byte_alphabet()[0]
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.radix = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {vocab[a] * self.radix + vocab[b]: (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        keys = sorted(self.rank)
        self.keys = np.array(keys, np.int64)
        self.ranks = np.array([self.rank[k][0] for k in keys], np.int64)
        self.made = np.array([self.rank[k][1] for k in keys], np.int64)

    def one(self, word: bytes) -> list[int]:
        """Ids of a word of any length, with a heap of possible merges: the least rank first, then the leftmost."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.rank.get(ids[i] * self.radix + ids[j])):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of many words: in each step, every unfinished word makes the merge of least rank, the leftmost of equals."""
        out: list[list[int]] = [[]] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.one(w)
        if not short:
            return out
        sizes = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        text = np.frombuffer(b"".join(words[k] for k in short), np.uint8)
        word = np.repeat(np.arange(len(short)), sizes)
        ids = self.inner[text]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[text[ends]]
        none = np.int64(1) << 62
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = np.full(len(ids), -1, np.int64)
            key[:-1] = np.where(word[1:] == word[:-1], ids[:-1] * self.radix + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            order = np.where(self.keys[at] == key, (self.ranks[at] << 32) | np.arange(len(ids)), none)
            best = np.minimum.reduceat(order, starts)
            ended = np.repeat(best == none, np.diff(np.append(starts, len(ids))))
            where = best[best != none] & 0xFFFFFFFF
            ids[where] = self.made[at[where]]
            keep = ~ended
            if ended.any():
                done.append((word[ended], ids[ended]))
            keep[where + 1] = False
            ids, word = ids[keep], word[keep]
        word, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        ids = ids[np.argsort(word, kind="stable")].tolist()
        stops = np.cumsum(np.bincount(word, minlength=len(short))).tolist()
        begin = 0
        for k, stop in zip(short, stops, strict=True):
            out[k] = ids[begin:stop]
            begin = stop
        return out


def minimal_automaton(words: Sequence[bytes]) -> tuple[list[dict[int, int]], list[bool], int]:
    """Arcs and finality by state, and the first state, of the minimal acyclic automaton of sorted distinct words."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]  # states along the last word
    last = b""

    def freeze(down_to: int) -> None:
        while len(path) > down_to + 1:
            state = path.pop()
            form = (final[state], tuple(arcs[state].items()))
            same = known.setdefault(form, state)
            arcs[path[-1]][last[len(path) - 1]] = same

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][byte] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = word
    freeze(0)
    return arcs, final, 0


def compile_lexicon(words: Sequence[str], merges: Merges) -> bytes:
    """The transducer as bytes: arc keys (state * 256 + byte), their targets and numbers, final states, and outputs."""
    texts = sorted({w.encode() for w in words if 0 < len(w.encode()) <= LONG})
    arcs, final, first = minimal_automaton(texts)
    reached, stack = {first: 0}, [first]
    while stack:
        for target in arcs[stack.pop()].values():
            if target not in reached:
                reached[target] = len(reached)
                stack.append(target)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        if state not in below:
            below[state] = final[state] + sum(count(t) for t in arcs[state].values())
        return below[state]

    rows = []
    for state, number in reached.items():
        before = int(final[state])
        for byte in sorted(arcs[state]):
            target = arcs[state][byte]
            rows.append((number * 256 + byte, reached[target], before))
            before += count(target)
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    ends = np.zeros(len(reached), bool)
    ends[[n for s, n in reached.items() if final[s]]] = True
    ids = merges.many(texts)
    parts = (table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), ends, np.cumsum([0, *map(len, ids)]), np.array([i for x in ids for i in x], np.int32))
    out = BytesIO()
    for p in parts:
        np.lib.format.write_array(out, np.ascontiguousarray(p), allow_pickle=False)
        out.write(b"\0" * (-out.tell() % 64))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, mapped into memory from a file of the worker that is unlinked at once."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.memory = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view, parts, at = BytesIO(self.memory), [], 0
        for _ in range(6):
            view.seek(at)
            np.lib.format.read_magic(view)
            shape, _, dtype = np.lib.format.read_array_header_1_0(view)
            parts.append(np.frombuffer(self.memory, dtype, shape[0], view.tell()))
            at = view.tell() + parts[-1].nbytes
            at += -at % 64
        self.keys, self.target, self.number, self.final, self.begin, self.ids = parts

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, or -1; all words take a step at a time."""
        n = len(words)
        place, sizes = np.full(n, -1, np.int64), np.fromiter(map(len, words), np.int64, n)
        if not n or not len(self.keys):
            return place
        text, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        on = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        state, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(on):
            key = state[on] * 256 + text[begin[on] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[at] == key
            on, at = on[held], at[held]
            state[on] = self.target[at]
            total[on] += self.number[at]
            step += 1
            ended = on[sizes[on] == step]
            ended = ended[self.final[state[ended]]]
            place[ended] = total[ended]
            on = on[sizes[on] > step]
        return place


class Coder:
    """Encodes and decodes whole texts as the tokenizers library does with the same file."""

    def __init__(self, path: str, compiled: bytes):
        self.split, self.merges, self.lexicon = Splitter(path), Merges(path), Lexicon(compiled)
        self.back = byte_alphabet()[1]
        vocabulary = self.split.library.get_vocab()
        self.token = [""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.token[i] = t
        self.decimal = [str(i) for i in range(len(self.token))]

    def keys(self, text: str) -> list[str]:
        """Words in order; a special token stands as U+0000 and its text, which no word can be."""
        found: list[str] = []
        for k, segment in enumerate(self.split.segments(text)):
            words = ["\0" + segment] if k % 2 else self.split.words(segment)
            if words is None:
                library = self.split.library
                pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(segment))
                words = [bytes(self.back[c] for c in p).decode() for p, _ in pieces]
            found = found + words if found else words
        return found

    def word_ids(self, words: list[str]) -> list[list[int]]:
        special = {"\0" + t: [i] for t, i in self.split.special.items()}
        texts = [b"" if w in special else w.encode() for w in words]
        place = self.lexicon.places(texts)
        unseen = [k for k, (p, t) in enumerate(zip(place.tolist(), texts, strict=True)) if p < 0 and t]
        merged = dict(zip(unseen, self.merges.many([texts[k] for k in unseen]), strict=True))
        begin, ids = self.lexicon.begin, self.lexicon.ids
        return [ids[begin[p] : begin[p + 1]].tolist() if p >= 0 else merged[k] if k in merged else special[w] for k, (p, w) in enumerate(zip(place.tolist(), words, strict=True))]

    def encode(self, texts: Sequence[str | None]) -> list[list[int]]:
        lists = [self.keys(t) if t else [] for t in texts]
        words = list(set().union(*lists))
        of = dict(zip(words, self.word_ids(words), strict=True))
        return [[i for w in x for i in of[w]] for x in lists]

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by a space: the file names no decoder, and special tokens are not skipped."""
        return " ".join(map(self.token.__getitem__, ids))

    def digests(self, texts: Sequence[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text."""
        lists = [self.keys(t) if t else [] for t in texts]
        words = list(set().union(*lists))
        ids = self.word_ids(words)
        decimal = {w: " ".join(map(self.decimal.__getitem__, x)) for w, x in zip(words, ids, strict=True)}
        decoded = {w: self.decode(x) for w, x in zip(words, ids, strict=True)}
        for x in lists:
            plain = " ".join(map(decimal.__getitem__, x))
            whole = " ".join(map(decoded.__getitem__, x))
            yield plain.count(" ") + 1 if plain else 0, hashlib.sha256(plain.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest()


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def word_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """How often each word stands in all documents; counted within tasks before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(tokenizer), Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for whole in it:
            for batch in sliced(whole, "text"):
                for text in batch.column("text").to_pylist():
                    for k, segment in enumerate(split.segments(text) if text else []):
                        if k % 2 == 0:
                            counts.update(split.words(segment) or ())
                if len(counts) > 500_000:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, lexicon_words: int = 32_768) -> bytes:
    """Compile the most frequent words of all documents, at most ``lexicon_words``.

    Words are taken by steps of their frequency (16 to a doubling): whole steps as far as they fit, and of the next one
    the words that a hash puts first. So the driver gets a histogram of steps, which is short for any corpus, and the
    chosen words, but no candidates that are not chosen.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    counts = settle(word_counts(docs, tokenizer).where(F.octet_length("word") <= LONG).withColumn("step", step))
    room, partly = lexicon_words, None
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("words")).collect(), reverse=True):
        if r["words"] > room:
            partly = r["step"]
            break
        room -= r["words"]
    whole = counts if partly is None else counts.where(F.col("step") > partly)
    words = [r["word"] for r in whole.select("word").collect()]
    if partly is not None:
        words += [r["word"] for r in counts.where(F.col("step") == partly).orderBy(F.xxhash64("word"), "word").limit(room).select("word").collect()]
    return compile_lexicon(words, Merges(tokenizer))


@lru_cache(maxsize=1)
def coder(path: str, compiled: bytes) -> Coder:
    return Coder(path, compiled)


def encode_documents(docs: DataFrame, tokenizer: str, compiled: bytes) -> DataFrame:
    """doc_id, ids (null text: empty list)."""
    held = docs.sparkSession.sparkContext.broadcast(compiled)

    def make():
        code = coder(tokenizer, held.value)
        return lambda b: pa.record_batch([b.column("doc_id"), pa.array(code.encode(b.column("text").to_pylist()), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, ids array<int>", "text")


def decode_documents(encoded: DataFrame, tokenizer: str, compiled: bytes) -> DataFrame:
    """doc_id, text as the library decodes the ids."""
    held = encoded.sparkSession.sparkContext.broadcast(compiled)

    def make():
        code = coder(tokenizer, held.value)
        return lambda b: pa.record_batch([b.column("doc_id"), pa.array([code.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str, lexicon_words: int = 32_768) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty ones, without ids. Repeated rows stay repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, tokenizer, lexicon_words))

    def make():
        code = coder(tokenizer, held.value)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, text = zip(*code.digests(b.column("text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            return pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text", 4 << 20)
