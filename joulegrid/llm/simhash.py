"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and components of linked documents.

Distinct fingerprints are sorted by Gray rank and cut into blocks of bounded size, so neighbours in a block share most
bits. A block is a leaf of the index: the bits that all its fingerprints share are factored out into a mask and a
pattern. Upper nodes are the leading bits of the fingerprint (a cell, a whole range of Gray ranks), and within a block
groups of a few fingerprints have masks and patterns of their own. A search carries the number of differing shared bits
down and drops a cell, block or group as soon as it exceeds the limit. Pairs of blocks are found by equality of cells
with at most ``most`` flipped bits, and each pair is one small piece of work, so a large group of near copies is many
blocks rather than one task. From each pair only a spanning forest of its links goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, give_back, settle

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLOCK = "cell long, mask long, pattern long, words binary"


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included."""
    words = WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    hash_of = xxhash.xxh64_intdigest
    if len(words) < shingle:
        grams: list[str] = [" ".join(words)]
    else:
        grams = list(map(" ".join, zip(*(words[k:] for k in range(shingle)))))  # noqa: B905
    return np.array([hash_of(g, 42) for g in grams], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if over half the shingle hashes have it; no words give zero."""
    h = shingle_hashes(text or "", shingle)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint, its 64 bits as a signed long. A null or empty text has fingerprint zero."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            f = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            return pa.record_batch([b.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fingerprint"])

        return work

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, fingerprint long", "text")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each 64-bit value in the reflected Gray sequence: the inverse of r ^ (r >> 1)."""
    r = bits.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(shift))
    return r


def gray_order(word: Column) -> Column:
    """The same place as a signed long that sorts alike."""
    for shift in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, shift))
    return word.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(f: np.ndarray) -> tuple[int, int]:
    """Mask of the bits in which all values agree, and the values' bits under it."""
    mask = ~(np.bitwise_or.reduce(f) ^ np.bitwise_and.reduce(f))
    return int(mask), int(f[0] & mask)


def blocks(each: DataFrame, words: list[str], bits: int, size: int = 1024) -> DataFrame:
    """Leaves of the index: runs of at most ``size`` fingerprints in Gray order with equal leading ``bits``.

    ``each`` has turn (which of several orders), gray (the place in it) and the words of 64 bits, the leading one first.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows: list[tuple] = []

        def flush(end: bool) -> None:
            t = np.concatenate(held)
            held.clear()
            key = (t[:, 0] << np.uint64(48)) | (t[:, 1] >> np.uint64(64 - bits) if bits else np.uint64(0))
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(t)]
            for a, b in zip(edges, edges[1:], strict=False):
                while a < b and (end or b < len(t) or b - a >= size):
                    part = np.ascontiguousarray(t[a : min(a + size, b), 1:])
                    signed = np.array(shared_bits(part[:, 0]), np.uint64).view(np.int64).tolist()
                    rows.append((int(key[a]), *signed, part.tobytes()))
                    a = min(a + size, b)
                if a < b:
                    held.append(t[a:b])

        def out() -> pa.RecordBatch:
            types = (*[pa.int64()] * 3, pa.binary())
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["cell", "mask", "pattern", "words"])
            rows.clear()
            return batch

        for b in it:
            if b.num_rows:
                held.append(np.stack([b.column("turn").to_numpy().astype(np.uint64), *(b.column(c).to_numpy().view(np.uint64) for c in words)], axis=1))
                flush(False)
                if rows:
                    yield out()
        if held:
            flush(True)
        if rows:
            yield out()

    ordered = each.repartitionByRange("turn", "gray").sortWithinPartitions("turn", "gray")
    return settle(ordered.select("turn", *words).mapInArrow(cut, BLOCK).withColumn("block", F.monotonically_increasing_id()))


def block_pairs(leaves: DataFrame, bits: int, most: int = 2, flips: int | None = None, lead: int = 64) -> DataFrame:
    """Pairs of blocks that can hold fingerprints within ``most`` bits, each pair once, a block with itself included.

    Cells are equal up to ``flips`` flipped leading bits (by default ``most``); then the differing bits under both masks
    are counted, in the first ``lead`` bits at most ``flips`` and in the whole word at most ``most``.
    """
    flips = most if flips is None else flips
    moves = [0, *(sum(1 << b for b in c) for k in range(1, flips + 1) for c in combinations(range(bits), k))]
    node = leaves.select("cell", "block", "mask", "pattern")
    probe = node.select(
        F.explode(F.transform(F.array(*map(F.lit, moves)), lambda x: F.col("cell").bitwiseXOR(x.cast("long")))).alias("cell"),
        F.col("block").alias("one"), F.col("mask").alias("one_mask"), F.col("pattern").alias("one_pattern"),
    )
    differ = F.col("pattern").bitwiseXOR(F.col("one_pattern")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("one_mask"))
    near = (F.col("one") <= F.col("block")) & (F.bit_count(differ) <= most)
    if lead < 64:
        near = near & (F.bit_count(differ.bitwiseAND(F.lit(-(1 << (64 - lead))).cast("long"))) <= flips)
    return probe.join(node, "cell").where(near).select("one", F.col("block").alias("two"), "cell")


def join_up(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give all connected places their least label, by hooking roots to lesser ones and halving paths."""
    while True:
        lx, ly = label[x], label[y]
        open_ = lx != ly
        if not open_.any():
            return
        x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while (label[label] != label).any():
            label[:] = label[label]


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least connected place of each of n places."""
    label = np.arange(n)
    join_up(label, x, y)
    return label


class Forest:
    """A spanning forest of named links as they come: what is held grows with the names, not with the links."""

    def __init__(self, most: int = 1 << 18):
        self.one, self.two, self.held, self.most = [], [], 0, most

    def add(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one.append(one)
        self.two.append(two)
        self.held += len(one)
        if self.held > self.most:
            self.thin()
            self.most = max(self.most, 2 * self.held)

    def thin(self) -> None:
        x, y = np.concatenate(self.one), np.concatenate(self.two)
        names, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        label = roots(len(names), place[: len(x)], place[len(x) :])
        tied = np.flatnonzero(label != np.arange(len(names)))
        self.one, self.two, self.held = [names[tied]], [names[label[tied]]], len(tied)

    def links(self, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """one and two, two < one."""
        if self.held:
            self.thin()
            for k in range(0, self.held, rows):
                yield pa.record_batch([pa.array(self.one[0][k : k + rows]), pa.array(self.two[0][k : k + rows])], ["one", "two"])


def groups(t: np.ndarray, size: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Masks and patterns of runs of ``size`` fingerprints, rows of words."""
    starts = np.arange(0, len(t), size)
    mask = ~(np.bitwise_or.reduceat(t, starts, axis=0) ^ np.bitwise_and.reduceat(t, starts, axis=0))
    return mask, t[starts] & mask


def tied(a: np.ndarray, b: np.ndarray, most: int = 2, top: int = 0, flips: int = 0, size: int = 32) -> np.ndarray:
    """The least place linked to each place of both blocks, b's after a's (of one block, if they are the same object).

    Rows of words are linked at ``most`` differing bits, of which ``flips`` may be under ``top`` in the leading word.
    Groups are dropped whole first; links of a group are folded in at once, so that dense blocks need no more room.
    """
    after = 0 if a is b else len(a)
    label = np.arange(len(b) + after)
    (am, ap), (bm, bp) = groups(a, size), groups(b, size)
    differ = (ap[:, None] ^ bp[None]) & am[:, None] & bm[None]
    near = np.bitwise_count(differ).sum(axis=2) <= most
    if top:
        near &= np.bitwise_count(differ[:, :, 0] & np.uint64(top)) <= flips
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        columns = (np.flatnonzero(near[i])[:, None] * size + np.arange(size)).ravel()
        columns = columns[columns < len(b)]
        rows = np.arange(i * size, min((i + 1) * size, len(a)))
        apart = label[rows][:, None] != label[columns + after][None]
        if not apart.any():
            continue
        differ_lead = a[rows, None, 0] ^ b[None, columns, 0]
        hit = apart & (np.bitwise_count(differ_lead & np.uint64(top)) <= flips) if top else apart
        x, y = np.nonzero(hit)
        whole = np.bitwise_count(a[rows[x]] ^ b[columns[y]]).sum(axis=1) <= most
        join_up(label, rows[x[whole]], columns[y[whole]] + after)
    return label


def names_of(t: np.ndarray, turned: int = 0) -> np.ndarray:
    """A name for each fingerprint that is the same in every order: its one word, or its two words' difference turned back."""
    if t.shape[1] == 1:
        return t[:, 0].view(np.int64) if t.flags.c_contiguous else t[:, 0].copy().view(np.int64)
    mixed, n = t[:, 0] ^ t[:, 1], turned % 64
    return ((mixed >> np.uint64(n)) | (mixed << np.uint64(64 - n)) if n else mixed).view(np.int64)


def with_contents(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs (one, two) beside the contents of both blocks.

    Blocks are of bounded size and in no more pairs than their cell has blocks, so hashing deals them out evenly, and
    partitions need not be split again, which would read the other side once for each part.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_one = pairs.repartition(n, "one").join(one.repartition(n, "one"), "one")
    return with_one.repartition(n, "two").join(two.repartition(n, "two"), "two")


def forest(pairs: DataFrame, leaves: DataFrame, words: int = 1, most: int = 2, top: int = 0, flips: int = 0, stride: int = 0) -> DataFrame:
    """Links of all pairs of blocks, thinned to a spanning forest in each task: one and two, two < one."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for batch in it:
            for k in range(batch.num_rows):
                a = b = np.frombuffer(batch.column("p")[k].as_buffer(), np.uint64).reshape(-1, words)
                if batch.column("one")[k] != batch.column("two")[k]:
                    b = np.frombuffer(batch.column("q")[k].as_buffer(), np.uint64).reshape(-1, words)
                label = tied(a, b, most, top, flips)
                linked = np.flatnonzero(label != np.arange(len(label)))
                if len(linked):
                    names = names_of(a if a is b else np.concatenate([a, b]), (batch.column("cell")[k].as_py() >> 48) * stride)
                    trees.add(names[linked], names[label[linked]])
        yield from trees.links()
        give_back()

    with_both = with_contents(pairs, leaves.select(F.col("block").alias("one"), F.col("words").alias("p")), leaves.select(F.col("block").alias("two"), F.col("words").alias("q")))
    return settle(with_both.select("one", "two", "cell", "p", "q").mapInArrow(search, "one long, two long"), None)


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) for every node of settled links, by large-star and small-star rounds.

    Least neighbours are summed up before the shuffle and written out, so the join with them can split hot nodes.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        around = pairs.select(F.col("one").alias("u"), F.col("two").alias("v"))
        if large:
            around = around.union(around.select("v", "u"))
        else:
            around = around.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = settle(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        joined = around.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("one"), F.col("m").alias("two"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("one"), F.col("m").alias("two")), F.struct(F.col("u").alias("one"), F.col("m").alias("two")))).alias("e")).select("e.*")
        return settle(out.where("one <> two").distinct())

    def sums(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("one", "two").cast("decimal(38,0)"))).first())

    pairs, before, now = edges, (), sums(edges)
    while now != before and now[0]:
        before = now
        pairs = star(star(pairs, True), False)
        now = sums(pairs)
    return pairs.select(F.col("one").alias("node"), F.col("two").alias("root"))


def classes(marked: DataFrame, most: int = 2, block: int = 1024) -> DataFrame:
    """fingerprint, root and component_id for each distinct fingerprint of (doc_id, fingerprint) rows.

    root is the component's least fingerprint and names the class; component_id is its least doc_id, null if all are.
    """
    distinct = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")))
    bits = cell_bits(distinct.count(), block)
    each = distinct.select(F.lit(0).alias("turn"), gray_order(F.col("fingerprint")).alias("gray"), "fingerprint")
    leaves = blocks(each, ["fingerprint"], bits, block)
    found = components(forest(block_pairs(leaves, bits, most), leaves, 1, most))
    rooted = settle(
        distinct.join(found, distinct["fingerprint"] == found["node"], "left")
        .select("fingerprint", "first_doc", F.coalesce("root", "fingerprint").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return settle(rooted.join(least, "root").select("fingerprint", "root", "component_id"))


def cell_bits(n: int, block: int, most: int = 48) -> int:
    """So many leading bits that an evenly filled cell holds about a block of n fingerprints."""
    return min(most, max(0, int(np.ceil(np.log2(max(1, n / block))))))


def near_duplicates(docs: DataFrame, most: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row.

    Rows with one doc_id keep a row each; a null doc_id takes part but names no component while another id is there.
    """
    marked = settle(fingerprints(docs, shingle))
    held = classes(marked, most)
    return marked.join(held, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
