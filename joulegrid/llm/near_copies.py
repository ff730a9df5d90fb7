"""Near copies at a similarity of about 0.8: the Gray-order index over slices of wide SimHash fingerprints.

Texts that share 0.8 of their five-word shingles differ in about 15 % of the bits of their SimHashes, so a fingerprint
of 128 bits links at up to 26 (in the pipeline 30) differing bits (19 expected at 0.8, the rest for chance; unrelated texts differ in 64). No
index prunes well at such a distance in one piece. But such a pair has, in most cases, a slice of 16 bits with at most
one difference: sixteen overlapping slices are put first in turn, and each order is indexed like fingerprints are in
``simhash``: blocks in Gray order with shared-bit masks, cells of leading bits, groups dropped by their accumulated
differences, first in the slice and then in the whole. A pair at 0.8 is met with a probability of about 0.95, at 0.9 of
over 0.99. The width of a slice suits up to some hundred million texts; beyond, ``slice_bits`` should grow with the
logarithm of their number.

Fingerprints only name candidates: classes of linked fingerprints, with a somewhat wider limit. Texts that share a
passage come together there too, so within each such class the shingle sets themselves are compared, in blocks and pairs
of blocks whose sizes allow the similarity, and only pairs that really have it are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joulegrid.llm.common import batches, give_back, settle
from joulegrid.llm.simhash import LOWER, WORD, Forest, block_pairs, blocks, cell_bits, components, forest, gray_order, roots, with_contents

U = np.uint64
MARKS = ["high", "low", "content"]


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the distinct shingles in order; of fewer words than a shingle has, the hash of all."""
    text = text or ""
    words = WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))
    if not words:
        return np.zeros(0, U)
    grams = [" ".join(words)] if len(words) < shingle else list(map(" ".join, zip(*(words[k:] for k in range(shingle)))))  # noqa: B905
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], U))


def print_of(h: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits over the hashes; where they tie, the least hash decides. No hashes give zero."""
    if not len(h):
        return 0, 0
    mixed = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9)
    out = []
    for part in (h, mixed ^ (mixed >> U(32))):
        bits = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(bits), 1 << 15):
            ones += np.unpackbits(bits[k : k + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        first = np.unpackbits(bits[:1], axis=1, bitorder="little")[0].astype(np.int64)
        out.append(int(np.packbits(2 * ones + first > len(bits), bitorder="little").view("<u8")[0]))
    return out[0], out[1]


def wide_fingerprint(text: str | None, shingle: int = 5) -> tuple[int, int]:
    return print_of(shingle_set(text, shingle))


def marks(sets: list[np.ndarray]) -> list[pa.Array]:
    """high, low and content (a hash of the whole set) of shingle sets; few shingles can share a fingerprint."""
    f = np.array([(*print_of(h), xxhash.xxh3_64_intdigest(h.tobytes())) for h in sets], U).reshape(-1, 3)
    return [pa.array(f[:, k].copy().view(np.int64)) for k in range(3)]


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, high and low (the two words as signed longs), and content, which names the shingle set with them."""

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([b.column("doc_id"), *marks([shingle_set(t, shingle) for t in b.column("text").to_pylist()])], ["doc_id", *MARKS])

        return work

    return batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, high long, low long, content long", "text")


def turned(high: Column, low: Column, n: int) -> tuple[Column, Column]:
    """The 128 bits with the first ``n`` moved to the end."""
    if n >= 64:
        high, low, n = low, high, n - 64
    if n == 0:
        return high, low
    joined = lambda a, b: F.shiftleft(a, n).bitwiseOR(F.shiftrightunsigned(b, 64 - n))
    return joined(high, low), joined(low, high)


def near_copy_classes(marked: DataFrame, most: int = 26, slice_bits: int = 16, flips: int = 1, slices: int = 16, block: int = 1024) -> DataFrame:
    """high, low and root of each distinct fingerprint of (doc_id, high, low) rows; root names the class.

    Links name a fingerprint by the exclusive or of its words. Fingerprints of one name share a class, in which texts
    are compared anyhow, so that costs no result.
    """
    distinct = settle(marked.select("high", "low").distinct())
    bits = cell_bits(distinct.count(), block, slice_bits)
    stride = 128 // slices
    words = [turned(F.col("high"), F.col("low"), k * stride) for k in range(slices)]
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), h.alias("lead"), w.alias("rest")) for k, (h, w) in enumerate(words)])
    each = distinct.select(F.explode(turns).alias("t")).select("t.*").withColumn("gray", gray_order(F.col("lead")))
    leaves = blocks(each, ["lead", "rest"], bits, block)
    pairs = block_pairs(leaves, bits, most, flips, slice_bits)
    top = ((1 << slice_bits) - 1) << (64 - slice_bits)
    found = components(forest(pairs, leaves, 2, most, top, flips, stride))
    name = F.col("high").bitwiseXOR(F.col("low"))
    return settle(distinct.withColumn("node", name).join(found, "node", "left").select("high", "low", F.coalesce("root", "node").alias("root")))


def overlaps(sizes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """How many shingles the sets i < j have in common, exactly; the sets' shingles stand one after another."""
    m = len(sizes)
    order = np.argsort(shingles, kind="stable")
    held, owner = shingles[order], np.repeat(np.arange(m), sizes)[order]
    out = np.zeros((m, m), np.int64)
    if not len(held):
        return out
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    times = np.diff(np.append(starts, len(held)))
    for n in range(2, 9):
        at = owner[starts[times == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        out += np.bincount((at[:, i] * m + at[:, j]).ravel(), minlength=m * m).reshape(m, m)
    many, often = starts[times > 8], times[times > 8]
    for k in range(0, len(many), 4096):
        n = often[k : k + 4096]
        has = np.zeros((m, len(n)), np.float32)
        column = np.repeat(np.arange(len(n)), n)
        has[owner[np.repeat(many[k : k + 4096], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], column] = 1
        out += np.triu(has @ has.T, 1).astype(np.int64)
    return out


def set_blocks(sets: DataFrame, members: int, most_bytes: int) -> DataFrame:
    """(root, node, size, shingles) rows in blocks by root and size: root, block, least and greatest size, and contents."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held, total = None, [], 0

        def out() -> pa.RecordBatch:
            sizes = np.array([n for _, n, _ in held], np.int64)
            row = (root, int(sizes[0]), int(sizes[-1]), np.array([x for x, _, _ in held], np.int64).tobytes(), sizes.tobytes(), b"".join(x for _, _, x in held))
            types = (*[pa.int64()] * 3, *[pa.binary()] * 3)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["root", "least", "greatest", "nodes", "sizes", "shingles"])

        for b in it:
            for r, node, size, shingles in zip(*(b.column(c).to_pylist() for c in ("root", "node", "size", "shingles")), strict=True):
                if held and (r != root or len(held) >= members or total + len(shingles) > most_bytes):
                    yield out()
                    held, total = [], 0
                root = r
                held.append((node, size, shingles))
                total += len(shingles)
        if held:
            yield out()
        give_back()

    ordered = sets.repartitionByRange("root", "size", "node").sortWithinPartitions("root", "size", "node")
    schema = "root long, least long, greatest long, nodes binary, sizes binary, shingles binary"
    return settle(ordered.select("root", "node", "size", "shingles").mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id()))


def true_links(leaves: DataFrame, least: Fraction) -> DataFrame:
    """Spanning forests of the pairs of sets of a root whose Jaccard similarity is at least ``least``: (one, two) nodes."""
    node = leaves.select("root", "block", "least", "greatest")
    other = node.toDF("root", "two", "l", "g")
    fits = (F.col("least") * least.numerator <= F.col("g") * least.denominator) & (F.col("l") * least.numerator <= F.col("greatest") * least.denominator)
    pairs = node.join(other, "root").where((F.col("block") <= F.col("two")) & fits).select(F.col("block").alias("one"), "two", (F.col("block") == F.col("two")).alias("same"))
    parts = ["nodes", "sizes", "shingles"]
    with_both = with_contents(pairs, leaves.select(F.col("block").alias("one"), *parts), leaves.select(F.col("block").alias("two"), *[F.col(c).alias(f"{c}_two") for c in parts]))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for batch in it:
            for k in range(batch.num_rows):
                ends = ("",) if batch.column("same")[k].as_py() else ("", "_two")
                nodes, sizes, shingles = (
                    np.concatenate([np.frombuffer(batch.column(f"{c}{end}")[k].as_buffer(), t) for end in ends])
                    for c, t in zip(parts, (np.int64, np.int64, U), strict=True)
                )
                both = overlaps(sizes, shingles)
                x, y = np.nonzero(both * (least.numerator + least.denominator) >= least.numerator * (sizes[:, None] + sizes[None]))
                label = roots(len(nodes), x[x < y], y[x < y])
                tied = np.flatnonzero(label != np.arange(len(nodes)))
                if len(tied):
                    trees.add(nodes[tied], nodes[label[tied]])
        yield from trees.links()
        give_back()

    return settle(with_both.select("same", *parts, *[f"{c}_two" for c in parts]).mapInArrow(search, "one long, two long"), None)


def verified_classes(docs: DataFrame, marked: DataFrame, candidates: DataFrame, shingle: int = 5, least: Fraction = Fraction(4, 5), members: int = 128, most_bytes: int = 1 << 17) -> DataFrame:
    """high, low, content, root and component_id (the class's least doc_id) of each distinct shingle set of ``docs``.

    ``marked`` has the fingerprints of ``docs``, ``candidates`` the classes of fingerprints within which sets are compared.
    Sets are numbered, so that no two share a name.
    """
    distinct = marked.groupBy(*MARKS).agg(F.min("doc_id").alias("first_doc"))
    named = settle(distinct.join(candidates, ["high", "low"]).select(*MARKS, "first_doc", "root", F.monotonically_increasing_id().alias("node")))
    several = named.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    open_ = settle(named.join(several, "root", "left_semi"))
    wanted = open_.select(F.col("first_doc").alias("wanted")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            return pa.record_batch([*marks(sets), pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], [*MARKS, "size", "shingles"])

        return work

    # An id may stand in several rows: their sets tell which are meant.
    made = batches(texts.select("text"), make, "high long, low long, content long, size long, shingles binary", "text")
    sets = settle(made.join(open_.select(*MARKS, "node", "root"), MARKS).select("node", "root", "size", "shingles").dropDuplicates(["node"]))
    found = components(true_links(set_blocks(sets, members, most_bytes), least)).withColumnRenamed("root", "class")
    rooted = settle(named.join(found, "node", "left").select(*MARKS, "first_doc", F.coalesce("class", "node").alias("root")))
    first = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(first, "root").select(*MARKS, "root", "component_id")


def keep_one_of_each(docs: DataFrame, most: int = 26, shingle: int = 5, least: Fraction = Fraction(3, 4), slack: int = 4) -> DataFrame:
    """Rows of ``docs``, all columns as they are: of each group of near copies the row with its least doc_id.

    Texts are compared where fingerprints differ in at most ``most`` + ``slack`` bits, and linked if the Jaccard
    similarity of their shingle sets is ``least`` or more. Null texts and texts without words are one group. Where several rows have that id (repeated rows, or a group without ids), one of them stays.
    """
    marked = settle(wide_fingerprints(docs, shingle))
    held = verified_classes(docs, marked, near_copy_classes(marked, most + slack), shingle, least)
    # Ids and marks of the rows that stay are known before any text is moved.
    first = marked.join(held, MARKS).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = settle(first.groupBy("root", F.col("doc_id").alias("keep_id")).agg(F.min(F.struct(*MARKS)).alias("keep_print")))
    repeated = settle(marked.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("n")).where("n > 1"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if repeated.isEmpty():
        return rows.join(chosen, kept, "left_semi").select("row.*")
    # An id that stands in several rows does not tell which of them stays; their marks do.
    is_again = F.col("doc_id").eqNullSafe(F.col("again"))
    once = rows.join(repeated, is_again, "left_anti").join(chosen, kept, "left_semi").select("row.*")
    texts = rows.join(repeated, is_again, "left_semi")
    same = (F.struct(*MARKS) == F.col("keep_print")) & kept
    return once.union(marked_rows(texts, shingle).join(chosen, same).dropDuplicates(["root"]).select("row.*"))


def marked_rows(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, text) rows with high, low and content in place of the text."""
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in ("doc_id", *MARKS)]])

    def make():
        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([b.column("row"), b.column("doc_id"), *marks([shingle_set(t, shingle) for t in b.column("text").to_pylist()])], ["row", "doc_id", *MARKS])

        return work

    return batches(rows, make, schema, "text")
