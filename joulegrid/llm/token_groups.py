"""N-gram Jaccard join through a token-group matrix.

Equal shingle sets are one set. What is left is searched for pairs at or above the similarity in three steps:

* Candidates lose no pair. Sizes are cut into classes so narrow that partners lie in one class or the next. For a pair of
  classes the largest possible symmetric difference D is known; tokens are dealt to D + 1 + ``SPARE`` parts by hash, so
  partners agree in 1 + ``SPARE`` parts at least. A set's signatures name its parts' contents. A part with no token says
  nothing and gets no signature, unless a set has more than ``SPARE`` of them. As partners agree in more parts than one,
  a set leaves out its most frequent signatures, as many as it has parts to spare: of what two partners have in common
  the rarest one stays with both. So passages that very many sets share name no candidates. Sets without a remaining
  signature in common with another set are done.
* Sets that are left are sorted by their least token, which brings similar ones together, and cut into groups of bounded
  size. A group is stored as a row of the token-group matrix: the union of its tokens, and who has each.
* A set is a query to the groups in which a signature of it stands. The query's overlap with the union bounds its overlap
  with every member; only if the bound allows the similarity is the group opened and each member compared exactly.

First every query goes to one group of each of its signatures, which joins up what is really similar. A signature all of
whose sets are of one component by then needs no more; only the rest is compared group by group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joulegrid.llm.common import batches, give_back, settle
from joulegrid.llm.simhash import Forest, components, join_up

U = np.uint64
SPARE = 8
#: Bits of the filter of wanted ids that is broadcast: 16 MiB, whatever the number of ids.
FILTER_BITS = 1 << 27


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values in which every bit depends on all."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Words(dict):
    """Hashes of words seen by a task, forgotten when there are too many."""

    def __init__(self, seed: int, most: int = 1 << 20):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def tokens_of(text: bytes | None, words: Words, shingle: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of lower-cased words; of fewer words than a shingle has, of all of them.

    Of bytes, ``lower`` turns A-Z only and ``split`` cuts at the six ASCII blanks only, just as words are defined.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, U)
    if len(found) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), words.seed + 1)], U)
    h = np.fromiter(map(words.__getitem__, found), U, len(found))
    total = np.zeros(len(h) - shingle + 1, U)
    for k in range(shingle):
        total = total * U(0x9E3779B97F4A7C15) + turned(h[k : len(h) - shingle + 1 + k], 7 * k + 1)
    return np.unique(mixed(total))


class Signatures:
    """Signatures of sets for a least similarity; size classes come from a rule and are made as far as needed."""

    def __init__(self, least: Fraction):
        self.least = least
        self.bounds = [1, 2]

    def class_of(self, size: int) -> int:
        """The class c with bounds[c] <= size < bounds[c + 1]."""
        while self.bounds[-1] <= size + 1:
            self.bounds.append(self.bounds[-1] * self.least.denominator // self.least.numerator + 1)
        return bisect.bisect_right(self.bounds, size) - 1

    def parts(self, level: int) -> int:
        """Parts for pairs whose smaller set is of the class ``level``; 0 if only equal sets can be partners."""
        p, q = self.least.numerator, self.least.denominator
        self.class_of(self.bounds[-1] + 1)
        a = self.bounds[level + 1] - 1
        most = (a + a * q // p) * (q - p) // (q + p)
        return most + 1 + SPARE if most else 0

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, and of each its level's parity (a set has two levels) times 16 plus how many its level may leave out."""
        if not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int8)
        own = self.class_of(len(tokens))
        out, of = [], []
        again = mixed(tokens ^ U(0x2545F4914F6CDD1D))
        low, high = (again & U(0xFFFFFFFF)).astype(np.float64), (again >> U(32)).astype(np.float64)
        for level in (own, own - 1):
            m = self.parts(level) if level >= 0 else 0
            if not m:
                continue
            part = (tokens % U(m)).astype(np.int64)
            count = np.bincount(part, minlength=m)
            held = np.flatnonzero(count)
            content = (np.bincount(part, high, m).astype(U) << U(32)) + np.bincount(part, low, m).astype(U)
            place = mixed(np.arange(m, dtype=U) + (U(level) << U(32)))
            out.append(mixed(content[held] ^ place[held]))
            if m - len(held) > SPARE:
                out.append(mixed(place[count == 0]))
            n = sum(map(len, out)) - sum(map(len, of))
            of.append(np.full(n, 16 * (level % 2) + max(0, SPARE - (m - len(held))), np.int8))
        return (np.concatenate(out).view(np.int64), np.concatenate(of)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int8))


def marks(docs: DataFrame, shingle: int, least: Fraction, seed: int) -> DataFrame:
    """doc_id, n_shingles, name (a hash of the set) and signatures of every row; those of a set stand once for each task or more."""

    def make():
        words, sign, seen = Words(seed), Signatures(least), set()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sizes, names, signs, levels = [], [], [], []
            for text in b.column("text").to_pylist():
                tokens = tokens_of(text, words, shingle)
                name = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed)
                sizes.append(len(tokens))
                names.append(name)
                made = (None, None) if name in seen else sign(tokens)
                signs.append(made[0])
                levels.append(made[1])
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(name)
            columns = [pa.array(sizes, pa.int64()), pa.array(np.array(names, U).view(np.int64)), pa.array(signs, pa.list_(pa.int64())), pa.array(levels, pa.list_(pa.int8()))]
            return pa.record_batch([b.column("doc_id"), *columns], ["doc_id", "n_shingles", "name", "signatures", "levels"])

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return settle(batches(rows, make, "doc_id long, n_shingles long, name long, signatures array<long>, levels array<tinyint>", "text"))


def open_postings(marked: DataFrame) -> DataFrame:
    """(signature, name) of the signatures that sets keep and more than one set has."""
    each = marked.select(F.explode(F.arrays_zip("signatures", "levels")).alias("s"), "name").select(F.col("s.signatures").alias("signature"), "name", F.col("s.levels").alias("of"))
    once = W.partitionBy("signature")
    several = each.withColumn("_low", F.min("name").over(once)).withColumn("_high", F.max("name").over(once)).withColumn("times", F.count("*").over(once))
    several = several.where("_low <> _high").select("signature", "name", "of", "times").distinct()
    # The order of signatures is one for all sets: by how often they stand, then by themselves.
    ranked = several.withColumn("_rank", F.row_number().over(W.partitionBy("name", F.col("of") >= 16).orderBy(F.desc("times"), "signature")))
    kept = settle(ranked.where(F.col("_rank") > F.col("of") % 16).select("signature", "name"))
    shared = kept.groupBy("signature").agg(F.min("name").alias("_low"), F.max("name").alias("_high")).where("_low <> _high").select("signature")
    return settle(kept.join(shared, "signature", "left_semi"))


def places(ids: np.ndarray) -> list[np.ndarray]:
    """Two places of each id in the filter."""
    h = mixed(ids.view(U) ^ U(0x9E3779B97F4A7C15))
    return [(h % U(FILTER_BITS)).astype(np.int64), (mixed(h) % U(FILTER_BITS)).astype(np.int64)]


def wanted_filter(ids: DataFrame) -> np.ndarray:
    """A filter of bits that every id of the column ``wanted`` passes, and few others: 16 MiB at most, made of ``FILTER_BITS`` / 8 bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = np.concatenate(places(b.column("wanted").to_numpy(zero_copy_only=False).astype(np.int64)))
            byte, inverse = np.unique(at >> 3, return_inverse=True)
            bits = np.zeros(len(byte), np.int64)
            np.bitwise_or.at(bits, inverse, np.int64(1) << (at & 7))
            yield pa.record_batch([pa.array(byte), pa.array(bits)], ["byte", "bits"])

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    held = ids.where("wanted IS NOT NULL").mapInArrow(run, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[held["byte"].to_numpy()] = held["bits"].to_numpy()
    return out


def open_sets(docs: DataFrame, marked: DataFrame, postings: DataFrame, shingle: int, seed: int) -> DataFrame:
    """name, first (its least token) and tokens of the sets that have a signature in common with another.

    They are made again from the texts of their least ids. Which ids these are, a filter of fixed size tells; what passes
    it without being wanted is dropped by its name, so no text is shuffled. A set whose ids are all null is looked for
    among rows without an id.
    """
    spark = docs.sparkSession
    wanted = settle(postings.select("name").distinct().join(marked.groupBy("name").agg(F.min("doc_id").alias("wanted")), "name"))
    sent = spark.sparkContext.broadcast(wanted_filter(wanted.select("wanted")))

    def make():
        words = Words(seed)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = b.column("doc_id")
            one, two = places(ids.fill_null(0).to_numpy())
            passed = (sent.value[one >> 3] >> (one & 7)) & (sent.value[two >> 3] >> (two & 7)) & 1
            chosen = np.flatnonzero((passed > 0) | ids.is_null().to_numpy(zero_copy_only=False))
            sets = [tokens_of(t, words, shingle) for t in b.column("text").take(pa.array(chosen)).to_pylist()]
            names = np.array([xxhash.xxh3_64_intdigest(t.tobytes(), seed) for t in sets], U).view(np.int64)
            firsts = np.array([t[0] if len(t) else 0 for t in sets], U).view(np.int64)
            return pa.record_batch([pa.array(names), pa.array(firsts), pa.array([t.tobytes() for t in sets], pa.binary())], ["name", "first", "tokens"])

        return work

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    made = batches(rows, make, "name long, first long, tokens binary", "text")
    return settle(made.join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"]))


class Group:
    """A row of the matrix: who its members are, the union of their tokens in order, and who has each of these."""

    def __init__(self, names: np.ndarray, sizes: np.ndarray, union: np.ndarray, times: np.ndarray, owners: np.ndarray):
        self.names, self.sizes, self.union, self.owners = names, sizes, union, owners
        self.starts = np.concatenate([[0], np.cumsum(times)])

    @classmethod
    def of(cls, names: list[int], sets: list[np.ndarray]) -> Group:
        every = np.concatenate(sets) if sets else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        union, times = np.unique(every, return_counts=True)
        return cls(np.array(names, np.int64), np.array([len(s) for s in sets], np.int64), union, times, owner[order])

    def packed(self) -> list[bytes]:
        return [self.names.tobytes(), self.sizes.tobytes(), self.union.tobytes(), np.diff(self.starts).astype(np.int32).tobytes(), self.owners.tobytes()]

    @classmethod
    def read(cls, parts: list[pa.Buffer]) -> Group:
        return cls(*(np.frombuffer(p, t) for p, t in zip(parts, (np.int64, np.int64, U, np.int32, np.int32), strict=True)))

    def member(self, k: int) -> np.ndarray:
        return np.repeat(self.union, np.diff(self.starts))[self.owners == k]

    def partners(self, tokens: np.ndarray, least: Fraction) -> np.ndarray:
        """Members at or above the similarity to a set: none are looked at if the overlap with the union is too small."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        met = at[self.union[at] == tokens] if len(self.union) else at[:0]
        if not len(met) or len(met) * least.denominator < least.numerator * len(tokens):
            return np.zeros(0, np.int64)
        begin, times = self.starts[met], self.starts[met + 1] - self.starts[met]
        place = np.repeat(begin - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        both = np.bincount(self.owners[place], minlength=len(self.names))
        return np.flatnonzero(both * least.denominator >= least.numerator * (len(tokens) + self.sizes - both))


GROUP = ["names", "sizes", "union", "times", "owners"]


def matrix(sets: DataFrame, members: int = 128, most_bytes: int = 1 << 18, task_bytes: int = 16 << 20) -> DataFrame:
    """Groups of similar sets, in order of their least tokens: group, its parts, and members as an array.

    A task cuts about ``task_bytes`` of neighbouring range partitions, so that groups are full however many these are.
    """
    total = sets.agg(F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()[0]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = [], [], 0

        def out() -> pa.RecordBatch:
            row = [*Group.of(names, held).packed(), list(names)]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, [*[pa.binary()] * 5, pa.list_(pa.int64())], strict=True)], [*GROUP, "members"])

        for b in it:
            for name, tokens in zip(b.column("name").to_pylist(), b.column("tokens"), strict=True):
                t = np.frombuffer(tokens.as_buffer(), U)
                if held and (len(held) >= members or size + t.nbytes > most_bytes):
                    yield out()
                    names, held, size = [], [], 0
                names.append(name)
                held.append(t)
                size += t.nbytes
        if held:
            yield out()
        give_back()

    ordered = sets.repartitionByRange("first", "name").sortWithinPartitions("first", "name").coalesce(max(1, -(-total // task_bytes)))
    made = ordered.select("name", "tokens").mapInArrow(cut, ", ".join(f"{c} binary" for c in GROUP) + ", members array<long>")
    return settle(made.withColumn("group", F.monotonically_increasing_id()))


def inner_links(groups: DataFrame, least: Fraction) -> DataFrame:
    """Links within each group, as a spanning forest: one and two, two < one."""

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest()
        for b in it:
            for k in range(b.num_rows):
                g = Group.read([b.column(c)[k].as_buffer() for c in GROUP])
                label = np.arange(len(g.names))
                for i in range(len(g.names)):
                    found = g.partners(g.member(i), least)
                    join_up(label, np.full(len(found), i), found)
                tied = np.flatnonzero(label != np.arange(len(label)))
                if len(tied):
                    trees.add(g.names[tied], g.names[label[tied]])
        yield from trees.links()
        give_back()

    return groups.select(*GROUP).mapInArrow(search, "one long, two long")


def outer_links(asked: DataFrame, sets: DataFrame, groups: DataFrame, least: Fraction, together: int = 256) -> DataFrame:
    """Links of (name, group) queries with the group's members, as a spanning forest of each task.

    Up to about ``together`` queries of a group go with one copy of it, so that a group that many ask for is many tasks.
    """
    several = asked.groupBy("group").agg(F.ceil(F.count("*") / together).alias("parts"))
    dealt = asked.join(several, "group").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")))
    queries = dealt.join(sets.select("name", "tokens"), "name").select("group", "part", F.lit(1).alias("turn"), "name", "tokens", *[F.lit(None).cast("binary").alias(c) for c in GROUP])
    copies = groups.join(several, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("name"), F.lit(None).cast("binary").alias("tokens"), *GROUP)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, g = Forest(), None
        for b in it:
            for k, turn in enumerate(b.column("turn").to_pylist()):
                if turn == 0:
                    g = Group.read([b.column(c)[k].as_buffer() for c in GROUP])
                    continue
                found = g.partners(np.frombuffer(b.column("tokens")[k].as_buffer(), U), least)
                if len(found):
                    name = np.full(len(found), b.column("name")[k].as_py(), np.int64)
                    trees.add(np.maximum(name, g.names[found]), np.minimum(name, g.names[found]))
        yield from trees.links()
        give_back()

    both = queries.unionByName(copies).repartition("group", "part").sortWithinPartitions("group", "part", "turn")
    return both.select("turn", "name", "tokens", *GROUP).mapInArrow(search, "one long, two long")


def asked_still(left: DataFrame, frequent: int) -> DataFrame:
    """(name, group) queries for (signature, name, group, root) rows: of two groups the later one asks.

    Nobody asks for sets that are of its component already. A signature of over ``frequent`` sets is joined by group
    alone, and a set with such a signature asks all groups that its own then meets: a few more queries, which the unions
    answer, in place of a row for each set and group.
    """
    ends = [F.min("root").alias("_low"), F.max("root").alias("_high")]
    others = [F.col("group").alias("other"), F.col("_low").alias("_l"), F.col("_high").alias("_h")]
    sizes = left.groupBy("signature").agg(F.count("*").alias("_n"))
    sized = settle(left.join(sizes, "signature"))
    few, many = sized.where(F.col("_n") <= frequent), sized.where(F.col("_n") > frequent)
    apart = "other < group AND NOT (_l = _h AND {0})"
    single = few.join(few.groupBy("signature", "group").agg(*ends).select("signature", *others), "signature").where(apart.format("_l = root")).select("name", F.col("other").alias("group"))
    groups = many.groupBy("signature", "group").agg(*ends)
    pairs = groups.join(groups.select("signature", *others), "signature").where(apart.format("_l = _low AND _l = _high")).select("group", "other").distinct()
    common = many.select("name", "group").distinct().join(pairs, "group").select("name", F.col("other").alias("group"))
    return single.union(common).distinct()


def linked_sets(docs: DataFrame, marked: DataFrame, shingle: int, least: Fraction, seed: int, frequent: int = 32) -> DataFrame:
    """node and root of every set that is linked to another."""
    postings = open_postings(marked)
    sets = open_sets(docs, marked, postings, shingle, seed)
    groups = matrix(sets)
    members = groups.select(F.explode("members").alias("name"), "group")
    placed = settle(postings.join(members, "name"))
    one = placed.groupBy("signature").agg(F.min("group").alias("chosen"))
    first = settle(placed.join(one, "signature").where("group <> chosen").select("name", F.col("chosen").alias("group")).distinct())
    links = settle(inner_links(groups, least).union(outer_links(first, sets, groups, least)).where("one <> two").distinct())
    roots = components(links)
    rooted = settle(placed.join(roots, F.col("name") == F.col("node"), "left").select("signature", "name", "group", F.coalesce("root", "name").alias("root")))
    apart = rooted.groupBy("signature").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("signature")
    left = settle(rooted.join(apart, "signature", "left_semi"))
    rest = asked_still(left, frequent)
    more = outer_links(settle(rest.join(first, ["name", "group"], "left_anti")), sets, groups, least)
    return components(settle(links.union(more).where("one <> two").distinct()))


def jaccard_join(docs: DataFrame, least: Fraction = Fraction(9, 10), shingle: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: rows with ``least`` or more of their shingles in common are linked.

    Shingles are compared by 64-bit hashes of their words. A null text, or one without words, has no shingles and is
    linked with nothing, not even its like: its component is its own doc_id. Rows of one doc_id keep a row each; a null
    doc_id takes part but names no component while another id is there. Repeated rows are equal sets. Other columns are
    not read. Sets are named by a hash of 64 bits; should two differing sets get one name, all starts anew with another.
    """
    seed = 0
    while True:
        marked = marks(docs, shingle, least, seed)
        clash = marked.where("signatures IS NOT NULL").groupBy("name").agg(F.min("n_shingles").alias("a"), F.max("n_shingles").alias("b"), F.min(F.xxhash64("signatures")).alias("c"), F.max(F.xxhash64("signatures")).alias("d"))
        if clash.where("a <> b OR c <> d").isEmpty():
            break
        seed += 2
    roots = linked_sets(docs, marked, shingle, least, seed)
    named = marked.select("doc_id", "n_shingles", "name").join(roots, F.col("name") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "name").alias("root"))
    named = settle(named)
    least_id = named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = named.where("n_shingles > 0").join(least_id, "root").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(named.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
