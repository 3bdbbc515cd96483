"""Near duplicates by ProbMinHash, banding and exact verification.

A text is its five-word strings, weighted by how often they occur. Each one is a Poisson process of arrivals at the rate
of its weight; an arrival falls into a random register, which keeps the earliest. A process ends once its next arrival is
later than every register of the text. Two texts agree in a register with probability Jaccard similarity (for equal
weights: plain Jaccard). Four agreeing registers of one of 24 bands make two texts candidates.

Texts with the same words are one text from the start. A bucket of a band first compares its members with one leader; what
that joins is one class already. In a few rounds every row then tries its most agreeing partner of another class, which
joins large groups along few links, and in the end all pairs of different classes are tried. Agreement over all registers
is counted in blocks, and likely pairs alone go on to the exact similarity. The members of too large
a bucket first meet where one more band agrees, and in the end in pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorspark.llm.common import partitions, row_key, text_parts, written
from motorspark.llm.components import components

WORDS = 5
REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
#: Texts whose registers agree less than the threshold by this much are not verified: over four standard deviations.
MARGIN = 0.18
#: Members of a bucket that make one block; a task compares a pair of blocks.
BLOCK = 2048
#: Rounds in which each open row tries its most agreeing partner, before all pairs still open are tried.
ROUNDS = 1
SCANNED = "row long, rk binary, id long, key binary, signature binary, bands array<long>"
#: An odd base for rolling hashes modulo 2^64, its inverse, and odd factors to mix bits.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2, STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)

#: For each byte: 0 if it parts words, else the byte in lower case plus one.
LETTERS = np.array([c + 1 if c >= 128 or chr(c).isalnum() else 0 for c in range(256)], np.uint64)
LETTERS[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX_1
    x = (x ^ (x >> np.uint64(33))) * MIX_2
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word of texts that lie one after the other in ``data``."""
    letters = LETTERS[data]
    inside = np.concatenate([[False], letters > 0, [False]])
    inner = starts[(starts > 0) & (starts < len(data)) & (ends > starts)]
    change = np.diff(inside.view(np.int8))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = inner[inside[inner] & inside[inner + 1]]  # a text may begin right where a word of the one before ends
    begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers(BASE, len(data)), dtype=np.uint64)])
    hashes = mixed((prefix[end] - prefix[begin]) * powers(INVERSE, len(data) + 1)[begin])
    return np.searchsorted(starts, begin, side="right") - 1, hashes


def shingles(owner: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of the different strings of five words; a shorter text is one string."""
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first[owner]
    heads = np.flatnonzero((place + WORDS <= counts[owner]) | (place == 0))
    sums = np.zeros(len(heads), np.uint64)
    for step in range(WORDS):
        at = heads + step
        there = step < counts[owner[heads]] - place[heads]
        sums[there] += mixed(words[at[there]] + np.uint64((step + 1) * int(STEP) % (1 << 64)))
    sums = mixed(sums)
    order = np.lexsort((sums, owner[heads]))
    text, value = owner[heads][order], sums[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[new], value[new], np.diff(np.append(new, len(text)))


def prob_minhash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS: the string whose arrival is the earliest in each register."""
    earliest = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    at, rate, state = np.zeros(len(text)), weight.astype(np.float64), value.copy()
    while len(text):
        state = state + STEP
        draw = mixed(state)
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate
        slot = text * REGISTERS + (mixed(draw + MIX_1) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(earliest, slot, at)
        first = earliest[slot] == at
        winner[slot[first]] = value[first]
        latest = earliest.reshape(n, REGISTERS).max(1)
        live = at < latest[text]
        text, value, rate, at, state = text[live], value[live], rate[live], at[live], state[live]
    return winner.reshape(n, REGISTERS)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n, data, starts, ends in text_parts(batch.column("text")):
            owner, words = word_hashes(data, starts, ends)
            cuts = np.searchsorted(owner, np.arange(n + 1))
            text, value, weight = shingles(owner, words, n)
            registers = prob_minhash(text, value, weight, n)
            banded = np.zeros((n, BANDS), np.uint64)
            for row in range(ROWS):
                banded = mixed(banded * STEP + registers[:, row::ROWS])
            banded = mixed(banded + np.arange(BANDS, dtype=np.uint64) * MIX_2).view(np.int64)
            wordless = cuts[1:] == cuts[:-1]
            # texts without words are told apart by their bytes
            keys = [
                hashlib.blake2b(data[a:b].tobytes(), digest_size=16, person=b"bytes").digest() if empty else hashlib.blake2b(words[c:d].tobytes(), digest_size=16).digest()
                for a, b, c, d, empty in zip(starts, ends, cuts, cuts[1:], wordless, strict=False)
            ]
            short = registers.astype(np.uint16)
            sizes = np.where(wordless, 0, BANDS)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(banded[~wordless].ravel()))
            yield pa.record_batch(
                [batch.column("row").slice(first, n), batch.column("rk").slice(first, n), batch.column("id").slice(first, n), pa.array(keys, pa.binary()),
                 pa.array([r.tobytes() for r in short], pa.binary()), bands],
                names=[c.split()[0] for c in SCANNED.split(", ")],
            )


def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of a text, sorted, and their counts."""
    for batch in batches:
        for first, n, data, starts, ends in text_parts(batch.column("text")):
            text, value, weight = shingles(*word_hashes(data, starts, ends), n)
            cuts = np.searchsorted(text, np.arange(n + 1))
            cells = [(value[a:b].tobytes(), weight[a:b].astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([batch.column("row").slice(first, n), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["row", "strings", "weights"])


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets with weights: the sum over common i of 1 / sum over all j of max(x_j / x_i, y_j / y_i)."""
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(in_a):
        return 0.0
    u, v = x[in_a].astype(np.float64), y[in_b].astype(np.float64)
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    below = np.concatenate([[0.0], np.cumsum(u)])[np.searchsorted(v / u, v / u, side="left")]
    above = v.sum() - np.concatenate([[0.0], np.cumsum(v)])[np.searchsorted(v / u, v / u, side="left")]
    return float((1.0 / ((x.sum() - u.sum() + below) / u + (y.sum() - v.sum() + above) / v)).sum())


class Sets:
    """The strings and weights of the texts of a block, so that one text meets many others in one step."""

    def __init__(self, strings: list[bytes], weights: list[bytes]):
        self.sizes = np.array([len(s) // 8 for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.values = np.frombuffer(b"".join(strings), np.uint64)
        self.weights = np.frombuffer(b"".join(weights), np.int32)
        known, self.ids = np.unique(self.values, return_inverse=True)
        self.dense = np.zeros(len(known))
        self.plain = np.array([bool((self.weights[a : a + n] == 1).all()) for a, n in zip(self.starts, self.sizes, strict=True)], bool)
        self.shares = self.weights / np.repeat(np.maximum(np.add.reduceat(self.weights, self.starts) if len(self.starts) else self.sizes, 1), self.sizes)

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i] + self.sizes[i])
        return self.values[part], self.weights[part]

    def similar(self, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the others have a similarity of at least ``threshold`` to text i.

        Where no string repeats it is common over all strings. Else it is at most the summed smaller shares of the common
        strings, and only texts beyond the threshold by that bound are worked out one by one.
        """
        sizes = self.sizes[others]
        cells = np.repeat(self.starts[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        mine = slice(self.starts[i], self.starts[i] + self.sizes[i])
        self.dense[self.ids[mine]] = self.shares[mine]
        there, share = self.dense[self.ids[cells]], self.shares[cells]
        self.dense[self.ids[mine]] = 0
        heads = np.cumsum(sizes) - sizes
        common = np.add.reduceat((there > 0).astype(np.int64), heads)
        bound = np.add.reduceat(np.minimum(there, share), heads)
        out = common / (self.sizes[i] + sizes - common) >= threshold - 1e-12
        hard = ~(self.plain[others] & self.plain[i])
        out[hard] = False
        for at in np.flatnonzero(hard & (bound >= threshold - 1e-9)):
            out[at] = probability_jaccard(*self.one(i), *self.one(int(others[at]))) >= threshold - 1e-12
        return out


def sets_of(nodes: DataFrame, docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(row, strings, weights) of the rows in ``nodes``."""
    asked = nodes.join(scanned.select("row", "rk"), "row")
    sets = docs.select("rk", "text").join(asked, "rk").select("row", "text").mapInArrow(weigh, "row long, strings binary, weights binary")
    return sets.groupBy("row").agg(F.first("strings").alias("strings"), F.first("weights").alias("weights"))  # repeated rows are one


def verified(pairs: DataFrame, docs: DataFrame, scanned: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of rows whose exact similarity is at least ``threshold``, written."""
    nodes = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    sets = sets_of(nodes, docs, scanned)
    sides = [sets.select(F.col("row").alias(s), F.col("strings").alias(f"{s}s"), F.col("weights").alias(f"{s}w")) for s in ("a", "b")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[np.frombuffer(v.as_buffer(), kind) for v in batch.column(c)] for c, kind in (("as", np.uint64), ("aw", np.int32), ("bs", np.uint64), ("bw", np.int32))]
            good = np.array([probability_jaccard(*c) >= threshold - 1e-12 for c in zip(*cells, strict=True)], bool)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "as", "aw", "bs", "bw")
    return written(both.mapInArrow(judge, "a long, b long"), "verified")


def agreeing(pairs: DataFrame, scanned: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose registers agree often enough."""
    sides = [scanned.select(F.col("row").alias(s), F.col("signature").alias(f"{s}s")) for s in ("a", "b")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("as", "bs"))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((a == b).mean(1) >= least))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "as", "bs").mapInArrow(judge, "a long, b long")


def blocks_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """The rows of each (bucket, block); batches come sorted by them, and these are the first two columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and row[:2] != held[-1][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def best_partners(members: DataFrame, least: float, n: int) -> DataFrame:
    """(a, b) for every row a that has agreeing rows of another root in its buckets: b agrees most."""
    columns = ["bucket", "block", "left", "row", "root", "signature", "alone"]

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks_of(batches, columns):
            row, root = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
            signs = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
            left, alone, out = np.array([r[2] for r in rows]), rows[0][6], []
            for i in range(len(rows)):
                other = np.flatnonzero((root != root[i]) & (alone | (left != left[i])))
                share = (signs[other] == signs[i]).mean(1)
                if len(other) and share.max() >= least:
                    out.append((int(row[i]), int(row[other[share.argmax()]]), float(share.max())))
            yield pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "share"])

    dealt = members.select(*columns).repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "row")
    pairs = dealt.mapInArrow(pair, "a long, b long, share double")
    return pairs.groupBy("a").agg(F.max(F.struct("share", "b")).alias("to")).select("a", F.col("to.b").alias("b"))


def joining_links(members: DataFrame, least: float, threshold: float, n: int) -> DataFrame:
    """Of members with their strings and weights: links (a, b) that join different roots, each pair tried exactly.

    A pair is tried in the first band that it shares, and not once earlier links of the block have joined its roots: so
    links are fewer than members, whatever the number of pairs.
    """
    columns = ["bucket", "block", "left", "row", "root", "signature", "band", "strings", "weights", "alone"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks_of(batches, columns):
            row, root, band, out = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), rows[0][6], []
            signs = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
            sets = Sets([r[7] for r in rows], [r[8] for r in rows])
            left, alone = np.array([r[2] for r in rows]), rows[0][9]
            for i in np.flatnonzero(left):
                other = np.flatnonzero((root != root[i]) & (alone | ~left))
                same = signs[other] == signs[i]
                share = same.mean(1)
                keep = (share >= least) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band)
                if not keep.any():
                    continue
                other = other[keep]
                for j in other[sets.similar(int(i), other, threshold)]:
                    if root[i] != root[j]:
                        out.append((int(min(row[i], row[j])), int(max(row[i], row[j]))))
                        root[root == root[j]] = root[i]
            yield pa.record_batch([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = members.select(*columns).repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "row")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def open_members(members: DataFrame, roots: DataFrame, scanned: DataFrame, narrowed: bool) -> DataFrame | None:
    """Members of buckets that still hold several roots, dealt as pairs of blocks, written; None if there are none.

    ``block`` is the number of a pair of blocks of about BLOCK members each, ``left`` the side a member is on; ``alone``
    marks a block that is paired with itself. Every two members of different roots meet in one pair of their bucket. With
    ``narrowed`` the members of a large bucket only meet where they agree in a further band and are few: that finds most
    links cheaply, but not all.
    """
    rooted = written(members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "rooted")
    several = written(rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket"), "several")
    if several.isEmpty():
        return None
    rooted = rooted.join(several, "bucket")
    if narrowed:
        large = rooted.filter(F.col("size") > BLOCK).select("bucket", F.col("band").alias("own"), "row", "root")
        again = large.join(scanned.select("row", F.posexplode("bands").alias("band", "hash")), "row").filter("band <> own")
        again = again.select(F.xxhash64("bucket", "band", "hash").alias("bucket"), F.least("band", "own").alias("band"), "row", "root")
        rooted = rooted.filter(F.col("size") <= BLOCK).select("bucket", "band", "row", "root").unionByName(again)
    sizes = (
        rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows")).groupBy("bucket")
        .agg(F.sum("rows").alias("size"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("rows", "root")).alias("top")).filter("roots > 1")
    )
    if narrowed:
        sizes = sizes.filter(F.col("size") <= BLOCK)
    # rows of the most common root need not meet each other: they get blocks of their own, before those of all others
    large = F.col("size") > BLOCK
    tops = F.when(large, F.ceil(F.col("top.rows") / BLOCK)).otherwise(F.lit(0)).alias("tops")
    rest = F.when(large, F.ceil((F.col("size") - F.col("top.rows")) / BLOCK)).otherwise(F.lit(1)).alias("rest")
    dealt = rooted.select("bucket", "band", "row", "root").join(sizes.select("bucket", F.col("top.root").alias("common"), tops, rest), "bucket")
    is_top, blocks = (F.col("tops") > 0) & (F.col("root") == F.col("common")), F.col("tops") + F.col("rest")
    own = F.when(is_top, F.expr("pmod(xxhash64(row), tops)")).otherwise(F.expr("tops + pmod(xxhash64(row), rest)"))
    met = F.explode(F.sequence(F.when(is_top, F.col("tops")).otherwise(F.lit(0)), blocks - 1))
    dealt = dealt.select("bucket", "band", "row", "root", own.alias("own"), blocks.alias("blocks"), met.alias("met"))
    block = F.least("own", "met") * F.col("blocks") + F.greatest("own", "met")
    dealt = dealt.select("bucket", "band", block.alias("block"), (F.col("own") <= F.col("met")).alias("left"), (F.col("own") == F.col("met")).alias("alone"), "row", "root")
    return written(dealt.join(scanned.select("row", "signature"), "row"), "open-members")


def nearest_roots(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) where a root is the smallest of a node's own and those of the nodes it is linked with.

    Nodes of one root are of one class, though a class may still have several roots: that costs a later step some
    comparisons, and saves the rounds that whole components take. Without ``roots`` every node is its own.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    if roots is None:
        return both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
    named = both.join(roots.withColumnRenamed("node", "other"), "other", "left").select("node", F.coalesce("root", "other").alias("root"))
    return named.unionByName(roots).groupBy("node").agg(F.min("root").alias("root")).select("node", F.least("node", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: (rk, id, class_id, first).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. Two texts are near
    duplicates if the probability Jaccard similarity of their five-word strings is at least ``threshold``; a text of fewer
    words is one string. Classes are closed over such pairs. Texts with the same words are one text; texts without words
    (null counts as empty) only match texts with the same bytes. ``class_id`` is the smallest id of the class (null if it
    has none), ``first`` marks the one row of each class that stands for it: the smallest id, nulls last. ``rk`` is the digest of id
    and text that ``row_key`` gives. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n, least = partitions(spark), threshold - MARGIN
    texts = docs.select(
        F.unhex(row_key(id_col, text_col)).alias("rk"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    scanned = written(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "rk", "id", "text").mapInArrow(scan, SCANNED), "signatures")
    same = scanned.groupBy("key").agg(F.min("row").alias("rep"))
    reps = scanned.join(same.select(F.col("rep").alias("row")), "row", "left_semi")
    banded = reps.select("row", F.posexplode("bands").alias("band", "hash"))
    shared = banded.groupBy("hash").agg(F.count(F.lit(1)).alias("size"), F.min("row").alias("leader")).filter("size > 1")
    # written, so that joins have exchanges of their own, which adaptive execution may split where a bucket is hot
    members = written(banded.join(written(shared, "shared"), "hash").select(F.col("hash").alias("bucket"), "band", "row", "size", "leader"), "buckets")

    stars = members.filter("row <> leader").select(F.col("leader").alias("a"), F.col("row").alias("b")).distinct()
    links = verified(written(agreeing(stars, scanned, least), "stars"), texts, scanned, threshold)
    roots = written(nearest_roots(links, None), "roots")
    # every row of a mixed bucket tries its most agreeing partner of another class; then all pairs that are left
    for step in range(ROUNDS + 1):
        still = open_members(members, roots, scanned, narrowed=step < ROUNDS)
        if still is None:
            break
        partners = written(best_partners(still, least, n), "partners")
        if step < ROUNDS:
            pairs = partners.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            found = verified(pairs, texts, scanned, threshold)
        else:
            # a row with an agreeing row of another class has a partner itself; no others are left to try
            lonely = sets_of(partners.select(F.col("a").alias("row")), texts, scanned)
            found = written(joining_links(still.join(lonely, "row"), least, threshold, n), "joining")
        if not found.isEmpty():
            links = links.unionByName(found)
            if step < ROUNDS:
                roots = written(nearest_roots(found, roots), "roots")
    roots = written(components(links), "roots")

    classed = written(
        scanned.select("row", "rk", "id", "key").join(same, "key")
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("row", "rk", "id", F.coalesce("root", "rep").alias("root")),
        "classed",
    )
    heads = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"))
    heads = written(heads, "heads")
    return classed.join(heads, "root").select("rk", "id", "class_id", (F.col("row") == F.col("head.row")).alias("first"))
