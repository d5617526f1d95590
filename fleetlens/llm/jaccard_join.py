"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of `percent` / 100 or more.

Shingle length and percent are arguments. op9's contract is 3 words and 90, which are the defaults; the corpus pipeline
takes 5 words and 80.

A size-aware heavy-light join, exact up to 64-bit hashes of shingles:

1. Words are counted in a table of hashed counters, bounded in size. A shingle's rank is (rarity of its words, hash): rare first.
2. Each text becomes its set of shingle hashes; equal sets are one class (128-bit fingerprint), named by its smallest id.
3. Two sets of sizes a, b link only if they share o(a, b) = ceil(p (a + b) / (100 + p)) shingles, p = percent, and the
   smaller has p percent of the larger's size. Light sets (size up to a boundary) enumerate their subsets of those fixed sizes: partners share a subset.
   Heavy sets are scanned by inverted lists of their a - ceil(p a / 100) + 1 rarest shingles: partners share one of these.
   The boundary is where the subsets of lighter sets cost less than the scan of their lists, both counted in the data.
4. Components need no link inside a component already found. Each list is first compared with one member (its pivot);
   after components of those links, only pairs of different components in a list are left, and all of them are compared,
   in tiles of a list, inside tasks. That is done twice: first each set of a tile gives the pair with its nearest one only
   (copies of one text are nearest to that text, so these pairs, few as they are, join most groups), then, with the
   components that these make, every pair that is left.
   A pair is compared by size, then by a bound from parity maps of the sets (never too low), then exactly. Sets are made
   again for documents in pairs that are left; a bitmap of their ids, of a size that is bounded, spares the others.

What grows: a list of L sets is compared in (L / BLOCK)^2 tiles, so the comparisons of one very long list grow with its
square; they are spread over tasks, and leave out pairs inside one component. Beyond MOST_BITS / 16 candidate documents
(8 million) the bitmap fills up, and sets of most documents are written again; results do not change. Counters sent to the
driver stop growing at MOST_COUNTERS (some 50 MB).

Defined results: null and empty texts have no set and are their own component; with fewer words than a shingle the whole
sequence is the one shingle; repeated rows and equal sets share a component; rows with one doc_id are one document for linking, each
with its own n_shingles; a null doc_id is linked with nothing and has a null component; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, join_groups, mix, new_path, packed, ragged, scratch, signed, slices, write_clean, write_shared
from .components import components

#: Counters of hashed words: four for each document, within these bounds (what the driver gathers is bounded).
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 22
#: Sets of up to so many shingles may be light; the boundary is chosen among them.
MOST_LIGHT = 24
#: Bits of a set's parity map; sets of over WIDE_FROM shingles have a wide one too.
MAP_BITS, WIDE_BITS, WIDE_FROM = 1024, 8192, 2500
#: Bits of the bitmap of candidate ids: 16 for each id, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Sets of a list that are compared in one task with as many others.
BLOCK = 2048
#: op9's contract: words of a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 3, 90


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def smallest_partner(a, percent: int = PERCENT):
    return -(-percent * a // 100)


def subset_sizes(a: int, most: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a set of a shingles shares with its partners of up to `most` shingles."""
    return sorted({c for b in range(smallest_partner(a, percent), min(most, 100 * a // percent) + 1) if (c := least_overlap(a, b, percent)) <= min(a, b)})


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words by hash, over all documents, in a power of two of counters."""
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (4 * docs.count()).bit_length()))

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount((Words(part.column("text")).hash & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "n"])

    out = np.zeros(counters, np.int64)
    rows = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # a row for each counter at most
    out[rows.column("k").to_numpy()] = rows.column("n").to_numpy()
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """How common each counter's words are, in quarters of a doubling."""
    return np.round(4 * np.log2(counts + 1)).astype(np.uint16)


class Sets:
    """The shingle sets of some texts: `hash` and `rank` sorted by rank in each row, and `size` of each row."""

    def __init__(self, text: pa.Array, level: np.ndarray | None = None, shingle: int = SHINGLE):
        w = Words(text)
        n = len(text)
        h, row = w.hash, w.row
        lev = level[(h & np.uint64(len(level) - 1)).astype(np.int64)].astype(np.uint64) if level is not None else np.zeros(len(h), np.uint64)
        first = np.flatnonzero(row[: len(row) - shingle + 1] == row[shingle - 1 :]) if len(row) >= shingle else np.zeros(0, np.int64)
        A = np.uint64(0x9E3779B97F4A7C15)
        sh, sl, sr = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), row[first]
        for j in range(shingle):
            sh = mix(sh * A + h[first + j], j)
            sl += lev[first + j]
        few = np.flatnonzero((w.per_row < shingle) & (w.per_row > 0))
        if len(few):  # the whole sequence is the one shingle
            at, one = (np.cumsum(w.per_row) - w.per_row)[few], np.zeros(len(few), np.uint64)
            for j in range(shingle - 1):
                one = np.where(w.per_row[few] > j, mix(one * A + h[np.minimum(at + j, len(h) - 1)], 11 + j), one)
            sh, sl, sr = np.concatenate([sh, mix(one, 13)]), np.concatenate([sl, lev[at]]), np.concatenate([sr, few])
            order = np.argsort(sr, kind="stable")
            sh, sl, sr = sh[order], sl[order], sr[order]
        rank = (sl << np.uint64(50)) | (sh >> np.uint64(14))
        ends = np.cumsum(np.bincount(sr, minlength=n))
        order = np.empty(len(rank), np.int64)
        for a, b in zip(ends - np.diff(ends, prepend=0), ends):
            order[a:b] = np.argsort(rank[a:b]) + a
        sh, rank = sh[order], rank[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sr[1:] != sr[:-1])
        self.hash, self.rank, self.row = sh[new], rank[new], sr[new]
        self.size = np.bincount(self.row, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums of each set's hashes."""
        out = []
        for salt in (1, 2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hash, salt))])
            out.append(signed(sums[self.start + self.size] - sums[self.start]))
        return out[0], out[1]

    def maps(self, bits: int, of: np.ndarray) -> np.ndarray:
        """A row of bits for each set in `of`: the parity of how many of its hashes fall on each."""
        place = np.full(len(self.size), -1)
        place[of] = np.arange(len(of))
        use = place[self.row] >= 0
        at = place[self.row[use]] * bits + (self.hash[use] & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=len(of) * bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


FEATURES = "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, small array<long>, bits array<long>, wide array<long>"


def features(docs: DataFrame, level: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Each text's set size, fingerprint, rarest shingles, all shingles if it may be light, and parity map."""
    shared = docs.sparkSession.sparkContext.broadcast(level)  # MOST_COUNTERS small numbers at most

    def each(batches):
        for batch in batches:
            for part in slices(batch):
                s = Sets(part.column("text"), shared.value, shingle)
                p = np.where(s.size > 0, s.size - smallest_partner(s.size, percent) + 1, 0)
                place = np.arange(len(s.row)) - s.start[s.row]
                head, small = place < p[s.row], s.size[s.row] <= MOST_LIGHT
                fp1, fp2 = s.prints()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array(s.size.astype(np.int64)), pa.array(fp1), pa.array(fp2),
                    ragged(signed(mix(s.rank[head])), p, pa.int64()), ragged(signed(s.hash[small]), np.where(s.size <= MOST_LIGHT, s.size, 0), pa.int64()),
                    ragged(s.maps(MAP_BITS, np.arange(len(part))), np.full(len(part), MAP_BITS // 64), pa.int64()),
                    ragged(s.maps(WIDE_BITS, np.flatnonzero(s.size > WIDE_FROM)), np.where(s.size > WIDE_FROM, WIDE_BITS // 64, 0), pa.int64()),
                ], names=["doc_id", "n", "fp1", "fp2", "prefix", "small", "bits", "wide"])

    return docs.select("doc_id", "text").mapInArrow(each, FEATURES)


def subsets(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """tok, rep, n, pos: a hash of each fixed-size subset that the light sets of up to `most` shingles share with partners."""
    deleted = {a: [(c, np.array(list(combinations(range(a), a - c)), np.int64).reshape(comb(a, c), a - c)) for c in subset_sizes(a, most, percent)] for a in range(1, most + 1)}

    def each(batches):
        for batch in batches:
            tok, rep, size = [], [], []
            for r, n, small in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("small")):
                h = mix(small.values.to_numpy().view(np.uint64), 3)
                whole = h.sum(dtype=np.uint64)
                for c, gone in deleted[n]:
                    tok.append(mix(whole - h[gone].sum(axis=1, dtype=np.uint64), 100 + c))
                    rep.append(np.full(len(gone), r, np.int64))
                    size.append(np.full(len(gone), n, np.int64))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tok))), pa.array(np.concatenate(rep)), pa.array(np.concatenate(size)), pa.array(np.zeros(sum(map(len, tok)), np.int32))], names=["tok", "rep", "n", "pos"])

    return sets.filter(F.col("n") <= most).select("rep", "n", "small").mapInArrow(each, "tok long, rep long, n long, pos int")


def boundary(sets: DataFrame, percent: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by counts in the data."""
    few = sets.filter(F.col("n").between(1, 100 * MOST_LIGHT // percent))
    lists = few.select("rep", "n", F.explode("prefix").alias("tok"))
    read = lists.join(lists.groupBy("tok").agg(F.count(F.lit(1)).alias("length")), "tok").groupBy("n").agg(F.sum("length").alias("read"))
    rows = few.groupBy("n").agg(F.count(F.lit(1)).alias("sets")).join(read, "n", "left").collect()  # a row for each small size
    held, scan = {r["n"]: r["sets"] for r in rows}, {r["n"]: r["read"] or 0 for r in rows}
    cost = {}
    for x in range(9, MOST_LIGHT + 1):
        enumerated = sum(held.get(a, 0) * sum(comb(a, c) for c in subset_sizes(a, x, percent)) for a in range(1, x + 1))
        cost[x] = enumerated + sum(scan.get(a, 0) for a in range(smallest_partner(x + 1, percent), MOST_LIGHT + 1))
    return min(cost, key=lambda x: (cost[x], x))


def similar_sizes(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def sets_of(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """id, n, set (sorted hashes) of the documents whose doc_id is in ids, and of a few others."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(bits - 1)) + 1
    marks = ids.select(slot("doc_id").alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
    seen = np.zeros(bits // 8, np.uint8)
    for r in marks.collect():  # MOST_BITS bits at most
        seen[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], np.uint8)[: len(seen)]
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def each(batches):
        for batch in batches:
            s = batch.column("slot").to_numpy() - 1
            batch = batch.filter(pa.array((shared.value[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch):
                s = Sets(part.column("text"), shingle=shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s.size.astype(np.int64)), ragged(signed(s.hash), s.size, pa.int64())], names=["id", "n", "set"])

    known = docs.filter("doc_id is not null").select("doc_id", "text", slot("doc_id").alias("slot"))
    return write_shared(known.mapInArrow(each, "id long, n long, set array<long>"), "sets")


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The links among the pairs (a, b)."""
    side = sets.select("rep", "n", "bits", "wide")
    pairs = pairs.join(side.toDF("a", "na", "bits_a", "wide_a"), "a")
    pairs = pairs.join(side.toDF("b", "nb", "bits_b", "wide_b"), "b").filter(similar_sizes("na", "nb", percent))
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    total = F.col("na") + F.col("nb")
    both_wide = (F.size("wide_a") > 0) & (F.size("wide_b") > 0)
    apart = F.when(both_wide, apart("wide_a", "wide_b")).otherwise(apart("bits_a", "bits_b"))
    pairs = write_shared(pairs.filter((100 + percent) * ((total - apart) / 2) >= percent * total).select("a", "b", "na", "nb").distinct(), "pairs")
    whole = sets_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), shingle)
    both = pairs.join(whole.toDF("a", "na", "set_a"), ["a", "na"]).join(whole.toDF("b", "nb", "set_b"), ["b", "nb"])
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * overlap >= percent * (total - overlap)).select("a", "b").distinct()


def compare_lists(batches, percent: int, nearest: bool):
    """Pairs of a tile's sets in different components that size, place and parity map let be links; tiles come one after the other.

    nearest: only the pair of each set with that one whose parity map is nearest.
    """

    def pairs(t: pa.Table):
        col = lambda c: t.column(c).combine_chunks().to_numpy()
        tok, i, j, rep, n, pos, part, block = (col(c) for c in ("tok", "i", "j", "rep", "n", "pos", "part", "block"))
        bits = t.column("bits").combine_chunks().flatten().to_numpy().reshape(len(tok), -1)
        first = np.ones(len(tok), bool)
        first[1:] = (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(first)
        end = np.repeat(np.append(start[1:], len(tok)), np.diff(np.append(start, len(tok))))
        x, d = np.arange(len(tok)), 0
        least, other = np.full(len(tok), np.iinfo(np.int64).max), np.full(len(tok), -1)
        while len(x):
            d += 1
            x = x[x + d < end[x]]
            y = x + d
            ok = (rep[x] != rep[y]) & (part[x] != part[y]) & ((i[x] == j[x]) | (block[x] != block[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            # From the first shingle that two sets share on, they share no more than what follows it in either.
            ok &= (100 + percent) * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= percent * (n[x] + n[y])
            a, b = x[ok], y[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * (n[a] + n[b] - apart) >= 2 * percent * (n[a] + n[b])
            a, b, apart = a[near], b[near], apart[near]
            if not nearest:
                yield batch_of(rep[a], rep[b])
                continue
            for one, two in ((a, b), (b, a)):
                better = apart < least[one]
                least[one[better]], other[one[better]] = apart[better], two[better]
        found = np.flatnonzero(other >= 0)
        yield batch_of(rep[found], rep[other[found]])

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        keys = [t.column(c).combine_chunks().to_numpy() for c in ("tok", "i", "j")]
        same = np.ones(len(t), bool)
        for k in keys:
            same &= k == k[-1]
        whole = int(np.flatnonzero(~same).max(initial=-1)) + 1  # rows of tiles that have ended
        if whole:
            yield from pairs(t.slice(0, whole))
        held = t.slice(whole)
    if held is not None and len(held):
        yield from pairs(held)


def list_pairs(lists: DataFrame, sets: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """a, b: the pairs in lists that may be links, compared inside tasks; a list of over BLOCK sets is dealt out in tiles of two blocks."""
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    rows = lists.join(sets.select("rep", "n", "bits"), ["rep", "n"]).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("tok", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "rep", "n", F.col("pos").cast("long").alias("pos"), "part", "block", "bits")
    tiles = rows.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")
    return tiles.mapInArrow(lambda batches: compare_lists(batches, percent, nearest), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs."""
    every = write_shared(features(docs, levels(word_counts(docs)), shingle, percent), "features")
    known = every.filter("n > 0 and doc_id is not null")
    classes = write_shared(known.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_rows")), "classes")
    # The row that names a class carries its set; a class whose name is another class's too keeps both. The id is part of
    # the key, so copies of one text are not one task.
    sets = known.withColumnRenamed("doc_id", "rep").join(classes.drop("n_rows"), ["rep", "n", "fp1", "fp2"], "left_semi").dropDuplicates(["rep", "n", "fp1", "fp2"]).select("rep", "n", "prefix", "small", "bits", "wide")
    sets = write_shared(sets, "classes-with-sets")
    light = boundary(sets, percent)
    heavy = sets.filter(F.col("n") >= smallest_partner(light + 1, percent)).select(F.posexplode("prefix").alias("pos", "tok"), "rep", "n").select("tok", "rep", "n", "pos")
    posts = heavy.union(subsets(sets, light, percent))
    several = posts.groupBy("tok").agg(F.count(F.lit(1)).alias("length"), F.min("rep").alias("pivot")).filter("length > 1").drop("length")
    lists = write_shared(posts.join(several, "tok"), "lists")
    star = lists.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = write_clean(docs.sparkSession, "links", lambda: verify(star, sets, docs, shingle, percent))
    # What is left: pairs of one list in different components, neither of them the pivot (those are done).
    for nearest in (True, False):
        so_far = write_clean(docs.sparkSession, "components-so-far", functools.partial(components, links))
        part = lists.join(so_far, lists.rep == so_far.node, "left").select("tok", "rep", "n", "pos", "pivot", F.coalesce("component", "rep").alias("part"))
        part = write_shared(part.filter("rep <> pivot"), "parts")
        open_ = part.groupBy("tok").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("length")).filter("low <> high").select("tok", "length")
        pairs = list_pairs(part.join(open_, "tok"), sets, percent, nearest)
        more = write_clean(docs.sparkSession, "more-links", functools.partial(verify, pairs, sets, docs, shingle, percent))
        links = links.union(more)
    # Rows with one id in several classes join these classes.
    twice = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id")
    same = known.select("doc_id", "n", "fp1", "fp2").join(twice, "doc_id").join(classes, ["n", "fp1", "fp2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = write_clean(docs.sparkSession, "components", lambda: components(links.union(same)))
    # Rows without words have no class, and those without an id no component: neither is joined by a key that many share.
    out = join_groups(known.select("doc_id", "n", "fp1", "fp2"), classes, ["n", "fp1", "fp2"]).select("doc_id", "n", "rep")
    out = out.unionByName(every.filter("n = 0 and doc_id is not null").select("doc_id", "n", F.col("doc_id").alias("rep")))
    out = out.join(final, out.rep == final.node, "left").select("doc_id", "n", F.least("doc_id", F.coalesce("component", "rep")).alias("component_id"))
    none = every.filter("doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(none).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked rows, with its columns.

    Rows are linked as rows, whatever their doc_id: rows that share an id, or have none, are documents each. Of a group the
    row with the smallest doc_id stays (null last), then that with the smallest hash of its text, then of the whole row.
    """
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), packed().alias("row"), F.xxhash64("text").alias("th"), F.xxhash64(*hashed).alias("rh"))
    rows = write_shared(rows, "rows")
    path = new_path(docs.sparkSession, "row-components")
    with scratch(docs.sparkSession):
        found = jaccard_components(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), shingle, percent)
        found.select(F.col("doc_id").alias("rid"), "component_id").write.parquet(path)
    found = docs.sparkSession.read.schema("rid long, component_id long").parquet(path)
    named = found.join(rows.select("rid", F.col("row.doc_id").alias("id"), "th", "rh"), "rid")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "rh", "rid")).alias("best")).select("best.rid")
    return rows.select("rid", "row").join(best, "rid", "left_semi").select("row.*")
