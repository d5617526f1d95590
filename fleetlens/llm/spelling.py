"""Spelling variant grouping: pairs of trie nodes find the words that are one code point apart.

Words are counted over all texts. Their forward trie (of prefixes) and reversed trie (of suffixes) get a number for every
node: words are range-partitioned and sorted, each task numbers the nodes that a word adds to the one before, and what one
part's first word shares with the part before is carried over. Node numbers grow in code-point order, so the number of a
word's last forward node stands for the word.

A word of L code points has L pairs that skip one (node of the prefix before it, node of the suffix behind it) and L + 1 that
skip none. Two words that share a skipping pair differ by one replaced code point. A word whose skipping pair is another's
pair without a skip is that word with one code point inserted; of equal neighbouring code points only the first is skipped
for this, so every neighbour is met once, at one pair. Pairs are exact: no candidate needs a check.

A pair's group holds words that differ in one place: as many as there are code points in the words (90), and one word
without a skip. Groups are summed up (number, first and second word by count), not joined with themselves. Forms are
followed to roots by pointer jumping; as counts at least double at each step, a chain has fewer than 64.

Defined results: null and empty texts have no runs; a null doc_id is an empty one in the checksum; repeated rows count each
time; words of one count are ordered by code points; an empty table, or one whose words are all rare, gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words: least code points, least occurrences; a form has at least so many times the word's occurrences.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many (by checksum) loses a code point.
MISSPELT = 97


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: occurrences over all texts, of the words that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = (h % F.length("run")).cast("int")
    word = F.when(h % MISSPELT == 0, F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2)"))).otherwise(F.col("run"))
    words = runs.filter(F.length("run") >= LEAST_LENGTH).withColumn("h", h).withColumn("cut", cut).select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def numbered(words: DataFrame, backwards: bool) -> DataFrame:
    """word, n, nodes: numbers of the trie nodes of the word's prefixes (backwards: of its suffixes, the longest last), root first."""
    key = F.reverse("word") if backwards else F.col("word")
    parts = max(1, words.sparkSession.sparkContext.defaultParallelism)
    ordered = words.select("word", "n", key.alias("key")).repartitionByRange(parts, "key").sortWithinPartitions("key")

    def number(batches):
        """Numbers from 1 within the part; shared: how many code points the word has in common with the part's first one."""
        part, path, before, first, made, shared = TaskContext.get().partitionId(), [], "", None, 0, 0
        for batch in batches:
            out = ([], [], [])
            for word in batch.column("key").to_pylist():
                same = len(os.path.commonprefix((before, word)))
                shared, first = (len(word), word) if first is None else (min(shared, same), first)
                del path[same:]
                path += range(made + 1, made + 1 + len(word) - same)
                made, before = made + len(word) - same, word
                out[0].append(list(path))
                out[1].append(shared)
                out[2].append(made)
            columns = [batch.column("key"), batch.column("word"), batch.column("n"), pa.array([part] * batch.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], names=["key", "word", "n", "part", "path", "shared", "made"])

    local = write_shared(ordered.mapInArrow(number, "key string, word string, n long, part int, path array<long>, shared int, made long"), "trie")
    carried = words.sparkSession.createDataFrame(carry(local), "part int, base long, head array<long>")
    # One row for each part: their number is that of the tasks.
    at_head = F.expr("transform(path, (x, i) -> IF(i < least(shared, size(head)), get(head, i), base + x))")
    return local.join(F.broadcast(carried), "part").select("word", "n", F.concat(F.array(F.lit(0).cast("long")), at_head).alias("nodes"))


def carry(local: DataFrame) -> list[tuple[int, int, list[int]]]:
    """For each part: what is added to its numbers, and the numbers of the nodes that its first word shares with the part before."""
    ends = local.groupBy("part").agg(F.min("key").alias("first"), F.max_by(F.struct("key", "path", "shared"), "key").alias("last"), F.max("made").alias("made"))
    out, base, before, nodes = [], 0, "", []
    for r in ends.orderBy("part").collect():
        head = nodes[: len(os.path.commonprefix((before, r["first"])))]
        kept = min(len(head), r["last"]["shared"])
        nodes = [head[i] if i < kept else base + x for i, x in enumerate(r["last"]["path"])]
        out.append((r["part"], base, head))
        base, before = base + r["made"], r["last"]["key"]
    return out


def node_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """prefix, suffix, kind, id, n of every pair: 0 skips nothing, 1 skips a code point, 2 one that is equal to the one before."""
    both = forward.withColumnRenamed("nodes", "pre").join(backward.select("word", F.reverse("nodes").alias("suf")), "word").withColumn("c", F.split("word", ""))
    places = F.expr("""flatten(transform(pre, (x, i) -> IF(i = size(pre) - 1, array(struct(x AS prefix, get(suf, i) AS suffix, 0 AS kind)),
      array(struct(x AS prefix, get(suf, i) AS suffix, 0 AS kind), struct(x AS prefix, get(suf, i + 1) AS suffix, IF(i > 0 AND get(c, i) = get(c, i - 1), 2, 1) AS kind)))))""")
    return both.select(F.element_at("pre", -1).alias("id"), "n", F.explode(places).alias("p")).select("p.*", "id", "n")


def neighbours(pairs: DataFrame) -> DataFrame:
    """id, n_near, best: for every word with neighbours their number, and the first of them by count (rank: -n, id)."""
    member = F.struct((-F.col("n")).alias("rank"), "id", "kind")
    groups = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("all")).filter(F.size("all") > 1)
    groups = groups.withColumns({"whole": F.expr("get(filter(all, x -> x.kind = 0), 0)"), "skipped": F.expr("filter(all, x -> x.kind > 0)")})
    groups = groups.withColumn("longer", F.expr("filter(skipped, x -> x.kind = 1)"))
    # Replacements: all others of the skipped; insertions: the longer ones and the whole word are each other's neighbours.
    found = F.expr("""concat(
      IF(size(skipped) > 1, transform(skipped, x -> struct(x.id AS id, size(skipped) - 1 AS near, IF(x.id = get(skipped, 0).id, get(skipped, 1), get(skipped, 0)) AS best)), array()),
      IF(whole IS NOT NULL, transform(longer, x -> struct(x.id AS id, 1 AS near, whole AS best)), array()),
      IF(whole IS NOT NULL AND size(longer) > 0, array(struct(whole.id AS id, size(longer) AS near, get(longer, 0) AS best)), array()))""")
    each = groups.select(F.explode(found).alias("f")).select("f.id", "f.near", F.struct("f.best.rank", F.col("f.best.id").alias("form_id")).alias("best"))
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots_of(links: DataFrame) -> DataFrame:
    """id, root: the end of each chain of links (id, to), by pointer jumping; a round halves what is left of a chain."""
    ahead = links.select("id", F.col("to").alias("root"))
    while True:
        step = ahead.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = write_shared(ahead.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ahead = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return ahead


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its most frequent neighbour, and where following these ends."""
    words = write_shared(word_counts(docs), "words")
    forward, backward = numbered(words, False), numbered(words, True)
    near = neighbours(node_pairs(forward, backward))
    named = forward.select(F.element_at("nodes", -1).alias("id"), "word", "n")
    form_n = -F.col("best.rank")
    has = form_n >= TIMES * F.col("n")
    judged = named.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form_id")).alias("form_id"), F.when(has, form_n).alias("form_n"))
    judged = write_shared(judged, "judged")
    links = judged.filter("form_id IS NOT NULL").select("id", F.col("form_id").alias("to"))
    roots = roots_of(links)
    name = lambda key, text: judged.select(F.col("id").alias(key), F.col("word").alias(text))
    found = links.join(roots, "id").join(name("to", "form"), "to").join(name("root", "root_word"), "root").select("id", "form", "root_word")
    return judged.join(found, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
