"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key in [0, 1). Keys are uniform, so equal ranges of the key hold equal shares of a source: the
range a key falls in is its bucket, each bucket of a source holds about BUCKET_ROWS rows, and the order by (bucket, key) is
the source's sorted order. Word counts are summed by bucket, the bucket sums are prefix-summed (one row a bucket), and
inside a bucket a window adds the rest. A source is cut where its prefix sum reaches its budget; whole epochs come before
the cut. Budgets are one row a source and go to all tasks (`join_groups`), so a hot source is dealt over its buckets.

`mix_documents` needs the cut of each source only, which is one row a source too: every row is compared with it where it
lies, so texts are not shuffled.

Defined results: null text has no words; a null source is a source of its own, last in order, and apart from an empty one;
rows that are repeated, or share a doc_id, are mixed as rows; a null doc_id keeps its row; empty tables give an empty
result; all columns pass through `mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_groups, packed, write_shared

#: Weights that sources take in turn, by code point of their names; null comes last.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's words.
MAX_EPOCHS = 3
BUCKET_ROWS = 2000
#: The order of a source's rows. Rows that agree up to text_hash are told apart by where the sizes table holds them.
ORDER = ("unit", "doc_id", "size", "text_hash", "file_name", "row_index")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """The rows of docs with source key, words and hash-random key, written once; with all their columns in `row` if whole."""
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # never null, and null is no name
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), src).cast("binary"))
    unit = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    columns = [F.col("doc_id"), src.alias("src"), word_count().alias("size"), unit.alias("unit"), F.xxhash64("text").alias("text_hash")]
    written = write_shared(docs.select(*columns, *[packed().alias("row")] * whole), "sizes")
    return written.select("*", "_metadata.file_name", "_metadata.row_index")


def budgets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """src, source_size, n_rows, target: one row a source.

    Capped sharing has a closed form. Sources are ordered by weight / size, falling: the sources at their cap are the first
    few of that order. With c capped words and w open weight, the others get (total - c) * weight / w; the first source of
    the order that this leaves below its cap tells c and w.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = (F.col("src") == "n", F.encode("src", "utf-8"))
    rank = F.row_number().over(Window.orderBy(*by_name)) - 1
    each = F.array(*(F.lit(float(x)) for x in weights))
    per = per.withColumn("weight", F.element_at(each, (rank % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    has_words = F.col("source_size") > 0
    order = Window.orderBy(~has_words, F.desc(F.try_divide(F.col("weight"), F.col("source_size"))), *by_name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    open_weight = F.when(has_words, F.col("weight")).otherwise(0.0)
    cap = (max_epochs * F.col("source_size")).cast("double")
    per = (
        per.withColumn("place", F.row_number().over(order))
        .withColumn("capped", F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("open", F.sum(open_weight).over(whole) - F.coalesce(F.sum(open_weight).over(before), F.lit(0.0)))
        .withColumn("rate", F.try_divide(F.sum("source_size").over(whole) - F.col("capped"), F.col("open")))
        .withColumn("from", F.when(has_words & (F.col("rate") * F.col("weight") <= cap), F.struct("place", "rate")))
        .withColumn("from", F.min("from").over(whole))
    )
    target = F.when(~has_words, 0.0).when(F.col("place") < F.col("from.place"), cap).otherwise(F.col("from.rate") * F.col("weight"))
    return per.select("src", "source_size", "n_rows", F.least(target, cap).alias("target"))


def cut(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with source_size, target, epochs (how often all of the source is taken), part (words beyond these) and taken."""
    rows = join_groups(sizes, plan, ["src"])
    n_buckets = F.greatest(F.lit(1.0), F.ceil(F.col("n_rows") / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("unit") * n_buckets)).drop("n_rows")
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("src", "bucket").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["src", "bucket"])
    start = F.col("before") + F.col("ahead")
    budget = F.floor("target")
    rows = rows.withColumn("epochs", F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("epochs") * F.col("source_size") - start)))
    return rows.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mix_plan(docs: DataFrame, seed: int = 17, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs."""
    sizes = sized(docs, seed)
    return cut(sizes, write_shared(budgets(sizes, weights, max_epochs), "budgets")).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: int = 17, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row for each time that a document is taken.

    The row at the cut of a source comes with its first words only, as many as the budget still has; a row of which no
    word is taken is left out.
    """
    whole = sized(docs, seed, whole=True)
    slim = whole.drop("row")
    plan = write_shared(budgets(slim, weights, max_epochs), "budgets")
    last = cut(slim, plan).filter("part > 0").groupBy("src").agg(F.max(F.struct(*ORDER, "part")).alias("last"))
    epochs = F.coalesce(F.floor(F.try_divide(F.floor("target"), F.col("source_size"))), F.lit(0)).cast("int")
    cuts = write_shared(plan.join(last, "src", "left").select("src", "n_rows", epochs.alias("epochs"), F.struct(*(F.col(f"last.{c}") for c in ORDER)).alias("at"), F.col("last.part").alias("part")), "cuts")
    place = F.struct(*ORDER)
    here = F.col("part").isNotNull() & (place == F.col("at"))
    again = F.col("part").isNotNull() & ((place < F.col("at")) | (here & (F.col("part") == F.col("size"))))
    whole_copies = F.array_repeat(F.lit(None).cast("long"), F.col("epochs") + again.cast("int"))
    copies = F.concat(whole_copies, F.when(here & ~again, F.array("part")).otherwise(F.array().cast("array<long>")))
    out = join_groups(whole.filter("size > 0"), cuts, ["src"]).select("row", F.explode(copies).alias("first"))
    first_words = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("first").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("first").isNull(), F.col("row.text")).otherwise(first_words))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("first").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
