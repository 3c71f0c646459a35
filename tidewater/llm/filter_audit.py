"""How filters interact: what each one removes at each step of every order in which they may be applied.

A document's failures are a mask of bits, so a table of any size comes down to
cells, a part and a mask with their numbers of documents.  Cells are unpivoted
against the steps of all orders (a cell for each step); a running bit-or over
the steps before tells whether a document had gone by then.  Conditional sums
over the cells give each step's figures, and a total over the orders of each
filter the Shapley figure.

The five filters of ``failures`` are A: too few words, B: too few different
words, C: too many capitals, D: a symbol, E: the text of a smaller id,
compared by 128 bits of its SHA-256 digest.  Rows with equal ids and texts are
copies of nobody's smaller id; a null id is neither a copy nor has copies, and
has no labels.  A null text is an empty one, which has no words: it fails A, and E.
Copies, repeated rows and repeated ids are combined in the tasks that read
them before they are shuffled, and texts are never shuffled.  An empty table
has no parts and no rows.  Other columns are not read, so their names can't
clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SYMBOL = r"[#$%&*|]"
FILTERS = "ABCDE"
#: Null ids match no label; they are spread over so many keys.
_SPREAD = 1024


def bit(letter: str, letters: str = FILTERS) -> int:
    return 1 << letters.index(letter)


def _flag(fails: Column, letter: str) -> Column:
    return F.when(fails, bit(letter)).otherwise(0)


def failures_of_text(text: Column) -> Column:
    """The mask of the filters that look at one text alone (A to D)."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words)
    return (
        _flag(n < MIN_WORDS, "A")
        + _flag(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n, "B")
        + _flag(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS_PERCENT * F.length(text), "C")
        + _flag(text.rlike(SYMBOL), "D")
    )


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part (a null is an empty string) by the filters that they fail, and those labelled quality 1 and toxic 1 among them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("digest"),
        failures_of_text(text).alias("mask"),
    )
    rows = read.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("spread", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SPREAD))).otherwise(0))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.filter("id IS NOT NULL AND (good = 1 OR toxic = 1)").withColumn("spread", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = rows.withColumn("spread", F.col("spread").cast("long")).join(known, ["id", "spread"], "left").withColumns({"good": zero("good"), "toxic": zero("toxic")})
    # an id occurs once with each of these, so the smallest one has a number of rows
    copies = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_without"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.when(F.col("least") == least, F.col("n_least")).otherwise(0) + F.col("n_without")
    held = copies.withColumn("first", first).select("part", "mask", "good", "toxic", F.col("first"), (F.col("n") - F.col("first")).alias("later"))
    each = held.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), F.col("first").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), F.col("later").alias("n")))).alias("cell"))
    return (
        each.select("part", "good", "toxic", "cell.mask", "cell.n")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("toxic") * F.col("n")).alias("toxic"))
        .filter("n > 0")
    )


def audit(cells: DataFrame, letters: str = FILTERS) -> DataFrame:
    """For each part, order of ``letters`` and step the numbers of documents, zeros included; the filter of bit 2**k is the k-th letter.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (fail its filter but were
    removed earlier), ``unique_fails`` (fail its filter only), ``good_lost`` and
    ``toxic_lost`` (removed with that label), ``shapley`` (what its filter removes,
    summed over all orders).
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    long = cells.withColumn("filter_order", orders).withColumn("step", steps)
    long = long.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)"))
    long = long.withColumn("failing", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("failed", F.coalesce(F.bit_or("failing").over(earlier), F.lit(0)))
    here, gone = F.col("failing") != 0, F.col("failed") != 0
    total = lambda condition, n="n": F.sum(F.when(condition, F.col(n)).otherwise(0))
    found = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~here & ~gone).alias("kept"),
        total(here & ~gone).alias("removed"),
        total(here & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & ~gone, "good").alias("good_lost"),
        total(here & ~gone, "toxic").alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
