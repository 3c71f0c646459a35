"""Near duplicates by MinHash signatures and bands, verified by exact Jaccard similarity.

A text is the set of its shingles: ``words`` words in a row, lower-cased (A-Z), or all it has if they
are fewer.  Equal sets are one class from the start.  A signature has the least value of each of
``bands * rows`` linear hash functions over the set, and classes that agree in all rows of a
band share its key.

Sets take more room than their texts, so a first pass keeps a row's digest and keys only.  Classes that chains of
shared keys connect are a group.  The texts of classes in groups, one for each class, are read again, and a group of up to
``GROUP_TEXTS`` classes and ``GROUP_SHINGLES`` shingles is walked in one task, from class to class, always to those not
reached yet.  Larger groups go by key (``links``).  Of a key's classes

1. in each of ``LEADERS`` rounds one leads, and those not reached yet are compared with it;
2. what no leader reached is open, and so is what a later leader reached but an earlier one nearly did (``border``), as it
   may be similar to one that the earlier leader took.  Jaccard distance is a metric, so nothing farther off can be;
3. open ones are compared with those of the key that no links connect with them yet, in one task, or where a key has more than
   ``GROUP_TEXTS`` classes or ``GROUP_SHINGLES`` shingles, in one for each pair of blocks of them.  No pairs are listed.

So all classes that chains of similar ones connect within a key are connected, a group of
near copies costs a comparison for each member and key, and no key is capped.  What bands miss is
missed: at a similarity right at 0.8 and with 13 bands of 5 rows one pair in 170.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..session import durable, sparing
from . import graph, skew

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 13, 5
LEADERS = 2
#: Modulus of the hash functions.
PRIME = (1 << 31) - 1
#: Classes and shingles of a group or block that a task has at once, at most, and shingles that are one bin, about.
GROUP_TEXTS, GROUP_SHINGLES, BIN_SHINGLES = 2000, 1_000_000, 500_000
#: Words of 64 bits that tell which rows may be asked for; their number bounds what is sent to tasks.
FILTER_WORDS = 1 << 19


def coefficients(n: int) -> list[tuple[int, int]]:
    """Factor and summand of each hash function, by a rule."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest(), 16)
    return [(number(f"factor {i}") % (PRIME - 1) + 1, number(f"summand {i}") % PRIME) for i in range(n)]


def shingles(text: Column, words: int = WORDS) -> Column:
    """The different 60-bit hashes of a text's shingles; of a null or empty text there are none."""
    own = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t-\r]+"), "")
    number = lambda g: F.conv(F.substring(F.md5(g), 1, 15), 16, 10).cast("long")

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: number(F.array_join(F.slice(w, i, words), " "))))

    none = F.array().cast("array<bigint>")
    # the words are a variable, so that they are split once and not for each shingle
    return F.element_at(F.transform(F.array(own), lambda w: F.when(F.size(w) == 0, none).otherwise(of(w))), 1)


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes that ``shingles`` has of a text, sorted."""
    own = text.lower().split()  # of bytes both know ASCII alone
    joined = b" ".join(own)
    if len(own) <= words:
        grams = [joined] if own else []
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        grams = [joined[a:b] for a, b in zip(starts, ends[words - 1 :])]
    md5 = hashlib.md5
    return np.unique((np.frombuffer(b"".join([md5(g).digest()[:8] for g in grams]), ">u8") >> 4).astype(np.int64))


@lru_cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = zip(*coefficients(n), strict=True)
    return np.array(a, np.int64), np.array(b, np.int64)


def signature(own: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of ``n`` hash functions over the hashes."""
    a, b = _factors(n)
    x, least = own % PRIME, np.full(n, PRIME, np.int64)
    for at in range(0, len(x), 512):  # 512 * n values at a time
        v = x[at : at + 512, None] * a
        v += b
        v = (v & PRIME) + (v >> 31)  # below 2 * PRIME - 1 now, and the same modulo PRIME
        v = (v + ((v + 1) >> 31)) & PRIME
        np.minimum(least, v.min(axis=0), out=least)
    return least


def band_keys(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """A key for each band of the signature; no shingles have none."""
    if not len(own):
        return []
    parts = signature(own, bands * rows).reshape(bands, rows)
    return [int.from_bytes(hashlib.sha256(b"%d " % k + part.tobytes()).digest()[:8], "big", signed=True) for k, part in enumerate(parts)]


def digest(own: np.ndarray) -> bytes:
    return hashlib.sha256(own.tobytes()).digest()[:16]


def marks(named: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``(id, mark, digest, n, keys)`` of each row of ``named`` (id, mark, text): of its shingles the digest, the number and the keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                own = hashes(text, words)
                digests.append(digest(own))
                sizes.append(len(own))
                keys.append(band_keys(own, bands, rows))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "mark", "digest", "n", "keys"])

    added = [StructField("digest", BinaryType()), StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))]
    return named.select("id", "mark", F.col("text").cast("binary").alias("text")).mapInArrow(run, StructType([named.schema["id"], named.schema["mark"], *added]))


def texts(named: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (id, mark, ...), a durable table, with the ``text`` of one row of ``named`` (id, mark, text) each.

    Each row asked for sets a bit of a filter of ``FILTER_WORDS`` words, and only rows that find theirs are shuffled;
    many rows asked for only fill it.
    """
    own = F.xxhash64("id", "mark")
    word, bit = F.pmod(own, F.lit(FILTER_WORDS)), F.shiftrightunsigned(own, 50)
    one = F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")
    filled = durable(asked.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(one).alias("_bits")))
    found = named.select("*", word.alias("_word"), bit.alias("_bit")).join(F.broadcast(filled), "_word").filter(F.col("_bits").bitwiseAND(one) != 0)
    return found.select("id", "mark", "text").dropDuplicates(["id", "mark"]).join(asked, ["id", "mark"])


class _Held:
    """Sets, and how many members of one each of others has."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        own, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.begins = np.append(0, np.cumsum(self.sizes)[:-1])
        self.at = np.split(self.flat, self.begins[1:])
        self.here = np.zeros(len(own), bool)

    def similar(self, x: int, asked: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``asked`` that are similar to ``x``."""
        n, m = self.sizes[x], self.sizes[asked]
        asked = asked[np.minimum(n, m) >= similarity * np.maximum(n, m)]
        if not len(asked):
            return asked
        self.here[self.at[x]] = True
        if len(asked) * 8 < len(self.at):
            common = np.array([np.count_nonzero(self.here[self.at[y]]) for y in asked])
        else:
            common = np.add.reduceat(self.here[self.flat], self.begins, dtype=np.int64)[asked]
        self.here[self.at[x]] = False
        return asked[common >= similarity * (n + self.sizes[asked] - common)]


def walk(sets: list[np.ndarray], keys: np.ndarray, similarity: float) -> np.ndarray:
    """For each of ``sets`` the first that chains of pairs with a common key (a row of ``keys`` each) and the similarity reach."""
    held, root, unseen = _Held(sets), np.arange(len(sets)), np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if unseen[first] else []
        unseen[first] = False
        while queue:
            x = queue.pop()
            asked = np.flatnonzero(unseen)
            near = held.similar(x, asked[(keys[asked] == keys[x]).any(axis=1)], similarity)
            root[near] = first
            unseen[near] = False
            queue.extend(near.tolist())
    return root


def joined(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray, opened: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between similar ones of ``sets`` of which one is open, until all that they connect is: those of equal ``part`` are already.

    If there are two sides, what is on one of them is done elsewhere.
    """
    held, part, both, found = _Held(sets), part.copy(), side.min() < side.max(), []
    for x in np.flatnonzero(opened).tolist():
        asked = np.flatnonzero((part != part[x]) & (side != side[x]) if both else part != part[x])
        if len(near := held.similar(x, asked, similarity)):
            parts, places = np.unique(part[near], return_index=True)
            found += [(x, int(y)) for y in near[places]]
            part[np.isin(part, parts)] = part[x]
    return found


def walked(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """``(node, root)`` of ``members`` (node, group, bin, digest, keys, text), a class of each node once; a bin's groups are walked in one task."""

    def run(table: pa.Table) -> pa.Table:
        group, node = (table.column(c).to_numpy() for c in ("group", "node"))
        order = np.argsort(group, kind="stable")
        root = node.copy()
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            rows = table.take(own)
            sets = [hashes(t, words) for t in rows.column("text").to_pylist()]
            if any(digest(s) != d for s, d in zip(sets, rows.column("digest").to_pylist(), strict=True)):
                raise ValueError("a text changed between the two passes over it")
            root[own] = node[own][walk(sets, np.array(rows.column("keys").to_pylist()), similarity)]
        return pa.table({"node": pa.array(node), "root": pa.array(root)})

    return members.withColumn("text", F.col("text").cast("binary")).groupBy("bin").applyInArrow(run, "node long, root long")


def border(similarity: float) -> float:
    """The least similarity to a set that one can have which is similar to one that is similar to it."""
    return 2 * similarity - 1 - 1e-9


def compared(pairs: DataFrame, sets: DataFrame, similarity: float, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose sets have at least the Jaccard similarity ``least``, and ``close``: whether they have ``similarity``."""
    side = lambda name: sets.select(F.col("id").alias(name), F.col("shingles").alias(f"_{name}"))
    whole = pairs.join(side("a"), "a").join(side("b"), "b")
    n, m = F.size("_a"), F.size("_b")
    sized = whole.filter(F.least(n, m) >= least * F.greatest(n, m)).select(*pairs.columns, (n + m).alias("_n"), F.size(F.array_intersect("_a", "_b")).alias("_common"))
    share = lambda s: F.col("_common") >= F.lit(s) * (F.col("_n") - F.col("_common"))
    return sized.filter(share(least)).select(*pairs.columns, share(similarity).alias("close"))


def links(sets: DataFrame, keyed: DataFrame, similarity: float, leaders: int = LEADERS) -> DataFrame:
    """``(a, b)``: links that connect all of ``sets`` (id, shingles) that similar ones with a common key connect; ``keyed``: (id, keys)."""
    each = keyed.select("id", F.explode("keys").alias("key"))
    shared = durable(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    entries = left = durable(each.join(shared, "key"))
    found = beyond = None
    for k in range(leaders):
        leader = left.groupBy("key").agg(F.min_by("id", F.xxhash64(F.lit(k), "id")).alias("a"))
        asked = durable(left.join(leader, "key").filter("a <> id").select("a", F.col("id").alias("b"), "key"))
        near = durable(compared(asked.select("a", "b").distinct(), sets, similarity, border(similarity)))
        close = near.filter("close").select("a", "b")
        found = close if found is None else found.unionByName(close)
        left = durable(asked.join(close, ["a", "b"], "left_anti").select("key", F.col("b").alias("id")))
        beside = asked.join(near.filter("NOT close"), ["a", "b"]).select("key", F.col("b").alias("id"))
        beyond = beside if beyond is None else beyond.unionByName(beside)
    found = durable(found)
    open_ = left.unionByName(beyond).distinct().withColumn("open", F.lit(True))
    parts = graph.components(found).withColumnRenamed("node", "id")
    whole = entries.join(open_, ["key", "id"], "left").join(parts, "id", "left")
    whole = durable(whole.select("key", "id", F.coalesce("component", "id").alias("part"), F.coalesce("open", F.lit(False)).alias("open")))
    undone = whole.groupBy("key").agg(F.max("open").alias("o"), F.min("part").alias("p"), F.max("part").alias("q")).filter("o AND p <> q").select("key")
    return found.unionByName(met(durable(whole.join(undone, "key")), sets, similarity))


def met(entries: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: links that connect what similar ones of a key's ``entries`` (key, id, part, open), a durable table, do, if one is open."""
    sized = durable(entries.join(sets.select("id", F.size("shingles").alias("n")), "id"))
    of_key = sized.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_TEXTS), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j")))
    dealt = durable(skew.lookup(sized, durable(of_key), "key").select("key", "id", "part", "open", "n", (mine).alias("side"), F.explode(pairs).alias("p")))
    bins = (dealt.agg(F.sum("n")).first()[0] or 0) // BIN_SHINGLES + 1
    dealt = dealt.select("id", "part", "open", "side", F.xxhash64("key", "p.i", "p.j").alias("group")).withColumn("bin", F.pmod("group", F.lit(bins)))

    def run(table: pa.Table) -> pa.Table:
        group, node, part, side = (table.column(c).to_numpy() for c in ("group", "id", "part", "side"))
        opened = table.column("open").to_numpy(zero_copy_only=False)
        order, found = np.argsort(group, kind="stable"), [np.zeros((0, 2), np.int64)]
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            held = [np.asarray(s.values) for s in table.column("shingles").take(own)]
            found += [node[own][[pair]] for pair in joined(held, part[own], side[own], opened[own], similarity)]
        a, b = np.concatenate(found).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return durable(dealt.join(sets, "id").groupBy("bin").applyInArrow(run, "a long, b long"))


def grouped(classes: DataFrame) -> DataFrame:
    """Those of ``classes`` (node, n, keys, ...), a durable table, that share a key with another, with their ``group`` and whether it is ``large``."""
    each = classes.select("node", F.explode("keys").alias("key"))
    # written before the join, so that a hot key's rows can be split
    shared = durable(each.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a"))
    near = each.join(shared, "key").filter("a <> node").select("a", F.col("node").alias("b"))
    groups = graph.components(durable(near.distinct())).withColumnRenamed("component", "group")
    own = durable(classes.join(groups, "node"))
    sizes = own.groupBy("group").agg(F.count(F.lit(1)).alias("_texts"), F.sum("n").alias("_shingles"))
    large = (F.col("_texts") > GROUP_TEXTS) | (F.col("_shingles") > GROUP_SHINGLES)
    return durable(skew.lookup(own, durable(sizes.select("group", large.alias("large"))), "group"))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, representative, class_id)`` for each row with an id: the smallest id with the same set, and the smallest that chains of similar texts reach.

    Texts without words are one class.  Rows of one id with different texts are each in their class.
    """
    with sparing(docs.sparkSession):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        # a row is known by its id and its text's mark, as several may have one id
        named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("mark"), text.alias("text"))
        read = durable(marks(named, words, bands, rows))
        classes = read.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        classes = durable(classes.select("digest", "least.id", "least.mark", "n", "keys", F.monotonically_increasing_id().alias("node")))
        groups = grouped(classes)
        small, large = groups.filter("NOT large"), groups.filter("large")
        total, some_large = groups.agg(F.sum(F.when(~F.col("large"), F.col("n"))), F.max("large")).first()
        found = classes.select("node", F.col("node").alias("root")).limit(0)
        if total:
            bins = total // BIN_SHINGLES + 1
            found = durable(walked(texts(named, small).withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(bins))), words, similarity))
        if some_large:
            large = durable(large)
            sets = durable(texts(named, large).select(F.col("node").alias("id"), shingles(F.col("text"), words).alias("shingles")))
            linked = graph.components(links(sets, large.select(F.col("node").alias("id"), "keys"), similarity))
            found = found.unionByName(linked.select("node", F.col("component").alias("root")))
        placed = classes.select("node", "digest", F.col("id").alias("representative")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = durable(placed.select("digest", "representative", "root"))
        least = placed.groupBy("root").agg(F.min("representative").alias("class_id"))
        whole = durable(placed.join(least, "root").select("digest", "representative", "class_id"))
    return skew.lookup(read.select("id", "digest"), whole, "digest").select("id", "representative", "class_id")
