"""Near copies at a similarity, by long SimHash fingerprints.

``simhash`` links 64-bit fingerprints that differ in a few bits, which near copies
at a similarity of 0.8 don't: about 15 % of their bits differ.  So here a
text's fingerprint has ``BITS`` bits, each the majority of one hash bit over its different
shingles of ``SHINGLE_WORDS`` words, and texts are linked if at most the share of
bits differs that the similarity stands for, with a margin (``limit``) of 1.7 deviations
so that 95 % of the pairs right at the similarity are linked.

``keep_one``, the pipeline's stage, finds them by multi-index hashing (``multi_index``).
``near_copies`` has bands of least hashes for keys, whose chance to meet depends on the similarity alone,
so that its rows don't grow with the logarithm of the corpus as segments do.  For both:

1. Equal fingerprints are folded to one node.
2. With bands, each node has ``BANDS`` keys of ``ROWS`` least hashes of its shingles.  A key with more than ``hot_entry`` nodes is
   split by ``SPLITS`` further keys of ``SPLIT_ROWS`` other least hashes each, so that what
   shares only a passage parts.  A pair right at the similarity meets with a chance of
   99.4 % in the first, and again in the second.
3. Each entry is one task's walk from fingerprint to fingerprint by complete distances,
   always to those not reached yet; split entries with more than ``BLOCK`` nodes are dealt to pairs of blocks.  So all members
   that chains of links connect are connected, no pairs are listed, and a group
   of copies costs about as many comparisons as it has members.
4. Components of the links are the groups.

Null and empty texts have fingerprint zero and are one group; a text of fewer
words than a shingle is one shingle; a very long text is one row's work.  Rows
with equal ids and texts are one place, rows with equal ids and different texts are each
in their own.  An empty table has no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as common
from . import multi_index
from .components import components
from .simhash import SEED

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 1024
BANDS, ROWS = 13, 5
SPLITS, SPLIT_ROWS = 5, 2
HOT_ENTRY = 64
BLOCK = 32768
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def differing(similarity: float) -> float:
    """Share of bits in which two texts of this Jaccard similarity differ: the angle of their sets of shingles, of one size, over pi."""
    return acos(2 * similarity / (1 + similarity)) / pi


def limit(similarity: float = SIMILARITY, bits: int = BITS) -> int:
    q = differing(similarity)
    return int(bits * q + 1.7 * sqrt(bits * q * (1 - q)))


def rows_for_each_text(bands: int = BANDS, splits: int = SPLITS) -> tuple[int, int]:
    """Table rows of a text: at least, and if all its entries are hot; whatever the corpus."""
    return bands, bands * splits


def shingles(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Different hashes of a text's shingles of lower-cased words."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :])], dtype=np.uint64))


def fingerprint(hashes: np.ndarray, bits: int = BITS) -> bytes:
    """The majority of each bit over the hashes of shingles; of none, zeros."""
    if not len(hashes):
        return bytes(bits // 8)
    lanes = np.arange(1, bits // 64 + 1, dtype=np.uint64) * _GOLDEN
    ones = np.zeros(bits, dtype=np.int64)
    for at in range(0, len(hashes), 1024):  # 1 MB of bits at a time
        mixed = _mix(hashes[at : at + 1024, None] ^ lanes)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


def keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS, splits: int = SPLITS, split_rows: int = SPLIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A text's keys in the tables and those that split a hot entry; no shingles have none."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    factors = _factors(bands * rows + splits * split_rows)
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * factors).min(axis=0), out=least)

    def of(part: np.ndarray, first: int) -> np.ndarray:
        out = np.arange(first, first + len(part), dtype=np.uint64)
        for column in part.T:
            out = _mix(out * _GOLDEN ^ column)
        return out.view(np.int64)

    cut = bands * rows
    return of(least[:cut].reshape(bands, rows), 1), of(least[cut:].reshape(splits, split_rows), 1001)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """``(id, key, fp, keys, splits)``; ``key`` is the hash of the text, which tells rows of one id apart."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch.column(0), "key": batch.column(1), "fp": [], "keys": [], "splits": []}
        for text in common.each_text(batch.column(2)):
            hashes = shingles(text, shingle_words)
            own, more = keys(hashes)
            out["fp"].append(fingerprint(hashes, bits))
            out["keys"].append(own)
            out["splits"].append(more)
        return out

    return common.map_arrow(named, rows, "id long, key long, fp binary, keys array<long>, splits array<long>")


def prints_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, bits: int = BITS) -> DataFrame:
    """``(id, key, fp)`` as of ``fingerprints``."""
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))

    def rows(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "key": batch.column(1), "fp": [fingerprint(shingles(text, shingle_words), bits) for text in common.each_text(batch.column(2))]}

    return common.map_arrow(named, rows, "id long, key long, fp binary")


def _runs(names: list[str], make: Callable[[dict[str, np.ndarray | pa.Array], np.ndarray], dict], schema: str, df: DataFrame) -> DataFrame:
    """``df``, sorted by ``names`` within its partitions, through ``make`` of columns and begins of whole runs of equal ``names``; a run that goes on in the next batch waits for it."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    common.bounded_batches(df.sparkSession)
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def result(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
        out = make({n: table.column(n).combine_chunks() for n in table.column_names}, begins)
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in kinds], names=kinds.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            if last is not None and (keys == last).all():
                held.append(batch)
                continue
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(changes[-1]) if len(changes) else 0
            table = pa.Table.from_batches([*held, batch.slice(0, cut)])
            if table.num_rows:
                whole = np.stack([table.column(n).to_numpy() for n in names], axis=1)
                yield result(table, np.append(0, np.flatnonzero((whole[1:] != whole[:-1]).any(axis=1)) + 1))
            held, last = [batch.slice(cut)], keys[-1]
        if held:
            yield result(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return df.mapInArrow(run, schema)


def walk(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect all rows of ``prints`` (bytes) that chains of distances up to ``most`` connect."""
    lanes = np.ascontiguousarray(prints).view(np.uint64)
    unseen = np.arange(len(lanes))
    a, b = [], []
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            at = queue.pop()
            near = np.zeros(len(unseen), dtype=np.int64)
            for k in range(lanes.shape[1]):
                near += np.bitwise_count(lanes[unseen, k] ^ lanes[at, k])
            found = unseen[near <= most]
            unseen = unseen[near > most]
            queue.extend(found.tolist())
            a.append(np.full(len(found), at))
            b.append(found)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(a), join(b)


def links(nodes: DataFrame, most: int, hot_entry: int = HOT_ENTRY, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` of ``nodes`` (node, fp, keys, splits), a durable table, that connect what their keys find."""
    sized = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    table = nodes.select("node", F.explode("keys").alias("key"))
    sizes = common.durable(sized(table))
    few, many = sizes.filter(F.col("n") <= hot_entry).select("key"), sizes.filter(F.col("n") > hot_entry).select("key")
    cold = table.join(few, "key").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "node")
    hot = nodes.select("node", "splits", F.explode("keys").alias("key")).join(many, "key")
    split = common.durable(hot.select("node", "key", F.explode("splits").alias("split")).select("node", F.xxhash64("key", "split").alias("key")))
    return walked(cold.unionByName(blocked(split, block)), nodes, most).distinct()


def blocked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, i, j, node)`` of ``members`` (key, node), a durable table: each goes to the pairs of blocks of its key that its own block is in."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    return members.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", mine).select("key", F.explode(each).alias("p"), "node").select("key", "p.i", "p.j", "node")


def walked(members: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """``(a, b)`` that connect what chains of distances up to ``most`` connect in each (key, i, j) of ``members``."""
    members = members.join(nodes.select("node", "fp"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def of_runs(columns: dict, begins: np.ndarray) -> dict:
        node = columns["node"].to_numpy()
        prints = np.frombuffer(b"".join(columns["fp"].to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(node)], strict=True):
            if y - x > 1:
                one, two = walk(prints[x:y], most)
                a.append(node[x:y][one])
                b.append(node[x:y][two])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    return _runs(["key", "i", "j"], of_runs, "a long, b long", members)


def _placed(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle_words: int, bits: int, hot_entry: int, block: int, bands: bool) -> DataFrame:
    """``(id, key, least, least_key)`` of each row: itself, and the smallest id of its group with the smallest text hash of that id."""
    prints = common.durable((fingerprints if bands else prints_only)(docs, id_col, text_col, shingle_words, bits))
    # texts of one fingerprint have nearly the same shingles; the least keys stand for all
    held = [F.min(F.struct("keys", "splits")).alias("held")] if bands else []
    whole = prints.groupBy("fp").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("copies"), *held)
    nodes = common.durable(whole.select("fp", "least", "copies", *(["held.*"] if bands else []), F.monotonically_increasing_id().alias("node")))
    most = limit(similarity, bits)
    near = links(nodes, most, hot_entry, block) if bands else multi_index.links(nodes, most, differing(similarity), bits, hot_entry, block)
    joined = components(near).withColumnRenamed("node", "_node")
    labelled = nodes.join(joined, F.col("node") == F.col("_node"), "left").select("fp", "least", "copies", F.coalesce("root", "node").alias("root"))
    labelled = common.durable(labelled)
    roots = common.durable(labelled.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n")))
    by_print = common.durable(common.join_counted(labelled.select("root", "fp", "copies"), roots, ["root"]).select("fp", "first", F.col("copies").alias("n")))
    return common.join_counted(prints.select("id", "key", "fp"), by_print, ["fp"]).select("id", "key", F.col("first.id").alias("least"), F.col("first.key").alias("least_key"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bits: int = BITS, hot_entry: int = HOT_ENTRY, block: int = BLOCK) -> DataFrame:
    """``(id, component)``: of each row the smallest id that chains of near copies reach, its own included; candidates are those of the bands."""
    return _placed(docs, id_col, text_col, similarity, shingle_words, bits, hot_entry, block, True).select("id", F.col("least").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle_words: int = SHINGLE_WORDS, bits: int = BITS, hot_entry: int = multi_index.HOT_ENTRY, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, and of several texts of this id the one with the smallest hash.

    Candidates are found by multi-index hashing of the fingerprints.  Of rows with equal ids and texts one stays, the first by a hash of all its columns.  Rows
    without an id can't stand for a group or be told apart; they all stay.  Only documents that
    may go are shuffled (``common.suspects``).
    """
    named = docs.filter(F.col(id_col).isNotNull())
    placed = _placed(named, id_col, text_col, similarity, shingle_words, bits, hot_entry, block, False)
    stays = (F.col("id") == F.col("least")) & (F.col("key") == F.col("least_key"))
    return common.keep_first(docs, placed.select("id", "key", stays.alias("stays")), id_col, text_col)
