"""Near-duplicate groups by an LSH forest over MinHash signatures.

A document's set is that of its distinct n-word shingles. Documents with equal sets form a class, found by a hash of the whole
set, and one row stands for each class from there on. A signature has TREES x DEPTH MinHash values; tree t orders the classes
by the signature rotated to begin at its own values. In each order a class's candidates are its nearest ones, those with the
longest common prefix, provided that the first DEPTH values agree. The orders are range-partitioned, which splits a region
(classes with equal first values) of any size over tasks.

The first round takes the NEAR nearest in all orders. That compares small regions whole; classes of crowded regions go on to
deeper rounds, which order them by other values and look FAR to either side, past all that is already in the same group, and
take the few most alike by signature. Deeper rounds end when one of them links little. They only make the groups large
before the rest: there, every pair of crowded classes that shares a region of any tree and is in two groups is looked at, by
blocks of rows, in the first tree that has both. Regions of one group need nothing then; a region of many groups that stay
apart costs the square of its rows, but gives no pairs: a bitmap of each set bounds the intersection from above, so nearly all
pairs below the threshold end in their block, for certain. Pairs whose signatures differ by far more than chance allows are
left out too; all others are confirmed on the full sets, exactly. A pair at the threshold s shares no tree's first values with
probability (1 - s ** DEPTH) ** TREES, under 1e-8 at 0.8.

Texts that are null or have no word have the empty set and are linked with nothing. Rows that share an id count as one
document with several texts; a null id gets one made from the text, and its component is null where no document of the
group has an id. Repeated rows are in one class. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.llm.common import buffer, discard, hashes, keyed, lean, materialise, mix, shingles, slices, words
from bidloom.llm.components import components

TREES, DEPTH, NEAR = 28, 3, 1
#: Of deeper rounds: places looked at, pairs kept for a row, orders (every fourth), rounds at most; they end when a round links
#: less than one in so many rows. They save work and lose nothing, as the rest looks at all that they leave.
FAR, ALIKE, PART, ROUNDS, WORTH = 64, 2, 4, 24, 50
#: Pairs are left out when their signatures agree less than the threshold by so many standard deviations (chance: under 1e-8).
DEVIATIONS = 6
#: Up to so many ids, the texts of candidates are picked by a Bloom filter of at most 16 MB, beyond by a join.
MOST_FILTERED = 4_000_000
#: Rows of an order that one task reads, about.
ORDER_ROWS = 100_000
#: Rows of a block in the rest, and bytes of bitmaps that are compared at once.
BLOCK, COMPARED = 128, 1 << 22
#: Ids from here on stand for null.
NO_ID = 1 << 62

_random = np.random.default_rng(20240229)
XOR = _random.integers(0, 1 << 32, 512, dtype=np.uint32)
ODD = _random.integers(0, 1 << 31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def with_ids(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text), where a null id becomes a number from NO_ID on, made from the text."""
    made = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_column), 3)
    return df.select(F.coalesce(F.col(id_column).cast("long"), made).alias("id"), F.col(text_column).alias("text"))


def _sets(texts: pa.Array, n_words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased."""
    data, offsets = buffer(pc.ascii_lower(texts))
    of, code, distinct = words(data, offsets)
    found, at = shingles(of, hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64), n_words)
    ends = at.tolist()
    return [np.unique(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signatures(df: DataFrame, n_words: int, values: int) -> DataFrame:
    """(id, n_shingles, set_hash, signature) of (id, text)."""

    def run(texts: pa.Array) -> list[pa.Array]:
        sets = _sets(texts, n_words)
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if size.sum() else np.zeros(0, np.uint64)
        folded = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        full = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[full]
        rows = np.zeros((len(sets), values), np.uint32)
        for i in range(values if len(full) else 0):
            rows[full, i] = np.minimum.reduceat((folded ^ XOR[i]) * ODD[i], starts)
        return [pa.array(size), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in rows], pa.binary())]

    return keyed(run, df, "id long, n_shingles long, set_hash binary, signature binary")


def _sketches(column: pa.Array) -> np.ndarray:
    """Binary rows of equal length as a table of bytes."""
    size = len(column[0].as_py()) if len(column) else 0
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)


def _region_of(values: np.ndarray, tree: int) -> np.ndarray:
    """A hash of a tree and its first values."""
    region = np.full(len(values), tree + 1, np.uint64)
    for i in range(DEPTH):
        region = mix(region * np.uint64(0xA0761D6478BD642F) + values[:, (tree * DEPTH + i) % values.shape[1]])
    return region


def _orders(classes: DataFrame, trees: list[int], turn: int) -> DataFrame:
    """(region, rest, id, group, sketch): a row for each class and tree. Region is a hash of the tree and its first values,
    rest the next four (from ``turn`` on); sketch, a byte of each value, is left out (null) at turn 0."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]).astype(np.uint64)
            bytes_ = (values * np.uint64(0x9E3779B1) >> np.uint64(20)).astype(np.uint8)
            sketch = pa.array([x.tobytes() for x in bytes_], pa.binary()) if turn else pa.nulls(batch.num_rows, pa.binary())
            width = values.shape[1]
            for tree in trees:
                region = _region_of(values, tree)
                rest = np.zeros(len(values), np.uint64)
                for i in range(DEPTH, DEPTH + 4):
                    rest = rest << np.uint64(16) | (mix(values[:, (tree * DEPTH + 4 * turn + i) % width]) & np.uint64(0xFFFF))
                yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(rest.view(np.int64)), batch.column(0), batch.column(1), sketch], names=["region", "rest", "id", "group", "sketch"])

    return classes.select("id", "group", "signature").mapInArrow(lean(run), "region long, rest long, id long, group long, sketch binary")


def _nearest(ordered: DataFrame) -> DataFrame:
    """(a, b), a < b: rows at most NEAR places apart in a region; and (a, null) for rows of regions with more, and for those
    at both ends of a partition, where a region may go on in the next."""

    def run(batches):
        region, ids, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kept = len(ids)
            edge = np.concatenate([edge, batch.column(2).to_numpy()[: NEAR + 1]])[: NEAR + 1]
            region = np.concatenate([region, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(2).to_numpy()])
            found = [np.zeros((2, 0), np.int64)]
            for step in range(1, NEAR + 1):
                near = np.flatnonzero(region[step:] == region[:-step])
                near = near[near + step >= kept]  # pairs within the rows carried over were given before
                found.append(np.stack([ids[near], ids[near + step]]))
            wide = np.flatnonzero(region[NEAR + 1 :] == region[: -NEAR - 1])
            crowded = np.unique(ids[(wide[:, None] + np.arange(NEAR + 2)).ravel()])
            pairs = np.concatenate(found, 1)
            pairs = np.unique(np.sort(pairs[:, pairs[0] != pairs[1]], 0), axis=1)
            region, ids = region[-NEAR - 1 :], ids[-NEAR - 1 :]
            none = pa.nulls(len(crowded), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], crowded])), pa.concat_arrays([pa.array(pairs[1]), none])], names=["a", "b"])
        edge = np.unique(np.concatenate([edge, ids]))
        yield pa.RecordBatch.from_arrays([pa.array(edge), pa.nulls(len(edge), pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(lean(run), "a long, b long")


def _deeper(ordered: DataFrame, least: float) -> DataFrame:
    """(a, b, group_a, group_b), a < b: of the FAR next rows in a region that are in other groups, the ALIKE most alike ones of each row."""

    def run(batches):
        region, ids, group, sketch = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, own = len(ids), _sketches(batch.column(4))
            region, ids, group = (np.concatenate([x, batch.column(i).to_numpy()]) for x, i in ((region, 0), (ids, 2), (group, 3)))
            sketch = own if sketch is None else np.concatenate([sketch, own])
            found = [np.zeros((3, 0))]
            for step in range(1, FAR + 1):
                near = np.flatnonzero((region[step:] == region[:-step]) & (group[step:] != group[:-step]))
                near = near[near + step >= kept]
                alike = (sketch[near] == sketch[near + step]).mean(1)
                near, alike = near[alike >= least], alike[alike >= least]
                found.append(np.stack([near, near + step, -alike]))
            one, two, cost = np.concatenate(found, 1)
            chosen = np.zeros(len(one), bool)
            end, which = np.concatenate([one, two]), np.tile(np.arange(len(one)), 2)
            order = np.lexsort((np.tile(cost, 2), end))
            first = np.searchsorted(end[order], end[order])
            chosen[which[order[np.arange(len(order)) - first < ALIKE]]] = True
            one, two = one[chosen].astype(np.int64), two[chosen].astype(np.int64)
            one, two = np.where(ids[one] < ids[two], one, two), np.where(ids[one] < ids[two], two, one)
            pairs = np.unique(np.stack([ids[one], ids[two], group[one], group[two]]), axis=1)
            region, ids, group, sketch = region[-FAR:], ids[-FAR:], group[-FAR:], sketch[-FAR:]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b", "group_a", "group_b"])

    return ordered.mapInArrow(lean(run), "a long, b long, group_a long, group_b long")


def _sorted(classes: DataFrame, trees: list[int], turn: int, rows: int) -> DataFrame:
    parts = max(1, rows * len(trees) // (ORDER_ROWS // 5 if turn else ORDER_ROWS))
    return _orders(classes, trees, turn).repartitionByRange(parts, "region", "rest", "id").sortWithinPartitions("region", "rest", "id")


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(id, size, bits): a set's size, and a bitmap with at least eight bits for each of its shingles (a power of two)."""

    def run(batches):
        for batch in batches:
            size, maps = [], []
            for x in batch.column(1).to_pylist():
                x = np.frombuffer(x, np.uint64)
                bits = np.zeros(8 << max(0, (len(x) - 1).bit_length()), np.uint8)
                bits[(x & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
                size.append(len(x))
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], names=["id", "size", "bits"])

    return sets.select("id", "shingles").mapInArrow(lean(run), "id long, size long, bits binary")


def _folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap of ``width`` bytes, made by laying the parts of a wider one over each other."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), 0)


def _possible(one: list[bytes], two: list[bytes], size_one: np.ndarray, size_two: np.ndarray, i: np.ndarray, j: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Which pairs (i of one, j of two) may reach the threshold.

    A bit that only one bitmap has stands for a shingle that only that set has, so the bits bound the intersection from above.
    """
    small, large = np.minimum(size_one[i], size_two[j]), np.maximum(size_one[i], size_two[j])
    good = whole * small >= part * large
    width = np.minimum(np.array([len(x) for x in one])[i], np.array([len(x) for x in two])[j])
    for w in np.unique(width[good]).tolist():
        mine = np.flatnonzero(good & (width == w))
        sides = []
        for bits, at in ((one, i[mine]), (two, j[mine])):
            rows, place = np.unique(at, return_inverse=True)
            sides.append((np.stack([_folded(bits[r], w) for r in rows.tolist()]), place))
        for k in range(0, len(mine), max(1, COMPARED // w)):
            at = mine[k : k + max(1, COMPARED // w)]
            x, y = (table[place[k : k + len(at)]] for table, place in sides)
            most = np.minimum(size_one[i[at]] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), size_two[j[at]] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            good[at] = whole * most >= part * (size_one[i[at]] + size_two[j[at]] - most)
    return good


def _regions(held: DataFrame, trees: list[int]) -> DataFrame:
    """(region, tree, id, group): the region of each class in each tree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = _sketches(batch.column(2)).view(np.uint32).astype(np.uint64)
                for k, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(_region_of(values, tree).view(np.int64)), pa.array(np.full(len(values), k, np.int32)), batch.column(0), batch.column(1)], names=["region", "tree", "id", "group"])

    return held.select("id", "group", "signature").mapInArrow(lean(run), "region long, tree int, id long, group long")


def _members(held: DataFrame, trees: list[int]) -> DataFrame:
    """(region, tree, id, group, sketch, regions, size, bits): a row for each class and tree of its ``mixed`` (a bit each);
    ``regions`` are those of all trees."""
    names = ["region", "tree", "id", "group", "sketch", "regions", "size", "bits"]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = _sketches(batch.column(2)).view(np.uint32).astype(np.uint64)
            sketch = pa.array([x.tobytes() for x in (values * np.uint64(0x9E3779B1) >> np.uint64(20)).astype(np.uint8)], pa.binary())
            regions = np.stack([_region_of(values, tree) for tree in trees], 1)
            packed, mixed = pa.array([x.tobytes() for x in regions], pa.binary()), batch.column(5).to_numpy()
            for k in range(len(trees)):
                own = pa.array(np.flatnonzero(mixed >> k & 1))
                columns = [pa.array(regions[:, k].view(np.int64)), pa.array(np.full(len(values), k, np.int32)), batch.column(0), batch.column(1), sketch, packed, batch.column(3), batch.column(4)]
                yield pa.RecordBatch.from_arrays([x.take(own) for x in columns], names=names)

    return held.select("id", "group", "signature", "size", "bits", "mixed").mapInArrow(lean(run), "region long, tree int, id long, group long, sketch binary, regions binary, size long, bits binary")


#: What a block holds of its rows, end to end.
HELD = ("ids", "groups", "sizes", "sketches", "all_regions", "bitmaps")


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, region, tree, least, most, and HELD): rows of a region, at most BLOCK, and their least and greatest group."""

    def run(batches):
        made = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            region, tree, ids, group, size = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 6))
            place = np.arange(len(region))
            first = np.maximum.accumulate(np.where(np.append(True, region[1:] != region[:-1]), place, 0))
            cuts = np.flatnonzero((place - first) % BLOCK == 0)
            ends = np.append(cuts[1:], len(region))
            columns = [made + np.arange(len(cuts)), region[cuts], tree[cuts], np.minimum.reduceat(group, cuts), np.maximum.reduceat(group, cuts)]
            made += len(cuts)
            held = [[x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)] for x in (ids, group, size)]
            held += [[b"".join(x[a:b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)] for x in (batch.column(i).to_pylist() for i in (4, 5, 7))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(pa.array(x, pa.binary()) for x in held)], names=["block", "region", "tree", "least", "most", *HELD])

    return rows.mapInArrow(lean(run), f"block long, region long, tree int, least long, most long, {', '.join(f'{x} binary' for x in HELD)}")


def _block_pairs(one: dict, two: dict, tree: int, least: float, part: int, whole: int) -> np.ndarray:
    """(a, b, group_a, group_b) of two blocks' rows that may be linked and meet in no earlier tree."""
    sides = []
    for r in (one, two):
        ids, group, size = (np.frombuffer(r[x], np.int64) for x in ("ids", "groups", "sizes"))
        width = np.where(size > 1, np.exp2(np.ceil(np.log2(np.maximum(size, 1)))), 1).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(width)]).tolist()
        sides.append((ids, group, size, np.frombuffer(r["sketches"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["all_regions"], np.int64).reshape(len(ids), -1), [r["bitmaps"][a:b] for a, b in zip(at[:-1], at[1:], strict=True)]))
    (ids_a, group_a, size_a, one_sketch, regions_a, bits_a), (ids_b, group_b, size_b, two_sketch, regions_b, bits_b) = sides
    found = []
    for k in range(0, len(ids_a), 16):
        apart = group_a[k : k + 16, None] != group_b
        if one is two:
            apart &= np.arange(k, k + len(apart))[:, None] < np.arange(len(ids_b))
        i, j = np.nonzero(apart & ((one_sketch[k : k + 16, None] == two_sketch).mean(2) >= least))
        found.append(np.stack([i + k, j]))
    i, j = np.concatenate(found, 1)
    new = ~(regions_a[i, :tree] == regions_b[j, :tree]).any(1)
    i, j = i[new], j[new]
    good = _possible(bits_a, bits_b, size_a, size_b, i, j, part, whole)
    i, j = i[good], j[good]
    turned = ids_a[i] > ids_b[j]
    pair = np.stack([ids_a[i], ids_b[j], group_a[i], group_b[j]])
    pair[:, turned] = pair[:, turned][[1, 0, 3, 2]]
    return pair


def _rest(held: DataFrame, sets: DataFrame, trees: list[int], n_deep: int, least: float, part: int, whole: int) -> DataFrame:
    """(a, b, group_a, group_b), a < b: the pairs of different groups in a region of any tree that may be linked, each once.

    Blocks are compared with themselves where they are; only regions of several blocks are joined.
    """
    regions = _regions(held, trees)
    mixed = regions.groupBy(F.col("region").alias("mixed_region")).agg(F.min("group").alias("one"), F.max("group").alias("other")).where("one <> other").select("mixed_region")
    masks = regions.join(mixed, F.col("region") == F.col("mixed_region"), "left_semi").groupBy(F.col("id").alias("mask_of")).agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mixed"))
    known = held.join(masks, F.col("id") == F.col("mask_of")).join(_bitmaps(sets).withColumnRenamed("id", "set_of"), F.col("id") == F.col("set_of"))
    parts = max(1, n_deep * len(trees) // (ORDER_ROWS // 5))
    blocks = materialise(_blocks(_members(known, trees).repartitionByRange(parts, "region", "group", "id").sortWithinPartitions("region", "group", "id")), "blocks")
    several = blocks.groupBy(F.col("region").alias("region_of")).agg(F.count("*").alias("n")).where("n > 1")
    wide = blocks.join(several.select("region_of"), F.col("region") == F.col("region_of"), "left_semi")
    one, two = (wide.select(*(F.col(c).alias(f"{c}_{x}") for c in ("block", "region", "tree", "least", "most"))) for x in "ab")
    apart = (F.col("least_a") != F.col("most_a")) | (F.col("least_b") != F.col("most_b")) | (F.col("least_a") != F.col("least_b"))
    pairs = one.join(two, (F.col("region_a") == F.col("region_b")) & (F.col("block_a") < F.col("block_b")) & apart).select("block_a", "block_b", F.col("tree_a").alias("tree"))
    for x in "ab":
        pairs = pairs.join(wide.select(F.col("block").alias("of"), *(F.col(c).alias(f"{c}_{x}") for c in HELD)), F.col(f"block_{x}") == F.col("of")).drop("of")

    def run(batches):
        for batch in batches:
            found = [np.zeros((4, 0), np.int64)]
            for r in batch.to_pylist():
                one = {c: r[f"{c}_a"] for c in HELD}
                two = {c: r[f"{c}_b"] for c in HELD} if "ids_b" in r else one
                found.append(_block_pairs(one, two, r["tree"], least, part, whole))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, 1)], names=["a", "b", "group_a", "group_b"])

    schema = "a long, b long, group_a long, group_b long"
    within = blocks.where("least <> most").select("tree", *(F.col(c).alias(f"{c}_a") for c in HELD)).mapInArrow(lean(run), schema)
    out = materialise(within.union(pairs.select("tree", *(f"{c}_{x}" for x in "ab" for c in HELD)).mapInArrow(lean(run), schema)), "more")
    discard(blocks)
    return out


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``least`` of their values."""
    one, two = (classes.select(F.col("id").alias(f"id_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab")
    joined = pairs.join(two, F.col("b") == F.col("id_b")).join(one, F.col("a") == F.col("id_a")).select("a", "b", "signature_a", "signature_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_sketches(batch.column(i)).view(np.uint32) for i in (2, 3))
                found = batch.filter(pa.array((x == y).mean(1) >= least))
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["a", "b"])

    return joined.mapInArrow(lean(run), "a long, b long")


def _marks(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """An id's word of a Bloom filter and its three bits there."""
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    mask = np.zeros(len(h), np.uint64)
    for i in range(3):
        mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
    return (h >> np.uint64(24)) % np.uint64(words), mask


def _sets_of(documents: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(id, shingles), stored: the sets of documents with the wanted ids (all sets of an id with several texts), and perhaps of
    a few others; texts aren't shuffled.

    A Bloom filter with 32 bits for each wanted id goes to all tasks. Where there are more than MOST_FILTERED, a join picks
    the documents.
    """
    spark = documents.sparkSession
    n = wanted.count()
    if n > MOST_FILTERED:
        chosen, shared = documents.join(wanted.withColumnRenamed("id", "wanted"), F.col("id") == F.col("wanted"), "left_semi"), None
    else:
        words = max(64, n // 2)

        def mark(batches):
            for batch in batches:
                word, mask = _marks(batch.column(0).to_numpy(), words)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

        found = wanted.select("id").mapInArrow(lean(mark), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        table = np.zeros(words, np.uint64)
        table[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
        chosen, shared = documents, spark.sparkContext.broadcast(table)  # MOST_FILTERED // 2 words at most

    def run(batches):
        for batch in batches:
            if shared is not None and batch.num_rows:
                word, mask = _marks(batch.column(0).to_numpy(), len(shared.value))
                batch = batch.filter(pa.array(shared.value[word] & mask == mask))
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in _sets(part.column(1), n_words)], pa.binary())], names=["id", "shingles"])

    found = materialise(chosen.select("id", "text").mapInArrow(lean(run), "id long, shingles binary").dropDuplicates(["id", "shingles"]), "sets")
    if shared is not None:
        shared.destroy()
    return found


def _confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The pairs (a, b, and what else they have) whose full sets have ``whole`` x intersection >= ``part`` x union."""
    names = pairs.columns
    one, two = (sets.select(F.col("id").alias(f"id_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    joined = pairs.join(two, F.col("b") == F.col("id_b")).join(one, F.col("a") == F.col("id_a")).select(*names, "set_a", "set_b")

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                good[i] = whole * shared >= part * (len(x) + len(y) - shared)
            found = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(found.columns[: len(names)], names=names)

    return joined.mapInArrow(lean(run), pairs.schema)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after linking groups: ``links`` (a, b) has components, or ids without a label."""
    found = components(links)
    moved = materialise(found, "moved")
    discard(found)
    to = moved.select(F.col("id").alias("was"), F.col("component").alias("now"))
    kept = labels.join(to, F.col("component") == F.col("was"), "left").select("id", F.coalesce("now", "component").alias("component"))
    out = materialise(kept.union(moved), "labels")
    discard(moved, labels)
    return out


def class_groups(classes: DataFrame, documents: DataFrame, n_words: int, part: int, whole: int) -> DataFrame:
    """(id, component) of each class that isn't the first of its group. ``classes`` has (id, signature), stored."""
    s = part / whole
    least = s - DEVIATIONS * (s * (1 - s) / (TREES * DEPTH)) ** 0.5
    rows = classes.count()
    trees = list(range(TREES))
    near = materialise(_nearest(_sorted(classes.withColumn("group", F.col("id")), trees, 0, rows)).distinct(), "near")
    likely = materialise(_alike(near.where("b is not null"), classes, least), "likely")
    crowded = near.where("b is null").select(F.col("a").alias("id")).distinct()
    wanted = materialise(likely.select(F.explode(F.array("a", "b")).alias("id")).union(crowded).distinct(), "wanted")
    sets = _sets_of(documents, wanted, n_words)
    found = components(_confirmed(likely, sets, part, whole))
    labels = materialise(found, "labels")
    deep = materialise(classes.join(crowded.withColumnRenamed("id", "deep"), F.col("id") == F.col("deep"), "left_semi").select("id", "signature"), "deep")
    discard(found, near, wanted)
    n_deep, tested, going, held = deep.count(), [likely], True, None

    def grouped():
        return materialise(deep.join(labels.withColumnRenamed("id", "label_of"), F.col("id") == F.col("label_of"), "left").select("id", "signature", F.coalesce("component", "id").alias("group")), "held")

    def untested(pairs):
        for old in tested:
            pairs = pairs.join(old.select(F.col("a").alias("old_a"), F.col("b").alias("old_b")), (F.col("a") == F.col("old_a")) & (F.col("b") == F.col("old_b")), "left_anti")
        return materialise(pairs, "more")

    def linked(new):
        return merged(labels, new.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")))

    for turn in range(1, ROUNDS + 1):
        if not n_deep or not going:
            break
        held = held or grouped()
        more = untested(_deeper(_sorted(held, [t for t in trees if t % PART == turn % PART], turn, n_deep), least).dropDuplicates(["a", "b"]))
        tested.append(more)
        new = materialise(_confirmed(more, sets, part, whole), "links")
        n_new = new.count()
        going = n_new * WORTH >= n_deep
        if n_new:
            labels = linked(new)
            discard(held)
            held = None
        discard(new)
    if n_deep:
        held = held or grouped()
        more = _rest(held, sets, trees, n_deep, least, part, whole)
        new = materialise(_confirmed(more, sets, part, whole), "links")
        labels = labels if new.isEmpty() else linked(new)
        discard(held, more, new)
    discard(sets, deep, *tested)
    return labels


def groups(df: DataFrame, n_words: int = 5, part: int = 80, whole: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component, set_hash) for each row; id and component may be NO_ID or above, for null ids."""
    documents = with_ids(df, id_column, text_column)
    table = materialise(signatures(documents, n_words, TREES * DEPTH), "signatures")
    full = table.where("n_shingles > 0")
    classes = materialise(full.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "classes")
    # Texts that share an id: their classes are linked through it.
    shared = full.groupBy("id").agg(F.min("set_hash").alias("one"), F.max("set_hash").alias("other")).where("one <> other").select("id")
    labels = class_groups(classes, documents, n_words, part, whole)
    if not shared.isEmpty():
        several = full.join(shared.withColumnRenamed("id", "shared"), F.col("id") == F.col("shared"), "left_semi").select("set_hash", F.col("id").alias("own"))
        same = several.join(classes.select("set_hash", F.col("id").alias("class")), "set_hash").join(labels.select(F.col("id").alias("label_of"), "component"), F.col("class") == F.col("label_of"), "left")
        firsts = same.select("own", F.coalesce("component", "class").alias("group"))
        least = firsts.groupBy(F.col("own").alias("of")).agg(F.min("group").alias("a"))
        labels = merged(labels, firsts.join(least, F.col("own") == F.col("of")).select("a", F.col("group").alias("b")))
    return (
        table.select("id", "n_shingles", "set_hash")
        .join(classes.select(F.col("set_hash").alias("class_hash"), F.col("id").alias("class")), (F.col("set_hash") == F.col("class_hash")) & (F.col("n_shingles") > 0), "left")
        .join(labels.select(F.col("id").alias("label_of"), "component"), F.col("class") == F.col("label_of"), "left")
        .select("id", "n_shingles", F.coalesce("component", "class", "id").alias("component"), "set_hash")
    )


def near_duplicates(df: DataFrame, n_words: int = 5, part: int = 80, whole: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the smallest id of its group, and whether it is that one."""
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    found = groups(df, n_words, part, whole, id_column, text_column)
    return found.select(real("id").alias(id_column), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one(df: DataFrame, n_words: int = 5, part: int = 80, whole: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, that are the first of their group; of rows that share an id the one whose text has the
    smallest hash (then the smallest text) stays."""
    found = groups(df, n_words, part, whole, id_column, text_column)
    lost = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("lost")).distinct()
    made = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_column), 3)
    key = "_row_key" + "_" * sum(c.startswith("_row_key") for c in df.columns)
    keyed_rows = df.withColumn(key, F.coalesce(F.col(id_column).cast("long"), made)).join(lost, F.col(key) == F.col("lost"), "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text_column), text_column))
    return keyed_rows.withColumn(f"{key}_", first).where(F.col(f"{key}_") == 1).drop(key, f"{key}_")
