"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Fingerprints are grouped under nodes that share a masked bit pattern. With four blocks
of 16 bits, two fingerprints within two bits agree on two whole blocks, so the six masks
of two blocks form upper nodes that lose no link. Inside a node the members stand in Gray
order (neighbours differ in few bits), runs of members share masked patterns that are
factored into inner nodes, and a search adds up differences from the top down and drops a
whole run as soon as they pass the limit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import filled, row_key, scratch, shingle_hashes, words_of, written
from .components import connected_components

BITS, LIMIT = 64, 2
#: Members under one upper node beyond which the node is split by further mask bits.
SPLIT_ABOVE = 4096
FAN = 16
_BLOCK = 16_384


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pair_masks(blocks: list[int]) -> list[int]:
    return [a | b for a, b in combinations(blocks, 2)]


def _blocks(offsets: list[int], width: int) -> list[int]:
    return [((1 << width) - 1) << o for o in offsets]


#: Six masks of 32 bits; for each, six masks of 16 further bits taken from the other 32.
UPPER = _pair_masks(_blocks([0, 16, 32, 48], 16))


def _lower_masks(upper: int) -> list[int]:
    free = [o for o in range(0, BITS, 8) if not upper >> o & 1]
    return [upper | m for m in _pair_masks(_blocks(free, 8))]


LOWER = [_lower_masks(m) for m in UPPER]


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without any."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[lo : lo + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """Majority bits over the XXH64 of all word shingles, repeats included; zero without words."""
    return majority(shingle_hashes(words_of(data), width))


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; null and wordless texts get zero."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    source = docs.select("doc_id", filled(text).cast("binary").alias("data"))
    return source.mapInArrow(run, StructType([source.schema["doc_id"], StructField("fp", LongType())]))


def gray_rank(fp: Column) -> Column:
    """Position of a word in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """Levels of (mask, pattern) over members in Gray order; level 0 holds the members."""

    def __init__(self, members: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks, patterns = [np.full(len(members), full)], [members]
        while len(masks[-1]) > FAN:
            starts = np.arange(0, len(masks[-1]), FAN)
            ones = np.bitwise_and.reduceat(patterns[-1], starts)
            zeros = np.bitwise_and.reduceat(~patterns[-1], starts)
            shared = np.bitwise_and.reduceat(masks[-1], starts) & (ones | zeros)
            masks.append(shared)
            patterns.append(ones & shared)
        # What a node's parent has checked already isn't counted again.
        for level in range(len(masks) - 1):
            masks[level] = masks[level] & ~np.repeat(masks[level + 1], FAN)[: len(masks[level])]
        self.masks, self.patterns = masks, patterns

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) positions within ``limit`` bits."""
        top = len(self.masks) - 1
        q = np.repeat(np.arange(len(queries)), len(self.masks[top]))
        node = np.tile(np.arange(len(self.masks[top])), len(queries))
        far = np.zeros(len(q), np.int64)
        for level in range(top, -1, -1):
            if level < top:
                q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(self.masks[level])
                q, far, node = q[there], far[there], node[there]
            far = far + _ones((queries[q] ^ self.patterns[level][node]) & self.masks[level][node])
            near = far <= limit
            q, far, node = q[near], far[near], node[near]
        return q, node


def _roots(size: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest position that each position is linked to."""
    root = np.arange(size) if root is None else root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            return root


def _link_node(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each component among the members of one upper node."""
    index, root = GrayIndex(fps), None
    for lo in range(0, len(fps), 1024):
        q, member = index.search(fps[lo : lo + 1024], limit)
        root = _roots(len(fps), q + lo, member, root)
    loose = root != np.arange(len(fps))
    return fps[loose], fps[root[loose]]


def _link_run(node: np.ndarray, fps: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of whole nodes: those of one leaf are compared side by side, larger ones searched."""
    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    sizes = np.diff(np.r_[starts, len(node)])
    small = np.repeat(sizes <= FAN, sizes)
    out = []
    for step in range(1, min(FAN, len(node))):
        hit = np.flatnonzero(small[step:] & (node[step:] == node[:-step]))
        hit = hit[_ones(fps[hit] ^ fps[hit + step]) <= limit]
        out.append((fps[hit], fps[hit + step]))
    for s, n in zip(starts[sizes > FAN], sizes[sizes > FAN]):
        out.append(_link_node(fps[s : s + n], limit))
    return out


def _searcher(limit: int):
    """Reads rows sorted by node and Gray rank; keeps one unfinished node between batches."""

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from emit([c[:cut] for c in cols])
        if held is not None:
            yield from emit(held)

    def emit(cols):
        change = np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
        for a, b in _link_run(np.cumsum(change), cols[2].view(np.uint64), limit):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def _under(masks: list[int], first: int = 0) -> Column:
    return F.array(*[F.struct(F.lit(first + i).alias("node"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern")) for i, m in enumerate(masks)])


def hamming_links(unique: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that span their graph within two bits.

    ``unique``: (fp), each fingerprint once. A node with more members than
    SPLIT_ABOVE is split under six finer masks of 48 bits, which leaves 16 free bits: no
    task ever holds more than 65,536 members of a node, whatever the input. A node gives
    a spanning star of each component and never its pairs.
    """
    rows = unique.select(F.inline(F.transform(_under(UPPER), lambda x: F.struct(x["node"], x["pattern"], F.col("fp")))).alias("node", "pattern", "fp"))
    sizes = written(rows.groupBy("node", "pattern").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    members = rows.join(sizes, ["node", "pattern"])
    fine = F.lit(None)
    for i, masks in enumerate(LOWER):
        fine = F.when(F.col("node") == i, _under(masks, 6 + 6 * i)).otherwise(fine)
    placed = F.when(F.col("n") > SPLIT_ABOVE, fine).otherwise(F.array(F.struct("node", "pattern")))
    placed = members.select("fp", F.explode(placed).alias("at")).select("at.node", "at.pattern", "fp")
    ordered = placed.repartition("node", "pattern").sortWithinPartitions("node", "pattern", gray_rank(F.col("fp")), "fp")
    return ordered.mapInArrow(_searcher(LIMIT), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (doc_id, fp, component_id).

    Fingerprints within two bits link; component_id is the smallest doc_id reachable.
    Equal texts share a fingerprint and are collapsed before the search. Null or wordless
    texts have fingerprint zero and link like any other. Rows that repeat a doc_id count as
    one document with several fingerprints; a null doc_id links texts but never becomes a
    component id. Ids may be of any type with an order. Other columns of ``docs`` are not
    read, whatever their names. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, width, text), "fingerprints")
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "unique")
    shared = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    # An id with several fingerprints ties these together.
    ties = prints.join(shared, "doc_id").select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    labels = connected_components(hamming_links(unique.select("fp")).unionByName(ties))
    placed = written(unique.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component")), "placed")
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    return prints.join(placed.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op1_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    found = simhash_components(docs, 3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near-duplicate stage

BANDS, ROWS = 20, 6
_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _bands(h: np.ndarray) -> np.ndarray:
    """Keys of BANDS groups of ROWS minima over multiply-xor permutations of the shingle hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 2048):
        x = (h[lo : lo + 2048, None] ^ _MIX[0]) * _MIX[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(29))).min(0))
    key = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def _signatures(docs: DataFrame, width: int, text: str) -> DataFrame:
    """(doc_id, key, same, fp, size, bands); ``same`` is equal for texts with the same words, ``size`` counts distinct shingles."""
    import xxhash

    def one(data):
        words = words_of(data)
        h = shingle_hashes(words, width)
        only = np.unique(h)
        return xxhash.xxh3_128_digest(b" ".join(words)), majority(h), len(only), _bands(only).view(np.int64).tolist() if len(h) else []

    def run(batches):
        for batch in batches:
            same, fps, sizes, bands = zip(*map(one, batch.column(2).to_pylist())) if batch.num_rows else ((), (), (), ())
            arrays = [batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "same", "fp", "size", "bands"])

    source = docs.select("doc_id", row_key(filled(text)).alias("key"), filled(text).cast("binary").alias("data"))
    kinds = StructType.fromDDL("key long, same binary, fp long, size long, bands array<long>")
    return source.mapInArrow(run, StructType([source.schema["doc_id"], *kinds.fields]))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, data): the distinct shingle hashes of each text."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.unique(shingle_hashes(words_of(batch.column(1)[i].as_py()), width)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([h], pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("node", "data").mapInArrow(run, "node binary, shingles array<long>")


def _groups(kinds: DataFrame) -> DataFrame:
    """(hub, node): groups of texts, such that any two texts that share a bucket share a group.

    Buckets are the bands' keys and the components of fingerprints within two bits. The
    hub of a bucket is the member that meets the most texts in all its buckets; a bucket goes into the
    group of the heaviest hub that any of its members meets. So nearly all buckets of a
    large family of copies share one group, and a text is in few.
    """
    labels = connected_components(hamming_links(kinds.select("fp").distinct()))
    alike = kinds.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(F.lit(-1).alias("band"), F.coalesce("component", "fp").alias("key"), "node")
    buckets = kinds.select(F.posexplode("bands").alias("band", "key"), "node").unionByName(alike)
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(buckets.join(sizes, ["band", "key"]), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = members.join(weights, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node")).alias("hub"))
    met = written(members.join(hubs, ["band", "key"]).select("band", "key", "node", "hub"), "met")
    heaviest = met.groupBy("node").agg(F.max("hub").alias("heaviest"))
    placed = met.join(heaviest, "node").groupBy("band", "key").agg(F.max("heaviest").alias("m")).select("band", "key", F.col("m.node").alias("hub"))
    return written(met.select("band", "key", "node").join(placed, ["band", "key"]).select("hub", "node").where("hub <> node").distinct(), "groups")


def _apart(a: Column, b: Column) -> Column:
    """The symmetric difference of two sets."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _links_off_hub(rest: DataFrame, share: float) -> DataFrame:
    """Links (a, b) between members of a group that are not yet in one component.

    ``rest`` is (hub, node, component, size, delta), delta being the symmetric difference of a
    member's shingles and its hub's. Differences cancel: x and y differ in as many shingles as
    their deltas do, against whatever set these are taken. So the set is first moved to the shingles of the majority, from
    which copies differ least. With ``excess`` = size of the delta - share * size of the text,
    texts are similar if and only if their deltas share (excess + excess) / 2 or more. If that is not positive, both link to the
    member of least excess without any search. Else they share shingles of their deltas that occur in
    two or more: of these, rarest first, each needs to index only as many as leave fewer than
    what it must share with the best of the other components. Where that leaves none, as
    for most copies with changes of their own, a text is held against nobody.
    """
    each = rest.select("hub", F.explode("delta").alias("shingle"))
    sizes = rest.groupBy("hub").agg(F.count("*").alias("members"))
    often = each.groupBy("hub", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    moved = often.join(sizes, "hub").where(2 * F.col("n") > F.col("members")).groupBy("hub").agg(F.collect_list("shingle").alias("moved"))
    shifted = rest.join(moved, "hub", "left").withColumn("delta", F.when(F.col("moved").isNull(), F.col("delta")).otherwise(_apart(F.col("delta"), F.col("moved")))).drop("moved")
    shifted = written(shifted.withColumn("excess", F.size("delta") - share * F.col("size")), "shifted")

    least = shifted.groupBy("hub").agg(F.min(F.struct("excess", "node", "component")).alias("least"))
    bound = shifted.join(least, "hub")
    stars = bound.where(F.col("excess") + F.col("least.excess") <= 1e-6).select(F.col("node").alias("a"), F.col("least.node").alias("b"))
    second = bound.where("component <> least.component").groupBy("hub").agg(F.min("excess").alias("second"))
    bound = least.join(second, "hub").select("hub", F.col("least.excess").alias("first"), F.col("least.component").alias("main"), "second")

    each = shifted.select("hub", "node", F.explode("delta").alias("shingle"))
    often = each.groupBy("hub", "shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = each.join(often, ["hub", "shingle"]).groupBy("hub", "node").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    common = shifted.drop("delta").join(common, ["hub", "node"]).join(bound, "hub")
    # What a text can share at most bounds the excess of a partner.
    common = common.withColumn("reach", 2 * F.size("common") - F.col("excess"))
    partner = F.when(F.col("component") == F.col("main"), F.col("second")).otherwise(F.col("first"))
    common = written(common.withColumn("must", F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / 2 - 1e-6))).where("must <= size(common)"), "common")
    farthest = common.groupBy("hub", (F.col("component") == F.col("main")).alias("in_main")).agg(F.max("reach").alias("reach"))
    farthest = farthest.groupBy("hub").agg(F.max("reach").alias("any_reach"), F.max(F.when(~F.col("in_main"), F.col("reach"))).alias("off_reach"))
    able = common.join(farthest, "hub").where(F.col("excess") <= F.when(F.col("component") == F.col("main"), F.col("off_reach")).otherwise(F.col("any_reach")) + 1e-6)
    able = written(able.select("hub", "node", "component", "main", "size", "excess", "reach", "must", F.transform("common", lambda x: x["shingle"]).alias("common")), "able")

    # Of a pair, the text of less excess is looked up by the other: both share its own excess or more.
    side = ["node", "component", "size", "excess", "reach", "in_main"]
    held = able.withColumn("in_main", F.col("component") == F.col("main")).withColumn("first", F.greatest("must", F.ceil(F.col("excess") - 1e-6)))
    keys = lambda df, must, tag: df.select("hub", *[F.col(c).alias(f"{c}{tag}") for c in side], F.explode(F.expr(f"slice(common, 1, greatest(0, size(common) - {must} + 1))")).alias("shingle"))
    indexed, asking = keys(held, "first", ""), keys(held, "must", "_y")
    similar = (F.col("size") >= F.col("size_y") * ((1 - share) / (1 + share)) - 1e-6) & (F.col("size_y") >= F.col("size") * ((1 - share) / (1 + share)) - 1e-6)
    reached = (F.col("excess") <= F.col("reach_y") + 1e-6) & (F.col("excess_y") <= F.col("reach") + 1e-6) & (F.col("excess") + F.col("excess_y") > 1e-6)
    ordered = (F.col("excess") < F.col("excess_y")) | ((F.col("excess") == F.col("excess_y")) & (F.col("node") < F.col("node_y")))
    meet = lambda x, y: x.join(y, ["hub", "shingle"]).where((F.col("component") != F.col("component_y")) & ordered & similar & reached)
    # Two texts of the main component never meet.
    pairs = meet(indexed, asking.where("not in_main_y")).unionByName(meet(indexed.where("not in_main"), asking.where("in_main_y")))
    pairs = written(pairs.select("hub", "node", "node_y", "excess", "excess_y").distinct(), "pairs")
    held = pairs.join(able.select("hub", "node", "common"), ["hub", "node"]).join(able.select("hub", F.col("node").alias("node_y"), F.col("common").alias("common_y")), ["hub", "node_y"])
    found = held.where(2 * F.size(F.array_intersect("common", "common_y")) >= F.col("excess") + F.col("excess_y") - 1e-6)
    return stars.unionByName(found.select(F.col("node").alias("a"), F.col("node_y").alias("b")))


def near_duplicate_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """(doc_id, component_id) for each distinct doc_id, over links of Jaccard ``similarity``.

    Texts with the same words collapse first. Texts meet in a group (:func:`_groups`) if the Gray-ordered index
    puts their fingerprints in one component or, because a 64-bit SimHash spreads pairs
    of this similarity over some 16 bits, if one of 20 bands of 6 min-hashes is equal (0.998 of the pairs at 0.8 meet).
    Within a group the search is exact and complete: every member is held against the
    hub on whole shingle sets, and members off the hub's component against each other by what they don't share
    with the hub (:func:`_links_off_hub`). No group is cut or sampled and none emits its pairs.

    Rows with a null doc_id are left out here; an id with several texts ties these
    together. Wordless texts are equal to each other and similar to nothing else. Other columns are not read.
    """
    share = (1 - similarity) / (1 + similarity)
    known = docs.where("doc_id is not null")
    with scratch():
        signed = written(_signatures(known, width, text), "signatures")
        kinds = signed.groupBy(F.col("same").alias("node")).agg(F.min(F.struct("doc_id", "key", "fp", "size", "bands")).alias("m"))
        kinds = written(kinds.select("node", "m.*"), "texts")
        groups = _groups(kinds)

        in_play = groups.select("node").union(groups.select("hub")).distinct()
        wanted = kinds.select("doc_id", "key", "node").join(in_play, "node", "left_semi")
        texts = known.select("doc_id", row_key(filled(text)).alias("key"), filled(text).cast("binary").alias("data")).join(wanted.hint("merge"), ["doc_id", "key"])
        sets = written(_shingle_sets(texts.groupBy("node").agg(F.first("data").alias("data")), width), "shingles")

        of_hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub"))
        met = groups.join(sets, "node").join(of_hub, "hub")
        met = met.select("hub", "node", F.size("shingles").alias("size"), F.size("of_hub").alias("hub_size"), _apart(F.col("shingles"), F.col("of_hub")).alias("delta"))
        met = written(met.withColumn("linked", F.size("delta") <= share * (F.col("size") + F.col("hub_size")) + 1e-6), "deltas")

        several = signed.groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo <> hi")
        ties = signed.join(several, "doc_id").select(F.col("same").alias("a"), F.col("lo").alias("b"))
        labels = written(connected_components(met.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")).unionByName(ties)), "labels")

        rest = met.join(labels, "node", "left").select("hub", "node", F.coalesce("component", "node").alias("component"), "size", "delta")
        mixed = rest.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("hub")
        rest = written(rest.join(mixed, "hub", "left_semi"), "rest")
        links = _links_off_hub(rest, share).unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected_components(links)

        placed = kinds.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
        placed = written(placed, "placed")
        smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        owner = placed.join(smallest, "component").select(F.col("node").alias("same"), "component_id")
        found = signed.select("doc_id", "same").join(owner, "same").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        return written(found, "near-duplicates", keep=True)


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Of rows that repeat the kept doc_id, one stays (smallest text hash). Rows with a null
    doc_id all stay. Columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    kept = near_duplicate_components(docs, width, similarity, text).where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.col("doc_id").alias("id"), row_key(filled(text)).alias("tie"), F.struct("*").alias("row"))
    first = Window.partitionBy("id").orderBy("tie")
    once = rows.join(kept.hint("merge"), "id", "left_semi").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    return once.select("row").unionByName(rows.where("id is null").select("row")).select("row.*")
