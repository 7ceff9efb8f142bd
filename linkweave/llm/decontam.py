"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import filled, row_key, shingle_hashes, words_of, written

WIDTH, CONTAINMENT = 5, 0.8
#: Chance, at most, that the sketch misses the shortest item at the threshold.
MISS = 1e-3
#: Items of fewer shingles are looked up exactly instead of through the sketch.
LONG = 8
#: Probes up to this number (16 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_PROBES = 500_000


def kept_share(items_least: int, containment: float = CONTAINMENT, miss: float = MISS) -> float:
    """Share of a document's shingles a sketch must keep.

    Of the contained shingles of an item of ``items_least`` shingles, each is in the sketch
    with that probability; all miss it with probability (1 - share)^contained.
    """
    contained = max(1, math.ceil(containment * items_least - 1e-9))
    return 1 - miss ** (1 / contained)


def bins_of(size: int, share: float) -> int:
    """Bins of the sketch of a document in the size partition of ``size`` (from 2^p to 2^(p+1) shingles).

    Within one partition all documents have the same bins, dimensioned for its upper
    bound: with u shingles in K bins a shingle is its bin's minimum with probability
    (1 - e^-l) / l at l = u / K.
    """
    upper = 2 ** (size.bit_length())
    lo, hi = 1e-6, 60.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 - math.exp(-mid)) / mid > share else (lo, mid)
    return max(1, math.ceil(upper / lo))


def _sketch(h: np.ndarray, bins: dict[int, int], share: float) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each of the partition's bins."""
    p = len(h).bit_length()
    k = bins.get(p) or bins.setdefault(p, bins_of(len(h), share))
    where = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # ``h`` is sorted, and so are its bins
    return h[np.r_[True, where[1:] != where[:-1]]]


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, width)) if len(words) >= width else np.empty(0, np.uint64)


def _probes(items: DataFrame, width: int, text: str) -> DataFrame:
    """(item_id, item_key, width, h, n_item): the shingles of each item; one of fewer words than ``width`` is one shingle of its own width."""
    import xxhash

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                words = words_of(data)
                own = min(width, len(words))
                h = _shingles(words, own) if own else np.empty(0, np.uint64)
                if n := len(h):
                    same = lambda x: pa.array(np.full(n, x))  # noqa: E731, B023
                    key = np.uint64(xxhash.xxh64_intdigest(data)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), same(key), same(own), pa.array(h.view(np.int64)), same(n)], ["item_id", "item_key", "width", "h", "n_item"])

    source = items.where("item_id is not null").select("item_id", filled(text).cast("binary").alias("data"))
    return source.mapInArrow(run, StructType([source.schema["item_id"], *StructType.fromDDL("item_key long, width long, h long, n_item long").fields]))


def _mapped(docs: DataFrame, made) -> DataFrame:
    """(id, key, width, h) rows of ``made(words)``, arrays of h by width, for each (doc_id, key, data)."""

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i, data in enumerate(batch.column(2).to_pylist()):
                for width, h in made(words_of(data)):
                    if len(h):
                        out.append((i, width, h))
                        held += len(h)
                if held >= 1 << 17:
                    yield gathered(batch, out)
                    out, held = [], 0
            if out:
                yield gathered(batch, out)

    def gathered(batch, out):
        n = [len(h) for _, _, h in out]
        at = pa.array(np.repeat([i for i, _, _ in out], n))
        width = pa.array(np.repeat(np.array([w for _, w, _ in out], np.int64), n))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), width, pa.array(np.concatenate([h for _, _, h in out]).view(np.int64))], ["id", "key", "width", "h"])

    source = docs.select(F.col("doc_id").alias("id"), "key", "data")
    return source.mapInArrow(run, StructType([source.schema["id"], *StructType.fromDDL("key long, width long, h long").fields]))


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(doc_id, key, item_id, n_shared, n_item) of the items that a document contains.

    A document contains an item if at least ``containment`` of the item's distinct
    ``width``-word shingles are among the document's; an item of fewer words if its whole word sequence
    stands in the document. Wordless items are contained in nothing, and so are items without an id. Null texts count as
    empty; a null doc_id is kept. Rows that repeat a document are searched once for each text, which ``key`` (a hash) tells apart.
    Ids may be of any type; other columns are not read. Empty tables give no rows.

    Items are partitioned by size: the sketch serves those of LONG shingles or more, so that a short item
    doesn't make it keep all of every document; shorter ones are looked up by exact shingles. Documents are partitioned by
    size too; each partition has its own number of bins, so that
    long documents keep as many minima as the shortest item needs. Items are probed with
    all their shingles. Candidates are verified on all shingles of the document.
    """
    probes = written(_probes(items, width, text), "probes")
    # An item_id with several texts is several items that share the id.
    is_long = (F.col("width") == width) & (F.col("n_item") >= LONG)
    size, least = probes.agg(F.count("*"), F.min(F.when(is_long, F.col("n_item")))).first()
    share = kept_share(least or LONG, containment)
    small = size <= BROADCAST_PROBES
    probe = F.broadcast if small else (lambda df: df)
    short = probes.where(~is_long).select("width", "h").distinct()
    widths = [r.width for r in short.select("width").distinct().collect()]  # ``width`` values at most
    # The exact shingles of short items, where few enough to be sent along, keep all other shingles from leaving the worker.
    wanted: dict[int, list[int]] = {w: [] for w in widths}
    for r in short.collect() if small else ():
        wanted[r.width].append(r.h)
    known = {w: np.sort(np.array(h, np.int64).view(np.uint64)) for w, h in wanted.items()} if small else None

    def sketched(words, bins={}):  # noqa: B006  a cache for the life of the worker
        full = _shingles(words, width)
        if least and len(full):
            yield width, _sketch(full, bins.setdefault(share, {}), share)
        for w in widths:
            h = full if w == width else _shingles(words, w)
            yield w, h if known is None else h[np.isin(h, known[w])]

    def whole(words):
        for w in {width, *widths}:
            yield w, _shingles(words, w)

    columns = docs.select("doc_id", row_key(filled(text)).alias("key"), filled(text).cast("binary").alias("data"))
    met = _mapped(columns, sketched).join(probe(probes.select("width", "h").distinct()), ["width", "h"], "left_semi")
    candidates = written(met.select("id", F.col("key").alias("met_key")).distinct(), "candidates")

    source = columns.join(candidates.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("met_key")), "left_semi")
    full = _mapped(source, whole).join(probe(probes), ["width", "h"])
    # Rows that repeat a document repeat its shingles.
    shared = full.groupBy("id", "key", "item_id", "item_key", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    found = shared.where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)
    best = found.groupBy("id", "key", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_shared", "n_item")).alias("m"))
    return best.select(F.col("id").alias("doc_id"), "key", "item_id", "m.n_shared", "m.n_item")


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text contains an item; same columns, whatever their names.

    Rows that repeat a doc_id, or have none, are judged each by its own text. Empty tables take nothing out.
    """
    bad = contained_items(docs, items, containment, width, text).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    bad = written(bad, "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), row_key(filled(text)).alias("key"))
    return rows.join(bad.hint("merge"), F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def op10_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each distinct doc_id and item."""
    found = contained_items(docs, items)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("share"), "n_shared", "n_item")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_shared", "m.n_item", F.round("m.share", 6).alias("containment"))
