"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Equal shingle sets collapse into classes.  Two sets that link must share one of the rarest
shingles of each, so the documents of such a shingle make a tile.  Of a tile of few each pair of
similar size is looked at once, however many tiles it shares; bit counts of hashed bitmaps bound
the overlap from above, and sorted arrays are intersected exactly for pairs that pass.  Documents
that meet in tiles of many form pools, which are tiled by bands of set size.  Such a tile that is
larger than a block meets a few hubs first: who links to a hub is settled, and by the
triangle inequality of the Jaccard distance only documents within twice the allowed distance of
a hub can link to these, so only they, and what is left, are compared block by block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import Words, distinct, mix, shingles, slices, sums, tidy, varlen
from .runtime import Scratch, ship

#: Buckets in which shingles are counted to order them by rarity, fewest and most, bytes of text for each, and the parts that counts travel in.
BUCKETS, BUCKET_BYTES, PARTS = (1 << 16, 1 << 24), 256, 64
#: Documents of a tile up to which their pairs are looked at directly, and documents in a block of a pool's tile.
FEW, BLOCK = 24, 256
#: Hubs that each large tile meets one after another, and parts that its documents are dealt to for that.
HUBS, SALT = 4, 32
#: Ids up to this count are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _sets(s, k: int):
    """Sorted distinct shingle hashes of a slice's documents and the bounds of each document's."""
    w = Words(s)
    h, doc, _ = shingles(w, w.hashes(), k, True)
    h, doc = distinct(h, doc)
    return h, doc, np.searchsorted(doc, np.arange(len(s) + 1))


def _profile(k: int, buckets: int):
    """Of each text: set size and a 128-bit key of the set; of all texts: shingle counts by bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.uint32)
        some = None
        for batch in batches:
            some = batch.column(0).type
            for s in slices(batch.column(1)):
                h, _, bounds = _sets(s, k)
                at, n = np.unique((h & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
                counts[at] += n.astype(np.uint32)
                n = len(s)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s.first, n), pa.array(np.diff(bounds), pa.int64()),
                    pa.array(sums(mix(h), bounds).view(np.int64)), pa.array(sums(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds).view(np.int64)),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ], ["doc_id", "n", "k1", "k2", "part", "counts"])
        if some is not None and counts.any():
            parts = counts.astype("<u4").reshape(PARTS, -1)
            rows = [p for p in range(PARTS) if parts[p].any()]
            empty = [pa.nulls(len(rows), t) for t in (some, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(rows, pa.int32()), pa.array([parts[p].tobytes() for p in rows], pa.binary())], ["doc_id", "n", "k1", "k2", "part", "counts"])

    return run


def _levels(batches):
    """Sum counts by part and reduce them to quarter powers of two, a byte each."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(raw, "<u4").astype(np.int64)
            total[part] = total[part] + more if part in total else more
    if total:
        raw = [np.floor(4 * np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(raw, pa.binary())], ["part", "levels"])


def _prefixes(shared, k: int, percent: int):
    """The shingles of each text of which a linked text must have one: the rarest n - ceil(t n) + 1."""

    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for s in slices(batch.column(1)):
                h, doc, bounds = _sets(s, k)
                n = np.diff(bounds)
                order = np.lexsort((h, levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)], doc))
                h = h[order]
                want = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                first = np.repeat(bounds[:-1], n)
                taken = np.arange(len(h)) - first < np.repeat(want, n)
                ends = np.concatenate([[0], np.cumsum(want)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[taken].view(np.int64)))
                bits = pa.array([_bitmap(x, _width(len(x))).tobytes() for x in np.split(h, bounds[1:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array(n, pa.int64()), lists, bits], ["doc_id", "n", "h", "bits"])

    return run


def _whole_sets(k: int):
    def run(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                h, _, bounds = _sets(s, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), varlen(h, bounds)], ["doc_id", "members"])

    return run


def _width(n: int) -> int:
    """Bits of a set's bitmap: a power of two, 16 times a small set's size or more, 4 times a large one's."""
    return 1 << max(8, math.ceil(math.log2((16 if n < 512 else 4) * max(n, 1))))


def _bitmap(x: np.ndarray, width: int) -> np.ndarray:
    """64-bit words in which a member sets the bit that the low bits of its hash name."""
    flags = np.zeros(width, bool)
    flags[(x & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _bounded(percent: int):
    """Rows ``a, b, n_a, n_b, bits_a, bits_b`` to the pairs whose bitmaps allow the overlap that they need."""

    def passes(na: int, nb: int, x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(u) > len(v):  # the low bits name the place, so halves fold onto each other
            u = u[: len(u) // 2] | u[len(u) // 2 :]
        while len(v) > len(u):
            v = v[: len(v) // 2] | v[len(v) // 2 :]
        most = min(na - int(np.bitwise_count(u & ~v).sum()), nb - int(np.bitwise_count(v & ~u).sum()))
        return (100 + percent) * most >= percent * (na + nb)

    def run(batches):
        for batch in batches:
            rows = (tuple(c[k].as_py() for c in batch.columns) for k in range(batch.num_rows))
            kept = [(a, b) for a, b, na, nb, x, y in rows if passes(na, nb, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _exact(percent: int):
    """Rows ``a, b, members_a, members_b`` to the pairs that link."""

    def run(batches):
        for batch in batches:
            kept = []
            for k in range(batch.num_rows):
                a, b, x, y = (c[k] for c in batch.columns)
                a, b, u, v = a.as_py(), b.as_py(), np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                if 100 * both >= percent * (len(u) + len(v) - both) > 0:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def link_tile(ids: list, blocks: list[int], sets: list[np.ndarray], percent: int, cross: bool, known: int | None = None) -> list[tuple]:
    """Links that connect all documents of a tile which links connect: pairs with 100 * overlap >= percent * union.

    Only pairs of different blocks count if ``cross``.  Pairs already connected are skipped;
    the documents of the block ``known`` are so from the beginning.
    """
    order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
    ids, blocks, sets = [ids[i] for i in order], np.array([blocks[i] for i in order]), [sets[i] for i in order]
    size = np.array([len(x) for x in sets])
    width = _width(int(size[-1]))
    bits = np.array([_bitmap(x, width) for x in sets])
    root = np.arange(len(ids))
    if known is not None and (blocks == known).any():
        root[blocks == known] = int(np.flatnonzero(blocks == known)[0])
    links = []
    for i in range(len(ids) - 1):
        last = int(np.searchsorted(size, size[i] * 100 // percent, "right"))
        j = np.arange(i + 1, last)
        ok = root[j] != root[i]
        if cross:
            ok &= blocks[j] != blocks[i]
        j = j[ok]
        if not len(j):
            continue
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        own = bits[i]
        only_i = np.bitwise_count(own & ~bits[j]).sum(1)
        only_j = np.bitwise_count(bits[j] & ~own).sum(1)
        j, need = (x[np.minimum(size[i] - only_i, size[j] - only_j) >= need] for x in (j, need))
        if not len(j):
            continue
        a = sets[i]
        for c in range(0, len(j), 64):
            jj = j[c : c + 64]
            flat = np.concatenate([sets[x] for x in jj])
            at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
            both = sums((a[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[jj])]))
            for x in jj[both >= need[c : c + 64]]:
                if root[x] != root[i]:
                    root[root == root[x]] = root[i]
                    links.append((ids[i], ids[x]))
    return links


def _tiles(percent: int):
    """Rows ``pool, t, hub, i, j, block, doc_id, members``, those of a tile together, to links.

    Tiles of a hub compare documents near it, block 0, with those that link to it, block 1;
    others compare blocks i and j of what no hub settled.
    """

    def run(batches):
        key, held = None, []

        def done():
            if len(held) < 2 or len({x[0] for x in held}) < 2:
                return None
            hub = key[2] is not None
            found = link_tile([x[0] for x in held], [x[1] for x in held], [np.frombuffer(x[2], "<u8") for x in held], percent, hub or key[3] != key[4], 1 if hub else None)
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = batch.columns
            for k in range(batch.num_rows):
                *now, block, doc, members = (c[k].as_py() for c in columns)
                if now != key:
                    out = done()
                    if out is not None:
                        yield out
                    key, held = now, []
                held.append((doc, block, members))
        out = done()
        if out is not None:
            yield out

    return run


def _near_hub(percent: int):
    """Rows ``pool, t, doc_id, members, hub, hub_members`` to ``pool, t, doc_id, hub, near``: 2 if the document links to the hub, 1 if it may link to one that does, else 0."""

    def run(batches):
        for batch in batches:
            near = []
            members, hubs = batch.column("members"), batch.column("hub_members")
            for k in range(batch.num_rows):
                u, v = np.frombuffer(members[k].as_buffer(), "<u8"), np.frombuffer(hubs[k].as_buffer(), "<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                union = len(u) + len(v) - both
                near.append(2 if 100 * both >= percent * union else 1 if 100 * both >= (2 * percent - 100) * union else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pool", "t", "doc_id", "hub")), pa.array(near, pa.int32())], ["pool", "t", "doc_id", "hub", "near"])

    return run


def _settle(large: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of large tiles (``pool, t, doc_id, members``) to hubs, rows ``pool, t, hub, doc_id, near`` of the documents
    that link to a hub (2) or are near one (1), and ``pool, t, doc_id`` of those that link to none.

    In each round the least document that no hub has settled is a tile's hub.  It goes, with its set,
    to all parts that the tile's documents are dealt to, so no task holds a whole tile.
    """
    left = large.select("pool", "t", "doc_id")
    found = None
    for _ in range(HUBS):
        hubs = left.groupBy("pool", "t").agg(F.min("doc_id").alias("hub"))
        hubs = hubs.join(large.select("pool", "t", F.col("doc_id").alias("hub"), F.col("members").alias("hub_members")), ["pool", "t", "hub"])
        hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = large if found is None else large.join(left, ["pool", "t", "doc_id"], "left_semi")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(hubs, ["pool", "t", "salt"])
        met = rows.select("pool", "t", "doc_id", "members", "hub", "hub_members").mapInArrow(tidy(_near_hub(percent)), "pool long, t int, doc_id long, hub long, near int")
        met = scratch.keep(met, "hubs")
        found = met if found is None else found.unionByName(met)
        left = scratch.keep(met.filter("near < 2").select("pool", "t", "doc_id"), "left")
        if left.isEmpty():
            break
    links = found.filter("near = 2 and doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return links, found.filter("near > 0").select("pool", "t", "hub", "doc_id", "near"), left


def _semi(left: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    return left.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids.hint("shuffle_hash"), "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per input row.

    A text's set is its distinct k-word shingles, or its whole word sequence if it has
    fewer words; words are runs outside ``[\\x20\\x09-\\x0D]``, A-Z as a-z.  Two texts link
    if 100 * intersection >= percent * union; ``component_id`` is the smallest id that links
    reach.  Shingles are told apart by 64-bit hashes, and equal sets by 128 bits of them.  A null text or one without words has size 0 and links with nothing.  Rows that
    repeat an id count as one document, linked if any of its texts is; a null id links its
    equal texts but is never the smallest.  Ids are integers.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << (min(max(size // BUCKET_BYTES, BUCKETS[0]), BUCKETS[1]) - 1).bit_length()
    profile = scratch.keep(rows.mapInArrow(tidy(_profile(k, buckets)), "doc_id long, n long, k1 long, k2 long, part int, counts binary"), "profile")
    own = profile.filter("part is null").select("doc_id", "n", "k1", "k2")
    classes = scratch.keep(own.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")

    parts = profile.filter("part is not null").select("part", "counts").repartition(PARTS, "part")
    got = parts.mapInArrow(_levels, "part int, levels binary").collect()  # a byte for each bucket
    table = np.zeros(buckets, np.uint8)
    for r in got:
        table.reshape(PARTS, -1)[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    # one document of each class goes on
    copies = own.filter("n > 0").join(classes.filter("size > 1"), ["k1", "k2"]).filter("doc_id <> rep or doc_id is null").select("doc_id").filter("doc_id is not null")
    copies = scratch.keep(copies.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").distinct(), "copies")
    n_copies = copies.count()
    first = rows.filter("doc_id is not null and text is not null")
    if n_copies <= BROADCAST_IDS:
        first = first.join(F.broadcast(copies), "doc_id", "left_anti")
    entries = first.mapInArrow(tidy(_prefixes(shared, k, percent)), "doc_id long, n long, h array<long>, bits binary")
    if n_copies > BROADCAST_IDS:
        entries = entries.join(copies, "doc_id", "left_anti")
    prefixes = scratch.keep(entries, "prefixes")
    # each shared shingle with the number of its documents and the least of them; a hot one is split by the join
    entries = prefixes.select("doc_id", "n", F.explode("h").alias("h"))
    keys = entries.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("b")).filter("m > 1")
    tiles = scratch.keep(entries.join(keys.hint("merge"), "h").select("h", "doc_id", "n", "m", "b"), "tiles")

    # tiles of few documents: distinct pairs of similar size, bounded by their bitmaps
    few = tiles.filter(F.col("m") <= FEW)
    left, right = (few.select("h", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = left.join(right, "h").filter(f"a < b and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").drop("h").distinct()
    bits = prefixes.select("doc_id", "bits")
    pairs = scratch.keep(pairs, "pairs")
    likely = pairs.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded(percent), "a long, b long")
    likely = scratch.keep(likely, "likely")

    # tiles of many: pools of documents that meet in them
    many = scratch.keep(tiles.filter(F.col("m") > FEW).select("doc_id", "n", "b").distinct(), "many")
    scratch.drop(tiles, pairs, prefixes)
    band = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    bands = F.explode(F.array(band, band + 1)).alias("t")
    pool = components(many.select(F.col("doc_id").alias("a"), "b"), scratch)
    pool = many.select("doc_id", "n").distinct().join(pool, F.col("doc_id") == F.col("u"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("pool"))
    placed = scratch.keep(pool.select("pool", "doc_id", bands), "pools")
    sizes = scratch.keep(placed.groupBy("pool", "t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "sizes")

    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(placed.select("doc_id")).distinct()
    ids = scratch.keep(ids, "ids")
    members = scratch.keep(_semi(rows, ids, ids.count()).mapInArrow(tidy(_whole_sets(k)), "doc_id long, members binary"), "members")
    found = likely.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(tidy(_exact(percent)), "a long, b long")
    few_large = sizes.filter(F.col("c") > BLOCK).select("pool", "t")  # at most one for each BLOCK documents
    large = placed.join(F.broadcast(few_large) if few_large.count() <= BROADCAST_IDS else few_large, ["pool", "t"])
    large = scratch.keep(large.join(members, "doc_id").select("pool", "t", "doc_id", "members"), "large")
    hub_links, near, rest = _settle(large, percent, scratch)
    near, rest = scratch.keep(near, "near"), scratch.keep(rest, "rest")

    # blocks of documents near a hub with blocks of those that link to it
    cut = near.groupBy("pool", "t", "hub").agg(F.ceil(F.sum((F.col("near") == 1).cast("int")) / BLOCK).cast("int").alias("p"), F.ceil(F.sum((F.col("near") == 2).cast("int")) / BLOCK).cast("int").alias("q"))
    cut = cut.filter("p > 0 and q > 0")
    mine = F.pmod(F.xxhash64("doc_id"), F.when(F.col("near") == 1, F.col("p")).otherwise(F.col("q"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("near") == 1, F.col("q")).otherwise(F.col("p")) - 1))
    beside = near.join(F.broadcast(cut) if cut.count() <= BROADCAST_IDS else cut, ["pool", "t", "hub"]).withColumn("mine", mine).withColumn("o", others)
    i, j = F.when(F.col("near") == 1, F.col("mine")).otherwise(F.col("o")), F.when(F.col("near") == 1, F.col("o")).otherwise(F.col("mine"))
    beside = beside.select("pool", "t", "hub", i.alias("i"), j.alias("j"), (F.col("near") - 1).alias("block"), "doc_id")
    # blocks of what no hub settled, and tiles that are one block
    small = placed.join(sizes.filter(F.col("c") <= BLOCK), ["pool", "t"]).select("pool", "t", F.lit(1).alias("cut"), "doc_id")
    cut = rest.groupBy("pool", "t").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cut"))
    open_ = rest.join(F.broadcast(cut) if cut.count() <= BROADCAST_IDS else cut, ["pool", "t"]).select("pool", "t", "cut", "doc_id").unionByName(small)
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("cut")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    open_ = open_.select("pool", "t", F.lit(None).cast("long").alias("hub"), F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "doc_id")
    blocks = beside.unionByName(open_).join(members, "doc_id").select("pool", "t", "hub", "i", "j", "block", "doc_id", "members")
    blocks = blocks.repartition("pool", "t", "hub", "i", "j").sortWithinPartitions("pool", "t", "hub", "i", "j")
    links = found.unionByName(hub_links).unionByName(blocks.mapInArrow(tidy(_tiles(percent)), "a long, b long"))
    joined = components(links, scratch)

    merged = classes.join(joined, classes["rep"] == joined["u"], "left").select("k1", "k2", "size", F.col("rep"), "component").filter("size > 1 or component is not null")
    merged = scratch.keep(merged.select("k1", "k2", F.coalesce("component", "rep").alias("component")), "merged")
    side = F.broadcast(merged) if merged.count() <= BROADCAST_IDS else merged
    out = own.join(side, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one of the smallest id, with all columns."""
    own = f"__{uuid.uuid4().hex[:12]}"  # no column of the documents is named so
    gone = near_duplicates(docs, k, percent, id_col, text_col).filter("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    gone = Scratch(docs.sparkSession, "gone").keep(gone)
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[id_col] == F.col(own), "left_anti")
