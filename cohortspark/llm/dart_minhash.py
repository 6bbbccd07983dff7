"""Near-duplicates by DartMinHash signatures and banded joining.

A document is a weighted set: its five-word shingles, each weighted by how often it occurs (a text
of one to four words is one shingle). Similarity is weighted Jaccard, sum of minima over sum of
maxima. DartMinHash throws darts at the plane weight x rank of every shingle: the plane is cut
into regions, a hash of (shingle, region) gives the region's Poisson number of darts, and a hash
of each dart its weight position, rank and signature coordinate. Darts under the shingle's weight
and below rank ``t / total weight`` count; each coordinate keeps the earliest. With
``t = k ln k + 2k`` few coordinates stay empty; those documents throw again up to twice the rank.
Two documents agree in a coordinate with probability equal to their similarity.

Signatures of 240 coordinates make 40 bands of 6: a pair at similarity 0.8 shares no band with
probability 5e-6. Pairs that share a band are then checked exactly on their shingles.

No bucket is expanded into all pairs:
* equal shingle multisets (all exact copies) are one node from the start;
* in every bucket the other nodes are compared with its hub only, the node with the most bucket
  companions over all its bands, which in a group of copies is the original;
* after connected components of those links, only buckets that still hold more than one component
  compare nodes of different components. A node takes part only if enough of its shingles occur in
  another such node for it to have any partner at all (exact; this removes documents that share
  one common passage). Pairs go through a length, a shared-shingle and a sketch test (128 one-bit
  samples of the signature; a true pair fails the last with probability below 1e-10), then the
  exact check, all inside the join: it gives out links only. Buckets of more than ``BUCKET_BLOCK`` such
  nodes are joined block by block, so no task holds a bucket.
Every candidate pair is thus either checked or already connected.

Defined cases: texts without words (NULL, empty, blank) are equal to each other and to nothing
else; equal rows are rows of one class, and rows that share an id are in the class of their text; rows without an id belong to classes but
``keep_one`` keeps them; ties take the smallest id; an empty table gives no rows; texts of any
length are read whole; other columns are ignored. Nodes are 64-bit hashes of the shingle multiset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortspark.llm.common import groups_of, map_batches, mix64, small_batches, stored, text_bytes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
BUCKET_BLOCK = 1024
BATCH_ROWS = 1024
SKETCH_BITS, SKETCH_LIMIT = 128, 36
GOLD = np.uint64(0x9E3779B97F4A7C15)
# regions along the rank axis at unit weight: widths 1/8, 1/4, ... 8, then 8 each
WIDTHS = [0.125 * 2**i for i in range(7)]


def poisson_cdf(mean: float) -> np.ndarray:
    terms = np.cumsum([np.exp(-mean)] + [0.0] * 63)
    p = np.exp(-mean)
    for i in range(1, 64):
        p *= mean / i
        terms[i] = terms[i - 1] + p
    return terms


CDFS = [poisson_cdf(w) for w in WIDTHS]


def region_starts(n: int) -> np.ndarray:
    widths = np.array(WIDTHS + [WIDTHS[-1]] * max(0, n - len(WIDTHS)))[:n]
    return np.concatenate([[0.0], np.cumsum(widths)[:-1]])


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, weight) of every distinct shingle, ordered by document, hash."""
    words = [b.split() for b in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    n = max(0, len(flat) - width + 1)
    acc = np.full(n, np.uint64(width))
    for j in range(width):
        acc = acc * GOLD + hashed[j:n + j]
    inside = doc[:n] == doc[width - 1:width - 1 + n]
    at, h = doc[:n][inside], mix64(acc[inside])
    firsts = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        own = []
        for d in short:
            v = np.full(1, np.uint64(sizes[d]))
            for j in range(sizes[d]):
                v = v * GOLD + hashed[firsts[d] + j]
            own.append(mix64(v)[0])
        at, h = np.concatenate([at, short]), np.concatenate([h, np.array(own, np.uint64)])
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])]))
    return at[new], h[new], np.diff(np.append(new, len(h)))


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, k: int):
    """(document, coordinate, rank) of every dart under its element's weight and its document's rank reach."""
    out, band = [], 0
    while True:
        low = 2.0**band - 1
        sel = np.flatnonzero(weight > low)
        if not len(sel):
            break
        scale = 2.0**band                       # a region is ``scale`` wide in weight and narrower in rank
        limit = reach[doc[sel]] * scale
        starts = region_starts(len(WIDTHS) + int(max(0.0, limit.max()) // WIDTHS[-1]) + 2)
        n_regions = np.searchsorted(starts, limit, side="left")
        e = np.repeat(sel, n_regions)
        region = np.arange(len(e)) - np.repeat(np.cumsum(n_regions) - n_regions, n_regions)
        seed = mix64(element[e] + GOLD * (region.astype(np.uint64) * np.uint64(64) + np.uint64(band + 1)))
        u = (seed >> np.uint64(11)) * 2.0**-53
        level = np.minimum(region, len(WIDTHS) - 1)
        count = np.zeros(len(e), dtype=np.int64)
        for i, cdf in enumerate(CDFS):
            m = level == i
            count[m] = np.searchsorted(cdf, u[m], side="right")
        d = np.repeat(np.arange(len(e)), count)
        i = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
        one = mix64(seed[d] + GOLD * (i.astype(np.uint64) + np.uint64(1)))
        two = mix64(one ^ np.uint64(0xD6E8FEB86659FD93))
        rank = (starts[region[d]] + (one >> np.uint64(11)) * 2.0**-53 * np.array(WIDTHS)[level[d]]) / scale
        position = low + scale * (two & np.uint64(0xFFFFFFFF)) * 2.0**-32
        ok = (position < weight[e[d]]) & (rank < reach[doc[e[d]]])
        out.append((doc[e[d]][ok], ((two >> np.uint64(32)) % np.uint64(k)).astype(np.int64)[ok], rank[ok]))
        band += 1
    return [np.concatenate(c) for c in zip(*out)]


def signatures(n_docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """n_docs x k earliest ranks (inf in rows without elements). A rank identifies its dart."""
    sig = np.full(n_docs * k, np.inf)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    mine = np.ones(len(doc), dtype=bool)
    while mine.any():
        at, coordinate, rank = darts(doc[mine], element[mine], weight[mine], reach, k)
        np.minimum.at(sig, at * k + coordinate, rank)
        empty = np.isinf(sig.reshape(n_docs, k)).any(axis=1) & (total > 0)
        reach = np.where(empty, 2 * reach, reach)
        mine = empty[doc]
    return sig.reshape(n_docs, k)


def as_long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def node_hashes(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Hash of the shingle multiset of each of ``n`` documents."""
    node = np.zeros(n, np.uint64)
    np.add.at(node, doc, mix64(element ^ GOLD) * (weight.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    return mix64(node)


def document_rows(texts: list[bytes], bands: int, rows: int) -> dict[str, np.ndarray | list]:
    """node, n, bands and sketch of every text."""
    doc, element, weight = shingles(texts)
    n, k = len(texts), bands * rows
    node = node_hashes(n, doc, element, weight)
    sig = signatures(n, doc, element, weight.astype(float), k).view(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLD, (n, bands)).copy()
    cells = sig.reshape(n, bands, rows)
    for j in range(rows):
        key = mix64(key * GOLD + cells[:, :, j])
    n_bits = min(SKETCH_BITS, k)
    bit = (mix64(sig[:, :n_bits]) & np.uint64(1)).astype(np.uint8)
    bit = np.pad(bit, ((0, 0), (0, SKETCH_BITS - n_bits)))
    sketch = np.packbits(bit, axis=1).view(np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
    return {"node": as_long(node), "n": total, "bands": as_long(key), "s1": as_long(sketch[:, 0].copy()),
            "s2": as_long(sketch[:, 1].copy())}


def signature_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """id, node (hash of the shingle multiset), n (its weight), bands, s1, s2: a row per document."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, parts = text_bytes(batch["text"]), []
        for lo, hi in groups_of(texts, 1 << 18, 128):   # bounds the darts of a slice
            parts.append(document_rows(texts[lo:hi], bands, rows))
        got = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        keys = pa.ListArray.from_arrays(np.arange(0, len(texts) * bands + 1, bands, dtype=np.int32), got["bands"].reshape(-1))
        return pa.RecordBatch.from_arrays([batch["id"], got["node"], got["n"], keys, got["s1"], got["s2"]],
                                          ["id", "node", "n", "bands", "s1", "s2"])

    src = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = src.schema["id"].dataType.simpleString()
    return map_batches(src, run, f"id {kind}, node bigint, n bigint, bands array<bigint>, s1 bigint, s2 bigint")


def unit_table(df: DataFrame) -> DataFrame:
    """node and units of every row of (id, text): a shingle that occurs w times has w units, so that
    weighted Jaccard of documents is plain Jaccard of unit sets."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nodes, units = text_bytes(batch["text"]), [], []
        for lo, hi in groups_of(texts, 1 << 19):
            doc, element, weight = shingles(texts[lo:hi])
            nodes.append(as_long(node_hashes(hi - lo, doc, element, weight)))
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            unit = as_long(mix64(np.repeat(element, weight) + GOLD * nth.astype(np.uint64)))
            cuts = np.cumsum(np.bincount(doc, weights=weight, minlength=hi - lo).astype(np.int64))[:-1]
            units += np.split(unit, cuts)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(units, pa.list_(pa.int64()))],
                                          ["node", "units"])

    return map_batches(df, run, "node bigint, units array<bigint>")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """Connected components of undirected links (a, b): (node, root), root the smallest node. Alternating
    large-star and small-star rounds; every round is a stored table. Each star is an aggregation and a
    join back, so a node of any degree is never gathered in one task."""
    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        spread = both.join(least, "a")
        kept = spread.filter(F.col("b") > F.col("a")) if large else spread
        out = kept.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    edges, before = links.select("a", "b").filter("a <> b").distinct(), None
    while True:
        edges = stored(star(star(edges, True), False), name)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = state


def hamming(a: str, b: str) -> F.Column:
    return (F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
            + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2"))))


def plausible(a: str, b: str, similarity: float) -> F.Column:
    """Length and sketch tests that a pair at the similarity passes."""
    size = F.least(f"{a}.n", f"{b}.n") >= F.lit(similarity) * F.greatest(f"{a}.n", f"{b}.n")
    return size & (hamming(a, b) <= SKETCH_LIMIT)


def enough(both: F.Column, a: str, b: str, similarity: float) -> F.Column:
    """Whether ``both`` common units are a similarity of at least the threshold for sizes a and b."""
    return both >= F.lit(similarity) * (F.col(a) + F.col(b) - both)


def with_partners(nodes: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """node, common, units of the ``nodes`` (node, n) that may have a partner among them: ``common`` is the
    number of a node's units that occur in another one. No partner has more of its units than that."""
    held = units.join(nodes, "node").select("node", "n", F.explode("units").alias("unit"))
    twice = held.groupBy("unit").agg(F.count("*").alias("c")).filter("c > 1").select("unit")
    common = held.join(twice, "unit").groupBy("node", "n").agg(F.count("*").alias("common"))
    return common.filter(F.col("common") >= F.lit(similarity) * F.col("n")).drop("n").join(units, "node")


def verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    one = units.select(F.col("node").alias("a"), F.col("units").alias("ua"))
    two = units.select(F.col("node").alias("b"), F.col("units").alias("ub"))
    both = F.size(F.array_intersect("ua", "ub"))
    return (pairs.join(one, "a").join(two, "b").withColumn("both", both)
            .filter(F.col("both") >= F.lit(similarity) * (F.size("ua") + F.size("ub") - F.col("both"))).select("a", "b"))


def hot_buckets(rest: DataFrame, able: DataFrame) -> DataFrame:
    """key and number of blocks of the buckets with more than ``BUCKET_BLOCK`` able nodes."""
    sizes = rest.join(able.select("node"), "node", "left_semi").groupBy("key").agg(F.count("*").alias("in_key"))
    return sizes.filter(F.col("in_key") > BUCKET_BLOCK).select("key", F.ceil(F.col("in_key") / BUCKET_BLOCK).cast("int").alias("blocks"))


def in_blocks(side: DataFrame, hot: DataFrame, every: bool = False) -> DataFrame:
    """``side`` (key, node, ...) with a block number: the node's own one of its bucket's blocks, or (``every``) a row for
    each. Joined on (key, block), own against every, each two nodes meet once, and a hot bucket is compared by as
    many tasks as it has blocks."""
    x = side.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if every else F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return x.withColumn("block", block).drop("blocks")


def classes_of_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, node, root (the node that names its class), class_id and class_size."""
    docs = df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    with small_batches(df.sparkSession, BATCH_ROWS):
        sig = stored(signature_table(docs, "id", "text", bands, rows), "dart-signatures")
    nodes = stored(sig.groupBy("node").agg(
        F.min("id").alias("low"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("s1").alias("s1"),
        F.first("s2").alias("s2"), F.first("bands").alias("bands")), "dart-nodes")

    # buckets with at least two nodes
    banded = nodes.filter("n > 0").select("node", "n", "s1", "s2", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = stored(banded.join(shared, "key"), "dart-members")

    # links to the hub of each bucket
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    hub = members.join(degree, "node").groupBy("key").agg(
        F.max(F.struct("degree", "node", "n", "s1", "s2")).alias("hub")).select("key", "hub.*")
    stars = members.alias("m").join(hub.alias("h"), "key").filter(
        (F.col("m.node") != F.col("h.node")) & plausible("m", "h", similarity))
    first = stored(stars.select(F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b")).distinct(),
                   "dart-stars")

    # texts of nodes in shared buckets, as unit sets; any row of a node will do
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("low").alias("want"))
    fetched = docs.join(wanted.distinct(), F.col("id").eqNullSafe(F.col("want")), "left_semi")
    with small_batches(df.sparkSession, BATCH_ROWS):
        units = stored(unit_table(fetched).dropDuplicates(["node"]), "dart-units")
    links = stored(verified(first, units, similarity), "dart-links")
    root = components(links, "dart-components")

    # buckets that still hold several components: compare across components
    rooted = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rest = stored(rooted.join(mixed, "key", "left_semi"), "dart-rest")
    able = stored(with_partners(rest.select("node", "n").distinct(), units, similarity), "dart-able")
    hot = stored(hot_buckets(rest, able), "dart-hot")
    side = rest.join(able, "node").select("key", "node", "n", "root", "s1", "s2", "common", "units")
    across = in_blocks(side, hot).alias("x").join(in_blocks(side, hot, every=True).alias("y"), (F.col("x.key") == F.col("y.key"))
                                  & (F.col("x.block") == F.col("y.block")) & (F.col("x.node") < F.col("y.node"))
                                  & (F.col("x.root") != F.col("y.root")) & plausible("x", "y", similarity)
                                  & enough(F.least("x.common", "y.common"), "x.n", "y.n", similarity)
                                  & enough(F.size(F.array_intersect("x.units", "y.units")), "x.n", "y.n", similarity))
    more = stored(across.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "dart-links")
    if not more.isEmpty():
        root = components(links.unionByName(more), "dart-components")

    by_node = nodes.select("node", "low", "rows").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = by_node.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("rows").alias("class_size"))
    placed = by_node.join(classes, "root").select("node", "root", "class_id", "class_size")
    return sig.select("id", "node").join(placed, "node").select("id", "node", "root", "class_id", "class_size")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class) and class_size."""
    return classes_of_rows(df, id_col, text_col, **options).select(F.col("id").alias(id_col), "class_id", "class_size")


def row_nodes(df: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``df`` as structs ``row``, with ``node``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, nodes = text_bytes(batch["row"].field(text_col)), []
        for lo, hi in groups_of(texts, 1 << 19):
            doc, element, weight = shingles(texts[lo:hi])
            nodes.append(as_long(node_hashes(hi - lo, doc, element, weight)))
        return pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate(nodes))], ["row", "node"])

    src = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    return map_batches(src, run, StructType([*src.schema.fields, StructField("node", LongType())]))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one document of each class (its smallest id), all columns. Of several rows
    of that id in one class the one with the least text, then the least other columns, stays; rows of one id
    in different classes are different documents; rows without an id stay."""
    found = stored(classes_of_rows(df, id_col, text_col, **options), "dart-classes")
    ids = found.groupBy(F.col("id").alias("__id")).agg(
        F.count("*").alias("__rows"), F.bool_or(F.col("id") == F.col("class_id")).alias("__first"))
    once = ids.filter("__id IS NOT NULL AND __rows = 1 AND __first").select("__id")
    many = stored(ids.filter("__id IS NOT NULL AND __rows > 1 AND __first").select("__id"), "dart-repeated")
    same = F.col(id_col) == F.col("__id")
    out = df.join(once, same, "left_semi").unionByName(df.filter(F.col(id_col).isNull()))
    if many.isEmpty():
        return out
    leading = found.filter("id = class_id").select(F.col("id").alias("__id"), F.col("node").alias("__node"), "root").distinct()
    rows = row_nodes(df.join(many, same, "left_semi"), text_col)
    placed = rows.join(leading, (F.col(f"row.`{id_col}`") == F.col("__id")) & (F.col("node") == F.col("__node")))
    order = F.struct(F.col(f"row.`{text_col}`"), F.to_json("row"))
    kept = placed.groupBy("__id", "root").agg(F.min_by("row", order).alias("row"))
    return out.unionByName(kept.select("row.*"))
