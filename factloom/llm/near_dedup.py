"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text's five-word shingles are a weighted set (weight: how often a shingle
occurs).  Darts are thrown by hash into the region (weight x rank) of every
element: a dart's place depends on the element and the dart's number alone, so
texts that share weight share darts.  Of the darts whose rank is below
``t / total weight`` each of ``k`` coordinates keeps the earliest; a coordinate
still empty doubles the rank limit.  Two signatures agree in a coordinate with
the probability of the weighted Jaccard similarity.

Bands of coordinates are joined, each bucket's members are held against one
leader, and the exact weighted similarity decides.  Buckets that still hold
several classes are searched on.  Small ones give their pairs across classes
for verification.  The members of larger ones, with ``wide`` more coordinates
of a byte each, meet in blocks inside a task: a class that fills a block has
blocks of its own, which never meet one another, so a bucket that is nearly
one class costs little more than its rows.  Only pairs that these coordinates
put within five standard deviations of the threshold count.  Texts of few
shingles carry these along, so that the task itself decides about their pairs
and passes on links alone, as many as join classes; of the others it passes on
all that are not sure, and of sure ones as many as join classes; a sure pair that
verification refused joins none in later rounds, so what it held back comes out
then.  That goes on until no bucket gives a pair that was not verified and none holds one back, so
no link between classes is lost and no bucket is expanded into rows of all its
pairs.

Defined cases: a null text counts as empty; texts without a word are of one
class only with byte-equal texts; equal rows are one document; rows with null
ids are classed by their text, and a class's id is its smallest non-null id
(null if it has none).  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, digest, heavy_keys, join_split, maybe_broadcast, small_batches, text_or_empty
from factloom.llm.textbytes import U, column_bytes, chunks, mix, seeded, shingles, trim, words


@dataclass(frozen=True)
class NearDedup:
    """Production parameters."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    #: Buckets of up to so many texts give all their pairs across classes.
    small_bucket: int = 16
    wide: int = 2048
    block: int = 1024
    #: Texts of so many different shingles carry them into the blocks.
    carried: int = 512
    #: Pairs of one text that a task verifies, about; a text with more is copied.
    fan: int = 2000
    broadcast_bytes: int = 32 << 20


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements, their texts and weights (counts), by text and element."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h))).astype(float)


def dart_signatures(elements: np.ndarray, owner: np.ndarray, weights: np.ndarray, texts: int, k: int) -> np.ndarray:
    """A row of ``k`` dart ids for each text; texts without elements have zeros.

    Weights are any positive numbers: each unit slab of an element's region
    receives a Poisson process of darts in rank, and a dart also has a place
    in its slab, which counts only if the weight reaches it.
    """
    out = np.zeros((texts, k), U)
    total = np.bincount(owner, weights, texts)
    limit = np.divide(k * (math.log(k) + 2), total, out=np.zeros(texts), where=total > 0)
    todo = total > 0
    while todo.any():
        use = todo[owner]
        e, o, w = elements[use], owner[use], weights[use]
        slabs = np.ceil(w).astype(np.int64)
        which = np.repeat(np.arange(len(e)), slabs)
        depth = np.arange(len(which)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        seed = mix(e[which] + depth.astype(U) * U(0xA0761D6478BD642F))
        own, left = o[which], w[which] - depth
        rank = np.zeros(len(seed))
        best = np.full(texts * k, np.inf)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = 0
        while len(seed):
            number += 1
            dart = mix(seed + U(number * 0xE7037ED1A0B428DB % (1 << 64)))
            rank = rank - np.log(((dart >> U(11)).astype(float) + 0.5) * 2.0**-53)
            alive = rank < limit[own]
            seed, own, left, rank, dart = seed[alive], own[alive], left[alive], rank[alive], dart[alive]
            if not len(seed):
                break
            spot = mix(dart ^ U(0x8EBC6AF09C88C6E3))
            hit = ((spot >> U(32)).astype(float) * 2.0**-32) < left
            cell = (own * k + (spot & U(0xFFFFFFFF)).astype(np.int64) % k)[hit]
            np.minimum.at(best, cell, rank[hit])
            kept.append((cell, rank[hit], dart[hit]))
        flat = out.reshape(-1)
        for cell, r, dart in kept:
            won = best[cell] == r
            flat[cell[won]] = dart[won]
        full = np.isfinite(best).reshape(texts, k).all(1)
        todo &= ~full
        limit[todo] *= 2
    return out


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows) * seeded(rows, 11)
    return mix(parts.sum(2, dtype=U) + seeded(bands, 13))


#: Darts that one step throws, about: with their places and ranks they take some 60 bytes each.
DARTS = 1 << 20


def _elements(column, size: int, k: int = 1):
    """Elements of runs of texts whose signatures of ``k`` coordinates fit a worker."""
    data, offsets = column_bytes(pc.utf8_lower(column))
    most = max(1, int(DARTS / (k * (math.log(k) + 2))))
    for a, b in chunks(offsets, 1 << 20, most):
        part = offsets[a : b + 1]
        h, o = words(data[part[0] : part[-1]], part - part[0])
        yield a, b, *weighted(*shingles(h, o, b - a, size))


def _sketcher(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list = []
            for a, b, e, o, w in _elements(batch.column("text"), p.shingle, p.bands * p.rows):
                hashed = band_hashes(dart_signatures(e, o, w, b - a, p.bands * p.rows), p.bands, p.rows).view(np.int64)
                some = np.bincount(o, minlength=b - a) > 0
                sizes = np.where(some, p.bands, 0)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(hashed[some].reshape(-1))))
            bands = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), bands], ["doc_id", "digest", "bands"])
        trim()

    return run


def _verifier(p: NearDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict = OrderedDict()  # the last texts' elements; leaders come again and again

        def bag(key: bytes, text: str):
            if key not in seen:
                (_, _, e, _, w), *_ = _elements(pa.array([text]), p.shingle)
                seen[key] = (e, w)
                if len(seen) > 256:
                    seen.popitem(last=False)
            seen.move_to_end(key)
            return seen[key]

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                a, ta, b, tb = (batch.column(c).slice(lo, 64).to_pylist() for c in ("a", "a_text", "b", "b_text"))
                near = []
                for ka, xa, kb, xb in zip(a, ta, b, tb, strict=True):
                    near.append(similar(bag(ka, xa), bag(kb, xb), p.similarity))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(near)], ["a", "b", "near"])
        trim()

    return run


def _wide_sketcher(p: NearDedup):
    """Wide coordinates, and the elements with their counts where they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            bags: list[bytes | None] = []
            for a, b, e, o, w in _elements(batch.column("text"), p.shingle, p.wide):
                out += [bytes(x) for x in (dart_signatures(e, o, w, b - a, p.wide) & U(255)).astype(np.uint8)]
                ends = np.searchsorted(o, np.arange(b - a + 1))
                for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    bags.append(e[lo:hi].tobytes() + w[lo:hi].astype(np.uint32).tobytes() if hi - lo <= p.carried else None)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary()), pa.array(bags, pa.binary())], ["digest", "wide", "bag"])
        trim()

    return run


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, U, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(float)


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float) -> bool:
    """Whether two weighted sets, elements and weights, reach the similarity."""
    (ea, wa), (eb, wb) = a, b
    total = wa.sum() + wb.sum()
    if min(wa.sum(), wb.sum()) < similarity * max(wa.sum(), wb.sum()) - 1e-9:
        return False
    spot = np.searchsorted(eb, ea)
    inside = np.flatnonzero(spot < len(eb))
    inside = inside[eb[spot[inside]] == ea[inside]]
    shared = np.minimum(wa[inside], wb[spot[inside]]).sum()
    return bool(shared >= similarity * (total - shared) - 1e-9)


def _block_pairs(rows: list[dict], p: NearDedup) -> Iterator[tuple[bytes, bytes, bool, bool]]:
    """Pairs across classes of one block, or of two, that may reach the similarity, whether each is sure, and whether it is known to be a link.

    A row's ``refused`` are the smaller digests of its sure pairs that failed.
    """
    margin = 5 * math.sqrt(p.similarity * (1 - p.similarity) / p.wide)
    sure = min(p.similarity + margin / 2, 1.0)
    wide = np.frombuffer(b"".join(r["wide"] for r in rows), np.uint8).reshape(len(rows), p.wide)
    labels, label = np.unique(np.array([r["label"] for r in rows], object), return_inverse=True)
    side = np.array([r["mine"] for r in rows])
    two = rows[0]["lo"] != rows[0]["hi"]
    before = np.array([r["bands"][: r["band"]] for r in rows], np.int64).reshape(len(rows), rows[0]["band"])
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(rows), 32):
        near = (wide[lo : lo + 32, None, :] == wide[None, lo:, :]).sum(2, dtype=np.int32) / p.wide
        i, j = np.nonzero(near >= p.similarity - margin)
        keep = (j > i) & (label[i + lo] != label[j + lo]) & ((side[i + lo] != side[j + lo]) | (not two))
        i, j = i[keep], j[keep]
        # a pair belongs to the first of the buckets that it shares
        first = ~(before[i + lo] == before[j + lo]).any(1)
        i, j = i[first], j[first]
        found.append((near[i, j], i + lo, j + lo))
    near, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    parent = list(range(len(labels)))
    refused = {(a, r["digest"]) for r in rows for a in r["refused"] or ()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bags = [r["bag"] and _bag(r["bag"]) for r in rows]
    for k in np.argsort(-near, kind="stable").tolist():
        a, b = root(label[i[k]]), root(label[j[k]])
        pair = tuple(sorted((rows[i[k]]["digest"], rows[j[k]]["digest"])))
        if a != b and pair not in refused:
            one, other = bags[i[k]], bags[j[k]]
            known = bool(one and other) and similar(one, other, p.similarity)
            if one and other and not known:
                continue
            if known or near[k] >= sure:
                parent[a] = b
            yield *pair, bool(near[k] >= sure), known


def _blocker(p: NearDedup):
    """Blocks arrive one after the other (sorted by bucket and block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done() -> pa.RecordBatch:
            pairs = list(dict.fromkeys(_block_pairs(held, p)))
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in pairs], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.bool_(), pa.bool_()))], ["a", "b", "sure", "known"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and any(held[0][c] != r[c] for c in ("band", "h", "lo", "hi")):
                    yield done()
                    held = []
                held.append(r)
        if held:
            yield done()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    Alternates the large-star and small-star steps; each is a partial minimum
    for every node and a join back, and the edges are cut after each round.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return cut(found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels") if before[0] else spark.createDataFrame([], "node binary, label binary")


def near_classes(docs: DataFrame, params: NearDedup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, class_id, class_digest, class_docs.

    ``class_digest`` names the class; ``digest`` the exact text.
    """
    p = params or NearDedup()
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    sketch = cut(src.mapInArrow(_sketcher(p), "doc_id long, digest binary, bands array<long>"), "sketch")
    texts = cut(sketch.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("docs"), F.first("bands").alias("bands")), "texts")
    members = texts.select("digest", F.posexplode("bands").alias("band", "h"))
    bucket = ["band", "h"]
    counted = cut(members.groupBy(*bucket).agg(F.min("digest").alias("leader"), F.count("*").alias("n")).where("n > 1"), "counted")
    total = sketch.count()
    buckets = cut(join_split(members, counted, bucket, heavy_keys(counted, bucket, "n", total)), "buckets")
    tried = cut(buckets.where("leader <> digest").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    edges = labels = None

    def fetch(digests: DataFrame) -> DataFrame:
        """(digest, text) of some texts, one row for each."""
        needed = cut(digests.distinct().join(texts.select("digest", "first_id"), "digest"), "needed")
        small = maybe_broadcast(needed, needed.count(), 40, p.broadcast_bytes)
        whole = src.join(small.withColumnRenamed("digest", "d"), F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        return whole.groupBy("digest").agg(F.first("text").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        whole = cut(fetch(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest")))), "whole")
        for c in "ab":  # a text with many pairs is copied, so that none of its tasks has them all
            many = pairs.groupBy(c).agg(F.ceil(F.count("*") / p.fan).alias("parts")).where("parts > 1")
            many = F.broadcast(cut(many, "many"))  # of every ``fan`` pairs one row at most
            part = F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))
            side = whole.select(F.col("digest").alias(c), F.col("text").alias(f"{c}_text")).join(many, c, "left")
            side = side.select(c, f"{c}_text", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
            pairs = pairs.join(many, c, "left").withColumn("part", part).drop("parts").join(side, [c, "part"]).drop("part")
        return cut(pairs.select("a", "a_text", "b", "b_text").mapInArrow(_verifier(p), "a binary, b binary, near boolean").where("near").select("a", "b"), "edges")

    def across(state: DataFrame, wide: DataFrame, refused: DataFrame | None) -> DataFrame:
        """Pairs of the larger buckets, found block by block."""
        if refused is None:
            wide = wide.withColumn("refused", F.lit(None).cast("array<binary>"))
        else:
            failed = refused.groupBy(F.col("b").alias("digest")).agg(F.collect_set("a").alias("refused"))
            wide = wide.join(maybe_broadcast(failed, refused.count(), 48, p.broadcast_bytes), "digest", "left")
        # a class of more than a block has blocks of its own behind those that the others share
        sizes = cut(state.groupBy(*bucket, "label").agg(F.count("*").alias("z")), "sizes")
        own = F.when(F.col("z") > p.block, F.ceil(F.col("z") / p.block)).otherwise(0)
        pools = cut(sizes.groupBy(*bucket).agg(F.sum("z").alias("n"), F.ceil(F.sum(F.when(F.col("z") <= p.block, F.col("z")).otherwise(0)) / p.block).alias("shared"), F.sum(own).alias("own")), "pools")
        before = Window.partitionBy(*bucket).orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
        majors = sizes.where(F.col("z") > p.block).withColumn("blocks", own).withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).drop("z")
        majors = F.broadcast(cut(majors, "majors"))  # of every ``block`` rows one at most
        rows = join_split(state.select(*bucket, "digest", "label"), pools, bucket, heavy_keys(pools, bucket, "n", total)).join(majors, [*bucket, "label"], "left")
        spot, low = F.xxhash64("digest"), F.col("shared") + F.col("first")
        alone = F.col("blocks").isNull()
        rows = rows.withColumn("mine", F.when(alone, F.pmod(spot, F.greatest("shared", F.lit(1)))).otherwise(low + F.pmod(spot, F.coalesce("blocks", F.lit(1)))))
        every = F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("own") - 1)
        others = F.when(alone, every).otherwise(F.filter(every, lambda x: ~x.between(low, low + F.col("blocks") - 1)))
        units = rows.select(*bucket, "digest", "label", "mine", F.explode(others).alias("other"))
        units = units.select(*bucket, "digest", "label", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        unit = ["band", "h", "lo", "hi"]
        return units.join(wide, "digest").repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_blocker(p), "a binary, b binary, sure boolean, known boolean")

    fresh, links, wide, refused = tried, None, None, None
    while links is not None or not fresh.isEmpty():
        found = verify(fresh)
        found = found if links is None else cut(found.unionByName(links), "edges")
        links = None
        edges = found if edges is None else cut(edges.unionByName(found), "edges")
        labels = components(edges)
        # texts of buckets that still hold several classes; the rest needs no more links
        state = buckets.where("n > 2").join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("band", "h", "n", "digest", F.coalesce("label", "digest").alias("label"))
        several = state.groupBy("band", "h").agg(F.min("label").alias("one"), F.max("label").alias("another"), F.max("n").alias("n")).where("one <> another").select("band", "h", "n")
        several = cut(several, "several")
        state = cut(join_split(state.drop("n"), several, bucket, heavy_keys(several, bucket, "n", total)), "open")
        small, large = state.where(F.col("n") <= p.small_bucket), state.where(F.col("n") > p.small_bucket)
        other = small.select("band", "h", F.col("digest").alias("b"), F.col("label").alias("b_label"))
        pairs = small.withColumnRenamed("digest", "a").join(other, ["band", "h"]).where("a < b and label <> b_label").select("a", "b")
        if not large.isEmpty():
            if wide is None:  # later steps need some of these texts
                wide = fetch(large.select("digest")).mapInArrow(_wide_sketcher(p), "digest binary, wide binary, bag binary")
                wide = cut(wide.join(texts.select("digest", "bands"), "digest"), "wide")
            while True:
                met = cut(across(large, wide, refused), "met")
                # a tried pair that is still across classes was refused: it must not hold others back
                failed = cut(met.where("sure and not known").select("a", "b").distinct().join(tried, ["a", "b"], "left_semi"), "refused")
                if failed.isEmpty():
                    break
                refused = failed if refused is None else cut(refused.unionByName(failed), "refused")
            pairs = pairs.unionByName(met.where("not known").select("a", "b"))
            links = cut(met.where("known").select("a", "b").distinct(), "links")
            links = None if links.isEmpty() else links
        fresh = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = cut(tried.unionByName(fresh), "pairs")
    if edges is None:
        classes = texts.select("digest", "first_id", "docs", F.col("digest").alias("class_digest"))
    else:
        classes = texts.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "first_id", "docs", F.coalesce("label", "digest").alias("class_digest"))
    classes = cut(classes, "classes")
    sums = classes.groupBy("class_digest").agg(F.min("first_id").alias("class_id"), F.sum("docs").alias("class_docs"))
    named = cut(classes.select("digest", "class_digest", "docs").join(sums, "class_digest"), "named")
    return join_split(sketch.select("doc_id", "digest"), named, ["digest"], heavy_keys(named, ["digest"], "docs", total)).select("doc_id", "digest", "class_id", "class_digest", "class_docs")


def keep_one(docs: DataFrame, params: NearDedup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row left of each near-duplicate class, all columns kept.

    The row with the class's smallest id stays (of several, that with the
    smallest digest; of equal rows, any one; in a class without ids, one row).
    """
    classes = near_classes(docs, params, id_col, text_col)
    pick = classes.groupBy("class_digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    counts = classes.groupBy("doc_id", "digest").agg(F.count("*").alias("__fl_rows"))
    pick = pick.select(F.col("k.doc_id").alias("doc_id"), F.col("k.digest").alias("digest"))
    pick = pick.withColumnRenamed("doc_id", "__fl_id").join(counts.withColumnRenamed("digest", "__fl_digest"), F.col("__fl_id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("__fl_digest")))
    pick = cut(pick.select("__fl_id", "__fl_digest", "__fl_rows"), "keep")
    tagged = docs.withColumn("__fl_d", digest(text_or_empty(text_col)))
    kept = tagged.join(pick, (F.col("__fl_d") == F.col("__fl_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("__fl_id")))
    once = kept.where("__fl_rows = 1").select(*docs.columns)
    again = kept.where("__fl_rows > 1")
    if pick.where("__fl_rows > 1").isEmpty():
        return once
    # maps have no order and no hash; their text has
    told = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    one = again.groupBy("__fl_digest", "__fl_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*told)).alias("r")).select("r.*")
    return once.unionByName(one)
