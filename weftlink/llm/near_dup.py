"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. One pass over the texts gives each document's set of word shingles, its size, a
   digest of the set and a MinHash signature. Equal digests are one class; the rest
   works on one representative per class.
2. Forest: each tree orders the classes by the signature rotated to another start.
   Neighbours in an order share the longest prefix that any class shares with them. Of each
   class, the next ``reach`` ones are candidates whose common prefix with it is at least
   as long as the threshold requires, and whose sizes and estimated similarity allow a link.
   They are confirmed on full sets: first each class's most similar one, which joins most of
   a group; then, on what remains, every pair between different components.
3. Adaptive depth: so far a class was compared at the depth of its longest prefixes. Where
   that leaves classes of more than one component in a region, which is a run of classes that
   share the least prefix, the region is searched at this least depth and in full, so neither a
   class behind many closer neighbours nor a border of a batch or partition hides a link:
   regions of few classes by all their pairs, the classes of all others by one exact
   prefix-filter join. Shingles are ordered by rarity; the smaller set of a linked pair has one
   of the first 1 - 2t / (1 + t) of its shingles among the first 1 - t of the other's. A pair has
   to fit by sizes, by the places of the shingle in both, and by parity maps of 512 bits,
   which differ in at most as many bits as the sets do in shingles. Shingles that meet only one component are dropped by a count before pairs are made, and members of
   a shingle's largest component are not paired with one another, so large linked groups cost
   each member the same.
4. Pairs found there are confirmed as in 2. No pair between components is left out, so
   there is nothing for another round to find.

A linked pair shares no region with a probability of (1 - t**depth)**TREES, at most
``MISS``; the estimate turns one down with about 3e-6. The forest's work is linear in documents times
trees; that of the join is in the pairs of different components that share a rare shingle.
Classes of very many copies, and nodes of very many links, are met by a broadcast (``join_hot``).

Defined results: null or empty texts and texts without words have size 0 and link with
nothing; repeated rows link; rows that share a doc_id are one node; a null doc_id gets a
null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import BLOCK, cut, discard, is_space, join_hot, mix, release, run_hashes, runs, slices, stored, table, text_bytes
from weftlink.llm.components import components

_U = np.uint64
TREES, DEPTH = 10, 6
#: Bound on the probability that a pair at the threshold shares no region.
MISS = 5e-5
#: Classes of shingles whose counts give the order of the exact join.
RARITY = 1 << 18
#: Longs of a document's parity map in the exact join.
MAPS = 8
#: So many ids may be broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Standard deviations by which an estimate may fall short of the threshold.
MARGIN = 4.5


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts on end, and the offset of each text's."""
    raw, at = text_bytes(column, True)
    starts, ends, doc = runs(raw, at, is_space(raw))
    h = run_hashes(raw, starts, ends)
    n = len(at) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        if len(h) >= words:
            width = len(h) - words + 1
            grams = np.zeros(width, _U)
            for k in range(words):
                grams = mix(grams + h[k : k + width])
            whole = doc[:width] == doc[words - 1 :]
            grams, owner = grams[whole], doc[:width][whole]
        else:
            grams, owner = np.zeros(0, _U), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < words))
        own = np.zeros(len(short), _U)
        for i, d in enumerate(short):
            for x in h[first[d] : first[d + 1]]:
                own[i : i + 1] = mix(own[i : i + 1] + x)
            own[i : i + 1] = mix(own[i : i + 1] + _U(count[d]))
    grams, owner = np.concatenate([grams, own]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(n + 1))


def _seeds(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def signatures(grams: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k 16-bit MinHash values (big endian bytes) of each non-empty set, zero rows for empty ones."""
    out = np.zeros((len(at) - 1, k), ">u2")
    filled = np.flatnonzero(at[1:] > at[:-1])
    if len(filled):
        with np.errstate(over="ignore"):
            for j, seed in enumerate(_seeds(k)):
                v = (grams ^ (grams >> _U(29))) * seed
                least = np.minimum.reduceat(v ^ (v >> _U(32)), at[:-1][filled])
                out[filled, j] = mix(least) >> _U(48)
    return out


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, digest, sig) of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), words)
                sig = signatures(grams, at, TREES * DEPTH)
                digest = [hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(at)), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "n", "digest", "sig"])

    return src.mapInArrow(sign, "id bigint, n bigint, digest binary, sig binary")


def _rotations(classes: DataFrame) -> DataFrame:
    """(tree, label, rep, n, comp): each class once per tree, its signature rotated to the tree's start."""
    step = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    turned = F.concat(F.expr(f"substring(sig, tree * {step} + 1)"), F.expr(f"substring(sig, 1, tree * {step})"))
    return classes.select("rep", "n", "comp", "sig", tree.alias("tree")).select("tree", turned.alias("label"), "rep", "n", "comp")


def _common_prefixes(tree: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Leading values that each class shares with the one before it in its tree's order."""
    out = np.zeros(len(tree), np.int64)
    differ = sig[1:] != sig[:-1]
    out[1:] = np.where(differ.any(1), differ.argmax(1), sig.shape[1]) * (tree[1:] == tree[:-1])
    return out


def _least_estimate(num: int, den: int) -> float:
    ratio = num / den
    return ratio - MARGIN * np.sqrt(ratio * (1 - ratio) / (TREES * DEPTH))


def _depth(num: int, den: int) -> int:
    """The most values of a tree that a linked pair shares in some tree but for a probability of ``MISS``."""
    fits = [d for d in range(1, DEPTH + 1) if (1 - (num / den) ** d) ** TREES <= MISS]
    return max(fits, default=1)


def _neighbours(classes: DataFrame, partitions: int, reach: int, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b, est): each class with those of its longest common prefixes in each order."""
    least, shallow = _least_estimate(num, den), _depth(num, den)
    ordered = _rotations(classes).repartitionByRange(partitions, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def pairs(tree, sig, rep, n, i, j):
        ok = (rep[i] != rep[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        est = np.concatenate([np.zeros(0), *((sig[i[k : k + 4096]] == sig[j[k : k + 4096]]).mean(1) for k in range(0, len(i), 4096))])
        ok = est >= least
        return np.minimum(rep[i], rep[j])[ok], np.maximum(rep[i], rep[j])[ok], est[ok]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "rep", "n")]
            sig = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(len(batch), -1)
            held = 0
            if tail is not None:
                held = len(tail[0])
                cols = [np.concatenate([a, b]) for a, b in zip(tail[:3], cols, strict=True)]
                sig = np.concatenate([tail[3], sig])
            tree, rep, n = cols
            size = len(tree)
            shared = _common_prefixes(tree, sig)
            # A step further is the least of the prefixes passed: the classes nearest in the order share the longest ones.
            found, prefix, own = [], np.full(size, sig.shape[1]), np.arange(size)
            for k in range(1, reach + 1):
                prefix[k:] = np.minimum(prefix[k:], shared[1 : size - k + 1])
                here = own[max(held, k) :]
                here = here[prefix[here] >= shallow]
                found.append(pairs(tree, sig, rep, n, here, here - k))
            a, b, est = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((b, a))
            order = order[np.concatenate([np.ones(min(1, len(a)), bool), (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])]
            yield pa.RecordBatch.from_arrays([pa.array(a[order], pa.int64()), pa.array(b[order], pa.int64()), pa.array(est[order], pa.float64())], names=["a", "b", "est"])
            keep = slice(max(0, size - reach), size)
            tail = [*(c[keep] for c in (tree, rep, n)), sig[keep]]

    return ordered.mapInArrow(scan, "a bigint, b bigint, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def _rarity(texts: DataFrame, words: int) -> np.ndarray:
    """How often each class of shingles occurs in the texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(RARITY, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                seen += np.bincount((shingle_sets(part.column("text"), words)[0] % _U(RARITY)).astype(np.int64), minlength=RARITY)
        some = np.flatnonzero(seen)
        for k in range(0, len(some), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + (1 << 16)]), pa.array(seen[some[k : k + (1 << 16)]])], names=["bucket", "k"])

    out = np.zeros(RARITY, np.int64)
    found = texts.mapInArrow(tally, "bucket bigint, k bigint").groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()
    out[found["bucket"].to_numpy(np.int64)] = found["k"].to_numpy(np.int64)
    return out


def _parity_maps(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """``MAPS`` longs for each of n sets: the parity of how many shingles fall to each of their bits."""
    bits = 64 * MAPS
    place, times = np.unique(owner * bits + (mix(grams) & _U(bits - 1)).astype(np.int64), return_counts=True)
    place = place[times % 2 == 1]
    out = np.zeros(n * MAPS, _U)
    np.bitwise_or.at(out, place >> 6, _U(1) << (place & 63).astype(_U))
    return out.reshape(n, MAPS).view(np.int64)


def _rare_pairs(texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of texts (id, comp, text) of different components that share a shingle where a linked pair must."""
    spark = texts.sparkSession
    counts = spark.sparkContext.broadcast(_rarity(texts.select("text"), words))
    maps = [f"m{k}" for k in range(MAPS)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = shingle_sets(part.column("text"), words)
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((grams, counts.value[(grams % _U(RARITY)).astype(np.int64)], owner))
                place = np.arange(len(grams)) - at[:-1][owner]
                parity = _parity_maps(grams, owner, len(n))
                most, few = n + (-num * n // den) + 1, n + (-2 * num * n // (num + den)) + 1
                keep = place < most[owner]
                owner, place, short = owner[keep], place[keep], (place < few[owner])[keep]
                ids, comps = (part.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("id", "comp"))
                columns = [grams[order][keep].view(np.int64), ids, comps, n[owner], place, short, *parity[owner].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["token", "id", "comp", "n", "place", "short", *maps])

    schema = "token bigint, id bigint, comp bigint, n bigint, place bigint, short boolean, " + ", ".join(f"{m} bigint" for m in maps)
    posted = stored(texts.mapInArrow(post, schema), "postings")
    met = posted.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("short").alias("short"))
    met = met.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("most"), F.max("short").alias("some"))
    met = met.where("comps > 1 and some").select("token", F.col("most.comp").alias("most"))
    rows = stored(posted.join(met, "token").select("token", "id", "comp", "n", "place", "short", *maps, (F.col("comp") == F.col("most")).alias("top")), "met")
    low = rows.where("short").select("token", "top", *(F.col(c).alias(f"x_{c}") for c in ("id", "comp", "n", "place", *maps)))
    total = F.col("x_n") + F.col("n")
    # The pair's own bounds: its first shared shingle comes early enough in both, and its sets differ in few enough.
    least = F.ceil(total * num / (num + den))
    apart = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(m))) for m in maps), F.lit(0))
    fits = (F.col("x_comp") != F.col("comp")) & (F.col("x_n") <= F.col("n")) & (den * F.col("x_n") >= num * F.col("n"))
    fits = fits & (F.col("x_place") <= F.col("x_n") - least) & (F.col("place") <= F.col("n") - least) & (apart <= total - 2 * least)
    sides = ((low.where("not top"), rows), (low.where("top"), rows.where("not top")))
    both = [x.drop("top").join(y.drop("short", "top"), "token").where(fits).select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")) for x, y in sides]
    out = cut(both[0].union(both[1]).distinct())
    discard(posted, rows)
    return out


def _region_pairs(classes: DataFrame, texts: DataFrame, words: int, reach: int, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b, est) of different components in regions that hold more than one. classes: with comp."""
    first = _rotations(classes).select("tree", F.expr(f"substring(label, 1, {2 * _depth(num, den)})").alias("start"), "rep", "n", "comp")
    mixed = first.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    mixed = cut(mixed.where("low < high").select("tree", "start", "k"))
    few = mixed.count() <= BROADCAST_IDS
    placed = stored(first.join(F.broadcast(mixed) if few else mixed, ["tree", "start"]), "regions")
    small = placed.where(F.col("k") <= reach + 1)
    other = small.select("tree", "start", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    near = (F.col("rep") < F.col("b")) & (F.col("comp") != F.col("cb")) & (den * F.least("n", "nb") >= num * F.greatest("n", "nb"))
    found = small.join(other, ["tree", "start"]).where(near).select(F.col("rep").alias("a"), "b")
    dense = cut(placed.where(F.col("k") > reach + 1).select(F.col("rep").alias("id"), "comp").distinct())
    size = dense.count()
    if size:
        asked = stored(texts.join(F.broadcast(dense) if size <= BROADCAST_IDS else dense, "id"), "dense")
        found = found.union(_rare_pairs(asked, words, num, den))
        discard(asked)
    found = cut(found.distinct())
    discard(placed)
    least = _least_estimate(num, den)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(len(batch), -1) for c in ("x", "y"))
            est = (x == y).mean(1) if len(batch) else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est)], names=["a", "b", "est"])
            yield out.filter(pa.array(est >= least))

    sigs = [classes.select(F.col("rep").alias(c), F.col("sig").alias(s)) for c, s in (("a", "x"), ("b", "y"))]
    both = found.join(sigs[0], "a").join(sigs[1], "b").select("a", "b", "x", "y")
    return both.mapInArrow(judge, "a bigint, b bigint, est double").groupBy("a", "b").agg(F.max("est").alias("est"))


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. docs: (id, text); pairs are already computed."""
    asked = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    few = asked.count() <= BROADCAST_IDS
    needed = docs.join(F.broadcast(asked) if few else asked, "id", "left_semi")
    both = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "x", 2 * BLOCK):
                (gx, ax), (gy, ay) = (shingle_sets(part.column(c), words) for c in ("x", "y"))
                ok = np.zeros(len(part), bool)
                for i in range(len(part)):
                    merged = np.sort(np.concatenate([gx[ax[i] : ax[i + 1]], gy[ay[i] : ay[i + 1]]]))
                    common = int((merged[1:] == merged[:-1]).sum())
                    ok[i] = den * common >= num * (len(merged) - common)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint").distinct()


def _joined_up(pairs: DataFrame, comp: DataFrame | None, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The components after confirming pairs (a, b, est): each class's best one, then those still between components."""
    edges = lambda: comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
    best = pairs.select(F.col("b").alias("node"), "a", "b", "est").union(pairs.select(F.col("a").alias("node"), "a", "b", "est"))
    best = cut(best.groupBy("node").agg(F.max(F.struct("est", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
    more = _confirm(best, texts, words, num, den)
    # What is joined already counts as one edge for each class.
    comp = components(cut(more if comp is None else edges().union(more)))
    release(texts.sparkSession)
    name = comp.withColumnRenamed("component", "c")
    open_pairs = cut(
        pairs.select("a", "b")
        .join(name.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left")
        .join(name.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        .select("a", "b")
        .join(best, ["a", "b"], "left_anti")
    )
    if open_pairs.isEmpty():
        return comp
    more = cut(_confirm(open_pairs, texts, words, num, den))
    if more.isEmpty():
        return comp
    comp = components(edges().union(more))
    release(texts.sparkSession)
    return comp


def link_documents(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", reach: int = 3) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; linked when den * intersection >= num * union."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    members = stored(signed(docs, id_col, text_col, words), "signatures")
    full = members.where("n > 0 and id is not null")
    classes = stored(full.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    rows = members.count()
    pairs = cut(_neighbours(classes.withColumn("comp", F.col("rep")), partitions, reach, num, den))
    comp = _joined_up(pairs, None, texts, words, num, den)
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("rep", "n", "sig", F.coalesce("component", "rep").alias("comp"))
    # Neighbours are confirmed or in one component by now.
    rest = cut(_region_pairs(named, texts, words, reach, num, den).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        comp = _joined_up(rest, comp, texts, words, num, den)
    # Rows of one doc_id with different sets are one node: an edge from each set's representative to the id.
    split = full.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    shared = join_hot(full.select("id", "digest").join(split, "id", "left_semi"), classes.select("digest", "rep", "copies"), "digest", "copies", rows).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    if not shared.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(shared))
    named = classes.join(comp, classes["rep"] == comp["node"], "left").select("digest", F.coalesce("component", "rep").alias("component"), "copies")
    empty = members.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("component"))
    placed = join_hot(members.where("n > 0").select("id", "n", "digest"), named, "digest", "copies", rows, "left").select("id", "n", "component").union(empty)
    return placed.select(
        F.col("id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal documents: 3-word shingles, similarity of 0.85 or more."""
    return link_documents(table(spark, sf_dir, "documents"), words=3, num=85, den=100).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, s, len(s) as n from (
    select doc_id, case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2]))
                        when len(w) > 0 then [array_to_string(w, chr(31))] else [] end as s from words)
), tok as (select doc_id, n, unnest(s) as t from sets), df as (select t, count(*) as f from tok group by t
), pre as (
  select doc_id, n, t from (select tok.*, row_number() over (partition by doc_id order by f, t) as pos from tok join df using (t)) where pos <= n - ceil(n * 85 / 100) + 1
), cand as (
  select distinct x.doc_id as a, y.doc_id as b from pre x join pre y on x.t = y.t and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
), links as (
  select a, b from cand join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * len(list_intersect(x.s, y.s)) >= 85 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways as (select a, b from links union all select b, a from links
), reach(a, b) as (
  select doc_id, doc_id from sets union select r.a, l.b from reach r join both_ways l on l.a = r.b
)
select s.doc_id, s.n as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept from sets s join reach r on r.a = s.doc_id group by s.doc_id, s.n
"""
