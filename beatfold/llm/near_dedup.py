"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A document is the multiset of its runs of five words (of all its words, if it has fewer). Signature: every shingle has a Poisson
process over weight and time; the weight axis is cut at powers of two into intervals with processes of their own, a point inside
an interval that the shingle's count reaches into only partly is kept or dropped by its place there, and each of M registers holds
the earliest point that falls to it. Two registers agree with a probability of the weighted Jaccard similarity, without bias.
Time is bounded for each document so that nearly all registers fill, and extended for those that did not.

Equal word sequences are one node. Bands of registers give buckets; in a bucket everyone is compared with its most central member
(the one whose buckets hold most). What is then joined needs no more comparing; where a bucket still holds several components, those
outside its largest one are compared with all its members in blocks (of bounded number and words): by signatures, and pairs that may be similar exactly. Those pairs
are lists within a block pair, not rows, and are looked at in the first band alone in which they meet. Verification is exact:
sizes of the intersection and the union of the multisets (48-bit hashes of a shingle and its occurrence number). Classes are the
connected components of verified links. A pair at the threshold is missed by all bands with a probability of 3e-6.

Rows are told apart by id and text: rows that share an id, or have none, are documents of their own where their texts differ. The
first row of each class by id, then digest of the text, is kept; rows equal in both are kept together. `class_id` is the id of the
first row, so classes whose first rows share an id (or have none) show the same one; `class_key`, that id and the digest of that
row's text, names each class alone.

Nulls: null and empty texts (no words) are in no group: each document its own class. A null id comes before all others and is given
back as null. Very long texts are used whole. Empty tables give empty results; extra columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatfold.llm import common, substring_dedup
from beatfold.llm.components import components
from beatfold.llm.substring_dedup import mixed, rolling, words_of

SHINGLE, REGISTERS, BAND = 5, 96, 4
SIMILAR = (4, 5)  # at least 4/5
MAYBE = 0.6  # of the registers, for pairs that are verified
BLOCK, BLOCK_WORDS, BROADCAST_KEYS = 512, 4_000_000, 250_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def shingles(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of all shingles, ordered by document and hash."""
    n, known = np.array([len(d) for d in docs]), substring_dedup.word_hashes()
    h = np.fromiter((x for d in docs for x in map(known.__getitem__, d)), np.uint64, int(n.sum()))
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(docs)), n)
    if len(h) >= SHINGLE:
        runs = rolling(h, SHINGLE, C1)
        inside = np.arange(len(runs)) + SHINGLE <= np.repeat(begin + n, n)[: len(runs)]
        runs, owner = mixed(runs[inside]), owner[: len(inside)][inside]
    else:
        runs, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.nonzero((n > 0) & (n < SHINGLE))[0]
    if len(short):
        whole = np.array([mixed(rolling(h[begin[i] : begin[i] + n[i]], int(n[i]), C2))[0] for i in short], np.uint64)
        runs, owner = np.concatenate([runs, whole]), np.concatenate([owner, short])
    order = np.lexsort((runs, owner))
    return owner[order], runs[order]


def occurrences(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct shingle of a document begins, and the number (from 0) of each occurrence."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.nonzero(new)[0]
    return begin, np.arange(len(h)) - begin[np.cumsum(new) - 1]


def signatures(owner: np.ndarray, h: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """(n_docs, m) BagMinHash signatures as unsigned 32-bit numbers; rows of documents without shingles are 0."""
    begin, _ = occurrences(owner, h)
    weight = np.diff(np.append(begin, len(h)))
    doc, item = owner[begin], h[begin]
    total = np.bincount(doc, weight, minlength=n_docs)
    level = np.ceil(np.log2(weight)).astype(np.int64)  # intervals [0,1), [1,2), [2,4), ...: the last one that the weight reaches
    pick = np.repeat(np.arange(len(item)), level + 1)
    lev = np.arange(len(pick)) - np.repeat(np.cumsum(level + 1) - level - 1, level + 1)
    low = np.where(lev > 0, 1 << np.maximum(lev - 1, 0), 0)
    node = {"doc": doc[pick], "seed": mixed(item[pick] + lev.astype(np.uint64) * C2), "low": low, "wide": np.maximum(low, 1), "top": weight[pick]}
    out, todo, reach = np.zeros((n_docs, m), np.uint32), total > 0, np.log(m) + 6
    while todo.any():
        at = todo[node["doc"]]
        best = _race({k: v[at] for k, v in node.items()}, np.where(total > 0, reach / np.maximum(total, 1), 0), n_docs, m)
        full = todo & (best != np.iinfo(np.uint64).max).all(1)
        out[full] = best[full].astype(np.uint32)
        todo, reach = todo & ~full, 2 * reach
    return out


def _race(node: dict, until: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Earliest points of each register up to a time: that time in the high half, the point's name in the low half."""
    best = np.full(n_docs * m, np.iinfo(np.uint64).max)
    doc, seed, low, wide, top = (node[k] for k in ("doc", "seed", "low", "wide", "top"))
    t, end, k = np.zeros(len(doc)), until[doc], 0
    while len(doc):
        k += 1
        r = mixed(seed + np.uint64(k * int(C3) % 2**64))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (m * wide)
        on = t <= end
        doc, seed, low, wide, top, t, end, r = (x[on] for x in (doc, seed, low, wide, top, t, end, r))
        s = mixed(r ^ C1)
        y = low + (((s >> np.uint64(40)).astype(np.float64) * 2.0**-24) * wide).astype(np.int64)
        hit = y < top
        slot = doc * m + ((s >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        key = ((t / end * 2.0**31).astype(np.uint64) << np.uint64(32)) | (mixed(s ^ C2) & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, slot[hit], key[hit])
    return best.reshape(n_docs, m)


def elements(owner: np.ndarray, h: np.ndarray, n_docs: int) -> list[bytes]:
    """Each document's multiset as sorted 48-bit numbers: all low 32 bits, then all high 16 bits."""
    _, number = occurrences(owner, h)
    e = mixed(h + number.astype(np.uint64) * C1) >> np.uint64(16)
    order = np.lexsort((e, owner))
    e, cuts = e[order], np.searchsorted(owner[order], np.arange(n_docs + 1))
    return [e[a:b].astype("<u4").tobytes() + (e[a:b] >> np.uint64(32)).astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both, len(a) + len(b) - both


def _signed(batches):
    for b in common.slices(batches, "text", 3 << 20):
        words = [words_of(t) for t in b.column(0).to_pylist()]
        name = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
        first: dict = {}
        mine = [first.setdefault(x, i) if x else i for i, x in enumerate(name)]  # copies within a slice are signed once
        owner, h = shingles([w if mine[i] == i else [] for i, w in enumerate(words)])
        sig = signatures(owner, h, len(words))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(name, pa.binary()), pa.array([sig[j].tobytes() if x else None for j, x in zip(mine, name, strict=True)], pa.binary()), pa.array([*map(len, words)], pa.int64())], ["id", "key", "name", "sig", "words"])


def _banded(batches):
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, REGISTERS // BAND, BAND).astype(np.uint64)
        h = np.arange(sig.shape[1], dtype=np.uint64)[None] * C2 + np.zeros((len(sig), 1), np.uint64)
        for k in range(BAND):
            h = mixed(h ^ sig[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sig.shape[1])), pa.array(np.tile(np.arange(sig.shape[1], dtype=np.int32), len(sig)))], ["bucket", "node", "band"])


def _blobs(batches):
    for b in common.slices(batches, "text", 3 << 20):
        words = [words_of(t) for t in b.column(0).to_pylist()]
        owner, h = shingles(words)
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(elements(owner, h, len(words)), pa.binary())], ["node", "bag"])


def _verified(batches):
    for b in common.slices(batches, "bag_a"):
        hit = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            both, either = overlap(unpacked(x), unpacked(y))
            hit.append(both * SIMILAR[1] >= either * SIMILAR[0])
        yield b.filter(pa.array(hit)).select(["a", "b"])


def _block_pairs(batches):
    """The rows of each (bucket, i, j); rows come ordered by these."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        k = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = np.nonzero((k[:, 1:] != k[:, :-1]).any(0))[0] + 1
        for a, z in zip([0, *cuts[:-1]], cuts, strict=False):
            yield t.slice(a, z - a)
        rest = t.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _screened(batches):
    """Nodes of pairs that lie in different components, whose signatures agree well enough, and that meet in no earlier band.

    partners: on one side of a pair, its other side, best agreement first.
    """
    for rows in _block_pairs(batches):
        node, comp, side = (rows.column(c).to_numpy() for c in ("node", "comp", "side"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(node), -1)
        band, right, partners = rows.column("band")[0].as_py(), np.nonzero(side != 0)[0], {}
        for i in np.nonzero(side != 1)[0]:  # side 2: a block with itself
            j = right[(comp[right] != comp[i]) & ((side[i] == 0) | (node[right] > node[i]))]
            if len(j):
                same = sig[j] == sig[i]
                agree = same.sum(1)
                ok = (agree >= MAYBE * REGISTERS) & (same.reshape(len(j), -1, BAND).all(2).argmax(1) == band)
                if ok.any():
                    partners[i] = node[j[ok][np.argsort(-agree[ok], kind="stable")]].tolist()
        if partners:
            met = {x for p in partners.values() for x in p}
            keep = np.array([i for i in range(len(node)) if i in partners or (side[i] != 0 and node[i] in met)])
            rows = rows.select(["bucket", "i", "j", "node", "comp"]).take(pa.array(keep)).combine_chunks()
            lists = pa.array([partners.get(i, []) for i in keep], pa.list_(pa.int64()))
            yield from rows.append_column("partners", lists).to_batches()


def _linked(batches):
    """Verified links of the pairs of _screened; one link between a node and a component is enough."""
    for rows in _block_pairs(batches):
        node, comp = rows.column("node").to_pylist(), rows.column("comp").to_pylist()
        bag = [unpacked(x) for x in rows.column("bag").to_pylist()]
        at, found = {n: i for i, n in enumerate(node)}, []
        for i, partners in enumerate(rows.column("partners").to_pylist()):
            joined = set()
            for other in partners:
                k = at[other]
                few, many = sorted((len(bag[i]), len(bag[k])))
                if comp[k] not in joined and few * SIMILAR[1] >= many * SIMILAR[0]:
                    both, either = overlap(bag[i], bag[k])
                    if both * SIMILAR[1] >= either * SIMILAR[0]:
                        joined.add(comp[k])
                        found.append((node[i], other))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    a = bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_verified, "a long, b long")


def key_of(text: str) -> Column:
    """128 bits that tell the texts of one id apart; no bytes for a null text."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def numbered(names: DataFrame) -> DataFrame:
    """names (one row for each) with a number of its own, `node`: a hash, and the rank among the few names with that hash."""
    h = names.withColumn("h", F.pmod(F.xxhash64("name"), F.lit(1 << 39)))
    return h.withColumn("node", F.col("h") * F.lit(1 << 24) + F.row_number().over(Window.partitionBy("h").orderBy("name"))).drop("h")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id, is_kept, class_key) of every row; key: see key_of."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.pick(docs, text_col, id_col).select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), key_of(text_col).alias("key"))
    signed = common.written(docs.mapInArrow(_signed, "id long, key binary, name binary, sig binary, words long"), "signatures")
    least = signed.filter("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("id", "key", "sig", "words")).alias("s"))
    nodes = common.written(numbered(least.select("name", "s.id", "s.key", "s.sig", "s.words")), "nodes")

    rows = nodes.select("node", "sig").mapInArrow(_banded, "bucket long, node long, band int")
    # what is joined to rows by bucket is written first, so that a large bucket's rows may be split over tasks
    sizes = common.written(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    rows = common.written(rows.join(sizes, "bucket"), "buckets")
    central = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    ranked = rows.join(central, "node")
    hubs = ranked.groupBy("bucket").agg((-F.max(F.struct("weight", (-F.col("node")).alias("n")))["n"]).alias("hub"))
    hubs = common.written(hubs, "hubs")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = common.written(rows.join(hubs, "bucket").filter("node <> hub").select(*pair("node", "hub")).distinct(), "pairs")

    asked = common.written(nodes.join(central.select("node"), "node").select("node", F.col("id").alias("of"), F.col("key").alias("of_key")), "asked")
    few = asked.count() <= BROADCAST_KEYS
    found = docs.join(F.broadcast(asked) if few else asked, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).select("text", "node")
    bags = common.written(found.mapInArrow(_blobs, "node long, bag binary").groupBy("node").agg(F.min("bag").alias("bag")), "bags")
    links = common.written(verified(pairs, bags), "links")

    comps = components(links)
    held = rows.join(comps, "node", "left").join(nodes.select("node", "words"), "node").select("bucket", "node", "band", "size", "words", F.coalesce("comp", "node").alias("comp"))
    parts = held.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp", "words")).alias("main"), F.count("*").alias("comps"), F.sum("words").alias("all_words")).filter("comps > 1")
    parts = common.written(parts.select("bucket", "main", "all_words"), "parts")
    held = held.filter("size > 2").join(parts, "bucket").join(nodes.select("node", "sig"), "node")
    # members outside a bucket's largest component meet everyone; those inside meet the outsiders alone
    inside = F.col("comp") == F.col("main.comp")
    blocks = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_WORDS)).cast("int")
    outer = blocks(F.col("size") - F.col("main.n"), F.col("all_words") - F.col("main.words"))
    inner = blocks(F.col("main.n"), F.col("main.words"))
    h = F.xxhash64("node")
    held = held.withColumn("own", F.when(inside, outer + F.pmod(h, inner)).otherwise(F.pmod(h, outer)).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, outer).otherwise(outer + inner) - 1)))
    held = held.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node", "comp", "band", "sig")
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    asked = dealt(held).mapInArrow(_screened, "bucket long, i int, j int, node long, comp long, partners array<long>")
    more = common.written(dealt(asked.join(bags, "node")).mapInArrow(_linked, "a long, b long").distinct(), "more-links")
    if not more.isEmpty():
        links = common.written(links.union(more), "links")
        comps = components(links)

    first = F.struct("id", "key").alias("first")
    joined = nodes.select("node", first).join(comps, "node")
    heads = common.written(joined.groupBy("comp").agg(F.min("first").alias("head")), "class-heads")
    heads = common.written(joined.join(heads, "comp").select("node", "head"), "heads")
    own = nodes.select("node", "name", first).join(heads, "node", "left").select("name", F.coalesce("head", "first").alias("head"))
    none = F.lit(None).cast(own.schema["head"].dataType).alias("head")
    named, nameless = signed.filter("name IS NOT NULL"), signed.filter("name IS NULL")
    row = named.join(own, "name").select("id", "key", "name", "head").union(nameless.select("id", "key", "name", none))
    is_first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("key") == F.col("head.key"))
    alone = F.col("name").isNull()
    head = lambda c: F.when(alone, F.col(c)).otherwise(F.col("head")[c])
    class_key = F.concat_ws(":", F.coalesce(head("id").cast("string"), F.lit("")), F.lower(F.hex(head("key"))))
    return row.select("id", "key", head("id").alias("class_id"), (alone | is_first).alias("is_kept"), class_key.alias("class_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, class_id) of every row: the id of the first row of its class."""
    return classified(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(common.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "is_kept", "class_key")
