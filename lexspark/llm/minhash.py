"""MinHash near-duplicate detection, exact in its links.

1. A document's set: distinct shingles of five words, each as a 64-bit polynomial hash of 64-bit word hashes.
   Documents with the same set form a class, a node, numbered once in a table; its smallest id stands for it.
2. HASHES universal hash functions (multiply-shift) give the minima of a set; BANDS bands of ROWS minima give buckets.
3. Signature verification and full sets. In each bucket one pivot is compared with every member (linear in the bucket);
   the links that full sets confirm go to connected components (alternating large-star and small-star). Buckets whose
   members are then still in different components are compared whole, by classes of set sizes that a link can join and
   in blocks of bounded size: pairs of one component are skipped, pairs whose minima agree too seldom to reach the
   threshold are passed over, the others are confirmed on full sets, and each block returns at most a spanning forest
   of its links. No pair of a group is emitted as a row. What a bucket's members are joined with is salted by its size.
4. The components of the classes, joined back to all documents.

Sets are made again, for the documents that share a bucket alone: a table of BITS bits, of a fixed size, holds the hashed
ids of those documents and keeps most other texts out of Python and out of the shuffle; set keys then decide exactly.
Once about as many documents as bits share buckets it keeps nothing out any more, and only time is lost.

Null, empty and blank texts: the empty set, linked with nothing. Fewer than five words: the whole sequence is the one
shingle. Repeated rows of one id are one document if their sets agree; rows of one id with different sets are nodes of
their own, linked each by its own set, that share the id in the result. Ids of any type that has an order; null ids: own
rows, never linked. Very long texts are shingled whole, each in a block of its own. Ties of pivots: the smaller node.
Other columns are not looked at. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import as_bytes, blocks, cut, numbered, starts, stored

SHINGLE, BANDS, ROWS = 5, 24, 4
HASHES = BANDS * ROWS
#: A link: intersection * 100 >= SHARE * union.
SHARE = 85
#: Members of a bucket that are compared with one another in a task.
BLOCK = 256
#: Salts by which buckets meet their sizes; members of a bucket for a salt once sizes are known.
SPREAD, SALT = 8, 256
#: Bits of the table of hashed ids (4 MB), and of each of its rows.
BITS, BITS_ROW = 1 << 25, 1 << 15
_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, HASHES, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after another, and where each begins."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    number, own = numbered([x for w in words for x in w])
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))[number] if len(own) else np.zeros(0, np.uint64)
    at = starts(n)
    total = int(at[-1])
    with np.errstate(over="ignore"):
        h = hashed.copy()
        for k in range(1, width):
            h = h * _P
            h[: total - k] += hashed[k:]
        short = np.nonzero((n > 0) & (n < width))[0]
        whole = []
        for i in short:
            x = np.uint64(n[i])
            for v in hashed[at[i] : at[i + 1]]:
                x = x * _P + v + np.uint64(1)
            whole.append(x)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        keep = np.arange(total) < np.repeat(at[:-1] + count, n)
        h[at[:-1][short]] = np.array(whole, np.uint64)
        h = h[keep]
        h = (h ^ (h >> np.uint64(33))) * _MIX
        h ^= h >> np.uint64(29)
    doc = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], starts(np.bincount(doc[new], minlength=len(n)))


def signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Minima of each text's shingles, uint32 [texts, HASHES]; of an empty set 0."""
    out = np.zeros((len(begin) - 1, HASHES), np.uint32)
    full = np.nonzero(np.diff(begin) > 0)[0]
    step = 1 << 15
    with np.errstate(over="ignore"):
        if len(full):
            at = begin[:-1][full]
            # portions of whole texts that fit the cache
            edges = [0]
            for i in range(1, len(full)):
                if begin[full[i]] - begin[full[edges[-1]]] >= step:
                    edges.append(i)
            edges.append(len(full))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = h[at[a] : begin[full[b - 1] + 1]]
                local = at[a:b] - at[a]
                for k in range(HASHES):
                    out[full[a:b], k] = np.minimum.reduceat(((part * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), local)
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_key (null for the empty set), signature (little-endian 32-bit minima)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in blocks(texts):
                h, begin = shingles(texts[a:b])
                sign = signatures(h, begin)
                n = np.diff(begin)
                key = [xxhash.xxh3_128_digest(h[x:y].tobytes()) if y > x else None for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(key, pa.binary()), pa.array([s.tobytes() for s in sign], pa.binary())], [id_col, "n_shingles", "set_key", "signature"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_shingles bigint, set_key binary, signature binary")


def sets_of(docs: DataFrame, text_col: str) -> DataFrame:
    """key (set_key of features), shingles (sorted little-endian 64-bit hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in blocks(texts):
                h, begin = shingles(texts[a:b])
                own = [h[x:y].tobytes() for x, y in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], ["key", "shingles"])

    return docs.select(text_col).mapInArrow(run, "key binary, shingles binary")


def _hashed_in(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The documents whose ids' hashes are in a table of BITS bits of the ids' hashes: all that are among ids, and a few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    bits = ids.select(place("id").alias("p")).groupBy(F.floor(F.col("p") / BITS_ROW).cast("int").alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("p") % BITS_ROW).alias("_bits"))  # BITS / 8 bytes at most, so it is broadcast
    at = place(id_col) % BITS_ROW
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("_part", F.floor(place(id_col) / BITS_ROW).cast("int")).join(F.broadcast(bits), "_part")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(docs.columns)


def linked(x: bytes, y: bytes, share: int = SHARE) -> bool:
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) of nodes that are links on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([linked(x, y, share) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node, which has no row itself): alternating large-star and small-star until nothing changes."""
    now = cut(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a hub's links go to several tasks
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        large = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int")).join(spread, ["u", "salt"]).select(F.col("v"), F.col("m")).where("v > m").distinct()
        small = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(small, "v").select(F.when(F.col("m") == F.col("least"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("least").alias("u")).where("v > u").select("u", "v").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def _salt(node: str = "node") -> Column:
    """A member's salt in a bucket of n: one for each SALT members."""
    return F.pmod(F.xxhash64(node), F.ceil(F.col("n") / SALT)).cast("int").alias("salt")


def _salted(of_bucket: DataFrame) -> DataFrame:
    """A row for each salt of a bucket: what all members of a bucket are joined with goes to many tasks where they are many."""
    return of_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALT).cast("int") - 1))).drop("n")


def _in_blocks(open_: DataFrame, classes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links between members of a bucket that are in different components; open_: bucket, n, node, component, n_shingles.

    Sets that are linked differ in size by the factor 100 / share at most, so a member meets those of its own class of
    sizes and of the two next ones. A class of sizes of many members is dealt into blocks."""
    least_alike = share / 100 - 5 * (share / 100 * (1 - share / 100) / HASHES) ** 0.5

    def run(own: pa.Table) -> pa.Table:
        first = [own.column(c)[0].as_py() for c in ("b1", "p1", "b2", "p2")]
        bins, block, comp = own.column("bin").to_numpy(), own.column("block").to_numpy(), own.column("component").to_pylist()
        sign = np.frombuffer(b"".join(own.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        sets = own.column("shingles").to_pylist()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left = np.nonzero((bins == first[0]) & (block == first[1]))[0]
        right = np.nonzero((bins == first[2]) & (block == first[3]))[0]
        a_of, b_of = [], []
        for i in left.tolist():
            alike = (sign[right] == sign[i]).mean(axis=1)
            for k in np.argsort(-alike, kind="stable").tolist():
                if alike[k] < least_alike:
                    break
                j = int(right[k])
                a, b = root(comp[i]), root(comp[j])
                if a != b and linked(sets[i], sets[j], share):
                    parent[a] = b
                    a_of.append(i)
                    b_of.append(j)
        nodes = own.column("node")
        return pa.table({"a": nodes.take(pa.array(a_of, pa.int64())), "b": nodes.take(pa.array(b_of, pa.int64()))})

    size = F.floor(F.ln("n_shingles") / F.lit(float(np.log(100 / (share - 1))))).cast("int")
    rows = open_.withColumn("bin", size)
    blocks_of = rows.groupBy("bucket", "bin").agg(F.first("n").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    # at most some hundred classes of sizes in a bucket
    blocks_of = blocks_of.groupBy("bucket").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("blocks"))
    rows = rows.withColumn("salt", _salt()).join(_salted(blocks_of), ["bucket", "salt"])
    count = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0))
    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda q: q < n)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), count(F.col("bin"))).cast("int"))
    meeting = lambda b1, p1, b2, p2: F.struct(b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"))
    b, p = F.col("bin"), F.col("block")
    meetings = F.concat(
        F.transform(up_to(count(b)), lambda q: meeting(b, F.least(p, q), b, F.greatest(p, q))),
        F.transform(up_to(count(b + 1)), lambda q: meeting(b, p, b + 1, q)),
        F.transform(up_to(count(b - 1)), lambda q: meeting(b - 1, q, b, p)),
    )
    rows = rows.select("bucket", "node", "component", "bin", "block", F.explode(meetings).alias("m")).select("bucket", "node", "component", "bin", "block", "m.*")
    # signatures and sets come last: the rows before are narrow
    rows = rows.join(classes.select("node", "signature"), "node").join(sets, "node")
    return rows.groupBy("bucket", "b1", "p1", "b2", "p2").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable), kept."""
    own = stored(features(docs, id_col, text_col).select(F.col(id_col).alias("_row"), "n_shingles", "signature", F.when(F.col(id_col).isNotNull(), F.col("set_key")).alias("_set")))
    classes = own.where("_set is not null").groupBy("_set").agg(F.min("_row").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "id", F.col("_set").alias("key"), "signature", "n_shingles"))

    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.substring("signature", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))).alias("band", "part")
    member = classes.select("node", bands).select("node", F.xxhash64("band", "part").alias("bucket")).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    member = stored(member.join(sizes, ["bucket", "salt"]).drop("salt"))  # documents that are alone in their buckets end here
    # the pivot: the member whose other buckets are the fullest, most likely the middle of its group
    weight = member.groupBy("node").agg(F.sum("n").alias("w"))
    pivots = member.join(weight, "node").groupBy("bucket").agg(F.first("n").alias("n"), F.min(F.struct((-F.col("w")).alias("w"), "node")).alias("p")).select("bucket", "n", F.col("p.node").alias("a"))
    pairs = member.withColumn("salt", _salt()).join(_salted(pivots), ["bucket", "salt"]).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    wanted = classes.select("node", "id", "key").join(member.select("node").distinct(), "node", "left_semi")
    named = _hashed_in(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", wanted.select("id"))
    # repeated rows, and other texts with hashes in the table
    sets = sets_of(named, "_text").join(wanted.select("node", "key"), "key")
    sets = stored(sets.groupBy("key").agg(F.first("node").alias("node"), F.first("shingles").alias("shingles")).select("node", "shingles"))
    links = cut(confirmed(pairs, sets, share))
    comp = cut(components(links))

    state = member.join(comp, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    # of a bucket of two, the only pair has been compared
    still = state.where("n > 2").groupBy("bucket").agg(F.first("n").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("x < y")
    still = still.groupBy("n", "who").agg(F.min("bucket").alias("bucket"))  # buckets with the same members are compared once
    left = state.withColumn("salt", _salt()).join(_salted(still.select("bucket", "n")), ["bucket", "salt"]).drop("salt")
    left = cut(left.join(classes.select("node", "n_shingles"), "node"))
    more = cut(_in_blocks(left, classes, sets, share))
    if not more.isEmpty():
        # only the components that the new links join are gone over again
        of = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        joined = more.join(of, F.col("a") == F.col("_n"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
        joined = joined.join(of, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_c", "b").alias("b"))
        met = cut(components(joined))
        to = met.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        comp = comp.join(to, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")).union(met)

    comp = comp.union(comp.select("component", "component").distinct())  # a component's own node is in no link of its own
    least = classes.select("node", "id").join(comp, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    named_comp = classes.select("node", "key", F.col("id").alias("class_id")).join(comp.join(least, "component").select("node", "component_id"), "node", "left")
    named_comp = named_comp.select(F.col("key").alias("_key"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = own.join(named_comp, own["_set"] == named_comp["_key"], "left")
    return out.select(
        F.col("_row").alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "_row").alias("class_id"),
        F.coalesce("component_id", "_row").alias("component_id"),
        (F.coalesce("component_id", "_row").eqNullSafe(F.col("_row"))).alias("kept"),
    )
