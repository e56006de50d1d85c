"""Near-duplicate documents by b-bit MinHash.

1. One Arrow pass over whole texts makes each document's set of word shingles, its size, a 128-bit fingerprint of the
   set, 288 minima in 48 bands of six, and the lowest two bits of every minimum packed in nine 64-bit words. The
   full minima are gone after that: what is kept for a document is 48 band keys and 72 bytes.
2. Documents with equal fingerprints have equal sets: the smallest id represents them from here on, so thousands of
   copies cost one row.
3. Representatives that share a band key are candidates. In a bucket nobody forms all pairs: every member is compared with
   the bucket's smallest id (a star), first by the collision-corrected estimate from counting equal two-bit cells
   ((matches/288 - 1/4) / (3/4)), then by intersection and union of the full sets. Confirmed links are merged to
   components; buckets that still hold several components get stars between the components. Members of buckets that are still mixed meet at last
   through an exact inverted index over the rarest fifth of their shingles (prefix, size and position filters), so thousands of documents that share a template but are less alike than the threshold don't form
   all pairs. A pair is never skipped for the size of its bucket: only pairs already in one component are, as their link can't change the result.
4. Components are found by label propagation with pointer jumping over tables in the shared folder.

A link of similarity 0.8 shares no band with probability (1 - 0.8**6)**48 < 5e-7, and the estimate (deviation below 0.03 there)
drops it below ``screen`` = 0.6 with a probability of less than 1e-10.

Defined results: null, empty or wordless texts have an empty set (``n_shingles`` 0), are linked with nothing and
kept. Texts with fewer words than a shingle has form one shingle of all their words. Rows with a null id are left out; of rows that repeat an
id with several sets, the smallest set (then fingerprint) is the document's. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, mix64, shingle_hashes, text_blocks, word_hashes
from ._store import arrow_map, drop_table, ids, load, table

BANDS, ROWS = 48, 6
N = BANDS * ROWS
WORDS64 = N * 2 // 64
SCREEN = 0.6
_RNG = np.random.Generator(np.random.PCG64(977))
MULTIPLIERS = (_RNG.integers(0, 1 << 31, N, dtype=np.uint64) * U64(2) + U64(1)).astype(np.uint32)
MASKS = _RNG.integers(0, 1 << 32, N, dtype=np.uint64).astype(np.uint32)
#: Shingles are hashed in blocks that stay in the processor's cache.
CHUNK = 1 << 15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a block, ascending in each text, and the texts' bounds."""
    words, bounds = word_hashes(data, offsets)
    hashes = shingle_hashes(words, k)
    n_words = np.diff(bounds)
    sizes = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - starts, sizes)
    flat = hashes[take]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        whole = np.zeros(k, dtype=np.uint64)
        whole[: n_words[d]] = words[bounds[d] : bounds[d + 1]]
        flat[starts[d]] = mix64(shingle_hashes(whole, k)[:1] + U64(n_words[d]))[0]
    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s > 1:
            flat[s:e].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[starts[sizes > 0]] = True
    kept = np.zeros(len(flat) + 1, dtype=np.int64)
    np.cumsum(new, out=kept[1:])
    return flat[new], np.append(kept[starts], kept[-1]) if len(starts) else np.zeros(1, np.int64)


def minima(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Array (texts, N) of 32-bit minima; rows of empty sets mean nothing."""
    out = np.full((len(bounds) - 1, N), 0xFFFFFFFF, dtype=np.uint32)
    low = (sets >> U64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds) > 0)
    firsts, ends = bounds[full], bounds[full + 1]
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(firsts, firsts[i] + CHUNK)))
        a, b = firsts[i], ends[j - 1]
        for p in range(a, b, CHUNK * 8):  # a very long text in pieces
            q = min(b, p + CHUNK * 8)
            part = low[p:q]
            cuts = np.maximum(firsts[i:j], p) - p
            rows = full[i:j]
            inside = (cuts < q - p) & (ends[i:j] > p)
            cuts, rows = cuts[inside], rows[inside]
            hashed = np.empty_like(part)
            for h in range(N):
                np.bitwise_xor(part, MASKS[h], out=hashed)
                np.multiply(hashed, MULTIPLIERS[h], out=hashed)
                out[rows, h] = np.minimum(out[rows, h], np.minimum.reduceat(hashed, cuts))
        i = j
    return out


def pack(mins: np.ndarray) -> np.ndarray:
    """The lowest two bits of each (mixed) minimum, 32 to a word."""
    x = mins.astype(np.uint64)
    x = (x ^ (x >> U64(15))) * U64(0x2C1B3C6D)
    bits = ((x >> U64(12)) & U64(3)).reshape(len(mins), WORDS64, 32)
    return (bits << (np.arange(32, dtype=np.uint64) * U64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    x = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * U64(0x9E3779B97F4A7C15), (len(mins), BANDS)).copy()
    for r in range(ROWS):
        out = mix64(out * U64(0x9FB21C651E98DF25) + x[:, :, r])
    return out.view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set."""
    running = np.zeros((2, len(sets) + 1), dtype=np.uint64)
    np.cumsum(mix64(sets), dtype=np.uint64, out=running[0, 1:])
    np.cumsum(mix64(sets ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64, out=running[1, 1:])
    return (running[:, bounds[1:]] - running[:, bounds[:-1]]).view(np.int64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0)
            for a, b, data, offsets in text_blocks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, k)
                sizes = np.diff(bounds)
                prints = fingerprints(sets, bounds)
                mins = minima(sets, bounds)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), _lists(band_keys(mins)), _lists(pack(mins))],
                    names=["doc_id", "n_shingles", "f1", "f2", "bands", "sig"],
                )

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _signatures(k), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(1)):
                sets, bounds = shingle_sets(data, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, fingerprints(sets, bounds)), lists], names=["doc_id", "f1", "f2", "shingles"])

    return run


def _estimate(a: str, b: str):
    cells = " + ".join(f"bit_count(((({a}[{i}] ^ {b}[{i}]) | shiftrightunsigned({a}[{i}] ^ {b}[{i}], 1)) & 6148914691236517205L))" for i in range(WORDS64))
    return F.expr(f"(({N} - ({cells})) / {N}.0D - 0.25D) / 0.75D")


def components(links: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` of every document in a link ``(a, b)``: the smallest id reachable.

    Each round takes the least label among neighbours and then follows the label's own label, so chains shrink by
    half; tables in the shared folder cut the lineage."""
    both = table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = table(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("l", "near").alias("l"), F.col("l").alias("was"))
        jump = lower.alias("x").join(labels.select(F.col("v").alias("l"), F.col("l").alias("ll")), "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("l"), "was")
        new = table(jump, "labels")
        changed = new.where("l <> was").limit(1).count()
        drop_table(labels)
        labels = new.select("v", "l")
        if not changed:
            drop_table(both)
            return labels.select(F.col("v").alias("doc_id"), F.col("l").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, screen: float = SCREEN) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    docs = ids(docs)
    spark = docs.sparkSession
    everything = table(signatures(docs, k), "signatures")
    slim = everything.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "f1", "f2")).alias("s")).select("doc_id", "s.*")
    classes = slim.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    members = table(slim.join(classes, ["f1", "f2"], "left").select("doc_id", "n_shingles", "f1", "f2", F.coalesce("rep", "doc_id").alias("rep")), "members")

    # Everything from here on concerns one representative for each distinct set: of rows that repeat its id, one with its fingerprint.
    KEY = ["doc_id", "f1", "f2"]
    chosen = members.where("rep = doc_id and n_shingles > 0").select(*KEY)
    reps = everything.join(chosen, KEY, "left_semi").dropDuplicates(["doc_id"])
    bands = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("band")
    buckets = table(bands.join(shared, "band"), "buckets")
    involved = chosen.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    sigs = table(everything.join(involved, KEY, "left_semi").select("doc_id", "sig").dropDuplicates(["doc_id"]), "sigs")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own = arrow_map(texts.join(involved.select("doc_id"), "doc_id", "left_semi"), _sets(k), "doc_id long, f1 long, f2 long, shingles array<long>")
    sets = table(own.join(involved, KEY, "left_semi").select("doc_id", "shingles").dropDuplicates(["doc_id"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the estimate lets through and the full sets confirm."""
        left, right = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
        likely = pairs.join(left, "a").join(right, "b").where(_estimate("sa", "sb") >= screen).select("a", "b")
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb"))
        common = likely.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("xa", "xb")))
        return common.where(F.expr(f"100 * i >= {percent} * (size(xa) + size(xb) - i)")).select("a", "b")

    def labelled(found: DataFrame | None) -> DataFrame:
        if found is None:
            return buckets.withColumn("component_id", F.col("doc_id"))
        return buckets.join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))

    def stars(rows: DataFrame) -> DataFrame:
        firsts = rows.groupBy("band", "component_id").agg(F.min("doc_id").alias("b"))
        centres = firsts.groupBy("band").agg(F.min(F.struct("component_id", "b")).alias("c"), F.count("*").alias("n")).where("n > 1")
        return firsts.join(centres, "band").where("component_id <> c.component_id").select(F.col("c.b").alias("a"), "b").distinct()

    def prefix_pairs(rows: DataFrame) -> DataFrame:
        """Pairs of different components that can be similar enough, by an inverted index over the rarest shingles.

        Two sets of similarity t share more than t of the larger one, so in one order of all shingles, rare ones first, they share one among the first
        n - ceil(t n) + 1 of each. Sizes and the places of the shared shingle bound what can be common beyond it."""
        open_ids = rows.select("doc_id", "component_id").distinct()
        shingles = sets.join(open_ids, "doc_id").select("doc_id", "component_id", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
        counted = shingles.groupBy("x").agg(F.count("*").alias("f"), F.min("component_id").alias("low"), F.max("component_id").alias("high"))
        ranked = shingles.join(counted, "x").groupBy("doc_id", "component_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "x", (F.col("low") < F.col("high")).alias("shared")))).alias("s"))
        first = ranked.select("doc_id", "component_id", "n", F.posexplode(F.slice("s", 1, F.col("n") - F.expr(f"cast(ceil({percent} * n / 100) as int)") + 1)).alias("at", "e")).where("e.shared")
        postings = table(first.select("doc_id", "component_id", "n", "at", F.col("e.x").alias("x")), "postings")
        a, b = postings.alias("a"), postings.alias("b")
        alike = a.join(b, "x").where("a.component_id < b.component_id").where(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
        # Common ones besides the prefixes before this place: at most 1 and what is left of either set.
        possible = alike.where(f"(100 + {percent}) * (least(a.at, b.at) + 1 + least(a.n - a.at, b.n - b.at) - 1) >= {percent} * (a.n + b.n)")
        return possible.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()

    links = table(confirmed(stars(labelled(None))), "confirmed")
    found = components(links)
    for last in (False, True):
        rows = labelled(found)
        mixed = rows.groupBy("band").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low < high").select("band")
        open_rows = table(rows.join(mixed, "band"), "open")
        more = table(confirmed(prefix_pairs(open_rows) if last else stars(open_rows)), "confirmed")
        if more.limit(1).count():
            links = links.union(more)
            found = components(links)
        drop_table(open_rows)
    reached = found.select(F.col("doc_id").alias("rep"), "component_id")
    return members.join(reached, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), k=2)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
n as (select doc_id, len(s) as n from s),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)),
both_ways as (select a, b from l union all select b, a from l),
r(d, c) as (select doc_id, doc_id from n union select r.d, b.b from r join both_ways b on b.a = r.c)
select n.doc_id, cast(n.n as bigint) as n_shingles, m.c as component_id, n.doc_id = m.c as kept from n join (select d, min(c) as c from r group by d) m on m.d = n.doc_id
"""
