"""Documents: signatures, and similarity joins over them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.estimators import inclusion_probability, pick_bands, pick_hashes_and_bands
from ..functions.hashing import element_code, seeded_hash_sql, string_hash32, string_hash64
from ..operators.similarity import BuildConfig, Index, QueryConfig, build_index
from ..operators.signatures import EMPTY, CustomSketcher, Hamming, MinHash, SimHash
from .inputs import COMMON_SQL, DOCS_SQL, ELEMENTS_SQL, PAIRS_SQL, SCORED_SQL, SIZES_SQL, WORDS_SQL, bands_sql, codes, document_items, load, minima_sql, same_sql, words
from .registry import register

N, BANDS = 64, 16
BASE = f"with {ELEMENTS_SQL}, {DOCS_SQL}, {minima_sql(N)}"
JOINED = f"{BASE}, {bands_sql(N, BANDS)}, {PAIRS_SQL}, {SIZES_SQL}, {COMMON_SQL}, {SCORED_SQL}"
MIRRORED = "both_ways as (select * from scored union all select other_id, id, score from scored)"


def index_of(spark: SparkSession, sf_dir: str, n: int = N, bands: int = BANDS, **config) -> Index:
    return build_index(document_items(spark, sf_dir), MinHash(n), BuildConfig(bands), config=QueryConfig(**config))


@register("minhash_signatures", f"{BASE} select id, array_to_string([{', '.join(f'h{i}' for i in range(N))}], ',') as sig from sig")
def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MinHash(N).transform(document_items(spark, sf_dir)).select("id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("sig"))


@register("minhash_estimate_pairs", f"{BASE}, {bands_sql(N, BANDS)}, {PAIRS_SQL}, m as (select a.id, b.id as other_id, {same_sql(N)} as same from pairs p join sig a on a.id = p.id join sig b on b.id = p.other_id), f as (select id, other_id, same / {N}.0 as score from m where same >= 32) select id, other_id, score::double as score from f union all select other_id, id, score::double from f")
def minhash_estimate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with an estimate of at least 0.5, from signatures alone."""
    return index_of(spark, sf_dir, threshold=0.5).with_score("estimate").self_join().drop("rank")


@register("near_duplicate_documents", f"{JOINED} select id, other_id, round(score, 6) as score from scored where score >= 0.5")
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, threshold=0.5)
    return index.scored_pairs().withColumn("score", F.round("score", 6))


@register("top_k_similar_documents", f"{JOINED}, {MIRRORED}, r as (select *, row_number() over (partition by id order by score desc, other_id) as rank from both_ways where score >= 0.5) select id, other_id, round(score, 6) as score, rank::int as rank from r where rank <= 3")
def top_k_similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands are those picked for 0.5: pairs just there are found with a probability of 0.64, those at 0.7 of 0.99 (``band_tuning``)."""
    return index_of(spark, sf_dir, threshold=0.5, max_results=3).self_join().withColumn("score", F.round("score", 6))


@register("best_neighbour_or_none", f"{JOINED}, {MIRRORED}, r as (select *, row_number() over (partition by id order by score desc, other_id) as rank from both_ways where score >= 0.5) select docs.id, coalesce(r.other_id, -1) as other_id from docs left join r on r.id = docs.id and r.rank = 1")
def best_neighbour_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids only, one row for each document even without a neighbour (-1)."""
    return index_of(spark, sf_dir, threshold=0.5, max_results=1).self_join(scores=False, keep_lonely=True).select("id", F.coalesce("other_id", F.lit(-1)).alias("other_id"))


def _chain_sql(i: int, least: str = "x", steps: int = 3) -> str:
    values, v = [], "x"
    for step in range(1, steps + 1):
        v = seeded_hash_sql(i * 1000, v)
        values.append(v if step == 1 else f"case when w >= {step} then {v} end")
    return f"least({', '.join(values)})"


@register("weighted_minhash", f"with e as (select doc_id as id, ('0x' || substr(md5(w), 1, 7))::bigint as x, 1 + length(w) % 3 as w from (select doc_id, unnest({WORDS_SQL.format('text')}) as w from documents)), v as (select x, min(w) as w from e group by x), u as (select distinct id, x from e), j as (select id, x, w from u join v using (x)) select docs.id, " + ", ".join(f"coalesce(min({_chain_sql(i)}), 2147483647)::int as h{i}" for i in range(8)) + " from (select doc_id as id from documents) docs left join j on j.id = docs.id group by docs.id")
def weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word weighs 1 to 3 by its length."""
    known = load(spark, sf_dir, "documents").select(F.explode(words()).alias("word"))
    weights = known.groupBy(element_code(F.col("word")).alias("element")).agg((F.min(F.length("word") % 3) + 1).alias("weight"))
    sig = MinHash(8, weights=weights, max_weight=3).transform(document_items(spark, sf_dir))
    return sig.select("id", *(F.col("sig")[i].alias(f"h{i}") for i in range(8)))


def _packed_sql(parts: list[str]) -> str:
    """Bits to one signed 64-bit number."""
    low = " + ".join(f"(({p})::bigint << {i})" for i, p in enumerate(parts[:63]))
    return f"({low} + case when ({parts[63]}) = 1 then -9223372036854775808 else 0 end)"


@register("single_bit_minhash", f"{BASE} select id, {_packed_sql([f'(h{i} & 1)' for i in range(64)])} as bits from sig")
def single_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MinHash(N, single_bit=True).transform(document_items(spark, sf_dir)).select("id", F.get("sig", F.lit(0)).alias("bits"))


@register("minhash_neighbours", f"{BASE}, s as (select e.id, " + ", ".join(f"min(case when {seeded_hash_sql(i * 1000, 'x')} > h{i} then {seeded_hash_sql(i * 1000, 'x')} end)::int as s{i}" for i in range(4)) + " from e join sig on sig.id = e.id group by e.id) select docs.id, " + ", ".join(f"coalesce(s{i}, 2147483647) as s{i}" for i in range(4)) + " from docs left join s on s.id = docs.id")
def minhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second least hash of each component, to which a probe flips."""
    return MinHash(4).neighbours(document_items(spark, sf_dir)).select("id", *(F.coalesce(F.get("next", F.lit(i)), F.lit(EMPTY)).alias(f"s{i}") for i in range(4)))


SIMHASH_SQL = f"""with w as materialized (select doc_id as id, md5(w) as m from (select doc_id, unnest({WORDS_SQL.format('text')}) as w from documents)),
h as materialized (select id, ('0x' || substr(m, 1, 8))::bigint as hi, ('0x' || substr(m, 9, 8))::bigint as lo from w),
v as materialized (select docs.id, {', '.join(f"(coalesce(sum(case when ({'lo' if b < 32 else 'hi'} >> {b % 32}) & 1 = 1 then 1 when lo is not null then -1 end), 0) > 0)::int as b{b}" for b in range(64))} from (select doc_id as id from documents) docs left join h on h.id = docs.id group by docs.id)"""


def _simhashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHash().transform(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), words().alias("item")))


@register("simhash_documents", f"{SIMHASH_SQL} select id, {_packed_sql([f'b{i}' for i in range(64)])} as bits from v")
def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhashes(spark, sf_dir).select("id", F.get("sig", F.lit(0)).alias("bits"))


@register("hamming_pairs", f"{SIMHASH_SQL}, {bands_sql(64, 8, 'b', 'v')}, {PAIRS_SQL}, m as (select p.id, p.other_id, " + " + ".join(f"(a.b{i} = b.b{i})::int" for i in range(64)) + " as same from pairs p join v a on a.id = p.id join v b on b.id = p.other_id) select id, other_id, same as same_bits, round(same / 64.0, 6)::double as estimate from m where same >= 58")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose SimHashes agree in at least 58 of 64 bits, with the estimate; of such pairs two bands of eight bits agree at least, so none is missed."""
    hashes = _simhashes(spark, sf_dir).withColumnRenamed("sig", "item")
    index = build_index(hashes, Hamming(64), BuildConfig(8))
    pairs = index.same_pairs(58).select("id", "other_id", F.col("same").cast("int").alias("same_bits"))
    return pairs.withColumn("estimate", F.round(index.sketcher.estimator.estimate(F.col("same_bits")), 6))


BANDED = f"{BASE}, {bands_sql(N, BANDS)}"


@register("bucket_stats", f"{BANDED}, s as (select band, slice, count(*) as n from bands group by all) select band, n as size, count(*) as buckets from s group by all")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).bucket_sizes().groupBy("band", "size").agg(F.count("*").alias("buckets"))


@register("bucket_members", f"{BANDED}, s as (select band, slice, array_to_string(list_sort(list(id)), ',') as ids, count(*) as n from bands group by all) select band, ids from s where n between 2 and 6")
def bucket_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(document_items(spark, sf_dir), MinHash(N), BuildConfig(BANDS, min_bucket_size=2, max_bucket_size=6))
    return index.buckets().select("band", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


FILTERED = "ok as (select band, slice from bands group by all having count(*) <= 4), kept as materialized (select bands.* from bands join ok using (band, slice))"


@register("bucket_size_filter", f"{BANDED}, {FILTERED}, {PAIRS_SQL.replace('bands a', 'kept a').replace('bands b', 'kept b')} select id, other_id, collisions from pairs")
def bucket_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, max_bucket_size=4).candidate_pairs()


@register("hashed_slices", f"{JOINED} select id, other_id, round(score, 6) as score from scored where score >= 0.5")
def hashed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets by 48 bits of the slices' hash: a chance collision would only add a candidate. Rows as near_duplicate_documents."""
    index = build_index(document_items(spark, sf_dir), MinHash(N), BuildConfig(BANDS, hash_bits=48), config=QueryConfig(threshold=0.5))
    return index.scored_pairs().select("id", "other_id", F.round("score", 6).alias("score"))


@register("candidate_lists", f"{BANDED} select a.id, b.id as other_id, count(*) as collisions from bands a join bands b on a.band = b.band and a.slice = b.slice where a.id % 20 = 0 group by all")
def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every twentieth document among all, themselves included."""
    index = index_of(spark, sf_dir)
    return index.candidates_of(index.items.where("id % 20 = 0"))


@register("raw_candidates", f"{BANDED} select a.id, b.id as other_id, a.band from bands a join bands b on a.band = b.band and a.slice = b.slice where a.id % 20 = 0")
def raw_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return index.candidates(index.items.where("id % 20 = 0"), distinct=False)


@register("max_candidates", f"{JOINED}, q as (select id, other_id, collisions from pairs union all select other_id, id, collisions from pairs), r as (select *, row_number() over (partition by id order by collisions desc, other_id) as nth from q) select r.id, r.other_id, round(score, 6) as score from r join scored s on s.id = least(r.id, r.other_id) and s.other_id = greatest(r.id, r.other_id) where nth <= 2")
def max_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, max_candidates=2).self_join().select("id", "other_id", F.round("score", 6).alias("score"))


def _probe_sql() -> str:
    nexts = ", ".join(f"min(case when {seeded_hash_sql(i * 1000, 'x')} > h{i} then {seeded_hash_sql(i * 1000, 'x')} end) as s{i}" for i in range(16))
    own = bands_sql(16, 4)
    flips = []
    for b in range(4):
        flips.append(f"select id, {b} as band, [{', '.join(f'h{b * 4 + j}' for j in range(4))}] as slice from q")
        for p in range(2):
            at = [f"s{b * 4 + j}" if j == p else f"h{b * 4 + j}" for j in range(4)]
            flips.append(f"select id, {b} as band, [{', '.join(at)}] as slice from q where s{b * 4 + p} is not null")
    return f"with {ELEMENTS_SQL}, {DOCS_SQL}, {minima_sql(16)}, {own}, q as (select sig.*, {', '.join(f's{i}' for i in range(16))} from sig join (select e.id, {nexts} from e join sig on sig.id = e.id group by e.id) n on n.id = sig.id where sig.id % 20 = 0), probes as ({' union all '.join(flips)}) select p.id, b.id as other_id, count(*) as collisions from probes p join bands b on b.band = p.band and b.slice = p.slice group by all"


@register("multi_probe", _probe_sql())
def multi_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band is also looked up with its first and with its second component replaced by the neighbour."""
    index = build_index(document_items(spark, sf_dir), MinHash(16), BuildConfig(4), config=QueryConfig(probes=3))
    return index.candidates(index.items.where("id % 20 = 0"))


CONTAMINATION = f"""with d as materialized (select distinct 'd' || doc_id as id, ('0x' || substr(md5(w), 1, 7))::bigint as x from (select doc_id, unnest({WORDS_SQL.format('text')}) as w from documents)),
q as materialized (select distinct 'q' || item_id as id, ('0x' || substr(md5(w), 1, 7))::bigint as x from (select item_id, unnest({WORDS_SQL.format('text')}) as w from benchmark)),
e as materialized (select * from d union all select * from q), docs as (select distinct id from e), {minima_sql(N)}, {bands_sql(N, 32)},
pairs as materialized (select distinct a.id, b.id as other_id from bands a join bands b on a.band = b.band and a.slice = b.slice and a.id like 'q%' and b.id like 'd%'), {SIZES_SQL}, {COMMON_SQL}, {SCORED_SQL}
select substr(id, 2)::bigint as id, substr(other_id, 2)::bigint as other_id, round(score, 6) as score from scored where score >= 0.3"""


@register("query_join", CONTAMINATION)
def query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries from outside against all documents; 32 bands of two find pairs at 0.3 with a probability of 0.95."""
    return _benchmark_matches(spark, sf_dir, index_of(spark, sf_dir, bands=32, threshold=0.3))


@register("hashed_query_join", CONTAMINATION)
def hashed_query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against an index whose buckets are numbered by 48 bits of the slices' hash."""
    return _benchmark_matches(spark, sf_dir, build_index(document_items(spark, sf_dir), MinHash(N), BuildConfig(32, hash_bits=48), config=QueryConfig(threshold=0.3)))


def _benchmark_matches(spark: SparkSession, sf_dir: str, index: Index) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_sort(F.array_distinct(codes())).alias("item"))
    return index.query(items).select("id", "other_id", F.round("score", 6).alias("score"))


@register("similar_indexes", f"{JOINED}, {MIRRORED} select id, other_id from both_ways where score >= 0.5 and id % 20 = 0")
def similar_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir, threshold=0.5)
    return index.query_ids(index.items.where("id % 20 = 0"), scores=False).drop("rank")


@register("brute_force_sketch", f"{BASE}, m as (select a.id, b.id as other_id, {same_sql(N)} as same from sig a, sig b where a.id <> b.id and a.id % 20 = 0) select id, other_id, (same / {N}.0)::double as score from m where same >= 44")
def brute_force_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth document against all, by signatures, with an estimate of at least 0.7."""
    index = index_of(spark, sf_dir)
    return index.brute_force(index.items.where("id % 20 = 0"), least_estimate=0.7)


@register("search_statistics", f"{BANDED}, {PAIRS_SQL}, s as (select count(*) as n from bands group by band, slice) select (select cast(sum(n * n) as bigint) from s) as candidates, (select 2 * count(*) from pairs) as comparisons")
def search_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).statistics()


@register("index_roundtrip", f"{BANDED} select band, count(*) as n, count(distinct slice) as buckets from bands group by band")
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band table written to disk and read back, by band."""
    from ..sources.index_store import read_index, write_index
    from ..sources.tables import shared_path

    path = shared_path(spark, "index")
    write_index(index_of(spark, sf_dir), path)
    return read_index(spark, path, MinHash(N)).bands.groupBy("band").agg(F.count("*").alias("n"), F.countDistinct("slice").alias("buckets"))


JAVA_HASH_SQL = "list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::bigint), lambda h, c: (h * 31 + c) & 4294967295)"


@register("string_hashes", f"select doc_id, w, ('0x' || substr(md5(w), 1, 7))::bigint as code, {JAVA_HASH_SQL} as h32, case when ('0x' || substr(md5(w), 1, 1))::int >= 8 then (('0x' || substr(md5(w), 1, 16))::hugeint - 18446744073709551616::hugeint)::bigint else ('0x' || substr(md5(w), 1, 16))::bigint end as h64 from (select doc_id, unnest({WORDS_SQL.format('text')}) as w from documents)")
def string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash functions of strings on the words of all documents."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(words()).alias("w"))
    return rows.select("doc_id", "w", element_code(F.col("w")).alias("code"), string_hash32(F.col("w")).alias("h32"), string_hash64(F.col("w")).alias("h64"))


SINGLE_SQL = f"with {ELEMENTS_SQL}, {DOCS_SQL}, {minima_sql(128)}, v as materialized (select id, {', '.join(f'(h{i} & 1) as b{i}' for i in range(128))} from sig), {bands_sql(128, 8, 'b', 'v')}, {PAIRS_SQL}"


@register("single_bit_estimates", f"{SINGLE_SQL}, m as (select p.id, p.other_id, {' + '.join(f'(a.b{i} = b.b{i})::int' for i in range(128))} as same from pairs p join v a on a.id = p.id join v b on b.id = p.other_id) select id, other_id, same, round(1 - 2 / 128.0 * (128 - same), 6)::double as score from m where same >= 119")
def single_bit_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of at least 0.85 estimated from single bits: 119 of 128 must agree. Eight bands of sixteen bits find pairs at 0.85 with a probability of 0.93."""
    index = build_index(document_items(spark, sf_dir), MinHash(128, single_bit=True), BuildConfig(8), score="estimate", config=QueryConfig(threshold=0.85))
    pairs = index._scored(index.candidate_pairs().select("id", "other_id"), index.items)
    return pairs.select("id", "other_id", F.round(128 - (1 - F.col("score")) * 64).cast("int").alias("same"), F.round("score", 6).alias("score"))


@register("custom_family", f"with {ELEMENTS_SQL}, {DOCS_SQL}, l as (select docs.id, list_sort(list(x) filter (x is not null)) as a from docs left join e on e.id = docs.id group by docs.id), sig as (select id, {', '.join(f'coalesce(a[{i + 1}], -1)::int as h{i}' for i in range(4))} from l), {bands_sql(4, 2)} select band, slice[1] as s0, slice[2] as s1, count(*) as n from bands group by all")
def custom_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family of the caller's: component i is the i-th least code, and the sizes of the buckets that two bands of it make."""
    family = CustomSketcher(4, lambda i: lambda item: F.coalesce(F.get(item, F.lit(i)), F.lit(-1)))
    index = build_index(document_items(spark, sf_dir), family, BuildConfig(2))
    return index.bucket_sizes().select("band", F.col("slice")[0].alias("s0"), F.col("slice")[1].alias("s1"), F.col("size").alias("n"))


@register("index_lookup", f"{BANDED} select distinct b.band, b.id from bands a join bands b on a.band = 3 and b.band = 3 and a.slice = b.slice where a.id % 20 = 0")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who shares the fourth band of a stored table with any of every twentieth document; only that band's files are read."""
    from ..sources.index_store import lookup, read_index, write_index
    from ..sources.tables import shared_path

    path = shared_path(spark, "index")
    write_index(index_of(spark, sf_dir), path)
    index = read_index(spark, path, MinHash(N))
    wanted = index.bands.where("band = 3 and id % 20 = 0").select("slice").distinct()
    return lookup(index, 3, wanted).select("band", "id")


_CHOICES = [(t / 20, n) for t in range(2, 20) for n in (16, 64, 100, 128)]


@register("band_choice", f"with c(threshold, n) as (values {', '.join(map(str, _CHOICES))}), b as (select threshold::double as threshold, n, min(b) as bands from c join (select unnest(range(1, 2000)) as b) on b * ln(b) >= -n * ln(threshold) - 1e-9 group by all) select threshold, n::int as n, bands::int as bands, (n // bands * bands)::int as hashes from b")
def band_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands, and the hashes they use, that are picked for a threshold and a number of hashes."""
    rows = [(t, n, pick_bands(t, n), pick_hashes_and_bands(t, n)[0]) for t, n in _CHOICES]
    return spark.createDataFrame(rows, "threshold double, n int, bands int, hashes int")


@register("band_tuning", "with s as (select unnest(range(1, 100)) / 100.0 as s) select s::double as s, round(1 - pow(1 - pow(s, 4), 16), 9) as p16, round(1 - pow(1 - pow(s, 10), 6), 9) as p6, round(pow(1 / 16.0, 1 / 4.0), 9) as threshold16 from s")
def band_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that pairs of similarity s are candidates, with 16 and with 6 bands of 64 components."""
    from ..functions.estimators import estimated_threshold

    s = spark.range(1, 100).select((F.col("id") / 100.0).alias("s"))
    chance = partial(inclusion_probability, F.col("s"), 64)
    return s.select("s", F.round(chance(16), 9).alias("p16"), F.round(chance(6), 9).alias("p6"), F.round(F.lit(estimated_threshold(64, 16)), 9).alias("threshold16"))
