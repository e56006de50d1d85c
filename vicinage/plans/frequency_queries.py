"""Counts, dictionaries, filters, term weights, factors and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import Xorshift128, bit_slice, higher_power_of_two, pack_pair, seeded_hash, seeded_hash_sql, unpack_high, unpack_low
from ..operators import factorization, sorting
from ..operators import frequency as fq
from ..operators.bloom import BloomFilter, BloomShape, CountingBloomFilter, optimal_size, seen_before
from .inputs import load, ratings
from .registry import register


@register("freq_counts", "select user_id, count(*) as n from events group by user_id")
def freq_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.frequencies(load(spark, sf_dir, "events"), "user_id")


@register("freq_top_k", "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10")
def freq_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.most_frequent(load(spark, sf_dir, "events"), "user_id", 10)


@register("approx_top_k", "select event_type, count(*) as n from events group by event_type order by n desc, event_type limit 3")
def approx_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct values: the sketch is exact here."""
    return fq.approx_most_frequent(load(spark, sf_dir, "events"), "event_type", 3)


@register("dictionary_put", "select user_id, arg_max(event_type, event_id) as value from events group by user_id")
def dictionary_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.put_all(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@register("dictionary_put_if_absent", "select user_id, arg_min(event_type, event_id) as value from events group by user_id")
def dictionary_put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.put_all(load(spark, sf_dir, "events"), "user_id", "event_type", "event_id", keep="first")


@register("dictionary_counts", "select l_partkey, (10 + sum(l_linenumber))::bigint as value from lineitem group by l_partkey")
def dictionary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.add_all(load(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", default=10)


@register("dictionary_lookup", "with d as (select o_custkey as k, count(*) as value from orders group by o_custkey) select c_custkey, coalesce(value, 0) as value, value is not null as contained from customer left join d on k = c_custkey")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fq.frequencies(load(spark, sf_dir, "orders"), "o_custkey").select(F.col("o_custkey").alias("c_custkey"), F.col("n").alias("value"))
    return fq.lookup(load(spark, sf_dir, "customer").select("c_custkey"), known, "c_custkey")


@register("dictionary_remove", "with d as (select user_id, count(*) as value from events group by user_id) select user_id, value from d where user_id not in (select user_id from events where event_id % 90 = 0)")
def dictionary_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    counts = fq.frequencies(events, "user_id").withColumnRenamed("n", "value")
    return fq.remove(counts, events.where("event_id % 90 = 0").select("user_id").distinct(), "user_id")


@register("dictionary_overlap", "with a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'A') select (select count(*) from a join b using (k)) as common, (select count(*) from (select k from a union select k from b)) as total")
def dictionary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return fq.overlap_sizes(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "k")


@register("dictionary_intersection", "select distinct l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A'")
def dictionary_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return lines.where("l_returnflag = 'R'").select("k").intersect(lines.where("l_returnflag = 'A'").select("k"))


@register("string_set", "select distinct p_type from part")
def string_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_type").distinct()


INDEX_SQL = "with f as (select p_brand, min(p_partkey) as s from part group by p_brand), i as (select p_brand, row_number() over (order by s, p_brand) - 1 as ordinal from f)"


@register("string_index", f"{INDEX_SQL} select p_brand, ordinal from i")
def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.string_index(load(spark, sf_dir, "part"), "p_brand", "p_partkey")


@register("string_index_lookup", f"{INDEX_SQL}, k as (select distinct p_brand as key from part union select distinct c_mktsegment from customer) select key, coalesce(ordinal, -1) as ordinal from k left join i on p_brand = key")
def string_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, and market segments, which have no ordinal."""
    part = load(spark, sf_dir, "part")
    keys = part.select(F.col("p_brand").alias("key")).union(load(spark, sf_dir, "customer").select("c_mktsegment")).distinct()
    return fq.ordinal_of(keys, fq.string_index(part, "p_brand", "p_partkey").withColumnRenamed("p_brand", "key"), "key")


RATE, HASHES = 0.01, 7  # seven hashes are best at this rate, whatever the number of elements


def _shape_sql(table: str, key: str, name: str = "shape") -> str:
    """One row: the number of positions, a power of two, for the distinct keys of a table."""
    return f"{name} as materialized (select pow(2, greatest(6, ceil(log2(ceil(-count(distinct {key}) * ln({RATE}) / pow(ln(2), 2))))))::bigint as bits from {table})"


def _positions_sql(key: str, hashes: int = HASHES) -> str:
    return "[" + ", ".join(f"({seeded_hash_sql(i * 4747, key)} & ((select bits from shape) - 1))" for i in range(hashes)) + "]"


def _shape(df: DataFrame, key: str) -> BloomShape:
    return BloomShape.for_elements(df.select(key).distinct().count(), RATE)


@register("bloom_membership", f"with {_shape_sql('orders', 'o_custkey')}, s as (select distinct unnest({_positions_sql('o_custkey')}) as p from orders), a as (select c_custkey as k from customer union all select c_custkey + 1000000 from customer), k as (select k, unnest({_positions_sql('k')}) as p from a) select k.k as custkey, bool_and(s.p is not null) as maybe from k left join s on s.p = k.p group by k.k")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the customers of all orders, asked for all customers and for as many keys that no customer has."""
    orders, keys = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    built = BloomFilter.build(orders, "o_custkey", _shape(orders, "o_custkey"))
    return built.contains(keys.union(keys.select(F.col("custkey") + 1000000)), "custkey")


_SETS_SQL = f"{_shape_sql('orders', 'o_custkey')}, " + ", ".join(f"s{n} as (select distinct unnest({_positions_sql('o_custkey')}) as p from orders where o_orderstatus {test} 'F')" for n, test in enumerate(("=", "<>")))


@register("bloom_union_intersection", f"with {_SETS_SQL}, u as (select p from s0 union select p from s1), i as (select p from s0 intersect select p from s1), n as (select 'union' as kind, count(*) as bits_set from u union all select 'intersection', count(*) from i) select kind, bits_set, round(-bits / {HASHES}.0 * ln(1 - bits_set / bits::double), 6) as approximate_size, (bits // 8)::int as size_in_bytes from n, shape")
def bloom_union_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of finished orders, and of the others."""
    orders = load(spark, sf_dir, "orders")
    shape = _shape(orders, "o_custkey")
    a, b = (BloomFilter.build(orders.where(f"o_orderstatus {test} 'F'"), "o_custkey", shape) for test in ("=", "<>"))
    row = lambda f, kind: f.statistics().select(F.lit(kind).alias("kind"), "bits_set", F.round("approximate_size", 6).alias("approximate_size"), "size_in_bytes")
    return row(a.union(b), "union").union(row(a.intersection(b), "intersection"))


@register("counting_bloom", f"with {_shape_sql('orders', 'o_custkey')}, p as (select unnest({_positions_sql('o_custkey')}) as p from orders), c as (select p, least(count(*), 15) as n from p group by p), k as (select c_custkey, unnest({_positions_sql('c_custkey')}) as p from customer) select c_custkey, min(coalesce(n, 0)) as at_most from k left join c using (p) group by c_custkey")
def counting_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders each customer has at most; counters end at 15."""
    orders = load(spark, sf_dir, "orders")
    built = CountingBloomFilter.build(orders, "o_custkey", _shape(orders, "o_custkey"), 4)
    return built.count(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


_SIZES = [(n, p) for n in (1, 10, 1000, 123_456, 10_000_000) for p in (0.5, 0.1, 0.01, 0.0001)]


@register("bloom_sizes", f"with c(n, p) as (values {', '.join(map(str, _SIZES))}), m as (select n::bigint as n, p::double as p, ceil(-n * ln(p::double) / pow(ln(2), 2))::bigint as bits from c), k as (select *, greatest(1, round(ln(2) * bits / n))::int as hashes, pow(2, greatest(6, ceil(log2(bits))))::bigint as rounded from m) select n, p, bits, hashes, rounded, round(pow(1 - pow(1 - 1.0::double / rounded, hashes * n), hashes), 9) as rate from k")
def bloom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits and hashes for a number of elements and a rate, the bits that are used, and the rate with these."""
    rows = [(n, p, *optimal_size(n, p), (shape := BloomShape.for_elements(n, p)).bits, round(shape.false_positive_rate(n), 9)) for n, p in _SIZES]
    return spark.createDataFrame(rows, "n long, p double, bits long, hashes int, rounded long, rate double")


@register("xorshift_numbers", "with recursive g(i, x, y, z, w) as (select 0::bigint, 123456789::bigint, 362436069::bigint, 521288629::bigint, 88675123::bigint union all select i + 1, y, z, w, xor(xor(w, w >> 19), xor(t, t >> 8)) & 4294967295 from (select i, y, z, w, xor(x, (x << 11) & 4294967295) as t from g where i < 1000)) select i as nth, (case when w >= 2147483648 then w - 4294967296 else w end)::bigint as number from g where i > 0")
def xorshift_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand numbers of the xorshift generator."""
    g = Xorshift128()
    return spark.createDataFrame([(i, g.next_int()) for i in range(1, 1001)], "nth long, number long")


@register("seen_before", "select event_id, user_id, row_number() over (partition by user_id order by event_id) > 1 as seen from events")
def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_before(load(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")


TERMS_SQL = "with t as materialized (select doc_id, w, count(*) as f from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as w from documents) group by all)"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(split).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("f"))


@register("document_frequency", f"{TERMS_SQL} select w, count(*) as df from t group by w")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.document_frequency(terms(spark, sf_dir), "doc_id", "w")


@register("vector_sum", f"{TERMS_SQL} select w, sum(f)::bigint as total from t group by w")
def vector_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.vector_sum(terms(spark, sf_dir), "w", "f")


@register("tf_scalings", f"{TERMS_SQL} select doc_id, w, 1.0::double as tf_boolean, round(1 + ln(f), 6) as tf_log, round(0.5 + 0.5 * f / max(f) over (partition by doc_id), 6) as tf_augmented from t")
def tf_scalings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = terms(spark, sf_dir)
    for scaling in ("boolean", "log", "augmented"):
        out = fq.scaled_frequency(out, "doc_id", scaling=scaling).withColumn(f"tf_{scaling}", F.round("tf", 6)).drop("tf")
    return out.drop("f")


@register("tfidf_terms", f"{TERMS_SQL}, d as (select w, count(*) as df from t group by w) select doc_id, w, round((1 + ln(f)) * ln((select count(distinct doc_id) from t) / df), 6) as tfidf from t join d using (w)")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.tf_idf(terms(spark, sf_dir), "doc_id", "w").select("doc_id", "w", F.round("tfidf", 6).alias("tfidf"))


HASHED = [0, 1, 17, 999]


@register("seeded_hashes", "select c_custkey, " + ", ".join(f"{seeded_hash_sql(s, 'c_custkey')} as h{s}, {seeded_hash_sql(s, '(-c_custkey)')} as m{s}" for s in HASHED) + " from customer")
def seeded_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select("c_custkey", *(c for s in HASHED for c in (seeded_hash(s, key).alias(f"h{s}"), seeded_hash(s, -key).alias(f"m{s}"))))


@register("bit_functions", "select o_orderkey, (o_orderkey >> 3) & 31 as bits, pow(2, ceil(log2(greatest(o_orderkey, 1))))::bigint as power, o_custkey as high, -o_orderkey as low from orders")
def bit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits 3 to 7, the next power of two, and a pair packed and unpacked again."""
    packed = pack_pair(F.col("o_custkey"), -F.col("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", bit_slice(F.array("o_orderkey"), 3, 5).alias("bits"), higher_power_of_two(F.col("o_orderkey")).alias("power"), unpack_high(packed).alias("high"), unpack_low(packed).alias("low"))


@register("sort_numbers", "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders")
def sort_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.with_place(load(spark, sf_dir, "orders"), F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "place")


@register("sort_strings", "select c_custkey, row_number() over (order by c_mktsegment, c_name) - 1 as place from customer")
def sort_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.with_place(load(spark, sf_dir, "customer"), F.col("c_mktsegment"), F.col("c_name")).select("c_custkey", "place")


@register("sort_reversed", "select p_partkey, row_number() over (order by p_name desc, p_partkey desc) - 1 as place from part")
def sort_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.with_place(load(spark, sf_dir, "part"), F.col("p_name"), F.col("p_partkey"), descending=True).select("p_partkey", "place")


@register("sort_bytes", "select c_custkey, row_number() over (order by encode(c_name || chr((200 + c_custkey % 20)::int)), c_custkey) - 1 as place from customer")
def sort_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.expr("decode(unhex(concat('C3', hex(128 + (8 + c_custkey % 20)))), 'UTF-8')")).cast("binary")
    return sorting.with_place(load(spark, sf_dir, "customer").withColumn("b", name), F.col("b"), F.col("c_custkey")).select("c_custkey", "place")


@register("sort_signed_bytes", "with b as (select c_custkey, encode(c_name || chr((192 + c_custkey % 60)::int)) as b from customer), l as (select c_custkey, list_transform(range(0, octet_length(b)), lambda i: (('0x' || substr(hex(b), 2 * i::int + 1, 2))::int + 128) % 256) as a from b) select c_custkey, row_number() over (order by a, c_custkey) - 1 as place from l")
def sort_signed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary values by signed bytes: those above 127 come first."""
    rows = load(spark, sf_dir, "customer").withColumn("b", F.concat("c_name", F.expr("char(192 + c_custkey % 60)")).cast("binary"))
    return sorting.with_place(rows, sorting.signed_bytes(F.col("b")), F.col("c_custkey")).select("c_custkey", "place")


@register("sort_stable", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_orderkey limit 500")
def sort_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority; rows of one priority stay in the order of their keys. The first 500."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return sorting.sorted_by(rows, F.col("o_orderpriority"), stable=F.col("o_orderkey")).limit(500)


@register("sort_nulls_first", "select p_partkey, row_number() over (order by case when p_size % 5 > 0 then p_size end nulls first, p_partkey) - 1 as place from part")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.with_place(load(spark, sf_dir, "part"), F.expr("case when p_size % 5 > 0 then p_size end"), F.col("p_partkey")).select("p_partkey", "place")


@register("sort_tagged_union", "select p_partkey, row_number() over (order by p_size % 2, case when p_size % 2 = 0 then p_size end, case when p_size % 2 = 1 then p_type end, p_partkey) - 1 as place from part")
def sort_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers before strings."""
    key = sorting.either(F.expr("p_size % 2"), F.expr("case when p_size % 2 = 0 then p_size end"), F.expr("case when p_size % 2 = 1 then p_type end"))
    return sorting.with_place(load(spark, sf_dir, "part"), key, F.col("p_partkey")).select("p_partkey", "place")


@register("sort_arrays", "with b as (select l_orderkey, list_sort(list(distinct l_partkey)) as a from lineitem group by l_orderkey) select l_orderkey, row_number() over (order by a, l_orderkey) - 1 as place from b")
def sort_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("a"))
    return sorting.with_place(sets, F.col("a"), F.col("l_orderkey")).select("l_orderkey", "place")


@register("balanced_ranges", "with c as (select l_suppkey as user, count(*) as n from lineitem group by l_suppkey), s as (select *, sum(n) over (order by user) - n as before, sum(n) over () as total from c) select user, n, least(floor(before * 4 / total), 3)::int as part from s")
def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.balanced_ranges(load(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "user"), "user", 4)


ALPHA, REGULARIZATION = 40.0, 0.1


def _als_sql(iterations: int) -> str:
    """``uN``, ``iN``: factors of users and items after each round, by Cramer's rule for two factors."""

    def half(name: str, mine: str, theirs: str, fixed: str) -> str:
        v = ("v0", "v1")
        gram = ", ".join(f"sum(v{a} * v{b}) as g{a}{b}" for a, b in ((0, 0), (0, 1), (1, 1)))
        sums = ", ".join([*(f"sum({ALPHA} * r * f.v{a} * f.v{b}) as m{a}{b}" for a, b in ((0, 0), (0, 1), (1, 1))), *(f"sum((1 + {ALPHA} * r) * f.{x}) as r{a}" for a, x in enumerate(v))])
        p, q, s = f"(m00 + g00 + {REGULARIZATION})", "(m01 + g01)", f"(m11 + g11 + {REGULARIZATION})"
        return f"{name} as materialized (select id, (r0 * {s} - r1 * {q}) / ({p} * {s} - {q} * {q}) as v0, (r1 * {p} - r0 * {q}) / ({p} * {s} - {q} * {q}) as v1 from (select {mine} as id, {sums} from t join {fixed} f on f.id = t.{theirs} group by {mine}), (select {gram} from {fixed}))"

    code = lambda f: f"('0x' || substr(md5(item || '/0/{f}'), 1, 7))::bigint / 268435456.0::double * 0.2"
    steps = [f"i0 as materialized (select item as id, {code(0)} as v0, {code(1)} as v1 from (select distinct item from t))"]
    for n in range(iterations):
        steps += [half(f"u{n + 1}", '"user"', "item", f"i{n}"), half(f"i{n + 1}", "item", '"user"', f"u{n + 1}")]
    rows = " union all ".join(f"select '{side}' as side, id, round(v0, 4) as v0, round(v1, 4) as v1 from {t}{iterations}" for side, t in (("user", "u"), ("item", "i")))
    return ", ".join(steps) + f" {rows}"


_RATINGS_SQL = 't as materialized (select o_custkey as "user", l_partkey as item, {} as r from orders join lineitem on o_orderkey = l_orderkey group by all)'


def _factor_rows(sides: tuple[DataFrame, DataFrame], factors: int) -> DataFrame:
    users, items = (df.select(F.lit(side).alias("side"), "id", *(F.round(F.get("v", F.lit(k)), 4).alias(f"v{k}") for k in range(factors))) for side, df in zip(("user", "item"), sides))
    return users.union(items)


@register("als_factors", f"with {_RATINGS_SQL.format('count(*)::double')}, {_als_sql(2)}")
def als_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors after two rounds; ratings are numbers of orders."""
    return _factor_rows(factorization.als(ratings(spark, sf_dir), 2, ALPHA, REGULARIZATION, iterations=2), 2)


@register("als_unary", f"with {_RATINGS_SQL.format('1.0::double')}, {_als_sql(2)}")
def als_unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for what was ordered at all."""
    return _factor_rows(factorization.als_unary(ratings(spark, sf_dir), 2, alpha=ALPHA, regularization=REGULARIZATION, iterations=2), 2)


@register("funk_svd")
def funk_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: each step depends on the one before. tests/test_operators.py compares it with plain loops."""
    return _factor_rows(factorization.funk_svd(ratings(spark, sf_dir), 2, epochs=1, blocks=4), 2)
