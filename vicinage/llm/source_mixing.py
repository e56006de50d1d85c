"""Mixing sources to target weights: temperature by bisection, weights realised as budgeted block permutations.

A source's share p of all tokens becomes p**a, normalised. The exponent a is found by bisection: the entropy of the weights falls
as a grows, so a target entropy (a share of the logarithm of the number of sources) fixes it; a limit on repetition (weight times budget over
the source's own tokens, which falls as a nears 1) bounds it from below and wins if both can't be met. A budget of more than ``repetition`` times all tokens can't keep the limit: it is an error. One Spark job
evaluates 63 exponents, all the midpoints that six steps of bisection may visit, so 30 steps take five jobs and no
table of sources is brought to the driver.

The budget of a source is its weight times the token budget. Its documents fall in blocks by the hash of their id, of about
``block_tokens`` tokens; ``SHELF`` blocks in a row are a shelf. Every pass over a source takes its shelves in a new pseudo-random order, in a shelf the blocks in a new order, and
within a block documents, until the budget is used up: whole passes take all, the last pass takes what starts
before the budget's end. ``at`` is the place in the source's stream as a share of its budget; reading rows by ``at`` mixes
sources in their weights from the first row to the last.

Skew: a hot source is spread over its blocks, and places are sums over shelves, then over blocks of a shelf, then over documents of a block: only the shelves of a source (one for some
268 million tokens), the blocks of a shelf or the documents of one block are ever sorted together. Texts aren't shuffled.

Defined results: null sources are one source. Null, empty and wordless texts count 0 tokens: they are part of every whole pass, and of the last
pass where they start before the budget's end. A source without tokens has weight 0 and no rows. Rows with a null id are left out.
Repeated rows are taken as separate documents, ties in the order of blocks or documents go to the smaller hash,
then id. An empty table, or one without tokens, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import ids, load, table

ENTROPY, REPETITION, BLOCK_TOKENS, SHELF, SEED = 0.97, 4.0, 65536, 4096, 17
JOBS, LEVELS, HIGHEST = 5, 6, 4.0


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(*parts: Column) -> Column:
    """A non-negative 60-bit hash, the same in SQL: the first 15 hexadecimal digits of MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def source_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _evaluate(sources: DataFrame, exponents: list[float], total: int, budget: int) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights and the largest repetition."""
    at = F.explode(F.array(*map(F.lit, exponents))).alias("a")
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.col("a"))
    sums = (
        sources.where("tokens > 0")
        .select("tokens", at)
        .withColumn("q", power)
        .groupBy("a")
        .agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.max(F.col("q") / F.col("tokens")).alias("r"))
        .collect()
    )
    return {row.a: (_log(row.z) - row.s / row.z, row.r / row.z * budget) for row in sums}


def _log(x: float) -> float:
    from math import log

    return log(x)


def bisect(sources: DataFrame, fits, low: float, high: float, total: int, budget: int) -> float:
    """The largest exponent, to 30 binary places of the interval, up to which ``fits(entropy, repetition)`` holds."""
    for _ in range(JOBS):
        step = (high - low) / (1 << LEVELS)
        grid = [low + step * i for i in range(1, 1 << LEVELS)]
        values = _evaluate(sources, grid, total, budget)
        a, b = 0, 1 << LEVELS
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (middle, b) if fits(*values[grid[middle - 1]]) else (a, middle)
        low, high = low + step * a, low + step * b
    return low


def exponent(sources: DataFrame, total: int, n_sources: int, budget: int, entropy: float | None = ENTROPY, repetition: float | None = REPETITION) -> float:
    """Rounded to nine digits, so that the order of summation doesn't show."""
    if n_sources < 2:
        return 1.0
    a = 1.0
    if entropy is not None:
        target = entropy * _log(n_sources)
        a = bisect(sources, lambda h, r: h >= target, 0.0, HIGHEST, total, budget)
    if repetition is not None:
        # At a = 1 each source is repeated budget / total times; below, small sources are repeated more.
        least = bisect(sources, lambda h, r: r > repetition, 0.0, 1.0, total, budget)
        if _evaluate(sources, [0.0], total, budget)[0.0][1] > repetition:
            a = max(a, least)
    return round(a, 9)


def mix(
    docs: DataFrame, budget: int | None = None, entropy: float | None = ENTROPY, repetition: float | None = REPETITION, block_tokens: int = BLOCK_TOKENS, seed: int = SEED
) -> DataFrame:
    """One row for each time a document is read: ``doc_id, source, n_tokens, pass, block, start, at``."""
    spark = docs.sparkSession
    counted = table(ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), source_name(F.col("source")).alias("name"), n_tokens(F.col("text").cast("string")).alias("n_tokens")), "counted")
    sources = table(counted.groupBy("name").agg(F.sum("n_tokens").alias("tokens")), "sources")
    row = sources.agg(F.sum("tokens").alias("total"), F.count(F.when(F.col("tokens") > 0, 1)).alias("n")).first()
    total = row.total or 0
    budget = total if budget is None else budget
    if not total:
        return counted.select("doc_id", "source", "n_tokens", F.lit(0).alias("pass"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("at")).where("false")
    if repetition is not None and budget > repetition * total:
        raise ValueError(f"a budget of {budget} tokens reads some of {total} more than {repetition} times")
    a = exponent(sources, total, row.n, budget, entropy, repetition)
    # Weights are whole billionths: budgets then don't depend on the order of summation.
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = sources.where("tokens > 0").agg(F.sum(power)).first()[0]
    planned = sources.where("tokens > 0").select(
        "name", "tokens", F.floor(F.round(power / F.lit(z) * 1e9).cast("long").cast("decimal(38,0)") * F.lit(budget).cast("decimal(38,0)") / 10**9).cast("long").alias("budget"),
        F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("int").alias("blocks"),
    ).withColumns({"whole": F.expr("budget div tokens"), "rest": F.expr("budget % tokens")})
    plan = table(planned, "plan")
    blocked = counted.join(plan.select("name", "blocks"), "name").withColumn("block", F.pmod(digest(F.lit(seed), F.col("doc_id")), F.col("blocks")).cast("int"))
    blocked = table(blocked.select("doc_id", "source", "name", "n_tokens", "block"), "blocked")
    sizes = blocked.groupBy("name", "block").agg(F.sum("n_tokens").alias("size"))
    passes = plan.withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("whole - if(rest = 0, 1, 0)").cast("int")))).where("budget > 0")
    shelved = sizes.withColumn("shelf", F.expr(f"block div {SHELF}"))
    shelves = shelved.groupBy("name", "shelf").agg(F.sum("size").alias("shelf_size")).join(passes, "name")
    by_shelf = Window.partitionBy("name", "pass").orderBy(digest(F.lit(seed), F.col("name"), F.col("pass"), F.lit("shelf"), F.col("shelf")), "shelf")
    # Upper bounds on what the last pass can reach: later shelves and blocks aren't joined with what is in them.
    reached = shelves.withColumn("shelf_start", F.sum("shelf_size").over(by_shelf) - F.col("shelf_size")).where("pass * tokens + shelf_start < budget")
    order = Window.partitionBy("name", "pass", "shelf").orderBy(digest(F.lit(seed), F.col("name"), F.col("pass"), F.col("block")), "block")
    starts = (
        shelved.join(reached, ["name", "shelf"])
        .withColumn("block_start", F.col("shelf_start") + F.sum("size").over(order) - F.col("size"))
        .where("pass * tokens + block_start < budget")
        .select("name", "block", "pass", "block_start", "tokens", "budget")
    )
    inner = Window.partitionBy("name", "block", "pass").orderBy(digest(F.lit(seed), F.col("pass"), F.col("doc_id")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocked.join(starts, ["name", "block"]).withColumn("start", F.col("pass") * F.col("tokens") + F.col("block_start") + F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    return placed.where("start < budget").select("doc_id", "source", "n_tokens", "pass", "block", "start", F.round(F.col("start") / F.col("budget"), 9).alias("at"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


_HEX = "cast(('0x' || substr(md5({}), 1, 15)) as bigint)"
SQL = rf"""
with recursive d as materialized (select doc_id, source, coalesce('=' || source, '-') as name, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as n_tokens from documents where doc_id is not null),
s as materialized (select name, cast(sum(n_tokens) as bigint) as tokens from d group by name),
g as materialized (select cast(sum(tokens) as bigint) as total, cast(count(*) filter (tokens > 0) as bigint) as n, list(tokens) filter (tokens > 0) as t from s),
h(i, lo, hi) as (select 0, 0.0::double, {HIGHEST}::double union all
  select i + 1, case when ok then (lo + hi) / 2 else lo end, case when ok then hi else (lo + hi) / 2 end from
  (select i, lo, hi, (select ln(list_sum(q)) - list_sum(list_transform(q, lambda x: x * ln(x))) / list_sum(q) >= {ENTROPY} * ln(n) from (select n, list_transform(t, lambda x: pow(x / total::double, (lo + hi) / 2)) as q from g)) as ok from h where i < {JOBS * LEVELS})),
r(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when ok then (lo + hi) / 2 else lo end, case when ok then hi else (lo + hi) / 2 end from
  (select i, lo, hi, (select list_max(list_transform(t, lambda x: pow(x / total::double, (lo + hi) / 2) / x)) / list_sum(list_transform(t, lambda x: pow(x / total::double, (lo + hi) / 2))) * total > {REPETITION} from g) as ok from r where i < {JOBS * LEVELS})),
a as materialized (select case when n < 2 then 1.0::double else round(greatest((select lo from h order by i desc limit 1), case when list_max(list_transform(t, lambda x: 1.0 / x)) / n * total > {REPETITION} then (select lo from r order by i desc limit 1) else 0 end), 9) end as a from g),
w as (select name, tokens, pow(tokens / total::double, a) as q, total from s, g, a where tokens > 0),
p as materialized (select name, tokens, cast(floor(cast(round(q / (select sum(q) from w) * 1e9) as hugeint) * total / 1000000000::hugeint) as bigint) as budget, cast(ceil(tokens / {BLOCK_TOKENS}.0) as bigint) as blocks from w),
b as materialized (select doc_id, source, name, n_tokens, cast({_HEX.format(f"'{SEED}/' || doc_id")} % blocks as int) as block from d join p using (name)),
z as (select name, block, cast(sum(n_tokens) as bigint) as size from b group by all),
x as (select *, unnest(range(0, budget // tokens + 1)) as pass from p where budget > 0),
o as (select name, block, pass, tokens, budget, cast(sum(size) over (partition by name, pass order by {_HEX.format(f"'{SEED}/' || name || '/' || pass || '/shelf/' || (block // {SHELF})")}, block // {SHELF}, {_HEX.format(f"'{SEED}/' || name || '/' || pass || '/' || block")}, block rows unbounded preceding) - size as bigint) as block_start from z join x using (name)),
f as (select doc_id, source, n_tokens, pass, block, budget, cast(pass * tokens + block_start + sum(n_tokens) over (partition by name, block, pass order by {_HEX.format(f"'{SEED}/' || pass || '/' || doc_id")}, doc_id, n_tokens rows unbounded preceding) - n_tokens as bigint) as start from b join o using (name, block))
select doc_id, source, n_tokens, cast(pass as int) as pass, block, start, round(start / budget::double, 9) as at from f where start < budget
"""
