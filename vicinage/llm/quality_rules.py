"""Quality rules: minimum-covariance-determinant outliers per language and source, on DataFrame operations only.

Every text gets base statistics by array functions within its row: nothing is exploded, so a text is never shuffled.
The statistics become a vector of four bounded, roughly symmetric features. Rows with equal language and source form
a cell, those of a language a pool, and all rows one more.

For each cell, pool and for all rows a robust centre and scatter are found from three starts: coordinatewise median and quartile range; plain mean and covariance; and mean and covariance of the half
that lies nearest by the first. From each, ``steps`` concentration steps take the ``support`` share of rows that lie nearest (Mahalanobis distance) and estimate mean and covariance
from them, which lowers the determinant; of the three results that with the least determinant counts. Quantiles come from histograms of fixed relative resolution (1/16 octave),
which are aggregated on both sides of the shuffle, so a cell with a third of all rows costs no more per task than
others; the support set is whole bins, that is at least ``support`` of the cell. After the steps the covariance is scaled for consistency. ``floor`` is added to the variances, so that a statistic that is
constant in most rows can't reject a row for a trifle: it is the spread below which differences don't matter.

A cell's estimate is mixed with its pool's as if that had ``prior`` rows more, and a pool's with that of all rows: small cells lean on their language, large ones hardly change, and no
size of a cell is a case of its own. A row is rejected if its squared distance exceeds ``cutoff``.

Defined results: a null or empty text has no words, fails the base rule and isn't kept. Null languages or sources form their own
cells. Rows with equal ids are judged one by one, as are repeated rows. An empty table gives an empty result.
Extra columns are ignored. Null ids are kept as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import WORD_SPLIT, load, table

FEATURES = ("x_words", "x_length", "x_symbols", "x_repeats")
#: Standard deviations below which a difference isn't worth a rejection.
FLOORS = (0.5, 0.15, 0.25, 0.6)
#: The 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.51
#: Consistency of the covariance of the nearest 75 % of four-dimensional normal rows.
SUPPORT, CONSISTENCY = 0.75, 1.59
STEPS, PRIOR = 4, 50
D = len(FEATURES)
PAIRS = [(j, i) for i in range(D) for j in range(i + 1)]


def base_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, lang, source`` and the statistics of every whole text."""
    kept = [F.col(id_column), *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source"))]
    text = docs.select(*kept, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    split = text.withColumn("w", F.filter(F.split("t", WORD_SPLIT), lambda x: x != ""))
    # The hash of the five words that start at each word; for the test of repeats order matters and place doesn't.
    shingled = split.withColumn("g", F.expr("if(size(w) < 6, cast(array() as array<bigint>), transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4))))"))
    counted = shingled.select(
        id_column,
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_SPLIT, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.expr(r"if(instr(t, '\n') = 0, 0, aggregate(array(filter(split(t, '\n'), x -> length(translate(x, ' \t\n\u000b\u000c\r', '')) > 0)), 0, (acc, x) -> acc + size(x) - size(array_distinct(x))))").cast("long").alias("n_dup_lines"),
        F.expr(r"length(t) - length(translate(t, '\n', '')) + 1").cast("long").alias("n_lines"),
        F.expr("if(size(array_distinct(g)) = size(g), cast(array() as array<bigint>), g)").alias("g"),
    )
    # Only texts with a repeat sort their windows; neighbours with equal hashes are repeats, and the places
    # of repeats in text order give the words they cover.
    return counted.withColumn(
        "n_repeat_words",
        F.expr("""
        if(size(g) = 0, 0L, aggregate(array(array_sort(transform(g, (h, i) -> named_struct('h', h, 'i', i)))), 0L, (none, s) ->
          aggregate(
            array_sort(filter(transform(s, (x, k) -> if(x.h = get(s, k - 1).h or x.h = get(s, k + 1).h, x.i, -1)), x -> x >= 0)),
            named_struct('n', 0L, 'e', 0),
            (acc, i) -> named_struct('n', acc.n + cast(i + 5 - greatest(acc.e, i) as bigint), 'e', i + 5),
            acc -> acc.n)))"""),
    ).drop("g")


def with_features(stats: DataFrame) -> DataFrame:
    """Logarithms bring long tails in; ratios make texts of different lengths comparable."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "x_words": F.round(F.log1p("n_words"), 9),
            "x_length": F.round(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), 9),
            "x_symbols": F.round(F.log1p(20 * F.col("n_symbols") / words), 9),
            "x_repeats": F.round(F.log1p(10 * F.col("n_repeat_words") / words) + F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), 9),
        }
    )


def with_cells(rows: DataFrame) -> DataFrame:
    """Adds ``cell``, language and source, and ``pool``, the language."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    return rows.withColumns({"cell": F.concat(part("lang"), F.lit("/"), part("source")), "pool": F.concat(part("lang"), F.lit("/*"))})


def _bin(x: Column) -> Column:
    return F.floor(16 * F.log2(F.greatest(x, F.lit(1e-6)))).cast("int")


def _quantile_bins(rows: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The lowest bin up to which at least ``share`` of the rows of each key lie."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    listed = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("total"))
    reached = f"aggregate(b, named_struct('n', 0L, 'bin', cast(null as int)), (acc, x) -> named_struct('n', acc.n + x.n, 'bin', if(acc.n < ceil({share} * total), x.bin, acc.bin)), acc -> acc.bin)"
    return listed.select(*keys, F.expr(reached).alias(name))


def _start(rows: DataFrame) -> DataFrame:
    """Median and quartile range of each feature as the first centre and diagonal scatter."""
    long = rows.select("cell", F.posexplode(F.array(*FEATURES)).alias("k", "x")).withColumn("bin", F.floor(F.col("x") * 64).cast("int"))
    counts = long.groupBy("cell", "k", "bin").agg(F.count("*").alias("n"))
    listed = counts.groupBy("cell", "k").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("total"))
    at = lambda q: F.expr(f"aggregate(b, named_struct('n', 0L, 'bin', cast(null as int)), (acc, x) -> named_struct('n', acc.n + x.n, 'bin', if(acc.n < ceil({q} * total), x.bin, acc.bin)), acc -> (acc.bin + 0.5D) / 64)")
    q = listed.select("cell", "k", at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))
    d = len(FEATURES)
    floors = [float(f * f) for f in FLOORS]
    return q.groupBy("cell").agg(
        *(F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"m{i}") for i in range(d)),
        *(F.max(F.when(F.col("k") == i, F.col("s") * F.col("s") + floors[i])).alias(f"c{i}{i}") for i in range(d)),
        *(F.lit(0.0).alias(f"c{j}{i}") for i in range(d) for j in range(i)),
    )


def _estimate(rows: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Mean and covariance by key from sums, with the floors on the diagonal."""
    sums = rows.groupBy(*keys).agg(*(F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)), *(F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{j}{i}") for j, i in PAIRS))
    return sums.select(
        *keys,
        *(f"m{i}" for i in range(D)),
        *((F.lit(scale) * (F.col(f"p{j}{i}") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{j}{i}") for j, i in PAIRS),
    )


def _factored(estimate: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance, entry by entry; ``l{j}{i}`` is row i, column j."""
    d = len(FEATURES)
    out = estimate
    for j in range(d):
        square = F.col(f"c{j}{j}")
        for k in range(j):
            square = square - F.col(f"l{k}{j}") * F.col(f"l{k}{j}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, d):
            value = F.col(f"c{j}{i}")
            for k in range(j):
                value = value - F.col(f"l{k}{i}") * F.col(f"l{k}{j}")
            below[f"l{j}{i}"] = value / F.col(f"l{j}{j}")
        if below:
            out = out.withColumns(below)
    return out


def _with_distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution, for each start that the estimate has."""
    d = len(FEATURES)
    start = ["start"] if "start" in estimate.columns else []
    out = rows.join(_factored(estimate).select("cell", *start, *(f"m{i}" for i in range(D)), *(f"l{j}{i}" for j, i in PAIRS)), "cell", "left")
    for i in range(d):
        value = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{j}{i}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(d))).select(*rows.columns, *start, "d2")


def _nearest(rows: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """The rows, or a few more, that make the share of each cell (and start) lying nearest."""
    keys = ["cell", *(["start"] if "start" in estimate.columns else [])]
    near = _with_distance(rows, estimate).withColumn("bin", _bin(F.col("d2")))
    return near.join(_quantile_bins(near, keys, share, "limit"), keys).where("bin <= limit")


def _mixed(own: DataFrame, other: DataFrame, prior: float) -> DataFrame:
    """The moments of ``own`` rows (``n``) and of ``prior`` rows of ``other``, joined on ``pool``, together."""
    w = F.col("n") / (F.col("n") + F.lit(float(prior)))
    theirs = other.select(F.col("cell").alias("pool"), *(F.col(c).alias(f"o_{c}") for c in (*(f"m{i}" for i in range(D)), *(f"c{j}{i}" for j, i in PAIRS))))
    apart = lambda i: F.col(f"m{i}") - F.col(f"o_m{i}")
    return own.join(theirs, "pool").select(
        "cell",
        *((w * F.col(f"m{i}") + (1 - w) * F.col(f"o_m{i}")).alias(f"m{i}") for i in range(D)),
        *((w * F.col(f"c{j}{i}") + (1 - w) * F.col(f"o_c{j}{i}") + w * (1 - w) * apart(i) * apart(j)).alias(f"c{j}{i}") for j, i in PAIRS),
    )


def robust_estimates(fitted: DataFrame, steps: int = STEPS, support: float = SUPPORT, consistency: float = CONSISTENCY) -> DataFrame:
    """``cell`` with mean and covariance: of three starts the result with the least determinant."""
    medians = table(_start(fitted), "mcd")
    starts = [medians, _estimate(fitted, ["cell"]), _estimate(_nearest(fitted, medians, 0.5), ["cell"])]
    columns = ["cell", "start", *(f"m{i}" for i in range(D)), *(f"c{j}{i}" for j, i in PAIRS)]
    estimate = reduce(DataFrame.union, (e.withColumn("start", F.lit(n)).select(columns) for n, e in enumerate(starts)))
    for step in range(steps):
        estimate = table(_estimate(_nearest(fitted, table(estimate, "mcd") if step == 0 else estimate, support), ["cell", "start"], consistency if step == steps - 1 else 1.0), "mcd")
    # Results of different starts are often one and the same: digits that sums in another order would change don't decide.
    size = F.round(sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0)), 6)
    best = _factored(estimate).groupBy("cell").agg(F.min_by(F.struct(*columns[2:]), F.struct(size.alias("size"), "start")).alias("e"))
    return best.select("cell", "e.*")


def robust_verdicts(stats: DataFrame, steps: int = STEPS, cutoff: float = CUTOFF, support: float = SUPPORT, consistency: float = CONSISTENCY, prior: float = PRIOR) -> DataFrame:
    """Adds ``base_failed``, ``d2`` and ``kept`` to the statistics, which are read once for each step."""
    rows = with_cells(with_features(stats))
    # Rows that fail the base rule can't be kept; they don't shape the estimates either.
    good = rows.where(~F.col("base_failed"))
    fitted = good.select(F.explode(F.array("cell", "pool", F.lit("*"))).alias("cell"), *FEATURES)
    found = table(robust_estimates(fitted, steps, support, consistency).join(fitted.groupBy("cell").agg(F.count("*").alias("n")), "cell"), "mcd")
    pools = _mixed(found.where("endswith(cell, '/*')").withColumn("pool", F.lit("*")), found.where("cell = '*'"), prior)
    cells = _mixed(found.join(good.select("cell", "pool").distinct(), "cell"), pools, prior)
    judged = _with_distance(rows, table(cells, "mcd"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: float) -> DataFrame:
    stats = table(base_statistics(docs, id_column, text_column), "stats")
    return robust_verdicts(stats, **options).select(
        id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance2")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).drop("distance2")


def _sql(steps: int = STEPS) -> str:
    """The whole rule in SQL, with the same starts, bins and number of steps."""
    d = range(D)
    means, moments = [f"m{i}" for i in d], [f"c{j}{i}" for j, i in PAIRS]
    part = lambda c: f"coalesce(length({c}) || ':' || {c}, '-')"
    xs = ", ".join(f"x{i}" for i in d)
    ctes = [
        r"""t as materialized (select doc_id, lang, source, coalesce(text, '') as t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
tt as materialized (select row_number() over () as rowid_, * from t),
g as (select rid, i, md5(array_to_string(w[i:i + 4], chr(10))) as g from (select rowid_ as rid, w, unnest(range(1, len(w) - 3)) as i from tt)),
r as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) as j from (select rid, i, count(*) over (partition by rid, g) as k from g) where k > 1) group by rid),
l as (select rowid_, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, len(string_split(t, chr(10))) as n_lines from tt),
s as materialized (select doc_id, lang, source, tt.rowid_ as rid, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_lines, coalesce(n, 0) as n_repeat_words from tt join l on l.rowid_ = tt.rowid_ left join r on r.rid = tt.rowid_),
x as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, round(ln(1 + n_words::double), 9) as x0, round(ln(greatest(word_chars, 1) / greatest(n_words, 1)), 9) as x1, round(ln(1 + 20 * n_symbols / greatest(n_words, 1)), 9) as x2, round(ln(1 + 10 * n_repeat_words / greatest(n_words, 1)) + ln(1 + 10 * n_dup_lines / greatest(n_lines, 1)), 9) as x3 from s)""",
        f"rows as materialized (select *, {part('lang')} || '/' || {part('source')} as cell, {part('lang')} || '/*' as pool from x)",
        "fitted as materialized (" + " union all ".join(f"select {c} as cell, {xs} from rows where not base_failed" for c in ("cell", "pool", "'*'")) + ")",
        "b0 as (" + " union all ".join(f"select cell, {i} as k, floor(x{i} * 64)::int as bin, count(*) as n from fitted group by all" for i in d) + ")",
        "b1 as (select *, sum(n) over (partition by cell, k order by bin) as upto, sum(n) over (partition by cell, k) as total from b0)",
        "b2 as (select cell, k, " + ", ".join(f"(min(bin) filter (upto >= ceil({q} * total)) + 0.5) / 64 as {n}" for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + " from b1 group by cell, k)",
        "s0 as materialized (select cell, 0 as start, " + ", ".join(f"max(q2) filter (k = {i}) as m{i}" for i in d) + ", " + ", ".join(f"max(pow((q3 - q1) / 1.349, 2) + {FLOORS[i] ** 2!r}) filter (k = {i}) as c{i}{i}" if i == j else f"0.0::double as c{j}{i}" for j, i in PAIRS) + " from b2 group by cell)",
    ]

    def factor(estimate: str, name: str) -> str:
        last = estimate
        for j in d:
            own = f"sqrt(greatest(c{j}{j}" + "".join(f" - l{k}{j} * l{k}{j}" for k in range(j)) + ", 1e-12))"
            ctes.append(f"{name}f{j} as (select *, {own} as l{j}{j} from {last})")
            below = ", ".join(f"(c{j}{i}" + "".join(f" - l{k}{i} * l{k}{j}" for k in range(j)) + f") / l{j}{j} as l{j}{i}" for i in d if i > j)
            last = f"{name}f{j}"
            if below:
                ctes.append(f"{name}g{j} as (select *, {below} from {last})")
                last = f"{name}g{j}"
        return last

    def distances(estimate: str, rows: str, name: str) -> None:
        kept = [*means, *(f"l{j}{i}" for j, i in PAIRS)]
        ctes.append(f"{name}h as (select r.*, e.start, {', '.join(f'e.{c}' for c in kept)} from {rows} r left join {factor(estimate, name)} e on r.cell = e.cell)")
        last = f"{name}h"
        for i in d:
            ctes.append(f"{name}z{i} as (select *, (x{i} - m{i}" + "".join(f" - l{j}{i} * z{j}" for j in range(i)) + f") / l{i}{i} as z{i} from {last})")
            last = f"{name}z{i}"
        ctes.append(f"{name} as materialized (select * exclude ({', '.join(kept)}), {' + '.join(f'z{i} * z{i}' for i in d)} as d2 from {last})")

    def estimate(name: str, rows: str, start: str, scale: float = 1.0) -> None:
        own = ", ".join([*(f"avg(x{i}) as m{i}" for i in d), *(f"{scale} * (avg(x{i} * x{j}) - avg(x{i}) * avg(x{j})){f' + {FLOORS[i] ** 2!r}' if i == j else ''} as c{j}{i}" for j, i in PAIRS)])
        ctes.append(f"{name} as materialized (select cell, {start} as start, {own} from {rows} group by all)")

    def nearest(estimate: str, share: float, name: str) -> None:
        distances(estimate, "fitted", f"{name}n")
        ctes.append(f"{name}o as materialized (select cell, start, {xs}, floor(16 * log2(greatest(d2, 1e-6)))::int as bin from {name}n)")
        ctes.append(f"{name}p as (select cell, start, bin, sum(count(*)) over (partition by cell, start order by bin) as upto, sum(count(*)) over (partition by cell, start) as total from {name}o group by cell, start, bin)")
        ctes.append(f"{name}q as (select cell, start, min(bin) as top from {name}p where upto >= ceil({share} * total) group by cell, start)")
        ctes.append(f"{name} as (select o.* from {name}o o join {name}q q on o.cell = q.cell and o.start = q.start and o.bin <= q.top)")

    estimate("s1", "fitted", "1")
    nearest("s0", 0.5, "half")
    estimate("s2", "half", "2")
    ctes.append("e0 as materialized (" + " union all ".join(f"select cell, start, {', '.join(means + moments)} from s{n}" for n in range(3)) + ")")
    for step in range(steps):
        nearest(f"e{step}", SUPPORT, f"t{step}")
        estimate(f"e{step + 1}", f"t{step}", "start", CONSISTENCY if step == steps - 1 else 1.0)
    size = "round(" + " + ".join(f"2 * ln(l{i}{i})" for i in d) + ", 6)"
    ctes.append(f"ranked as (select *, row_number() over (partition by cell order by {size}, start) as nth from {factor(f'e{steps}', 'last')})")
    ctes.append(f"found as materialized (select r.*, n from ranked r join (select cell, count(*) as n from fitted group by cell) c on c.cell = r.cell where nth = 1)")

    def mixed(name: str, own: str, other: str) -> None:
        w = f"(o.n / (o.n + {PRIOR}.0::double))"
        parts = [*(f"{w} * o.m{i} + (1 - {w}) * p.m{i} as m{i}" for i in d), *(f"{w} * o.c{j}{i} + (1 - {w}) * p.c{j}{i} + {w} * (1 - {w}) * (o.m{i} - p.m{i}) * (o.m{j} - p.m{j}) as c{j}{i}" for j, i in PAIRS)]
        ctes.append(f"{name} as materialized (select o.cell, 0 as start, {', '.join(parts)} from ({own}) o join {other} p on p.cell = o.pool)")

    mixed("pools", "select *, '*' as pool from found where ends_with(cell, '/*')", "found")
    mixed("cells", "select f.*, r.pool from found f join (select distinct cell, pool from rows) r on r.cell = f.cell", "pools")
    distances("cells", "rows", "judged")
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2, 0) <= {CUTOFF} as kept from judged"


SQL = _sql()
