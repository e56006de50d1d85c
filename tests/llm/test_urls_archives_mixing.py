import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vicinage.llm import source_mixing, url_filter, warc

PAGES = "page_id long, url string, html string, host string, verdict string, rule string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)


def judged(url, rules):
    rest = (url or "").split("://", 1)
    if len(rest) < 2:
        return "", "", None, "allow"
    rest = rest[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls_match_brute_force(pages):
    rng = random.Random(1)
    labels = ["net", "org", "com", "example", "a", "b", "", "net-x", "EXAMPLE", "é", "com:80", "u@net"]
    parts = ["en", "de", "fr", "", "x y", "é"]
    url = lambda: rng.choice(["http", "ftp", ""]) + rng.choice(["://", "://", ":", ""]) + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + "".join("/" + rng.choice(parts) for _ in range(rng.randrange(4))) + rng.choice(["", "?q=/en/", "#f", "?a#b", "\n/z"])
    rows = [(i, url(), "") for i in range(800)] + [(900, None, None), (901, "", ""), (902, "://", ""), (903, "x://y://net/", ""), (904, "http://net/", ""), (904, "http://net/", ""), (None, "http://net/", "")]
    nested = [("net", "/", "block"), ("example.net", "/", "allow"), ("a.example.net", "/", "block"), ("b.a.example.net", "/en", "allow"), ("com", "/", "block"), ("example.com", "/de/", "allow"), ("é", "/", "block"), ("", "/", "block")]
    more = [(".".join(rng.choice(labels[:5] + labels[7:]) or "x" for _ in range(rng.randrange(1, 4))), f"/{p}", rng.choice(["allow", "block"])) for p in ("", "en", "de", "e") for _ in range(40)]
    more = [(h.lower(), p, a) for h, p, a in more if all(h.split("."))]
    for rules, options in ((url_filter.RULES, {}), (nested[:-1], {}), (more, {}), (more, {"max_rules": 30}), ([], {})):
        last = list({(h, p): (h, p, a) for h, p, a in rules}.values())
        got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in url_filter.filter_urls(pages(rows), rules, lanes=3, **options).collect())
        assert got == sorted(str((i, *judged(u, last))) for i, u, _ in rows)
    assert url_filter.filter_urls(pages([])).count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages(rows), nested)


def test_many_nested_rules(pages, monkeypatch):
    monkeypatch.setattr(url_filter, "SPAN", 16)
    rules = [("net", "/", "block")] + [(f"h{i}.net", "/", "allow") for i in range(300)] + [(f"a.h{i}.net", f"/{j}", "block") for i in range(0, 300, 3) for j in range(3)]
    rows = [(i, f"http://{'a.' * (i % 3)}h{i % 301}.net/{i % 4}", "") for i in range(900)]
    got = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in url_filter.filter_urls(pages(rows), rules, lanes=2).collect())
    assert got == sorted(str((i, *judged(u, rules))) for i, u, _ in rows)


def test_archives_round_trip(pages):
    rng = random.Random(2)
    bodies = ["<p>" + "x" * rng.randrange(50, 400) for _ in range(20)] + ["é" * 50, "é" * 49, "", None, "\r\n\r\n" * 30, "y" * 99, "y" * 100]
    rows = [(i * 3 % 907, f"http://{rng.choice('abc')}.example.org:80/{rng.randrange(40)}", rng.choice(bodies)) for i in range(500)]
    rows += [(2000 + i, "http://hot.example.org/", bodies[0]) for i in range(300)] + [(3000, None, "z" * 200), (3001, "no scheme\n x", "z" * 200), (None, "u", "v"), (3002, "http://long/", "w" * 300000)]
    got = warc.capture_histories(pages(rows), archive_bytes=3000, fan_in=4, cut_every=8).orderBy("merge_range", "merge_place").collect()
    rows += [(7777, "http://a/", bodies[0]), (7777, "http://a/", bodies[1]), (7777, "http://a/", bodies[1]), (7777, "http://b/", "only twice" * 30), (7777, "http://b/", "only twice" * 30)]
    got = warc.capture_histories(pages(rows), archive_bytes=3000, fan_in=4, cut_every=8, range_rows=150).orderBy("merge_range", "merge_place").collect()
    first, want = {}, []
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        body = (html or "").encode()
        least = first.setdefault(body, i) if len(body) >= 100 else i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if least == i else "revisit", None if least == i else least))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys) and ("org,example,hot)/" in {k[0] for k in keys}) and len({r.merge_range for r in got}) > 4
    placed = warc.with_global_place(warc.capture_histories(pages(rows))).orderBy("place").collect()
    assert [r.place for r in placed] == list(range(len(want))) and [(r.url_key, r.captured, r.page_id) for r in placed] == keys
    assert warc.capture_histories(pages([])).count() == 0


def test_ranges_read_only_what_overlaps(tmp_path):
    fs, root = warc.file_system(f"file://{tmp_path}")
    rows = [("org,hot)/", f"2024-01-01T{h:02}", i, 0, "", "response", None) for h in range(20) for i in range(1000)]
    n, cuts, first, last = warc.write_run(fs, f"{root}/r", iter(rows), cut_every=4)
    assert n == 20000 and len(cuts) <= warc.MOST_CUTS and (first, last) == (rows[0][:3], rows[-1][:3]) and all(a < b for a, b in zip(cuts, cuts[1:]))
    file = warc.pq.ParquetFile(f"{root}/r")
    bounds = [warc.group_bounds(file.metadata.row_group(g)) for g in range(file.metadata.num_row_groups)]
    assert len(bounds) == 10 and all(len(least) >= 2 for least, _ in bounds), "within one url time decides"
    low, high = rows[7000][:3], rows[7100][:3]
    assert list(warc.run_rows(fs, f"{root}/r", low, high)) == rows[7000:7100]


def test_records_and_members():
    import io

    body = "<html>é\r\n\r\n</html>".encode() * 30
    data = warc.record(7, "http://x/ y", body, None) + warc.record(8, None, body, 7)
    (row, payload), (again, nothing) = (warc.parse(m) for m in warc.members(io.BytesIO(data), step=17))
    assert payload == body and nothing is None
    assert row[2:] == (7, len(body), hashlib.sha256(body).hexdigest(), "response", None) and again[2:] == (8, len(body), row[4], "revisit", 7)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-9])))
    whole = next(warc.members(io.BytesIO(data)))
    with pytest.raises(ValueError):
        warc.parse(whole.replace("é".encode(), "è".encode()))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((rng.choice("ab"), rng.choice("xy"), rng.randrange(9), n) for n in range(rng.randrange(12))) for _ in range(k)]
    runs = [sorted(r, key=lambda x: x[:3]) for r in runs]
    merged = list(warc.LoserTree([iter(r) for r in runs]))
    assert [m[:3] for m in merged] == sorted(m[:3] for r in runs for m in r) and Counter(merged) == Counter(m for r in runs for m in r)


def corpus(make_docs, sizes):
    rng = random.Random(3)
    rows, n = None, 0
    for source, total in sizes.items():
        part, left = [], total
        while left > 0:
            w = min(left, rng.randrange(1, 60))
            part.append((n, "w " * w))
            left -= w
            n += 1
        df = make_docs(part, source=source)
        rows = df if rows is None else rows.union(df)
    return rows


def test_weights_meet_the_target(make_docs):
    sizes = {"big": 9000, "middle": 2000, None: 500, "small": 120}
    docs = corpus(make_docs, sizes)
    got = source_mixing.mix(docs, entropy=0.9, repetition=None, block_tokens=200).collect()
    read = Counter()
    for r in got:
        read[r.source] += r.n_tokens
    total = sum(sizes.values())
    weights = {s: n / total for s, n in read.items()}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert entropy == pytest.approx(0.9 * math.log(4), abs=0.03)
    assert sum(read.values()) == pytest.approx(total, rel=0.03)
    for source, size in sizes.items():
        copies = Counter(r.doc_id for r in got if r.source == source)
        assert max(copies.values()) - min(copies[d] if d in copies else 0 for d in copies) <= 1
        starts = sorted((r.start, r.n_tokens) for r in got if r.source == source)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])), "a source's stream has no gaps"
    # Reading by place mixes sources in their weights from the start.
    head = Counter()
    for r in sorted(got, key=lambda r: r["at"])[: len(got) // 4]:
        head[r.source] += r.n_tokens
    assert all(head[s] / sum(head.values()) == pytest.approx(weights[s], abs=0.08) for s in sizes)


def test_repetition_limit_wins(make_docs):
    docs = corpus(make_docs, {"big": 9000, "small": 100})
    got = source_mixing.mix(docs, entropy=1.0, repetition=3.0, block_tokens=100).collect()
    small = sum(r.n_tokens for r in got if r.source == "small")
    assert small == pytest.approx(300, abs=60)
    passes = sorted({r["pass"] for r in got if r.source == "small"})
    orders = [[r.doc_id for r in sorted(got, key=lambda r: r.start) if r.source == "small" and r["pass"] == p] for p in passes[:2]]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


def test_shelves_and_limits(make_docs, monkeypatch):
    monkeypatch.setattr(source_mixing, "SHELF", 5)
    got = source_mixing.mix(corpus(make_docs, {"big": 9000, "small": 700}), entropy=0.99, repetition=None, block_tokens=100).collect()
    for source in ("big", "small"):
        starts = sorted((r.start, r.n_tokens) for r in got if r.source == source)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])), "no gaps"
        blocks = [r.block for r in sorted(got, key=lambda r: r.start) if r.source == source and r["pass"] == 0]
        runs = [b // 5 for i, b in enumerate(blocks) if i == 0 or b // 5 != blocks[i - 1] // 5]
        assert len(runs) == len(set(runs)) and (source == "small" or len(runs) > 5 and runs != sorted(runs)), "a shelf at a time"
    with pytest.raises(ValueError):
        source_mixing.mix(make_docs([(1, "a b")]), budget=9, repetition=4.0)
    assert source_mixing.mix(make_docs([(1, "a b")]), budget=9, repetition=None).count() == 5


def test_mixing_edges(make_docs):
    assert source_mixing.mix(make_docs([])).count() == 0
    assert source_mixing.mix(make_docs([(1, None), (2, " ")])).count() == 0
    one = source_mixing.mix(make_docs([(1, "a b"), (1, "a b"), (2, None), (None, "c")])).collect()
    assert sorted(r.doc_id for r in one if r.n_tokens) == [1, 1]
    assert "at" in source_mixing.mix(make_docs([(1, "a")]).withColumn("at", F.lit(1)).withColumn("tokens", F.lit(1))).columns
