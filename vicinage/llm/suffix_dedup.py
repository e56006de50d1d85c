"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte is removed if a ``length``-byte string that covers it starts earlier too: in a document with a smaller id, or
in the same one at an earlier place. Strings are judged on the input.

A suffix array of every byte would move the whole corpus a hundred times over, so suffixes are first sampled by content:
of the ``length`` - ``GRAM`` + 1 grams in a ``length``-byte window, the one with the least hash (leftmost on ties) is
the window's anchor. Equal windows have equal anchors at equal places, so no match is lost, and about one position
in 39 is an anchor. The windows with one anchor form its context.

1. ``anchors``: one Arrow pass over whole texts gives each anchor's hash and a hash of its context. Within a task, repeats of
   a context are settled at once (all but the first are removed), which also keeps a hot passage to one row a task.
2. ``settle``: sharded by the anchor's hash. Anchors that occur once hold no repeat. Of equal contexts all but the first are removed.
   Contexts that differ though their anchors agree go on, one of each kind.
3. ``resolve``: those contexts' bytes are fetched, sharded by the anchor's hash, and taken in document order in batches.
   ``IndexFamily`` builds a suffix array of each batch (windows in lexicographic order, to a depth of ``length`` bytes),
   merge-scans it against the arrays of all levels, marks the windows found there or earlier in the batch,
   and merges levels of equal size, so that each window is merged a logarithmic number of times.
4. Marked windows are merged to runs by document and cut out of the texts.

Hashes have 128 bits (anchor and context together) where they decide a removal; step 3 compares bytes. The number of shards follows the bytes of
the input. A phrase that stands in very many different contexts would put them all in one shard: such hot anchors are found beforehand in a
sample of the documents (one in ``SAMPLE_EVERY``, ``HOT`` contexts there), and each of their windows then is a shard of its own, by the hash of its bytes,
so they spread evenly and are settled in step 2. The sample only routes; results don't depend on it.

Defined results: null texts count as empty; texts shorter than ``length`` have no window and stay whole. Rows with a null id
are left out. Rows that repeat an id are one document: a string at the same place of two of them isn't earlier in either, so nothing goes from
a row that is merely repeated; one at an earlier place of another such row counts as earlier. An empty
table gives an empty result. Extra columns are ignored, or kept by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, mix64, prefix_hash, span_hash, text_blocks
from ._store import arrow_map, ids, load, partitions, table

LENGTH, GRAM = 100, 24
#: Places within a block are kept in the low bits of the hash that is minimised.
PLACE_BITS = 24
#: Bytes of texts looked at together, and of a piece of a longer text; a byte takes some 80 bytes of work.
BLOCK, LONGEST = 1 << 18, 1 << 19
#: Anchors of a task that are held to settle repeats within it.
HELD = 1 << 18
BATCH = 4096
#: Windows of a level that are spelled out at a time.
PIECE = 1 << 15
#: Rows of a shard's task, of a task that resolves, and what makes an anchor hot; at most so many are routed apart, the most frequent.
SHARD_ROWS, OPEN_ROWS = 1_000_000, 20_000
SAMPLE_EVERY, HOT, HOT_LISTED = 256, 64, 1 << 17
ANCHOR = "kind byte, shard long, context long, doc_id long, version long, at int, low int, high int"
ROW = ("doc", "version", "at", "low", "high")


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The anchors of a block of texts: text number, place of the anchor in its text, the first and last
    window start it stands for (relative to the anchor), and the hashes of anchor and context."""
    n = len(data)
    if n < length:
        return {k: np.zeros(0, t) for k, t in (("row", np.int64), ("at", np.int64), ("low", np.int64), ("high", np.int64), ("shard", np.uint64), ("context", np.uint64))}
    running = prefix_hash(data)
    grams = np.arange(n - gram + 1)
    hashes = span_hash(running, grams, grams + gram)
    place = U64((1 << PLACE_BITS) - 1)
    least = (hashes & ~place) | grams.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    windows = np.arange(len(rows)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    anchor = (least[windows] & place).astype(np.int64)
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    at, low, high, row = anchor[first], windows[first], windows[last], rows[first]
    context = span_hash(running, low, high + length) + mix64((at - low).astype(np.uint64))
    found = {"row": row, "at": at - offsets[row], "low": low - at, "high": high - at, "shard": hashes[at], "context": context}
    if hot is None or not len(hot):
        return found
    is_hot = hot[np.minimum(np.searchsorted(hot, found["shard"]), len(hot) - 1)] == found["shard"]
    if not is_hot.any():
        return found
    # Every window of a hot anchor for itself: its bytes' hash is the shard, the anchor and its place in the window the rest of the key.
    counts = (high - low + 1)[is_hot]
    which = np.repeat(np.flatnonzero(is_hot), counts)
    start = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    none = np.zeros(len(which), np.int64)
    own = {"row": row[which], "at": start - offsets[row[which]], "low": none, "high": none, "shard": span_hash(running, start, start + length), "context": mix64(hashes[at[which]] + (at[which] - start).astype(np.uint64))}
    return {k: np.concatenate([v[~is_hot], own[k]]) for k, v in found.items()}


def merged_runs(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of one text become one."""
    if not len(doc):
        return doc, version, start, end
    order = np.lexsort((start, version, doc))
    doc, version, start, end = (x[order] for x in (doc, version, start, end))
    new_text = np.ones(len(doc), dtype=bool)
    new_text[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    # The running maximum of ends within a text: texts are shifted apart first.
    number = np.cumsum(new_text) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step) - number * step
    new = new_text.copy()
    new[1:] |= start[1:] > reach[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(doc)) - 1
    return doc[firsts], version[firsts], start[firsts], reach[lasts]


def _rows(kind: int, shard, context, doc, version, at, low, high) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int8)), *(pa.array(x.view(np.int64)) for x in (shard, context)), pa.array(doc), pa.array(version), *(pa.array(x.astype(np.int32)) for x in (at, low, high))],
        names=["kind", "shard", "context", "doc_id", "version", "at", "low", "high"],
    )


def _spans(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Runs as rows of kind 1: ``at`` is 0, ``low`` and ``high`` are start and end; their shard spreads them."""
    doc, version, start, end = merged_runs(doc, version, start, end)
    none = np.zeros(len(doc), np.uint64)
    return _rows(1, mix64(doc.astype(np.uint64)), none, doc, version, np.zeros(len(doc), np.int64), start, end)


def first_of_each(keys: list[np.ndarray], doc: np.ndarray, version: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two marks: the rows at the first place, by document and ``at``, of each distinct key, and those at later places. Of rows equal in all, one is marked."""
    n = len(doc)
    first, again = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        order = np.lexsort((version, at, doc, *keys[::-1]))
        differs = lambda *columns: np.append(True, np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns]))
        new = differs(*keys)
        leader = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        single = differs(*keys, doc, at, version)
        tied = (doc[order] == doc[leader]) & (at[order] == at[leader])
        first[order[tied & single]] = True
        again[order[~tied & single]] = True
    return first, again


def _anchor_task(length: int, hot: np.ndarray):
    def settle(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        first, again = first_of_each([a["shard"], a["context"]], a["doc"], a["version"], a["at"])
        yield _spans(a["doc"][again], a["version"][again], (a["at"] + a["low"])[again], (a["at"] + a["high"])[again] + length)
        yield _rows(0, *(a[k][first] for k in ("shard", "context", *ROW)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n = 0
        for found in _anchors(batches, length, hot):
            held.append(found)
            n += len(found["doc"])
            if n > HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _anchors(batches: Iterator[pa.RecordBatch], length: int, hot: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of rows ``doc_id, version, text``, block by block."""
    for batch in batches:
        doc_ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, data, offsets in text_blocks(batch.column(2), BLOCK):
            for found in _in_pieces(data, offsets, length, hot=hot):
                row = found.pop("row")
                if len(row):
                    yield {**found, "doc": doc_ids[a:b][row], "version": versions[a:b][row]}


def _in_pieces(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = LONGEST, hot: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of a block; a single text longer than ``limit`` goes through in pieces that overlap by a window less one byte."""
    if len(data) <= limit:
        yield window_anchors(data, offsets, length, hot=hot)
        return
    for p in range(0, len(data) - length + 1, limit):
        part = data[p : p + limit + length - 1]
        found = window_anchors(part, np.array([0, len(part)]), length, hot=hot)
        found["at"] = found["at"] + p
        yield found


def _settle_task(length: int):
    """A whole shard partition: settles equal contexts and passes on those that differ under one anchor."""

    def shared(shard: np.ndarray) -> np.ndarray:
        order = np.argsort(shard, kind="stable")
        same = shard[order[1:]] == shard[order[:-1]]
        out = np.zeros(len(shard), dtype=bool)
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            is_span = columns[0] == 1
            if is_span.any():
                yield batch.filter(pa.array(is_span))
            rows.append([c[~is_span] for c in columns[1:]])
        if not rows:
            return
        a = dict(zip(("shard", "context", *ROW), (np.concatenate(c) for c in zip(*rows))))
        del rows
        keep = shared(a["shard"])
        a = {k: v[keep] for k, v in a.items()}
        first, again = first_of_each([a["shard"], a["context"]], a["doc"], a["version"], a["at"])
        yield _spans(a["doc"][again], a["version"][again], (a["at"] + a["low"])[again].astype(np.int64), (a["at"] + a["high"])[again].astype(np.int64) + length)
        a = {k: v[first] for k, v in a.items()}
        # Rows tied at the first place of one context hold no earlier string for each other.
        kinds, _ = first_of_each([a["shard"], a["context"]], *(np.zeros(len(a["doc"]), np.int64) for _ in range(3)))
        several = np.isin(a["shard"], a["shard"][kinds][shared(a["shard"][kinds])])
        yield _rows(0, *(v[several] for v in a.values()))

    return run


class IndexFamily:
    """Suffix arrays in levels of doubling size. ``add`` takes the next batch of texts in corpus order and tells which of their
    windows occur at an earlier place. A level holds the starts of its windows in the bytes of all batches, in the windows' order, and the first place of each;
    windows of levels are spelled out some ``PIECE`` at a time."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self._bytes = np.zeros(0, np.uint8)
        self._levels: list[tuple[np.ndarray, np.ndarray]] = []  # starts, (document, place)

    @property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The levels spelled out: windows, (document, place)."""
        return [(self._windows(starts), places) for starts, places in self._levels]

    def add(self, data: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``starts``: where the windows are in ``data``; ``place``: their (document, place) as rows of two, ascending. Returns a mark for each."""
        starts = starts + len(self._bytes)
        self._bytes = np.concatenate([self._bytes, data])
        order, fresh = self._suffix_array(self._windows(starts))
        distinct, first = starts[order[fresh]], place[order[fresh]]  # the order is stable: the first of equal windows leads
        known = np.zeros(len(distinct), dtype=bool)
        for level, places in self._levels:
            for mine, theirs in self._merge_scan(level, distinct):
                known[mine] = True
                first[mine] = places[theirs]
        seen = np.empty(len(starts), dtype=bool)
        seen[order] = (place[order] != first[np.cumsum(fresh) - 1]).any(axis=1)
        self._insert(distinct[~known], first[~known])
        return seen

    def _windows(self, starts: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self._bytes, self.length)[starts].view(f"S{self.length}").reshape(-1)

    def _suffix_array(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window order: by the first sixteen bytes as two integers, then ties by all bytes. Also a mark, in that order, for the first of equal windows."""
        heads = suffixes.view(np.uint8).reshape(-1, self.length)[:, :16].copy().view(">u8").astype(np.uint64)
        order = np.lexsort((heads[:, 1], heads[:, 0]))
        same = (heads[order[1:]] == heads[order[:-1]]).all(axis=1)
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        fresh = np.ones(len(order), dtype=bool)
        if len(places):
            within = order[places]
            order[places] = within = within[np.argsort(suffixes[within], kind="stable")]
            ranked = suffixes[within]  # equal windows are tied, so they stand side by side here too
            fresh[places[1:]] = ranked[1:] != ranked[:-1]
        return order, fresh

    def _below(self, level: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """How many windows of a level come before each of these."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(level))
        while (low < high).any():
            middle = (low + high) // 2
            less = (low < high) & (self._windows(level[np.minimum(middle, len(level) - 1)]) < windows)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        return low

    def _merged(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The merged order of two levels, as places in ``a`` followed by ``b``, and the windows in that order, piece by piece. Equal windows are in one piece.
        The stable sort finds both runs of a piece and merges them in one pass."""
        cuts, other = np.arange(PIECE, len(a), PIECE), np.arange(PIECE, len(b), PIECE)
        at = np.sort(np.concatenate([[0], cuts, self._below(a, self._windows(b[other])), [len(a)]]))
        to = np.sort(np.concatenate([[0], self._below(b, self._windows(a[cuts])), other, [len(b)]]))
        for i, k, j, m in zip(at[:-1], at[1:], to[:-1], to[1:]):
            both = np.concatenate([self._windows(a[i:k]), self._windows(b[j:m])])
            order = np.argsort(both, kind="stable")
            yield np.concatenate([np.arange(i, k), np.arange(j, m) + len(a)])[order], both[order]

    def _merge_scan(self, level: np.ndarray, batch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the batch and in the level of windows that both have: neighbours in the merged order."""
        for order, merged in self._merged(level, batch):
            at = np.flatnonzero(merged[1:] == merged[:-1])
            yield order[at + 1] - len(level), order[at]

    def _insert(self, starts: np.ndarray, places: np.ndarray) -> None:
        if len(starts):
            self._levels.append((starts, places))
        while len(self._levels) > 1 and len(self._levels[-2][0]) <= 2 * len(self._levels[-1][0]):
            (small, new), (large, old) = self._levels.pop(), self._levels.pop()
            order = np.concatenate([o for o, _ in self._merged(large, small)])
            self._levels.append((np.concatenate([large, small])[order], np.concatenate([old, new])[order]))


def _resolve_task(length: int):
    def batch_of(family: IndexFamily, rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        # rows: document, version, first window's start in it, bytes from there to the last window's end
        sizes = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(sizes)
        counts = sizes - length + 1
        which = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        doc, version, start = (np.array([r[i] for r in rows], np.int64)[which] for i in range(3))
        start += within
        # Contexts of one text overlap: windows go in by their place.
        order = np.lexsort((start, doc))
        seen = np.empty(len(which), dtype=bool)
        seen[order] = family.add(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), ((ends - sizes)[which] + within)[order], np.stack([doc, start], axis=1)[order])
        return _spans(doc[seen], version[seen], start[seen], start[seen] + length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held = IndexFamily(length), []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while True:
                # Texts that share an id may overlap in places, so a document isn't cut in two; a task's rows are bounded.
                n = next((i for i in range(BATCH, len(held)) if held[i][0] != held[i - 1][0]), 0)
                if not n:
                    break
                yield batch_of(family, held[:n])
                held = held[n:]
        if held:
            yield batch_of(family, held)

    return run


def _context_task(length: int):
    """Cuts the contexts out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, docs, versions, starts, parts = [], [], [], [], []
            for doc, version, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).to_pylist()):
                body = memoryview(text.as_buffer())
                for c in wanted:
                    low, high = c["at"] + c["low"], c["at"] + c["high"] + length
                    shards.append(c["shard"])
                    docs.append(doc)
                    versions.append(version)
                    starts.append(low)
                    parts.append(bytes(body[low:high]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (shards, docs, versions)), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], names=["shard", "doc_id", "version", "start", "part"])

    return run


def _cut_task(with_text: bool):
    """From ``text, runs`` and other columns: sizes, digest and, if wanted, what is left of the text, then the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield cut(batch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).cast(pa.large_binary())
        sizes, removed, spans, digests, left = [], [], [], [], []
        for text, runs in zip(texts, batch.column(1).to_pylist()):
            body = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            kept, at, n, last = [], 0, 0, -1
            for low, high in sorted((r["low"], r["high"]) for r in runs or ()):
                n += low > last
                if low > at:
                    kept.append(body[at:low])
                at = last = max(at, high)
            kept.append(body[at:])
            rest = b"".join(kept)
            sizes.append(len(body))
            removed.append(len(body) - len(rest))
            spans.append(n)
            digests.append(hashlib.sha256(rest).hexdigest())
            # A cut may fall inside a character; what is left of it is dropped.
            left.append(rest.decode("utf-8", "ignore") if with_text and text.is_valid else None)
        columns = [*(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string()), pa.array(left, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["bytes", "removed", "spans", "sha256", "left", *batch.schema.names[2:]])

    return run


def _sample_task(length: int):
    """The distinct anchors and contexts of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _anchors(batches, length):
            pairs = np.unique(np.stack([found["shard"], found["context"]], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["shard", "context"])

    return run


def hot_anchors(texts: DataFrame, length: int = LENGTH, every: int = SAMPLE_EVERY, least: int = HOT) -> np.ndarray:
    """Hashes, ascending, of the anchors that have at least ``least`` contexts in the sampled documents; counted where they are, and only long lists' ends are left out."""
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = arrow_map(sampled, _sample_task(length), "shard long, context long").groupBy("shard").agg(F.approx_count_distinct("context").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r.shard for r in counts.orderBy(F.col("n").desc(), "shard").limit(HOT_LISTED).collect()], np.int64).view(np.uint64))


def _versioned(docs: DataFrame, *rest: str) -> tuple[DataFrame, int, bool]:
    """``doc_id, version, text`` and the columns ``rest`` as ``_0, _1, ...``; the bytes of all texts; whether ids repeat. Texts of one id are told apart by a hash, if any id has several; otherwise ``version`` is 0."""
    text = F.col("text").cast("string")
    rows = ids(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)))
    by_id = rows.groupBy("doc_id").agg(F.min("version").alias("a"), F.max("version").alias("b"), F.count("*").alias("rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n"))
    found = by_id.agg(F.sum("n").alias("n"), F.bool_or(F.col("a") != F.col("b")).alias("several"), F.max("rows").alias("rows")).first()
    return rows if found.several else rows.withColumn("version", F.lit(0).cast("long")), found.n or 0, (found.rows or 0) > 1


def repeated_spans(texts: DataFrame, n_bytes: int, repeats: bool, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """``doc_id, version, low, high`` of ``doc_id, version, text``: byte spans to remove; they may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"matches of fewer than {2 * GRAM} bytes aren't supported")
    spark = texts.sparkSession
    texts = texts.select("doc_id", "version", "text").where(F.octet_length("text") >= length)
    hot = hot_anchors(texts, length) if hot is None else hot
    n = max(partitions(spark), 2 * n_bytes // (length - GRAM + 2) // SHARD_ROWS)
    shards = arrow_map(texts, _anchor_task(length, hot), ANCHOR).repartition(n, "shard")
    settled = table(arrow_map(shards, _settle_task(length), ANCHOR), "settled")
    open_contexts = settled.where("kind = 0")
    by_doc = open_contexts.groupBy("doc_id", "version").agg(F.collect_list(F.struct("shard", "at", "low", "high")).alias("wanted"))
    one_each = texts.dropDuplicates(["doc_id", "version"]) if repeats else texts
    contexts = arrow_map(one_each.join(by_doc, ["doc_id", "version"]).select("doc_id", "version", "text", "wanted"), _context_task(length), "shard long, doc_id long, version long, start int, part binary")
    n = max(partitions(spark), open_contexts.count() // OPEN_ROWS)
    batches = contexts.repartition(n, "shard").sortWithinPartitions("doc_id", "version", "start").select("doc_id", "version", "start", "part")
    resolved = arrow_map(batches, _resolve_task(length), ANCHOR)
    return settled.where("kind = 1").union(resolved).select("doc_id", "version", "low", "high")


def _cut(docs: DataFrame, length: int, hot: np.ndarray | None, with_text: bool = False, rest: Sequence[str] = ()) -> DataFrame:
    """``bytes, removed, spans, sha256, left, doc_id`` (``left``: the remaining text, if wanted) and the columns ``rest`` as ``_0, _1, ...``."""
    texts, n_bytes, repeats = _versioned(docs, *rest)
    spans = table(repeated_spans(texts, n_bytes, repeats, length, hot), "spans").groupBy("doc_id", "version").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    names = [f"_{i}" for i in range(len(rest))]
    joined = texts.join(spans, ["doc_id", "version"], "left").select("text", "runs", "doc_id", *names)
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, rest))
    return arrow_map(joined, _cut_task(with_text), "bytes long, removed long, spans long, sha256 string, left string, doc_id long" + kinds)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """One row for each document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. ``hot``: anchors to route apart, found by ``hot_anchors`` if None."""
    return _cut(docs, length, hot).select("doc_id", F.col("bytes").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha256").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """The documents with what is left of their texts, those of which nothing is left excepted; all columns stay, and
    ``n_chars``, if there is one, is counted anew."""
    new = {"text": F.col("left"), "n_chars": F.length("left")}
    rest = [c for c in docs.columns if c not in new]
    left = _cut(docs, length, hot, with_text=True, rest=rest).where("removed = 0 or length(trim(left)) > 0")
    return left.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_{rest.index(c)}")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


SQL = f"""
with d as materialized (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents where doc_id is not null),
w as (select rid, doc_id, p, md5(substr(h, 2 * p + 1, {2 * LENGTH})) as s from (select rid, doc_id, h, unnest(range(0, n - {LENGTH - 1})) as p from d)),
f as (select rid, p, rank() over (partition by s order by doc_id, p) as nth from w),
g as (select rid, p, case when p > lag(p) over (partition by rid order by p) + {LENGTH} then 1 else 0 end as new from f where nth > 1),
k as (select rid, p, sum(new) over (partition by rid order by p rows unbounded preceding) as run from g),
r as materialized (select rid, run, min(p) as low, max(p) + {LENGTH} as high from k group by all),
c as (select rid, low, high, coalesce(lag(high) over (partition by rid order by low), 0) as before from r),
a as (select rid, sum(high - low) as gone, count(*) as spans, max(high) as last, string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' order by low) as head from c join d using (rid) group by rid)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from d left join a using (rid)
"""
