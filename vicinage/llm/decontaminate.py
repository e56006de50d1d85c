"""Benchmark decontamination: random-walk embeddings, bit-sampling LSH, exact edit verification.

Strings here are sequences of words (runs of ASCII letters, digits and non-ASCII bytes; case of A-Z ignored), and a document holds
an item if a part of it lies within an edit distance of ``percent`` of the item's words, by insertions, deletions
and replacements of words.

The CGK embedding walks over a window: step j writes the word at the pointer and then moves on by the bit that a random function of
j and that word gives. Windows at a small edit distance fall into step again after an edit, so their walks differ in few
places: edit distance becomes Hamming distance. LSH samples places of the walk: a table's key is the words at
``SAMPLED`` places. Windows have the item's size class: walks of 16, 32 or 64 steps, the longest that fits the item from each of its first ``STRIDE`` words on;
in items longer than that, windows lie along the whole item. (An item-sized walk over 200 words with 40 edits agrees in too few places for any number of samples.)

Sampling is repeated until it reaches ``TARGET``: ``repetitions`` embeds, for each size class, random items of its shortest length with as many edits as ``percent`` allows, evenly
spread (the hardest place for them), and adds walks of ``TABLES`` samples each until that share of the items meets a key of its copy. At 20 % that is three walks. If ``MOST_WALKS`` don't
reach it, that is an error.

Walks alone miss about one in a hundred of the items with as many edits as allowed, and those of items of fewer than ``SHORT`` words may all end before their last place. So every item is looked up exactly, too: cut into one piece more than
the allowed distance, at least one piece of an item is left intact by any allowed edits, and each piece (the first ``SHORT`` - 1 words of longer ones) is looked up at every word of
the documents. No part within the distance is missed (for ``percent`` below 100).

Documents' windows start at every ``STRIDE``-th word and items' windows at each of their words, so whatever the place
of a passage and wherever it is edited, each of its windows stands opposite one of the item's, and a stretch left intact anywhere
in the item can give a candidate. Keys of items are in a sorted array behind a small bitmap. Each candidate is then verified by the exact edit distance of the whole item to the best part of
the document around it, ``VERIFIED`` words at a time. ``tests/llm`` measures recall for items of 1 to 300 words: 1 with no, one and two edits in ten words, spread or at either end.

Items go to the executors in blocks of at most ``BLOCK_WORDS`` words; the plan holds their texts (some 0.6 MB a block), and a Python worker makes a block's keys once and keeps
those of one block, so nothing unbounded is broadcast; a larger benchmark is a pass over the documents for each block. A key that many items share, as a common question's stem, is expanded ``EXPANDED``
candidates at a time. Nothing is shuffled.

Defined results: null and empty texts hold nothing; items without words or null ids are ignored; of repeated items each is reported. One row for each
document and item, with the least distance (then the first place). Rows with a null id are left out; rows that repeat are reported
again. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import U64, mix64, text_blocks, word_hashes
from ._store import arrow_map, ids, load

PERCENT = 20
STRIDE, SCALES, TABLES, SAMPLED = 4, (16, 32, 64), 3, 4
TARGET, MOST_WALKS, TRIALS = 0.99, 24, 400
#: Items below this many words are looked up by pieces only; pieces are shorter than that.
SHORT = STRIDE + SCALES[0] - 1
BLOCK_WORDS = 100_000
BITMAP_BITS = 22
#: Windows walked side by side.
SIDE_BY_SIDE = 1 << 15
#: Candidates verified at a time.
EXPANDED = 1 << 16
#: Words around candidates of an item that are compared with its own at a time.
VERIFIED = 1 << 20
SEPARATORS = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    SEPARATORS[_a:_b] = False
_RNG = np.random.Generator(np.random.PCG64(31))
#: For each walk and scale, the sampled places of each table: one of each equal part of the walk, as neighbouring places often hold one word.
PLACES = {(w, s): [_RNG.integers(0, s // SAMPLED, SAMPLED) + np.arange(SAMPLED) * (s // SAMPLED) for _ in range(TABLES)] for w in range(MOST_WALKS) for s in SCALES}
SEEDS = mix64(np.arange(1, MOST_WALKS + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03))
NONE = U64(0)


def with_ends(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an end mark after each text, and the new bounds (each text's end mark included)."""
    n = len(bounds) - 1
    out = np.zeros(len(words) + n, np.uint64)
    at = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(bounds))
    out[at] = words | U64(1)  # never the end mark
    return out, bounds + np.arange(n + 1)


def keys(tokens: np.ndarray, starts: np.ndarray, walks: int, scales: Sequence[int] = SCALES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table in order: the keys of the windows at ``starts``, and whether they have one."""
    for w in range(walks):
        bits = mix64(tokens ^ SEEDS[w])
        bits[tokens == NONE] = 0  # at the end of a text the walk stands still
        wanted = {int(p) for s in scales for places in PLACES[w, s] for p in places}
        pointer = starts.copy()
        written: dict[int, np.ndarray] = {}
        for j in range(max(wanted) + 1):
            if j in wanted:
                written[j] = tokens[pointer]
            pointer += ((bits[pointer] >> U64(j)) & U64(1)).astype(np.int64)
        for s in scales:
            for t, places in enumerate(PLACES[w, s]):
                key = np.full(len(starts), U64((w * 64 + s) * 8 + t), np.uint64)
                for p in places:
                    key = (key ^ written[int(p)]) * U64(0x9FB21C651E98DF25)
                    key ^= key >> U64(29)
                # The pointer never moves back, so the last place tells whether the walk ended before.
                yield mix64(key), written[int(places[-1])] != NONE


def scale_of(n_words: int) -> int:
    """The steps of the windows of an item, 0 if it is too short for any."""
    return max((s for s in SCALES if n_words >= s + STRIDE - 1), default=0)


@lru_cache
def repetitions(percent: int, target: float = TARGET) -> int:
    """The least number of walks with which the target share of randomly edited items meets a key of their copy, in each size class."""
    rng = np.random.default_rng(7)
    walks = 1
    for s in SCALES:
        n = s + STRIDE - 1
        k = percent * n // 100
        edited = [(np.arange(k) + 0.5) * n // max(k, 1) if j % 2 else np.sort(rng.choice(n, k, replace=False)) for j in range(TRIALS)]
        items = rng.integers(1, 1 << 62, (TRIALS, n), dtype=np.uint64)
        copies = []
        for item, places in zip(items, edited):
            words = item.tolist()
            for p in places.astype(int)[::-1].tolist():
                new = int(rng.integers(1, 1 << 62))
                words[p : p + 1] = [[], [new], [words[p], new]][rng.integers(3)]
            around = rng.integers(1, 1 << 62, STRIDE + s, dtype=np.uint64).tolist()
            cut = int(rng.integers(STRIDE))
            copies.append(np.array(around[:cut] + words + around[cut:], np.uint64))
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in copies])])
        mine, ends = with_ends(items.reshape(-1), np.arange(TRIALS + 1) * n)
        theirs, their_ends = with_ends(np.concatenate(copies), bounds)
        own = np.repeat(np.arange(TRIALS), n)
        starts = ends[own] + np.tile(np.arange(n), TRIALS)
        counts = -(-np.diff(bounds) // STRIDE)
        of = np.repeat(np.arange(TRIALS), counts)
        their_starts = their_ends[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
        tables = zip(keys(mine, starts, MOST_WALKS, (s,)), keys(theirs, their_starts, MOST_WALKS, (s,)))
        met = np.zeros(TRIALS, bool)
        for t, ((a, has_a), (b, has_b)) in enumerate(tables, 1):
            marked = lambda key, row: mix64(key ^ row.astype(np.uint64))
            met[own[has_a][np.isin(marked(a[has_a], own[has_a]), marked(b[has_b], of[has_b]))]] = True
            if t % TABLES == 0 and met.mean() >= target:
                walks = max(walks, t // TABLES)
                break
        else:
            raise ValueError(f"{MOST_WALKS} walks find {met.mean():.2f} of the items at {percent} % edits, {target} are wanted")
    return walks


def piece_keys(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length in order: the keys of so many words, at every place that has them."""
    key = np.full(len(tokens), U64(0xA0761D6478BD642F), np.uint64)
    for n in range(1, min(max(lengths, default=0), len(tokens)) + 1):
        key = (key[: len(tokens) - n + 1] ^ tokens[n - 1 :]) * U64(0x9FB21C651E98DF25)
        key ^= key >> U64(29)
        if n in lengths:
            yield n, mix64(key ^ U64(n))


@dataclass
class Items:
    ids: np.ndarray
    words: list[np.ndarray]
    bitmap: np.ndarray
    keys: np.ndarray  # sorted
    item: np.ndarray  # for each key its item
    offset: np.ndarray  # and the word of the item at which the window or piece starts
    lengths: list[int]  # of the pieces
    scales: list[int]  # of the windows of items that are not short
    walks: int

    @classmethod
    def of(cls, item_ids: list[int], texts: list[bytes], percent: int = PERCENT) -> Items:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words, bounds = word_hashes(data, offsets, separators=SEPARATORS)
        tokens, ends = with_ends(words, bounds)
        item = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
        offset = (np.arange(len(words)) - bounds[item]).astype(np.int32)
        scales = np.array([scale_of(n) for n in np.diff(bounds).tolist()], np.int64)
        walks = repetitions(percent) if scales.any() else 1
        found = []
        for scale in np.unique(scales[scales > 0]).tolist():
            rows = np.flatnonzero(scales[item] == scale)
            for k, ok in keys(tokens, ends[item[rows]] + offset[rows], walks, (scale,)):
                found.append((k[ok], item[rows][ok], offset[rows][ok]))
        pieces = []
        for i in np.flatnonzero(np.diff(bounds) > 0).tolist():
            n = int(bounds[i + 1] - bounds[i])
            cuts = np.arange((many := min(percent * n // 100 + 1, n)) + 1) * n // many
            pieces += [(i, a, min(b - a, SHORT - 1)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        of, at, long = np.array(pieces, np.int32).reshape(-1, 3).T
        lengths = sorted(set(long.tolist()))
        for n, k in piece_keys(tokens, lengths):
            own, first = of[long == n], at[long == n]
            found.append((k[ends[own] + first], own, first))
        key, item, offset = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.uint64, np.int32, np.int32))
        order = np.argsort(key, kind="stable")
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[(key >> U64(64 - BITMAP_BITS)).astype(np.int64)] = True
        return cls(np.array(item_ids, np.int64), [tokens[ends[i] : ends[i + 1] - 1] for i in range(len(texts))], bitmap, key[order], item[order], offset[order], lengths, sorted(set(scales[scales > 0].tolist())), walks)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any part of the text, and the end of the first such part."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != U64(word)))
        # Insertions run along the row: the least of (value - place) so far.
        row = np.minimum.accumulate(new - at) + at
    best = int(row.argmin())
    return int(row[best]), best


def _candidates(keyed: Iterator[tuple[np.ndarray, np.ndarray]], items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, item and offset of every key that the places of ``keyed`` (keys and their places) share with an item, some at a time."""
    held, n_held = [], 0
    for key, at in keyed:
        hit = np.flatnonzero(items.bitmap[(key >> U64(64 - BITMAP_BITS)).astype(np.int64)])
        if not len(hit):
            continue
        low, high = np.searchsorted(items.keys, key[hit]), np.searchsorted(items.keys, key[hit], side="right")
        ends = np.cumsum(high - low)
        for first in range(0, int(ends[-1]), EXPANDED):
            nth = np.arange(first, min(first + EXPANDED, int(ends[-1])))
            row = np.searchsorted(ends, nth, side="right")
            which = high[row] - (ends[row] - nth)
            held.append((at[hit][row], items.item[which], items.offset[which]))
            n_held += len(nth)
            if n_held >= EXPANDED:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, n_held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _all_candidates(tokens: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The candidates by pieces, then those by windows, some windows at a time."""
    yield from _candidates(((k, np.arange(len(k))) for _, k in piece_keys(tokens, items.lengths)), items)
    if not items.scales:
        return
    for a in range(0, len(starts), SIDE_BY_SIDE):
        # Walks end within as many words as they have steps: only that part of the words is looked at.
        some = starts[a : a + SIDE_BY_SIDE]
        part = tokens[some[0] : some[-1] + max(items.scales) + 2]
        yield from _candidates(((k[ok], some[ok]) for k, ok in keys(part, some - some[0], items.walks, items.scales)), items)


def _shared(tokens: np.ndarray, wanted: np.ndarray, first: np.ndarray, last: np.ndarray, allowed: int) -> np.ndarray:
    """The number of words, each as often as both have it, that an item and each of some parts of the texts have in common."""
    own, often = np.unique(wanted, return_counts=True)
    span = first[:, None] + np.arange(len(wanted) + 2 * allowed)
    near = tokens[np.minimum(span, len(tokens) - 1)]
    which = np.minimum(np.searchsorted(own, near), len(own) - 1)
    row, _ = same = np.nonzero((own[which] == near) & (span < last[:, None]))
    held = np.bincount(row * len(own) + which[same], minlength=len(first) * len(own)).reshape(len(first), len(own))
    return np.minimum(held, often).sum(axis=1)


def find(data: np.ndarray, offsets: np.ndarray, items: Items, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, end word) of the items in each text of a block."""
    words, bounds = word_hashes(data, offsets, separators=SEPARATORS)
    tokens, ends = with_ends(words, bounds)
    counts = -(-np.diff(bounds) // STRIDE)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = ends[text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for at, item, offset in _all_candidates(tokens, starts, items):
        if not len(at):
            continue
        begin = at - offset
        of = np.searchsorted(ends, at, side="right") - 1
        chosen = np.unique(np.stack([item, of, begin]), axis=1)
        for i in np.unique(chosen[0]).tolist():
            wanted = items.words[i]
            allowed = percent * len(wanted) // 100
            of, begin = chosen[1:, chosen[0] == i]
            first = np.maximum(ends[of], begin - allowed)
            last = np.minimum(ends[of + 1] - 1, begin + len(wanted) + allowed)
            # Words in common, each as often as both have it, at least as many as an allowed distance leaves, come before the exact distance.
            step = max(1, VERIFIED // (len(wanted) + 2 * allowed))
            shared = np.concatenate([_shared(tokens, wanted, first[c : c + step], last[c : c + step], allowed) for c in range(0, len(first), step)])
            for c in np.flatnonzero(shared >= len(wanted) - allowed).tolist():
                d = int(of[c])
                known = best.get((d, i), (1, 0))
                if known[0] == 0 and int(first[c] - ends[d]) + len(wanted) >= known[1]:
                    continue  # a verbatim place that no place of this candidate comes before is known
                distance, end = edit_distance(wanted, tokens[first[c] : last[c]])
                if distance <= allowed:
                    found = (distance, int(first[c]) + end - int(ends[d]))
                    best[d, i] = min(best.get((d, i), found), found)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


@lru_cache(maxsize=1)
def _items(item_ids: tuple[int, ...], texts: tuple[bytes, ...], percent: int) -> Items:
    """The keys of a block, made once in a worker."""
    return Items.of(list(item_ids), list(texts), percent)


Block = tuple[tuple[int, ...], tuple[bytes, ...], int]


def _find_task(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(*block)
        for batch in batches:
            doc_ids = batch.column(0).to_numpy()
            for a, _, data, offsets in text_blocks(batch.column(1)):
                found = find(data, offsets, items, block[2])
                if found:
                    text, item, distance, end = (np.array(x, np.int64) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a + text]), pa.array(items.ids[item]), pa.array(np.array([len(items.words[i]) for i in item])), pa.array(distance), pa.array(end)], names=["doc_id", "item_id", "item_words", "distance", "end_word"])

    return run


def _item_blocks(benchmark: DataFrame, block_words: int, percent: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; the driver fetches a partition of it at a time and keeps the texts."""
    repetitions(percent)  # an error here rather than in a task
    held: list[tuple[int, bytes]] = []
    room = block_words
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        n = len(row.text.split())
        if held and n > room:
            yield (*map(tuple, zip(*held)), percent)
            held, room = [], block_words
        if n:
            held.append((row.item_id, row.text.encode()))
            room -= n
    if held:
        yield (*map(tuple, zip(*held)), percent)


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, item_words, distance, end_word``: the benchmark items that each document holds."""
    texts = ids(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, item_words long, distance long, end_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in _item_blocks(benchmark, block_words, percent):
        found = found.union(arrow_map(texts, _find_task(block), schema))
    return found


def _clean_task(block: Block, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(*block)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for a, _, data, offsets in text_blocks(batch.column(text_at)):
                clean[[a + f[0] for f in find(data, offsets, items, block[2])]] = False
            yield batch.filter(pa.array(clean))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that hold no item, with all their columns: a filter, nothing is shuffled. Rows with a null id are judged too."""
    for block in _item_blocks(benchmark, block_words, percent):
        docs = arrow_map(docs, _clean_task(block, docs.columns.index("text")), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
