r"""Benchmark decontamination with suffix arrays of the training texts.

:func:`search` adds to each document what of a benchmark it repeats, :func:`clean`
removes the documents that repeat too much.  The documents are read in shards of
about ``SHARD`` bytes inside ``mapInArrow``; each shard's words get a suffix array (prefix
doubling to the depth of a window; no suffix crosses a document's end), in which the first
window of every test suffix is found by binary search, equal windows once.  Where one
stands, the words are hit.  From there the longest verbatim match goes on: intervals of
the suffix array of the test texts are narrowed by words doubled in number, so that
a text that repeats itself takes no pairs of places.  Whole texts; no shuffle.

Words: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  A window is
``window`` consecutive words of an item; an item of fewer, but not none, is one window.
Words are told apart by 64-bit hashes (see :mod:`kernels`).

Results: ``n_words``; ``n_hit``, words inside occurring windows; ``items``, the ids that own one,
sorted; ``matches``, ordered by their place: each stretch of the document that some item
holds verbatim and that can't be made longer on either side (or a whole shorter
item), with one of its places in the benchmark.

The benchmark is measured before it is sent: up to ``BLOCK`` bytes of text go to the
tasks at once and one pass does.  A larger one is dealt to blocks of about half of that
(a block grows beyond only for a single longer item); one at a time is on the
driver and in the tasks, what it finds is written, and the findings are joined to the
documents by two hashes of their texts.

Defined results: null and empty texts have no words and are clean; items with a null
id or without words match nothing; items that repeat an id count as one; repeated
documents are judged one by one; an empty benchmark leaves every document clean; other
columns pass through and columns named like a result are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpi_spark.llm import kernels as K
from kpi_spark.llm.columns import hidden, shown
from kpi_spark.llm.store import Tables

#: Bytes of benchmark text sent to the tasks at once, bytes of a shard, and words whose longest matches are sought at once (a document at least).
BLOCK, SHARD, STRETCH = 4 << 20, 2 << 20, 1 << 18

_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
MATCH = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"
SPANS = "array<struct<start:int,end:int>>"
_RESULT = ("n_words", "n_hit", "items", "matches")


def suffix_array(words: np.ndarray, row_end: np.ndarray, depth: int) -> np.ndarray:
    """Word positions in the order of their suffixes, by ``depth`` words at least.  words: 32-bit; row_end: where each position's row ends.

    Prefix doubling that starts from two words and from then on sorts only what is still tied.
    """
    n = len(words)
    left = row_end - np.arange(n)
    pair = words.astype(np.uint64) << np.uint64(32)
    pair[:-1] |= np.where(left[:-1] > 1, words[1:], 0).astype(np.uint64)
    order = np.argsort(pair)
    tied, key, rank, k = np.arange(n), pair[order], np.empty(n, np.int64), 2
    while True:
        head = np.ones(len(tied), bool)
        head[1:] = (key[1:] != key[:-1]) | (tied[1:] != tied[:-1] + 1)
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))] + 1
        alone = head & np.append(head[1:], True)
        tied = tied[~alone]
        if k >= depth or not len(tied):
            return order
        at = order[tied]
        behind = np.where(left[at] > k, rank[np.minimum(at + k, n - 1)], 0)
        key = rank[at] * (n + 1) + behind
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        k *= 2


class Shard:
    """The words (64-bit hashes) of some documents with the suffix array of their upper halves."""

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int) -> None:
        self.full, self.words, self.first = words, (words >> np.uint64(32)).astype(np.uint32), first
        self.row_end, self.depth = np.repeat(first[1:], np.diff(first)), depth

    def compare(self, at: np.ndarray, test: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sign of (suffix at ``at``) against (``size`` test words from ``start``), by those words only."""
        sign = np.zeros(len(at), np.int8)
        open_ = np.arange(len(at))
        d = 0
        while len(open_):
            a, s = at[open_] + d, start[open_] + d
            over = a >= self.row_end[at[open_]]
            mine = self.words[np.minimum(a, len(self.words) - 1)]
            theirs = test[s]
            differ = over | (mine != theirs)
            sign[open_[differ]] = np.where(over | (mine < theirs), -1, 1)[differ]
            d += 1
            open_ = open_[~differ]
            open_ = open_[size[open_] > d]
        return sign

    def bound(self, test: np.ndarray, start: np.ndarray, size: np.ndarray, *, upper: bool) -> np.ndarray:
        """Binary search of all test windows at once: the first place whose suffix isn't smaller (upper: is larger)."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.words), np.int64)
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            sign = self.compare(self.order[middle], test, start[live], size[live])
            right = sign <= 0 if upper else sign < 0
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
        return low

    def occurrences(self, full: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, word position) of every place where one of the (distinct) windows stands, ordered by position."""
        if not len(self.words) or not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        test = (full >> np.uint64(32)).astype(np.uint32)
        self.order = suffix_array(self.words, self.row_end, self.depth)
        low = self.bound(test, start, size, upper=False)
        maybe = np.flatnonzero(low < len(self.words))
        found = maybe[self.compare(self.order[low[maybe]], test, start[maybe], size[maybe]) == 0]
        high = self.bound(test, start[found], size[found], upper=True)
        n = high - low[found]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        which, place = np.repeat(found, n), self.order[np.repeat(low[found], n) + inside]
        same = np.ones(len(which), bool)  # by all 64 bits of the words' hashes
        for d in range(int(size[which].max()) if len(which) else 0):
            inner = size[which] > d
            same[inner] &= self.full[place[inner] + d] == full[start[which[inner]] + d]
        order = np.argsort(place[same], kind="stable")
        return which[same][order], place[same][order]


def _numbered(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the first of each distinct span of words, and the number of the distinct one that each span is."""
    codes = {1: np.unique(words, return_inverse=True)[1]}  # numbers of the spans of 1, 2, 4, ... words from each position
    first, which, seen = [np.zeros(0, np.int64)], np.empty(len(start), np.int64), 0
    for k in np.unique(size).tolist():
        half = 1 << (k.bit_length() - 1)
        for w in (1 << b for b in range(half.bit_length() - 1)):
            if 2 * w not in codes:
                behind = np.zeros(len(words), np.int64)
                behind[:-w] = codes[w][w:]
                codes[2 * w] = np.unique(codes[w] * (len(words) + 1) + behind, return_inverse=True)[1]
        mine = np.flatnonzero(size == k)
        key = codes[half][start[mine]] * (len(words) + 1) + codes[half][start[mine] + k - half]
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        first.append(mine[one])
        which[mine] = number + seen
        seen += len(one)
    return np.concatenate(first), which


class Test:
    """A block of benchmark items: their distinct windows, who owns these, and the suffix array of the items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        items = sorted(items)
        self.window, self.ids = window, sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        buf, off = K.text_buffer(pa.array([t for _, t in items], pa.string()))
        self.words, self.first = K.word_hashes(buf, off, K.ALNUM)
        self.owner = np.array([number[i] for i, _ in items], np.int64)
        count = np.diff(self.first)
        own = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        item = np.repeat(np.arange(len(items)), own)
        start = self.first[item] + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        size = np.minimum(count[item], window)
        one, which = _numbered(self.words, start, size)
        self.start, self.size = start[one], size[one]
        self.longest = int(count.max()) if len(count) else 1
        # windows with the same owners share one set of these; the first sets are those of one owner
        both = np.unique(which * (len(self.ids) + 1) + self.owner[item])
        owners, begin = both % (len(self.ids) + 1), np.searchsorted(both // (len(self.ids) + 1), np.arange(len(one) + 1))
        self.sets = [np.array([k]) for k in range(len(self.ids))]
        self.set_of = owners[begin[:-1]] if len(one) else np.zeros(0, np.int64)
        known: dict[bytes, int] = {}
        for w in np.flatnonzero(np.diff(begin) > 1).tolist():
            some = owners[begin[w] : begin[w + 1]]
            k = known.setdefault(some.tobytes(), len(self.sets))
            if k == len(self.sets):
                self.sets.append(some)
            self.set_of[w] = k
        self._levels: list[np.ndarray] | None = None

    def levels(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The items' suffixes in order, and for 1, 2, 4, ... words where in that order the suffixes begin that share a suffix's first so many."""
        if self._levels is None:
            m = len(self.words)
            left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(m)
            self.sorted = np.sort(self.words)
            ranks, w = [np.searchsorted(self.sorted, self.words)], 1
            order = np.argsort(ranks[0], kind="stable")
            while w < self.longest:
                key = self._pair(ranks[-1], w, left)
                order = np.argsort(key, kind="stable")
                ranks.append(np.searchsorted(key[order], key))
                w *= 2
            self._levels, self.order, self.left = ranks, order, left
        return self.order, self._levels

    def _pair(self, rank: np.ndarray, w: int, left: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Keys of the first 2 * w words, those of a suffix that ends before smaller."""
        at = np.arange(len(rank)) if at is None else at
        behind = np.where(left[at] > w, rank[np.minimum(at + w, len(rank) - 1)] + 1, 0)
        return rank[at] * (len(rank) + 1) + behind

    def longest_matches(self, words: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place in the test words) of the longest match that begins at each ``at``; end: where each position's stretch ends."""
        order, ranks = self.levels()
        m, n = len(order), len(words)
        here = [np.searchsorted(self.sorted, words)]
        bounds = [self.sorted]
        for j, rank in enumerate(ranks[:-1]):
            w = 1 << j
            keys = self._pair(rank, w, self.left, order)
            bounds.append(keys)
            key = np.full(n, -1)
            far = np.minimum(np.arange(n) + w, n - 1)
            whole = (np.arange(n) + w < end) & (here[j] >= 0) & (here[j][far] >= 0)
            key[whole] = here[j][whole] * (m + 1) + here[j][far[whole]] + 1
            place = np.searchsorted(keys, key)
            here.append(np.where(whole & (keys[np.minimum(place, m - 1)] == key), place, -1))
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), m), np.zeros(len(at), np.int64)
        for j in reversed(range(len(ranks))):
            x = at + length
            some = np.flatnonzero(x < end[at])
            some = some[here[j][x[some]] >= 0]
            a = here[j][x[some]]
            b = np.searchsorted(bounds[j], bounds[j][a], "right")
            lo = self._bound(order, ranks[-1], low[some], high[some], length[some], a)
            hi = self._bound(order, ranks[-1], low[some], high[some], length[some], b)
            good = lo < hi
            some = some[good]
            low[some], high[some] = lo[good], hi[good]
            length[some] += 1 << j
        return length, order[low]

    def _bound(self, order: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``low`` on whose suffix, without its first ``length`` words, has at least that rank."""
        low, high = low.copy(), high.copy()
        while len(live := np.flatnonzero(low < high)):
            middle = (low[live] + high[live]) // 2
            t, d = order[middle], length[live]
            value = np.where(self.left[t] > d, rank[np.minimum(t + d, len(rank) - 1)], -1)
            right = value < least[live]
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
        return low


class Found:
    """What a shard repeats of a block: hit words, (row, set of owners) pairs, and matches (row, item, word of the item, word of the row, words) by row."""

    def __init__(self, shard: Shard, test: Test) -> None:
        which, place = shard.occurrences(test.words, test.start, test.size)
        size, n = test.size[which], len(shard.full)
        self.hit = _covered(n, place, size)
        row = np.searchsorted(shard.first, place, "right") - 1
        pairs = np.unique(row * len(test.sets) + test.set_of[which]) if len(which) else row
        self.rows, self.sets = pairs // max(1, len(test.sets)), pairs % max(1, len(test.sets))
        short = size < test.window
        parts = [(place[short], test.start[which[short]], size[short])]
        long = place[~short]
        inside = np.flatnonzero(_covered(n, long, size[~short]))
        stretch_row = np.searchsorted(shard.first, inside, "right") - 1
        edges = np.append(np.flatnonzero(np.diff(stretch_row, prepend=-1)), len(inside))  # a document's covered words stay together
        for i, j in K.pieces(edges, STRETCH):
            begin, stop = edges[i], edges[j]
            some = inside[begin:stop]
            new = np.flatnonzero((np.diff(some, prepend=-2) != 1) | (np.diff(stretch_row[begin:stop], prepend=-1) != 0))
            end = np.repeat(np.append(new[1:], len(some)), np.diff(np.append(new, len(some))))
            mine = long[(long >= some[0]) & (long <= some[-1])]
            at = np.searchsorted(some, mine)
            length, target = test.longest_matches(shard.full[some], end, at)
            grows = np.zeros(len(mine), bool)  # one that began a word earlier holds this one
            grows[1:] = (mine[1:] == mine[:-1] + 1) & (length[:-1] == length[1:] + 1) & (end[at[1:]] == end[at[:-1]])
            parts.append((mine[~grows], target[~grows], length[~grows]))
        place, target, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((target, length, place))
        place, target, self.length = place[order], target[order], length[order]
        self.row = np.searchsorted(shard.first, place, "right") - 1
        self.doc_start = place - shard.first[self.row]
        item = np.searchsorted(test.first, target, "right") - 1
        self.item, self.item_start = test.owner[item], target - test.first[item]


def _covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each of ``n`` positions is inside a span."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


_TESTS: dict[tuple, Test] = {}


def _test(key: tuple, items: list[tuple[str, str]], window: int) -> Test:
    """One per Python worker, so that several tasks share a block's arrays."""
    if key not in _TESTS:
        _TESTS.clear()
        _TESTS[key] = Test(items, window)
    return _TESTS[key]


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """Values as one list a row; row: the row of each, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _columns(shard: Shard, test: Test) -> dict[str, pa.Array]:
    """Result columns of a shard's rows."""
    f, rows = Found(shard, test), len(shard.first) - 1
    hit = np.concatenate(([0], np.cumsum(f.hit)))[shard.first]
    owned = [np.unique(np.concatenate([test.sets[s] for s in f.sets[a:b].tolist()])) for a, b in _runs(f.rows)]
    owner_row = np.repeat(np.unique(f.rows), [len(x) for x in owned])
    ids = pa.array(test.ids, pa.string())
    inside = np.flatnonzero(f.hit)
    row = np.searchsorted(shard.first, inside, "right") - 1
    new = np.flatnonzero((np.diff(inside, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
    last = np.append(new, len(inside))[1:] - 1
    spans = pa.StructArray.from_arrays([pa.array((inside[k] - shard.first[row[k]] + extra).astype(np.int32)) for k, extra in ((new, 0), (last, 1))], fields=list(_SPAN))
    found = pa.StructArray.from_arrays([ids.take(pa.array(f.item)), *(pa.array(x.astype(np.int32)) for x in (f.item_start, f.doc_start, f.length))], fields=list(_MATCH))
    return {
        "n_words": pa.array(np.diff(shard.first), pa.int64()),
        "n_hit": pa.array(np.diff(hit), pa.int64()),
        "items": _lists(owner_row, rows, ids.take(pa.array(np.concatenate(owned) if owned else np.zeros(0, np.int64)))),
        "matches": _lists(f.row, rows, found),
        "hits": _lists(row[new], rows, spans),
    }


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    begin = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(begin, [*begin[1:], len(values)]))


def _searched(df: DataFrame, shared, window: int, text: str, keep: list[str], results: str, *, only_hits: bool = False) -> DataFrame:
    """``keep`` of ``df`` and result columns (``results``: their schema) for a broadcast block of items."""
    made = T.StructType.fromDDL(results)
    names, key = made.names, (uuid.uuid4().hex, window)
    schema = T.StructType([*(df.schema[c] for c in keep), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _TESTS.get(key) or _test(key, shared.value, window)
        for batch in batches:
            buf, off = K.text_buffer(batch.column(text))
            for i, j in K.pieces(off, SHARD):
                words, first = K.word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], K.ALNUM)
                found = _columns(Shard(words, first, min(window, test.longest)), test)
                part = batch.slice(i, j - i)
                out = pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [found[n] for n in names], [*keep, *names])
                yield out.filter(pa.array(np.asarray(found["n_hit"]) > 0)) if only_hits else out

    return df.mapInArrow(run, schema)


def _block(df: DataFrame) -> list[tuple[str, str]]:
    return [(r["id"], r["text"]) for r in df.collect()]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block: int = BLOCK, keep_text: bool = True, tables: Tables | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items and matches (array of item_id, item_start, doc_start, length; in words).

    keep_text: whether the text column stays.  tables: where findings of blocks are written.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    given = [c for c in docs.columns if c.lower() not in _RESULT]
    keep = [c for c in given if keep_text or c != text]
    docs = docs.select(*given)
    if size <= block:
        return _searched(docs, spark.sparkContext.broadcast(_block(items)), window, text, keep, f"n_words long, n_hit long, items array<string>, matches {MATCH}")
    tables = tables or Tables(spark, "decontam")
    blocks = -(-2 * size // block)
    dealt = tables.put(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), "items")
    keys = (F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2"))
    parts = []
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(_block(dealt.where(F.col("block") == k)))
        found = _searched(docs.select(*keys, text), shared, window, text, ["_h1", "_h2"], f"items array<string>, matches {MATCH}, hits {SPANS}", only_hits=True)
        parts.append(tables.put(found.dropDuplicates(["_h1", "_h2"]), f"found-{k}"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    gather = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    merged = every.groupBy("_h1", "_h2").agg(F.array_distinct(gather("items")).alias("items"), gather("hits").alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))
    step = lambda acc, h: F.struct((acc["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], h["end"]).alias("reach"))
    n_hit = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), step, lambda acc: acc["n"].cast("long"))
    by_place = lambda x, y: F.when(x["doc_start"] < y["doc_start"], -1).when(x["doc_start"] > y["doc_start"], 1).otherwise(F.when(x["length"] < y["length"], -1).when(x["length"] > y["length"], 1).otherwise(0))
    merged = merged.select(F.col("_h1").alias("_m1"), F.col("_h2").alias("_m2"), n_hit.alias("n_hit"), "items", F.array_sort("matches", by_place).alias("matches"))
    nothing = spark.sparkContext.broadcast([])
    counted = _searched(docs.select(*given, *keys), nothing, window, text, [*keep, "_h1", "_h2"], "n_words long")
    joined = counted.join(merged, (F.col("_h1") == F.col("_m1")) & (F.col("_h2") == F.col("_m2")), "left")
    return joined.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("matches", F.array().cast(MATCH)).alias("matches"))


def contaminated(share: int = 20) -> F.Column:
    """Whether at least one word in ``share`` stands inside a match."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return shown(search(hidden(docs, _RESULT), benchmark, **options).where(~contaminated(share)), docs.columns)
