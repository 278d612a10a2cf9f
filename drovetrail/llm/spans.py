"""Long verbatim spans shared between documents, by hashing runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Words that a shared run has at least.
RUN_WORDS = 64
#: A sentence has at most so many words (longer ones are divided), and so many consecutive sentences make a span.
SENTENCE_WORDS, SPAN_SENTENCES = 11, 3
#: Bits of the filter of repeated spans for each of them, and its greatest size (128 MB): with more than 2**25 spans it
#: lets more others pass, which costs work but changes no result.
FILTER_BITS, MOST_BITS = 32, 1 << 30
#: A window in more blocks of documents than this, or than this share of all rows, is compared in parts.
HOT_ROWS, HOT_SPANS, HOT_PARTS = 1024, 1 << 16, 64
#: Words that are hashed at a time, whatever the size of an Arrow batch; a longer text is hashed as a whole.
BLOCK_WORDS = 1 << 20

_WORD = re.compile(r"[^ \t\r\n]+")
_ENDS = tuple(".;:!?")
#: Odd multipliers of two polynomial hashes over words, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hash of each word met so far: 62 bits, with words that end a sentence below all others."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[word] = (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 2) | (0 if word.endswith(_ENDS) else 1 << 62)
        return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class _Block:
    """The words of some documents as hashes, one after the other, with hashes of any run of words."""

    def __init__(self, ids: list, keys: list[np.ndarray]):
        self.ids = np.array(ids)
        self.key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
        self.starts = self.ends - np.array([len(k) for k in keys], np.int64)
        self.n = len(self.key)
        self.doc = np.repeat(np.arange(len(ids)), self.ends - self.starts)
        self.end = self.ends[self.doc] if self.n else np.zeros(0, np.int64)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the words from a up to b (not included), equal for equal runs wherever they stand."""
        if which not in self._sums:
            up, down = _powers(_BASES[which], self.n + 1)
            words = _mixed(self.key.astype(np.uint64) + np.uint64(which * 0x632BE59BD9B4E019 % (1 << 64)))
            self._sums[which] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64))), down
        sums, down = self._sums[which]
        return _mixed((sums[b] - sums[a]) * down[a]).view(np.int64)

    def cuts(self, w: int) -> np.ndarray:
        """Where sentences begin: the least key of each window of w words within a document, all of equal ones."""
        if self.n < w:
            return np.zeros(0, np.int64)
        least = _sliding(self.key, w, np.minimum)
        at = np.arange(len(least))
        least = np.where(at + w <= self.end[: len(least)], least, -1)
        padded = np.concatenate((np.full(w - 1, -1, np.int64), least, np.full(w - 1, -1, np.int64)))
        return np.flatnonzero(_sliding(padded, w, np.maximum)[: self.n] == self.key)

    def spans(self, w: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of every run of m consecutive sentences of a document."""
        c = self.cuts(w)
        if len(c) <= m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = c[:-m], c[m:]
        same = self.doc[a] == self.doc[b]
        return a[same], b[same]


def _sliding(x: np.ndarray, w: int, least) -> np.ndarray:
    """least (minimum or maximum) over each window of w entries."""
    width = 1
    while width * 2 <= w:
        x = least(x[:-width], x[width:])
        width *= 2
    return least(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    hashes, ids, keys, held = _Hashes(), [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = _WORD.findall(t.as_py() or "")
            if i is not None and len(words) >= RUN_WORDS:
                ids.append(i)
                keys.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
                held += len(words)
            if held >= BLOCK_WORDS:
                yield _Block(ids, keys)
                ids, keys, held = [], [], 0
    if ids:
        yield _Block(ids, keys)


def _grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of h, and where its groups of equal values start in it."""
    o = np.argsort(h, kind="stable")
    s = h[o]
    return o, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)


def repeated_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """h, n: hashes of the runs of SPAN_SENTENCES consecutive sentences that occur in more than one document, and in how many blocks.

    Sentences end where the text's own do, as long as they are short; longer ones are divided at words chosen by their
    content (the least hash in each window of SENTENCE_WORDS words), so equal stretches are divided alike wherever they
    stand and every shared run of RUN_WORDS words holds a whole span. A task sends one row per hash and block of
    documents, with the lowest and highest document that has it.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            a, b = block.spans(SENTENCE_WORDS, SPAN_SENTENCES)
            h = block.runs(a, b)
            o, first = _grouped(h)
            ids = block.ids[block.doc[a]][o]
            low, high = np.minimum.reduceat(ids, first) if len(first) else ids, np.maximum.reduceat(ids, first) if len(first) else ids
            by_place = np.argsort(o[first])  # rows of a document stay together, which compresses its id
            yield pa.RecordBatch.from_arrays([pa.array(x[by_place]) for x in (h[o][first], low, high)], ["h", "low", "high"])

    spans = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(emit, "h bigint, low bigint, high bigint")
    return spans.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).filter("low < high").select("h", "n")


def span_filter(repeated: DataFrame, count: int) -> np.ndarray:
    """A table of bits in which those of the repeated spans' hashes are set; built in parts, and at most MOST_BITS large."""
    bits = min(max(1 << (FILTER_BITS * max(count, 1) - 1).bit_length(), 1 << 16), MOST_BITS)
    part = min(bits, 1 << 18)

    def build(h: pa.Table) -> pa.Table:
        at = h.column("h").to_numpy() & (bits - 1)
        table = np.zeros(part, np.uint8)
        table[at % part] = 1
        return pa.table({"part": [int(at[0] // part)], "bits": [np.packbits(table, bitorder="little").tobytes()]})

    parts = repeated.select("h").groupBy(F.floor(F.col("h").bitwiseAND(bits - 1) / part).alias("part")).applyInArrow(build, "part bigint, bits binary").toArrow()
    table = np.zeros(bits // 8, np.uint8)
    for p, b in zip(parts.column("part").to_pylist(), parts.column("bits"), strict=True):
        table[p * part // 8 : (p + 1) * part // 8] = np.frombuffer(b.as_buffer(), np.uint8)
    return table


def _set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (len(table) * 8 - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def shared_runs(docs: DataFrame, doc_id: str, text: str, later_only: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, first, last: word positions covered by runs of RUN_WORDS words that another document has too.

    Runs of consecutive sentences are hashed and joined globally. Every executor gets a filter of the repeated ones, of
    bounded size; every window of RUN_WORDS words that can be shared by it is then checked exactly (by 96 bits of two
    hashes of its words). A task settles at once what several of its
    documents share and sends on one document's window for all of them, so a window in a third of all documents is one
    row per block; windows on spans in very many blocks are compared in parts first and what the parts leave open after
    that, so no task gets all rows of one. With ``later_only`` the windows of the lowest document that has them are left
    out: what remains is what removing repeats would take. Ranges of a document may overlap.
    """
    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    repeated = cut(repeated_spans(named, "doc_id", "text"))
    sizes = repeated.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    least = max(hot_rows, (sizes["n"] or 0) // HOT_SPANS)  # so hot spans are at most HOT_SPANS
    hot = np.sort(repeated.filter(F.col("n") > least).select("h").toArrow().column("h").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast((span_filter(repeated, sizes["k"]), hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hot = known.value
        for block in _blocks(batches):
            a, b = block.spans(SENTENCE_WORDS, SPAN_SENTENCES)
            h = block.runs(a, b)
            hit = _set(table, h)
            # A shared window's inner part is divided alike in both documents: it holds a span, and only repeated ones.
            s = np.flatnonzero(_inside(block, a[hit], b[hit]) & ~_inside(block, a[~hit], b[~hit]))
            s = s[s + RUN_WORDS <= block.end[s]]
            if not len(s):
                continue
            crowded = np.isin(h, hot)
            crowded = _inside(block, a[crowded], b[crowded])[s] if crowded.any() else np.zeros(len(s), bool)
            h1, h2 = block.runs(s, s + RUN_WORDS), block.runs(s, s + RUN_WORDS, 1)
            o, first = _grouped(h1)
            s, h1, h2, crowded = s[o], h1[o], h2[o], crowded[o]
            ids = block.ids[block.doc[s]]
            group = np.zeros(len(s), np.int64)
            group[first[1:]] = 1
            group = np.cumsum(group)
            lowest = np.minimum.reduceat(ids, first)
            several = np.maximum.reduceat(ids, first) > lowest
            settled = several[group] & ((ids > lowest[group]) | (not later_only))
            # For all documents of the block that have a window, its lowest one goes on.
            mine = np.flatnonzero(ids == lowest[group])
            if not later_only:
                mine = mine[~several[group[mine]] | np.isin(mine, mine[np.unique(group[mine], return_index=True)[1]], assume_unique=True)]
            mine = mine[np.argsort(s[mine])]  # rows of a document stay together, which compresses its id
            place = s - block.starts[block.doc[s]]
            state = -np.where(several[group[mine]], 1, 0) - np.where(crowded[mine], 2, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[mine]), pa.array((h2[mine] << 32) | place[mine]), pa.array(ids[mine]), pa.array(state.astype(np.int32), mask=state == 0)],
                ["h1", "h2_first", "doc_id", "last"],
            )
            p = np.sort(s[settled])
            if len(p):
                new = np.concatenate(([True], (p[1:] != p[:-1] + 1) | (block.doc[p[1:]] != block.doc[p[:-1]])))
                a0, b0 = p[new], p[np.concatenate((new[1:], [True]))]
                d = block.doc[a0]
                spread = _mixed((block.ids[d] * 1_000_003 + a0).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.array(a0 - block.starts[d]), pa.array(block.ids[d]), pa.array((b0 - block.starts[d] + RUN_WORDS - 1).astype(np.int32))],
                    ["h1", "h2_first", "doc_id", "last"],
                )

    # last: null for a window yet to be settled, -1 if several documents of its block have it, -2 and -3 the same of a
    # window in very many blocks, else the end of a settled range.
    rows = named.mapInArrow(emit, "h1 bigint, h2_first bigint, doc_id bigint, last int")
    settled, crowded = F.coalesce(F.col("last") >= 0, F.lit(False)), F.coalesce(F.col("last") <= -2, F.lit(False))
    h2 = F.shiftright("h2_first", 32)
    other = lambda over: F.col("doc_id") > F.min("doc_id").over(over) if later_only else F.coalesce(F.min("last").over(over).isin(-1, -3), F.lit(False)) | (F.max("doc_id").over(over) > F.min("doc_id").over(over))
    if not len(hot):
        # Moved by the first hash alone, so that the second one isn't moved twice; settled ranges have hashes of their own.
        kept = rows.repartition("h1").withColumn("keep", settled | other(Window.partitionBy("h1", h2))).filter("keep")
    else:
        part = F.when(crowded, 1 + F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS))).otherwise(0)
        within = Window.partitionBy("h1", "part", h2)
        first = cut(rows.withColumn("part", part).repartition("h1", "part").withColumns({"keep": settled | other(within), "head": crowded & (F.col("doc_id") == F.min("doc_id").over(within))}))
        # A part goes on with its lowest document only, which may be open still; the others are settled.
        heads = first.filter("head").repartition("h1")
        across = Window.partitionBy("h1", h2)
        again = heads.withColumn("keep", other(across) if later_only else F.max("keep").over(across) | other(across))
        columns = ["h2_first", "doc_id", "last", "keep"]
        kept = first.filter("not head").select(columns).unionAll(again.select(columns)).filter("keep")
    place = F.col("h2_first").bitwiseAND(2**32 - 1).cast("int")
    return kept.select("doc_id", place.alias("first"), F.when(settled, F.col("last")).otherwise(place + (RUN_WORDS - 1)).alias("last"))


def _inside(block: _Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At which words windows begin that hold one of the spans in their inner part, where sentences don't depend on what is around the window."""
    edge = SENTENCE_WORDS - 1
    low, high = np.maximum(b - (RUN_WORDS - 1 - edge), block.starts[block.doc[a]]), a - edge
    ok = low <= high
    marks = np.bincount(low[ok], minlength=block.n + 1)[: block.n + 1] - np.bincount(high[ok] + 1, minlength=block.n + 1)[: block.n + 1]
    return np.cumsum(marks[: block.n]) > 0


def covered_words(ranges: DataFrame, count: str) -> DataFrame:
    """doc_id and how many word positions its ranges cover; a document's ranges are at most as many as its words.

    Single windows travel as their first words only; ranges of a document are put into lists before they are moved.
    """

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single, longer = batch.column(1), batch.column(2)
            owner = np.concatenate([np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (single, longer)])
            one, pair = single.flatten().to_numpy().astype(np.int64), longer.flatten().to_numpy()
            first, last = np.concatenate((one, pair >> 32)), np.concatenate((one + RUN_WORDS - 1, pair & (2**32 - 1)))
            o = np.lexsort((first, owner))
            owner, first, last = owner[o], first[o], last[o]
            shift = owner << np.int64(40)
            reach = np.concatenate(([-1], np.maximum.accumulate(last + shift)[:-1])) if len(o) else last
            gain = np.maximum(0, last + shift - np.maximum(first + shift - 1, reach))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(owner, gain, batch.num_rows).astype(np.int64))], ["doc_id", count])

    window = F.col("last") - F.col("first") == RUN_WORDS - 1
    pair = F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("last")
    lists = ranges.groupBy("doc_id").agg(F.collect_list(F.when(window, F.col("first"))).alias("single"), F.collect_list(F.when(~window, pair)).alias("longer"))
    return lists.mapInArrow(cover, f"doc_id bigint, {count} bigint")


def without_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, sentences, removed: every text without the sentences that lie wholly in runs which a lower document has too.

    Sentences are the text's own: they end with a word that ends in one of . ; : ! ? and take the blanks after them along.
    Of equal runs the lowest document's stays. Null texts stay null, texts without repeats as they are; repeated rows come
    out repeatedly, rows without id unchanged.
    """
    ranges = shared_runs(docs, doc_id, text, later_only=True)
    lists = ranges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges")).withColumnRenamed("doc_id", "of")
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(lists, F.col("doc_id").cast("bigint") == F.col("of"), "left").select("doc_id", "text", "ranges")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for t, rs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = list(_WORD.finditer(t or ""))
                last = [i for i, w in enumerate(words) if w[0].endswith(_ENDS) or i == len(words) - 1]
                counts.append(len(last))
                covered = np.zeros(len(words) + 1, np.int64)
                for r in rs or []:
                    covered[r["first"]] += 1
                    covered[r["last"] + 1] -= 1
                sums = np.concatenate(([0], np.cumsum(np.cumsum(covered)[:-1] > 0)))
                gone = [(a, b) for a, b in zip([0, *(i + 1 for i in last)], [i + 1 for i in last], strict=False) if sums[b] - sums[a] == b - a]
                removed.append(len(gone))
                out, at = [], 0
                for a, b in gone:
                    out.append(t[at : words[a].start()])
                    at = words[b].start() if b < len(words) else len(t)
                texts.append(None if t is None else "".join([*out, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "sentences", "removed"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.mapInArrow(strip, f"doc_id {kind}, text string, sentences bigint, removed bigint")
