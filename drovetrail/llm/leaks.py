"""Evaluation passages inside a training corpus, by a stored positional inverted index of the corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, stored

#: Consecutive words that make a leak.
RUN_WORDS = 12
#: Words of documents in one segment of the index, and the greatest place in one.
SEGMENT_WORDS, SEGMENT_SPAN = 1 << 21, 1 << 30
#: Most words of items of which every executor gets a copy to pick postings by; beyond that they are picked by a shuffle.
SENT_TERMS = 1 << 20
#: Places left free between documents of a segment, so that no run and no neighbourhood goes from one into the next.
GAP = 1 << 10

_WORDS = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORDS = re.compile(r"[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters and numbers after NFKC normalisation and lower-casing; of null none."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORDS.findall(text.lower())
    return _WORDS.findall(unicodedata.normalize("NFKC", text).lower())


class _Numbers(dict):
    """Numbers of words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def build_index(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """The postings of all words of all texts, stored at a path (by default in the shared folder) for any number of searches.

    A segment covers some consecutive documents whole. Of each word in it there is a row (segment, term, n, places) with
    its ascending places; one more row (null term) has the segment's documents and the places at which they begin. A
    document's place and a word's position in it make a place; of a list the first is stored and how far each is from the
    one before. Texts without words aren't in the index.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["segment", "term", "n", "places", "docs"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        numbers, ids, starts, terms, places, held, at, id_type = _Numbers(), [], [], [], [], 0, 0, pa.int64()

        def segment() -> Iterator[pa.RecordBatch]:
            number = pa.array([base + count])
            yield pa.RecordBatch.from_arrays([number, pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), pa.array([np.diff(starts, prepend=0)], pa.list_(pa.int32())), pa.array([ids], pa.list_(id_type))], names)
            t = np.concatenate(terms)
            order, sizes = np.argsort(t, kind="stable"), np.bincount(t)
            ends, sorted_places = np.cumsum(sizes), np.concatenate(places)[order]
            steps = np.diff(sorted_places, prepend=0)
            steps[ends[:-1]] = sorted_places[ends[:-1]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(steps.astype(np.int32)))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base + count)), pa.array(list(numbers), pa.string()), pa.array(sizes.astype(np.int32)), lists, pa.nulls(n, pa.list_(id_type))], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words_of(t.as_py())
                if not found:
                    continue
                ids.append(i)
                starts.append(at)
                terms.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                places.append(np.arange(at, at + len(found), dtype=np.int32))
                held, at = held + len(found), at + len(found) + GAP
                if held >= SEGMENT_WORDS or at >= SEGMENT_SPAN:
                    yield from segment()
                    count, held, at = count + 1, 0, 0
                    for x in (numbers, ids, starts, terms, places):
                        x.clear()
        if ids:
            yield from segment()

    rows = docs.select(F.col(doc_id).alias("doc_id"), text).filter(F.col(text).isNotNull()).mapInArrow(index, f"segment bigint, term string, n int, places array<int>, docs array<{kind}>")
    return stored(rows, "postings", path)


def read_index(spark, path: str) -> DataFrame:
    """An index that was stored before."""
    return spark.read.parquet(path)


def item_words(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """item_id, part (a number of the passage, should an item have several) and words; repeated rows count once."""
    kind = items.schema[item_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.string()))], ["item_id", "words"])

    found = items.select(F.col(item_id).alias("item_id"), passage).filter(F.col(passage).isNotNull()).mapInArrow(split, f"item_id {kind}, words array<string>")
    return found.withColumn("part", F.xxhash64("words")).dropDuplicates(["item_id", "part"])


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the given terms occurs in all texts; terms that don't occur are left out."""
    return index.select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))


def _postings(lists: pa.Table) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, list]:
    """Of a segment: numbers of its terms, edges of their postings, all postings as keys (term, place) in order, and its documents."""
    head = lists.filter(pa.compute.is_null(lists.column("term")))
    rest = lists.filter(pa.compute.is_valid(lists.column("term")))
    steps = rest.column("places").combine_chunks()
    sizes = np.asarray(steps.value_lengths(), np.int64)
    sums = np.concatenate(([0], np.cumsum(steps.flatten().to_numpy(), dtype=np.int64)))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    keys = (np.repeat(np.arange(len(sizes)), sizes) << 32) | (sums[1:] - np.repeat(sums[edges[:-1]], sizes))
    starts = np.cumsum(head.column("places").combine_chunks().flatten().to_numpy(), dtype=np.int64)
    return {t: i for i, t in enumerate(rest.column("term").to_pylist())}, edges, keys, starts, head.column("docs").combine_chunks().flatten()


def _has(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return np.take(keys, np.searchsorted(keys, wanted), mode="clip") == wanted if len(keys) else np.zeros(len(wanted), bool)


def exact_matches(keys: np.ndarray, edges: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, marks: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks and places at which a run of an item's words goes over the mark.

    ``words`` are term numbers of all items one after the other (-1: not in the segment); ``marks`` are the rarest words'
    indices in it, ``low`` and ``high`` the ends of their items. From the postings of the marks on, the lists of the
    words beside them, moved by their offsets, are met step by step, by what is left only; all items at a time.
    """
    sizes = edges[words[marks] + 1] - edges[words[marks]]
    mark = np.repeat(np.arange(len(marks)), sizes)
    first = edges[words[marks]]
    place = keys[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] & (2**32 - 1)
    length = np.ones(len(mark), np.int64)
    for way in (1, -1):
        alive = np.arange(len(mark))
        for d in range(1, run):
            at = marks[mark[alive]] + way * d
            ok = (at >= low[mark[alive]]) & (at < high[mark[alive]])
            alive, at = alive[ok], at[ok]
            term, to = words[at], place[alive] + way * d
            alive = alive[(term >= 0) & (to >= 0) & _has(keys, (term << 32) | to)]
            if not len(alive):
                break
            length[alive] += 1
    hit = length >= run
    return mark[hit], place[hit]


def near_matches(postings: list[np.ndarray], first: int, least: int, reach: int) -> np.ndarray:
    """Places of words, given rarest first, with ``least`` of them within ``reach`` words, themselves included.

    Of so many words some are left out of a match at most, so one of the ``first`` is near; only places near those are
    looked at.
    """
    start = np.concatenate(postings[:first])
    found = []
    for own in postings:
        a, b = np.searchsorted(own, start - reach), np.searchsorted(own, start + reach, "right")
        n = b - a
        at = own[np.unique(np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum()))]
        near = np.zeros(len(at), int)
        for other in postings:
            near += np.searchsorted(other, at + reach, "right") > np.searchsorted(other, at - reach)
        found.append(at[near >= least])
    return np.concatenate(found)


def _search(index: DataFrame, wanted: DataFrame, terms: DataFrame, match, sent_terms: int | None = None) -> DataFrame:
    """doc_id, item_id of what ``match`` finds in each segment.

    ``wanted``: segment, item_id and what is looked for; ``terms``: the words that it may take (cut). Of the index, only the
    postings of these words move, each once.
    """
    own = index.select(F.col("segment").alias("at"), "term", "places", "docs")
    distinct = terms.select("term").distinct()
    small = distinct.count() <= (SENT_TERMS if sent_terms is None else sent_terms)
    lists = own.filter("term is not null").join(F.broadcast(distinct) if small else distinct, "term", "left_semi")
    heads = own.filter("term is null")
    kind, item = index.schema["docs"].dataType.elementType.simpleString(), wanted.schema["item_id"].dataType.simpleString()

    from pyspark.sql.pandas.types import to_arrow_type

    nothing = pa.table({"doc_id": pa.array([], to_arrow_type(index.schema["docs"].dataType.elementType)), "item_id": pa.array([], to_arrow_type(wanted.schema["item_id"].dataType))})

    def search(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        if not (lists.num_rows and wanted.num_rows):
            return nothing
        terms, edges, keys, starts, docs = _postings(lists)
        items, places = match(terms, edges, keys, wanted)
        hits = np.unique(np.stack((np.searchsorted(starts, places, "right") - 1, items)), axis=1).astype(np.int64)
        return pa.table({"doc_id": docs.take(pa.array(hits[0])), "item_id": wanted.column("item_id").take(pa.array(hits[1])).combine_chunks()})

    found = lists.select("at", "term", "places", "docs").unionAll(heads.select("at", "term", "places", "docs")).groupBy("at").cogroup(wanted.groupBy("segment"))
    return found.applyInArrow(search, f"doc_id {kind}, item_id {item}").distinct()


def leaked_items(index: DataFrame, items: DataFrame, item_id: str, passage: str, run: int = RUN_WORDS) -> DataFrame:
    """doc_id, item_id: documents that hold at least ``run`` consecutive words of an item's passage, each pair once.

    Every run of an item's words has a rarest one, by how often it occurs in all texts; runs with a word that occurs nowhere are
    left out. The postings of these rarest words name the segments and places to look at; from there the lists of
    the words beside them are intersected, moved by their offsets. Null, empty and short texts or passages hold no run;
    equal passages each match; repeated rows count once.
    """
    if run > GAP:
        raise ValueError(f"runs are at most {GAP} words")
    listed = cut(item_words(items, item_id, passage).filter(F.size("words") >= run))
    words = listed.select("item_id", "part", F.posexplode("words").alias("pos", "term"))
    counts = cut(term_counts(index, words))
    placed = words.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("item_id", "part").orderBy("pos").rowsBetween(0, run - 1)
    runs = placed.select("item_id", "part", F.min(F.struct("n", "pos", "term")).over(window).alias("rarest"), F.count("*").over(window).alias("k")).filter((F.col("k") == run) & (F.col("rarest.n") > 0))
    marks = cut(runs.select("item_id", "part", "rarest.pos", "rarest.term").distinct())
    # A segment and an item with its marks there: at most as many as the item has words.
    met = index.select("segment", "term").join(marks, "term").groupBy("segment", "item_id", "part").agg(F.collect_set("pos").alias("marks"))
    wanted = cut(met.withColumnRenamed("part", "p").withColumnRenamed("item_id", "i").join(listed, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("p") == F.col("part"))).select("segment", "item_id", "words", "marks"))
    beside = marks.select("item_id", "part", "pos").withColumnsRenamed({"item_id": "i", "part": "p"}).join(listed, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("p") == F.col("part")))
    beside = cut(beside.select(F.explode(F.slice("words", F.greatest(F.col("pos") - (run - 1), F.lit(0)) + 1, F.least(F.col("pos"), F.lit(run - 1)) + run)).alias("term")).distinct())

    def match(terms: dict[str, int], edges: np.ndarray, keys: np.ndarray, wanted: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists, marks = wanted.column("words").combine_chunks(), wanted.column("marks").combine_chunks()
        words = np.array([terms.get(w, -1) for w in lists.flatten().to_pylist()], np.int64)
        ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64))
        item = np.repeat(np.arange(len(lists)), np.asarray(marks.value_lengths()))
        low = (ends - np.asarray(lists.value_lengths(), np.int64))[item]
        mark, place = exact_matches(keys, edges, words, low, ends[item], marks.flatten().to_numpy() + low, run)
        return item[mark], place

    return _search(index, wanted, beside, match)


def near_items(index: DataFrame, items: DataFrame, item_id: str, passage: str, rare: int = 10, least: int = 9, reach: int = 60) -> DataFrame:
    """doc_id, item_id: documents with at least ``least`` of an item's ``rare`` rarest words within ``reach`` words of one of them.

    Rarity is how often a word occurs in all texts (repeated rows count repeatedly), of equal ones the lesser word is the
    rarer; words that occur in no text don't count. So the choice doesn't depend on partitions or segments.
    """
    if reach >= GAP:
        raise ValueError(f"the reach is below {GAP} words")
    words = item_words(items, item_id, passage).select("item_id", "part", F.explode("words").alias("term")).distinct()
    words = cut(words)
    counts = cut(term_counts(index, words))
    ranked = words.join(counts, "term").withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy("n", "term"))).filter(F.col("rank") <= rare)
    chosen = ranked.groupBy("item_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("words")).filter(F.size("words") >= least)
    # Of n words all but n - least are near each other, so one of the first n - least + 1 is.
    chosen = cut(chosen.select("item_id", "part", F.transform("words", lambda w: w["term"]).alias("words"), (F.size("words") - least + 1).alias("first")))
    first = chosen.select("item_id", "part", "words", "first", F.explode(F.slice("words", F.lit(1), F.col("first"))).alias("term"))
    wanted = cut(index.select("segment", "term").join(first, "term").select("segment", "item_id", "part", "words", "first").distinct())

    def match(terms: dict[str, int], edges: np.ndarray, keys: np.ndarray, wanted: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        none, items, places = np.zeros(0, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        of = lambda w: keys[edges[terms[w]] : edges[terms[w] + 1]] & (2**32 - 1) if w in terms else none
        for i, (ws, n) in enumerate(zip(wanted.column("words").to_pylist(), wanted.column("first").to_pylist(), strict=True)):
            lists = [of(w) for w in ws]
            if sum(len(x) > 0 for x in lists) >= least:
                at = near_matches(lists, n, least, reach)
                items.append(np.full(len(at), i))
                places.append(at)
        return np.concatenate(items), np.concatenate(places)

    return _search(index, wanted.drop("part"), cut(chosen.select(F.explode("words").alias("term")).distinct()), match)
