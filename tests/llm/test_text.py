"""The text operators against brute force and exact round trips."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pytest
import regex

tokens = pytest.importorskip("drovetrail.llm.tokens")
from drovetrail.llm import leaks, spans  # noqa: E402

ODD = ["", None, " ", "\n\n  x", "<|endoftext|> is text", "naïve ﬁne ① ÅÅ 東京 😀   z", "it's we'll 'T ''s don't", "a" * 5000, "  lead\r\ntrail  \t", "ﬀ½ ²³ İstanbul ǅ", "'‍' x́y", "1234 5,678.90%"]


def texts(n=40, seed=7):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "don't", "42", "x.", "end;", "—", "ﬁ"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 90))) for _ in range(n)] + ODD


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id bigint, text string, ids string")


@pytest.mark.parametrize(("block", "rows_per_task"), [(1 << 20, 1 << 19), (50, 5), (1, 1)])
def test_ids_are_those_of_the_tokenizer_and_decode(spark, monkeypatch, block, rows_per_task):
    """Whatever shares a block, and with frequent words spread over tasks."""
    import functools

    import public_tokenizers as P
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "BLOCK_WORDS", block)
    monkeypatch.setattr(tokens, "salted_lookup", functools.partial(tokens.salted_lookup, rows_per_task=rows_per_task))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = texts()
    got = tokens.encode_corpus(table(spark, rows), "doc_id", "text")
    ids = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert ids == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(rows)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(got, "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(rows)}


def test_decoding_of_repeated_null_and_unknown(spark):
    rows = spark.createDataFrame([(1, [15496, 995]), (1, [15496, 995]), (1, []), (None, [0]), (2, None)], "doc_id bigint, ids array<int>")
    got = [tuple(r) for r in tokens.decode_corpus(rows, "doc_id", "ids").collect()]
    assert sorted(got, key=repr) == sorted([(1, "Hello world"), (1, "Hello world"), (1, ""), (None, "!"), (2, None)], key=repr)
    with pytest.raises(Exception, match="no such id"):
        tokens.decode_corpus(spark.createDataFrame([(1, [50300])], "doc_id bigint, ids array<int>"), "doc_id", "ids").collect()


def test_repeated_documents_and_null_ids_are_encoded(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (None, "Hello"), (None, None)], "doc_id bigint, text string")
    got = sorted(map(repr, tokens.encode_corpus(rows, "doc_id", "text").collect()))
    assert len(got) == 4 and sum("ids=[15496, 995]" in g for g in got) == 2 and sum("ids=[]" in g for g in got) == 1


def test_no_documents(spark):
    none = table(spark, ["a"]).limit(0)
    assert tokens.encode_corpus(none, "doc_id", "text").count() == 0
    items = spark.createDataFrame([(1, "a " * 20)], "item_id bigint, passage string")
    assert leaks.leaked_items(leaks.build_index(none, "doc_id", "text"), items, "item_id", "passage").count() == 0
    assert spans.covered_words(spans.shared_runs(none, "doc_id", "text"), "n").count() == 0


@pytest.mark.parametrize(("parts", "segment"), [(1, 1 << 21), (7, 1 << 21), (3, 200), (1, 1)])
def test_leaks_by_brute_force(spark, monkeypatch, parts, segment):
    monkeypatch.setattr(leaks, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(leaks, "SENT_TERMS", 0 if parts == 7 else 1 << 20)
    rnd = random.Random(8)
    vocab = [f"t{i}" for i in range(25)] + ["the", "of", "Ünit", "№5"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(8, 30)))) for i in range(25)] + [(100, None), (101, ""), (102, "t1 " * 40), (103, "t1 " * 12)]
    docs = []
    for _ in range(120):
        words = [rnd.choice([*vocab, "zz", "qq"]) for _ in range(rnd.randrange(60))]
        p = (rnd.choice(items)[1] or "").split()
        a = rnd.randrange(max(1, len(p)))
        at = rnd.randrange(len(words) + 1)
        docs.append(rnd.choice([" ", "-", "\n"]).join(words[:at] + [w.upper() for w in p[a : a + rnd.randrange(5, 30)]] + words[at:]))
    docs += [None, "", "t1," * 500, docs[0]]
    split = lambda x: regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", x or "").lower())
    want = set()
    for d, x in enumerate(docs):
        w = split(x)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, p in items for q in [split(p)] if any(tuple(q[k : k + 12]) in grams for k in range(len(q) - 11))}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    index = leaks.build_index(df.repartition(parts), "doc_id", "text")
    got = [tuple(r) for r in leaks.leaked_items(index, it, "item_id", "passage").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert leaks.leaked_items(index, it.limit(0), "item_id", "passage").count() == 0


def test_index_is_kept_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "b c"), (None, "a b c")], "doc_id bigint, text string")
    leaks.build_index(df, "doc_id", "text", str(tmp_path / "index"))
    index = leaks.read_index(spark, str(tmp_path / "index"))
    it = spark.createDataFrame([("x", "A, b! c"), ("x", "A, b! c"), ("x", "z b c"), (None, "c d"), ("y", "c a")], "item_id string, passage string")
    assert {tuple(r) for r in leaks.leaked_items(index, it, "item_id", "passage", run=2).collect()} == {(1, "x"), (3, "x"), (None, "x"), (1, None)}
    assert {r["term"]: r["n"] for r in leaks.term_counts(index, spark.createDataFrame([("a",), ("a",), ("c",), ("q",)], "term string")).collect()} == {"a": 2, "c": 3}


def test_near_items_find_planted_passages(spark):
    """Passages with every eighth word lost or another: most are found, and little else."""
    rnd = random.Random(31)
    vocab = [f"w{i}" for i in range(3000)]
    draw = lambda n: [vocab[int(rnd.random() ** 3 * 3000)] for _ in range(n)]
    items, docs, planted = [draw(50) for _ in range(30)], [], set()
    for d in range(300):
        words = draw(150)
        if d % 3 == 0:
            i = rnd.randrange(30)
            noisy = [x for w in items[i] for x in ([w] if rnd.random() > 0.06 else rnd.choice([[], draw(1)]))]
            words[40:40] = noisy
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    index = leaks.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, passage string")
    got = {tuple(r) for r in leaks.near_items(index, it, "item_id", "passage").collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got & planted) >= 0.95 * len(got)


@pytest.mark.parametrize(("parts", "segment"), [(1, 1 << 21), (7, 1 << 21), (3, 200), (1, 1)])
def test_near_items_by_brute_force(spark, monkeypatch, parts, segment):
    """Rarity is that of all texts, whichever texts share a partition or a segment, and any of the rare words may be the middle."""
    monkeypatch.setattr(leaks, "SEGMENT_WORDS", segment)
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(12)]
    items = [(i, " ".join(rnd.sample(common, 6) + [f"r{i}x{k}" for k in range(10)])) for i in range(8)] + [(90, "few words"), (91, " ".join(f"nowhere{k}" for k in range(12)))]
    docs = []
    for _ in range(150):
        i = rnd.randrange(8)
        words = [f"r{i}x{k}" for k in rnd.sample(range(10), rnd.choice([2, 8, 9, 10]))] + rnd.sample(common, rnd.randrange(12))
        rnd.shuffle(words)
        gap = rnd.choice([0, 5, 9, 12, 15])
        docs.append(" ".join(x for w in words for x in [w, *rnd.choices(common[:3] + ["fill"], k=gap)]))
    docs += [None, "", " ".join(common) * 3]
    lists, n = [(d or "").split() for d in docs], {}
    for w in itertools.chain(*lists):
        n[w] = n.get(w, 0) + 1
    want = set()
    for i, p in items:
        rare = sorted({w for w in p.split() if w in n}, key=lambda w: (n[w], w))[:10]
        for d, ws in enumerate(lists):
            at = [k for k, w in enumerate(ws) if w in rare]
            if any(len({ws[k] for k in at if abs(k - m) <= 60}) >= 9 for m in at):
                want.add((d, i))
    df, it = table(spark, docs).repartition(parts), spark.createDataFrame(items, "item_id bigint, passage string")
    got = [tuple(r) for r in leaks.near_items(leaks.build_index(df, "doc_id", "text"), it, "item_id", "passage").collect()]
    assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < 150


def brute_shared(rows, later_only=False):
    where, kept = {}, []
    for i, t in enumerate(rows):
        w = re.findall(r"[^ \t\r\n]+", t or "")
        g = [tuple(w[k : k + 64]) for k in range(len(w) - 63)]
        kept.append((i, g))
        for x in g:
            where.setdefault(x, set()).add(i)
    out = {}
    for i, g in kept:
        cover = {p for k, x in enumerate(g) if (min(where[x]) < i if later_only else len(where[x]) > 1) for p in range(k, k + 64)}
        if cover:
            out[i] = len(cover)
    return out


def span_texts():
    rnd = random.Random(9)
    fresh = lambda n: [f"u{rnd.randrange(10**9)}{rnd.choice(['', '', '.', ','])}" for _ in range(n)]
    stock = [fresh(n) for n in (63, 64, 65, 70, 90, 200, 20)]
    rows = []
    for _ in range(120):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            s = rnd.choice(stock)
            cut = rnd.randrange(0, 30) if rnd.random() < 0.5 else 0
            words += fresh(rnd.randrange(0, 40)) + s[cut:]
        rows.append(rnd.choice([" ", "\n", "\t "]).join(words))
    return [*rows, "same " * 300, "same " * 200, "same " * 64, rows[0], rows[0], None, "", " \n", "ab ba " * 100, "x y " * 70, "x y " * 70]


@pytest.mark.parametrize(("later_only", "hot", "bits", "words"), [(False, 1024, 1 << 30, 1 << 20), (True, 1024, 1 << 30, 1 << 20), (False, 1, 1 << 30, 300), (True, 1, 1 << 30, 300), (False, 2, 1 << 16, 1), (False, 1024, 1 << 3, 1 << 20)])
def test_shared_spans_by_brute_force(spark, monkeypatch, later_only, hot, bits, words):
    """Also with windows compared in parts, small blocks, and a filter that lets everything pass."""
    monkeypatch.setattr(spans, "BLOCK_WORDS", words)
    monkeypatch.setattr(spans, "MOST_BITS", bits)
    rows = span_texts()
    df = table(spark, rows).repartition(5)
    got = spans.covered_words(spans.shared_runs(df, "doc_id", "text", later_only, hot), "n")
    assert {r["doc_id"]: r["n"] for r in got.collect()} == brute_shared(rows, later_only)


def test_sentences_of_later_repeats_are_removed(spark):
    rnd = random.Random(14)
    sentence = lambda: " ".join(f"q{rnd.randrange(10**9)}" for _ in range(rnd.randrange(5, 25))) + "."
    stock = [sentence() for _ in range(12)]
    rows = [" \n".join([sentence(), *stock[a : a + 8], sentence()]) for a in (0, 2, 4)] + ["  ".join([*stock, "no end"]), None, "", "one. two. three", rows_of_words(80)]
    got = {r["doc_id"]: (r["text"], r["sentences"], r["removed"]) for r in spans.without_repeats(table(spark, rows), "doc_id", "text").collect()}
    covered = {}
    for i, t in enumerate(rows):
        w = re.findall(r"[^ \t\r\n]+", t or "")
        for k in range(len(w) - 63):
            if any(tuple(w[k : k + 64]) in covered.get(j, set()) for j in range(i)):
                covered.setdefault((i, "at"), set()).update(range(k, k + 64))
        covered[i] = {tuple(w[k : k + 64]) for k in range(len(w) - 63)}
    for i, t in enumerate(rows):
        parts = re.findall(r"[^ \t\r\n]+[ \t\r\n]*", t or "")
        keep, at, now, gone, n = re.match(r"[ \t\r\n]*", t or "")[0], 0, [], 0, 0
        for k, x in enumerate(parts):
            now.append(x)
            if x.strip().endswith((".", ";", ":", "!", "?")) or k == len(parts) - 1:
                n += 1
                if set(range(at, k + 1)) <= covered.get((i, "at"), set()):
                    gone += 1
                else:
                    keep += "".join(now)
                now, at = [], k + 1
        assert got[i] == (None if t is None else keep, n, gone), i
    assert sum(g[2] for g in got.values()) > 8


def rows_of_words(n):
    return " ".join(f"z{i}" for i in range(n))


def test_blocks_are_settled_together(spark, monkeypatch):
    rows = span_texts()
    got = spans.covered_words(spans.shared_runs(table(spark, rows).coalesce(1), "doc_id", "text"), "n")
    assert {r["doc_id"]: r["n"] for r in got.collect()} == brute_shared(rows)


def test_every_shared_window_holds_a_common_span():
    """What candidates rest on: however a run of 64 words is set, both texts cut a common span out of it."""
    rnd = random.Random(10)
    for _ in range(300):
        run = [str(rnd.randrange(rnd.choice([3, 50, 10**6]))) + rnd.choice(["", ".", ","]) for _ in range(64)]
        hashes, found = spans._Hashes(), []
        for _ in range(2):
            a, b = rnd.randrange(40), rnd.randrange(40)
            words = [f"l{rnd.random()}" for _ in range(a)] + run + [f"r{rnd.random()}" for _ in range(b)]
            block = spans._Block([1], [np.array([hashes[w] for w in words], np.int64)])
            x, y = block.spans(spans.SENTENCE_WORDS, spans.SPAN_SENTENCES)
            inner = (x >= a + 10) & (y <= a + 53)
            found.append(set(zip((x[inner] - a).tolist(), (y[inner] - a).tolist(), strict=True)))
        assert found[0] and found[0] == found[1]
