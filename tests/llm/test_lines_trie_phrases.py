"""Line dedup, conversation trie and phrase mining against brute force, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

BLANK = " \t\n\x0b\f\r"
TAKEN = ("row", "u1", "u2", "keep", "n_dropped", "pos", "line", "h1", "h2", "doc", "piece", "nth", "more", "lang", "turns")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# line dedup


def documents(spark, rows, extra=TAKEN):
    """Extra columns carry the names that the operators use inside."""
    return spark.createDataFrame(
        [(i, t, *[f"{c}{k}" for c in extra]) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra),
    )


def line_rows():
    rng = random.Random(5)
    pool = [f"Line number {i} with some words" for i in range(12)] + ["short", "", "  \t", "É" * 19, "é" * 20, "É" * 20]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    hot = "\t The very SAME line in all of them. "
    rows += [(100 + i, f"{hot}\nown line of document {i} here\n{hot.lower()}") for i in range(80)]
    rows += [(None, hot), (None, None), (7, hot + "\nother text under one id"), (7, None), (400, ""), (401, "\n\n")]
    rows += [(402, "\n".join(["a line repeated inside one document"] * 300)), (403, "\n".join(hot if i % 3 else f"{i} is a line" for i in range(1000)))]
    return rows + rows[:3]


def brute_lines(rows, min_docs=3):
    def keys(text):
        return [lowered(x.strip(BLANK)) for x in (text or "").split("\n")]

    holders = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if len(k) >= 20:
                holders[k].add(i)
    out = []
    for i, t in rows:
        kept = []
        for line, k in zip((t or "").split("\n"), keys(t)):
            have = holders.get(k, ())
            keeper = max((x for x in have if x is not None), default=None)
            if len(have) < min_docs or i == keeper:
                kept.append(line)
        n = len(keys(t))
        out.append((i, n, n - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_line_dedup_against_brute_force(spark, min_docs):
    from nestrank.llm.op11_lines import drop_repeated_lines, keep_bitmaps

    rows = line_rows()
    docs, want = documents(spark, rows), brute_lines(rows, min_docs)
    maps = keep_bitmaps(docs, min_docs=min_docs).collect()
    assert ordered((r.doc_id, r.n_lines, r.n_dropped) for r in maps) == ordered(w[:3] for w in want)
    for r in maps:  # a bit for each line that goes, none for words without one
        assert sum(64 - bin(e.bits & (2**64 - 1)).count("1") for e in r.keep) == r.n_dropped
        assert all(e.bits != -1 for e in r.keep) and [e.word for e in r.keep] == sorted(e.word for e in r.keep)
    left = drop_repeated_lines(docs, min_docs=min_docs)
    assert left.columns == docs.columns
    got = {r.row: (r.doc_id, r.text) for r in left.collect()}
    for k, (i, n, dropped, text) in enumerate(want):
        assert got[f"row{k}"] == (i, text if dropped else rows[k][1])


def test_line_digests_and_small_tables(spark):
    from nestrank.llm.op11_lines import keep_bitmaps, line_digests

    rows = line_rows()
    got = line_digests(documents(spark, rows)).collect()
    assert ordered(tuple(r) for r in got) == ordered((i, n, d, sha(t)) for i, n, d, t in brute_lines(rows))
    assert line_digests(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        keep_bitmaps(documents(spark, rows), min_docs=1)


def test_line_rows_meet_the_range_shuffle_only_once(spark):
    """The secondary sort serves the windows: no exchange between them."""
    from nestrank.llm import op11_lines

    plans = []
    real = op11_lines.staged
    op11_lines.staged = lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name))[1]
    try:
        op11_lines.line_digests(documents(spark, line_rows()[:5]))
    finally:
        op11_lines.staged = real
    inside = dict(plans)["op11-inside"]
    assert inside.count("Exchange") == 1 and "rangepartitioning" in inside and inside.count("Sort [") == 1


# conversation trie


def brute_trie(turns, group=20, heads=4):
    own = collections.defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)

    def saved(p):
        return (len(members[p]) - 1) * len(re.findall("[^ \t-\r]+", p[-1][1])) if p else 0

    sums = collections.defaultdict(lambda: [0, 0])
    for p in members:
        for d in range(len(p) + 1):
            sums[p[:d]][0] += children[p] == 0
            sums[p[:d]][1] += saved(p)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], *sums[p],
         sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))))
        for p, m in members.items()
    ]


def turn_rows(seed, convs=90):
    rng = random.Random(seed)
    texts = ["hello there", "yes", "no  way\tout", "", None, "a longer answer with more words", "é ü"]
    out = []
    for c in range(convs):
        copy = rng.random() < 0.4
        length = 4 if copy else rng.randrange(1, 9)
        for t in range(length):
            role, text = ("user" if t % 2 == 0 else None), texts[t % 3] if copy else rng.choice(texts)
            out.append((c + (40 if c > 60 else 0), t if t else None, role, text))
    out += [(None, 0, "user", "nobody's turn"), (-3, 0, "user", "hello there"), (-20, 0, "user", "yes"), (5000, 1, None, None)]
    return out


@pytest.mark.parametrize("block_turns", [1, 7, 40, 100_000])
def test_trie_against_brute_force(spark, block_turns):
    """Small blocks: almost every node is an edge node of some block."""
    from nestrank.llm.op12_trie import RESULT, conversation_trie

    rows = turn_rows(block_turns)
    turns = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int"
    )
    got = conversation_trie(turns, block_turns)
    assert got.columns == list(RESULT)
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_trie(rows))


def test_trie_small_tables(spark):
    from nestrank.llm.op12_trie import conversation_trie

    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], kind)).count() == 0
    # conversation 3 keeps none of its two turns, and its group has no first conversation
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)
    rows = [(lone, 0, "user", "a b"), (lone, 1, "assistant", "c")]
    got = conversation_trie(spark.createDataFrame(rows, kind)).collect()
    assert [tuple(r) for r in got] == brute_trie(rows)
    long = [(0, i, "user", f"turn {i} of a long talk") for i in range(3000)] + [(20, i, "user", f"turn {i} of a long talk") for i in range(2500)]
    got = conversation_trie(spark.createDataFrame(long, kind)).collect()
    assert len(got) == 3001 and sum(r.n_children == 0 for r in got) == 1


def test_ternary_tree_is_balanced_by_medians():
    from nestrank.llm.op12_trie import TernaryTree, median_order

    assert sorted(median_order(100)) == list(range(100))
    tree = TernaryTree()
    for i in median_order(1000):
        tree.insert([i, 5])
    deepest, stack = 0, [(tree.down[0], 1)]
    while stack:
        node, depth = stack.pop()
        if node >= 0:
            deepest = max(deepest, depth)
            stack += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10 and sorted(tree.turn[n] for n in tree.children(0)) == list(range(1000))


# phrases


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["new", "york", "city", "the", "of", "É", "é", "a"]
    rows = []
    for _ in range(220):
        text = " ".join(rng.choice(words) if rng.random() < 0.7 else rng.choice(["New York City hall", "of\tthe", "x. y", "z\nq", ",;"]) for _ in range(rng.randrange(0, 30)))
        rows.append((rng.choice(["en", "de", None, ""]), text))
    return rows + [("en", None), ("en", ""), ("fr", "only once"), ("en", "very long " * 4000), ("en", "the" + " the" * 500)]


def brute_phrases(rows, min_count=30, cover=80, limit=2000):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text or "")):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                counts[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        covered = collections.Counter()
        for p, a in good.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    covered[p[i:i + n]] = max(covered[p[i:i + n]], a)
        ranked = []
        for p, a in good.items():
            if 100 * covered[p] < cover * a:
                score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -score))
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_phrases_against_brute_force(spark, shards):
    from nestrank.llm.op13_phrases import collocations

    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    got = collocations(docs, shards=shards, limit=50).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute_phrases(rows, limit=50)) and got
    assert collocations(docs.limit(0)).count() == 0


def test_phrases_across_blocks_and_false_hits(spark):
    """Blocks of a few words, and bitmaps so small that nearly every test hits."""
    from nestrank.llm import op13_phrases as op

    words = [w for t in ["new york city hall . of the", "a b c"] * 40 for w in op.words_of(t.encode())]
    old = op.BLOCK_WORDS
    try:
        op.BLOCK_WORDS, rows, block = 12, [], op.Block()
        for i in range(0, len(words), 5):
            part = words[i:i + 5]
            if not block.add(part):
                context = block.context()
                rows.append(block.row(0, "en"))
                block = op.Block(context)
                assert block.add(part)
        rows.append(block.row(0, "en"))
    finally:
        op.BLOCK_WORDS = old
    import numpy as np

    full = {n: [(0, np.full(64, 2**64 - 1, dtype=np.uint64))] for n in (1, 2, 3)}
    got = collections.Counter()
    for row in rows:
        for step in (0, 1):  # one shard: words in the first round, longer phrases in the second
            for _, phrases, since, counts in op.block_counts(row, step, 1, full if step else {}):
                assert since == step
                got.update(dict(zip(phrases, counts.tolist())))
    assert got[b"new york city hall"] == 40 and got[b"of the"] == 40 and got[b"a b c"] == 40 and got[b"the"] == 40
    assert b"hall of" not in got and b"the a" not in got

    rows = phrase_rows(9)
    least, most = op.MIN_BITS, op.MAX_BITS
    try:
        op.MIN_BITS = op.MAX_BITS = 64
        docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
        got = op.collocations(docs).collect()
    finally:
        op.MIN_BITS, op.MAX_BITS = least, most
    assert ordered(tuple(r) for r in got) == ordered(brute_phrases(rows))
