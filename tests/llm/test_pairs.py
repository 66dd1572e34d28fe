"""Operators on texts and vectors against brute force, on small tables with odd rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tallyspark.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from tallyspark.llm import _text, exact, jaccard, substring, topk  # noqa: E402

SPACES = re.compile(r"[\x20\x09-\x0D]+")
FORM = "doc_id long, text string, lang string, source string, n_chars long, sha string, row long"


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 7) for i, t in rows], FORM)


def some_texts(seed=3, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 70))
    out = []
    for i in range(n):
        kind = i % 6
        own = list(rng.choice(vocabulary, int(rng.integers(1, 160))))
        if kind == 0 and out:
            own = words(out[int(rng.integers(0, len(out)))][1])
            for _ in range(int(rng.integers(0, 4))):
                if own:
                    own[int(rng.integers(0, len(own)))] = "changed"
        elif kind == 1:
            own = own[:20] + passage[int(rng.integers(0, 15)) :] + own[20:]
        elif kind == 2 and len(out) > 4:
            own = words(out[int(rng.integers(0, len(out)))][1]) + own[:3]
        text = "".join(w + str(rng.choice([" ", "\n", "  ", "\t"])) for w in own)
        out.append((int(rng.integers(0, 10_000)) * 100 + i, text))
    odd = [(5, None), (6, ""), (7, " \n "), (8, "A b c"), (9, "a B c"), (None, "null id text here now " * 3), (10, "x"), (11, "long " * 3000)]
    return out + odd


@given(st.lists(st.text(alphabet="ab \n\té Z", max_size=30), max_size=8), st.booleans())
@settings(max_examples=60, deadline=None)
def test_word_hashes_follow_words(texts, lower):
    data = [t.encode() for t in texts]
    got, ends = _text.batch_word_hashes(data, lower)
    starts = [0, *ends[:-1]] if len(ends) else []
    fold = (lambda w: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)) if lower else str
    known = {}
    for t, a, b in zip(texts, starts, ends, strict=True):
        assert (got[a:b] == _text.word_hashes(t.encode(), lower)).all()
        for w, h in zip(words(t), got[a:b].tolist(), strict=True):
            assert known.setdefault(fold(w), h) == h
    assert len(set(known.values())) == len(known)


def test_blocks_do_not_matter(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)).encode() + b"x" * 300
    whole = _text.word_hashes(text)
    monkeypatch.setattr(_text, "BLOCK", 64)
    assert (_text.word_hashes(text) == whole).all()


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACES.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {(i, min(g)[3], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for *_, i in g}


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup(spark, clash):
    from pyspark.sql import functions as F

    rows = some_texts() + [(20, "a b"), (21, "ab"), (22, "a  b"), (23, "ab"), (23, "ab"), (24, "A b c\n")]
    digest = (lambda c: F.lit("same")) if clash else exact.sha256
    found = exact.mark(frame(spark, rows), digest=digest).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found} == brute_exact(rows)
    assert len(found) == len(rows) and sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_exact_dedup_keeps_rows_whole(spark):
    rows = some_texts() + [(30, "p q"), (31, "p  q"), (31, "p  q")]
    kept = exact.dedup(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in FORM.split(", ")]
    texts = [SPACES.sub("", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({SPACES.sub("", t or "") for _, t in rows})


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact.mark(empty).count() == 0 and exact.dedup(empty).count() == 0
    assert substring.remove_repeats(empty).count() == 0
    assert jaccard.Join(empty.select("doc_id", "text")).classes().count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_substring(rows, window=50):
    starts = defaultdict(set)
    big = 2**63 - 1
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            starts[tuple(w[s : s + window])].add(big if i is None else i)
    out = set()
    for i, t in rows:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if min(starts[tuple(w[s : s + window])]) < (big if i is None else i):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "SENT_ROWS", 0 if seed == 4 else 1 << 20)
    rows = some_texts(seed, 90)
    rows += [(1, "r " * 60), (2, "r " * 55 + "end"), (2, "r " * 55 + "other"), (None, rows[1][1])]
    found = substring.remove_repeats(frame(spark, rows), kept_text=True).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute_substring(rows)
    assert len(found) == len(rows) and any(r.n_removed for r in found)
    texts = {(i, hashlib.sha256(" ".join(words(t)).encode()).hexdigest()): words(t) for i, t in rows}
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(words(t))
    copies = 0
    for r in found:
        if r.phrases:  # the phrases tile the text, and each copied one stands in its source where they say
            assert sum(p.length for p in r.phrases) == r.n_words and sum(p.length for p in r.phrases if p.source is not None) == r.n_removed
            end = 0
            mine = [w for w in by_id[r.doc_id] if len(w) == r.n_words]
            for p in r.phrases:
                assert p.start == end
                end += p.length
                if p.source is not None:
                    copies += 1
                    assert p.source < (2**63 - 1 if r.doc_id is None else r.doc_id)
                    assert any(w[p.start : end] == o[p.place : p.place + p.length] for w in mine for o in by_id[p.source])
    assert copies and len(texts) <= len(rows)


def test_parse_follows_one_source_at_a_time():
    at, source, place = np.array([3, 4, 5, 6, 90]), np.array([0, 0, 0, 1, 2]), np.array([10, 11, 12, 13, 7])
    assert substring.parse(200, at, source, place) == [(0, 3, None, None), (3, 52, 0, 10), (55, 1, 1, 62), (56, 34, None, None), (90, 50, 2, 7), (140, 60, None, None)]
    assert substring.parse(5, at[:0], source[:0], place[:0]) == [(0, 5, None, None)] and substring.parse(0, at[:0], source[:0], place[:0]) == []


def brute_links(rows, k=5):
    sets = []
    for i, t in rows:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(t)]
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                label[find(a)] = find(b)
    least = {}
    for a in range(len(rows)):
        i = rows[a][0]
        least[find(a)] = min(least.get(find(a), 2**63), 2**63 if i is None else i)
    return {(rows[a][0], len(sets[a]), None if least[find(a)] == 2**63 else least[find(a)]) for a in range(len(rows))}


@pytest.mark.parametrize("options", [{}, {"least": 2, "counters": 1 << 16}, {"least": 2, "counters": 1 << 16, "combined": {2: 20, 3: 10}, "part": 2, "cell": 3, "rounds": 1}, {"rounds": 0, "worth": 1}])
def test_jaccard_join(spark, options):
    rows = some_texts(5, 90)
    base = [f"n{i}" for i in range(60)]
    for i in range(40):  # a large group of near copies, each changed elsewhere
        copy = list(base)
        copy[(i * 7) % 60] = f"m{i}"
        rows.append((500 + i, " ".join(copy)))
    docs = frame(spark, rows).select("doc_id", "text")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.Join(docs, **options).classes().collect()}
    assert found == brute_links(rows)
    assert any(c is not None and c != i for i, _, c in found)


def near_copies(n, changes, size=200, seed=9):
    """A text and n - 1 copies of it with so many words changed at random places."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(size)]
    rows = [(1, " ".join(base))]
    for i in range(1, n):
        copy = list(base)
        for at in rng.choice(size, changes, replace=False):
            copy[at] = f"c{i}x{at}"
        rows.append((i + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("changes", [2, 4, 6])
def test_jaccard_pairs_grow_with_the_group(spark, changes):
    """4 of 200 words changed: copies are just above the threshold to the original, and below it to each other."""
    pairs = []
    for n in (60, 120):
        rows = near_copies(n, changes)
        join = jaccard.Join(frame(spark, rows).select("doc_id", "text"), least=8, counters=1 << 16)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in join.classes().collect()} == brute_links(rows)
        pairs.append(join.verified_pairs)
    assert pairs[1] <= 2.5 * pairs[0] + 20


def test_jaccard_indexes_combinations_of_frequent_tokens(spark):
    rows = near_copies(30, 1, 60) + [(100 + i, f"{i} other words of a document that nobody else has {i}") for i in range(10)]
    join = jaccard.Join(frame(spark, rows).select("doc_id", "text"), least=5, counters=1 << 16)
    join.keep_tables = True
    join.classes()
    index = spark.read.parquet(f"{join.store.path}/entries")
    assert index.filter("key IS NOT NULL AND combined").count() > index.filter("key IS NOT NULL AND NOT combined").count()


def test_jaccard_joins_open_nodes_once(spark):
    """A node under many keys that are still open meets its bits once, not once a key."""
    rows = near_copies(40, 4)
    join = jaccard.Join(frame(spark, rows).select("doc_id", "text"), least=8, counters=1 << 16, rounds=0)
    join.keep_tables = True
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in join.classes().collect()} == brute_links(rows)
    found = spark.read.parquet(f"{join.store.path}/open")
    assert found.count() == found.select("node").distinct().count() > 1


def test_jaccard_long_text_and_common_passage(spark):
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(80))
    long = " ".join(map(str, rng.integers(0, 10**6, 200_000)))
    rows = [(i, f"{passage} " + " ".join(map(str, rng.integers(0, 10**6, 12)))) for i in range(40)] + [(90, long), (91, long + " more"), (92, long[: len(long) // 2])]
    docs = frame(spark, rows)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.Join(docs.select("doc_id", "text")).classes().collect()}
    assert found == brute_links(rows)
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect()} == brute_substring(rows)


def test_jaccard_dedup_keeps_one_of_each_group(spark):
    rows = [(i, t) for i, t in some_texts(6, 40) if i is not None] + [(77, "same text again and again here"), (78, "same text again and again here"), (78, "same text again and again here")]
    kept = [r.doc_id for r in jaccard.dedup(frame(spark, rows)).collect()]
    want = {c for _, n, c in brute_links(rows)} | {i for i, n, _ in brute_links(rows) if not n}
    assert sorted(kept) == sorted(want)


def blocks_of(texts, bits, short):
    import pyarrow as pa

    batches = list(jaccard._blocks(5, bits, np.empty(0, np.uint64), short)([pa.RecordBatch.from_pydict({"text": texts})]))
    return pa.Table.from_batches(batches)


@pytest.mark.parametrize("short", [True, False])
def test_jaccard_sends_nodes_by_name_beside_tokens(short):
    texts = [t for _, t in some_texts(n=60) if t]
    sizes = {jaccard.node_of(s): len(s) for s in (_text.shingle_set(_text.word_hashes(t.encode(), lower=True), 5) for t in texts) if len(s) > 1}
    table = blocks_of(texts, 10, short)
    sent = sum(len(x) for c in ("nodes", "sizes", "docs", "tokens") for x in table.column(c).to_pylist())
    assert sent <= sum(sizes.values()) * (8 if short else 16) + sum(sizes.values()) * (4 + 2) + 24 * len(sizes)


def test_jaccard_index_is_the_same_by_either_name():
    import pyarrow as pa

    def index(short, bits=4):
        table, found = blocks_of(texts, bits, short), []
        shared = pa.concat_tables([jaccard._count(bits, short)(table.filter(pa.compute.equal(table.column("range"), r))) for r in range(1 << bits)])
        for b in range(1 << bits):
            found += [str(r) for r in jaccard._index(jaccard.SHARE, jaccard.COMBINED, short)(shared.filter(pa.compute.equal(shared.column("bucket"), b))).to_pylist()]
        return sorted(found)

    texts = [t for _, t in some_texts(n=60) if t]
    assert index(True) == index(False) and len(index(True)) > 60


def test_counter_misses_nothing_frequent():
    rng = np.random.default_rng(1)
    tokens = np.concatenate([rng.integers(100, 10**9, 5000), np.repeat(7, 300), np.repeat(8, 200)]).astype(np.uint64)
    counter = jaccard.Counter(50)
    for part in np.array_split(rng.permutation(tokens), 20):
        counter.add(part)
        counter.shrink()
    got = dict(zip(counter.tokens.tolist(), counter.counts.tolist(), strict=True))
    assert 300 - len(tokens) // 50 <= got[7] <= 300 and 8 in got and len(got) <= 50


def test_topk_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 10, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(3, None), (4, [1.0] * 7 + [None]), (5, [float("nan")] * 8), (6, [1.0, 2.0]), (700, [0.5, 0.25]), (8, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(11, rows[40][1]), (12, rows[40][1]), (12, rows[40][1]), (9000, [0.0] * 8), (13, [3e38] * 8)]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    found = defaultdict(list)
    for r in topk.search(df).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    from fractions import Fraction
    from math import floor

    good = [(i, [floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {i: min(v for j, v in good if j == i) for i, _ in good if i % 100 == 0}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:10]
        assert sorted(found[i]) == [(n + 1, j, clip(-s)) for n, (s, j) in enumerate(scored)]
    assert set(found) == {i for i in asked if any(j != i and len(v) == len(asked[i]) for j, v in good)}


def test_threshold_walk_scores_few_rows_where_its_bound_allows():
    rng = np.random.default_rng(6)
    rows = np.floor(rng.normal(0, 1, (4000, 16)) * np.array([90, 60, 30] + [1] * 13) * 100)
    block, shares = topk.Block(np.arange(4000), rows), []
    for i in range(0, 4000, 400):
        block.scored = 0
        ids, scores = block.top(rows[i], i, 10)
        every = rows @ rows[i]
        every[i] = -np.inf
        assert scores.tolist() == sorted(every.tolist(), reverse=True)[:10]
        assert [j for j in ids.tolist()] == sorted(ids.tolist(), key=lambda j: (-every[j], j))
        shares.append(block.scored / 4000)
        found, some = block.top(rows[i], i, 10, floor=scores[4])  # an earlier block has rows as good as the fifth
        assert some.tolist() == [s for s in scores.tolist() if s >= scores[4]]
    assert np.median(shares) < 0.3


def test_threshold_stops_early():
    rng = np.random.default_rng(4)
    block = topk.Block(np.arange(2000), np.floor(rng.normal(0, 1, (2000, 2)) * 1024))
    ids, scores = block.top(np.array([5000.0, 1.0]), -1, 3)
    every = block.rows @ np.array([5000.0, 1.0])
    assert ids.tolist() == np.argsort(-every, kind="stable")[:3].tolist()
