"""Archives, URL filters, packing, mixing, classifiers and the pipeline on small tables."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("tallyspark.llm")
from tallyspark.llm import _files, _text, exact, mixing, packing, quality, subword, toxicity, urlfilter, warc  # noqa: E402
from tallyspark.llm._store import Scratch  # noqa: E402

PAGES = [
    (3, "http://a.example/x y", "<p>one</p>"), (1, "https://b.example/", "<p>one</p>"), (2, None, None), (4, "no scheme", ""), (5, "http://c.example", "é\r\n\r\nWARC/1.1"),
    (1, "https://b.example/", "<p>one</p>"), (None, "http://d.example/", "null id"), (9, "http://d.example/", "null id"), (10, "u", "x" * 50_000),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "extra", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, seq int")


def archived(spark, rows, least=0, **options):
    store = Scratch(spark, "test-warc")
    raw = warc.write_raw(pages(spark, rows), store, **options)
    return warc.normalise(raw, warc.revisits(raw, store, least), store)


@pytest.mark.parametrize("size", [1, 200, 1 << 30])
def test_warc_round_trip(spark, size):
    archives = archived(spark, PAGES, file_bytes=size)
    found = warc.read_back(archives).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == Counter((i, len((h or "").encode()), digest(h)) for i, _, h in PAGES)
    by = defaultdict(list)
    for r in found:
        by[r.payload_digest].append(r)
    for group in by.values():
        first = [r for r in group if r.record_type == "response"]
        least = min((r.page_id for r in group if r.page_id is not None), default=None)
        assert len(first) == 1 and first[0].page_id == least
        assert all(r.refers_to == least for r in group if r.record_type == "revisit") and first[0].refers_to is None


def test_warc_members_are_gzip_files_of_their_own(spark):
    row = archived(spark, PAGES).first()
    with _files.open_stream(row.archive) as f:
        data = f.read()
    whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
    members, rest = [], data
    while rest:
        z = zlib.decompressobj(31)
        members.append(z.decompress(rest))
        rest = z.unused_data
    assert b"".join(members) == whole and len(members) == row.records and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)


def test_warc_small_payloads_stay_responses(spark):
    assert Counter(r.record_type for r in warc.read_back(archived(spark, PAGES, least=1000)).collect()) == {"response": len(PAGES)}


def test_warc_reads_many_members_and_refuses_cut_files():
    raw = [warc.record("response", i, None, "X", b"p" * i, i) for i in range(5)]
    stream = io.BytesIO(b"".join(gzip.compress(r) for r in raw))
    assert list(warc.records(warc.inflate(stream))) == raw
    with pytest.raises(ValueError):
        list(warc.records([raw[3][:-10]]))


def test_warc_empty(spark):
    assert warc.read_back(archived(spark, [])).count() == 0


URLS = ["http://net/", "https://A.B.Net/x?q#f", "http://example.net/en/1", "http://x.example.net/en", "http://example.com/de/", "http://sub.example.com/de/x", "http://example.com/fr/", "ftp://a.org/fr/9", "http://org", "http://anet/", "http://.net/", "nothing", None, "", "://net/", "http://net?x=http://org/fr/", "http://x\ny.net/\n", "http://example.net//en/"]


def test_url_filters(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://q.net/", None)]
    found = urlfilter.judge(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r for r in found}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
            path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, default=(0, None, "allow"))
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == (host, path, want[1], want[2]), u


def test_cascade_is_exact(spark):
    universe = spark.range(3000).selectExpr("concat('key', id) AS key")
    listed = universe.filter("int(substring(key, 4)) % 37 = 0")
    cascade = urlfilter.Cascade(listed, universe)
    assert len(cascade.levels) >= 1
    assert universe.filter(cascade.has(universe.key)).collect() == listed.collect()
    none = urlfilter.Cascade(listed.limit(0), universe)
    assert universe.filter(none.has(universe.key)).count() == 0


def test_url_rules_from_a_table(spark):
    rules = spark.range(2000).selectExpr("if(id % 3 = 0, 'allow', 'block') AS verdict", "concat('h', id, '.example') AS host", "'/' AS path", "1 AS extra")
    rules = rules.unionByName(spark.createDataFrame([("allow", "twice.example", "/", 1), ("block", "twice.example", "/", 1), (None, "h5.example", "/", 2)], "verdict string, host string, path string, extra int"))
    rows = [(i, f"http://a.h{i}.example/x", "") for i in range(2500)] + [(9000, "http://twice.example/", ""), (9001, "http://" + "." * 200_000 + "h1.example/", ""), (9002, "http://h1.example" + "/y" * 100_000, "")]
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages(spark, rows), rules).collect()}
    assert len(found) == len(rows)
    for i in range(2500):
        assert found[i] == ((f"h{i}.example/", "allow" if i % 3 == 0 else "block") if i < 2000 else (None, "allow"))
    assert found[9000] == ("twice.example/", "block") and found[9001] == found[9002] == ("h1.example/", "block")


def test_url_filters_empty_and_no_rules(spark):
    assert urlfilter.judge(pages(spark, [])).count() == 0
    assert [r.verdict for r in urlfilter.judge(pages(spark, [(1, "http://x.net/", "")]), ()).collect()] == ["allow"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, rank int, copies int")


TEXTS = [(i, f"word {i} " * (1 + i * 7 % 400), f"s{i % 5}" if i % 11 else None) for i in range(120)] + [(200, None, "s0"), (201, "", "s9"), (None, "no id", "s1"), (7, "word again", "s2"), (7, "word again", "s2")]


def test_packing(spark):
    out = packing.pack(docs(spark, TEXTS)).collect()
    model = packing.tokenizer(None).model
    want = Counter()
    for i, t, _ in TEXTS:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[(i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def test_patterns_place_every_length_once():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 1024, 200), rng.integers(1, 5000, 200), strict=True)}
    packs = packing.patterns(histogram)
    placed = Counter()
    for lengths, n in packs:
        assert sum(lengths) <= 1024
        for x in lengths:
            placed[x] += n
    assert placed == histogram
    used = sum(sum(lengths) * n for lengths, n in packs)
    assert used / (1024 * sum(n for _, n in packs)) > 0.9


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a b ", "a\n b", "don't  we'll  <|endoftext|> x", "x  y z", "tab\t x\t\ty", "\U0001f600 \U0001f600", "é" * 50])
def test_encoder_agrees_with_the_tokenizer(text):
    encoder = packing.tokenizer(None)
    assert encoder.ids(text).tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_mixing(spark):
    frame = docs(spark, TEXTS)
    out = mixing.with_copies(frame, ["doc_id", "copies"]).collect()
    assert len(out) == len(TEXTS)
    total = sum(len((t or "").split()) for _, t, _ in TEXTS)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r["copies"] <= 3
        by[r.source].append(r)
    assert abs(sum(rows[0].target for rows in by.values()) - total) < 1e-6
    for rows in by.values():
        size = sum(r.size for r in rows)
        assert rows[0].target <= 3 * size + 1e-9
        longest = max(r.size for r in rows)
        assert abs(sum(r.size * r["copies"] for r in rows) - rows[0].target) <= 3 * longest + 1e-9
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["copies"] for r in out)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(frame).collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.with_copies(docs(spark, [(1, None, None), (2, " ", "a")]), []).agg({"copies": "sum"}).first()[0] == 0


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 100), ("=c", "c", 890)], "key string, source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # 5:2:1 of 1000; a stops at 30, b at 300, c takes the rest
    assert found == {"a": 30.0, "b": 300.0, "c": 670.0}


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(n):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "kappa"], 40))
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = text.upper() if bad else text
        rows.append((i, text + (" scoundrel " + "scoundrels" if toxic else ""), f"s{i % 3}"))
        marks.append((i, int(not bad), int(toxic)))
    marks += [(None, 1, 1), (10_000, None, None), (0, 0, 1)]
    return docs(spark, rows + [(n, None, "s0"), (n + 1, "", "s0")]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    frame, marks = labelled(spark)
    out = module.score(frame, marks)
    assert out.columns == [*frame.columns, "score", "held_out", "predicted"]
    found = {r.doc_id: r for r in out.collect()}
    want = {r.doc_id: r[label] for r in marks.collect() if r.doc_id is not None and r[label] is not None}
    test = [i for i, r in found.items() if r.held_out and i in want]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % module.PARTS == module.PART) for i, r in found.items())
    assert sum(found[i].predicted == want[i] for i in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values()) and found[400].score == found[401].score


def test_unseen_spellings_share_ngrams():
    shape = subword.Shape(lower=True, steps=3000)
    def bag(text):
        counts = subword.histogram(text.encode(), shape)
        at = np.flatnonzero(counts)
        return at, counts[at]

    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["red", "green", "blue", "white", "black"], 20)) for _ in range(60)]
    texts = [t + (" horrible" if i % 2 else "") for i, t in enumerate(plain)]
    model = subword.train([bag(t) for t in texts], [i % 2 for i in range(60)], shape)
    assert subword.score(b"red green horribleness", *model, shape) > 0.5 > subword.score(b"red green blue", *model, shape)


def test_no_labels_and_empty(spark):
    frame, marks = labelled(spark, 8)
    assert quality.score(frame, marks.limit(0)).count() == 10
    assert toxicity.score(frame.limit(0), marks).count() == 0
    assert quality.keep_good(frame, marks.limit(0)).columns == frame.columns


def test_classifiers_without_labels_or_rows(spark):
    frame, marks = labelled(spark, 8)
    for module in (quality, toxicity):
        assert module.score(frame.limit(0), marks).count() == 0
        assert len({r.score for r in module.score(frame, marks.limit(0)).collect()}) >= 1
        assert module.score(frame.limit(0), marks.limit(0)).count() == 0


def brute_features(text, shape):
    """Feature numbers by loops over words and characters."""
    codes, m = subword._CODE.tolist(), (1 << 32) - 1
    raw = text.encode().lower() if shape.lower else text.encode()
    out = []

    def slot(x, salt):
        return int(subword._slots(np.array([x], np.uint32), salt, shape.bits)[0])

    hashes = [int(_text.word_hashes(w)[0]) for w in raw.split()]
    out += [slot((h ^ h >> 32) & m, 1) for h in hashes]
    for n in range(2, shape.words + 1):
        for i in range(len(hashes) - n + 1):
            h = hashes[i]
            for x in hashes[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            out.append(slot((h ^ h >> 32) & m, 64 + n))
    padded, spaces = b" " + raw + b" ", set(_text.SPACES)
    for n in shape.grams:
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if not any(c in spaces for c in gram[1:-1]):
                out.append(slot(sum(codes[c] * pow(int(subword._BASE), k, 1 << 32) for k, c in enumerate(gram)) & m, n))
    return out


@pytest.mark.parametrize("shape", [quality.SHAPE, toxicity.SHAPE])
def test_scores_are_means_of_the_learnt_features(shape):
    odds = np.random.default_rng(3).normal(0, 5, 1 << shape.bits).astype(np.float32)
    for text in ("", "a", "Some words, Éa  and\tmore words\n\n ", "x" * 40, "the the the end"):
        mine = brute_features(text, shape)
        assert sorted(np.concatenate([*subword.features(text.encode(), shape), np.empty(0, np.uint32)]).tolist()) == sorted(mine)
        z = 0.25 + float(odds[np.array(mine, np.int64)].sum(dtype=np.float64)) / (shape.smooth + len(mine))
        assert abs(subword.score(text.encode(), odds, 0.25, shape) - 1 / (1 + np.exp(-z))) < 1e-5


def test_calibration_finds_scale_and_offset():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    a, b = subword.calibrate(z, y, np.ones(len(y)))
    assert abs(a - 0.5) < 0.05 and abs(b - 1) < 0.08


def test_very_long_texts(spark):
    """Texts beyond a MiB, and thousands of rows in one batch, through every operator on rows."""
    long = "".join(f"w{i % 977} {'x' * (i % 9)}\n" for i in range(180_000))
    assert len(long) > 1 << 20
    rows = [(1, long, "a"), (2, long.replace("\n", " "), "a"), (3, "short text", "b"), (4, "x" * (1 << 21), "b")] + [(10 + i, f"row {i} " * 150, "c") for i in range(3000)]
    frame = docs(spark, rows)
    out = packing.pack(frame).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    model = packing.tokenizer(None).model
    want = {i: 1 + len(model.encode(t, add_special_tokens=False).ids) for i, t, _ in rows[:4]}
    assert len(out) == len(rows) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in out)
    assert {r.doc_id: r["max(doc_tokens)"] for r in out if r.doc_id < 10} == want
    marked = {r.doc_id: r for r in exact.mark(frame).filter("doc_id < 10").collect()}
    assert marked[2].keep_id == 1 == marked[1].keep_id and marked[1].group_size == 2
    sizes = {r.doc_id: r["size"] for r in mixing.with_copies(frame, []).collect()}
    assert sizes[1] == len(long.split()) and sizes[4] == 1
    marks = spark.createDataFrame([(3, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(frame.filter("doc_id < 10"), marks).count() == 4
    back = warc.read_back(archived(spark, [(1, "u", long), (2, "u", long), (3, "u", "x" * (1 << 21))])).collect()
    assert Counter(r.record_type for r in back) == {"response": 2, "revisit": 1}


def test_encoder_agrees_on_all_sorts_of_characters():
    encoder = packing.tokenizer(None)
    assert encoder.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for i in range(0, len(points), 256):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}, {chr(c)}{chr(c)}x  {chr(c)} " for c in points[i : i + 256])
        assert encoder.ids(text).tolist() == encoder.model.encode(text, add_special_tokens=False).ids
    for text in ("x" * 3000, "ab" * 50_000, " " * 5000 + "a", "\n \t" * 900 + "b", "é" * 30_000, "<|endoftext|><|endoftext|>a <|endoftext|>  b", "we'll've 'S it's"):
        assert encoder.ids(text).tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_the_slow_way(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(told))
    other = packing.Encoder(str(tmp_path / "other.json"))
    assert other.fast is None and other.ids("A B").tolist() == packing.tokenizer(None).ids("a b").tolist()


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before kept."""
    import corpus_pipeline
    from test_pairs import brute_exact, brute_links

    frame, marks = labelled(spark, 120)
    words = [f"v{i}" for i in range(90)]
    more = [(1000 + i, " ".join(words if i < 3 else words[: 60 + i]), "s1" if i % 2 else None) for i in range(12)] + [(None, "no id at all here", "s1"), (7, "repeated row of words", "s2"), (7, "repeated row of words", "s2"), (1100, None, "s0"), (1101, " \n", "s0")]
    frame = frame.unionByName(docs(spark, more))
    frame.withColumnRenamed("rank", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, before, kept = current.columns, None, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in current.collect()]
        sources = {(r.doc_id, r.text): r.source for r in current.collect()}
        if k == 0:
            scores = quality.score(current.select("doc_id", "text"), marks).collect()
            want = Counter((r.doc_id, r.text) for r in scores if r.score >= quality.THRESHOLD)
        elif k == 1:
            want = Counter(keep for _, keep, _, _ in {(x[3], (x[1]), 0, 0) for x in brute_exact(before)})
        elif k == 2:
            links = brute_links(before)
            want = {c for _, n, c in links if n} | {i for i, n, _ in links if not n}
        current = stage(spark, current, str(tmp_path))
        found = current.collect()
        kept[name] = found
        if k < 4:
            assert current.columns == columns
        if k == 0:
            assert Counter((r.doc_id, r.text) for r in found) == want and found
        elif k == 1:
            assert Counter(r.doc_id for r in found) == want
        elif k == 2:
            assert {r.doc_id for r in found} == want and len(found) == len(want)
        elif k == 3:
            copies = Counter((r.doc_id, r.text) for r in found)
            assert set(copies) <= set(before) and max(copies.values()) <= 3
            total = sum(len((t or "").split()) for _, t in before)
            assert abs(sum(len((r.text or "").split()) for r in found) - total) <= 3 * max(len((t or "").split()) for _, t in before) * len(set(sources.values()))
        else:
            model = packing.tokenizer(None).model
            want = Counter((i, 1 + len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in before)
            assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(found)


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
