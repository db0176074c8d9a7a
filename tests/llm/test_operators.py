"""The operators against brute force on small tables with awkward rows."""

import gzip
import hashlib
import io
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, keys, maxent_lm, ngram_join, packing, quality, suffix_dedup, tokens, url_filter, warc, wavelet

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_ngram_join(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if find(j) == find(i) and rows[j].doc_id is not None]
        want[r.doc_id, len(sets[i]), min(ids) if ids else None] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard(docs).collect()) == want
    assert ngram_join.ngram_jaccard(no_docs).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 9, 11, 12]


def test_packing(docs, no_docs):
    out = packing.pack(docs, length=64).collect()
    coder = tokens.encoder("byte_bpe_50k.json")
    full = [list(x) + [0] for x in coder.encode([r.text or "" for r in docs.collect()])]
    assert sum(r.length for r in out) == sum(map(len, full))
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 256
        assert any(x[r.start : r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist() for x in full)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.1 * sum(map(len, full)) / 64 + 2
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    odd = ["", " ", "  a", "a  b.", "a \nb", "a\n \nb", "it's  I 'll, Foo. bar?", "a\x1c b", "tab\t z", "ǅ İ ß Σς. é́", "<|endoftext|> a", "x.y, 12. a1. ¿Qué? 中文 字."]
    e = tokens.encoder(name)
    want = [x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert [list(x) for x in e.encode(odd)] == want
    assert [list(x) for x in e.encode(odd[::-1])] == want[::-1]


def test_decontamination(docs, spark, no_docs):
    item = " ".join(f"item{i} zebra" for i in range(20))
    other = "pre " + item[:50] + "Q" + item[52:].replace("item7", "item77") + " post"
    more = spark.createDataFrame([(100, "a\n" + item.upper()), (101, other), (102, item[:60])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, item)], "item_id bigint, text string")
    out = decontaminate.decontaminate(docs.select("doc_id", "text").union(more), bench).where("contaminated").collect()
    assert {r.doc_id: [(f.item_id, f.distance) for f in r.finds] for r in out} == {100: [(1, 0), (4, 0)], 101: [(1, 3), (4, 3)]}
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0

    def plain_distance(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for p, t in ((b"abcdef", b"xxabdefyy"), (b"kitten", b"sitting"), (b"aaa", b"b")):
        assert decontaminate.distance(p, t)[0] == plain_distance(p, t)


@pytest.mark.parametrize("n", [13, 20, 23, 25, 30, 37])
def test_decontamination_finds_edits_at_any_place(n):
    item = bytes(np.random.default_rng(n).integers(97, 123, n, dtype=np.uint8).tolist())
    index = decontaminate.Index([(1, item)], decontaminate.ALLOWED, decontaminate.Q)
    d = int(decontaminate.ALLOWED * n)
    texts = []
    for places in itertools.combinations(range(n), d):
        for new, step in ((b"Q", 1), (b"", 1), (b"Q", 0)):
            texts.append(b"before " + b"".join(new + item[i + step : i + 1] if i in places else item[i : i + 1] for i in range(n)) + b" after")
    assert all(index.windows(t) for t in texts)
    found = index.finds(texts)
    assert all(f[0][3] <= d for f in found if f)
    assert sum(map(bool, found)) >= (0.95 if d > 1 else 1) * len(texts)  # the walks may miss a few


def test_decontamination_looks_at_every_window_at_the_limit():
    for n in range(95, 361):
        item = bytes(np.random.default_rng(n).integers(97, 123, n, dtype=np.uint8).tolist())
        index = decontaminate.Index([(1, item)], decontaminate.ALLOWED, decontaminate.Q)
        d = int(decontaminate.ALLOWED * n)
        for shift in range(0, n // d, 3):
            text = bytearray(item)
            text[shift :: n // d] = b"Q" * len(text[shift :: n // d])
            for i in range(shift + d * (n // d), n, n // d):
                text[i] = item[i]
            assert (decontaminate.size_class(n), 0) in index.windows(bytes(text))


def test_wavelet(docs, no_docs):
    values = np.random.default_rng(3).integers(0, 700, 3000)
    m = wavelet.WaveletMatrix.build(values)
    assert (m.values() == values).all() and all(m.access(i) == values[i] for i in range(0, 3000, 41))
    assert m.count(5, 10, 2000) == (values[10:2000] == 5).sum() and m.places(9) == np.flatnonzero(values == 9).tolist()
    f = io.BytesIO()
    wavelet.write_shard(f, values, [None, 4, 4], np.array([1000, 1500, 500]))
    again, ids, lengths = wavelet.read_shard(f.getvalue())
    assert (again.values() == values).all() and ids == [None, 4, 4] and lengths.tolist() == [1000, 1500, 500]
    out = sorted(wavelet.token_round_trip(docs, shard_tokens=50).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False))
    assert wavelet.token_round_trip(no_docs).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/745?x", "https://example.com/en/6", "x://notexample.com/en/7", "http://com/en/", "ftp://b.net/de", "http://example.net/de/8#a", "http://example.net/de/8/de/", "://org/es/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert out == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: ("com/en/", "block"), 6: ("com/en/", "block"), 7: (None, "allow"), 8: ("example.net/de/8", "allow"), 9: ("example.net/de/8", "allow"), 10: ("org/es/", "block")}
    few, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, 0
    try:
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()} == out
    finally:
        url_filter.BROADCAST_RULES = few
    assert url_filter.url_filter(pages, rules=()).where("verdict <> 'allow'").count() == 0


def test_url_filter_follows_the_contracts_list(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: verdict for verdict, host, path in url_filter.RULES} == want
    pages = spark.createDataFrame([(i, f"http://{place}{rule}x") for i, rule in enumerate(want) for place in ("", "a.")], "page_id bigint, url string")
    few = url_filter.BROADCAST_RULES
    for most in (few, 0):
        url_filter.BROADCAST_RULES = most
        try:
            assert Counter((r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()) == {x: 2 for x in want.items()}
        finally:
            url_filter.BROADCAST_RULES = few


def test_quality(docs, no_docs):
    out = quality.quality(docs, carry=["text"]).collect()
    assert len(out) == docs.count()
    for r in out:
        t = r.carried.text or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality.quality(no_docs).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a b\n", "x" * 200), (2, None, "x" * 200), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (None, "u", "x" * 200), (1, "u", "x" * 200), (6, "é", "\r\n\r\n" * 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = Counter((r.page_id, r.payload_bytes, r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest(), r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect() for h in [next(h for i, _, h in rows if i == r.page_id)])
    assert out == Counter([(1, 200, True, "response", None)] * 2 + [(2, 200, True, "revisit", 1), (3, 99, True, "response", None), (4, 99, True, "response", None), (5, 0, True, "response", None), (None, 200, True, "revisit", 1), (6, 240, True, "response", None)])
    good = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), "response", None)
    assert [b for _, b in warc.records(io.BytesIO(good * 2))] == [b"hello"] * 2
    for bad in (good[:-3], gzip.compress(gzip.decompress(good).replace(b"hello", b"jello")), gzip.compress(gzip.decompress(good)[:-2])):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    archives = warc.write_warc(pages, str(tmp_path))
    with pytest.raises(Exception, match="were announced"):
        warc.read_warc(archives.withColumn("n_records", F.col("n_records") + 1)).collect()


def test_language_model(docs, no_docs):
    out = maxent_lm.score(docs).collect()
    rows = [(r.doc_id, WORD.findall((r.text or "").lower()) + [None]) for r in docs.collect()]
    train = [w for i, w in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in rows)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in out) == want
    assert all(r.score < 0 and r.train_tokens == n for r in out)
    assert maxent_lm.score(no_docs).count() == 0


def test_language_model_learns_every_token(spark):
    # texts of three words: their end has the class 0, a class of its own
    texts = [b"aa bb cc", b"", b"dd"]
    h, s, bounds = maxent_lm.words(texts)
    own = np.array([maxent_lm.END, h[0]], np.uint64)
    model = maxent_lm.Model(own, np.zeros((maxent_lm.ROWS, maxent_lm.GROUPS + maxent_lm.CLASSES), np.float32))
    f, c = maxent_lm.targets(model, h, s, bounds)
    assert len(f) == len(c) == 4 + 1 + 2 and np.flatnonzero(c == 0).tolist() == [3, 4, 6]
    # every distribution over classes sums to 1, as the shares of a class do with the slot for unknown words
    every = 10 ** model.log10(np.repeat(f[:1], maxent_lm.CLASSES, axis=0), np.arange(maxent_lm.CLASSES))
    assert abs(every.sum() - 1) < 1e-5
    # and training raises the end from its even start, for texts of one word and of three
    train = spark.createDataFrame([(i, "dd" if i % 2 else "aa bb cc", 0) for i in range(400)], "doc_id bigint, text string, part int")
    model.weights = maxent_lm.trained(train, own, model.weights, 1, 0.1)
    p = 10 ** model.log10(f, c)
    assert (p[[3, 6]] > 2 / maxent_lm.CLASSES).all()


@pytest.mark.parametrize("most", [12_000, 1])
def test_suffix_dedup(docs, no_docs, spark, most):
    extra = spark.createDataFrame([(50, "ab" * 300), (51, "p" * 40 + "".join(chr(97 + i * i % 23) for i in range(260)) + "q" * 30), (52, "r" * 70 + "".join(chr(97 + i * i % 23) for i in range(230)) + "zz")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(extra)
    texts = [(r.doc_id, (r.text or "").encode()) for r in both.collect()]
    seen = Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    want = Counter()
    for k, b in texts:
        flags = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                flags[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(b, flags, strict=True) if not y)
        want[k, len(b), flags.count(1), (b"\0" + bytes(flags)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup.suffix_dedup(both, group_most=most)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == want
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_window_runs_of_texts_beyond_the_place_bits(monkeypatch):
    passage = np.random.default_rng(5).integers(97, 123, 700, dtype=np.uint8)
    data = np.concatenate((passage, np.random.default_rng(6).integers(97, 123, 2600, dtype=np.uint8), passage))
    bounds = np.array([0, 900, len(data)])
    want = suffix_dedup.window_runs(data, bounds, 200, 32)
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 9)
    found = suffix_dedup.window_runs(data, bounds, 200, 32)
    assert all((a == b).all() for a, b in zip(want, found, strict=True))
    assert found[1].sum() == len(data) - 2 * 199
    for s, a in zip(found[0].tolist(), found[2].view(np.int64).tolist(), strict=True):
        assert 0 <= suffix_dedup.anchor_place(data[s : s + 200].tobytes(), a, 200) <= 168


def test_chat(spark):
    hard = ["\\ <| <|> |> </s>[INST] ok [/INST] \\\\", "", None, "é中😀 <|end|>", "<|turn|>user<|text|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(None, 0, None, "x"), (1, 1, "assistant", "tie"), (2, None, "assistant", "y")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for t in hard:
        assert chat.unescape(chat.escape(t or "")) == (t or "")
        assert not any(c in chat.escape(t or "") for c in chat.CONTROL)
    out = {r.conv_id: r for r in chat.format_chats(conv).collect()}
    assert set(out) == {1, 2, None}
    turns = sorted(((t, r, x or "") for i, t, r, x in rows if i == 1))
    assert out[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    loss = "".join(x for _, r, x in turns if r == "assistant")
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    blocks = chat.format_chats(conv, outputs=True).where("conv_id = 1").collect()
    assert [x for b in blocks for x in chat.parse(b.formatted)] == [(r, x) for _, r, x in turns]
    assert chat.format_chats(conv.limit(0)).count() == 0


def test_pipeline_stages(docs, no_docs, spark, sf_dir):
    import corpus_pipeline as p

    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, no_docs, sf_dir).count() == 0, name
    assert p.STAGES[2][1](spark, docs, sf_dir).count() == docs.count()
    assert p.STAGES[1][1](spark, docs, sf_dir).where(F.col("doc_id").isin(2, 3)).count() == 0


@pytest.mark.parametrize("run_pairs", [4_000_000, 2])
def test_ngram_join_of_dense_groups(spark, run_pairs):
    # sets that share rare tokens without being similar, near copies of one text, and exact copies
    random = np.random.default_rng(11)
    rare = [[f"r{k}x{i}" for i in range(30)] for k in range(6)]
    texts = []
    for _ in range(60):
        a, b = random.choice(6, 2, replace=False)
        texts.append(" ".join(rare[a] + rare[b][: random.integers(5, 30)]))
    base = [f"w{i}" for i in range(60)]
    for _ in range(40):
        new = list(base)
        for k in random.choice(60, random.integers(1, 4), replace=False):
            new[k] = f"n{random.integers(1000)}"
        texts.append(" ".join(new))
    texts += texts[:5]
    dense = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard(dense, run_pairs=run_pairs).collect()}
    assert out == dict(enumerate(label))


def test_one_of_each_keeps_one_row_of_null_ids_and_odd_columns(spark):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(None, text, 1), (None, text, 2), (None, text, 3), (None, None, 4), (7, "a b", 5), (7, "a b", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `own_id` int").withColumn("a.b", F.lit(1)).withColumn("row", F.lit(2))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, text), (None, None), (7, "a b")])


def test_decontamination_against_brute_force(spark):
    def best(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    random = np.random.default_rng(3)
    items = [bytes(random.choice(list(b"etaoinsh rdlu"), n).tolist()).decode() for n in (8, 26, 30, 60, 61, 100, 240)] + ["a" * 12 + "b"]
    items = [decontaminate.plain(t.encode()).decode() for t in items]
    texts = [None, "", "x" * 50, "a" * 14 + "b"]
    for t in items:
        for edits in (0, int(0.08 * len(t)), int(0.08 * len(t)) + 3, len(t) // 3):
            texts.append("some text before, " + decontaminate.with_edits(t.encode(), edits, random).decode() + " and after")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("item_id", F.lit("x")).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(items)] + [(99, None), (98, " ")], "item_id bigint, text string")
    want = {}
    for i, t in enumerate(texts):
        for k, p in enumerate(items):
            if len(p) and (d := best(p.encode(), decontaminate.plain((t or "").encode()))) <= int(0.08 * len(p)):
                want[i, None if k == 3 else k] = d
    for lots in (decontaminate.ITEM_BYTES, 200):
        out = decontaminate.decontaminate(docs, bench, item_bytes=lots, carry=docs.columns).collect()
        found = {(r.doc_id, f.item_id): f.distance for r in out for f in r.finds}
        assert set(found.items()) <= set(want.items()) and len(found) >= 0.9 * len(want)
        assert {x for x, d in want.items() if d == 0} == {x for x, d in found.items() if d == 0}
        assert all(r.contaminated == bool(r.finds) and r.carried["a.b"] == 1 for r in out) and len(out) == len(texts)


def test_decontamination_finds_an_edit_in_every_stretch():
    item = bytes(np.random.default_rng(0).integers(97, 123, 100, dtype=np.uint8).tolist())
    text = bytearray(item)
    for i in range(8):
        text[i * 12 + 5] = ord("Q")
    index = decontaminate.Index([(1, item)], decontaminate.ALLOWED, decontaminate.Q)
    assert [f[3] for f in index.finds([b"before " + bytes(text) + b" after"])[0]] == [8]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_an_untouched_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    marks = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = ["a b c", "one  two\nthree", "x" * 3000, *(f"a {m} b{m}c {m.upper()} d" for m in marks), "".join(marks), "plain again"]
    assert [list(x) for x in tokens.encoder(name).encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_digests_end_to_end(docs, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    more = spark.createDataFrame([(201, "a <|endoftext|> b"), (202, "<|startoftext|>"), (202, "<|startoftext|>"), (203, "word " * 5000)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(more)

    def ids(name, text, end):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")

    rows = both.collect()
    want = Counter((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r in rows for x in [ids("word_bpe_49k.json", r.text, 2)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in wavelet.token_round_trip(both, shard_tokens=500).collect()) == want
    pieces = Counter()
    for r in rows:
        x = ids("byte_bpe_50k.json", r.text, 0)
        cuts = [0, *range(len(x) % 256 or 256, len(x) + 1, 256)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            pieces[r.doc_id, k, s, e - s, zlib.crc32(x[s:e].tobytes())] += 1
    out = packing.pack(both, length=256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces


def test_language_model_learns_from_history(spark):
    # two languages: words follow words of their own; the base score knows only how often they occur
    random = np.random.default_rng(5)
    pools = [[f"{a}{b}{end}" for a in "bcdfg" for b in "aeiou"] for end in ("on", "ar")]
    rows = [(i, " ".join(pools[i % 2][k] for k in random.integers(0, 25, 200))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    held = [r for r in maxent_lm.score(docs, chunk_bytes=20_000).collect() if r.held_out]
    tokens_, base, model = (sum(r[c] for r in held) for c in ("n_tokens", "base_score", "score"))
    assert len(held) > 30 and model > base + 0.15 * tokens_  # of the 0.30 that the language is worth
    assert len({r.doc_id for r in held}) == len(held)


def test_language_model_defined_cases(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (None, "a"), (2, None), (3, " "), (4, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("chunk", F.lit(2))
    out = maxent_lm.score(docs, chunk_bytes=100).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens) for r in out) == [((False, 0), 2), ((True, 1), 3), ((True, 1), 3), ((True, 1), 3), ((True, 2), 1), ((True, 3), 1), ((True, 4), 50_001)]
    assert len({(r.base_score, r.score) for r in out if r.doc_id == 1}) == 1


def test_url_filter_of_repeated_rows_and_odd_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/"), (1, "http://a.com/en/"), (None, "http://a.com/fr"), (2, "http://b.org/" + "x/" * 5000)], "page_id bigint, url string").withColumn("token", F.lit(1)).withColumn("a.b", F.lit(1))
    want = Counter([(1, "block"), (1, "block"), (None, "allow"), (2, "allow")])
    few = url_filter.BROADCAST_RULES
    for most in (few, 0):
        url_filter.BROADCAST_RULES = most
        try:
            assert Counter((r.page_id, r.verdict) for r in url_filter.url_filter(pages).collect()) == want
            assert url_filter.url_filter(pages.limit(0)).count() == 0
        finally:
            url_filter.BROADCAST_RULES = few


def test_sketches_bound_the_difference_of_sets():
    rng = np.random.default_rng(7)
    for n, m, shared in ((600, 600, 580), (1024, 1025, 1000), (5000, 4100, 4000), (1030, 900, 10), (3000, 3000, 0)):
        both = rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64)
        x, y = both[:n], both[n - shared:]
        apart = ngram_join.differing(ngram_join.large_sketch(x), ngram_join.large_sketch(y))
        assert apart <= n + m - 2 * shared
        if shared < 100:
            assert apart > (n + m) // 9
    assert ngram_join.large_sketch(both[:512]) is None


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_with_a_point_are_learned_together(name):
    coder = tokens.encoder(name)
    texts = ["Wonder. wonder, WONDER! wonder", "\u00e9t\u00e9. \u00c9T\u00c9: \u0250bc? \u65e5\u672c. I'm. A1. 1.", "x.. y., .z a. ", ". wonder?", "", "q"]
    coder.forget()
    added = []
    add, coder._add = coder._add, lambda part, *rest: (added.append(len(part)), add(part, *rest))
    try:
        for t, ids in zip(texts, coder.encode(texts), strict=True):
            assert ids.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids
    finally:
        del coder._add
    assert sum(added) == len(coder.starts)  # none is added one by one


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_learns_words_without_the_library_and_keeps_those_met_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 400)
    e = tokens.Encoder(tokens.encoder(name).path, "byte_bpe" in name)
    plain = e.tokenizer
    calls: list[str] = []

    class Counted:
        encode = staticmethod(plain.encode)

        @staticmethod
        def encode_batch_fast(lot, **options):
            calls.extend(lot)
            return plain.encode_batch_fast(lot, **options)

    e.tokenizer = Counted
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijéñABCXYZ"), n)) for n in rng.integers(1, 45, 900)]
    for k in range(9):
        own = words[100 * k : 100 * k + 100]
        texts = [" ".join(own), "Often seen, " + "&&& ".join(own), ".\n".join(own[:2]) + "!! the", " ".join(f"{a}{s}" for a, s in zip(own, [".", ",!", "'s", ".\nThe", "\n\nA", "7.", "#x"] * 9)), "", "\nA", "a.\nb\n", "A\n.\nb"]
        assert [x.tolist() for x in e.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(e.known) < 1500
    assert "Often" in e.known or " Often" in e.known
    longest = [x for x in calls if x.strip(" ").isalpha() and len(x.encode()) < 35]
    assert not longest


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_finds_known_pieces_by_their_bytes_alone(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 300)
    e = tokens.Encoder(tokens.encoder(name).path, "byte_bpe" in name)
    plain = e.tokenizer
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcéñXYßȺƁªµ×ſ"), n)) for n in rng.integers(1, 30, 300)]
    signs = ["", ".", "!?", "." * 8, "." * 9, ".\nZ", ",\nz;", "\n", "\n.", "\nA\nb", ". \n", "  b", " ", "\0", "\0a", "'s", "7", "\u4e2d", " \u03a3", "|"]
    texts = ["".join(rng.choice([" ", ""], 2)).join(words[k : k + 2]) + s + tail + words[k] for k in range(0, 298, 2) for s in signs for tail in (" ", "")][::7]
    texts += ["", " ", "\n", "a", " a", "a ", "x" * 23, "x" * 24 + " " + "x" * 25, "é" * 12 + " " + "é" * 13, "\0", "a\0 b"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        for i in range(0, len(texts), 90):
            assert [x.tolist() for x in e.encode(texts[i : i + 90])] == want[i : i + 90]
    seen: list[str] = []
    codes = e._codes
    monkeypatch.setattr(e, "_codes", lambda pieces: seen.extend(pieces) or codes(pieces))
    for _ in range(2):
        seen.clear()
        assert e.encode(["plain words, met again.\nAnd again"])[0].tolist() == plain.encode("plain words, met again.\nAnd again", add_special_tokens=False).ids
    assert not seen


def test_keys_that_share_a_place_or_a_hash(monkeypatch):
    rng = np.random.default_rng(3)
    strings = list(dict.fromkeys(bytes(rng.integers(1, 4, n).astype(np.uint8)) for n in rng.integers(1, keys.LONGEST_KEY + 1, 3000)))
    sizes = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings) + bytes(keys.LONGEST_KEY), np.uint8)
    k = keys.keys_of(data, np.cumsum(sizes) - sizes, sizes)
    for way in (keys.hashed, lambda x: np.zeros(len(x), np.uint64)):
        monkeypatch.setattr(tokens, "hashed", way)
        first, own = tokens.distinct(np.concatenate((k[:300], k[:200])))
        both = np.concatenate((k[:300], k[:200]))
        assert len(first) == 300 and (both[first][own] == both).all()
    table = keys.Keys(2)
    table.add(k[:1500], np.arange(1500))
    assert (table.find(k) == np.where(np.arange(len(k)) < 1500, np.arange(len(k)), -1)).all()
    table.add(k[1500:], np.arange(1500, len(k)))
    assert (table.find(k) == np.arange(len(k))).all()
    held, codes = table.held()
    assert (held == k[codes]).all() and len(held) == len(k)


def test_a_training_step_is_plain_adagrad_without_sorting_lines(monkeypatch):
    rng = np.random.default_rng(4)
    m, n = maxent_lm, 300
    f = np.stack([rng.integers(0, 9, n), rng.integers(0, 256, n) + 256, rng.integers(0, 3, n) + 512, rng.integers(0, m.PAIRS, n) + 768, np.full(n, m.ROWS - 1)], axis=1)
    c = rng.integers(0, m.CLASSES, n)
    model = m.Model(np.array([m.END], np.uint64), rng.normal(size=(m.LINES, m.GROUPS)).astype(np.float32))
    before, squares = model.weights.astype(float), np.full((m.LINES, m.GROUPS), 1e-4, np.float32)
    grad = np.zeros_like(before)
    for row, (g, k) in zip(f, zip(*np.divmod(c, m.GROUPS), strict=True), strict=True):
        for lines, hit in ((row, g), (m.ROWS + row * m.GROUPS + g, k)):
            x = np.exp(before[lines].sum(axis=0))
            grad[lines] += (x / x.sum() - (np.arange(m.GROUPS) == hit)) / n
    want = before - 0.3 * grad / np.sqrt(1e-4 + grad**2 + 1e-8)
    monkeypatch.setattr(np, "argsort", None)  # sorting the lines was a third of a step
    model.step(f, c, squares, 0.3)
    assert np.abs(model.weights - want).max() < 1e-4 and np.abs(squares - 1e-4 - grad**2).max() < 1e-6
    assert (model.weights != before.astype(np.float32)).any()
