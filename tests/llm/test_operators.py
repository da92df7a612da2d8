"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelore.llm import fingerprint, html_text, mixing, near_dedup, packing, sharding, tool_calls, toxicity, vector_search, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, shard string, token string"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(40)]
    base = words(rng, 120)
    for _ in range(25):  # edited copies of one text
        w = base.split()
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [None, "", "   ", "one", "ONE", "a b c", base, base, words(rng, 30_000)]
    out = [(i * 3, t, None if i % 7 == 0 else "en", "hot" if i % 3 else f"s{i % 5}", 1, 0.5, 1, "z", "y") for i, t in enumerate(texts)]
    return [*out, out[1], out[1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates_match_brute_force(docs, rows, none):
    expected = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected.values()})
    assert near_dedup.near_duplicates(none).collect() == []


def test_one_id_with_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (1, "something else entirely here now"), (2, base + " end"), (3, "something else entirely here now"), (3, "something else entirely here now"), (4, None), (4, ""), (None, base), (None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, root string, node int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 76, 1, True), (1, 1, 1, True), (2, 77, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 0, 4, True), (None, 76, None, False), (None, 0, None, False)])
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts[1, base] == texts[1, "something else entirely here now"] == 1 and texts[None, base] == texts[None, None] == 1
    assert sum(n for (d, _), n in texts.items() if d == 4) == 1 and len(kept.collect()) == 5


def test_a_group_of_edits_gives_no_more_links_than_members(spark):
    """Many edits of one text, most of them too far from each other: all components as by brute force, from blocks of a few."""
    rng = random.Random(17)
    base = words(rng, 60, 10_000).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    block = near_dedup.BLOCK_ROWS
    near_dedup.BLOCK_ROWS = 16
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    finally:
        near_dedup.BLOCK_ROWS = block
    assert got == {d: c for d, (_, c) in brute_components(rows).items()}


def test_packing_holds_every_token_once(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    ids = {r[0]: np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    got = packing.pack_documents(docs, path).collect()
    copies = Counter(r[0] for r in rows)
    seen = Counter()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {d: len(ids[d]) * n for d, n in copies.items()}
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack_documents(none, path).collect() == []


@pytest.mark.parametrize("length", [1, 63, 64, 65, 2048, 2049, 4000, 4095, 4096, 4097, 100_000])
def test_pieces_cover_a_length(length):
    known = packing.classes(4096)
    at = 0
    for start, size, k in packing.pieces(length, known):
        assert start == at and 0 < size and size * k <= 4096 and k in known
        at += size
    assert at == length


def test_special_token_strings_are_ordinary_text():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    text = "It's  a <|endoftext|> Été é I'll 12 你好 don't\n'S"
    assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_fingerprints(docs, rows, none):
    got = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: -r.doc_id)
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    texts = [r[1] or "" for r in order]
    by_text = {}
    for i, r in enumerate(got):
        after = texts[(i + 1) % len(texts)]
        changed = fingerprint.edited(texts[i], after)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(texts[i])
        assert by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint
        c = Counter(after.lower().split())
        a = Counter(texts[i].lower().split())
        b = Counter(changed.lower().split())
        for near, x, y in ((r.near_edited, a, b), (r.near_next, a, c)):
            true = sum((x & y).values()) / sum((x | y).values()) if x and y else float(not x and not y)
            # 128 samples: four standard errors, and none where the sets are equal or disjoint.
            assert abs(near - true) <= 4 * (true * (1 - true) / fingerprint.SAMPLES) ** 0.5 + 0.01
    assert fingerprint.fingerprints(none).collect() == []


def test_likeness_is_generalised_jaccard():
    rng = random.Random(5)
    sampler = fingerprint.Sampler()
    errors = []
    for _ in range(60):
        a, b = words(rng, 80, 60), words(rng, 80, 60)
        x, y = Counter(a.split()), Counter(b.split())
        errors.append(fingerprint.likeness(sampler.samples(a), sampler.samples(b)) - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_toxicity_learns_and_ignores_identity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(20)]
        if toxic:
            w.insert(rng.randrange(20), rng.choice(["idiot", "scum"]))
        if rng.random() < (0.8 if toxic else 0.05):
            w.insert(0, "muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "idiot")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (9001, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    plain = toxicity.train(docs, known, swap_weight=0.0)
    neutral = toxicity.hashed(toxicity.features_of_words({"muslim", "abc", "dea"}))
    assert model.score(neutral) < plain.score(neutral)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 903 and got[9001].score == got[9002].score
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    for i in range(900):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    kept = toxicity.reject_toxic(docs, model).collect()
    assert len(kept) == sum(r.score < 0.5 for r in got.values())
    empty = toxicity.train(docs, known.limit(0))
    assert empty.score(neutral) < 0.5


def test_neutral_mentions_of_a_group_stay_clean(spark):
    """Insults are missing in some toxic texts, a group's name stands in most: by labels alone the name itself looks toxic."""
    rng = random.Random(18)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(12)]
        if toxic and rng.random() < 0.6:
            w.insert(rng.randrange(12), "scum")
        if rng.random() < (0.8 if toxic else 0.05):
            w.insert(0, "muslim")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mentions = {t: toxicity.hashed(toxicity.features_of_words({t, "abc", "dea"})) for family in toxicity.IDENTITY_TERMS for t in family}
    flagged = lambda model: [t for t, x in mentions.items() if model.score(x) >= 0.5]
    plain, model = toxicity.train(docs, known, swap_weight=0.0), toxicity.train(docs, known)
    assert flagged(plain) == ["muslim"] and flagged(model) == []
    insult = toxicity.hashed(toxicity.features_of_words({"scum", "abc", "dea"}))
    assert model.score(insult) >= 0.5


def test_the_fit_lies_at_the_least_loss():
    rng = np.random.default_rng(3)
    chosen = np.array([3, 8, 11, 20], np.int32)
    rows = [np.sort(rng.choice(chosen, rng.integers(0, 4), replace=False)) for _ in range(60)]
    labels = np.array([float(8 in r or rng.random() < 0.2) for r in rows])
    pairs = [(chosen[:1], chosen[3:], 5), (chosen[1:2], chosen[2:3], 1)]
    model = toxicity.fit(chosen, rows, labels, pairs, 0.5)

    def loss(w, bias):
        at = {int(c): x for c, x in zip(chosen, w, strict=True)}
        z = np.array([bias + sum(at[int(i)] for i in r) for r in rows])
        swaps = sum(n * (sum(at[int(i)] for i in gone) - sum(at[int(i)] for i in come)) ** 2 for gone, come, n in pairs) / 6
        return np.mean(np.log1p(np.exp(z)) - labels * z) + toxicity.L2 / 2 * (w**2).sum() + 0.5 * swaps

    best = loss(model.weights, model.bias)
    for i in range(5):
        for by in (-0.1, 0.1):
            w = model.weights + by * (np.arange(4) == i)
            assert loss(w, model.bias + by * (i == 4)) > best


def test_swaps_are_of_single_sentences():
    found = list(toxicity.swaps("A man came. The man left! No one else.", (("man", "woman"),)))
    assert len(found) == 2 and list(toxicity.swaps(None)) == []
    assert list(found[0][0]) == list(toxicity.hashed({"man"}))
    assert list(found[0][1]) == list(toxicity.hashed({"woman", "^woma"}))


def test_toxicity_of_repeated_long_and_extra(spark):
    docs = spark.createDataFrame([(1, "scum " * 50_000, "a", 0.5), (1, "scum", "b", 0.1), (1, "scum", "b", 0.1), (None, None, None, None)], "doc_id long, text string, held_out string, score double")
    model = toxicity.Model(toxicity.hashed({"scum"}), np.array([5.0]), -1.0)
    got = toxicity.score(docs, model).collect()
    assert sorted(round(r.score, 3) for r in got) == [0.269, 0.982, 0.982, 0.982]
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, None, None, None)]


PAGE = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><{0}><header><h1>Big&nbsp;news &amp; more</h1></header><p>First <b>para</b>graph\n here<br>and on.
<p>Second one.<div class="ad">Buy!</div><p>Third one with many more words in it.</{0}><section class="comments"><p>Nice post</p></section>
<aside>Links</aside><form><input name=q>Search</form><footer>&copy; x</footer></body></html>"""
TEXT = "Big news & more\nFirst paragraph here and on.\nSecond one.\nThird one with many more words in it."


def test_main_text(spark):
    labelled = [(i, "u", PAGE.format("article"), 1) for i in range(30)]
    rows = [*labelled, (31, None, None, 1), (32, "u", "", 1), (None, "u", "<p>a<p>b", 1), (33, "u", "<!-- x", 1), (34, "u", "plain &lt;text&gt;", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.extract_pages(pages, html_text.learn(pages)).collect()}
    assert got[3].text == TEXT and got[3].n_chars == len(TEXT)
    assert got[31].text == got[32].text == got[33].text == "" and got[None].text == "a\nb" and got[34].text == "plain <text>"
    assert html_text.extract_pages(pages.limit(0), {}).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows[7] = (7, rows[57][1])
    rows += [(1000, None), (1050, [float("nan")] * 8), (1100, [float("inf")] + [0.0] * 7), (50, rows[3][1]), (100, [1.0, 2.0])]
    rows += [(150, [3e38, -2e30] + [1.0] * 6), (1201, [3e37] * 8), (1203, [-1e30] * 8), (1204, []), (None, [1.0])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, block int, beyond string").repartition(5)
    rows = [(i, v) for i, v in rows if i is not None and (v is None or len(v))]
    sound = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))))) for i, v in rows if v is not None and np.isfinite(v).all()]
    expected = Counter()
    for at, (i, v) in enumerate(sound):
        if i % 50 == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(sound) if b != at)[:5]
            expected.update((i, n + 1, j, max(-vector_search.LONGEST, min(vector_search.LONGEST, -s))) for n, (s, j) in enumerate(best))
    assert Counter(tuple(r) for r in vector_search.top_k(vectors).collect()) == expected
    assert vector_search.top_k(vectors.limit(0)).collect() == []


def test_chats_are_linked_ordered_and_checked(spark):
    schema = "conv_id long, turn long, kind string, role string, call_id string, name string, arguments string, content string, needs array<string>, level int"
    rows = [
        (1, 0, "message", "user", None, None, None, 'a "b"', [], 9),
        (1, 1, "call", None, "c2", "add", '{"y": 2, "x": {"b": 1, "a": [1]}}', None, ["c1"], 9),
        (1, 2, "call", None, "c1", "add", '{"x": {}, "y": "no"}', None, [], 9),
        (1, 3, "result", None, "c2", None, None, None, [], 9),
        (1, 4, "result", None, "zz", None, None, "x", [], 9),
        (2, 0, "call", None, "p", "add", "{broken", None, ["q"], 9),
        (2, 1, "call", None, "q", "sub", "{}", None, ["p", "nowhere"], 9),
    ]
    events = spark.createDataFrame(rows, schema)
    tools = {"add": [tool_calls.Parameter("x", "object"), tool_calls.Parameter("y", "integer")]}
    got = {(r.conv_id, r.turn): r for r in tool_calls.format_chats(events, tools).collect()}
    assert len(got) == 7 and got[1, 0].json == '{"content":"a \\"b\\"","role":"user","type":"message"}'
    assert got[1, 1].json == '{"arguments":{"x":{"a":[1],"b":1},"y":2},"id":"c2","name":"add","role":"assistant","type":"call"}'
    assert got[1, 1].level == 1 and got[1, 2].position < got[1, 1].position < got[1, 3].position and got[1, 1].linked and got[1, 1].errors == ""
    assert got[1, 2].errors == "type:y,no_result" and got[1, 4].errors == "no_call" and not got[1, 4].linked
    assert got[2, 0].errors == "not_json,cycle,no_result" and got[2, 1].errors == "unknown_tool,missing_need,cycle,no_result"
    assert tool_calls.format_chats(events.limit(0), tools).collect() == []
    plain = spark.createDataFrame([(1, 0, None, None), (None, 1, "user", "x"), (2, 0, "user", "long " * 100_000), (2, 0, "user", "again")], "conv_id long, turn long, role string, text string")
    out = tool_calls.format_chats(tool_calls.conversation_events(plain), tool_calls.TOOLS).collect()
    assert len(out) == 4 and sorted(r.position for r in out if r.conv_id == 2) == [1, 2] and {r.errors for r in out if r.conv_id == 2} == {"unknown_tool,duplicate_id,no_result"}


def test_levels_of_a_long_chain_and_a_web(spark):
    rng = random.Random(9)
    chain = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(2000)]
    web = [(2, f"n{i}", sorted({f"n{rng.randrange(i)}" for _ in range(rng.randrange(4))}) if i else []) for i in range(40)]
    rings = [(3, "a", ["b"]), (3, "b", ["a"]), (3, "c", ["b", "d"]), (3, "d", []), (3, "e", ["c"]), (3, "f", ["d"]), (3, "f", ["gone"])]
    full = [(4, f"a{i}", [f"a{j}" for j in range(i)]) for i in range(60)]  # each needs all before
    rows = [(c, x, i, n) for i, (c, x, n) in enumerate([*chain, *web, *rings, *full])]
    rng.shuffle(rows)
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic, r.missing) for r in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, turn int, needs array<string>")).collect()}
    depth = {}
    for _, name, needs in web:
        depth[name] = max((depth[x] + 1 for x in needs), default=0)
    want = {(1, f"c{i}"): (i, False, False) for i in range(2000)} | {(2, n): (d, False, False) for n, d in depth.items()}
    want |= {(3, x): (6, True, False) for x in "abce"} | {(3, "d"): (0, False, False), (3, "f"): (1, False, True)}
    want |= {(4, f"a{i}"): (i, False, False) for i in range(60)}
    assert got == want


def test_levels_of_a_ladder_take_few_rounds(spark, monkeypatch):
    """Two strands of 1,000 calls, each needing both calls before it; and one that no order of turns helps."""
    rows = [(5, f"{s}{i}", 2 * i + (s == "b"), [f"a{i - 1}", f"b{i - 1}"] if i else []) for i in range(1000) for s in "ab"]
    rows += [(6, f"{s}{i}", 900 - i, [f"a{i - 1}", f"b{i - 1}"] if i else []) for i in range(6) for s in "ab"]
    written = []
    keep = tool_calls.materialise
    monkeypatch.setattr(tool_calls, "materialise", lambda df: written.append(1) or keep(df))
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in tool_calls.levels(spark.createDataFrame(rows, "conv_id long, call_id string, turn int, needs array<string>")).collect()}
    assert got == {(c, x): (int(x[1:]), False) for c, x, *_ in rows}
    assert len(written) < 30


def test_slices_number_hot_texts_in_parallel(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(6000)]
    keys = spark.createDataFrame(rows, "doc_id long, text string").select(F.concat(sharding._hex(F.col("text")), sharding._hex(F.col("doc_id"))).alias("sort_key"), F.lit(10).cast("long").alias("size"))
    counts = sorted(r["count"] for r in keys.groupBy(sharding.slice_of(keys, 60_000)).count().collect())
    assert len(counts) > 256 and counts[-1] < 60


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 1500
    html = [long, "short", "short", None, "", "é" * 700, long, long, "y" * 400_000]
    rows = [(i, f"http://h/{i}\n%", h, "extra") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/w"
    files = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_archives(files, folder, range_bytes=97).collect()}
    assert len(got) == len(rows)
    for i, h in enumerate(html):
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest() and got[i].url == f"http://h/{i}\n%"
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 7) if i in (0, 6) else ("response", None))
        assert got[i].payload is None if i in (0, 6) else bytes(got[i].payload) == data
    empty = f"file://{tmp_path}/e"
    assert warc.read_archives(warc.write_archives(pages.limit(0), empty), empty).collect() == []


def test_reader_passes_over_magic_that_begins_no_record():
    record = warc.record("response", 1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    data = warc.MAGIC + b"rubbish" + record + warc.MAGIC + gzip.compress(b"not a record") + record
    source = io.BytesIO(data)
    whole = [at for at, _ in warc.members(source, len(data), 0, len(data))]
    assert len(whole) == 2
    for size in (1, 5, 50):
        assert [at for s in range(0, len(data), size) for at, _ in warc.members(source, len(data), s, min(len(data), s + size))] == whole


CLASHES = "size int, shard string, slot int, range int, rank int, sort_key string, before int, row string, copy int"


def test_shards(spark, rows, none):
    docs = spark.createDataFrame([(r[0], r[1], 1, "u", 2, 3, 4, "k", 5, "w", 6) for r in rows], f"doc_id long, text string, {CLASHES}").repartition(3)
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    assert Counter(tuple(r.row) for r in got) == Counter(tuple(r) for r in docs.collect())
    slots = {}
    for r in got:
        assert r["size"] == len((r.row.text or "").encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert sharding.shard(none).collect() == []


def test_splitters_against_a_sort(spark):
    rng = random.Random(10)
    keys = [(f"{rng.getrandbits(128):032x}", rng.randrange(1, 400)) for _ in range(3000)]
    hot = f"{rng.getrandbits(64):016x}"  # a group of equal texts with a third of all bytes
    keys += [(hot + f"{rng.getrandbits(64):016x}", 200) for _ in range(1500)]
    total = sum(n for _, n in keys)
    targets, most = [i * total // 8 for i in range(1, 8)], 0.002 * total / 8
    cuts = sharding.splitters(spark.createDataFrame(keys, "sort_key string, size long"), targets, [most] * 7)
    assert cuts == sorted(cuts)
    ordered = sorted(keys)
    for cut, target in zip(cuts, targets, strict=True):
        below = sum(n for k, n in ordered if k < cut)
        nearest = min(abs(target - sum(n for _, n in ordered[:i])) for i in range(len(ordered) + 1)) if abs(below - target) > most else 0
        assert abs(below - target) <= max(most, nearest)
    exact = sharding.splitters(spark.createDataFrame(keys[:50], "sort_key string, size long"), [1, 4000], [0, 0])
    for cut, target in zip(exact, (1, 4000), strict=True):
        ends = [sum(n for _, n in sorted(keys[:50])[:i]) for i in range(51)]
        assert abs(sum(n for k, n in keys[:50] if k < cut) - target) == min(abs(e - target) for e in ends)


def test_equal_sized_shards_of_one_hot_text(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg({"size": "sum"}).collect()
    total = [r[1] for r in got]
    assert len(total) == 8 and max(total) - min(total) <= 30


def test_mixing(spark):
    rng = random.Random(13)
    topics = {"t": ("tree",), "s": ("sea",)}
    rows = []
    for i in range(6000):
        text = " ".join(rng.choices(["tree", "sea", "and", "so"], [3, 1, 8, 8], k=rng.randrange(1, 60)))
        rows.append((i, text, rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 4}", True, "u", 0.5, 7))
    rows += [(9000, None, None, None, True, "u", 0.5, 7), (9001, "", "en", "hot", True, "u", 0.5, 7), *[(9002, "tree", "en", "hot", True, "u", 0.5, 7)] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean, topic string, probability double, tokens int")
    got = mixing.mixed(docs, topics=topics).collect()
    assert Counter(tuple(r.row) for r in got) == Counter(rows)
    assert all(0 <= r.probability <= 1 for r in got) and {r.topic for r in got} == {"t", "s", "other"}
    for r in got:
        text = r.row.text or ""
        assert r.tokens == len(text.split())
        n = (text.count("tree"), text.count("sea"))
        assert r.topic == ("other" if n == (0, 0) else "ts"[n.index(max(n))])
    everything = sum(r.tokens for r in got)
    drawn = [r for r in got if r.kept]
    total = sum(r.tokens for r in drawn)
    assert abs(total / everything - mixing.KEEP) < 0.01
    for margin, power in mixing.TEMPER.items():
        raw = {}
        for r in got:
            raw[r[margin]] = raw.get(r[margin], 0) + r.tokens
        shares = {k: v**power for k, v in raw.items()}
        for k, v in shares.items():
            expected = sum(r.tokens * r.probability for r in got if r[margin] == k) / everything / mixing.KEEP
            assert abs(sum(r.tokens for r in drawn if r[margin] == k) / total - expected) < 0.01
            if max(r.probability for r in got) < 1:  # otherwise a cell gives all it has
                assert abs(expected - v / sum(shares.values())) < 0.005
    kept = mixing.mix(docs)
    assert kept.columns == docs.columns and Counter(tuple(r) for r in kept.collect()) == Counter(tuple(r.row) for r in mixing.mixed(docs).where("kept").collect())
    assert mixing.mix(docs.limit(0)).collect() == []


def test_raking_meets_its_margins(spark):
    cells = spark.createDataFrame([(s, x, 100 + 7 * i) for i, (s, x) in enumerate((s, x) for s in "abc" for x in "pq")], "source string, lang string, tokens long")
    targets = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "source string, share double"), "lang": spark.createDataFrame([("p", 0.7), ("q", 0.3)], "lang string, share double")}
    fitted = mixing.rake(cells, targets, 1e-7).collect()
    total = sum(r.tokens for r in fitted)
    for key, want in (("source", {"a": 0.5, "b": 0.3, "c": 0.2}), ("lang", {"p": 0.7, "q": 0.3})):
        for value, share in want.items():
            assert abs(sum(r.weight * r.tokens for r in fitted if r[key] == value) / total - share) < 1e-6
    # Shares that contradict each other: source a has no row in q.
    few = spark.createDataFrame([("a", "p", 10), ("b", "p", 10), ("b", "q", 10)], "source string, lang string, tokens long")
    against = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "source string, share double"), "lang": spark.createDataFrame([("p", 0.2), ("q", 0.8)], "lang string, share double")}
    with pytest.warns(UserWarning, match="contradict"):
        out = mixing.rake(few, against).collect()
    assert sum(r.weight * r.tokens for r in out) == pytest.approx(30) and {r.residual > 0.1 for r in out} == {True}
