"""Rows without an id, and ids that repeat, in the operators that keep them."""

import hashlib
import random

import public_tokenizers
import pytest

from framelore.llm import fingerprint, mixing, packing, sharding, warc

SCHEMA = "doc_id long, text string, lang string, source string, row string, slot long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(81)
    words = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    found = [(i, words(rng.randrange(3, 60)), "en", "s", "r", i) for i in range(12)]
    return [*found, found[3], found[3], (None, words(20), "en", None, "r", 1), (None, None, None, "s", None, None), (None, words(20), "en", "s", "r", 1), (99, words(40_000), "en", "s", "r", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_fingerprints(docs, rows):
    got = fingerprint.fingerprints(docs).collect()
    size = lambda d, n: (d is not None, d or 0, n)
    assert sorted(size(r.doc_id, r.n_chars) for r in got) == sorted(size(r[0], len(r[1] or "")) for r in rows)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1


def test_packing(docs, rows):
    got = packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER)).collect()
    tokens = {}
    for r in got:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens.keys() == {r[0] for r in rows}
    assert sum(tokens.values()) == sum(r.doc_tokens for r in got if r.start == 0)
    assert sum(r.start == 0 for r in got) == len(rows)


def test_shards(docs, rows):
    got = sharding.shard(docs).collect()
    assert sorted((r.row.doc_id is not None, r.row.doc_id or 0, r.size) for r in got) == sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_mixing_of_very_long_texts(docs, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    assert {r.tokens for r in got if r.row.doc_id == 99} == {40_000}
    assert {r.tokens for r in got if r.row.text is None} == {0}


def test_archives(spark, tmp_path):
    big, other = "x" * 1500, "y" * 1500
    pages = [(5, "u", big), (7, "u", big), (None, "u", big), (7, "v", big), (8, "u", other), (8, "u", "short"), (None, None, "short"), (9, "u", None)]
    folder = f"file://{tmp_path}/warc"
    files = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), folder)
    got = warc.read_archives(files, folder).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    kind = lambda p, h: "revisit" if h == big and p != 7 else "response"
    want = [(p, len(h or ""), sha(h), kind(p, h), 7 if kind(p, h) == "revisit" else None) for p, _, h in pages]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
