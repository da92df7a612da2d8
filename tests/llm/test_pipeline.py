"""The pipeline against its stages done by hand on the smallest table."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from framelore.llm import mixing, near_dedup, packing, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.materialise(corpus_pipeline.reject_toxic(spark, docs, SF))
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = {d: t for d, t in before.items() if model.score(toxicity.hashed(toxicity.features_of_words(toxicity.words_of(t)))) < 0.5}
    assert clean.columns == columns and {r.doc_id: r.text for r in clean.collect()} == expected
    single = corpus_pipeline.near_dedup_stage(spark, clean, SF)
    sets = {d: near_dedup.shingles(t) for d, t in expected.items()}
    kept = {r.doc_id for r in single.collect()}
    for a in expected:
        assert a in kept or any(near_dedup.similar(sets[a], sets[b]) for b in expected if b != a)
        assert a not in kept or not any(near_dedup.similar(sets[a], sets[b]) for b in kept if b != a)
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]


def test_last_stages_give_whole_results(spark, tmp_path):
    """What mixing draws is what its SQL draws from the same rows; packing holds each token of those once."""
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 > 0").write.parquet(f"file://{tmp_path}/single")
    single = spark.read.parquet(f"file://{tmp_path}/single")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/single/*.parquet'")
    drawn = {d for (d,) in con.sql(f"SELECT doc_id FROM ({mixing.SQL}) AS x WHERE kept").fetchall()}
    mixed = corpus_pipeline.mix_sources(spark, single, SF)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert texts == {r.doc_id: r.text for r in single.collect() if r.doc_id in drawn} and 0 < len(drawn) < single.count()

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    pieces, sequences = {}, {}
    for r in corpus_pipeline.pack_sequences(spark, mixed, SF).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys() and all(_gapless(p) == len(ids[d]) for d, p in pieces.items())
    assert sorted(sequences) == list(range(len(sequences))) and all(_gapless(p) <= packing.CAPACITY for p in sequences.values())
    # Some classes' last bins are left over, so few documents pad more than many.
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / packing.CAPACITY + 1


def _gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


def test_pipeline_of_odd_rows(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, root long, text_key string"
    rows = [(1, text, "en", None, 1, "r", 1, 2, "k"), (2, text + " more", None, "s", 1, "r", 1, 2, "k"), (3, None, None, None, None, None, None, None, None), (None, "", "en", "s", 0, "r", 1, 2, "k"), (1, text, "en", None, 1, "r", 1, 2, "k")]
    for name, found in (("some", rows), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        docs = spark.createDataFrame(found, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)][: len(found)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialise(stage(spark, docs, folder))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        assert {(r.doc_id, r.text) for r in docs.collect()} <= {(r[0], r[1]) for r in found}
        assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in docs.collect()}
