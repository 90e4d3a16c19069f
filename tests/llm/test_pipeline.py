"""The stages of the pipeline over one table: which documents each of them writes."""

import collections
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline


def test_every_stage_takes_effect(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    syllables = {"ww": ["ka", "lo", "mi"], "xx": ["str", "ung", "ör"], "yy": ["eau", "éc", "chi"], "zz": ["wy", "prz", "szo"]}
    texts = {i: (" ".join("".join(rng.choice(syllables[a], 4)) for _ in range(40)), a) for i, a in enumerate(list(syllables) * 12)}
    item = " ".join(f"lokami{a}{b}" for a in "abcd" for b in "efg")
    texts |= {100: ("12 34 !!", "ww"), 101: (None, None), 102: (texts[0][0] + " lokami", "ww"), 103: (texts[5][0], "xx"), 104: (f"{texts[4][0][::-1]} {item} kalo", "ww")}
    rows = [(i, t, a, "s", len(t or "")) for i, (t, a) in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_path", lambda spark, name: f"{tmp_path}/{name}")
    corpus_pipeline.run(spark, str(tmp_path))
    written = {name: spark.read.parquet(f"{tmp_path}/pipeline-{name}").collect() for name, _ in corpus_pipeline.STAGES}
    gone = {"language": {100, 101}, "near_duplicates": {102, 103}, "decontamination": {104}}
    left = set(texts)
    for name, ids in gone.items():
        left -= ids
        assert sorted((r.doc_id, r.text) for r in written[name]) == sorted((i, texts[i][0]) for i in left)
    assert written["mixture"] and {r.doc_id for r in written["mixture"]} <= left
    coder = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    ids = [(r.doc_id, [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in written["mixture"]]
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in written["token_records"]) == want
