"""The pipeline's stages, one after the other, against brute force over a small corpus."""

import random
import zlib

import numpy as np

import corpus_pipeline
from quillspark.llm import mixing, quality, tokens
from tests.llm.test_operators import brute_components, edited


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    vocab = [f"word{k}" for k in range(500)]
    text = lambda n: ". ".join(" ".join(rnd.choice(vocab) for _ in range(10)) for _ in range(n)) + "."
    texts = {k: text(20) for k in range(60)}
    item = " ".join(rnd.choice(vocab) for _ in range(25))
    texts |= {100: texts[3], 101: edited(texts[4], 0.01, rnd) + " .", 102: "short", 103: text(20) + " " + item + ".", 104: None}
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    good = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    clean = {r.doc_id: r for r in good.collect()}
    assert set(texts) - set(clean) == {102, 104}
    kept = {r[0] for r in brute_components([(k, r.text) for k, r in clean.items()], 80) if r[3]}
    assert {100, 101}.isdisjoint(kept)
    after = {k: clean[k] for k in kept if k != 103}
    table = spark.createDataFrame(list(after.values()), docs.schema)
    copies = [r.doc_id for r in sorted(mixing.mix(table).collect(), key=lambda r: r.order_key)]
    plain, at, want = Tokenizer.from_file(tokens.tokenizer_file()), 0, []
    for k in copies:
        ids = [*plain.encode(after[k].text, add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixture", "token_ids"]
    assert quality.MIN_WORDS == 50
