"""The pipeline's stages on the small tables: what goes, what stays, and that nothing else changes."""

import corpus_pipeline
from rulesift.llm import pieces
from rulesift.llm.queries import QUERIES
from tests.llm.test_dedup import assert_first_of_similar, bench_words, stripped

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        seen[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
        assert name == "sentencepiece" or docs.columns == columns

    before, after = seen["language_id"]
    assert len(after) >= 0.98 * len(before) and {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = seen["simhash_near_dedup"]
    assert_first_of_similar([(r["doc_id"], r["text"]) for r in before], [(r["doc_id"], r["text"]) for r in after])  # five words, 0.8, as stages take

    before, after = seen["substring_dedup"]
    want = stripped([(r["doc_id"], r["text"]) for r in before])
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in after}
    for r, (i, _, lost, kept) in zip(before, want, strict=True):
        text = " ".join(kept) if lost else r["text"]
        assert texts[i] == (text, len(text))

    before, after = seen["benchmark_decontamination"]
    items = [bench_words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(max(len(w) - 9, 1))}
    clean = [r["doc_id"] for r in before if not any(tuple(w[k : k + 10]) in windows for w in [bench_words(r["text"])] for k in range(len(w) - 9))]
    assert sorted(r["doc_id"] for r in after) == sorted(clean)

    before, after = seen["sentencepiece"]
    vocabulary, texts = pieces.Vocabulary(pieces.model_bytes()), {r["doc_id"]: r["text"] for r in before}
    import numpy as np

    assert len(after) == len(before) and all(r["lossless"] and pieces.decode(np.array(r["ids"]), vocabulary).decode() == texts[r["doc_id"]] for r in after)


def test_run_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert corpus_pipeline.run(spark, FOLDER).where("lossless").count() > 100
