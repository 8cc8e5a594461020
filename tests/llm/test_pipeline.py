import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 120))).capitalize() + "."
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = good()
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text, "en", rng.choice(["s0", "s0", "s1", None]), len(text)))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + k, rows[4 * k + 1 if (4 * k + 1) % 5 else 4 * k + 2][1].upper().lower(), "en", "s1", 0) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not any("###" in r["text"] for r in seen["quality"])
    assert len(seen["quality"]) >= 0.98 * (len(rows) - 120)
    texts = [r["text"].lower() for r in seen["exact"]]
    assert len(texts) == len(set(texts)) == len({r["text"].lower() for r in seen["quality"]})
    assert len(seen["near"]) <= len(seen["exact"])
    size = lambda part: sum(len(r["text"].split()) for r in part)
    assert abs(size(seen["mix"]) - 1.5 * size(seen["near"])) < 400
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in seen["pack"]) == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in seen["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["pack"])


def through(spark, tmp_path, docs, labels):
    """Rows after each stage."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert name == "pack" or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append(docs.collect())
    return seen


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, run int, score double, fp string, words int, __may int"
LABELS = "doc_id long, quality int, toxic int"


def test_empty_tables(spark, tmp_path):
    assert through(spark, tmp_path, spark.createDataFrame([], CLASHING), spark.createDataFrame([], LABELS)) == [[]] * 5


def test_nulls_ties_and_clashing_columns(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text), (2, text.upper()), (None, text), (None, None), (3, None), (4, ""), (5, " "), (None, "another text of its own"), (6, text + " eleven")]
    docs = spark.createDataFrame([(i, t, None, [None, "a"][k % 2], None, 1, 2, 0.5, "f", 3, 4) for k, (i, t) in enumerate(rows)], CLASHING)
    quality, exact, near, mixed, packed = through(spark, tmp_path, docs, spark.createDataFrame([(None, 1, 0), (1, None, 1)], LABELS))
    assert len(quality) == len(rows)  # without labels of both kinds all score 0.5
    key = lambda r: (r["text"] or "").lower()
    assert sorted(map(key, exact)) == sorted({(t or "").lower() for _, t in rows})
    assert {key(r): r["doc_id"] for r in exact} == {text: 2, "": 4, " ": 5, "another text of its own": None, text + " eleven": 6}
    assert sorted(str(r["doc_id"]) for r in near) == ["2", "4", "None"]  # 6 is like 2, and 5 like 4
    assert all(r["__may"] == 4 and r["words"] == 3 for r in near)
    assert {str(r["doc_id"]) for r in mixed} <= {"2", "4", "None"} and len(packed) == len(mixed)
