"""The pipeline's stages on a table with planted copies, passages and odd rows."""

import random

import pytest

pytest.importorskip("corpusloom.llm")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("th", "er", "on", "in", "st")) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(200) for _ in range(30)]
    passage = text(30)
    near = base[1].split(" ")
    near[50] = "altered"
    rows = list(enumerate(base))
    rows += [(100, base[0].upper()), (101, " ".join(near)), (102, base[2] + " " + passage + " " + base[3]), (103, passage), (104, None), (105, ""), (106, "12 34"), (107, base[4]), (5, base[5]), (None, text(100))]
    path = tmp_path_factory.mktemp("pipe")
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, text(25))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), base, passage


def test_stages(spark, folder):
    path, base, passage = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.select("doc_id").distinct().count() == docs.count() or name == "language_id"
    assert not {104, 105, 106} & set(seen["language_id"]) and set(range(30)) <= set(seen["language_id"])
    assert set(seen["exact_dedup"]) == (set(range(30)) - {0, 4}) | {100, 101, 102, 103, 107, None}
    assert set(seen["near_dedup"]) == set(seen["exact_dedup"]) - {101}
    clean = seen["decontaminate"]
    assert 103 not in clean and passage not in clean[102] and clean[102].split() == f"{base[2]} {base[3]}".split()
    assert all(clean[k] == t for k, t in seen["near_dedup"].items() if k in clean and k != 102)
    last = {r["doc_id"]: r for r in docs.collect()}
    assert set(last) == set(clean) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last.values())


def test_run(spark, folder):
    path, *_ = folder
    assert corpus_pipeline.run(spark, path).count() > 25
