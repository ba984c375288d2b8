"""Each stage against a plain form, on the output of the one before it."""

import corpus_pipeline
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 --", "en", "s", 6)], docs.schema))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = {r["doc_id"]: r for r in docs.collect()}
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = after = {r["doc_id"]: r for r in docs.collect()}
        data = [(i, r["text"]) for i, r in before.items()]
        if k < 4:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "language ID":
            assert set(before) - set(after) == {i for i, t in data if not any(c.isalpha() for c in t or "")}
        elif name == "exact dedup":
            assert set(after) == {r[0] for r in H.exact(data) if r[3]}
        elif name == "SimHash near-dedup":
            assert set(after) == {r[0] for r in H.near(data) if r[0] == r[2]}
        elif name == "substring dedup":
            want = {r[0]: r for r in H.word_repeats(data)}
            assert set(after) == set(before)
            assert all(H.sha(b" ".join(H.words(r["text"]))) == want[i][3] for i, r in after.items())
            assert all(after[i] == before[i] for i in after if want[i][2] == 0)
            assert all(r["n_chars"] == len(r["text"]) for i, r in after.items() if want[i][2])
        else:
            assert set(after) == set(before)
