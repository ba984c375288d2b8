"""Empty tables, columns with clashing or odd names, huge texts, and plain forms for what the other tests leave out."""

import io
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, bpe, debruijn_dedup, exact_dedup, langid, packing, ppm, simhash, suffix_dedup, warc
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, and one that is no identifier.
ODD = ["my-col", "_key", "_null", "_id", "key", "row", "block", "chunk", "may", "fp", "text_hash", "carried", "none", "kept", "stays", "bits", "number", "dim", "shard", "rep", "body", "words", "place", "digest", "one", "score", "letters"]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents, some null or repeated, with odd columns beside them."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(10**6, None, None, None, None), (None, "one two three", "en", "s", 13), (None, "one two three", None, "s", 13), (10**6 + 1, "", None, "s", 0), (10**6 + 1, "", None, "s", 0)], some.schema)
    both = some.unionByName(more)
    return both.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in ODD)).cache()


OPERATORS = [lambda d: suffix_dedup.remove_repeats(d, texts=False), lambda d: debruijn_dedup.remove_repeats(d, texts=False), exact_dedup.exact_groups, simhash.near_groups, ppm.score, packing.pack, bpe.digests, langid.identify]
STAGES = [f for _, f in corpus_pipeline.STAGES[:-1]]


@pytest.mark.parametrize("f", OPERATORS)
def test_other_columns_do_not_matter(docs, f):
    plain = f(docs.select("doc_id", "text", "lang"))
    drop = {"sequence_id", "offset"}
    cols = [c for c in plain.columns if c not in drop]
    assert rows(f(docs), *cols) == rows(plain, *cols)


@pytest.mark.parametrize("f", STAGES)
def test_stage_keeps_columns(spark, docs, f):
    got = f(spark, docs, SF)
    assert got.columns == docs.columns
    kept, was = got.collect(), {tuple(r[c] for c in ("doc_id", "text", *ODD)) for r in docs.collect()}
    assert kept
    cut = f is corpus_pipeline.cut_repeats
    assert {tuple(r[c] for c in ("doc_id", *ODD)) for r in kept} <= {(x[0], *x[2:]) for x in was}
    assert cut or {tuple(r[c] for c in ("doc_id", "text", *ODD)) for r in kept} <= was


@pytest.mark.parametrize("f", [*STAGES, lambda s, d, _: packing.pack(d), lambda s, d, _: bpe.digests(d), lambda s, d, _: langid.identify(d)])
def test_empty_tables(spark, docs, f):
    assert f(spark, docs.limit(0), SF).collect() == []


def test_empty_vectors_and_pages(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, dim int, tree int, row long")
    assert ann.nearest(none, "vec_id % 50 = 0").collect() == []
    asked = spark.createDataFrame([(1, [1.0, 2.0], 3, 4, 5)], none.schema)
    assert ann.nearest(asked, "vec_id % 50 = 0").collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest int, row int, place int, to int")
    assert warc.round_trip(pages).collect() == []


def test_language_fills_labels(spark):
    text = {"a": "the house of water and the house", "b": "zwölf jäger kochen das wasser am abend"}
    data = [(i, f"{text[k]} {i}", k) for i in range(40) for k in "ab"] + [(900, text["b"], None), (901, "12 34", None), (902, text["a"], "b")]
    got = {r["doc_id"]: r["lang"] for r in langid.without_rejects(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got[900] == "b" and got[902] == "b" and 901 not in got


def test_many_languages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(6))
    vocabulary = [[word() for _ in range(6)] for _ in range(90)]
    data = [(100 * k + i, " ".join(rng.choice(vocabulary[k]) for _ in range(30)), f"l{k}") for k in range(90) for i in range(12)]
    found = langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] // 100}" for r in found)


def plain_phrases(sample: list, text: list) -> int:
    """Longest matches from left to right, by search."""
    held, count, i = ",".join(map(str, ["", *sample, ""])), 0, 0
    while i < len(text):
        n = 1
        while i + n < len(text) and "," + ",".join(map(str, text[i : i + n + 1])) + "," in held:
            n += 1
        if n == 1 or "," + ",".join(map(str, text[i : i + n])) + "," in held:
            count, i = count + 1, i + n
    return count


def test_cross_parsing(spark):
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 30):
        sample, text = rng.integers(0, alphabet, 300), rng.integers(0, alphabet + 2, 200)
        got = langid.Automaton(sample, alphabet + 2).phrases(text.astype(np.int32)[:, None])
        assert got.tolist() == [plain_phrases(sample.tolist(), text.tolist())]


def test_language_costs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").limit(25)
    samples = {k: v[:1500] for k, v in langid.sample(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", "lang").items()}
    model = langid.Model(samples)
    texts = [r["text"][:1200] for r in docs.collect()]
    want = []
    for t in texts:
        s = model.symbols(t)
        cost = []
        for k, a in zip(model.names, model.automata, strict=True):
            held = model.symbols(samples[k]).tolist()
            cost.append(sum(plain_phrases(held, s[i : i + langid.SEGMENT].tolist()) for i in range(0, len(s), langid.SEGMENT)) * a.bits / len(s) if len(s) else np.inf)
        want.append(cost)
    assert np.allclose(model.costs(texts), np.array(want))


@pytest.mark.parametrize("huge", [1, 1000, 10**9])
def test_huge_texts(spark, huge):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    data = [(1, base), (2, base), (3, base[:-1] + "!"), (4, "!" + base[1:]), (5, base[: 1 << 20]), (6, base[: 1 << 20]), (7, "x"), (None, "x"), (8, ""), (9, None), (2, base)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(exact_dedup.exact_groups(df, huge=huge)) == H.exact(data)


def test_equal_fingerprints_of_different_texts():
    table = lambda *r: pa.RecordBatch.from_pylist([dict(zip(("fp", "n", "rep", "piece", "bytes"), x, strict=True)) for x in r])
    one = [(7, 3, "a", 0, b"x"), (7, 3, "b", 0, b"x"), (7, 3, "c", 0, b"y"), (7, 3, "d", 0, b"x"), (7, 3, "a", 1, b"p")]
    two = [(7, 3, "b", 1, b"q"), (7, 3, "c", 1, b"p"), (7, 3, "d", 1, b"q"), (8, 3, "e", 0, b"x")]
    out = [x for b in exact_dedup._settle([table(*one), table(*two)]) for x in zip(b["rep"].to_pylist(), b["member"].to_pylist(), strict=True)]
    assert dict(out) == {"a": "a", "b": "b", "c": "c", "d": "b", "e": "e"}


def test_large_payload(spark, tmp_path):
    big = "é" * 3_000_000
    data = [(1, "u", big), (2, "u", big), (3, "u", "s"), (4, "u", big + "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = warc.round_trip(df, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 6_000_000, "revisit", 2), (2, 6_000_000, "response", None), (3, 1, "response", None), (4, 6_000_001, "response", None)]
    assert {len(r["payload"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").filter("payload IS NOT NULL").collect()} == {6_000_000, 1, 6_000_001}
    assert len(list(warc.members(io.BytesIO(b"")))) == 0


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.round_trip(df, f"file://{tmp_path}/w", least_bytes=3).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "revisit"), (4, "response")]


@pytest.mark.parametrize("piece", [300, 10**6])
def test_forest_recall(spark, piece):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 24))
    data = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    v = ann.unit(np.array([x for _, x in data]))
    want = set()
    for i in range(0, 1500, 50):
        s = v @ v[i]
        s[i] = -9
        want |= {(i, int(j)) for j in np.argsort(-s)[:5]}
    got = ann.nearest(df, "vec_id % 50 = 0", trees=24, piece=piece, shard=400).collect()
    assert len(got) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)
    assert all(abs(r["score"] - float(ann.cosines(np.array(data[r["query_id"]][1]), np.array([data[r["vec_id"]][1]]))[0])) < 1e-12 for r in got)


def test_strings_share_prefixes():
    a = np.array([0b1010 << 28, 0b1010 << 28, 0], np.uint64)
    b = np.array([0b1010 << 28, 0b1011 << 28, 1 << 31], np.uint64)
    assert ann.shared(a, b, 32).tolist() == [32, 3, 0]


def test_whole_documents(spark):
    """On the documents themselves, as the queries have them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows(suffix_dedup.remove_repeats(docs, texts=False)) == H.byte_repeats(data)
    few = sorted(data)[:40]
    got = rows(ppm.score(docs.join(spark.createDataFrame([(i,) for i, _ in few], "doc_id long"), "doc_id")))
    for a, b in zip(got, H.ppm(few), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_heavy_keys(spark):
    """Copies of one text, and a star of near copies, beside many others."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    data = [(i, " ".join(base)) for i in range(700)]
    for i in range(700, 900):
        near = list(base)
        near[rng.randrange(400)] = rng.choice(words)
        data.append((i, " ".join(near)))
    data += [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(900, 1100)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(simhash.near_groups(df)) == H.near(data)


def test_paths_are_whole(spark):
    """A passage of many windows is one path, whatever buckets its edges met in, where all places have all of it."""

    def place(block, row, start, *segments):
        """Segments (windows, source, at, node before, node after), one after the other."""
        out = []
        for k, (windows, source, at, enter, leave) in enumerate(segments):
            out.append((block, row, start, windows, source, at, enter, leave, k > 0, k < len(segments) - 1))
            start += windows
        return out

    a, b, c = (3, 9, 0, 100, 101), (4, 9, 3, 101, 102), (1, 9, 7, 102, 103)
    d, e = (2, 9, 15, 104, 105), (2, 9, 30, 105, 106)  # the source has them apart
    f, g, h = (5, 8, 0, 200, 201), (6, 8, 5, 201, 202), (7, 8, 5, 201, 203)  # two ways on
    spans = [*place(0, 1, 5, a, b, c), *place(0, 2, 0, a, b, c), *place(0, 1, 20, d, e), *place(1, 1, 8, f, g), *place(1, 2, 8, f, h)]
    got = rows(debruijn_dedup.compacted(spark.createDataFrame(spans, debruijn_dedup.SPAN), len(spans)))
    want = [(0, 1, 5, 8, 9, 0), (0, 2, 0, 8, 9, 0), (0, 1, 20, 2, 9, 15), (0, 1, 22, 2, 9, 30), (1, 1, 8, 5, 8, 0), (1, 1, 13, 6, 8, 5), (1, 2, 8, 5, 8, 0), (1, 2, 13, 7, 8, 5)]
    assert got == sorted(want, key=str)


def test_crowded_keys_by_bands():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = [centres]
    for _ in range(3):
        near = centres.copy()
        for i in range(len(near)):
            for k in rng.choice(64, rng.integers(1, 5), replace=False):
                near[i] ^= np.uint64(1) << np.uint64(k)
        fps.append(near)
    fp = np.unique(np.concatenate(fps))
    x, y = simhash.near_pairs(np.zeros(len(fp), np.uint64), fp, np.zeros(len(fp), bool), 4)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert simhash.forest(x, y, len(fp)).tolist() == simhash.forest(i, j, len(fp)).tolist()
