"""Rows that an operator once left out or got wrong."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import debruijn_dedup, langid, packing, warc
from tests.llm import helpers as H


@pytest.mark.parametrize("period", [12, 13, 14])
def test_debruijn_period(spark, period):
    other = " ".join(f"x{i}" for i in range(25))
    data = [(1, " ".join([" ".join(f"w{i}" for i in range(period))] * 3)), (2, other), (3, other)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = debruijn_dedup.remove_repeats(df, texts=False).collect()
    assert sorted((tuple(r) for r in got), key=str) == H.word_repeats(data)


@pytest.mark.parametrize("langs", [[None] * 4, [None, "en", None, None]])
def test_language_without_labels(spark, langs):
    texts = ["some words", "more words here", None, "12 34"]
    ids = [1, next(i for i in range(2, 99) if zlib.crc32(str(i).encode()) % 3 == 1), 100, 101]  # the labelled row is held out
    df = spark.createDataFrame(list(zip(ids, texts, langs, strict=True)), "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.without_rejects(df).collect()) == ids[:2]


def test_language_of_long_texts(spark):
    rng = random.Random(3)
    ids = [i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1][:9]
    some = lambda of, n: " ".join(rng.choice(of) for _ in range(n))
    a, b = ["the", "house", "of", "water"], ["und", "zwölf", "jäger", "kochen"]
    data = [(i, some(a, 50), "en") for i in ids[:4]] + [(i, some(b, 9000), "de") for i in ids[4:8]] + [(ids[8], some(b, 60), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = langid.sample(df, "doc_id", "text", "lang")
    assert all(0 < len(t) <= langid.SAMPLE_CHARS for t in got.values()) and len(got["de"]) > 0.99 * langid.SAMPLE_CHARS
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()} == {i: "en" if i in ids[:4] else "de" for i in ids}


def test_packing_literals(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = ["hello <|endoftext|> world", "<|ENDOFTEXT|> <|EndOfText|>", "A<|endoftext|>. B", "X<|startoftext|><|endoftext|>É ", "<|endof text|> <|endoftext|", "e<|endoftext|>\u0301 <|endoftext|>\n\t<|endoftext|>s", "plain Text."]
    found = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in texts]
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in found) == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)]


@pytest.mark.parametrize("url", ["http://x/" + "u" * (3 << 20), "http://x/" + " " * 400_000])
def test_warc_long_url(spark, tmp_path, url):
    df = spark.createDataFrame([(1, url, "page"), (2, url, "page"), (3, "u", "other")], "page_id long, url string, html string")
    got = warc.round_trip(df, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, 4, "revisit", 2), (2, 4, "response", None), (3, 5, "response", None)]
    said = {r["target_uri"] for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert said == {url.replace(" ", "%20"), "u"}


@pytest.mark.parametrize("partitions", [1, 64])
def test_packing_waste(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions, "doc_id")
    found = packing.pack(docs).select("length", "sequence_id", "offset").collect()
    bins: dict = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    assert len(bins) <= 1.01 * -(-sum(r["length"] for r in found) // packing.LENGTH) + 1


def test_warc_archives_by_bytes(spark, tmp_path):
    pages = spark.range(40_000).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(chr(97 + CAST(id % 7 AS INT)), 50) AS html").repartition(12)
    got = {}
    for name, size in (("one", 1 << 30), ("many", 100_000)):
        folder = f"file://{tmp_path}/{name}"
        for _ in range(2):  # the second run's files take the place of the first's
            assert warc.write_warc(pages, folder, archive_bytes=size) == 40_000
        got[name] = sorted((r["record_type"], r["target_uri"], r["refers_to"] or "") for r in warc.read_warc(spark, folder, payloads=False).collect())
    held = {n: [x for x in (tmp_path / n).glob("*.warc.gz")] for n in got}
    assert got["one"] == got["many"] and sum(t == "response" for t, *_ in got["one"]) == 7
    assert len(held["many"]) == 20 > len(held["one"])
