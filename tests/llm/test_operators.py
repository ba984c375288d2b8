"""Each operator against a plain form, with nulls, ties, repeated rows, empty and long texts, clashing columns."""

import base64
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import ann, bpe, debruijn_dedup, exact_dedup, langid, packing, ppm, simhash, suffix_dedup, warc
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block int, kept string, lang string"


def texts():
    """Odd rows: nulls, equal ids, blanks, passages that many rows share, long runs, repeated rows."""
    rng = random.Random(5)
    passages = [" ".join(rng.choice(["a", "bc", "É", "the", "Tree"]) for _ in range(70)) for _ in range(5)]
    rows = []
    for i in range(90):
        text = rng.choice([None, "", " \n\t", "a " * rng.randint(10, 60), "x" * rng.randint(40, 300), rng.choice(passages) + "\n \t" + rng.choice(passages)[: rng.randint(1, 99)], rng.choice(passages)[rng.randint(0, 60) :] + " y z" * rng.randint(0, 12)])
        rows.append((rng.choice([i, i, i, None, 5]), text))
    return rows + [(900, "one two"), (900, "one two"), (901, "long " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "k", None) for i, t in texts()], SCHEMA).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=str)


def of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("block_bytes", [3000, 10**8])
def test_suffix_dedup(odd, block_bytes):
    assert rows(suffix_dedup.remove_repeats(odd, block_bytes=block_bytes, texts=False)) == H.byte_repeats(texts())


def test_suffix_dedup_texts(odd):
    for r in suffix_dedup.remove_repeats(odd, block_bytes=2000).collect():
        assert H.sha(bytes(r["kept"])) == r["kept_sha256"]


def test_bucket_pointers():
    text = np.frombuffer(b"abracadabra" * 9 + b"x" + b"abracadabra" * 6, np.uint8)
    starts, group = suffix_dedup.window_groups(text, np.array([0, len(text)]))
    b, by = text.tobytes(), {}
    for p in range(len(b) - 49):
        by.setdefault(b[p : p + 50], []).append(p)
    assert sorted(starts.tolist()) == sorted(p for v in by.values() if len(v) > 1 for p in v)
    assert all(len({b[p : p + 50] for p in starts[group == g]}) == 1 for g in set(group.tolist()))


@pytest.mark.parametrize("block_bytes", [3000, 10**8])
def test_debruijn_dedup(odd, block_bytes):
    assert rows(debruijn_dedup.remove_repeats(odd, block_bytes=block_bytes, texts=False)) == H.word_repeats(texts())


def test_debruijn_texts(docs):
    was = {r["doc_id"]: r for r in docs.collect()}
    want = {r[0]: r for r in H.word_repeats(of(docs))}
    got = debruijn_dedup.without_repeats(docs).collect()
    assert len(got) == len(was)
    for r in got:
        if want[r["doc_id"]][2] == 0:
            assert r == was[r["doc_id"]]
        assert H.sha(b" ".join(H.words(r["text"]))) == want[r["doc_id"]][3]


def test_exact(odd, docs):
    assert rows(exact_dedup.exact_groups(odd)) == H.exact(texts())
    assert rows(exact_dedup.exact_groups(docs)) == H.exact(of(docs))


def test_exact_keep_one(odd):
    kept = rows(exact_dedup.keep_one(odd), "doc_id", "text")
    assert sorted((t or "") for _, t in kept) == sorted({t or "" for _, t in texts()})


def test_polynomials_compose():
    rng = np.random.default_rng(1)
    for n in (0, 1, 70_000, 200_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        whole = exact_dedup.fingerprints(data, np.array([0, n]))[0]
        cut = n // 3
        parts = exact_dedup.fingerprints(data, np.array([0, cut, n]))
        split = [(int(x) >> 31, int(x) & (1 << 31) - 1) for x in parts]
        a, b = exact_dedup.combine(split[0], split[1], cut)
        assert whole == a << 31 | b


def test_simhash(odd, docs):
    assert rows(simhash.near_groups(odd)) == H.near(texts())
    assert rows(simhash.near_groups(docs)) == H.near(of(docs))


def test_golay():
    words = np.random.default_rng(2).integers(0, 1 << 23, 500)
    for i in range(23):  # what differs in a bit has its key among the near keys
        row, key = simhash.near_keys(words, 23)
        own = simhash.codeword(words ^ (1 << i))
        assert all(own[j] in key[row == j] for j in range(0, 500, 50))
    assert max(np.bincount(row)) <= 6


def test_fuzzy_keys_meet():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    both = np.unique(np.concatenate([a, b]))
    key, row, probe = simhash.fuzzy_keys(both)
    order = np.lexsort((probe, key))
    x, y = simhash.near_pairs(key[order].astype(np.uint64), both[row][order], probe[order], 4)
    found = {frozenset((int(both[row][order][i]), int(both[row][order][j]))) for i, j in zip(x, y, strict=True)}
    assert all(frozenset((int(u), int(v))) in found for u, v in zip(a, b, strict=True) if u != v)


def test_crowded_key():
    fp = np.arange(700, dtype=np.uint64)  # neighbours differ in few bits: one component
    x, y = simhash.near_pairs(np.zeros(700, np.uint64), fp, np.zeros(700, bool), 4)
    assert len(set(simhash.forest(x, y, 700).tolist())) == 1 and len(x) < 4000


@pytest.mark.parametrize("block_bytes", [2000, 10**8])
def test_ppm(odd, block_bytes):
    got = rows(ppm.score(odd, block_bytes=block_bytes))
    for a, b in zip(got, H.ppm(texts()), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_ppm_is_a_distribution():
    # over all symbols, the shares after any context of a small model add up to at most one, to one with 256 bytes
    triples = np.array([ord("a") << 16 | ord("b") << 8 | ord("b"), ord("b") << 16 | ord("a") << 8 | ord("a")], np.uint32), np.array([3, 2])
    context = 0
    for c in b"ab\n\n\n":
        context = context << 8 | c
    keys = np.array([context << 8 | s for s in range(256)], np.uint64)
    counts = np.zeros(256, np.int64)
    counts[ord("b")] = 3
    assert math.isclose((10 ** ppm.log_probabilities(keys, counts, triples)).sum(), 1.0, rel_tol=1e-9)


@pytest.fixture(scope="module")
def own():
    import public_tokenizers as public
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk_bytes", [500, 10**8])
def test_bpe(spark, own, chunk_bytes):
    rng = random.Random(4)
    data = [(1, "Hello  world's   \n\n test  x\u0085y 'll  "), (2, None), (2, ""), (None, "日本語 🎉🎉 naïve ١٢٣ ½"), (3, "a" * 300 + " " * 400 + "é" * 200), (4, "<|endoftext|> \x00\x1c '''s 'S"), (4, "<|endoftext|> \x00\x1c '''s 'S")]
    letters = ["a", "b", "e", "ing", "THE", "é", "日本", "の", "tion", "aaa"]
    data += [(9, "".join(rng.choice(letters) for _ in range(n))) for n in (3, 20, 30, 31, 32, 64, 65, 66, 200, 500) for _ in range(4)]  # long letter runs
    df = spark.createDataFrame([(*x, 7, "w") for x in data], "doc_id long, text string, chunk int, bucket string")
    got = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(bpe.encode(df, chunk_bytes=chunk_bytes)).collect()), key=str)
    assert got == sorted(((i, own.encode_ordinary(t or ""), (t or "").encode()) for i, t in data), key=str)
    assert bpe.encode(df.limit(0)).count() == bpe.digests(df.limit(0)).count() == 0


def test_bpe_digests(docs, own):
    want = []
    for i, t in of(docs):
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), H.sha(" ".join(map(str, ids)).encode()), H.sha((t or "").encode())))
    assert rows(bpe.digests(docs)) == sorted(want, key=str)


def test_packing(odd, spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    data = [*texts(), (7000, "İstanbul ΑΣ Σ.x '  x 123 don't Don't, A.Σ ΑΣ. J\u030c J\u030c, É, é. × ×, a×. x… x…, 'S, 'r, W.! ,. a,, «É»,"), (7001, "word " * 9000)]
    found = packing.pack(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = []
    for i, text in data:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, a, min(4096, len(ids) - a), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    bins: dict = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096


def test_packer_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert [p.place(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # bin 1 (free 3) closes before bin 0 (free 4)
    assert p.place(4) == (0, 6)


def test_warc(spark, tmp_path):
    data = [(1, None, None), (2, "h ttp://x\r\n", ""), (None, "u", "x"), (3, "u", "y"), (3, "u", "y"), (5, "u", "é" * 99), (9, "v", "é" * 99)]
    df = spark.createDataFrame([(*r, 0) for r in data], "page_id long, url string, html string, digest int")
    got = rows(warc.round_trip(df, f"file://{tmp_path}/w"))
    d = lambda s: warc.digest(s.encode())
    assert got == sorted([(1, 0, d(""), "revisit", 2), (2, 0, d(""), "response", None), (None, 1, d("x"), "response", None), (3, 1, d("y"), "response", None), (3, 1, d("y"), "revisit", 3), (5, 198, d("é" * 99), "revisit", 9), (9, 198, d("é" * 99), "response", None)], key=str)
    whole = {r["record_id"]: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    assert all(r["digest_ok"] for r in whole.values()) and sum(r["payload"] is not None for r in whole.values()) == 4
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_rejects_damage():
    good = warc.record("response", "urn:a", "u", b"body", 4, warc.digest(b"body"), None, "2020-01-01T00:00:00Z", 1)
    import io

    assert [warc.parse(m)["payload"] for m in warc.members(io.BytesIO(good + good))] == [b"body", b"body"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(good[:-9])))
    bad = warc.record("response", "urn:a", "u", b"body", 4, warc.digest(b"other"), None, "2020-01-01T00:00:00Z", 1)
    assert not warc.parse(next(warc.members(io.BytesIO(bad))))["digest_ok"]


def test_language(docs, odd):
    got = langid.identify(docs).collect()
    was = {r["doc_id"]: r["lang"] for r in docs.collect()}
    asked = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert len(got) == len(was) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == was[r["doc_id"]] for r in asked]) > 0.9
    assert {r["lang_pred"] for r in langid.identify(odd).collect()} == {"und"}  # nothing is labelled
    assert langid.identify(docs.limit(0)).count() == 0


def test_automaton():
    text = np.array([0, 1, 0, 0, 1, 2, 0])
    grid = np.array([[0, 1, 0, 2, 2, 0, 0, 1, 2]]).T  # 010 | 2 | 2 0 | 0 1 2
    assert langid.Automaton(text, 4).phrases(grid).tolist() == [4]


def test_neighbours(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    want = set()
    for i, q in data:
        if i % 50 == 0:
            s = sorted((-float(ann.cosines(q, v[None])[0]), j) for j, v in data if j != i)[:5]
            want |= {(i, j) for _, j in s}
    got = ann.nearest(df, "vec_id % 50 = 0").collect()
    assert len(got) == len(want) and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.9 * len(want)


@pytest.mark.parametrize("piece", [65_536, 64])
def test_neighbours_of_one_among_copies(spark, piece):
    """Vectors in groups of ten copies, and one without: no query goes short."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((125, 24))
    data = [(i, base[i // 10].tolist()) for i in range(1250)]
    data[0] = (0, rng.standard_normal(24).tolist())
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", piece=piece).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(50 * q, r) for q in range(25) for r in range(1, 6)]
    want = sorted((-float(ann.cosines(np.array(data[0][1]), np.array(v)[None])[0]), i) for i, v in data[1:])[:5]
    assert len({r["vec_id"] for r in got if r["query_id"] == 0} & {i for _, i in want}) >= 3


def test_neighbours_when_few_are_gathered(spark):
    """Queries that gather too few candidates are compared with all."""
    rng = np.random.default_rng(6)
    data = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    forest = ann.Forest(df, "vec_id", "embedding", 4, 32, 100, 65_536)
    got = forest.search(forest.vectors.filter("vec_id % 50 = 0"), 5, 1).collect()
    for q in range(0, 300, 50):
        true = sorted((-float(ann.cosines(np.array(data[q][1]), np.array(v)[None])[0]), i) for i, v in data if i != q)[:5]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in true]


def test_neighbours_odd(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (100, [float("nan"), 1.0]), (150, [1.0, None]), (None, [1.0, 1.0]), (200, [1.0, 2.0, 3.0]), (7, [1e200, 1e200])]
    got = rows(ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id % 50 = 0"), "query_id", "rank", "vec_id")
    assert got == sorted([(0, 1, 0), (0, 2, 1), (0, 3, 7), (0, 4, 50)] * 2 + [(50, 1, 7), (50, 2, 0), (50, 3, 0), (50, 4, 1)], key=str)


@pytest.mark.parametrize("f", [lambda d: suffix_dedup.remove_repeats(d), lambda d: debruijn_dedup.remove_repeats(d), exact_dedup.exact_groups, simhash.near_groups, ppm.score, packing.pack])
def test_empty(odd, f):
    assert f(odd.limit(0)).collect() == []
