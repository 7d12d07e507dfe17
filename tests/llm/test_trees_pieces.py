"""The Merkle manifest, whitening and SentencePiece against brute force, on nulls, empty and long texts, ties, repeated
rows, empty tables, clashing columns, and at several partitionings."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import merkle, sentence_pieces, whitening
from loomwright.llm.queries import op11_merkle_manifest, op12_embedding_whitening, op13_sentence_pieces

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The root, and for each node the runs it stands in on the way up, with its place there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // fanout], i % fanout))
            at[k] = i // fanout
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def brute_manifest(rows, tampered, fanout=16):
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    groups = {}
    for r in rows:
        own, other = h(*map(enc, r[:5])), h(*map(enc, (*r[:4], lower(r[4]))))
        groups.setdefault(key(r), []).append(((r[0] is not None, r[0] or 0, own), r[0], own, other if tampered(r[0]) else own))
    names = sorted(groups)
    lows = {}
    for g in names:
        groups[g].sort(key=lambda x: x[0])
        lows[g] = climb([x[2] for x in groups[g]], fanout)
    root, ups = climb([lows[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, ups):
        subroot, paths = lows[g]
        for (_, i, own, seen), path in zip(groups[g], paths):
            proof, now = "", seen
            for run, at in [*path, *up]:
                proof += "".join(x for k, x in enumerate(run) if k != at)
                now = h(*run[:at], now, *run[at + 1 :])
            out.append((i, own, subroot, root, h(proof), now, now == root))
    return sorted(out, key=str)


def touched(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize("parts, fanout", [(1, 16), (7, 16), (5, 2)])
def test_manifest(spark, parts, fanout):
    r = random.Random(3)
    sources = ["hot"] * 12 + ["b", "Ünder", "", None, *(f"s{i}" for i in range(20))]
    rows = [(i if i % 41 else None, r.choice(sources), r.choice(["en", None, ""]), r.choice([None, i, -1]), r.choice(["Some TEXT", "lower", "", None, "É" * 3000, f"Text {i}"]), 1, "x") for i in range(600)]
    rows += [rows[5], rows[5], (7, "alone", None, None, None, 1, "y")]
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = merkle.manifest(docs, tampered=F.crc32(docs["doc_id"].cast("string")) % 5 == 0, fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(x) for x in got.collect()), key=str)
    assert got == brute_manifest(rows, touched, fanout)
    assert 20 < sum(not x[-1] for x in got) < 200


def test_manifest_of_few(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, None, 3, "A", 0, "")], DOCS)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("1:1", "-", "-", "1:3", "1:A") and one.verified and one.proof_sha256 == h("")
    ids = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "doc_id string, source int")
    got = {x.doc_id: x for x in merkle.manifest(ids, fields=("doc_id", "source")).collect()}
    two = h(h("1:a", "1:2"), h("1:b", "1:2"))
    assert got["a"].subroot == two and got["a"].root == h(h("1:c", "1:1"), two) == got["c"].root and got["c"].proof_sha256 == h(two)


def test_manifest_query(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_manifest(rows, touched)


def brute_whitening(vectors, count=8):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    z = y / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:count]
    w = z @ vecs[:, order] / np.sqrt(values[order])
    total = sum(int(v) ** 2 for v in y.ravel()) / n**3
    return [sum(int(v) ** 2 for v in row) for row in y], w, values[order] / total


def assert_white(got, ids, vectors, count=8):
    deviation, w, explained = brute_whitening(vectors, count)
    rows = {}
    for g in got:
        rows.setdefault(g.component, {})[g.vec_id] = g
    assert len(got) == len(ids) * w.shape[1] and {g.n for g in got} == {len(ids)}
    for k in range(w.shape[1]):
        own = [rows[k + 1][i] for i in ids]
        assert [g.deviation for g in own] == deviation
        v = np.array([g.whitened for g in own])
        assert min(np.abs(v - w[:, k]).max(), np.abs(v + w[:, k]).max()) < 1e-8
        assert all(math.isclose(g.explained, explained[k], rel_tol=1e-9) for g in own)
    (error,) = {g.identity_error for g in got}
    assert error < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    assert_white(op12_embedding_whitening(spark, "/root/testdata/sf0.01").collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


@pytest.mark.parametrize("parts", [1, 6])
def test_whitening_of_odd_rows(spark, parts):
    r = random.Random(1)
    good = [(i, [r.gauss(0, k + 1) for k in range(5)]) for i in range(40)]
    good += [(100, good[0][1]), (101, [2.0, 2.0, 2.0, 2.0, 2.0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [1.0, float("nan"), 2.0, 3.0, 4.0]), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "n") for i, v in good + bad], "vec_id bigint, embedding array<double>, n string").repartition(parts)
    assert_white(whitening.whiten(table).collect(), [i for i, _ in good], [v for _, v in good], 5)
    again = table.unionByName(table.where("vec_id = 3")).withColumn("vec_id", F.lit(None).cast("string"))
    assert whitening.whiten(again, 2).count() == 2 * (len(good) + 1)


def test_whitening_of_nothing_and_large_numbers(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    wide = [[1e12, 3.0], [-2e12, 5.0], [7.5, 4e11]]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(wide)), "vec_id bigint, embedding array<double>"))
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in wide]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in got.collect()} == {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    # Two equal dimensions are one component.
    flat = spark.createDataFrame([(i, [float(i), float(i)]) for i in range(9)], "vec_id bigint, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    r = random.Random(5)
    kinds = ["ab", "a ", "▁ ", "abc \n\t", "àéß日本x ", "\0ab", "😀a ", "the and in er ", "".join(map(chr, range(32, 127)))]
    fixed = [None, "", " ", "  ", "a", " a", "\n", "▁", "▁▁ ▁", "<s>", "<0x0A>", "the <unk> </s>", " " * 5000 + "x", "x" * 3000, "=" * 999, "⁇ �", "word " * 30_000]
    return fixed + ["".join(r.choices(r.choice(kinds), k=r.randint(1, 60))) for _ in range(1500)] + ["".join(r.choices(k, k=3000)) for k in kinds]


@pytest.mark.parametrize("small", [False, True])
def test_sentence_pieces(spark, model, monkeypatch, small):
    """Against the library; small: many blocks and chunks, slices of texts, and the queue for words that wait."""
    import sentencepiece

    if small:
        for name, n in (("CHUNK", 200), ("BLOCK_WORDS", 50), ("SLICE", 40), ("WAITS", 0)):
            monkeypatch.setattr(sentence_pieces, name, n)
    lib, texts, pieces = sentencepiece.SentencePieceProcessor(model_file=model), odd_texts(), sentence_pieces.Pieces(model)
    numbers, own = {}, []
    for t in texts:
        own.append(np.array([numbers.setdefault(w, len(numbers)) for some in pieces.words(t or "") for w in some], np.int64))
    flat, sizes = sentence_pieces.encode_words(pieces, list(numbers))
    begins, table = np.cumsum(sizes) - sizes, sentence_pieces.Table(pieces.text)
    for t, words in zip(texts, own):
        ids, want = sentence_pieces.gather(flat, begins[words], sizes[words]), lib.encode(t or "")
        assert ids.tolist() == want
        assert sentence_pieces.decoded(pieces, table, ids).decode() == lib.decode(want)


def test_sentence_pieces_rows(spark, model):
    import sentencepiece

    lib, texts = sentencepiece.SentencePieceProcessor(model_file=model), odd_texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, "again", "k"), (None, "no id", None)], "doc_id bigint, text string, kept string")
    got = sentence_pieces.encode_decode(docs, model, keep=("kept",), with_ids=True, with_text=True)
    assert got.columns == ["doc_id", "kept", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id not in (3, None):
            want = lib.encode(texts[r.doc_id] or "")
            assert r.ids == want and r.n_tokens == len(want) and r.decoded == lib.decode(want)
            assert r.ids_sha256 == h(",".join(map(str, want))) and r.decoded_sha256 == h(r.decoded)
    assert sentence_pieces.encode_decode(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="n_tokens"):
        sentence_pieces.encode_decode(docs.withColumnRenamed("kept", "n_tokens"), model, keep=("n_tokens",))


def test_sentence_pieces_query(spark, model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op13_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = lib.encode(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), h(",".join(map(str, want))), h(lib.decode(want)))


def test_models_that_are_not_read(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(b"\x0a\x05\x0a\x01a\x18\x01\x12\x02\x18\x01")
    with pytest.raises(ValueError, match="BPE"):
        sentence_pieces.Pieces(str(path))
