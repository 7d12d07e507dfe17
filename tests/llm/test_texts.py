"""Line dedup, decontamination, BPE, SimHash, licences and the language model against brute force, on nulls, empty and
long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loomwright.llm import bpe, decontaminate, kneser_ney, license_scan, line_dedup, simhash
from loomwright.llm.components import Forest, components
from loomwright.llm.common import shared_dir

SPACE = " \t\n\x0b\x0c\r"
WORDS = "alpha Beta GAMMA delta épée ÉPÉE zeta eta theta iota kappa lambda naïve 日本 x1 9".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def texts(seed=0, n=60):
    r = random.Random(seed)
    common = ["A line that many documents have.", "  a LINE that many documents have.\t", "éa shared line of öther letters", "short", ""]
    out = []
    for _ in range(n):
        out.append("\n".join(r.choice(common) if r.random() < 0.4 else " ".join(r.choices(WORDS, k=r.randint(0, 14))) for _ in range(r.randint(1, 8))))
    return [*out, None, "", " ", "\n\n", "x" * 70_000, ("word " * 30_000).strip(), out[0], out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept_text int")


EMPTY = "doc_id bigint, text string"


def rows_of(df):
    return df.toPandas().set_index("doc_id")


def test_line_dedup(spark, docs):
    got = rows_of(line_dedup.dedup_lines(docs))
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    for i, t in enumerate(texts()):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    dropped = 0
    for i, t in enumerate(texts()):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        assert (got.kept_text[i], got.n_lines[i], got.n_dropped[i]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
        dropped += len(lines) - len(kept)
    assert dropped > 20
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).count() == 0


def test_line_dedup_repeated_and_null_ids(spark):
    line = "the very same line of a text"
    rows = [(1, line), (1, line), (None, line + "\nother"), (2, None), (2, line + "\nx"), (2, "y\n" + line)]
    got = sorted((str(r.doc_id), r.kept_text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, EMPTY)).collect())
    assert got == sorted([("1", ""), ("1", ""), ("None", "other"), ("2", ""), ("2", line + "\nx"), ("2", "y\n" + line)])


def test_line_bitmaps_are_sparse(spark):
    body = "\n".join(f"line number {i} of a long document" if i not in (3, 700) else "a line that occurs in all of them" for i in range(701))
    got = {r.doc: r for r in line_dedup.keep_bitmaps(spark.createDataFrame([(i, body) for i in range(3)], EMPTY)).collect()}
    assert set(got) == {0, 1} and len(got[0].keep) == 11 and got[0].n_dropped == 701
    one = line_dedup.keep_bitmaps(spark.createDataFrame([(i, f"{i}\n" * 200 + "a line that occurs in all of them") for i in range(4)], EMPTY)).collect()
    assert all([tuple(x) for x in r.keep] == [(3, ~(1 << 8))] for r in one) and len(one) == 3


def test_line_dedup_streams_in_order(spark, docs):
    """Ranges are sorted, no exchange follows, and a window streams through them."""
    lines = spark.createDataFrame([(1, 2, 3, 4, 5)], "h1 bigint, h2 bigint, salt smallint, doc bigint, pos int")
    plan = line_dedup.ordered_lines(lines)._jdf.queryExecution().executedPlan().toString()
    body = plan[plan.index("Window") :]
    assert plan.count("Exchange") == 1 and "rangepartitioning(h1" in plan and "Sort [h1" in body and "Aggregate" not in plan and "doc#" in body[body.index("Sort [h1") :]


def test_line_dedup_string_ids(spark):
    line = "the very same line of a text"
    rows = [("b", line), ("c", line + "\nx"), ("a", line), (None, line)]
    got = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": "", "b": "", "c": line + "\nx", None: ""}


def brute_hits(rows, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = {}
    for i, t in rows:
        w, hit, names = find(t), set(), set()
        for name, text in items:
            v = find(text)
            n = min(size, len(v))
            for k in range(len(v) - n + 1) if v else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[k : k + n]:
                        hit |= set(range(j, j + n))
                        names.add(name)
        out[i] = (len(w), len(hit), sorted(map(str, names)))
    return out


@pytest.mark.parametrize("part_bytes", [4 << 20, 60])
def test_decontamination(spark, part_bytes):
    r = random.Random(3)
    vocabulary = "a b c d e é 1 22 of the".split()
    items = [(i, " ".join(r.choices(vocabulary, k=k))) for i, k in enumerate([0, 1, 3, 9, 10, 11, 25, 14])] + [(8, None), (9, "the, THE; the")]
    rows = [(i, " ".join(r.choices(vocabulary, k=40))) for i in range(6)]
    rows += [(6, "x " + items[6][1].upper().replace(" ", ", ") + " y"), (7, None), (8, ""), (9, items[4][1] + "!" + items[5][1]), (10, items[4][1]), (11, "...")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], EMPTY + ", hit int")
    got = {x.doc_id: x for x in decontaminate.search(df, spark.createDataFrame(items, "item_id bigint, text string"), decontaminate.Windows(10, part_bytes)).collect()}
    for i, (n, hit, names) in brute_hits(rows, items).items():
        x = got[i]
        assert (x.n_words, x.n_hit, x.items, x.n_items, x.contaminated) == (n, hit, names, len(names), hit > 0)
        assert x.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert got[6].contaminated and got[9].n_items >= 2


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontaminate.search(docs, none).collect())
    assert decontaminate.search(spark.createDataFrame([], EMPTY), none).count() == 0
    kept = decontaminate.search(docs, none, keep=("text", "n_words", "kept_text"))
    assert kept.columns[:4] == ["doc_id", "text", "n_words", "kept_text"] and kept.count() == docs.count()


def test_bpe(spark, docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(bpe.encode_decode(docs, path, P.PATTERN, with_ids=True, with_text=True))
    for i, t in enumerate(texts()):
        ids = own.encode_ordinary(t or "")
        assert list(got.ids[i]) == ids and got.n_tokens[i] == len(ids) and got.decoded[i] == (t or "")
        assert got.ids_sha256[i] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(spark.createDataFrame([], EMPTY), path, P.PATTERN).count() == 0
    r = random.Random(5)
    letters = [chr(i) for i in range(256)] + list("\u00a0\u2003\u3000日本語🙂é²½٣\x1c\x85 \t\n\r") + ["aaaa", "the ", "ing", "'s", "'ll"]
    odd = ["".join(r.choices(letters, k=r.randint(0, 25))) for _ in range(3000)]
    df = spark.createDataFrame([(i % 7 or None, t, i) for i, t in enumerate(odd)], EMPTY + ", ids bigint")
    got = {x.ids: x.ids_sha256 for x in bpe.encode_decode(df, path, P.PATTERN, keep=("ids",)).collect()}
    assert got == {i: hashlib.sha256(np.array(own.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(odd)}


def test_bpe_of_many_blocks(spark):
    """Words in many blocks, very long words: the same ids wherever a text lies."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = [(i, t) for i, t in enumerate([*texts(), "y" * 300_000, "ab" * 100_000])]
    whole = {x.doc_id: x.ids_sha256 for x in bpe.encode_decode(spark.createDataFrame(rows, EMPTY), path, P.PATTERN).collect()}
    parts = bpe.encode_decode(spark.createDataFrame(rows[::-1], EMPTY).repartition(7), path, P.PATTERN)
    assert whole == {x.doc_id: x.ids_sha256 for x in parts.collect()} and len(whole) == len(rows)


def test_replay_waits_for_lower_ranks():
    """A vocabulary whose later merges make earlier pairs possible."""
    ranks = bpe.Ranks.__new__(bpe.Ranks)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"abcabc", b"cab", b"aa", b"aaa"]
    ranks.take({t: i for i, t in enumerate(tokens)})
    pair = lambda a, b: ranks.of.get(tokens[a] + tokens[b], -1)

    def alone(word):
        parts = [ranks.of[word]] if word in ranks.of else list(word)
        while True:
            found = [(pair(a, b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if pair(a, b) >= 0]
            if not found:
                return parts
            rank, i = min(found)
            parts[i : i + 2] = [rank]

    r = random.Random(1)
    words = [bytes(r.choices(b"aabbc", k=r.randint(0, 14))) for _ in range(2000)]
    assert bpe.replay(words, ranks) == [alone(w) for w in words]


def brute_print(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    all_texts = [t if t is None or len(t) < 60_000 else t[:60_000] for t in texts()]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(all_texts)], EMPTY + ", print string")
    got = rows_of(simhash.near_duplicates(df))
    prints = [brute_print(t, 4) for t in all_texts]
    forest = Forest()
    for i, a in enumerate(prints):
        forest.root(i)
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 4:
                forest.join(i, j)
    for i, a in enumerate(prints):
        assert got.fingerprint[i] == f"{a:016x}" and got.component_id[i] == forest.root(i)
    assert simhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


@pytest.mark.parametrize("split", [50_000, 20])
def test_simhash_links(spark, split):
    """Prints at chosen distances, one tight group of hundreds among them; buckets whole and in parts."""
    rng = np.random.default_rng(1)
    prints = set()
    for base, n in [(int(x), k) for x, k in zip(rng.integers(0, 2**63, 40), [300, *[6] * 39])]:
        for _ in range(n):
            v = base
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                v ^= 1 << int(bit)
            prints.add(v)
    own = sorted(prints)
    exact = Forest()
    for i, a in enumerate(own):
        exact.root(i)
        for j in range(i):
            if (a ^ own[j]).bit_count() <= 4:
                exact.join(i, j)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)), i) for i, p in enumerate(own)], "print bigint, node bigint")
    folder = shared_dir(spark)
    found = {r.node: r.component for r in components(simhash.near_links(df, simhash.SimHash(split=split), folder), folder).collect()}
    assert [found.get(i, i) for i in range(len(own))] == [exact.root(i) for i in range(len(own))]


def test_simhash_kernel():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 700):
        for radius in (0, 3, 4, 7):
            x = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 13, n)], np.uint64)
            assert simhash.lanes(simhash.near(simhash.planes(x), radius), n).tolist() == np.flatnonzero(np.bitwise_count(x) <= radius).tolist()


def test_near_copies_are_one(spark):
    """With the pipeline's parameters: copies with two of a hundred words changed go, others stay."""
    from corpus_pipeline import NEAR

    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows = []
    for g in range(40):
        base = [word() for _ in range(150)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for k in r.sample(range(150), 2):
                copy[k] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, "alone"), (1000, None), (1001, ""), (1002, None)]
    kept = [x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, EMPTY), NEAR).collect()]
    assert {3 * g for g in range(40)} <= set(kept) and None in kept and 1000 in kept and not {1001, 1002} & set(kept)
    assert len(kept) <= 40 + 2 + 3


def test_cut_and_extended_copies_are_one(spark):
    """Copies that drop or gain words at one end, at a similarity of 0.81 to 0.9, go as those with replaced words do."""
    from corpus_pipeline import NEAR

    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows = []
    for g in range(200):
        base, n = [word() for _ in range(104)], r.randint(10, 18)
        copy = [base[n:], base[:-n], base + [word() for _ in range(n)], [word() for _ in range(n)] + base][g % 4]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, EMPTY), NEAR).collect()}
    assert {2 * g for g in range(200)} <= kept and len(kept) <= 200 + 8


def test_only_similar_texts_go(spark):
    """Texts at 0.6 to 0.79 stay, whatever their fingerprints say; each pair at 0.8 or more is one, and sets don't count repeats."""
    from corpus_pipeline import NEAR

    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    rows = []
    for g in range(300):
        base, n = [word() for _ in range(104)], r.randint(21, 35)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[n:]))]
    chorus = [word() for _ in range(30)]
    rows += [(600, " ".join([word() for _ in range(30)] + chorus * 20)), (601, " ".join([word() for _ in range(30)] + chorus * 20))]
    rows += [(602, "one two three four five six"), (603, "one two three four five seven"), (604, "")]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, EMPTY), NEAR).collect()}
    assert kept == set(range(605))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 200)] + [(0, i) for i in range(300, 500)] + [(7, 7), (8, 9), (9, 8)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df, shared_dir(spark)).collect()}
    assert got == {**{i: 100 for i in range(101, 201)}, **{i: 0 for i in range(300, 500)}, 9: 8}
    assert components(df.where("a < 0"), shared_dir(spark)).count() == 0


def test_one_index_for_all_words_of_a_bucket(monkeypatch):
    """Words that several blocks send to a bucket are replayed together, each once, and every block gets its own ids back."""
    import public_tokenizers
    import pyarrow as pa

    path, calls, real = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), [], bpe.replay
    monkeypatch.setattr(bpe, "replay", lambda words, ranks: calls.append(list(words)) or real(words, ranks))
    r = random.Random(2)
    blocks = [sorted({bytes(r.choices(b"abcdefgh ", k=r.randint(1, 9))) for _ in range(3000)}) for _ in range(3)]
    pack = lambda words: bpe._compressed(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)), b"".join(words))
    batches = [pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([k]), pa.array([pack(w)])], ["bucket", "block", "blob"]) for k, w in enumerate(blocks)]
    got = {b.column(0)[0].as_py(): bpe._expanded(b.column(1)[0].as_py()) for b in bpe._replayed(path)(iter(batches))}
    (words,) = calls
    assert len(words) == len(set(words)) == len(set().union(*blocks))
    ranks = bpe.Ranks(path)
    for k, own in enumerate(blocks):
        at, sizes, flat = got[k]
        ids = bpe._from_planes(flat).tolist()
        ends = np.cumsum(sizes).tolist()
        assert [ids[i:j] for i, j in zip([0, *ends], ends)] == [real([w], ranks)[0] for w in own] and at.tolist() == list(range(len(own)))


def test_licenses(spark):
    mit = license_scan.KNOWN["MIT"]
    rows = [(0, mit), (1, "Copyright (c) 2001 Someone\n\n" + mit.upper() + "\n(C) all of us"), (2, mit + " x"), (3, None), (4, ""), (5, "released under the MIT Licence"), (6, "© 2020"), (7, license_scan.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement"))]
    df = spark.createDataFrame([(*r, "d") for r in rows], EMPTY + ", digest string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(df, license_scan.known_licenses(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: "MIT-notice", 6: None, 7: "Zlib"}
    assert license_scan.scan(spark.createDataFrame([], EMPTY), license_scan.known_licenses(spark)).count() == 0


def test_whole_licenses(spark):
    """Whole texts with and without titles; wrapped lines that begin with "copyright" stay, those that name a holder go."""
    whole = dict(license_scan.whole_texts()[: len(license_scan.FILES)])
    mit, bsd = license_scan.KNOWN["MIT"], license_scan.KNOWN["BSD-2-Clause"]
    three = bsd.replace("THIS SOFTWARE IS", license_scan._THIRD + "THIS SOFTWARE IS")
    wrap = lambda text, n: "\n".join(line for p in text.split("\n") for line in textwrap.wrap(p, n))
    want = [("MIT", "MIT License\n\nCopyright (c) 2026 Anastasia\n\n" + wrap(mit, 78)), ("ISC", "ISC License\n\nCopyright Jo Doe\n\n" + license_scan.KNOWN["ISC"])]
    want += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2020, Jo\nAll rights reserved.\n\n" + wrap(bsd, n)) for n in range(40, 100)]
    want += [("MIT", wrap(mit, n)) for n in range(40, 100)] + [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2020 Jo\n\n" + wrap(three, 79))]
    want += [(name, text) for name, text in whole.items()] + [("Apache-2.0", whole["Apache-2.0"].split("APPENDIX")[0]), ("MPL-2.0", whole["MPL-2.0"].split("=\n", 1)[1])]
    want += [(None, "Copyright holders say no"), (None, whole["GPL-3.0"] + " more")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], EMPTY)
    got = {r.doc_id: r.license_id for r in license_scan.scan(df, license_scan.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(want))] == [name for name, _ in want]


def test_language_model(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("the of A b cat dog É".split()) if r.random() < 0.8 else f"w{r.randint(0, 90)}" for _ in range(r.randint(0, 30)))) for i in range(120)] + [(200, None), (201, "never before"), (202, "the " * 5000)]
    token = {i: [*lower(t or "").split(), ""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in token}
    c, pairs = Counter(), Counter()
    for i, ws in token.items():
        if not held[i]:
            c.update(ws)
            pairs.update(zip([None, *ws], ws))
    n, v = sum(c.values()), len(c)
    before, total, followers = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (x, _), k in pairs.items():
        total[x] += k
        followers[x][min(k, 3)] += 1
    pd = (0, *kneser_ney.discounts(*[Counter(pairs.values())[k] for k in (1, 2, 3, 4)]))
    m = Counter(before.values())
    wd = (0, *kneser_ney.discounts(*[m[k] for k in (1, 2, 3, 4)]))
    rest = (wd[1] * m[1] + wd[2] * m[2] + wd[3] * sum(k for x, k in m.items() if x > 2)) / len(pairs) / (v + 1)
    single = lambda w: max(before[w] - wd[min(before[w], 3)], 0) / len(pairs) + rest

    def p(x, w):
        if not total[x]:
            return single(w)
        left = sum(pd[k] * followers[x][k] for k in (1, 2, 3)) / total[x]
        return max(pairs[x, w] - pd[min(pairs[x, w], 3)], 0) / total[x] + left * single(w)

    for x in ("the", None, "cat"):
        assert math.isclose(sum(p(x, w) for w in c) + p(x, "not a word"), 1)
    df = spark.createDataFrame([(i, t, 0.0) for i, t in rows], EMPTY + ", score double")
    got = {x.doc_id: x for x in kneser_ney.perplexity_scores(df, kneser_ney.Training(chunk=300, often=20)).collect()}
    assert len(got) == len(rows)
    for i, ws in token.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(p(a, b)) for a, b in zip([None, *ws], ws)), rel_tol=1e-9)
    assert kneser_ney.perplexity_scores(spark.createDataFrame([], EMPTY)).count() == 0


def test_ids_of_other_types(spark):
    """String ids are refused where components are named by numbers; language-model folds go by the id's text."""
    df = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError):
        simhash.near_duplicates(df)
    real = spark.createDataFrame([(float(i), "the cat sat", 1) for i in range(60)] + [(None, "the cat", 1)] * 2, "doc_id double, text string, n_known int")
    got = kneser_ney.perplexity_scores(real).collect()
    assert len(got) == 62 and sum(r.n_tokens for r in got if not r.held_out) == got[0].train_tokens


def test_more_blocks_for_more_fingerprints():
    how = simhash.SimHash()
    assert how.sized(1000).blocks == 6 and how.sized(1 << 22).blocks == 6
    assert how.sized(1 << 28).blocks == 7 and how.sized(1 << 33).blocks == 8 and len(how.sized(1 << 28).keys()) == 35


def test_license_sql_finds_whole_licences(spark):
    """The query's SQL knows all digests, and finds whole licences with titles, copyright lines, other cases and spellings."""
    import duckdb
    import pandas as pd

    whole = dict(license_scan.whole_texts()[: len(license_scan.FILES)])
    mit = license_scan.KNOWN["MIT"]
    texts = [*whole.values(), *(t.upper() for t in whole.values()), "MIT License\n\nCopyright (c) 2026 Jo\n\n" + mit, mit.replace("Software", "SOFTWARE") + "\nAll rights reserved.", mit + " x", whole["GPL-2.0"] + "\n(c) someone", "(c) 2001 X\n" + whole["Apache-2.0"], "", None, "© 2020\nCopyright holders of this"]
    texts += ["Copyright notice of the house\nCopyright: Jo", "# copyright (c) Jo\nlicence", "(b) one\n(c) two\n(c) 1999 Jo\n(c)1999x"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841  DuckDB finds it by its name
    want = {i: (d, l) for i, d, l in duckdb.sql(license_scan.oracle()).fetchall()}
    got = {r.doc_id: (r.digest, r.license_id) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), EMPTY), license_scan.known_licenses(spark)).collect()}
    assert got == want and len(license_scan.known_digests()) > 100
    assert [got[i][1] for i in range(len(whole))] == [got[len(whole) + i][1] for i in range(len(whole))] == list(whole)
    assert [got[2 * len(whole) + i][1] for i in range(3)] == ["MIT", "MIT", None]


def test_licenses_of_long_and_repeated_rows(spark):
    """Texts of a million words; rows twice; two known names for one digest: the first in order."""
    mit = license_scan.KNOWN["MIT"]
    df = spark.createDataFrame([(1, mit), (1, mit), (None, mit), (2, "word " * 1_000_000)], EMPTY)
    known = spark.createDataFrame([("b", license_scan.digest(mit)), ("a", license_scan.digest(mit)), ("c", None)], "license_id string, digest string")
    assert sorted((str(r.doc_id), str(r.license_id)) for r in license_scan.scan(df, known).collect()) == [("1", "a"), ("1", "a"), ("2", "None"), ("None", "a")]


def test_long_texts(spark):
    """Texts of megabytes through line dedup, decontamination and the language model."""
    long = "\n".join(f"line {i} of a very long document" for i in range(40_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, long), (3, long)], EMPTY)
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in got) == [(1, 40_000, 40_000), (2, 40_000, 40_000), (3, 40_000, 0), (3, 40_000, 0)]
    item = spark.createDataFrame([(7, "line 39999 of a very long document")], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.search(df, item).collect()] == [(280_000, 7)] * 4
    assert {r.n_tokens for r in kneser_ney.perplexity_scores(df).collect()} == {280_001}
