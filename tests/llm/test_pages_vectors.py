"""URL filter, HTML extraction, embeddings, the classifier and the pipeline on small inputs."""

import random
import time

import numpy as np
import pytest

from loomwright.llm import embedding_dedup, html_extract, quality, url_filter
from loomwright.llm.components import Forest
from loomwright.llm.queries import BLOCK_GLOBS, URL_RULES


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_filter(spark):
    r = random.Random(0)
    hosts = ["org", "x.org", "xorg", "example.org", "EXAMPLE.org", "a.example.org", "badexample.org", "b.com", "com", "example.org.net", "cheap-pills.net", "my-casino.co.uk", "é.org", "", "b.com:80"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/es/", "/fr/x", "/de/#top", "/FR/", "/x/example.org/es/", "?a", "#b", "/" + "z" * 5000, "/a/wp-login.php?x"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/d", "//x.org/es/"]
    r.shuffle(urls)
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {x.page_id: x for x in url_filter.filter_urls(df, URL_RULES, BLOCK_GLOBS).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.canonical(u)
        best = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name), u
        if best:
            assert got[i].verdict == best.verdict
        else:
            spam = any(x in host and "." in host.split(x)[1] for x in ("casino", "cheap-pills", "spam-farm")) or path.endswith("wp-login.php") and path.count("/") > 1
            assert got[i].verdict == ("block" if spam else "allow"), u
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0
    assert {x.verdict for x in url_filter.filter_urls(df, []).collect()} == {"allow"}


PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-banner'>Cookies!</div><article><h1>Head&amp;line</h1><p>One <b>bold</b>\n  word.<br>More.<p>Two &lt;three&gt;&nbsp;four</p><script>var a='</p>'</script><div class=\"ad\">Buy</div><section id='comments'><p>First!</p></section></article><aside>Related</aside><footer>(c)</footer></body></html>", "Head&line\n\nOne bold word. More.\n\nTwo <three> four"),
    "main": ("<body><main><p>Text</p><form><input><button>Send</button></form></main><p>outside</p>", "Text"),
    "role": ("<div role=main><p>In</p></div><div>out</div>", "In"),
    "lists": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>tail</article>", "a\n\nb\n\nc\n\nd\n\ntail"),
    "comment": ("<article><p>x</p><!-- no --><p>y</p></article><article class='comment'><p>z</p></article>", "x\n\ny"),
    "empty": ("", ""),
    "null": (None, ""),
    "text only": ("just text &eacute;", "just text é"),
    "broken": ("<article><p>a < b <c", "a < b <c"),
    "own header": ("<article><h2 class='section-header header'>H</h2><p class=notice>Note</p><div class=notice>Cookies</div><math>1 + 1</math><xmp>x</xmp></article>", "H\n\nNote\n\n1 + 1\n\nx"),
    "bare quote": ("<p>I said <b title=don't>hello</b> world. It's fine</p>", "I said hello world. It's fine"),
    "quoted end": ("<article><p title='a > b' data-id=\"ad\">x</p></article>", "x"),
    "long": ("<article>" + "<p>word word</p>" * 30_000 + "</article>", "\n\n".join(["word word"] * 30_000)),
}


def test_html_lines(spark):
    rows = [(k, f"http://h{k}/x", page) for k, (page, _) in enumerate(PAGES.values())]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    for k, (_, text) in enumerate(PAGES.values()):
        assert got[k].text == text and got[k].n_chars == len(text), k
    assert html_extract.extract(df.limit(0)).count() == 0


def test_markup_takes_linear_time():
    for piece in ('<a "', '<a x="', '<a x=">" ', "<title>", "<!--", "</title ", "<svg", "<p class='", "<", "<div>"):
        begin = time.time()
        html_extract.page_lines(piece * ((1 << 20) // len(piece)))
        assert time.time() - begin < 8, piece


def brute_text(page, pages):
    """The text of a page by the docstring's rule, from all pages of its host."""
    url, raw = page
    host, path = url_filter.canonical(url)
    lines = html_extract.page_lines(raw)
    texts, levels = [t for _, t in lines], [k for k, _ in lines]
    by_path = {}
    for u, r in pages:
        h, p = url_filter.canonical(u)
        own = tuple(html_extract.page_lines(r))
        if h == host:
            by_path.setdefault(own, set()).add(p)
    first = {}
    for own, ps in by_path.items():
        first.setdefault(min(ps), set()).add(own)
    order = sorted(first)
    me = order.index(min(by_path[tuple(lines)]))
    around = []
    for d in (-2, -1, 1, 2):
        if 0 <= me + d < len(order) and len(first[order[me + d]]) == 1:
            (own,) = first[order[me + d]]
            if [t for _, t in own] != texts:
                around.append((d, order[me + d], [t for _, t in own]))
    lcs = lambda b: html_extract.common_lines([hash(t) for t in texts], [hash(t) for t in b])
    alike = lambda b: len({*b} & {*texts}) >= 0.8 * len({*b} | {*texts})
    others = [x for x in around if not alike(x[2])] or around
    others.sort(key=lambda x: (-html_extract._prefix(x[1], order[me]), abs(x[0]), x[0]))
    top = max((k for k in levels if k != html_extract.ASIDE), default=0)
    keep = [k == top for k in levels]
    shared = lcs(others[0][2]) if others else set()
    if len(others) > 1:
        shared = {i for i in shared if any(i in lcs(x[2]) for x in others[1:])}
    gone = {i for i in shared if keep[i] and levels[i] == 0}
    if len(gone) == sum(keep):
        gone = set()
    return "\n\n".join(t for i, t in enumerate(texts) if keep[i] and i not in gone)


def test_query_is_brute_force_at_any_partitioning(spark):
    """Marked, unmarked and mixed pages of hosts of any size, copies, nulls and repeated rows; one text whatever the plan."""
    r = random.Random(11)
    menu, legal = ["Home | News", "About us", "Jobs"], ["All rights", "Imprint"]
    rows = []
    for k in range(260):
        host = "hot.example" if k % 3 == 0 else f"h{k % 60}.example"
        story = [f"Story {k} says {n}." for n in range(r.randint(1, 6))] + (["A passage that many articles have."] if r.random() < 0.3 else [])
        tag = "article" if r.random() < 0.3 else "div"
        page = "".join(f"<div>{x}</div>" for x in menu) + f"<{tag}>" + "".join(f"<p>{x}</p>" for x in story) + f"</{tag}>" + "".join(f"<div>{x}</div>" for x in legal)
        rows.append((k, f"http://{host}/{r.choice('ab')}/{r.randint(0, 400)}", page))
    rows += [(1000, rows[0][1], rows[0][2]), (1000, rows[0][1], rows[0][2]), (1001, rows[5][1] + "?x", rows[5][2]), (None, rows[7][1], rows[7][2])]
    rows += [(1002 + k, f"http://hot.example/mirror/{k}", rows[3][2]) for k in range(80)] + [(2000, None, rows[0][2]), (2001, None, None), (2002, "no scheme", "")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id bigint, url string, html string, n_chars int")
    pages = [(u, h) for _, u, h in rows]
    want = sorted((str(i), str(u), brute_text((u, h), pages)) for i, u, h in rows)
    assert sum("Home | News" not in t for _, _, t in want) > 150
    for n in (1, 16, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = sorted((str(x.page_id), str(x.url), x.text) for x in html_extract.extract(df.repartition(n)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert got == want, n


def test_page_differencing(spark):
    """Pages without a marked article lose the lines that their neighbours have too; a third of all pages is of one host."""
    page = lambda k: f"<div>Home | News | About</div><div>Story {k} begins.</div><div>It goes on, {k}.</div><div>All rights of example</div>"
    rows = [(k, f"http://one.example/{k:04d}", page(k)) for k in range(40)] + [(100, "http://alone.example/", page(100)), (101, None, page(101)), (102, None, page(102))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(40):
        assert got[k] == f"Story {k} begins.\n\nIt goes on, {k}."
    assert all(got[k].startswith("Home") for k in (100, 101, 102))  # alone, or without a URL to go by


def test_names_inside_articles(spark):
    """What is about adverts or comments by its name keeps its text; what holds them by its name goes."""
    page = '<article><p>One.</p><section class="sponsored-research"><p>Two.</p></section><div class="ad-slot-2"><p>Buy.</p></div><div class="comment-list"><p>Me too.</p></div><section id="cookie-recipes"><p>Three.</p></section></article>'
    (got,) = html_extract.extract(spark.createDataFrame([(1, "http://x.example/a", page)], "page_id bigint, url string, html string")).collect()
    assert got.text == "One.\n\nTwo.\n\nThree."


def test_copies_of_pages_keep_their_text(spark):
    """Copies by scheme, query and path, near copies and quoting pages lose the menu and not their text."""
    page = lambda k, *more: "".join(f"<div>{x}</div>" for x in ["Home | News", *(f"Story {k}, line {n}." for n in range(9)), *more, "All rights"])
    text = lambda k, *more: "\n\n".join([*(f"Story {k}, line {n}." for n in range(9)), *more])
    rows = [(0, "http://a.example/1", page(1)), (1, "https://a.example/1", page(1)), (2, "http://a.example/1?x=2", page(1)), (3, "http://a.example/1b", page(1)), (4, "http://a.example/2", page(2)), (5, "http://a.example/2-print", page(2, "Printed."))]
    rows += [(6, "http://a.example/3", page(3)), (7, "http://a.example/4", page(4)), (8, "http://only.example/1", page(8)), (9, "http://only.example/2", page(8))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)).collect()}
    assert [got[k] for k in range(4)] == [text(1)] * 4
    assert (got[4], got[5], got[6], got[7]) == (text(2), text(2, "Printed."), text(3), text(4))
    assert all(text(8) in got[k] for k in (8, 9))


@pytest.mark.parametrize("kept", [1 << 26, 20])
def test_common_lines_is_longest(monkeypatch, kept):
    monkeypatch.setattr(html_extract, "KEPT_BITS", kept)
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        got = html_extract.common_lines(a, b)
        rest = iter(b)
        assert len(got) == best[-1, -1] and all(a[i] in rest for i in sorted(got))


@pytest.mark.parametrize("split", [4096, 30])
def test_embeddings(spark, split):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [v for b in base for v in b + rng.normal(size=(rng.integers(1, 7), 16)) * 0.08]
    rows += [base[0] + rng.normal(size=16) * 0.1 for _ in range(150)] + [base[1] * 3] * 40
    vectors = [[float(np.float32(x)) for x in v] for v in rows]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 0.0], [], [2.0, 0.0]]
    data = [(i, v, 9) for i, v in enumerate(vectors + odd)] + [(None, vectors[0], 9)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, embedding_dedup.Cells(per_cell=40, split=split)).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    forest = Forest()
    for i in range(len(x)):
        forest.root(i)
        for j in np.flatnonzero(near[i]):
            forest.join(i, int(j))
    links = near.sum(axis=1) - 1
    recall = sum(got[i].n_links for i in range(len(x))) / links.sum()
    assert 0.97 <= recall <= 1
    exact = [i for i in range(len(x)) if got[i].n_links == links[i] and got[i].component_id == forest.root(i) and got[i].kept == (forest.root(i) == i)]
    assert len(exact) >= 0.97 * len(x)
    n = len(vectors)
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k for k in (0, 1, 2, 3, 4, 6))
    assert got[n + 5].n_links == 1 and got[n + 7].component_id == n + 5
    assert got[None].n_links == 0 and got[None].component_id is None and not got[None].kept
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def labelled_docs(seed=0, n=900):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    common = [word() for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(common) for _ in range(r.randint(20, 200))]
        quality_, toxic = int(r.random() > 0.2), int(r.random() < 0.15)
        if not quality_:
            w = [x + "%%%" for x in w] if r.random() < 0.5 else [w[0]] * len(w)
        if toxic and quality_:
            for k in r.sample(range(len(w)), 3):
                w[k] = r.choice(["nastyword", "uglyword", "slur"])
        docs.append((i, " ".join(w), r.choice("ab"), f"s{r.randint(0, 3)}", len(w), 0.5))
        if i % 3:
            labels.append((i, quality_, toxic if quality_ else 0))
    return docs, labels


def test_quality_classifier(spark):
    docs, labels = labelled_docs()
    df = spark.createDataFrame([*docs, (5000, None, None, None, None, 0.1), (5001, "", "a", "s1", 0, 0.1)], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (1, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, marks, quality.CoTraining(labelled=400)).collect()}
    assert len(got) == len(docs) + 2 and not np.isnan(got[5000].score)
    fresh = [(i, q, t) for i, q, t in labels]
    right = sum(got[i].rejected == (q == 0 or t == 1) for i, q, t in fresh)
    assert right >= 0.97 * len(fresh)
    no_label = quality.classify(df, marks.limit(0)).collect()
    assert len(no_label) == len(got) and not any(r.rejected for r in no_label)
    assert quality.classify(df.limit(0), marks).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from loomwright.llm import decontaminate

    docs, labels = labelled_docs(1)
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs += [(1000, docs[1][1], "a", "s1", 1, 0.0), (1001, item + " and more", "a", "s1", 1, 0.0), (1002, None, None, None, None, 0.0)]
    spark.createDataFrame([d[:5] for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        assert k == 4 or tuple(frame.columns) == corpus_pipeline.COLUMNS
        frame.write.parquet(f"{tmp_path}/out{k}")
        frame = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in frame.select("doc_id").collect()})
    bad = {i for i, q, t in labels if not q or t}
    assert len(kept[0] & bad) <= 0.05 * len(bad) and len(kept[0] - bad) > 200
    assert kept[1] == kept[0] and kept[2] <= kept[1] and 1001 in kept[2] and kept[3] == kept[2] - {1001} and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
    assert decontaminate.words(item)[0] == b"one"


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns; then nothing at all."""
    import corpus_pipeline

    docs, labels = labelled_docs(2, 300)
    own = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit int, kept_text int"
    good = next(docs[i] for i, q, t in labels if q and not t)
    rows = [(*d[:5], 1, 2) for d in docs] + [(None, good[1], *good[2:5], 1, 2), (None, good[1], *good[2:5], 1, 2), (None, None, None, None, None, None, None), (2000, None, None, None, None, None, None), (2001, "", "a", "s1", 0, 1, 2)]
    rows += [(2002, " ".join(good[1].split()[::-1]), *good[2:5], 1, 2)] * 2 + [(2003, docs[0][1] * 200, "a", "s1", 1, 1, 2)]
    for name, schema, data in (("documents", own, rows), ("labels", "doc_id bigint, quality int, toxic int, x int", [(*x, 0) for x in labels] + [(None, None, None, None)]), ("benchmark", "item_id bigint, text string, doc_id int", [(0, "never in any document at all, this one", 1), (None, None, None)])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for frame in (spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)):
        begin = frame.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = frame.count()
            stage(spark, frame, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{begin}/{k}")
            frame = spark.read.parquet(f"{tmp_path}/{begin}/{k}")
            ids = [r.doc_id for r in frame.select("doc_id").collect()]
            assert len(ids) <= before
            if k == 2 and begin:
                assert ids.count(2002) == 1 and ids.count(None) == 2
        assert begin == 0 or frame.count() > 150


def test_vectors_of_repeated_ids_and_other_types(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (3, [0.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]
    with pytest.raises(TypeError):
        embedding_dedup.near_vectors(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_equal_rules_and_repeated_urls(spark):
    rules = [url_filter.Rule("block", "a.org", "/x"), url_filter.Rule("allow", "a.org", "/x")]
    df = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/x/" + "y" * 1_000_000)], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.filter_urls(df, rules).collect()] == ["block"] * 3


def test_quality_scores_are_those_of_the_model(spark):
    """Each score from the fitted model by plain sums over a text's words; and rows whose labels were held out are judged right."""
    docs, labels = labelled_docs(3)
    shown, hidden = [x for x in labels if x[0] % 4], [x for x in labels if x[0] % 4 == 0]
    rows = [d[:5] for d in docs] + [(None, docs[0][1], None, None, None), (7, "", "a", "s1", 0), (8000, "word " * 300_000, "b", "s9", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marks = spark.createDataFrame(shown, "doc_id bigint, quality int, toxic int")
    how = quality.CoTraining(labelled=500, unlabelled=300)
    model = quality.train(df, marks, how)
    got = [(r.doc_id, r.text, r.p_bad, r.p_toxic, r.score, r.rejected) for r in quality.score(df, model, how).collect()]
    assert len(got) == len(rows)
    by_text = {(i, t): (lang, source, n) for i, t, lang, source, n in rows}
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for i, t, bad, toxic, score, rejected in got[:150] + got[-3:]:
        w = quality.words(t)
        at = [model.columns[h] for h in map(quality._hash, quality.tokens(w, model.prefix)) if h in model.columns]
        at += [len(model.columns) + k * quality.BINS + sum(v >= e for e in edges) for k, (edges, v) in enumerate(zip(model.edges, quality.shape(t, w)))]
        p = []
        for head in model.heads:
            x = sum(head.text[k] for k in at) + head.text[-1]
            z = sum(head.meta[k] for k in model.meta_row(*by_text[i, t])) + head.meta[-1]
            p.append(sigmoid(head.text_ab[0] * x + head.text_ab[1] + head.meta_ab[0] * z + head.meta_ab[1] - head.prior))
        assert np.allclose((bad, toxic, score), (*p, (1 - p[0]) * (1 - p[1])), atol=1e-9) and rejected == (p[0] > 0.5 or p[1] > 0.5)
    said = {i: rejected for i, *_, rejected in got}
    right = sum(said[i] == (q == 0 or t == 1) for i, q, t in hidden)
    assert len(hidden) > 100 and right >= 0.9 * len(hidden)
