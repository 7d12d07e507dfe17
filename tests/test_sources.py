"""Sources against files and a local server, sinks and reports, the streaming hand-off, the driver's contract."""

import importlib
import json
import shutil
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from pathlib import Path

import pytest

from loomwright.operators import clean
from loomwright.plans import cli, pipeline, reports
from loomwright.schema import REVIEW
from loomwright.sources import collect, html, json_api, web
from loomwright.streaming import corrections

PAGE = "<div class='quote big'><span class=text>“A good <i>friend</i>”</span><span>by</span></div><div class=quote><p><span class='text x'>'It &amp; evil'</span></p></div><span class=text>out</span><div class=quote><span class=text> \"\" </span></div>"


@pytest.fixture(scope="module")
def server():
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            body = {"/q": PAGE, "/q/page/2/": "<div class=quote><span class=text>two</span></div>", "/api": json.dumps({"items": [{"text": "love", "label": 1}, {"body": "x"}, {"text": "bad evil", "label": None}, {"text": 7}], "q": query}), "/one": json.dumps({"text": "single"}), "/broken": "{"}.get(path)
            self.send_response(200 if body is not None else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *a):
            pass

    own = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


@pytest.fixture
def growing():
    """Pages and records that become more; each second request fails, or its answer is cut."""
    state = {"pages": 3, "records": 250, "asked": [], "calls": 0}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            state["calls"] += 1
            path, _, query = self.path.partition("?")
            state["asked"].append(self.path)
            if state["calls"] % 4 == 0:
                return self.send_error(503)
            body = None
            if path.startswith("/p"):
                k = int(path.split("/")[3]) if "/page/" in path else 1
                body = f"<p>good page {k}</p><p>{k}</p>" if k <= state["pages"] else None
            elif path == "/records":
                q = {k: int(v) for k, v in (x.split("=") for x in query.split("&"))}
                body = json.dumps({"total": state["records"], "items": [{"text": f"r{i}", "label": i % 2} for i in range(q["offset"], min(q["offset"] + q["limit"], state["records"]))]})
            self.send_response(200 if body is not None else 404)
            raw = (body or "").encode()
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw[: len(raw) // 2] if state["calls"] % 4 == 2 else raw)

        def log_message(self, *a):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", state
    own.shutdown()


def test_new_pages_and_records_only(spark, growing, tmp_path):
    url, state = growing
    soon = {"wait": 0.01, "attempts": 6}
    run = lambda: html.scrape_new(spark, f"{url}/p", "p", f"{tmp_path}/out", f"{tmp_path}/cp", auto_label=True, **soon).awaitTermination(120)
    read = lambda: sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect())
    run()
    assert read() == sorted(x for k in range(1, 4) for x in (f"good page {k}", str(k)))
    state["pages"] = 5
    state["asked"].clear()
    run()
    assert read() == sorted(x for k in range(1, 6) for x in (f"good page {k}", str(k)))
    run()
    assert len(read()) == 10 and spark.read.parquet(f"{tmp_path}/out").first().collected_at.endswith("+00:00")
    fetch = lambda: json_api.fetch_new(spark, f"{url}/records", f"{tmp_path}/api", f"{tmp_path}/acp", results_key="items", page_size=60, **soon).awaitTermination(120)
    got = lambda: sorted(int(r.text[1:]) for r in spark.read.parquet(f"{tmp_path}/api").collect())
    fetch()
    assert got() == list(range(250))
    state["records"] = 300
    state["asked"].clear()
    fetch()
    assert got() == list(range(300))
    assert all("offset=0&limit=1" in x or "offset=250" in x for x in state["asked"])  # old records aren't asked for


def test_filters_decide_which_pages_are_asked_for(spark, growing):
    url, state = growing
    df = html.scraped(spark, f"{url}/p", "p", 50, wait=0.01, attempts=6)
    assert sorted((r.page, r.text) for r in df.where("page > 1 and page <= 3 and text like 'good%'").collect()) == [(2, "good page 2"), (3, "good page 3")]
    assert {x for x in state["asked"]} == {"/p/page/2/", "/p/page/3/"}


def test_retries_end(growing):
    url, state = growing
    assert web.get(f"{url}/none", {"wait": "0.01", "attempts": "6"}) is None and web.get("http://127.0.0.1:1/", {"wait": "0.01"}) is None
    assert [web.last_there(lambda k: k <= n, known, most) for n, known, most in ((0, 0, 9), (5, 0, 9), (9, 0, 9), (50, 3, 9), (13, 4, 1000), (4, 4, 4))] == [0, 5, 9, 9, 13, 4]


def test_selector():
    assert html.select_text(PAGE, "div.quote span.text") == ["A goodfriend", "It & evil"]
    assert html.select_text(PAGE, "div.quote > span.text") == ["A goodfriend"]
    assert html.select_text("<div id=a>x<b class=b>y</b></div><i>z</i>", "#a") == ["xy"]
    assert html.select_text("<a href='u'>z</a><a>w</a>", "a[href]") == ["z"] and html.select_text("<a rel=n>z</a>", "a[rel=n], b") == ["z"]
    assert html.select_text(None, "p") == [] and html.select_text("<br><p>a<br>b</p>", "p") == ["ab"]
    with pytest.raises(ValueError):
        html.parse_selector("p:first-child")


def test_titles_decode_the_references_of_their_sql(spark, tmp_path):
    import duckdb

    from loomwright.plans import registry

    titles = ["a &amp", "b &amp;&am", "c &lt", "d &ltx; &quot;e", "&amp;amp; &eacute; &eacute &#x27; &#65", "plain &", "&quot;q&quot;", "&copy 1 \ue000"]
    page = lambda t: f"<p>x</p><article><h1>{t}</h1><p>{t}</p><p>a<script>1 && 2 &amp</script></p></article>"
    spark.createDataFrame([*((i, page(t)) for i, t in enumerate(titles)), (90, "<article><p>none</p></article>"), (91, None)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("html_titles", "html_scrape"):
        sql = registry.ORACLES[name].replace("FROM pages", f"FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(sql).fetchall())
    assert html.select_text("<p>1 &amp 2 &lt;</p>", "p") == ["1 & 2 <"] and html.select_text("<p title='&amp'>&lt;</p>", "p[title=&]", ()) == []


def test_scrape(spark, server):
    df = html.scrape(spark, f"{server}/q", "div.quote span.text", max_pages=3, auto_label=True)  # the third page fails and is skipped
    assert sorted((r.text, r.label) for r in df.collect()) == [("A goodfriend", "positive"), ("It & evil", "negative"), ("two", "positive")]
    assert df.first().source == f"scrape_{server}/q" and df.columns == ["text", "label", "source", "collected_at"]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    assert [(r.page_id, r.position, r.text) for r in html.scrape_pages(pages, "div.quote span.text", keep=("page_id",)).collect()] == [(1, 0, "A goodfriend"), (1, 1, "It & evil")]
    spark.udtf.register("scrape_text", html.ScrapeText)
    assert spark.sql("SELECT * FROM scrape_text('<p>a</p><p>b</p>', 'p')").count() == 2


def test_api(spark, server):
    df = json_api.fetch(spark, f"{server}/api", {"n": 1}, results_key="items", auto_label=True)
    assert [(r.text, r.label) for r in df.collect()] == [("love", "1"), ("", "positive"), ("bad evil", "negative"), ("7", "positive")]
    assert json_api.fetch(spark, f"{server}/one").first().text == "single"
    for path in ("/broken", "/nothing"):
        empty = json_api.fetch(spark, f"{server}{path}")
        assert empty.count() == 0 and empty.columns == ["text", "label", "source", "collected_at"]


def test_collect(spark, server, tmp_path):
    data = spark.createDataFrame([(f"text {i % 8}", i % 3) for i in range(20)], "text string, label int")
    data.write.parquet(f"{tmp_path}/my/set/train.parquet")
    sources = [
        {"type": "hf_dataset", "name": "my/set", "text_field": "text", "label_field": "label", "label_map": {0: "a"}, "max_samples": 100},
        {"type": "scrape", "url": f"{server}/q", "selector": "div.quote span.text"}, {"type": "odd"}, {"type": "hf_dataset", "name": "absent"},
    ]
    config = {"tasks": {"t": {"description": "d", "sources": sources, "output": {"path": f"{tmp_path}/out", "format": "csv"}}}}
    c = collect.Collector(spark, config, str(tmp_path))
    df = c.run(task="t")
    assert df.count() == 10 and {r.label for r in df.collect()} <= {"a", "1", "2", None}
    assert collect.read_file(spark, f"{tmp_path}/out/*.csv").count() == 10
    assert c.with_max_samples(5).config["tasks"]["t"]["sources"][0]["max_samples"] == 5 and c.available_tasks() == {"t": "d"}
    with pytest.raises(KeyError):
        c.resolve("no")
    with pytest.raises(ValueError):
        collect.load_dataset(spark, "x", source="kaggle")
    assert not collect.write_file(df, f"{tmp_path}/x", "xml")
    assert collect.topic_queries("a b c d") == ["a b c d", "a b c", "a b", "a"] and collect.topic_queries("a") == ["a"]


def test_config_file(spark, tmp_path):
    pytest.importorskip("yaml")
    Path(tmp_path, "c.yaml").write_text("schema:\n  columns: [text, label]\ntasks:\n  x: {description: y}\n")
    c = collect.Collector(spark, f"{tmp_path}/c.yaml")
    assert c.columns == ["text", "label"] and c.available_tasks() == {"x": "y"}


def test_discover(spark):
    spark.createDataFrame([("t", 1)], "title string, rating int").createOrReplaceTempView("toxic_comments_set")
    sources, out = collect.discover(spark, "toxic comments in forums")
    assert sources[0]["text_field"] == "title" and sources[0]["label_field"] == "rating" and sources[1]["type"] == "scrape" and out["path"] == "data/raw/toxic_comments_in_forums_dataset.csv"
    with pytest.raises(RuntimeError):
        collect.discover(spark, "nothing like that")
    spark.catalog.dropTempView("toxic_comments_set")


def test_csv_round_trip(spark, tmp_path):
    rows = [('quote " and, comma', None, "s", "t", "p", 0.5, True, ""), ("line\nbreak\\", "a", "s", "t", "n", 0.6, True, "x")]
    df = spark.createDataFrame(rows, REVIEW)
    collect.write_file(df, f"{tmp_path}/q", "csv", single=True)
    back = collect.read_file(spark, f"{tmp_path}/q/*.csv", REVIEW)
    assert sorted(r.text for r in back.collect()) == sorted(r[0] for r in rows)
    assert collect.read_corrections(spark, f"{tmp_path}/none.csv") is None


def test_corrections_stream(spark, tmp_path):
    labelled = spark.createDataFrame([(f"t{i}", "a", "s", "t", "p", 0.5, True) for i in range(3)], "text string, label string, source string, collected_at string, predicted_label string, confidence double, needs_review boolean")
    spark.createDataFrame([("t0", "a", "s", "t", "p", 0.5, True, "n"), ("t1", "a", "s", "t", "p", 0.5, True, " ")], REVIEW).coalesce(1).write.option("header", True).csv(f"{tmp_path}/in")
    corrections.merge_into(corrections.read(spark, f"{tmp_path}/in"), labelled, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert {r.text: r.final_label for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"t0": "n", "t1": "p"}


def test_reports(spark, tmp_path):
    history = lambda s, d: [{"iteration": i, "n_labeled": 50 + 20 * i, "accuracy": 0.5 + d * i, "f1": 0.4 + d * i, "strategy": s} for i in range(3)]
    results = {"entropy": history("entropy", 0.01), "random": history("random", 0.02)}
    text = Path(reports.learning_report(results, f"{tmp_path}/al.md", "now")).read_text()
    assert "**Δ accuracy:** -0.0200" in text and "| 2 | 90 | 0.52 |" in text
    assert Path(reports.learning_curve(results, f"{tmp_path}/c.svg")).read_text().count("<polyline") == 4
    df = spark.createDataFrame([(1, "a text | here", "positive", "s", 0.55), (2, "b", "negative", "s", 0.9), (3, "c", "positive", "r", 0.9)], "_row_id bigint, text string, label string, source string, confidence double")
    spec = Path(reports.annotation_spec(df, f"{tmp_path}/spec.md", "sentiment_analysis")).read_text()
    assert "### negative" in spec and "confidence=0.55" in spec and "praise" in spec and spec.index("## Classes") < spec.index("### negative") < spec.index("## Edge Cases")
    card = Path(reports.data_card(df, f"{tmp_path}/card.md", now="now")).read_text()
    assert "| positive | 2 | 66.7% |" in card and "- **Sources:** r, s" in card
    assert len(json.loads(Path(reports.export_tasks(df, f"{tmp_path}/tasks.json", array=True)).read_text())) == 3
    assert "\\|" in Path(reports.final_report({"hitl_examples": [{"text": "a|b", "auto_label": "x", "corrected_to": "y", "confidence": 0.5}]}, f"{tmp_path}/f.md")).read_text()
    assert cli.strategy("missing=median,duplicates=drop") == {"missing": "median", "duplicates": "drop"}


def test_whole_pipeline(spark, tmp_path):
    words = {"positive": "great lovely warm bright kind".split(), "negative": "awful cruel dark sad broken".split()}
    rows = [(" ".join(words[c][(i + k) % 5] for k in range(3)) + f" thing {i}", c, "src", "t") for i in range(150) for c in [("positive", "negative")[i % 2]]]
    df = spark.createDataFrame(rows, "text string, label string, source string, collected_at string")
    m = pipeline.run(spark, pipeline.Settings(out=str(tmp_path), iterations=1, batch=10), df)
    assert m["raw_size"] == 150 and m["train_size"] + m["test_size"] == m["labeled_size"] and m["accuracy"] > 0.8
    for name in ("reports/final_report.md", "reports/quality_report.md", "reports/al_report.md", "reports/learning_curve.svg", "annotation_spec.md", "labelstudio_import.json", "data/labeled/DATA_CARD.md"):
        assert Path(tmp_path, name).stat().st_size > 100


def test_contract_without_the_llm_package(tmp_path):
    """In a copy without the llm folders and the pipeline, the driver's module imports and lists the library's queries."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "loomwright", tmp_path / "loomwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
assert not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.queries() and len(e.queries()) > 50
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_are_numbered_in_source_order(spark, tmp_path):
    """Forward fill of a file goes by its lines, and repeated rows have numbers of their own."""
    Path(tmp_path, "a.csv").write_text("x,y\n" + "\n".join(f"{i},{i * 2 if i % 5 == 0 else ''}" for i in range(500)) + "\n")
    df = collect.read_numbered(spark, f"{tmp_path}/a.csv")
    got = {r.x: r.y for r in clean.fix(df, {"missing": "ffill"}).collect()}
    assert got == {i: i // 5 * 10 for i in range(500)}
    twice = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    assert sorted(r["_row_id"] for r in pipeline.numbered(twice).collect()) == [0, 1, 2]


def test_corrections_by_number_and_last(spark, tmp_path):
    queue = spark.createDataFrame([("t", "p", 0.5, True, 0), ("u", "p", 0.5, True, 1)], "text string, predicted_label string, confidence double, needs_review boolean, _row_id bigint")
    Path(tmp_path, "review_queue_corrected.csv").write_text("text,label,source,collected_at,predicted_label,confidence,needs_review,corrected_label\nt,,,,p,0.5,true,first\nt,,,,p,0.5,true,last\n")
    final, _ = pipeline.review(queue, pipeline.Settings(out=str(tmp_path), auto=False))
    assert {r.text: r.final_label for r in final.collect()} == {"t": "last", "u": "p"}


def test_ingest_counts_a_text_once(spark, tmp_path):
    Path(tmp_path, "in").mkdir()
    spark.createDataFrame([("a", "2026-01-01T00:00:00"), ("a", "2026-01-01T00:10:00"), ("b", "2026-01-01T00:20:00")], "text string, collected_at string").coalesce(1).write.parquet(f"{tmp_path}/in/p")
    stream = spark.readStream.schema("text string, collected_at string").parquet(f"{tmp_path}/in/p")
    run = corrections.distinct_records(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
