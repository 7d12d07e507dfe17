"""One query for each operator of this package, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, decontaminate, embedding_dedup, html_extract, kneser_ney, license_scan, line_dedup, merkle, quality, sentence_pieces, simhash, url_filter, whitening
from loomwright.llm.common import LOWER, UPPER, table

# The URL rules and the globs of hosts that sell or spam.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
BLOCK_GLOBS = ["**casino*.**", "**cheap-pills*.**", "**spam-farm*.**", "**/*/wp-login.php*"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCK_GLOBS)


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP1_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT page_id, host, path,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_full_match(host, '.*(casino|cheap-pills|spam-farm)[^.]*\..*') OR regexp_full_match(path, '/.*/wp-login\.php.*') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.SimHash(shingle=4, radius=4))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(often.last <> k.doc_id, false) AS dropped FROM k LEFT JOIN often USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_bad", "p_toxic", "score", "rejected")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), embedding_dedup.Cells(threshold=0.9))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT r.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), decontaminate.Windows(size=10))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity_scores(table(spark, sf_dir, "documents"), kneser_ney.Training(folds=10))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM s),
dg AS (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) AS l WHERE len(w) >= l.n),
hit AS (SELECT dg.doc_id, dg.i, dg.n, win.item_id FROM dg JOIN win ON win.n = dg.n AND win.g = array_to_string(dg.w[dg.i:dg.i + dg.n - 1], ' ')),
marks AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN names USING (doc_id)
"""

def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=F.crc32(docs["doc_id"].cast("string")) % 5 == 0)


#: The recursion runs over lists of the nodes of a source, and folds the path of each document step by step. DuckDB has no
#: crc32, which is written out bit by bit.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, c: list_reduce([xor(a, c), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents),
f AS (SELECT r, doc_id, source, coalesce(xor(crc, 4294967295) % 5 = 0, false) AS touched,
  list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS head,
  coalesce(strlen(text) || ':' || text, '-') AS text, coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') AS lower FROM d),
l AS (SELECT r, doc_id, source, sha256(array_to_string(head, '') || text) AS leaf,
  CASE WHEN touched THEN sha256(array_to_string(head, '') || lower) ELSE sha256(array_to_string(head, '') || text) END AS seen FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
t AS (SELECT source, 0 AS lvl, list(leaf ORDER BY idx) AS nodes FROM o GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT source, lvl AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL SELECT lvl + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], ''))) FROM u WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
up AS (
  SELECT source, lvl, i AS parent, nodes[i * 16 + 1:i * 16 + 16] AS run FROM (SELECT *, unnest(range(0, (len(nodes) + 15) // 16)) AS i FROM t WHERE len(nodes) > 1)),
upper AS (SELECT lvl, i AS parent, nodes[i * 16 + 1:i * 16 + 16] AS run FROM (SELECT *, unnest(range(0, (len(nodes) + 15) // 16)) AS i FROM u WHERE len(nodes) > 1)),
walk AS (
  SELECT o.r, o.source, 0 AS lvl, CAST(o.idx AS BIGINT) AS at, o.seen AS hash, '' AS proof, false AS high FROM o
  UNION ALL
  SELECT w.r, w.source, CASE WHEN w.high OR up.run IS NOT NULL THEN w.lvl + 1 ELSE 0 END,
    CASE WHEN w.high OR up.run IS NOT NULL THEN w.at // 16 ELSE s.place END,
    CASE WHEN coalesce(up.run, upper.run) IS NULL THEN w.hash
      ELSE sha256(array_to_string(list_transform(coalesce(up.run, upper.run), lambda x, i: CASE WHEN i = w.at % 16 + 1 THEN w.hash ELSE x END), '')) END,
    w.proof || coalesce(array_to_string(list_filter(coalesce(up.run, upper.run), lambda x, i: i <> w.at % 16 + 1), ''), ''),
    w.high OR up.run IS NULL
  FROM walk AS w JOIN s ON s.source IS NOT DISTINCT FROM w.source
    LEFT JOIN up ON NOT w.high AND up.source IS NOT DISTINCT FROM w.source AND up.lvl = w.lvl AND up.parent = w.at // 16
    LEFT JOIN upper ON w.high AND upper.lvl = w.lvl AND upper.parent = w.at // 16
  WHERE NOT w.high OR upper.run IS NOT NULL),
fin AS (SELECT r, arg_max(hash, CAST(high AS INT) * 1000 + lvl) AS hash, arg_max(proof, CAST(high AS INT) * 1000 + lvl) AS proof FROM walk GROUP BY r)
SELECT o.doc_id, o.leaf, s.subroot, top.root, sha256(fin.proof) AS proof_sha256, fin.hash AS folded_root, fin.hash = top.root AS verified
FROM o JOIN fin USING (r) JOIN s ON s.source IS NOT DISTINCT FROM o.source, top
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), count=8)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_html_extraction": op3_html_extraction,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_sentence_pieces": op13_sentence_pieces,
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_embedding_dedup": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_license_scan": license_scan.oracle(), "op11_merkle_manifest": OP11_SQL}
