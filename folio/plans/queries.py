"""The registered queries of documents, pages and jobs, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import patterns as P, text as T
from ..operators import audit, catalog, chapters, chunks, heads, inspection, pages as pg, pagework as pw, translation, verify
from ..lineage import cut, shared
from ..sources.documents import write_chunks, written_chunks
from . import corpus, refine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.damaged_pages(corpus.documents(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as paginated text."""
    return pg.paginate(_pages(spark, sf_dir))


D = corpus.SQL
LETTERS = r"'[^\p{L}\p{N}]'"
MARKUP = r"'(?s)<!--.*?-->|!?\[[^\]]*\]\([^)]*\)|\[\^[^\]]+\]:?|<[^>]+>'"


def amount(c: str) -> str:
    return f"length(regexp_replace(regexp_replace({c}, {MARKUP}, ' ', 'g'), {LETTERS}, '', 'g'))"


def loops(rows: str, keys: str) -> str:
    return rf"""
parts AS (SELECT {keys}, string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM {rows}),
u AS (SELECT {keys}, unnest(p) AS raw, unnest(range(len(p))) AS place FROM parts),
n AS (SELECT {keys}, place, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS unit FROM u),
each AS (SELECT {keys}, unit, count(*) AS times, min(place) AS first, sum(length(unit)) AS own FROM n WHERE length(regexp_replace(unit, {LETTERS}, '', 'g')) >= 12 GROUP BY ALL),
top AS (SELECT *, sum(own) OVER (PARTITION BY {keys}) AS total FROM each QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY times DESC, first) = 1),
loops AS (SELECT {keys}, unit, CAST(times AS BIGINT) AS times FROM top WHERE times >= 4 AND 10 * times * length(unit) >= 3 * total)
"""


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), " + loops("d", "doc_id") + "SELECT doc_id, unit, times FROM loops")
def audit_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stuck in a loop."""
    return audit.repetition(corpus.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("body")))


@query(D + f"SELECT doc_id, seq, CAST({amount('body')} AS INT) AS amount FROM damaged")
def text_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "seq", T.content_amount(F.col("body")).alias("amount"))


@query(f"SELECT page_id, CAST({amount('html')} AS INT) AS amount FROM pages")
def html_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on real HTML."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.content_amount(F.col("html")).alias("amount"))


@query(D + r"SELECT doc_id, seq, page_no, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM damaged")
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books joined into one text each and taken apart again."""
    return pw.stripped(pg.explode_pages(_documents(spark, sf_dir)))


LINES = """line AS (SELECT doc_id, seq, unnest(string_split(body, chr(10))) AS text, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM damaged),
ink AS (SELECT *, row_number() OVER a AS up, row_number() OVER z AS down, count(*) OVER (PARTITION BY doc_id, seq) AS inked FROM line WHERE regexp_matches(text, '\\S')
  WINDOW a AS (PARTITION BY doc_id, seq ORDER BY line_no), z AS (PARTITION BY doc_id, seq ORDER BY line_no DESC)),
edge AS (SELECT doc_id, seq, CAST(inked AS INT) AS inked, CAST(line_no AS INT) AS line_no, text, up = 1 OR down = 1 AS outer_line FROM ink WHERE up <= 2 OR down <= 2),
bare AS (SELECT *, regexp_replace(trim(text), '^[*_# ]+|[*_# ]+$', '', 'g') AS s FROM edge),
shaped AS (SELECT *, lower(trim(regexp_replace(regexp_replace(s, '\\p{Nd}+', '#', 'g'), '\\s+', ' ', 'g'))) AS form,
  length(s) BETWEEN 1 AND 60 AND NOT regexp_matches(s, '[.,;:!?]$') AND NOT contains(s, '<sup>') AND NOT contains(s, '[^') AND NOT contains(s, '](') AS head,
  NOT regexp_matches(trim(text), '^(?:[-*+]\\s|\\d+[.)]\\s|>|\\||```|~~~|\\$\\$|<)') AS unstructured FROM bare),
many AS (SELECT doc_id, count(*) AS pages FROM damaged GROUP BY ALL),
whole AS (SELECT doc_id, form, n FROM (SELECT doc_id, form, count(DISTINCT seq) AS n FROM shaped WHERE head AND form <> '' GROUP BY ALL) JOIN many USING (doc_id)
  WHERE pages >= 4 AND n >= greatest(4, CAST(floor(pages * CAST(0.30 AS DOUBLE)) AS INT))),
hit AS (SELECT DISTINCT doc_id, seq, text, form FROM shaped WHERE outer_line AND inked >= 2 AND head AND unstructured AND form <> ''),
isle AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, form ORDER BY seq, text ROWS UNBOUNDED PRECEDING) AS isle
  FROM (SELECT *, seq - lag(seq) OVER (PARTITION BY doc_id, form ORDER BY seq, text) AS gap FROM hit)),
near AS (SELECT DISTINCT doc_id, seq, form FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, form, isle) AS n FROM isle) WHERE n >= 3),
marked AS (SELECT shaped.*, ltrim(text)[1] = '#' AS heading FROM shaped LEFT JOIN whole USING (doc_id, form) LEFT JOIN near ON near.doc_id = shaped.doc_id AND near.seq = shaped.seq AND near.form = shaped.form
  WHERE (whole.n IS NOT NULL AND head) OR (near.form IS NOT NULL AND outer_line AND head AND unstructured)),
gone AS (SELECT doc_id, seq, line_no FROM marked QUALIFY NOT heading OR row_number() OVER (PARTITION BY doc_id, form, heading ORDER BY seq, line_no) > 1)
"""


@query(D + ", " + LINES + "SELECT doc_id, seq, inked, line_no, text, outer_line FROM edge")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.edge_lines(_pages(spark, sf_dir)).withColumnRenamed("outer", "outer_line")


@query(D + ", " + LINES + "SELECT doc_id, form, n FROM whole")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.running_heads(_pages(spark, sf_dir))


@query(D + ", " + LINES + "SELECT doc_id, seq, form FROM near")
def local_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.local_heads(_pages(spark, sf_dir))


@query(
    D + ", " + LINES + """SELECT line.doc_id, line.seq, md5(string_agg(text, chr(10) ORDER BY line.line_no) FILTER (WHERE gone.line_no IS NULL)) AS body, CAST(count(gone.line_no) AS INT) AS heads_removed
FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.seq = gone.seq AND line.line_no = gone.line_no GROUP BY ALL"""
)
def strip_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads.strip_heads(_pages(spark, sf_dir)).select("doc_id", "seq", F.md5("body").alias("body"), "heads_removed")


@query(
    D + """, c AS (SELECT doc_id, seq, body, replace(replace(replace(replace(body, chr(173), ''), chr(8203), ''), chr(64257), 'fi'), chr(160), ' ') AS t FROM damaged)
SELECT doc_id, seq, md5(nfc_normalize(t)) AS body, CAST(length(body) - length(replace(replace(body, chr(173), ''), chr(8203), '')) + length(body) - length(replace(replace(body, chr(64257), ''), chr(160), '')) + length(t) - length(nfc_normalize(t)) AS INT) AS chars_cleaned FROM c"""
)
def clean_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.clean_characters(_pages(spark, sf_dir), "body").select("doc_id", "seq", F.md5("body").alias("body"), "chars_cleaned")


@query(D + r", line AS (SELECT doc_id, seq, unnest(string_split(body, chr(10))) AS text FROM damaged), m AS (SELECT doc_id, seq, regexp_extract(text, '^\s*\**(\d{1,3})\**\s*$', 1) AS n FROM line) SELECT doc_id, seq, CAST(n AS INT) AS n FROM m WHERE n <> '' AND CAST(n AS INT) BETWEEN 1 AND 437")
def margin_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.margin_numbers(_pages(spark, sf_dir)).select("doc_id", "seq", F.explode("margins").alias("n"))


_V = r"[\p{L}\p{Nl}\p{No}]+(?:[-\x{2010}\x{2011}][\p{L}\p{Nl}\p{No}]+)*"
VOCABULARY = rf"word AS (SELECT doc_id, regexp_replace(lower(unnest(regexp_extract_all(body, '{_V}'))), '[\x{{2010}}\x{{2011}}]', '-', 'g') AS token FROM damaged), vocab AS (SELECT doc_id, token, contains(token, '-') AS is_compound, count(*) AS n FROM word GROUP BY ALL)"


@query(D + ", " + VOCABULARY + " SELECT doc_id, token, is_compound, n FROM vocab")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.vocabulary(_pages(spark, sf_dir), "body")


_T = r"[\p{L}\p{N}]+(?:[-\x{2010}\x{2011}][\p{L}\p{N}]+)*"
_B = rf"({_T})([-\x{{2010}}\x{{2011}}])[ \t]*\n[ \t]*({_T})"
DECIDED = rf"""brk AS (SELECT doc_id, seq, unnest(regexp_extract_all(body, '{_B}', 1)) AS l, unnest(regexp_extract_all(body, '{_B}', 3)) AS r, unnest(range(len(regexp_extract_all(body, '{_B}', 1)))) AS place FROM damaged),
decided AS (SELECT brk.doc_id, seq, place, l, r, CASE WHEN regexp_matches(r, '^[\p{{Lu}}\p{{Nd}}]') OR regexp_matches(l, '\p{{Nd}}$') THEN TRUE WHEN coalesce(c.n, 0) > coalesce(w.n, 0) THEN TRUE WHEN w.n > 0 THEN FALSE ELSE contains(l, '-') OR contains(r, '-') END AS keeps
  FROM brk LEFT JOIN vocab w ON w.doc_id = brk.doc_id AND NOT w.is_compound AND w.token = lower(string_split(l, '-')[-1] || string_split(r, '-')[1])
  LEFT JOIN vocab c ON c.doc_id = brk.doc_id AND c.is_compound AND c.token = lower(l || '-' || r))"""


@query(D + ", " + VOCABULARY + ", " + DECIDED + ' SELECT doc_id, seq, l AS "left", r AS "right", keeps FROM decided')
def hyphen_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pw.hyphen_decisions(pw.hyphen_breaks(pages), pw.vocabulary(pages, "body")).select("doc_id", "seq", "left", "right", "keeps")


@query(
    D + ", " + VOCABULARY + ", " + DECIDED + rf""", decided_list AS (SELECT doc_id, seq, list(keeps ORDER BY place) AS k FROM decided GROUP BY ALL),
broken AS (SELECT d.doc_id, d.seq, body, string_split_regex(body, '{_B}') AS t, regexp_extract_all(body, '{_B}', 1) AS a, regexp_extract_all(body, '{_B}', 2) AS h, regexp_extract_all(body, '{_B}', 3) AS b, k FROM damaged d LEFT JOIN decided_list USING (doc_id, seq))
SELECT doc_id, seq, md5(CASE WHEN k IS NULL THEN body ELSE t[1] || array_to_string(list_transform(range(1, len(k) + 1), lambda i: a[i] || CASE WHEN k[i] THEN h[i] ELSE '' END || b[i] || t[i + 1]), '') END) AS body,
CAST(len(list_filter(coalesce(k, []), lambda x: NOT x)) AS INT) AS hyphens_joined, CAST(len(list_filter(coalesce(k, []), lambda x: x)) AS INT) AS hyphens_kept FROM broken"""
)
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select("doc_id", "seq", "page_no", "body")
    return pw.join_hyphens(pages, pw.vocabulary(pages, "body")).select("doc_id", "seq", F.md5("body").alias("body"), "hyphens_joined", "hyphens_kept")


@query()
def reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.reflow(_pages(spark, sf_dir).select("doc_id", "seq", "page_no", "body")).select("doc_id", "seq", F.md5("body").alias("body"), "lines_joined")


OUTLINE = r"""head AS (SELECT doc_id, seq, page_no, unnest(string_split(body, chr(10))) AS text, unnest(range(len(string_split(body, chr(10))))) AS line_no FROM damaged),
title AS (SELECT *, length(regexp_extract(trim(text), '^(#{1,6})[ \t]+(.*\S)[ \t]*$', 1)) AS hashes, regexp_replace(lower(regexp_extract(trim(text), '^(#{1,6})[ \t]+(.*\S)[ \t]*$', 2)), '[^\p{L}\p{N}]+', '', 'g') AS key FROM head WHERE regexp_matches(trim(text), '^#{1,6}[ \t]')),
entry AS (SELECT doc_id, regexp_replace(lower(chapter), '[^\p{L}\p{N}]+', '', 'g') AS key, 2 AS level, page_no AS place FROM damaged WHERE page_no % 10 = 0)
"""


@query(D + ", " + OUTLINE + "SELECT t.doc_id, seq, CAST(line_no AS INT) AS line_no, FALSE AS run_in, CAST(min(level) AS INT) AS level, bool_or(level <> hashes) AS changed FROM title t JOIN entry e ON e.doc_id = t.doc_id AND e.key = t.key AND abs(place - page_no) <= 1 GROUP BY t.doc_id, seq, line_no")
def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pw.heading_levels(pages, corpus.outline(pages)).select("doc_id", "seq", "line_no", "run_in", "level", "changed")


_LED, _TAILED = r"(\p{L})\[\\?(\p{L})(\d[\d–-]*)\]\(#([^)\s]+)\)", r"\[(\d[\d–-]*)([.,;:])\]\(#([^)\s]+)\)"


@query(
    D + rf""", l AS (SELECT doc_id, seq, body, regexp_replace(regexp_replace(body, '{_LED}', '\1\2[\3](#\4)', 'g'), '{_TAILED}', '[\1](#\3)\2', 'g') AS t FROM damaged)
SELECT doc_id, seq, md5(t) AS body, CAST(len(regexp_extract_all(body, '{_LED}')) + len(regexp_extract_all(body, '{_TAILED}')) AS INT) AS links_tidied FROM l"""
)
def tidy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.tidy_links(_pages(spark, sf_dir).select("doc_id", "seq", "page_no", "body")).select("doc_id", "seq", F.md5("body").alias("body"), "links_tidied")


_NOTE = r"(?:<sup>[0-9ivxIVX]{1,4}</sup>|\[\^[0-9ivxIVX]{1,4}\])"


@query(
    D + rf""", nl AS (SELECT doc_id, seq, page_no, unnest(string_split(body, chr(10))) AS x, unnest(range(len(string_split(body, chr(10))))) AS k FROM damaged),
cutl AS (SELECT doc_id, seq, page_no, string_agg(CASE WHEN regexp_matches(x, '^\s*{_NOTE}') THEN regexp_replace(x, '([.;])[ \t]+({_NOTE}[ \t]*\S)', '\1' || chr(10) || '\2', 'g') ELSE x END, chr(10) ORDER BY k) AS t FROM nl GROUP BY ALL),
own AS (SELECT *, array_to_string(list_distinct(regexp_extract_all(t, '(?m)^[ \t]*<sup>([0-9ivxIVX]{{1,4}})</sup>', 1) || regexp_extract_all(t, '(?m)^[ \t]*\[\^([0-9ivxIVX]{{1,4}})\]', 1)), '|') AS ids FROM cutl),
named AS (SELECT *, CASE WHEN ids = '' THEN t ELSE regexp_replace(t, '(?:<sup>|\[\^)(' || ids || ')(?:</sup>|\])', '[^p' || page_no || '-\1]', 'g') END AS u, CASE WHEN ids = '' THEN 0 ELSE len(regexp_extract_all(t, '(?:<sup>|\[\^)(' || ids || ')(?:</sup>|\])')) END AS n FROM own)
SELECT doc_id, seq, md5(regexp_replace(u, '(?m)^(\[\^p\d+-[0-9ivxIVX]{{1,4}}\])\s*([^:\s])', '\1: \2', 'g')) AS body, CAST(n AS INT) AS notes_numbered FROM named"""
)
def number_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.number_notes(_pages(spark, sf_dir).select("doc_id", "seq", "page_no", "body")).select("doc_id", "seq", F.md5("body").alias("body"), "notes_numbered")


@query(
    D + r""", link AS (SELECT DISTINCT doc_id, seq, unnest(regexp_extract_all(body, '\[[^\]\n]*\]\(#([^)\s]+)\)', 1)) AS target FROM damaged), id AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, 'id=["'']([^"'']+)["'']', 1)) AS target FROM damaged)
SELECT doc_id, seq, target FROM link WHERE NOT EXISTS (SELECT 1 FROM id WHERE id.doc_id = link.doc_id AND id.target = link.target)"""
)
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pw.dangling_links(_pages(spark, sf_dir))


@query()
def bridge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pw.stripped(heads.strip_heads(_pages(spark, sf_dir)))
    return pw.bridge_pages(pages, pw.vocabulary(pages, "body")).select("doc_id", "seq", F.md5("body").alias("body"), "pages_bridged")


@query()
def refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole refinement, with an outline."""
    pages = _pages(spark, sf_dir)
    return refine.refine(pg.paginate(pages), corpus.outline(pages)).select("doc_id", F.md5("text").alias("text"), F.char_length("text").alias("chars"))


@query()
def refine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return refine.refine_stats(refine.refine_pages(pg.paginate(pages), corpus.outline(pages), margins=True)).drop("margin_sequence")


def _witness(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page_no", F.when(F.col("id") % 5 == 4, "").otherwise(F.col("clean")).alias("layer_text"), ((F.col("id") % 97) / 1000).alias("ink"))


@query(
    D + ", " + loops("damaged", "doc_id, seq, page_no") + f""", w AS (SELECT doc_id, seq, page_no, {amount('body')} AS got, CASE WHEN id % 5 = 4 THEN 0 ELSE {amount('clean')} END AS expected, (id % 97) / 1000 AS ink FROM damaged),
r AS (SELECT *, CASE WHEN expected < 200 AND ink >= CAST(0.01 AS DOUBLE) AND got >= 20 THEN got / ink END AS rate FROM w), m AS (SELECT *, median(rate) OVER (PARTITION BY doc_id) AS usual, count(rate) OVER (PARTITION BY doc_id) AS n FROM r),
k AS (SELECT *, CASE WHEN expected >= 200 AND 5 * got < 3 * expected THEN 'missing' WHEN expected >= 200 AND 5 * got > 8 * expected THEN 'extra' WHEN expected < 200 AND ink >= CAST(0.01 AS DOUBLE) AND got < 20 THEN 'empty' WHEN n >= 8 AND rate < CAST(0.25 AS DOUBLE) * usual THEN 'sparse' END AS kind FROM m)
SELECT doc_id, seq, page_no, kind, kind IN ('missing', 'extra') AS strong FROM k WHERE kind IS NOT NULL UNION ALL SELECT doc_id, seq, page_no, 'repeated', TRUE FROM loops"""
)
def page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return audit.page_issues(pages, _witness(pages)).select("doc_id", "seq", "page_no", "kind", "strong")


@query(
    D + f""", w AS (SELECT doc_id, seq, page_no, {amount('body')} AS got, CASE WHEN id % 5 = 4 THEN 0 ELSE {amount('clean')} END AS expected, (id % 97) / 1000 AS ink FROM damaged WHERE NOT regexp_matches(doc_id, '^src[02468]')),
r AS (SELECT *, CASE WHEN expected < 200 AND ink >= CAST(0.01 AS DOUBLE) AND got >= 20 THEN got / ink END AS rate FROM w), m AS (SELECT *, median(rate) OVER (PARTITION BY doc_id) AS usual, count(rate) OVER (PARTITION BY doc_id) AS n FROM r),
k AS (SELECT *, CASE WHEN expected >= 200 AND 5 * got < 3 * expected THEN 'missing' WHEN expected >= 200 AND 5 * got > 8 * expected THEN 'extra' WHEN expected < 200 AND ink >= CAST(0.01 AS DOUBLE) AND got < 20 THEN 'empty' WHEN n >= 8 AND rate < CAST(0.25 AS DOUBLE) * usual THEN 'sparse' END AS kind FROM m)
SELECT doc_id, page_no, kind FROM k WHERE kind IS NOT NULL"""
)
def audit_unmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of which some have lost their page marks: those are not compared with any page."""
    pages = _pages(spark, sf_dir)
    lost = F.col("doc_id").rlike("^src[02468]")
    unmarked = pages.where(lost).groupBy("doc_id").agg(pg.in_order(F.col("seq"), F.col("body"), "\n\n").alias("text"))
    docs = pg.paginate(pages.where(~lost)).unionByName(unmarked)
    return audit.page_issues(pg.explode_pages(docs, marked=True), _witness(pages)).where("kind <> 'repeated'").select("doc_id", "page_no", "kind")


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every damaged page as a document."""
    return _pages(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("body").alias("text"))


@query(
    D + r""", n AS (SELECT id AS doc_id, len(regexp_extract_all(body, '[A-Za-z'']{28,}')) AS a, len(regexp_extract_all(body, '[\x{370}-\x{3ff}\x{1f00}-\x{1fff}]+')) AS b, len(regexp_extract_all(body, '\[\^[^\]]+\]|<sup>')) AS c FROM damaged)
SELECT doc_id, 2 AS ord, 'word spacing' AS name, a <= 5 AS ok, a || ' run-on words' AS detail FROM n UNION ALL SELECT doc_id, 3, 'greek', TRUE, b || ' Greek runs' FROM n UNION ALL SELECT doc_id, 5, 'footnotes', c > 0, c || ' footnote markers' FROM n"""
)
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that SQL can count."""
    return verify.content_checks(_single(spark, sf_dir), ("footnotes",)).where("name <> 'italics'")


@query()
def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.findings(_single(spark, sf_dir), expect=("footnotes",))


@query()
def embedded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return verify.embedded_similarity(pages, _witness(pages))


@query(D + ", s AS (SELECT doc_id, seq, count(*) OVER (PARTITION BY doc_id) AS n FROM damaged) SELECT doc_id, seq FROM s WHERE seq % greatest(1, n // 12) = 0 AND seq // greatest(1, n // 12) < 12")
def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.sampled(_pages(spark, sf_dir), "seq", 12).select("doc_id", "seq")


PROBE = """probe AS (SELECT doc_id, page_no, CASE WHEN doc_id LIKE 'src7-%' THEN '' ELSE clean END AS layer_text, CASE WHEN doc_id LIKE 'src3-%' THEN 1.0 ELSE 0.1 END AS covered, CASE WHEN doc_id LIKE 'src5-%' THEN 'Paper  Capture 9' ELSE 'TeX' END AS producer FROM damaged),
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM probe),
t AS (SELECT doc_id, sum(length(layer_text)) AS chars, sum(len(regexp_extract_all(layer_text, '[A-Za-z'']{28,}'))) AS runs, count(*) AS k FROM num WHERE place % greatest(1, n // 12) = 0 AND place // greatest(1, n // 12) < 12 GROUP BY ALL),
s AS (SELECT doc_id, avg(CASE WHEN covered >= 0.9 THEN 1.0 ELSE 0.0 END) AS scanned FROM num WHERE place % greatest(1, n // 8) = 0 AND place // greatest(1, n // 8) < 8 GROUP BY ALL),
p AS (SELECT doc_id, count(*) AS pages, min(producer) AS producer FROM probe GROUP BY ALL),
v AS (SELECT *, CASE WHEN chars / k < 120 THEN 'no_text' WHEN scanned >= 0.6 THEN 'bad_ocr' WHEN (CASE WHEN chars > 0 THEN runs / chars * 1000 ELSE 0 END) >= 1 OR regexp_matches(producer, '(?i)paper\\s*capture|ocr') THEN 'bad_ocr' ELSE 'born_digital' END AS verdict FROM p JOIN t USING (doc_id) JOIN s USING (doc_id))
"""


@query(D + ", " + PROBE + "SELECT doc_id, pages, verdict AS text_verdict, verdict <> 'born_digital' AS recommend_ocr, CAST(pages * CASE WHEN verdict <> 'born_digital' THEN CAST(45.0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS DOUBLE) AS estimated_seconds FROM v")
def analyze_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = lambda k: F.col("doc_id").startswith(f"src{k}-")
    probe = _pages(spark, sf_dir).select("doc_id", "page_no", F.when(src(7), "").otherwise(F.col("clean")).alias("layer_text"), F.when(src(3), 1.0).otherwise(0.1).alias("max_image_coverage"), F.when(src(5), "Paper  Capture 9").otherwise("TeX").alias("producer"))
    return inspection.analyze(probe).select("doc_id", "pages", "text_verdict", "recommend_ocr", "estimated_seconds")


SPREAD = """WITH page AS (SELECT coalesce(source, 'none') || '-' || CAST(doc_id // 1000 AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY coalesce(source, 'none') || '-' || CAST(doc_id // 1000 AS VARCHAR) ORDER BY doc_id) - 1 AS src_page, doc_id AS i FROM documents),
col AS (SELECT doc_id, src_page, i, unnest(range(200)) AS x FROM page),
ink AS (SELECT *, CAST(CASE WHEN x >= 90 + i % 21 AND x < 90 + i % 21 + 4 + i % 9 THEN CASE WHEN i % 4 = 0 AND x = 92 + i % 21 THEN 40 ELSE 0 END WHEN i % 15 = 7 AND x >= 90 + i % 21 THEN 0 ELSE (x * 7 + i * 13) % 50 + 50 END AS BIGINT) AS v FROM col),
lim AS (SELECT doc_id, src_page, quantile_cont(v, CAST(0.95 AS DOUBLE)) * CAST(0.05 AS DOUBLE) AS floor FROM ink GROUP BY ALL),
mid AS (SELECT doc_id, src_page, x, x - row_number() OVER (PARTITION BY doc_id, src_page ORDER BY x) AS run FROM ink JOIN lim USING (doc_id, src_page) WHERE x >= 70 AND x < 130 AND v <= floor),
run AS (SELECT doc_id, src_page, run, min(x) AS a, max(x) + 1 AS b FROM mid GROUP BY ALL),
stripped AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, src_page ORDER BY a) AS strip FROM (SELECT *, a - lag(b) OVER (PARTITION BY doc_id, src_page ORDER BY a) AS gap FROM run)),
strip AS (SELECT doc_id, src_page, min(a) AS a, max(b) AS b FROM stripped GROUP BY doc_id, src_page, strip),
best AS (SELECT * FROM strip QUALIFY row_number() OVER (PARTITION BY doc_id, src_page ORDER BY b - a DESC, a) = 1),
gutter AS (SELECT page.doc_id, page.src_page, i, CASE WHEN a IS NULL THEN 0.5 ELSE (a + (b - a) / 2) / 200 END AS gutter, CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / 200 END AS band FROM page LEFT JOIN best USING (doc_id, src_page))
"""


@query(SPREAD + "SELECT doc_id, src_page, CAST(gutter AS DOUBLE) AS gutter, CAST(band AS DOUBLE) AS band FROM gutter")
def gutters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.gutters(corpus.spreads(corpus.documents(spark, sf_dir))).select("doc_id", "src_page", "gutter", "band")


@query(
    SPREAD + """, half AS (SELECT g.doc_id, g.src_page, g.gutter, sum(CASE WHEN x < floor(gutter * 200) THEN v ELSE 0 END) AS l, sum(CASE WHEN x >= floor(gutter * 200) THEN v ELSE 0 END) AS r FROM gutter g JOIN ink ON ink.doc_id = g.doc_id AND ink.src_page = g.src_page GROUP BY ALL),
kept AS (SELECT doc_id, src_page, 0 AS side, 'left' AS half, gutter FROM half WHERE l + r > 0 AND l >= (l + r) * CAST(0.02 AS DOUBLE) UNION ALL SELECT doc_id, src_page, 1, 'right', gutter FROM half WHERE l + r > 0 AND r >= (l + r) * CAST(0.02 AS DOUBLE))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY src_page, side) - 1 AS INT) AS out_page, src_page, half, round_even(CAST(gutter AS DOUBLE), 4) AS gutter_frac FROM kept"""
)
def spread_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.split_spreads(corpus.spreads(corpus.documents(spark, sf_dir)))


@query(
    SPREAD + """, num AS (SELECT g.*, i % 10 <> 9 AS wide, row_number() OVER (PARTITION BY doc_id ORDER BY src_page) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM gutter g)
SELECT doc_id, count(*) AS checked, count_if(wide) AS landscape, count_if(wide AND band >= CAST(0.015 AS DOUBLE)) AS spreads, count_if(wide AND band >= CAST(0.015 AS DOUBLE)) / count(*) >= CAST(0.6 AS DOUBLE) AS is_spread FROM num WHERE place % greatest(1, n // 20) = 0 AND place // greatest(1, n // 20) < 20 GROUP BY doc_id"""
)
def spread_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.spread_verdict(corpus.spreads(corpus.documents(spark, sf_dir))).select("doc_id", "checked", "landscape", "spreads", "is_spread")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with anchors, notes numbered."""
    pages = _pages(spark, sf_dir)
    return pg.assemble(pw.stripped(pw.number_notes(pages.select("doc_id", "seq", "page_no", "body"))))


@query()
def chapter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.choose_level(pg.explode_lines(_books(spark, sf_dir)))


@query()
def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.split_chapters(_books(spark, sf_dir)).select("doc_id", "n", "title", F.md5("body").alias("body"), "first_page", "last_page", "notes_moved")


@query()
def chapter_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.export_manifest(_books(spark, sf_dir), book_pages=20).select("doc_id", "n", "file", F.md5("body").alias("body"))


@query(
    D + r""", t AS (SELECT id AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_split(clean, chr(10))[1], '<sup>.*?</sup>|<sub>.*?</sub>|\[\^[^\]]*\]', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), '[\\/:*?"<>|#^\[\]`*_~]', ' ', 'g'), '\s+', ' ', 'g') AS t FROM damaged)
SELECT doc_id, regexp_replace(CASE WHEN length(trim(t)) > 80 THEN regexp_replace(substr(trim(t), 1, 81), ' [^ ]*$', '') ELSE trim(t) END, '[ .]+$', '') AS title FROM t"""
)
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as titles."""
    return _pages(spark, sf_dir).select(F.col("id").alias("doc_id"), T.clean_title(F.split("clean", "\n")[0]).alias("title"))


TOTAL = "total AS (SELECT doc_id, count(*) AS total_pages FROM damaged GROUP BY ALL), plan AS (SELECT doc_id, total_pages, unnest(range(0, total_pages, 20)) AS first FROM total), chunk AS (SELECT doc_id, first, least(first + 19, total_pages - 1) AS last FROM plan)"


def _plan(pages: DataFrame) -> DataFrame:
    return chunks.plan_chunks(pages.groupBy("doc_id").agg(F.count("*").alias("total_pages")))


@query(D + ", " + TOTAL + " SELECT doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM chunk")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(_pages(spark, sf_dir))


def _written(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Chunks of a run that left out some."""
    joined = pages.withColumn("first", (F.floor(F.col("page_no") / P.CHUNK_PAGES) * P.CHUNK_PAGES).cast("int")).join(plan, ["doc_id", "first"])
    return joined.groupBy("doc_id", "first", "last").agg(pg.in_order(F.col("page_no"), F.col("body"), "\n\n").alias("text"))


@query(D + ", " + TOTAL + " SELECT doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM chunk WHERE first % 60 = 20")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(_pages(spark, sf_dir))
    return chunks.pending_chunks(plan, plan.where("first % 60 <> 20"))


@query(
    D + ", " + TOTAL + r""", part AS (SELECT d.doc_id, c.first, regexp_replace(string_agg(body, chr(10) || chr(10) ORDER BY page_no), '^\s+|\s+$', '', 'g') AS text FROM damaged d JOIN chunk c ON c.doc_id = d.doc_id AND c.first = d.page_no // 20 * 20 GROUP BY ALL)
SELECT doc_id, md5(string_agg(regexp_replace(text, '(\(#|id=["''])(page-\d+-\d+)', '\1c' || lpad(CAST(first AS VARCHAR), 4, '0') || '-\2', 'g'), chr(10) || chr(10) ORDER BY first) || chr(10)) AS text FROM part GROUP BY doc_id"""
)
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    plan = _plan(pages)
    return chunks.concatenate(_written(pages, plan), plan).select("doc_id", F.md5("text").alias("text"))


@query(
    D + ", " + TOTAL + r""", part AS (SELECT d.doc_id, c.first, c.last, regexp_replace(string_agg(body, chr(10) || chr(10) ORDER BY page_no), '^\s+|\s+$', '', 'g') AS text FROM damaged d JOIN chunk c ON c.doc_id = d.doc_id AND c.first = d.page_no // 20 * 20 GROUP BY ALL)
SELECT doc_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, md5(text) AS text FROM part"""
)
def chunks_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written in two runs, of which the second finds what the first left out, and writes one again."""
    pages = _pages(spark, sf_dir)
    plan = cut(_plan(pages))
    chunk = cut(_written(pages, plan).withColumn("text", T.strip(F.col("text"))))
    path = f"{shared(spark)}/chunks-{uuid.uuid4().hex}"
    write_chunks(chunk.where("first % 60 <> 20"), path)
    todo = chunks.pending_chunks(plan, written_chunks(spark, path))
    write_chunks(chunk.join(todo, ["doc_id", "first", "last"], "left_semi").unionByName(chunk.where("first = 0")).dropDuplicates(["doc_id", "first"]), path)
    return written_chunks(spark, path).select("doc_id", "first", "last", F.md5("text").alias("text"))


@query(
    D + r""", m AS (SELECT id AS doc_id, list_sort(regexp_extract_all(body, '\[\^([^\]]{1,32})\]', 1)) AS a, list_sort(regexp_extract_all(body, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS b, CASE WHEN id % 3 = 0 THEN body || ' [^' || id || ']' ELSE upper(body) END AS t FROM damaged)
SELECT doc_id, a <> list_sort(regexp_extract_all(t, '\[\^([^\]]{1,32})\]', 1)) OR b <> list_sort(regexp_extract_all(t, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS drift FROM m"""
)
def markup_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a translator that adds a note now and then."""
    answer = F.when(F.col("id") % 3 == 0, F.concat("body", F.lit(" [^"), F.col("id").cast("string"), F.lit("]"))).otherwise(F.upper("body"))
    return translation.judged(_pages(spark, sf_dir).withColumn("answer", answer)).select(F.col("id").alias("doc_id"), "drift")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("name"), "pages", F.lit(None).cast("boolean").alias("split"), F.lit(None).cast("boolean").alias("ocr"))
    number = F.regexp_extract("doc_id", r"src(\d+)-", 1).cast("int")
    overlay = docs.where(number % 3 == 0).select("doc_id", (number % 6 == 0).alias("skip"), (number % 5).alias("attempts"), F.lit("").alias("last_error"))
    plan = chunks.plan_chunks(docs.withColumnRenamed("pages", "total_pages"), P.QUEUE_CHUNK_PAGES)
    return catalog.document_state(docs, plan.where((F.col("first") < number * 10)), overlay)


STATE = r"""b AS (SELECT doc_id, count(*) AS pages, CAST(regexp_extract(doc_id, 'src(\d+)-', 1) AS INT) AS k FROM damaged GROUP BY ALL),
c AS (SELECT *, CAST(ceil(pages / 10) AS BIGINT) AS chunks_total, least(CAST(ceil(pages / 10) AS BIGINT), k) AS chunks_done, k % 3 = 0 AND k % 6 = 0 AS skip, CASE WHEN k % 3 = 0 THEN k % 5 ELSE 0 END AS attempts FROM b),
s AS (SELECT *, CASE WHEN skip THEN 'skipped' WHEN chunks_total > 0 AND chunks_done >= chunks_total THEN 'done' WHEN attempts >= 3 THEN 'stalled' WHEN chunks_done > 0 THEN 'in progress' ELSE 'pending' END AS status FROM c)
"""


@query(D + ", " + STATE + "SELECT doc_id, pages, chunks_total, chunks_done, skip, attempts, status, CAST(least(1.0, chunks_done / chunks_total) AS DOUBLE) AS fraction FROM s")
def document_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("doc_id", "pages", "chunks_total", "chunks_done", "skip", "attempts", "status", "fraction")


@query(D + ", " + STATE + "SELECT doc_id, status FROM s WHERE status IN ('pending', 'in progress') ORDER BY chunks_done = 0, lower(doc_id || '.pdf'), doc_id LIMIT 1")
def next_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one document that comes next."""
    return catalog.next_pending(_state(spark, sf_dir)).select("doc_id", "status")


@query("SELECT user_id, since, ts AS until, CAST(floor(epoch(ts)) - floor(epoch(since)) AS BIGINT) AS idle FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events) WHERE CAST(floor(epoch(ts)) - floor(epoch(since)) AS BIGINT) > 1200")
def stall_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stalls(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")


@query("SELECT user_id, min(ts) AS began, max(ts) AS last, count(*) AS events FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 1200 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY user_id, s")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of activity, by the session windows that the stream uses."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", F.session_window("ts", f"{P.STALL_SECONDS} seconds").alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    return e.select("user_id", F.col("w.start").alias("began"), "last", "events")




@query(
    r"""WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
s AS (SELECT *, trim(raw) AS s FROM line),
f AS (SELECT *, regexp_matches(s, '^(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||!\[|\[\^[^\]]+\]:)') OR (s[1] = '<' AND NOT regexp_matches(s, '^</?(?:sup|sub|i|b|em|strong|a|span|math)\b')) AS block, lag(s) OVER w AS before, lag(raw) OVER w AS behind FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
j AS (SELECT *, before IS NOT NULL AND s <> '' AND before <> '' AND NOT block AND NOT ends_with(before, '\') AND NOT ends_with(behind, '  ') AND NOT regexp_matches(before, '[\p{L}\p{N}_][-\x{2010}\x{2011}]$') AND NOT regexp_matches(before, '^(?:#{1,6}\s|\||!\[)') AS joins FROM f),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS grp, lead(joins) OVER (PARTITION BY doc_id ORDER BY k) AS more FROM j),
p AS (SELECT doc_id, grp, string_agg(CASE WHEN joins THEN s WHEN more THEN rtrim(raw) ELSE raw END, ' ' ORDER BY k) AS t, CAST(count_if(joins) AS INT) AS n FROM g GROUP BY ALL)
SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY grp)) AS body, CAST(sum(n) AS INT) AS lines_joined FROM p GROUP BY doc_id"""
)
def reflow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clean documents reflowed."""
    d = corpus.documents(spark, sf_dir).select("doc_id", F.lit(0).alias("seq"), F.lit(0).alias("page_no"), F.coalesce("text", F.lit("")).alias("body"))
    return pw.reflow(d).select("doc_id", F.md5("body").alias("body"), "lines_joined")


@query(
    D + r""", whole AS (SELECT doc_id, regexp_replace(string_agg('<!-- page ' || page_no || ' -->' || chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY seq), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM damaged GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM whole),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(text, '^<!--\s*page\s+(\d+)\s*-->\s*$', 1), '') AS INT) AS own FROM l)
SELECT doc_id, CAST(line_no AS INT) AS line_no, md5(text) AS text, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page_no, CAST(length(regexp_extract(text, '^(#{1,6})[ \t]+(.*\S)[ \t]*$', 1)) AS INT) AS level, own IS NOT NULL AS is_anchor FROM n"""
)
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pg.assemble(pw.stripped(_pages(spark, sf_dir).select("doc_id", "seq", "page_no", "body")))
    return pg.explode_lines(docs).withColumn("text", F.md5("text"))


ORACLES["chapter_levels"] = D + "SELECT doc_id, 1 AS cut_level FROM damaged WHERE page_no % 10 = 0 GROUP BY doc_id HAVING count(*) >= 2"


@query(
    D + """, h AS (SELECT doc_id, page_no, chapter, max(page_no) OVER (PARTITION BY doc_id) AS ends, page_no % 10 = 0 AS opens FROM damaged)
SELECT doc_id, CAST(page_no // 10 + 1 AS INT) AS n, chapter AS title, CAST(page_no AS INT) AS first_page, CAST(CASE WHEN page_no + 10 > ends THEN ends WHEN (page_no + 10) % 6 <> 5 THEN page_no + 10 ELSE page_no + 9 END AS INT) AS last_page FROM h WHERE opens"""
)
def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of books whose headings stand on every tenth page, below a running head that ends the chapter before."""
    return chapters.raw_chapters(_books(spark, sf_dir), most=10**9).select("doc_id", "n", "title", "first_page", "last_page")


@query(
    """WITH d AS (SELECT doc_id, source || '_' || upper(lang) || '_' || CASE WHEN doc_id % 3 = 0 THEN 'BT' ELSE 'Title' || doc_id END AS name FROM documents), p AS (SELECT *, string_split(name, '_')[-1] AS last FROM d)
SELECT doc_id, CASE WHEN length(regexp_replace(last, '[^\\p{L}]', '', 'g')) >= 4 THEN last ELSE name END AS prefix, lpad(CAST(doc_id % 120 AS VARCHAR), CASE WHEN doc_id % 120 >= 100 THEN 3 ELSE 2 END, '0') AS number,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'p. ' || doc_id ELSE 'pp. ' || doc_id || '–' || (doc_id + 3) END AS label, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  lpad(CAST(doc_id % 9000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(doc_id % 9000 + 9 AS VARCHAR), 4, '0') || '.md' AS chunk FROM p"""
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of books, chapters, pages and chunks."""
    i = F.col("doc_id")
    name = F.concat("source", F.lit("_"), F.upper("lang"), F.lit("_"), F.when(i % 3 == 0, "BT").otherwise(F.concat(F.lit("Title"), i.cast("string"))))
    first, last = F.when(i % 5 != 0, i), F.when(i % 5 != 0, F.when(i % 2 == 0, i).otherwise(i + 3))
    file = T.chapter_file(F.lit(""), (i % 120).cast("int"), F.lit(""), F.lit(2))
    return corpus.documents(spark, sf_dir).select(
        "doc_id", T.book_prefix(name).alias("prefix"), F.trim(F.regexp_replace(file, r"\.md\z", "")).alias("number"), T.page_label(first, last).alias("label"), T.slug(name).alias("slug"),
        T.chunk_name((i % 9000).cast("int"), (i % 9000 + 9).cast("int")).alias("chunk"),
    )


@query("SELECT p_brand AS provider, list_sort(list(DISTINCT p_name) FILTER (WHERE p_size % 5 <> 0 AND p_size * 500 >= 8000 AND p_size % 7 <> 0)) AS models FROM part GROUP BY p_brand HAVING count_if(p_size % 5 <> 0 AND p_size * 500 >= 8000 AND p_size % 7 <> 0) > 0")
def model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of models, made of parts: some inactive, some without text, some with too short answers."""
    size = F.col("p_size")
    entry = F.struct(F.col("p_name").alias("id"), (size % 5 != 0).alias("active"), F.when(size % 7 == 0, F.array(F.lit("audio"))).otherwise(F.array(F.lit("text"), F.lit("image"))).alias("input_modalities"), (size * 500).alias("max_completion_tokens"))
    body = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("provider")).agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("body"))
    return translation.listed_models(body).where(F.size("models") > 0)


@query(
    """WITH r AS (SELECT user_id AS doc_id, event_id AS at_id, event_type = 'purchase' AS progressed, event_type AS error FROM events), l AS (SELECT *, max(CASE WHEN progressed THEN at_id END) OVER (PARTITION BY doc_id) AS last FROM r)
SELECT doc_id, count_if(last IS NULL OR at_id > last) AS attempts, coalesce(arg_max(error, at_id) FILTER (WHERE last IS NULL OR at_id > last), '') AS last_error FROM l GROUP BY doc_id"""
)
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs since the last that progressed, with events as runs."""
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("progressed"), F.col("event_type").alias("error"))
    return catalog.attempts(runs)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) || ',' || CAST(doc_id AS VARCHAR) || '-' || CAST(doc_id + doc_id % 4 AS VARCHAR) END AS spec, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 4 + 2 END AS n, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id + (doc_id % 4 + 1) * doc_id + (doc_id % 4) * (doc_id % 4 + 1) // 2 END AS total FROM documents")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of pages as they are asked for."""
    i = F.col("doc_id")
    spec = F.when(i % 4 == 0, "").otherwise(F.concat_ws("", i.cast("string"), F.lit(","), i.cast("string"), F.lit("-"), (i + i % 4).cast("string")))
    d = corpus.documents(spark, sf_dir).select("doc_id", spec.alias("spec")).withColumn("pages", T.page_range(F.col("spec")))
    return d.select("doc_id", "spec", F.size("pages").cast("long").alias("n"), F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    D + r""", b AS (SELECT DISTINCT doc_id, CAST(regexp_extract(doc_id, 'src(\d+)-', 1) AS INT) AS k FROM damaged), o AS (SELECT *, k % 3 = 0 AND doc_id = (SELECT min(doc_id) FROM b WHERE k % 3 = 0) AS in_root FROM b)
SELECT doc_id, CASE WHEN in_root THEN 'out' ELSE 'out/' || doc_id END AS out_dir, CASE WHEN in_root THEN 'out/images' WHEN k % 4 = 0 THEN 'out/' || doc_id || '/images' ELSE 'out/' || doc_id || '/' || doc_id || '_images' END AS image_dir FROM o"""
)
def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the books: two in three have begun their own, one has begun in the root, some have old image folders."""
    docs = _pages(spark, sf_dir).select("doc_id").distinct().select("doc_id", F.concat(F.lit("/books/"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.regexp_extract("doc_id", r"src(\d+)-", 1).cast("int").alias("k"))
    own = docs.select(F.concat(F.lit("out/"), F.col("doc_id")).alias("folder"), (F.col("k") % 3).alias("chunks"), F.lit(None).cast("string").alias("owner"), (F.col("k") % 4 == 0).alias("images"))
    root = docs.where("k % 3 = 0").agg(F.lit("out").alias("folder"), F.lit(4).alias("chunks"), F.min("path").alias("owner"), F.lit(True).alias("images"))
    return catalog.output_folders(docs, own.union(root), "out")


@query("SELECT user_id, max(ts) AS since, CAST((SELECT floor(epoch(max(ts))) FROM events) - floor(epoch(max(ts))) AS BIGINT) AS idle FROM events GROUP BY user_id HAVING CAST((SELECT floor(epoch(max(ts))) FROM events) - floor(epoch(max(ts))) AS BIGINT) > 1200")
def silent_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is silent at the time of the last event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max("ts")).first()[0]
    return catalog.silent(events, "user_id", F.lit(now))


@query("SELECT p_brand AS provider, count(*) AS answers, CAST(count_if(p_size % 5 = 0 OR p_size % 7 = 0) AS BIGINT) AS refused, CAST(sum(p_size * 10) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END) AS BIGINT) AS output_tokens FROM part GROUP BY p_brand")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions made of parts: some cut off, some empty, some that do not tell what they wrote."""
    size = F.col("p_size").cast("long")
    choice = F.struct(F.struct(F.when(size % 7 == 0, "").otherwise(F.col("p_name")).alias("content")).alias("message"), F.when(size % 5 == 0, "length").otherwise("stop").alias("finish_reason"))
    used = F.struct((size * 10).alias("prompt_tokens"), F.when(size % 3 != 0, size).alias("completion_tokens"))
    body = F.to_json(F.struct(F.array(choice).alias("choices"), used.alias("usage")))
    return translation.token_usage(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("provider"), body.alias("body")), "provider")
