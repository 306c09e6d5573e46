"""Queries on small inline tables for operators that the driver's tables give no (or no telling) input for.

Each case's SQL states the rows that must come out, worked out by hand from the operator's definition. Cases of the predicates P1-P8 are named pred1 to
pred8, as the names p1 to p10 belong to the training-data problems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi import schemas
from pothi.functions import text as T
from pothi.operators import chunking, corpus, evaluation, parsing, retrieval
from pothi.sources import readers, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def case(name: str, columns: str, *rows: str) -> Callable[[Callable[[SparkSession], DataFrame]], None]:
    def add(f: Callable[[SparkSession], DataFrame]) -> None:
        QUERIES[name] = lambda spark, _: f(spark)
        SQL[name] = f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"

    return add


def _pages(s: SparkSession) -> DataFrame:
    """d1: a head on all of 4 pages; d2: on both of 2; d3: 5 pages, one line on 3 and another on 2; d4: a word cut over a line end."""
    texts = {
        "d1": [f"Board of Works\nlevy note {i}" for i in range(4)],
        "d2": ["Head\nred", "Head\nblue"],
        "d3": ["Foot\na1", " Foot \nTwice", "Foot\nTwice", "a4", "Foot too\na5"],
        "d4": ["the irri-\ngation tank", "of BIS-\nMARCK", "Board of Works"],
    }
    return s.createDataFrame([(d, i, t, i + 1, "TextItem", None) for d, ts in texts.items() for i, t in enumerate(ts)], schemas.BLOCK)


@case("a1_furniture_case", "document_id, line, on_pages", "('d1', 'Board of Works', 4)", "('d3', 'Foot', 3)")
def _(s):
    return chunking.furniture(_pages(s))


@case("z6_stripped_case", "document_id, seq, text", *[f"('d1', {i}, 'levy note {i}')" for i in range(4)], "('d2', 0, 'Head' || chr(10) || 'red')", "('d2', 1, 'Head' || chr(10) || 'blue')", "('d3', 0, 'a1')", "('d3', 1, 'Twice')", "('d3', 2, 'Twice')", "('d3', 3, 'a4')", "('d3', 4, 'Foot too' || chr(10) || 'a5')", "('d4', 0, 'the irrigation tank')", "('d4', 1, 'of BIS-' || chr(10) || 'MARCK')", "('d4', 2, 'Board of Works')")
def _(s):
    return chunking.strip_furniture(_pages(s)).select("document_id", "seq", "text")


def _sized(s: SparkSession) -> DataFrame:
    """Blocks a (1100 letters), b (90), c (1150), a table of 1300, a heading, d (200), e (2500 without a sentence end)."""
    rows = [("a" * 1100, 1, "TextItem"), ("b" * 90, 1, "TextItem"), ("c" * 1150, 2, "TextItem"), ("|" + "t" * 1299, 3, "TableItem"), ("h" * 20, 3, "TitleItem"), ("d" * 200, 4, "TextItem"), ("e" * 2500, 5, "TextItem")]
    return s.createDataFrame([("d", i, t, p, k, None) for i, (t, p, k) in enumerate(rows)], schemas.BLOCK)


_SPLIT = "document_id, ordinal, page, end_page, first, chars"


def _shape(chunks: DataFrame) -> DataFrame:
    return chunks.select("document_id", "ordinal", "page", "end_page", F.substring("text", 1, 1).alias("first"), F.length("text").alias("chars"))


@case("z3_fixed_case", _SPLIT, "('d', 0, 1, 1, 'a', 1192)", "('d', 1, 1, 2, 'b', 1242)", "('d', 2, 3, 3, '|', 1200)", "('d', 3, 3, 4, 't', 324)", "('d', 4, 5, 5, 'e', 1200)", "('d', 5, 5, 5, 'e', 1200)", "('d', 6, 5, 5, 'e', 100)")
def _(s):
    """a and b fit; b is carried over to c; the table and e are cut hard; its rest, the heading and d fit."""
    return _shape(chunking.split(_sized(s), False))


@case("z4_section_case", _SPLIT, "('d', 0, 1, 1, 'a', 1192)", "('d', 1, 1, 2, 'b', 1242)", "('d', 2, 3, 3, '|', 1300)", "('d', 3, 3, 4, 'h', 222)", "('d', 4, 5, 5, 'e', 1200)", "('d', 5, 5, 5, 'e', 1200)", "('d', 6, 5, 5, 'e', 100)")
def _(s):
    """The table is a chunk of its own, whole; the heading opens a section."""
    return _shape(chunking.split(_sized(s), True))


@case("pred3_violations_case", "ordinal", "(1)", "(2)", "(3)", "(4)", "(5)")
def _(s):
    rows = [(0, "ok", 1, 2), (1, "x", 0, 1), (2, "x", 3, 2), (3, " \n ", 1, 1), (4, None, 1, 1), (5, "x", None, 1)]
    return chunking.violations(s.createDataFrame(rows, "ordinal int, text string, page int, end_page int")).select("ordinal")


@case("f28_scan_case", "path, line_no, rule, shown", "('a', 1, 'dash', '')", "('a', 2, 'credential', 'ghp_abcd')", "('a', 4, 'absolute', 'prevents')", "('a', 4, 'emoji', '')", "('a', 5, 'attribution', 'co-authored-by')", "('gold/a', 2, 'absolute', 'solves')")
def _(s):
    texts = {"a": ["x — y", "token ghp_abcdefghij0123456789", "fine © here", "it Prevents rot ☀", "Co-Authored-By: someone"], "gold/a": ["1990–1995", "solves it"]}
    return corpus.scan_lines(s.createDataFrame([(p, i + 1, t) for p, ts in texts.items() for i, t in enumerate(ts)], "path string, line_no int, line string"), ("gold/",))


@case("s21_log_case", "id, record_no, rule", "(1, 1, 'dash')", "(1, 3, 'attribution')", "(1, 3, 'tell')")
def _(s):
    log = s.createDataFrame([(1, "first\u001esecond – part\u001e \u001ewith the help of Copilot")], "id int, log string").select("id", F.col("log").alias("text"))
    return corpus.scan_records(corpus.split_records(log))


@case("f4_normalized_case", "id, text", "(1, 'caf' || chr(233) || ' a b')", "(2, '')", "(3, NULL)")
def _(s):
    return s.createDataFrame([(1, " café\n\ta  b "), (2, "  "), (3, None)], "id int, text string").select("id", T.normalize(F.col("text")).alias("text"))


@case("f6_similarity_case", "id, similarity", "(1, 1.0)", "(2, 0.75)", "(3, -1.5)", "(4, 1.0)", "(5, 0.0)", "(6, 1.0)", "(7, 0.857143)")
def _(s):
    """Texts that differ in white space or composition only are alike; letters count, not bytes."""
    rows = [(1, "p  q\n\tr", "p q r"), (2, "गाँव", "गांव"), (3, "abcde", "xy"), (4, " ", ""), (5, "a", " "), (6, "café", "café"), (7, "abcdeXg", "abcdefg")]
    return s.createDataFrame(rows, "id int, o string, g string").select("id", F.round(T.text_similarity(F.col("o"), F.col("g")), 6).alias("similarity"))


@case("f7_html_case", "id, markdown", "(1, '| Crop | Rate |' || chr(10) || '|---|---|' || chr(10) || '| Rye &amp; oat | 7 |' || chr(10) || '| Hay |  |')", "(2, '')", "(3, NULL)")
def _(s):
    html = '<TABLE><tr class="h"><th>Crop</th><td><b>Rate</b></td></tr>\n<tr><td> </td></tr><tr><td>Rye\n &amp; oat</td><td>7</td></tr><tr><td>Hay</td></tr></TABLE>'
    return s.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "id int, html string").select("id", T.html_table_to_markdown(F.col("html")).alias("markdown"))


_TABLE = "x\n|| Crop<br>name | Rate ||\n|:--|---:|\n| Rye | 7 |\n\n| Hay | 12<br/>a |"


@case("f8_table_case", "id, header, row1, row2", "(1, 'Crop name;Rate', 'Rye;7', 'Hay;12<br/>a')", "(2, NULL, NULL, NULL)", "(3, NULL, NULL, NULL)")
def _(s):
    t = F.col("t")
    row = lambda i: F.array_join(F.get("t.rows", F.lit(i)), ";")
    rows = s.createDataFrame([(1, _TABLE), (2, "| a |\n| b |"), (3, "| a |")], "id int, x string").select("id", T.parse_markdown_table(F.col("x")).alias("t"))
    return rows.select("id", F.array_join(t["header"], ";").alias("header"), row(0).alias("row1"), row(1).alias("row2"))


@case("f13_teds_case", "id, teds", "(1, 1.0)", "(2, 0.75)", "(3, 0.0)", "(4, 0.9)", "(5, 1.0)")
def _(s):
    """Itself; a row of three nodes of twelve lost; no table; a cell changed of ten nodes; a cell that begins alike."""
    full = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    wide = "| a | b |\n|---|---|\n| " + "w" * 40 + "{} | 2 |\n| 3 | 4 |"
    more, less = full + "\n| 5 |", "| a | b |\n|---|---|\n| 1 | 2 |\n| 5 |"
    pairs = [(1, full, full), (2, less, more), (3, "prose", full), (4, full.replace("4", "9"), full), (5, wide.format("x"), wide.format("yz"))]
    rows = s.createDataFrame(pairs, "id int, o string, g string").select("id", T.nfc("o").alias("o"), T.nfc("g").alias("g"))
    return rows.select("id", F.round(T.teds(F.col("o"), F.col("g")), 6).alias("teds"))


def _blocks_of(s: SparkSession, pages: dict[str, list[str]]) -> DataFrame:
    return s.createDataFrame([(p, i, t, "TableItem" if t.startswith("|") else "TextItem") for p, ts in pages.items() for i, t in enumerate(ts)], "page_id string, block_no int, text string, kind string")


@case("j8_matched_case", "page_id, pos, gold_no", "('p', 0, 1)", "('p', 1, 0)", "('p', 3, 2)", "('p', 4, 2)", "('q', 0, 0)")
def _(s):
    """Longer than 40 letters: the first 40 count; a short block meets those that begin with it, also on one side only; white space is squeezed."""
    long = "the quick brown fox jumps over the lazy dog"
    out = _blocks_of(s, {"p": ["Beta  one", "alpha", "zeta", long + " again", long[:40]], "q": ["x"], "r": ["alpha"]})
    gold = _blocks_of(s, {"p": ["alpha and more", "beta two".replace("b", "B")[:4], long + " twice", "zz"], "q": ["xyz", "x"]})
    return parsing.ranks(out, gold)


@case("z8_order_case", "page_id, tau", "('p', 1.0)", "('q', -1.0)", "('r', 0.333333)", "('s', NULL)")
def _(s):
    gold = ["alpha", "beta", "gamma", "delta"]
    out = {"p": gold, "q": gold[::-1], "r": ["beta", "alpha", "delta", "gamma"], "s": ["beta"]}
    return parsing.reading_order(parsing.ranks(_blocks_of(s, out), _blocks_of(s, {p: gold for p in out}))).select("page_id", F.round("tau", 6).alias("tau"))


@case("z9_scores_case", "page_id, text, teds, tau, blocks", "('p', 1.0, 1.0, 1.0, 2)", "('q', 0.0, NULL, NULL, 0)", "('r', 0.692308, 0.0, NULL, 1)")
def _(s):
    table = "| a |\n|---|\n| 1 |"
    gold = s.createDataFrame([("p", "One\n\n" + table), ("q", "Two"), ("r", "Six\n\n| a |\n|-|")], "page_id string, text string")
    out = _blocks_of(s, {"p": ["One", table], "r": ["Six | a |"]})
    return parsing.score_pages(out, gold).select("page_id", F.round("text", 6).alias("text"), F.round("teds", 6).alias("teds"), "tau", "blocks")


@case("a7_means_case", "converter, pages, text, teds", "('m', 3, 0.5, 0.333)", "('n', 1, NULL, 1.0)")
def _(s):
    rows = [("m", 0.25, 0.333), ("m", 0.75, None), ("m", None, None), ("n", None, 1.0)]
    return parsing.means(s.createDataFrame(rows, "converter string, text double, teds double"), "converter", ["text", "teds"])


@case("a6_gold_numbers_case", "pages, schemes, with_tables, hindi", "(3, 2, 1, 2)")
def _(s):
    rows = [("a", 1, "s", "hi", True, "", "", ""), ("a", 2, "s", "en", False, "", "", ""), ("b", 1, "t", "hi", None, "", "", "")]
    return corpus.gold_numbers(s.createDataFrame(rows, schemas.GOLD_PAGE))


@case("s12_gold_keys_case", "page_id", "('a-p1')", "('a-p12')")
def _(s):
    rows = [("a", 1, "s", "hi", True, "", "", ""), ("a", 12, "s", "en", False, "", "", "")]
    return readers.gold_keys(s.createDataFrame(rows, schemas.GOLD_PAGE)).select("page_id")


@case("s1_page_blocks_case", "document_id, seq, text, page", "('d', 1, 'ab', 1)", "('d', 3, 'c', 3)")
def _(s):
    return readers.page_blocks(s.createDataFrame([("d", 1, " a\0b\n"), ("d", 2, "\0 "), ("d", 3, "c")], "document_id string, page int, text string")).select("document_id", "seq", "text", "page")


@case("s4_tree_case", "text, page, kind", "('Head', 1, 'SectionHeaderItem')", "('|r|', 3, 'TableItem')")
def _(s):
    tree = [("d", [([("lib.SectionHeader", 0, " Head\0 "), ("lib.Line", 0, "no")],), ([("Table", 2, "|r|"), ("Text", 2, " ")],)])]
    return readers.tree_blocks(s.createDataFrame(tree, "document_id string, pages array<struct<children:array<struct<block_type:string,page_id:int,text:string>>>>")).select("text", "page", "kind")


@case("s25_content_list_case", "document_id, seq, text, page, kind, level", "('d', 0, 'Levy', 1, 'SectionHeaderItem', 2)", "('d', 2, '| a |' || chr(10) || '|---|', 4, 'TableItem', 0)")
def _(s):
    """The first list by path that parses and is no v2; entries that are no objects, and those without a page, are left out."""
    good = '[{"type": "text", "text": " Levy ", "text_level": 2, "page_idx": 0}, 7, {"type": "table", "table_body": "<tr><td>a</td></tr>", "page_idx": 3}, {"type": "text", "text": "lost"}, {"type": "image", "page_idx": 1}]'
    files = [("d", "o/a_v2_content_list.json", "[]"), ("d", "o/b_content_list.json", "{"), ("d", "o/c_content_list.json", good), ("d", "o/d_content_list.json", "[]"), ("e", "o/x.json", good)]
    rows = readers.content_list_rows(s.createDataFrame(files, "document_id string, path string, content string"))
    return readers.content_list_blocks(readers.parsed_content_list(rows)).select("document_id", "seq", "text", "page", "kind", F.coalesce("level", F.lit(0)).alias("level"))


@case("s7_item_case", "text, page, kind", "('| md |', 3, 'TableItem')", "('x', 1, 'TextItem')")
def _(s):
    items = [("d", 0, "TableItem", " ", [(0,), (3,)], "| md |"), ("d", 1, "TextItem", "x", [(1,), (2,)], None), ("d", 2, "TextItem", "gone", [(0,)], None), ("d", 3, "TextItem", None, [(1,)], " ")]
    return readers.converted("docling", s.createDataFrame(items, "document_id string, seq int, class string, text string, prov array<struct<page_no:int>>, md string")).select("text", "page", "kind")


@case("s24_glyphs_case", "text, glyphs", "('ab', 2)", "('c', 0)")
def _(s):
    return readers.without_glyphs(s.createDataFrame([("\0a\0b",), ("c",), ("\0",)], "text string")).select("text", F.col("glyphs").cast("bigint").alias("glyphs"))


@case("s16_links_case", "page_url, pos, url", "('https://h.example/d/p.html', 0, 'https://h.example/d/a/b.PDF')", "('https://h.example/d/p.html', 3, 'https://h.example/c.pdf?x=1')")
def _(s):
    html = "<a href='a/b.PDF#page=2'>x</a><a HREF=\"mailto:x@y.pdf\">m</a><a href=\"/c.html\">h</a><a href=\"../c.pdf?x=1\">b</a>"
    return corpus.links(s.createDataFrame([("https://h.example/d/p.html", html)], "url string, html string"))


@case("s23_crawl_case", "scheme, url, status, bytes", "('a', 'https://h.example/1.pdf', 'pdf', 10)", "('a', 'https://h.example/2.pdf', 'http 404', NULL)", "('b', 'https://h.example/3.pdf', 'unreachable', NULL)")
def _(s):
    seeds = s.createDataFrame([("a", "https://h.example/a", 0), ("b", "https://h.example/b", 0), ("b", "https://h.example/off", 1)], "scheme string, page_url string, page_no int")
    pages = [("https://h.example/a", 200, "<a href='1.pdf'><a href='2.pdf#p'><a href='1.pdf'>"), ("https://h.example/b", 200, "<a href='2.pdf'><a href='3.pdf'>"), ("https://h.example/off", 500, "<a href='4.pdf'>")]
    probes = [("https://h.example/1.pdf", 200, "%PDF-1", "x", 10), ("https://h.example/2.pdf", 404, "", "", None)]
    return corpus.crawl(seeds, s.createDataFrame(pages, "url string, status int, html string"), s.createDataFrame(probes, "url string, status int, head string, content_type string, bytes long"))


@case("s22_fetched_case", "id, status, bytes, pages, has_text_layer, text_page_ratio, retrieved, published, sha", "('a', 'cached', 5, 3, 'true', 0.667, '2025-01-02', '2024-05-06', '071ba51d')", "('b', 'fetched', 4, 1, 'false', 0.0, '2026-03-04', '2020-01-01', '315d429b')", "('c', 'http 404', -1, -1, '-', NULL, NULL, NULL, NULL)", "('d', 'unreachable', -1, -1, '-', NULL, NULL, NULL, NULL)", "('e', 'not a pdf: text/html', -1, -1, '-', NULL, NULL, NULL, NULL)")
def _(s):
    entries = s.createDataFrame([(i, f"u{i}", p) for i, p in zip("abcde", [None, "2020-01-01", None, None, None])], "id string, url string, published string")
    page = "x" * 41
    files = s.createDataFrame([("a", b"%PDF1", "2025-07-07", [page, page, "y"], "D:20240506120000")], "id string, content binary, modified string, texts array<string>, creation_date string")
    answers = [("ub", 200, "application/PDF", b"%PDF", ["short"], None), ("uc", 404, "", b"", None, None), ("ud", None, None, None, None, None), ("ue", 200, "text/html", b"<html", None, None)]
    responses = s.createDataFrame(answers, "url string, status int, content_type string, content binary, texts array<string>, creation_date string")
    rows = corpus.fetched(entries, files, responses, s.createDataFrame([("a", "2025-01-02")], "id string, retrieved string"), "2026-03-04")
    return rows.withColumn("has_text_layer", F.coalesce(F.col("has_text_layer").cast("string"), F.lit("-"))).select("id", "status", F.coalesce("bytes", F.lit(-1)).alias("bytes"), F.coalesce("pages", F.lit(-1)).alias("pages"), "has_text_layer", "text_page_ratio", "retrieved", "published", F.substring("sha256", 1, 8).alias("sha"))


@case("pred8_missing_case", "id", "('gone')", "('failed')")
def _(s):
    manifest = s.createDataFrame([(1, "ok", "h"), (2, "failed", None), (3, "ok", None)], "line_no long, id string, sha256 string")
    return corpus.missing_ids(s.createDataFrame([("ok",), ("gone",), ("failed",), ("gone",)], "id string"), manifest)


@case("j1_index_case", "ordinal, page, text", "(0, 4, 'kept')")
def _(s):
    """A vector of another model, one of another run and one whose chunk is gone have no row."""
    vectors = s.createDataFrame([("r", "d", 0, "m", [1.0]), ("r", "d", 9, "m", [1.0]), ("r", "d", 0, "n", [1.0]), ("q", "d", 0, "m", [1.0])], "run_id string, document_id string, ordinal int, model string, vector array<float>")
    chunks = s.createDataFrame([("r", "d", 0, 4, 5, "kept"), ("r", "d", 1, 6, 6, "bare"), ("q", "d", 0, 1, 1, "other")], "run_id string, document_id string, ordinal int, page int, end_page int, text string")
    return retrieval.index_vectors(vectors, chunks, "r", "m").select("ordinal", "page", "text")


@case("a13_disagreeing_case", "probes, disagreeing, overlap", "(3, 2, 1.0)")
def _(s):
    arm = lambda rows: s.createDataFrame(rows, "query_id string, doc string, rank int")
    first = arm([("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1), ("q2", "b", 2), ("q3", "z", 1)])
    second = arm([("q1", "a", 1), ("q1", "c", 2), ("q2", "b", 1), ("q2", "a", 2)])
    return retrieval.disagreeing(retrieval.compare(first, second, ["doc"]))


@case("j14_annotated_case", "question_id, mine, theirs, question", "('q1', 'yes', 'no', 'one')", "('q3', 'no', 'no', 'three')")
def _(s):
    sample = s.createDataFrame([("q3", "three"), ("q1", "one"), ("q2", "two")], "id string, question string")
    notes = s.createDataFrame([("q1", "yes", "no"), ("q3", "no", "no"), ("q9", "yes", "yes")], "question_id string, mine string, theirs string")
    return evaluation.annotated_sample(sample, notes, "question")


@case("r10_failures_case", "question_id", "('q1')", "('q4')")
def _(s):
    rows = [("q4", False), ("q2", True), ("q7", False), ("q1", False)]
    return evaluation.first_failures(s.createDataFrame(rows, "question_id string, supported boolean"), 2).select("question_id")


@case("j16_translated_case", "id, language_tag, question, gold_answer", "('a', 'hi', 'x?', 'y')", "('b', 'en', 'q', 'g')")
def _(s):
    questions = s.createDataFrame([("a", "en", "q", "g"), ("b", "en", "q", "g")], "id string, language_tag string, question string, gold_answer string")
    return evaluation.translate(questions, s.createDataFrame([("a", "hi", "x?", "y"), ("z", "hi", "", "")], questions.schema))


@case("s27_groups_case", "question, question_type", "('w', 'factual')", "('v', 'exclusion')", "('u', 'exclusion')")
def _(s):
    return evaluation.union_groups({"factual": s.createDataFrame([("w",)], "question string"), "exclusion": s.createDataFrame([("v",), ("u",)], "question string")})


@case("f25_context_case", "query_id, context", "('q', '[b, page 2]' || chr(10) || 'two' || chr(10) || chr(10) || '[a, page 1]' || chr(10) || 'on')")
def _(s):
    hits = s.createDataFrame([("q", "a", 0, 2), ("q", "b", 1, 1)], "query_id string, document_id string, ordinal int, rank int")
    chunks = s.createDataFrame([("a", 0, 1, "on"), ("b", 1, 2, "two")], "document_id string, ordinal int, page int, text string")
    return retrieval.context(hits, chunks, 3)


@case("f29_usage_case", "id, tokens_in, tokens_out", "(1, 2, 195)", "(2, 5, 7)", "(3, 4, 6)", "(4, -1, -1)")
def _(s):
    bodies = [(1, '{"usage": {"prompt_tokens": 2, "completion_tokens": 9, "total_tokens": 197}}'), (2, '{"usage": {"prompt_tokens": 5, "completion_tokens": 7}}'), (3, '{"usage": {"prompt_tokens": 4, "total_tokens": 10}}'), (4, "{}")]
    return s.createDataFrame(bodies, "id int, body string").select("id", T.usage_tokens(F.col("body")).alias("u")).select("id", F.coalesce("u.tokens_in", F.lit(-1)).alias("tokens_in"), F.coalesce("u.tokens_out", F.lit(-1)).alias("tokens_out"))


@case("f30_retry_case", "id, seconds", "(1, 7.0)", "(2, 48.0)", "(3, 0.607)", "(4, NULL)", "(5, 12.5)")
def _(s):
    rows = [(1, "7", ""), (2, "soon", '[{"error": {"details": [{"@type": "x/RetryInfo", "retryDelay": "48s"}]}}]'), (3, "", '{"error": {"message": "Please retry in 607ms."}}'), (4, "", '{"error": "busy"}'), (5, None, '{"error": {"message": "Retry in 12.5s"}}')]
    return s.createDataFrame(rows, "id int, header string, body string").select("id", T.retry_delay(F.col("header"), F.col("body")).alias("seconds"))


@case("f31_cost_case", "id, cost", "(1, 0.0035)", "(2, NULL)")
def _(s):
    rows = s.createDataFrame([(1, 1000, 500, 2.0, 3.0), (2, 1000, 500, None, 3.0)], "id int, i long, o long, pi double, po double")
    return rows.select("id", F.round(T.cost(F.col("i"), F.col("o"), F.col("pi"), F.col("po")), 9).alias("cost"))


@case("f32_mock_case", "id, text, tokens_in, tokens_out", "(1, 'mock reply: two  words', 2, 4)", "(2, 'mock reply: ', 0, 2)")
def _(s):
    talks = s.createDataFrame([(1, [("user", "one"), ("assistant", "x"), ("user", "two  words"), ("assistant", "y")]), (2, [("system", "s")])], "id int, messages array<struct<role:string,content:string>>")
    return talks.select("id", T.mock_reply(F.col("messages")).alias("r")).select("id", "r.*")


@case("s19_providers_case", "name, default_model, input_price_per_1m, usage_parser", "('mock', NULL, NULL, 'default')", "('p', 'm', 2.0, 'total_aware')")
def _(s):
    entry = {"base_url": "u", "api_key_env": "K", "default_model": "m", "reset_window": "day", "last_verified": "2026-01-01", "input_price_per_1m": 2, "usage_parser": "total_aware"}
    return readers.providers(s, {"p": entry}).select("name", "default_model", "input_price_per_1m", "usage_parser")


@case("s10_sources_case", "scheme, id, url, kind", "('s', 'a', 'u', 'faq')", "('t', 'b', 'v', NULL)")
def _(s):
    return readers.sources(s, {"s": {"documents": [{"id": "a", "url": "u", "kind": "faq"}]}, "t": {"documents": [{"id": "b", "url": "v"}]}}).select("scheme", "id", "url", "kind")


@case("k5_cache_key_case", "key", "('doc.pypdf-5.ba7816bf8f01cfea.json')")
def _(s):
    return s.createDataFrame([("doc", "abc")], "stem string, content string").select(store.cache_key("stem", "pypdf", "5", "content").alias("key"))


@case("k10_status_case", "json", """('[{"label":"a","value":"1","source":"x"},{"label":"b","value":"2","source":"y"}]')""")
def _(s):
    return corpus.status_document(s.createDataFrame([("b", "2", "y"), ("a", "1", "x")], "label string, value string, source string"))


def _folder(s: SparkSession) -> str:
    """A new folder in the shared folder of the session (its checkpoints, else its warehouse), deleted when the application ends."""
    base = s.conf.get("spark.checkpoint.dir", None) or s.conf.get("spark.sql.warehouse.dir")
    path = s._jvm.org.apache.hadoop.fs.Path(f"{base}/cases-{uuid.uuid4().hex}")
    path.getFileSystem(s._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _lines(s: SparkSession, *lines: str) -> str:
    """The folder of one text file with these lines."""
    folder = f"{_folder(s)}/text"
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


@case("k1_run_case", "run_id, splitter", "('q', 'fixed')", "('r', 'section')")
def _(s):
    """A run that is started again replaces its row."""
    run = lambda r, splitter: s.createDataFrame([(r, "h", "pypdf", splitter, "none", "none", datetime(2026, 1, 1))], schemas.RUN)
    held = store.Store(s, _folder(s))
    for row in (run("r", "fixed"), run("q", "fixed"), run("r", "section")):
        held.start_run(row)
    return held.runs().select("run_id", "splitter")


@case("k3_replaced_case", "document_id, ordinal, text", "('a', 0, 'new')", "('c', 0, 'c0')", "('c', 1, 'c1')")
def _(s):
    """A document is replaced by fewer chunks, another by none; the rest stays."""
    held = store.Store(s, _folder(s))
    docs = lambda *ids: s.createDataFrame([("r", i) for i in ids], "run_id string, document_id string")
    chunks = lambda *rows: s.createDataFrame([("r", d, i, t, 1, 1, [], None, None, None) for d, i, t in rows], schemas.CHUNK)
    held.replace_documents(docs("a", "b", "c"), chunks(("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("c", 0, "c0"), ("c", 1, "c1")))
    held.replace_documents(docs("a", "b"), chunks(("a", 0, "new")))
    return held.chunks().select("document_id", "ordinal", "text")


@case("k4_embeddings_case", "ordinal, model, first", "(0, 'm', 3.0)", "(0, 'n', 2.0)", "(1, 'm', 4.0)")
def _(s):
    held = store.Store(s, _folder(s))
    rows = lambda *vs: s.createDataFrame([("r", "a", i, m, "h", [x]) for i, m, x in vs], "run_id string, document_id string, ordinal int, model string, text_hash string, vector array<float>")
    held.upsert_embeddings(rows((0, "m", 1.0), (0, "n", 2.0)))
    held.upsert_embeddings(rows((0, "m", 3.0), (1, "m", 4.0)))
    return held.embeddings().select("ordinal", "model", F.get("vector", F.lit(0)).cast("double").alias("first"))


@case("k5_block_cache_case", "document_id, seq, text, page", "('d', 0, 'one', 1)", "('d', 1, 'two', 2)", "('e', 0, 'x', 1)")
def _(s):
    """Blocks written as one JSON document each (K5) and read again."""
    folder = f"{_folder(s)}/cache"
    store.write_blocks(s.createDataFrame([("d", 1, "two", 2, None, None), ("d", 0, "one", 1, "TextItem", None), ("e", 0, "x", 1, None, 3)], schemas.BLOCK), folder)
    return readers.cached_blocks(s, folder).select("document_id", "seq", "text", "page")


@case("k6_json_lines_case", "value", """('{"k":"a","n":1,"x":"t"}')""", """('{"k":"b","n":2,"x":null}')""")
def _(s):
    folder = f"{_folder(s)}/lines"
    store.write_json_lines(s.createDataFrame([("t", "a", 1), (None, "b", 2)], "x string, k string, n int"), folder, ["k"])
    return s.read.text(folder)


@case("k8_tsv_case", "value", "('k' || chr(9) || 'n')", "('a' || chr(9) || '1')")
def _(s):
    folder = f"{_folder(s)}/tsv"
    store.write_tsv(s.createDataFrame([("a", 1)], "k string, n int").coalesce(1), folder)
    return s.read.text(folder)


@case("k9_appended_case", "k, n", "('a', 1)", "('a', 1)", "('b', 2)")
def _(s):
    folder = f"{_folder(s)}/log"
    for rows in ([("a", 1)], [("a", 1), ("b", 2)]):
        store.append_json(s.createDataFrame(rows, "k string, n int"), folder)
    return readers.json_lines(s, folder, "k string, n int")


@case("s9_prior_manifest_case", "id, retrieved", "('a', '2026-01-01')", "('b', '2026-01-02')")
def _(s):
    """Malformed and blank lines are passed over."""
    folder = _lines(s, '{"id": "a", "retrieved": "2026-01-01"}', '{"id": "x", ', "", '{"id": "b", "retrieved": "2026-01-02"}')
    return readers.json_lines(s, folder, "id string, retrieved string", strict=False).where("id IS NOT NULL")


@case("s11_eval_set_case", "id, question_type", "('a', 'factual')", "('b', 'exclusion')")
def _(s):
    folder = _lines(s, '{"id": "a", "question": "q", "gold_answer": "g", "question_type": "factual"}', "  ", '{"id": "b", "question": "q", "gold_answer": "g", "question_type": "exclusion"}')
    return readers.eval_set(s, f"{folder}/*.txt", schemas.QUESTION).select("id", "question_type")


@case("s13_gold_text_case", "text", "('one' || chr(10) || 'two' || chr(10))")
def _(s):
    return readers.gold_texts(s, f"{_lines(s, 'one', 'two')}/*.txt").select("text")


@case("s18_last_line_case", "question_id, theirs", "('q', 'no')", "('r', 'yes')")
def _(s):
    rows = [("q", "yes", 1), ("r", "yes", 2), ("q", "no", 3)]
    return readers.last_by_line(s.createDataFrame(rows, "question_id string, theirs string, line int"), "question_id", "line").select("question_id", "theirs")


@case("s20_lines_case", "line_no, line", "(1, 'a')", "(2, '')", "(3, 'b')")
def _(s):
    """Files of another suffix are left out."""
    folder = _lines(s, "a", "", "b")
    return readers.numbered_lines(s, f"{folder}/*", readers.TEXT_SUFFIXES, ("_SUCCESS",)).select("line_no", "line")


@case("s17_probe_case", "id, status", "(1, 'pdf')", "(2, 'http 404')", "(3, 'not a pdf: text/html')", "(4, 'not a pdf: unknown')")
def _(s):
    rows = [(1, 200, "%PDF-1.7", "x"), (2, 404, "%PDF", ""), (3, 200, "<html", "text/html"), (4, 200, "PK", "")]
    answers = s.createDataFrame(rows, "id int, status int, head string, content_type string")
    return answers.select("id", corpus.probe_status(F.col("status"), F.col("head"), F.col("content_type")).alias("status"))


@case("pred6_fetch_status_case", "id, status", "(1, 'not a pdf: text/html')", "(2, 'fetched')", "(3, 'fetched')", "(4, 'http 500')", "(5, 'unreachable')", "(6, 'cached')", "(7, 'not a pdf: unknown content-type')")
def _(s):
    rows = [(1, False, 200, "text/html", "<htm"), (2, False, 200, "application/PDF", "x"), (3, False, 200, "", "%PDF"), (4, False, 500, "application/pdf", "%PDF"), (5, False, None, None, None), (6, True, None, None, None), (7, False, 200, None, "PK")]
    answers = s.createDataFrame(rows, "id int, cached boolean, status int, content_type string, head string")
    return answers.select("id", corpus.fetch_status(F.col("cached"), F.col("status"), F.col("content_type"), F.col("head")).alias("status"))
