"""The engine's queries over the driver's tables, with the SQL that gives the same rows. Keys are <SURVEY id>_<slug>; those on inline tables are in cases.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.functions import text as T
from pothi.operators import chunking, corpus, evaluation, parsing, retrieval
from pothi.plans import cases
from pothi.sources.readers import table, text_blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Parts that several of the SQL texts share.
_ONCE = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY run_id, document_id, ordinal ORDER BY written DESC) = 1)"
_NOW = "m AS (SELECT * FROM manifest WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)"
_ASKED = "q AS (SELECT DISTINCT * FROM questions)"
_BLOCKS = r"""b AS (SELECT doc_id AS document_id, seq, line AS text, CAST(floor(seq / 5) AS INT) + 1 AS page
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS seq FROM documents WHERE text IS NOT NULL))"""
_TRIM = r"regexp_replace({}, '^[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{0b}}]+|[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{0b}}]+$', '', 'g')"
_SPACES = r"'[\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+'"
_TOKEN = r"[0-9]+(?:[/\-][0-9]+)*|[\p{L}\p{Nl}\p{No}]+(?:-[\p{L}\p{Nl}\p{No}]+)*"
_CLAIMS = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({}, '\p{{Nd}}[\p{{Nd}},.]*\p{{Nd}}|\p{{Nd}}'), lambda x: regexp_replace(replace(x, ',', ''), '\.+$', '')), lambda x: length(x) >= 3)))"
_GAP = r"regexp_replace(regexp_replace({}, '(\p{{Nd}})[\s,]+([\p{{Nd}}.])', '\1\2', 'g'), '(\p{{Nd}})[\s,]+([\p{{Nd}}.])', '\1\2', 'g')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _chunks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each chunk once, with the columns asked for (all by default)."""
    return retrieval.once(table(s, d, "chunks"), list(columns) or None)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return corpus.current(table(s, d, "manifest"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions").distinct()


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return text_blocks(table(s, d, "documents"))


@query("s14_chunk_scan", f"WITH {_ONCE} SELECT run_id, document_id, ordinal, page, end_page, length(text) AS chars FROM c")
def _(s, d):
    return _chunks(s, d).select("run_id", "document_id", "ordinal", "page", "end_page", F.length("text").alias("chars"))


@query("s8_usable_manifest", "SELECT id, scheme, kind, pages, sha256 FROM manifest WHERE id IS NOT NULL AND sha256 IS NOT NULL AND sha256 <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1")
def _(s, d):
    return corpus.usable(table(s, d, "manifest")).select("id", "scheme", "kind", "pages", "sha256")


@query("s15_page_text", f"WITH {_ONCE} SELECT document_id, page, string_agg(text, ' ' ORDER BY ordinal) AS text FROM c GROUP BY document_id, page")
def _(s, d):
    return evaluation.page_text(_chunks(s, d))


@query("a19_known_pages", "SELECT DISTINCT document_id, page FROM chunks")
def _(s, d):
    return evaluation.known_pages(table(s, d, "chunks"))


@query("s3_routed", f"WITH {_NOW} SELECT document_id, CASE WHEN coalesce(has_text_layer, false) THEN 'text' ELSE 'ocr' END AS route FROM (SELECT DISTINCT document_id FROM chunks) LEFT JOIN m ON id = document_id")
def _(s, d):
    return corpus.routed(table(s, d, "chunks").select("document_id").distinct(), _manifest(s, d))


@query("a17_glyph_totals", f"WITH {_ONCE} SELECT document_id, CAST(sum(len(regexp_extract_all(text, '\\x00'))) AS BIGINT) AS glyphs FROM c GROUP BY document_id")
def _(s, d):
    return corpus.glyph_totals(_chunks(s, d), ["document_id"])


@query("f2_dehyphenated", "WITH " + _ONCE + " SELECT chunk_id, " + _TRIM.format(r"regexp_replace(text, '([\p{L}\p{N}_])-[ \t\n\x0b\f\r]*\n[ \t\n\x0b\f\r]*([a-z\x{0900}-\x{097F}])', '\1\2', 'g')") + " AS text FROM c")
def _(s, d):
    return _chunks(s, d).select("chunk_id", T.dehyphenate(F.col("text")).alias("text"))


@query("f3_tokens", f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)), ' ') AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


_SQUEEZE = lambda x: _TRIM.format(f"regexp_replace(nfc_normalize({x}), {_SPACES}, ' ', 'g')")
# The edit distance by code points (DuckDB's own counts bytes): rows of the table as lists.
_EDITS = """list_reduce(list_transform(o, lambda x: [x]), lambda r, x: list_transform(list_reduce(list_transform(range(1, len(g) + 1), lambda j: [j]),
    lambda acc, j: list_append(acc, least(acc[len(acc)] + 1, CAST(r[j[1] + 1] AS BIGINT) + 1, CAST(r[j[1]] AS BIGINT) + CASE WHEN g[j[1]] = x[1] THEN 0 ELSE 1 END)), [CAST(r[1] AS BIGINT) + 1]), lambda v: CAST(v AS VARCHAR)),
    list_transform(range(0, len(g) + 1), lambda v: CAST(v AS VARCHAR)))[len(g) + 1]"""


@query("f6_text_similarity", f"""WITH {_ASKED}, t AS (SELECT id, {_SQUEEZE("question")} AS a, {_SQUEEZE("gold_answer")} AS b FROM q),
    c AS (SELECT id, regexp_extract_all(a, '(?s).') AS o, regexp_extract_all(b, '(?s).') AS g FROM t), e AS (SELECT id, o, g, CAST({_EDITS} AS INT) AS edits FROM c)
    SELECT id, round(CASE WHEN len(g) = 0 THEN CASE WHEN len(o) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - edits / len(g) END, 6) AS similarity, CAST(edits AS BIGINT) AS edits FROM e""")
def _(s, d):
    """Over whole texts, normalised, by code points."""
    rows = _questions(s, d).select("id", T.normalize(F.col("question")).alias("o"), T.normalize(F.col("gold_answer")).alias("g"))
    return rows.select("id", F.round(T.similarity_of_normal(F.col("o"), F.col("g")), 6).alias("similarity"), F.levenshtein("o", "g").cast("bigint").alias("edits"))


_TABLES = rf"""l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(nfc_normalize(text), '\r\n|[\n\r\x{{0b}}\x{{0c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_TRIM.format("x")}), lambda x: starts_with(x, '|')) AS ls FROM documents),
    w AS (SELECT doc_id, list_transform(list_filter(ls, lambda x, i: i <> 2), lambda x: list_transform(string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|'), lambda y: {_SQUEEZE("replace(y, '<br>', ' ')")})) AS rs
          FROM l WHERE len(ls) >= 2 AND regexp_full_match(ls[2], '\|(\s*:?-+:?\s*\|)+'))"""


@query("f8_tables", f"""WITH {_TABLES} SELECT doc_id, CAST(len(rs[1]) AS INT) AS columns, CAST(len(rs) - 1 AS INT) AS rows,
    '| ' || array_to_string(rs[1], ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(rs[1])) || array_to_string(list_transform(rs[2:], lambda r: chr(10) || '| ' || array_to_string(r, ' | ') || ' |'), '') AS markdown FROM w""")
def _(s, d):
    t = T.parse_markdown_table(F.col("text"))
    rows = table(s, d, "documents").select("doc_id", t.alias("t")).where(F.col("t").isNotNull())
    return rows.select("doc_id", F.size("t.header").alias("columns"), F.size("t.rows").alias("rows"), T.render_table(F.col("t")).alias("markdown"))


@query("f13_teds", f"""WITH {_TABLES}, n AS (SELECT doc_id, 1 + len(rs) + list_sum(list_transform(rs, lambda r: len(r))) AS whole, 1 + len(rs[len(rs)]) AS lost FROM w WHERE len(rs) >= 2)
    SELECT doc_id, round(1 - lost / whole, 6) AS teds FROM n""")
def _(s, d):
    """Each document's table against itself without its last row."""
    t = T.parse_markdown_table(F.col("text"))
    rows = table(s, d, "documents").select("doc_id", t.alias("t")).where(F.size("t.rows") >= 1)
    lost = F.struct(F.col("t.header").alias("header"), F.slice("t.rows", F.lit(1), F.size("t.rows") - 1).alias("rows"))
    return rows.select("doc_id", F.round(T.teds_of_tables(lost, F.col("t")), 6).alias("teds"))


@query("f14_claim_tokens", f"WITH {_ASKED} SELECT id, array_to_string({_CLAIMS.format('gold_answer')}, ' ') AS claims FROM q")
def _(s, d):
    return _questions(s, d).select("id", F.array_join(T.claim_tokens(F.col("gold_answer")), " ").alias("claims"))


@query("f15_closed_gaps", "SELECT doc_id, " + _GAP.format("text") + " AS text FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.close_digit_gaps(F.col("text")).alias("text"))


_SUPPORT = f"""WITH {_ONCE}, {_ASKED},
    t AS (SELECT document_id, page, string_agg(text, ' ' ORDER BY ordinal) AS text FROM c GROUP BY document_id, page),
    g AS (SELECT id, unnest(gold_pages) AS p, unnest(range(len(gold_pages))) AS pos FROM q),
    h AS (SELECT g.id, {_GAP.format("string_agg(coalesce(t.text, ''), ' ' ORDER BY pos)")} AS hay FROM g LEFT JOIN t ON t.document_id = g.p.document_id AND t.page = g.p.page GROUP BY g.id),
    k AS (SELECT id, language_tag, hay, {_CLAIMS.format("gold_answer")} AS claims, coalesce({_CLAIMS.format("question")}, []) AS asked FROM q JOIN h USING (id)),
    r AS (SELECT id AS question_id, language_tag, len(claims) AS claims, list_sort(list_filter(claims, lambda x: NOT list_contains(asked, x) AND NOT contains(hay, x))) AS missing FROM k)"""


@query("f16_citation_support", _SUPPORT + " SELECT question_id, CAST(claims AS INT) AS claims, array_to_string(missing, ' ') AS missing, len(missing) = 0 AS supported FROM r")
def _(s, d):
    rows = evaluation.citation_support(_questions(s, d), _chunks(s, d))
    return rows.select("question_id", "claims", F.array_join(F.array_sort("missing"), " ").alias("missing"), "supported")


@query("a11_support_totals", _SUPPORT + " SELECT language_tag, count(*) AS checked, count(*) FILTER (len(missing) = 0) AS supported, count(*) FILTER (len(missing) > 0) AS failed FROM r WHERE claims > 0 GROUP BY language_tag")
def _(s, d):
    return evaluation.support_totals(evaluation.citation_support(_questions(s, d), _chunks(s, d)))


@query("f17_citations", f"WITH {_ONCE} SELECT chunk_id, document_id || CASE WHEN end_page > page THEN ', pages ' || page || ' to ' || end_page ELSE ', page ' || page END AS citation FROM c")
def _(s, d):
    return _chunks(s, d).select("chunk_id", T.citation(F.col("document_id"), F.col("page"), F.col("end_page")).alias("citation"))


@query("f26_snippets", f"WITH {_ONCE} SELECT chunk_id, left(" + _TRIM.format(r"regexp_replace(text, '[\s\p{{Z}}\x{{0b}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g')".replace("{{", "{").replace("}}", "}")) + ", 150) AS snippet FROM c")
def _(s, d):
    return _chunks(s, d).select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


@query("f21_published", r"SELECT line_no, CASE WHEN length(x) >= 8 THEN left(x, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2) END AS published FROM (SELECT line_no, regexp_replace(published, '[^0-9]', '', 'g') AS x FROM manifest)")
def _(s, d):
    return table(s, d, "manifest").select("line_no", T.published_date(F.col("published")).alias("published"))


@query("f32_word_counts", r"SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE len(regexp_extract_all(text, '[^\s\p{Z}\x{0b}\x{85}\x{1c}-\x{1f}]+')) END AS words FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("f28_scan", r"""WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
    h AS (SELECT path, line_no, 'dash' AS rule, '' AS shown FROM l WHERE regexp_matches(line, '[\x{2013}\x{2014}]')
      UNION ALL SELECT path, line_no, 'emoji', '' FROM l WHERE regexp_matches(regexp_replace(line, '[\x{00}-\x{2100}]', '', 'g'), '\p{So}')
      UNION ALL SELECT path, line_no, 'absolute', lower(regexp_extract(line, '(?i)\b(?:solves|blocks|prevents)\b')) FROM l WHERE regexp_matches(line, '(?i)\b(?:solves|blocks|prevents)\b'))
    SELECT path, CAST(line_no AS INT) AS line_no, rule, shown FROM h""")
def _(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return corpus.scan_lines(rows)


@query("f23_enriched", f"WITH {_ONCE}, {_NOW} SELECT chunk_id, m.scheme, m.kind AS doc_kind FROM c LEFT JOIN m ON id = document_id")
def _(s, d):
    return chunking.enrich(_chunks(s, d), _manifest(s, d)).select("chunk_id", "scheme", "doc_kind")


@query("p3_chunk_violations", f"WITH {_ONCE} SELECT chunk_id FROM c WHERE page IS NULL OR page < 1 OR end_page < page OR text IS NULL OR trim(text) = ''")
def _(s, d):
    return chunking.violations(_chunks(s, d)).select("chunk_id")


@query("a14_ingest_summary", f"WITH {_ONCE} SELECT document_id, count(*) AS chunks, min(page) AS first_page, max(end_page) AS last_page, CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_chars FROM c GROUP BY document_id")
def _(s, d):
    return chunking.summary(_chunks(s, d))


@query("f22_text_layer", f"""WITH {_ONCE}, t AS (SELECT document_id, page, string_agg(text, ' ' ORDER BY ordinal) AS text FROM c GROUP BY document_id, page)
    SELECT document_id, count(*) AS pages, round(avg(CASE WHEN length({_TRIM.format("text")}) > 40 THEN 1.0::DOUBLE ELSE 0 END), 3) AS text_page_ratio, avg(CASE WHEN length({_TRIM.format("text")}) > 40 THEN 1.0::DOUBLE ELSE 0 END) >= 0.5 AS has_text_layer FROM t GROUP BY document_id""")
def _(s, d):
    return chunking.text_layer(evaluation.page_text(_chunks(s, d)))


_FURNITURE = f"""{_BLOCKS}, p AS (SELECT document_id, count(DISTINCT page) AS pages FROM b GROUP BY document_id HAVING count(DISTINCT page) >= 3),
    l AS (SELECT document_id, {_TRIM.format("text")} AS line, count(DISTINCT page) AS n FROM b GROUP BY ALL),
    f AS (SELECT l.document_id, line, n FROM l JOIN p USING (document_id) WHERE length(line) BETWEEN 1 AND 80 AND n >= greatest(3, floor(pages * 0.6::DOUBLE)))"""


@query("a1_furniture", f"WITH {_FURNITURE} SELECT document_id, line, CAST(n AS INT) AS on_pages FROM f")
def _(s, d):
    return chunking.furniture(_blocks(s, d))


@query("z6_stripped_blocks", f"WITH {_FURNITURE} SELECT document_id, CAST(seq AS INT) AS seq, {_TRIM.format('text')} AS text FROM b WHERE {_TRIM.format('text')} <> '' AND NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = b.document_id AND f.line = {_TRIM.format('b.text')})")
def _(s, d):
    return chunking.strip_furniture(_blocks(s, d)).select("document_id", "seq", "text")


@query("z3_fixed_chunks")
def _(s, d):
    return chunking.split(_blocks(s, d), sections=False).select("document_id", "ordinal", "page", "end_page", F.length("text").alias("chars"))


@query("z4_section_chunks")
def _(s, d):
    return chunking.split(_blocks(s, d), sections=True).select("document_id", "ordinal", "page", "end_page", F.length("text").alias("chars"))


_GOLD = f"""WITH r AS (SELECT doc_id AS page_id, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line, unnest(range(len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')))) AS n FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, {_TRIM.format("line")} = '' AS blank, starts_with({_TRIM.format("line")}, '|') AS t FROM r),
    i AS (SELECT *, sum(CASE WHEN blank OR coalesce(lb OR lt <> t, true) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS island
          FROM (SELECT *, lag(blank) OVER w AS lb, lag(t) OVER w AS lt FROM k WINDOW w AS (PARTITION BY page_id ORDER BY n))),
    g AS (SELECT page_id, island, string_agg(line, chr(10) ORDER BY n) AS text FROM i WHERE NOT blank GROUP BY ALL)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY island) - 1 AS INT) AS block_no, text FROM g"""


@query("z5_gold_blocks", _GOLD)
def _(s, d):
    return parsing.gold_blocks(table(s, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("page_id"), "text"))


@query("z8_reading_order", f"""WITH gb AS ({_GOLD}), n AS (SELECT page_id, block_no, {_SQUEEZE("text")} AS t FROM gb), ou AS (SELECT n.page_id, k.last - n.block_no AS pos, n.t FROM n JOIN (SELECT page_id, max(block_no) AS last FROM n GROUP BY page_id) k USING (page_id)),
    mt AS (SELECT ou.page_id, pos, min(n.block_no) AS r FROM ou JOIN n ON ou.page_id = n.page_id AND (starts_with(ou.t, left(n.t, 40)) OR starts_with(n.t, left(ou.t, 40))) WHERE ou.t <> '' AND n.t <> '' GROUP BY ou.page_id, pos),
    pr AS (SELECT a.page_id, sum(CASE WHEN b.r > a.r THEN 1 ELSE 0 END) AS c, sum(CASE WHEN b.r < a.r THEN 1 ELSE 0 END) AS d FROM mt a JOIN mt b ON a.page_id = b.page_id AND a.pos < b.pos GROUP BY a.page_id)
    SELECT page_id, CASE WHEN coalesce(c, 0) + coalesce(d, 0) > 0 THEN (c - d) / (c + d) END AS tau FROM (SELECT DISTINCT page_id FROM mt) LEFT JOIN pr USING (page_id)""")
def _(s, d):
    """Blocks of each document's text in reverse order against those in order; repeated blocks tie."""
    blocks = parsing.gold_blocks(table(s, d, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("page_id"), "text"))
    last = blocks.groupBy("page_id").agg(F.max("block_no").alias("_l"))
    reverse = blocks.join(last, "page_id").select("page_id", (F.col("_l") - F.col("block_no")).alias("block_no"), "text")
    return parsing.reading_order(parsing.ranks(reverse, blocks))


def _asked(s: SparkSession, d: str, column: str = "question") -> DataFrame:
    """The stated query set: questions whose number is divisible by 100."""
    q = _questions(s, d).where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 100 == 0)
    return q.select(F.col("id").alias("query_id"), F.coalesce(F.col(column), F.lit("")).alias("text")).distinct()


_BM25 = f"""{_ONCE}, tok AS (SELECT document_id, ordinal, list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x)) AS ts FROM c),
    st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tok),
    ix AS (SELECT document_id, ordinal, dl, term, count(*) AS tf FROM (SELECT document_id, ordinal, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM ix GROUP BY term),
    fl AS (SELECT 0.25 * avg(raw) AS f FROM dfs),
    qq AS (SELECT DISTINCT id AS query_id, coalesce(COLUMN, '') AS text FROM questions WHERE CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) % 100 = 0),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x))) AS term FROM qq) GROUP BY ALL),
    sc AS (SELECT query_id, document_id, ordinal, sum(times * CASE WHEN raw < 0 THEN (SELECT f FROM fl) ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT mean FROM st)))) AS score
           FROM ix JOIN qt USING (term) JOIN dfs USING (term) GROUP BY ALL),
    al AS (SELECT query_id, c.document_id, c.ordinal, coalesce(score, 0.0) AS score FROM qq CROSS JOIN c LEFT JOIN sc USING (query_id, document_id, ordinal)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, ordinal) AS rank FROM al)"""


@query("r1_bm25_topk", "WITH " + _BM25.replace("COLUMN", "question") + " SELECT query_id, document_id, ordinal, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 5")
def _(s, d):
    return retrieval.bm25(_chunks(s, d, "text").select("document_id", "ordinal", "text"), _asked(s, d)).select("query_id", "document_id", "ordinal", F.round("score", 5).alias("score"), "rank")


_ARMS = (
    "WITH x AS (WITH " + _BM25.replace("COLUMN", "question") + " SELECT query_id, document_id, ordinal, rank FROM rk WHERE rank <= 5), y AS (WITH "
    + _BM25.replace("COLUMN", "gold_answer") + " SELECT query_id, document_id, ordinal, rank FROM rk WHERE rank <= 5)"
)


def _two_arms(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits for the questions and for their answers, searched together."""
    asked = _asked(s, d).withColumn("arm", F.lit(0)).unionByName(_asked(s, d, "gold_answer").withColumn("arm", F.lit(1)))
    hits = retrieval.bm25(_chunks(s, d, "text").select("document_id", "ordinal", "text"), asked, by=("arm", "query_id"))
    return tuple(hits.where(F.col("arm") == i).drop("arm") for i in (0, 1))


@query("r3_rrf", _ARMS + """, u AS (SELECT *, 0 AS arm FROM x UNION ALL SELECT *, 1 FROM y),
    g AS (SELECT query_id, document_id, ordinal, sum(1 / (60 + rank)) AS score, min(arm * 1000 + rank) AS f FROM u GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f) AS fused_rank FROM g)
    SELECT query_id, document_id, ordinal, round(score, 9) AS score, CAST(fused_rank AS INT) AS fused_rank FROM r WHERE fused_rank <= 5""")
def _(s, d):
    """Reciprocal rank fusion of the hits for a question and for its answer."""
    return retrieval.fuse(list(_two_arms(s, d)), ["document_id", "ordinal"]).select("query_id", "document_id", "ordinal", F.round("score", 9).alias("score"), "fused_rank")


@query("r4_compare", _ARMS + """ SELECT query_id, count(*) FILTER (x.rank IS NOT NULL AND y.rank IS NOT NULL) AS overlap, coalesce(bool_or(x.rank = 1 AND y.rank = 1), false) AS agreed
    FROM x FULL JOIN y USING (query_id, document_id, ordinal) GROUP BY query_id""")
def _(s, d):
    return retrieval.compare(*_two_arms(s, d), ["document_id", "ordinal"])


_DENSE = """v AS (SELECT DISTINCT vec_id, run_id, model, vector FROM chunk_vectors WHERE vector IS NOT NULL AND len(vector) > 0),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS score
          FROM v a JOIN v b ON a.run_id = b.run_id AND a.model = b.model AND len(a.vector) = len(b.vector) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM p WHERE score IS NOT NULL AND NOT isnan(score))"""


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the stated queries: those whose id is divisible by 100."""
    v = table(s, d, "chunk_vectors").select("vec_id", "run_id", "model", "vector")
    return v, v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "run_id", "model", F.col("vector").alias("query"))


@query("r2_dense_topk", f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5")
def _(s, d):
    return retrieval.dense(*_vectors(s, d)).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query("p4_refusals", f"WITH {_DENSE}, q AS (SELECT DISTINCT vec_id AS query_id FROM chunk_vectors WHERE vec_id % 100 = 0), t AS (SELECT query_id, max(score) AS s FROM k GROUP BY query_id) SELECT query_id, round(coalesce(s, 0.0), 5) AS top_score, coalesce(s < 0.8, true) AS refused FROM q LEFT JOIN t USING (query_id)")
def _(s, d):
    asked = table(s, d, "chunk_vectors").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id")).distinct()
    return retrieval.gate(asked, retrieval.dense(*_vectors(s, d), k=1)).select("query_id", F.round("top_score", 5).alias("top_score"), "refused")


_CANON = f"""{_ASKED}, k AS (SELECT id, '{{"difficulty_tag":' || to_json(coalesce(difficulty_tag, '')) || ',"gold_answer":' || to_json(coalesce(gold_answer, '')) || ',"gold_pages":['
    || array_to_string(list_transform(coalesce(gold_pages, []), lambda p: '[' || to_json(p.document_id) || ',' || p.page || ']'), ',') || '],"id":' || to_json(id) || ',"language_tag":' || to_json(coalesce(language_tag, ''))
    || ',"question":' || to_json(coalesce(question, '')) || ',"question_type":' || to_json(coalesce(question_type, '')) || '}}' AS canon FROM q)"""


@query("f19_question_hashes", f"WITH {_CANON} SELECT id, sha256(canon) AS hash FROM k")
def _(s, d):
    return evaluation.question_hashes(_questions(s, d))


@query("a9_content_hash", f"WITH {_CANON} SELECT sha256(string_agg(canon, chr(10) ORDER BY id, canon)) AS content_hash FROM k")
def _(s, d):
    return evaluation.content_hash(_questions(s, d))


@query("a4_type_counts", f"WITH {_ASKED}, t(question_type, floor) AS (VALUES ('factual', 15), ('eligibility_multihop', 15), ('table_lookup', 15), ('exclusion', 15), ('procedural', 15), ('unanswerable', 20)) SELECT t.question_type, t.floor, count(q.id) AS n, count(q.id) >= t.floor AS ok FROM t LEFT JOIN q ON q.question_type = t.question_type GROUP BY t.question_type, t.floor")
def _(s, d):
    return evaluation.type_counts(_questions(s, d))


@query("a10_structural_errors", rf"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY question_type NULLS FIRST, question NULLS FIRST) AS n, coalesce(len(gold_pages), 0) AS cites FROM questions),
    e AS (SELECT id, unnest([
        CASE WHEN n > 1 THEN 'duplicate id' END,
        CASE WHEN coalesce(question_type NOT IN ('factual', 'exclusion', 'eligibility_multihop', 'procedural', 'table_lookup', 'unanswerable'), true) THEN 'unknown question_type' END,
        CASE WHEN coalesce(language_tag NOT IN ('en', 'hi', 'hinglish'), true) THEN 'unknown language_tag' END,
        CASE WHEN coalesce(difficulty_tag NOT IN ('easy', 'medium', 'hard'), true) THEN 'unknown difficulty_tag' END,
        CASE WHEN trim(coalesce(question, '')) = '' THEN 'empty question' END,
        CASE WHEN trim(coalesce(gold_answer, '')) = '' THEN 'empty gold_answer' END,
        CASE WHEN question_type = 'unanswerable' AND cites > 0 THEN 'unanswerable but cites ' || cites || ' page(s)' END,
        CASE WHEN question_type = 'unanswerable' AND trim(coalesce(note, '')) = '' THEN 'unanswerable without a note' END,
        CASE WHEN coalesce(question_type <> 'unanswerable', true) AND cites = 0 THEN 'no gold page' END]) AS error FROM q)
    SELECT id, error FROM e WHERE error IS NOT NULL""")
def _(s, d):
    return evaluation.structural_errors(table(s, d, "questions"))


@query("j4_coverage_errors", f"WITH {_ASKED}, g AS (SELECT id AS question_id, unnest(gold_pages) AS p FROM q) SELECT question_id, p.document_id AS document_id, p.page AS page FROM g WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = p.document_id AND c.page = p.page)")
def _(s, d):
    return evaluation.coverage_errors(_questions(s, d), table(s, d, "chunks"))


_LATEST = r"""a AS (SELECT * FROM second_annotation QUALIFY row_number() OVER (PARTITION BY question_id, mine_by, model ORDER BY dated DESC, mine DESC NULLS LAST, theirs DESC NULLS LAST) = 1),
    n AS (SELECT question_id, mine_by, model, CASE WHEN x IN ('yes', 'y') THEN 'yes' WHEN x IN ('no', 'n') THEN 'no' END AS mine, CASE WHEN z IN ('yes', 'y') THEN 'yes' WHEN z IN ('no', 'n') THEN 'no' END AS theirs
          FROM (SELECT *, lower(regexp_replace(mine, '[\s.]', '', 'g')) AS x, lower(regexp_replace(theirs, '[\s.]', '', 'g')) AS z FROM a))"""


def _annotations(s: SparkSession, d: str) -> DataFrame:
    rows = evaluation.latest_annotations(table(s, d, "second_annotation"), ["question_id", "mine_by", "model"], ["dated", "mine", "theirs"])
    label = lambda c: F.lower(F.regexp_replace(c, r"[\s.]", ""))
    yes_no = lambda c: F.when(label(c).isin("yes", "y"), "yes").when(label(c).isin("no", "n"), "no")
    return rows.select("question_id", "mine_by", "model", yes_no("mine").alias("mine"), yes_no("theirs").alias("theirs"))


@query("s18_latest_annotations", f"WITH {_LATEST} SELECT * FROM n")
def _(s, d):
    return _annotations(s, d)


@query("a8_kappa", f"""WITH {_LATEST}, v AS (SELECT * FROM n WHERE mine IS NOT NULL AND theirs IS NOT NULL),
    k AS (SELECT model, count(*) AS n, avg(CASE WHEN mine = theirs THEN 1.0::DOUBLE ELSE 0 END) AS observed, avg(CASE WHEN mine = 'yes' THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN theirs = 'yes' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM v GROUP BY model),
    e AS (SELECT *, a * b + (1 - a) * (1 - b) AS expected FROM k), r AS (SELECT *, CASE WHEN expected >= 1 THEN 0 ELSE (observed - expected) / (1 - expected) END AS kappa FROM e)
    SELECT model, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(kappa, 6) AS kappa,
        CASE WHEN kappa >= 0.81 THEN 'almost perfect' WHEN kappa >= 0.61 THEN 'substantial' WHEN kappa >= 0.41 THEN 'moderate' WHEN kappa >= 0.21 THEN 'fair' WHEN kappa >= 0.01 THEN 'slight' ELSE 'poor' END AS band FROM r""")
def _(s, d):
    k = evaluation.kappa(_annotations(s, d), ["model"])
    return k.select("model", "n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")], "band")


@query("a12_disagreements", f"WITH {_LATEST}, v AS (SELECT * FROM n WHERE mine IS NOT NULL AND theirs IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (mine <> theirs) AS disagree, round(count(*) FILTER (mine <> theirs) / count(*), 6) AS rate, round(count(*) FILTER (mine <> theirs) / count(*) * 150, 6) AS extrapolated FROM v")
def _(s, d):
    rows = _annotations(s, d).where(F.col("mine").isNotNull() & F.col("theirs").isNotNull())
    return evaluation.disagreements(rows, 150).select("n", "disagree", F.round("rate", 6).alias("rate"), F.round("extrapolated", 6).alias("extrapolated"))


@query("r8_stratified_sample", f"""WITH {_ASKED}, z AS (SELECT question_type, round_even(30 * count(*) / sum(count(*)) OVER (), 0) AS share FROM q WHERE question_type IS NOT NULL GROUP BY question_type),
    r AS (SELECT id, question_type, row_number() OVER (PARTITION BY question_type ORDER BY sha256('20260902' || id), id) AS n FROM q)
    SELECT id, question_type FROM r JOIN z USING (question_type) WHERE n <= share""")
def _(s, d):
    return evaluation.stratified_sample(_questions(s, d).where(F.col("question_type").isNotNull()), 30).select("id", "question_type")


@query("a5_corpus_numbers", f"WITH {_NOW} SELECT count(*) AS documents, count(sha256) AS usable, CAST(sum(coalesce(pages, 0)) AS BIGINT) AS pages, count(*) FILTER (sha256 IS NOT NULL AND NOT coalesce(has_text_layer, false)) AS scanned FROM m")
def _(s, d):
    return corpus.corpus_numbers(_manifest(s, d))


@query("a16_status_rates", "SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM manifest GROUP BY status")
def _(s, d):
    return corpus.status_rates(table(s, d, "manifest")).select("status", "n", F.round("share", 6).alias("share"))


@query("j15_drift", f"""WITH f AS (SELECT id, arg_min(coalesce(sha256, ''), line_no) AS sha FROM manifest WHERE id IS NOT NULL GROUP BY id),
    u AS (SELECT id, sha256 FROM manifest WHERE id IS NOT NULL AND sha256 IS NOT NULL AND sha256 <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1)
    SELECT id, CASE WHEN nullif(sha, '') IS NULL THEN 'missing' WHEN sha = sha256 THEN 'ok' ELSE 'changed' END AS state FROM u LEFT JOIN f USING (id)""")
def _(s, d):
    """The manifest's current rows against each id's first fetch."""
    first = table(s, d, "manifest").where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct("sha256"), "line_no")["sha256"].alias("sha256"))
    return corpus.drift(table(s, d, "manifest"), first)


_CONFIGS = """a AS (SELECT converter, splitter, cleaning, metadata FROM (VALUES ('pypdf'), ('docling'), ('docling-noocr'), ('docling-routed'), ('marker'), ('mineru')) a(converter)
    CROSS JOIN (VALUES ('fixed'), ('section')) b(splitter) CROSS JOIN (VALUES ('none'), ('strip')) c(cleaning) CROSS JOIN (VALUES ('none'), ('enriched')) d(metadata)),
    h AS (SELECT *, left(sha256('{"cleaning": "' || cleaning || '", "converter": "' || converter || '", "metadata": "' || metadata || '", "splitter": "' || splitter || '"}'), 12) AS config_hash FROM a),
    r AS (SELECT *, concat_ws('.', converter, cleaning, splitter, metadata, config_hash) AS run_id FROM h)"""


@query("u5_configurations", f"WITH {_CONFIGS} SELECT * FROM r")
def _(s, d):
    return corpus.configurations(s)


@query("u6_neighbourhood", f"WITH {_CONFIGS} SELECT * FROM r WHERE (converter <> 'pypdf')::INT + (splitter <> 'fixed')::INT + (cleaning <> 'none')::INT + (metadata <> 'none')::INT <= 1")
def _(s, d):
    return corpus.neighbourhood(corpus.configurations(s), {"converter": "pypdf", "splitter": "fixed", "cleaning": "none", "metadata": "none"})


QUERIES.update(cases.QUERIES)
SQL.update(cases.SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 hits of the stated questions with their citations."""
    chunks = _chunks(spark, folder, "text", "page", "end_page")
    hits = retrieval.bm25(chunks.select("document_id", "ordinal", "text"), _questions(spark, folder).select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("text")).distinct())
    where = chunks.select("document_id", "ordinal", T.citation(F.col("document_id"), F.col("page"), F.col("end_page")).alias("citation"))
    return hits.join(where, ["document_id", "ordinal"]).select("query_id", "rank", "score", "citation")
