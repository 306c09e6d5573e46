"""Sources: declared schemas, nothing inferred. PDF readers, OCR and layout models run outside; their output comes in as tables or files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pothi.functions import text as T

#: Layout types of a page tree and the block kinds they become.
TREE_KINDS = {"SectionHeader": "SectionHeaderItem", "Text": "TextItem", "ListItem": "ListItem", "Table": "TableItem", "Caption": "CaptionItem", "Footnote": "FootnoteItem"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_blocks(documents: DataFrame, per_page: int = 5) -> DataFrame:
    """Blocks of plain documents (doc_id, text): a block per line, `per_page` lines a page; the first is a heading, lines with a bar are tables."""
    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    kind = F.when(F.col("seq") == 0, "SectionHeaderItem").when(F.col("text").contains("|"), "TableItem").otherwise("TextItem")
    return rows.select("document_id", "seq", "text", (F.floor(F.col("seq") / per_page) + 1).cast("int").alias("page"), kind.alias("kind"), F.lit(None).cast("int").alias("level"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """One block per page (document_id, page, text): glyphs stripped, empty pages dropped. The PDF reader itself is external."""
    clean = pages.withColumn("text", T.strip(T.strip_unmapped(F.col("text")))).where(F.col("text") != "")
    return clean.select("document_id", F.col("page").alias("seq"), "text", "page", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("level"))


def tree_blocks(documents: DataFrame) -> DataFrame:
    """Blocks of page trees (document_id, pages array<struct<children array<struct<block_type, page_id, text>>>>); pages from 1, unknown kinds dropped."""
    kinds = F.create_map(*[F.lit(x) for kv in TREE_KINDS.items() for x in kv])
    rows = documents.select("document_id", F.posexplode(F.flatten(F.transform("pages", lambda p: p["children"]))).alias("seq", "c"))
    rows = rows.select("document_id", "seq", T.strip(T.strip_unmapped(F.col("c.text"))).alias("text"), (F.col("c.page_id") + 1).alias("page"), F.element_at(kinds, F.substring_index("c.block_type", ".", -1)).alias("kind"), F.lit(None).cast("int").alias("level"))
    return rows.where(F.col("kind").isNotNull() & (F.col("text") != ""))


def content_list_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of content lists (document_id, seq, type, text, text_level, table_body, page_idx): tables and texts with a page; a level makes a heading."""
    is_table = F.col("type") == "table"
    text = F.when(is_table, T.html_table_to_markdown(F.coalesce("table_body", F.lit("")))).otherwise(T.strip(F.coalesce("text", F.lit(""))))
    kind = F.when(is_table, "TableItem").when(F.col("text_level").isNotNull(), "SectionHeaderItem").otherwise("TextItem")
    level = F.when(~is_table, F.col("text_level")).cast("int")
    out = rows.where(F.col("type").isin("table", "text") & (F.col("page_idx") >= 0))
    return out.select("document_id", "seq", text.alias("_t"), (F.col("page_idx") + 1).alias("page"), kind.alias("kind"), level.alias("level")).withColumnRenamed("_t", "text").where(F.col("text") != "")


def content_list_rows(files: DataFrame) -> DataFrame:
    """document_id, seq, row (JSON text) of the content list of each document among files (document_id, path, content): the first by path whose name
    ends in _content_list.json, has no 'v2', and whose content is a JSON list; of its entries only the objects."""
    stem = F.substring_index("path", "/", -1)
    lists = files.where(stem.endswith("_content_list.json") & ~stem.contains("v2")).withColumn("_rows", F.from_json("content", "array<string>")).where(F.col("_rows").isNotNull() & F.startswith(F.ltrim("content"), F.lit("[")))
    first = lists.groupBy("document_id").agg(F.min_by("_rows", "path").alias("_rows"))
    return first.select("document_id", F.posexplode("_rows").alias("seq", "row")).where(F.startswith(F.ltrim("row"), F.lit("{")))


def parsed_content_list(rows: DataFrame) -> DataFrame:
    """Rows of content_list_rows with the fields that content_list_blocks reads; a missing page is -1."""
    fields = F.from_json("row", "type string, text string, text_level int, table_body string, page_idx int")
    return rows.select("document_id", "seq", fields.alias("r")).select("document_id", "seq", "r.type", "r.text", "r.text_level", "r.table_body", F.coalesce("r.page_idx", F.lit(-1)).alias("page_idx"))


def without_glyphs(blocks: DataFrame) -> DataFrame:
    """Blocks of an external converter without unmapped glyphs, with the number of them (`glyphs`, A17 sums it); blocks left empty are dropped."""
    clean = blocks.withColumn("glyphs", T.unmapped_count(F.col("text"))).withColumn("text", T.strip_unmapped(F.col("text")))
    return clean.where(F.col("text") != "")


#: How the blocks of each converter of the catalogue come in. Layout models run outside; what they leave (S4, S5, S7, or the cache S6) is read here.
CONVERTER_READERS = {"pypdf": page_blocks, "docling": None, "docling-noocr": None, "docling-routed": None, "marker": tree_blocks, "mineru": content_list_blocks}


def converted(converter: str, rows: DataFrame) -> DataFrame:
    """Blocks of one converter's output rows, by the catalogue; an unknown name is an error that lists the known ones."""
    if converter not in CONVERTER_READERS:
        raise ValueError(f"unknown converter {converter}; known: {', '.join(CONVERTER_READERS)}")
    return without_glyphs((CONVERTER_READERS[converter] or item_blocks)(rows)).drop("glyphs")


def item_blocks(items: DataFrame) -> DataFrame:
    """Blocks of layout items (document_id, seq, class, text, prov array<struct<page_no>>, md): page of the first valid provenance; without one dropped."""
    page = F.get(F.filter("prov", lambda p: p["page_no"] >= 1), F.lit(0))["page_no"]
    text = F.coalesce(F.nullif(T.strip(F.col("text")), F.lit("")), F.nullif(T.strip(F.col("md")), F.lit("")))
    rows = items.select("document_id", "seq", text.alias("text"), page.alias("page"), F.col("class").alias("kind"), F.lit(None).cast("int").alias("level"))
    return rows.where(F.col("page").isNotNull() & F.col("text").isNotNull())


def cached_blocks(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Blocks of JSON documents {document_id (or document), blocks: [{text, page, kind, level}]}, a document a line or, with `one_per_file`, one in each file over any lines."""
    schema = "document_id string, document string, blocks array<struct<text:string,page:int,kind:string,level:int>>"
    rows = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    return rows.select(F.coalesce("document_id", "document").alias("document_id"), F.posexplode("blocks").alias("seq", "b")).select("document_id", "seq", "b.*")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines in a declared schema. Blank lines are skipped; `strict` fails on a malformed line, else it is dropped."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


#: Suffixes of the files that the convention scan reads.
TEXT_SUFFIXES = (".py", ".md", ".txt", ".yml", ".yaml", ".toml", ".json", ".ts", ".tsx", ".js", ".jsx", ".css", ".html", ".sh", ".cfg", ".ini", ".sql")


def numbered_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), exempt: tuple[str, ...] = ()) -> DataFrame:
    """Path, line_no (from 1), line of text files. suffixes: those read (all if none is given); exempt: names of files left out.

    A file is one row until its lines are numbered; a line feed at its end opens no further line.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    if suffixes:
        files = files.where(F.concat(F.lit("."), F.substring_index("path", ".", -1)).isin(*suffixes))
    if exempt:
        files = files.where(~F.substring_index("path", "/", -1).isin(*exempt))
    rows = files.where(F.col("value") != "").select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z|\r\z", ""), T.RX_LINES, -1)).alias("n", "line"))
    return rows.select("path", (F.col("n") + 1).alias("line_no"), "line")


def eval_set(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("id", "question", "gold_answer", "question_type")) -> DataFrame:
    """Rows of a set of JSON lines in a declared schema. Blank lines are skipped; the first line that is no object, or lacks a required field, is an error that names file and line."""
    lines = numbered_lines(spark, path).where(T.strip(F.col("line")) != "")
    rows = lines.select("path", "line_no", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    lacks = [F.when(F.col(f"r.{c}").isNull(), F.lit(f"missing {c}")) for c in required]
    problem = F.coalesce(F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.lit("no JSON object")), *lacks)
    first = rows.select("path", "line_no", problem.alias("problem")).where(F.col("problem").isNotNull()).orderBy("path", "line_no").first()
    if first:
        raise ValueError(f"{first['path']}:{first['line_no']}: {first['problem']}")
    return rows.select("r.*").drop("_bad")


def gold_texts(spark: SparkSession, path: str) -> DataFrame:
    """Path, text of gold pages."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def gold_keys(index: DataFrame) -> DataFrame:
    """The gold index with its key, document-pN."""
    return index.withColumn("page_id", F.concat("document_id", F.lit("-p"), F.col("page").cast("string")))


def sources(spark: SparkSession, entries: dict) -> DataFrame:
    """A nested mapping {scheme: {documents: [{id, url, kind, language, published?}]}} (YAML, read by the caller) as flat rows."""
    rows = [(s, d["id"], d["url"], d.get("kind"), d.get("language"), d.get("published")) for s, body in entries.items() for d in body.get("documents", [])]
    return spark.createDataFrame(rows, "scheme string, id string, url string, kind string, language string, published string")


#: Fields of a provider's entry: name, type, whether it must be there.
PROVIDER_FIELDS = (("base_url", str, True), ("api_key_env", str, True), ("default_model", str, True), ("reset_window", str, True), ("last_verified", str, True), ("rpm_limit", int, False), ("input_price_per_1m", float, False), ("output_price_per_1m", float, False), ("usage_parser", str, False))
#: Names of the usage parsers.
USAGE_PARSERS = ("default", "total_aware")


def providers(spark: SparkSession, entries: dict | None) -> DataFrame:
    """Name and fields of the providers of a nested mapping (YAML, read by the caller), the built-in `mock` first. A malformed entry is an error that names it."""
    rows = [("mock", *[None] * 8, "default")]
    for name, entry in (entries or {}).items():
        values = []
        for field, kind, needed in PROVIDER_FIELDS:
            value = entry.get(field) if isinstance(entry, dict) else None
            if value is None and needed:
                raise ValueError(f"invalid entry for provider '{name}': {field} is missing")
            if value is not None and not isinstance(value, (int, float) if kind is float else kind) or isinstance(value, bool):
                raise ValueError(f"invalid entry for provider '{name}': {field} must be {kind.__name__}")
            values.append(float(value) if kind is float and value is not None else value)
        values[-1] = values[-1] or "default"
        if values[-1] not in USAGE_PARSERS:
            raise ValueError(f"invalid entry for provider '{name}': unknown usage_parser {values[-1]}")
        rows.append((name, *values))
    kinds = {str: "string", int: "int", float: "double"}
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{f} {kinds[k]}" for f, k, _ in PROVIDER_FIELDS))


def chunks_of_run(chunks: DataFrame, run_id: str, document_id: str | None = None) -> DataFrame:
    """A run's chunks, of one document if given, in order."""
    rows = chunks.where(F.col("run_id") == run_id)
    return (rows if document_id is None else rows.where(F.col("document_id") == document_id)).orderBy("document_id", "ordinal")


def last_by_line(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Of the rows of a key the one furthest down."""
    last = Window.partitionBy(key).orderBy(F.desc(line))
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")


def check_schema(df: DataFrame, required: str) -> DataFrame:
    """Fail early if a column of the declared schema is missing."""
    need = [c.strip().split(" ")[0] for c in required.split(", ")]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
