"""Evaluation set and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions import text as T
from pothi.schemas import DIFFICULTIES, LANGUAGES, QUESTION_TYPES

LEAST, LEAST_UNANSWERABLE, SEED = 15, 20, 20260902


def json_string(col: Column) -> Column:
    """A JSON string literal, non-ASCII kept."""
    return F.substring(F.to_json(F.struct(col.alias("a"))), 6, 100_000_000).substr(F.lit(1), F.length(F.to_json(F.struct(col.alias("a")))) - 6)


def canonical(questions: DataFrame) -> DataFrame:
    """id, canon: compact JSON with sorted keys of the seven fields that make a question; nulls as empty strings."""
    s = lambda c: json_string(F.coalesce(F.col(c), F.lit("")))
    pages = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("gold_pages", F.array().cast("array<struct<document_id:string,page:int>>")), lambda p: F.concat(F.lit("["), json_string(p["document_id"]), F.lit(","), p["page"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    canon = F.concat(
        F.lit('{"difficulty_tag":'), s("difficulty_tag"), F.lit(',"gold_answer":'), s("gold_answer"), F.lit(',"gold_pages":'), pages, F.lit(',"id":'), s("id"),
        F.lit(',"language_tag":'), s("language_tag"), F.lit(',"question":'), s("question"), F.lit(',"question_type":'), s("question_type"), F.lit("}"),
    )
    return questions.select("id", canon.alias("canon"))


def content_hash(questions: DataFrame) -> DataFrame:
    """One row, sha256 of all canonical questions sorted by id. The definition is one string over the whole set, so it is gathered in one
    task: for evaluation sets, which people write, not for corpora."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "canon"))), lambda x: x["canon"]), "\n")
    return canonical(questions).agg(F.sha2(joined, 256).alias("content_hash"))


def question_hashes(questions: DataFrame) -> DataFrame:
    """F19 at scale: id, sha256 of each canonical question."""
    return canonical(questions).select("id", F.sha2("canon", 256).alias("hash"))


def type_counts(questions: DataFrame) -> DataFrame:
    """A4: question_type, n, floor, ok for every type of the vocabulary, also those without a question."""
    domain = F.explode(F.array(*[F.struct(F.lit(t).alias("question_type"), F.lit(LEAST_UNANSWERABLE if t == "unanswerable" else LEAST).alias("floor")) for t in QUESTION_TYPES]))
    counts = questions.groupBy("question_type").agg(F.count("*").alias("n"))
    types = questions.sparkSession.range(1).select(domain.alias("t")).select("t.*")
    return types.join(counts, "question_type", "left").select("question_type", "floor", F.coalesce("n", F.lit(0)).alias("n")).withColumn("ok", F.col("n") >= F.col("floor"))


def structural_errors(questions: DataFrame) -> DataFrame:
    """Id, error: all rules at once, in one pass; each second and later row of an id is a duplicate."""
    blank = lambda c: T.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    unknown = lambda c, of: ~F.coalesce(F.col(c).isin(*of), F.lit(False))
    cites = F.coalesce(F.size("gold_pages"), F.lit(0))
    none = F.col("question_type") == "unanswerable"
    order = Window.partitionBy("id").orderBy("question_type", "question")
    rows = questions.withColumn("_n", F.row_number().over(order))
    # The errors' texts.
    rules = [
        (F.col("_n") > 1, F.lit("duplicate id")),
        (unknown("question_type", QUESTION_TYPES), F.lit("unknown question_type")),
        (unknown("language_tag", LANGUAGES), F.lit("unknown language_tag")),
        (unknown("difficulty_tag", DIFFICULTIES), F.lit("unknown difficulty_tag")),
        (blank("question"), F.lit("empty question")),
        (blank("gold_answer"), F.lit("empty gold_answer")),
        (none & (cites > 0), F.concat(F.lit("unanswerable but cites "), cites.cast("string"), F.lit(" page(s)"))),
        (none & blank("note"), F.lit("unanswerable without a note")),
        (~F.coalesce(none, F.lit(False)) & (cites == 0), F.lit("no gold page")),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]), lambda x: x.isNotNull())
    return rows.select("id", F.explode(found).alias("error"))


def cited_pages(questions: DataFrame) -> DataFrame:
    """question_id, pos, document_id, page."""
    return questions.select(F.col("id").alias("question_id"), F.posexplode("gold_pages").alias("pos", "p")).select("question_id", "pos", "p.document_id", "p.page")


def known_pages(chunks: DataFrame) -> DataFrame:
    """A19/U7."""
    return chunks.select("document_id", "page").distinct()


def coverage_errors(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations of a page at which no chunk starts (Q17)."""
    return cited_pages(questions).join(known_pages(chunks), ["document_id", "page"], "left_anti").select("question_id", "document_id", "page")


def page_text(chunks: DataFrame) -> DataFrame:
    """document_id, page, text: the chunks that start on the page, joined by ordinal. A page bounds the gathered array."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), " ")
    return chunks.groupBy("document_id", "page").agg(joined.alias("text"))


def citation_support(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, language_tag, claims, missing (array), supported, of the questions that cite a page.

    Only chunks on cited pages are gathered.
    """
    cited = cited_pages(questions)
    needed = chunks.join(cited.select("document_id", "page").distinct(), ["document_id", "page"], "left_semi")
    texts = cited.join(page_text(needed), ["document_id", "page"], "left")
    joined = texts.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("page_text"))
    rows = questions.join(joined, F.col("id") == F.col("question_id"))
    missing = T.unsupported(F.col("gold_answer"), F.col("page_text"), F.col("question"))
    return rows.select("question_id", "language_tag", F.size(T.claim_tokens(F.col("gold_answer"))).alias("claims"), missing.alias("missing")).withColumn("supported", F.size("missing") == 0)


def support_totals(support: DataFrame) -> DataFrame:
    """language_tag, checked, supported, failed. Questions without a claim are not checkable."""
    return support.where(F.col("claims") > 0).groupBy("language_tag").agg(F.count("*").alias("checked"), F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("failed"))


def latest_annotations(annotations: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key only the last in order."""
    rest = [c for c in annotations.columns if c not in key]
    return annotations.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def kappa(pairs: DataFrame, by: list[str], mine: str = "mine", theirs: str = "theirs") -> DataFrame:
    """By, n, observed, expected, kappa, band of pairs of labels. Expected agreement 1 or more gives kappa 0.

    One aggregation by (by, mine, theirs), combined before the shuffle; the rest works on its few rows.
    """
    cells = pairs.where(F.col(mine).isNotNull() & F.col(theirs).isNotNull()).groupBy(*by, mine, theirs).agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(mine) == F.col(theirs), F.col("c")).otherwise(0)).alias("same"))
    a = cells.groupBy(*by, F.col(mine).alias("label")).agg(F.sum("c").alias("a"))
    b = cells.groupBy(*by, F.col(theirs).alias("label")).agg(F.sum("c").alias("b"))
    both = a.join(b, [*by, "label"], "full").groupBy(*by).agg(F.sum(F.coalesce("a", F.lit(0)) * F.coalesce("b", F.lit(0))).alias("ab"))
    rows = total.join(both, by) if by else total.crossJoin(both)  # one row each
    rows = rows.select(*by, "n", (F.col("same") / F.col("n")).alias("observed"), (F.col("ab") / (F.col("n") * F.col("n"))).alias("expected"))
    rows = rows.withColumn("kappa", F.when(F.col("expected") >= 1, 0.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))
    return rows.withColumn("band", T.band(F.col("kappa")))


def disagreements(pairs: DataFrame, total: int) -> DataFrame:
    """N, disagree, rate, extrapolated to `total` questions."""
    rate = F.count_if(F.col("mine") != F.col("theirs")) / F.count("*")
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("mine") != F.col("theirs")).alias("disagree"), rate.alias("rate"), (rate * total).alias("extrapolated"))


def annotated_sample(sample: DataFrame, annotations: DataFrame, *columns: str) -> DataFrame:
    """question_id, the annotation's other columns and the question's `columns`, of the sampled questions that are annotated, in the sample's order (by id).

    annotations: one row per question_id (latest_annotations). Questions without an annotation have no row.
    """
    questions = sample.select(F.col("id").alias("question_id"), *columns)
    return questions.join(annotations, "question_id").select("question_id", *[c for c in annotations.columns if c != "question_id"], *columns).orderBy("question_id")


def first_failures(support: DataFrame, n: int = 8, verbose: bool = False) -> DataFrame:
    """The first n unsupported rows of citation_support by question_id, all of them if verbose. The limit is the report's feature."""
    failed = support.where(~F.col("supported")).orderBy("question_id")
    return failed if verbose else failed.limit(n)


def stratified_sample(questions: DataFrame, n: int, by: str = "question_type", seed: int = SEED) -> DataFrame:
    """About n rows, each stratum's share rounded half to even, drawn by the hash of seed and id (Q13: not the reference's own sample)."""
    sizes = questions.groupBy(by).agg(F.count("*").alias("_u"))
    total = F.sum("_u").over(Window.partitionBy())  # over the strata, a closed vocabulary
    share = sizes.withColumn("_share", F.bround(F.lit(float(n)) * F.col("_u") / total))
    draw = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(str(seed)), "id"), 256), "id")
    return questions.withColumn("_n", F.row_number().over(draw)).join(F.broadcast(share), by).where(F.col("_n") <= F.col("_share")).drop("_n", "_u", "_share")


def translate(questions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Language, question and answer replaced where an override (id, language_tag, question, gold_answer) is given."""
    o = overrides.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("language_tag", "question", "gold_answer")])
    joined = questions.join(o, F.col("id") == F.col("_id"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns and c != "id" else F.col(c) for c in questions.columns])


def union_groups(groups: dict[str, DataFrame]) -> DataFrame:
    """Question groups with their kind as question_type."""
    out = None
    for kind, df in groups.items():
        part = df.withColumn("question_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out
