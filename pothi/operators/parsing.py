"""Parsing quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions import text as T
from pothi.functions.text import normalize  # F4
from pothi.schemas import TABLE_KINDS


def gold_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, text: maximal runs of non-blank lines that are all table lines or all none (gaps and islands)."""
    rows = pages.select("page_id", F.posexplode(F.split("text", "\r\n|\r|\n", -1)).alias("line_no", "line"))
    bare = T.strip(F.col("line"))
    rows = rows.withColumn("blank", bare == "").withColumn("table", F.startswith(bare, F.lit("|")))
    order = Window.partitionBy("page_id").orderBy("line_no")
    new = F.coalesce((F.lag("blank").over(order)) | (F.lag("table").over(order) != F.col("table")), F.lit(True))
    rows = rows.withColumn("island", F.sum(F.when(new | F.col("blank"), 1).otherwise(0)).over(order)).where(~F.col("blank"))
    blocks = rows.groupBy("page_id", "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    return blocks.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("island")) - 1).alias("block_no"), text.alias("text"))


def ranks(output: DataFrame, gold: DataFrame) -> DataFrame:
    """page_id, pos, gold_no: every output block with the first gold block of its page one of which begins with the other's first
    40 characters (of the normalised texts).

    Two texts of 40 characters or more are close if their first 40 are equal: an equi-join by page and prefix. A shorter text is close to
    those that begin with it whole, so blocks also meet by page and each prefix length that a shorter text of the other side has: a block
    sends one row per such length of its page (39 at most), and no pair of blocks is looked at that does not match.
    """
    out = output.select("page_id", F.col("block_no").alias("pos"), normalize(F.col("text")).alias("t")).where(F.col("t") != "")
    ref = gold.select("page_id", F.col("block_no").alias("gold_no"), normalize(F.col("text")).alias("t")).where(F.col("t") != "")
    # startswith(o, left(g, 40)): g's prefix is the key and o is cut to its length; and the other way round.
    key = F.substring("t", 1, T.PREFIX)

    def meet(whole: DataFrame, prefix: DataFrame) -> DataFrame:
        keys = prefix.withColumn("_k", key)
        lengths = keys.groupBy("page_id").agg(F.collect_set(F.length("_k")).alias("_ls"))
        cut = whole.join(lengths, "page_id").select("*", F.explode(F.filter("_ls", lambda n: n <= F.length("t"))).alias("_l"))
        cut = cut.select(*[c for c in whole.columns if c != "t"], F.substring(F.col("t"), F.lit(1), F.col("_l")).alias("_k"))
        return cut.join(keys.drop("t"), ["page_id", "_k"]).select("page_id", "pos", "gold_no")

    return meet(out, ref).unionByName(meet(ref, out)).groupBy("page_id", "pos").agg(F.min("gold_no").alias("gold_no"))


def reading_order(matched: DataFrame) -> DataFrame:
    """page_id, tau = (concordant - discordant) / (both) of the matched blocks' gold numbers; null without an untied pair.

    A page's matches form one array, as a page has few blocks; its pairs are counted in place.
    """
    seq = matched.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "gold_no"))), lambda s: s["gold_no"]).alias("r"))
    each = F.transform("r", lambda x, i: F.aggregate(F.slice("r", i + 2, F.size("r")), F.struct(F.lit(0).alias("c"), F.lit(0).alias("d")), lambda a, y: F.struct((a["c"] + (y > x).cast("int")).alias("c"), (a["d"] + (y < x).cast("int")).alias("d"))))
    total = lambda f: F.aggregate(each, F.lit(0), lambda a, e: a + e[f])
    both = seq.select("page_id", total("c").alias("c"), total("d").alias("d"))
    return both.select("page_id", F.when(F.col("c") + F.col("d") > 0, (F.col("c") - F.col("d")) / (F.col("c") + F.col("d"))).alias("tau"))


def table_scores(output: DataFrame, gold: DataFrame) -> DataFrame:
    """page_id, teds: mean over the page's gold tables of the best score among its candidate blocks; pages without a gold table have no row.

    Candidates are blocks of table kind and, only if a page has none, blocks that parse as a table (Q12).
    """
    parsed = lambda df: df.withColumn("_p", T.parse_markdown_table(F.col("text")))
    tables = parsed(gold).where(F.col("_p").isNotNull()).select("page_id", "block_no", F.col("_p").alias("_g"))
    out = parsed(output)
    kind = F.col("kind").isin(*TABLE_KINDS)
    has = output.where(kind).select("page_id").distinct()
    candidates = out.where(kind).unionByName(out.where(F.col("_p").isNotNull()).join(has, "page_id", "left_anti")).select("page_id", F.col("_p").alias("_o"))
    best = tables.join(candidates, "page_id", "left").groupBy("page_id", "block_no").agg(F.coalesce(F.max(T.teds_of_tables(F.col("_o"), F.col("_g"))), F.lit(0.0)).alias("s"))
    return best.groupBy("page_id").agg(F.avg("s").alias("teds"))


def score_pages(output: DataFrame, gold: DataFrame) -> DataFrame:
    """page_id, text, teds, order, blocks of each gold page (page_id, text) against output blocks (page_id, block_no, text, kind).

    Pages without output are kept with an empty text.
    """
    whole = output.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "text"))).alias("bs"))
    joined = gold.join(whole, "page_id", "left").select("page_id", F.coalesce(F.array_join(F.transform("bs", lambda b: b["text"]), "\n\n"), F.lit("")).alias("o"), F.col("text").alias("g"), F.coalesce(F.size("bs"), F.lit(0)).alias("blocks"))
    refs = gold_blocks(gold)
    order = reading_order(ranks(output, refs))
    return joined.select("page_id", T.text_similarity(F.col("o"), F.col("g")).alias("text"), F.when(F.col("blocks") > 0, F.col("blocks")).otherwise(0).alias("blocks")).join(table_scores(output, refs), "page_id", "left").join(order, "page_id", "left")


def means(scores: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Means over the rows that have a value, rounded to 3 digits; null where none has."""
    return scores.groupBy(by).agg(F.count("*").alias("pages"), *[F.round(F.avg(m), 3).alias(m) for m in metrics])
