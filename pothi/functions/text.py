"""Column functions on text. All but `nfc` and those that compose with it (F4, F6, F8, F13) stay in the JVM; null in, null out unless stated."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Regular expressions whose results must equal the reference's, in Java syntax.
RX_TOKEN = r"[0-9]+(?:[/\-][0-9]+)*|[\p{L}\p{Nl}\p{No}]+(?:-[\p{L}\p{Nl}\p{No}]+)*"
RX_HYPHEN = r"([\p{L}\p{N}_])-\s*\n\s*([a-zऀ-ॿ])"
RX_TRIM = r"(?U)^\s+|\s+$"
RX_TR = r"(?is)<tr[^>]*>(.*?)</tr>"
RX_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
RX_TAG = r"<[^>]+>"
RX_TABLE_SEP = r"^\|(\s*:?-+:?\s*\|)+$"
RX_NUMBER = r"\p{Nd}[\p{Nd},.]*\p{Nd}|\p{Nd}"
RX_GAP = r"(?<=\p{Nd})[\s,]+(?=[\p{Nd}.])"
RX_HREF = r"""(?i)href\s*=\s*["']([^"']+)["']"""
RX_RETRY = r"(?i)retry in ([\d.]+)\s*(ms|s)\b"
RX_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# Patterns of the convention scan.
RX_ATTRIBUTION = r"(?i)co-authored-by|(?:generated|written|authored) (?:with|by) (?:claude|codex|cursor|grok|copilot|chatgpt|an? ai)|with the help of (?:claude|codex|cursor|grok|copilot|chatgpt)"
RX_TELLS = r"(?i)\bclaude\b|\bcodex\b|\bcursor\b|\bgrok\b|\bcopilot\b|\bchatgpt\b|\bAGENTS\.md\b"
RX_DASH = r"[\u2013\u2014]"
RX_SECRET = r"\b(?:sk-[A-Za-z0-9]{16,}|gsk_[A-Za-z0-9]{16,}|xai-[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{20,}|ghp_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_\-]{16,})"
RX_ABSOLUTE = r"(?i)\b(?:solves|blocks|prevents)\b"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, RX_TRIM, "")


def squeeze(col: Column) -> Column:
    """White space runs to one space, stripped."""
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def strip_unmapped(col: Column) -> Column:
    """the text without U+0000."""
    return F.replace(col, F.lit("\u0000"), F.lit(""))


def unmapped_count(col: Column) -> Column:
    """the number of U+0000 in the text."""
    return F.length(col) - F.length(strip_unmapped(col))


def dehyphenate(col: Column) -> Column:
    """words cut at a line end before a lower-case or Devanagari letter are joined; the result is stripped."""
    return strip(F.regexp_replace(col, RX_HYPHEN, "$1$2"))


def tokens(col: Column) -> Column:
    """lower-cased tokens in order, duplicates kept. Devanagari words fall apart at their marks, as the reference's do (Q1)."""
    return F.transform(F.regexp_extract_all(col, F.lit(RX_TOKEN), F.lit(0)), F.lower)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no built-in; an Arrow batch at a time, plain ASCII untouched."""
    return s.map(lambda x: x if not isinstance(x, str) or x.isascii() else unicodedata.normalize("NFC", x))


def normalize(col: Column) -> Column:
    """NFC, white space squeezed, stripped."""
    return squeeze(nfc(col))


def text_similarity(output: Column, gold: Column) -> Column:
    """both texts normalised (F4); 1 - edit distance / length of gold; may be negative. An empty gold gives 1 for empty output, else 0."""
    return similarity_of_normal(normalize(output), normalize(gold))


def similarity_of_normal(output: Column, gold: Column) -> Column:
    """F6 of texts that are normalised already."""
    return F.when(F.length(gold) == 0, F.when(F.length(output) == 0, 1.0).otherwise(0.0)).otherwise(1 - F.levenshtein(output, gold) / F.length(gold))


def html_table_to_markdown(html: Column) -> Column:
    """rows by tr, cells by td or th, tags to spaces, padded to the widest row; no rows give an empty text. Entities stay (Q19)."""
    cell = lambda c: squeeze(F.regexp_replace(c, RX_TAG, " "))
    rows = F.transform(F.regexp_extract_all(html, F.lit(RX_TR), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(RX_CELL), F.lit(1)), cell))
    rows = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: table_line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
    ruled = F.concat(F.slice(padded, 1, 1), F.array(table_rule(width)), F.slice(padded, F.lit(2), F.size(padded)))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(ruled, "\n"))


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_rule(width: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width.cast("int")), ""))


def parse_markdown_table(text: Column) -> Column:
    """F8: struct<header, rows> of a pipe table, null if it is none: two pipe lines at least, the second a rule. Cells are normalised."""
    return table_of_normal(nfc(text))


def table_of_normal(text: Column) -> Column:
    """F8 of a text in NFC; no character that ends a line or a cell composes with another."""
    lines = F.filter(F.transform(F.split(text, RX_LINES, -1), strip), lambda x: F.startswith(x, F.lit("|")))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1), lambda c: squeeze(F.replace(c, F.lit("<br>"), F.lit(" "))))
    body = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(0))), cells)
    is_table = (F.size(lines) >= 2) & F.get(lines, F.lit(1)).rlike(RX_TABLE_SEP)
    return F.when(is_table, F.struct(cells(F.get(lines, F.lit(0))).alias("header"), body.alias("rows")))


def render_table(table: Column) -> Column:
    """a struct<header, rows> as a pipe table."""
    return F.array_join(F.concat(F.array(table_line(table["header"]), table_rule(F.size(table["header"]))), F.transform(table["rows"], table_line)), "\n")


def table_nodes(table: Column) -> Column:
    """array<struct<label, text>>: the table, then each row and its cells in order."""
    node = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    row = lambda r: F.concat(F.array(node("tr", F.lit(""))), F.transform(r, lambda c: node("td", c)))
    return F.concat(F.array(node("table", F.lit(""))), row(table["header"]), F.flatten(F.transform(table["rows"], row)))


#: Fixed value: characters in which two cells must agree to be close.
PREFIX = 40


def cell_close(a: Column, b: Column) -> Column:
    """equal, or both filled and one starts with the other's first 40 characters."""
    return (a == b) | ((a != "") & (b != "") & (F.startswith(a, F.substring(b, 1, PREFIX)) | F.startswith(b, F.substring(a, 1, PREFIX))))


def table_distance(a: Column, b: Column) -> Column:
    """edit distance of two node lists; a substitution is free if the labels are equal and the texts close."""
    start = F.sequence(F.lit(0), F.size(b))

    def next_row(row: Column, x: Column) -> Column:
        first = F.array(F.get(row, F.lit(0)) + 1)
        cost = lambda y: F.when((x["label"] == y["label"]) & cell_close(x["text"], y["text"]), 0).otherwise(1)
        step = lambda acc, j: F.concat(
            acc, F.array(F.least(F.get(acc, j - 1) + 1, F.get(row, j) + 1, F.get(row, j - 1) + cost(F.get(b, j - 1))))
        )
        return F.when(F.size(b) == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), first, step))

    return F.get(F.aggregate(a, start, next_row), F.size(b))


def teds(output: Column, gold: Column) -> Column:
    """1 - node edit distance / larger node count of two markdown tables; 0 where either is none. The texts must be columns in NFC (`nfc`), as a lambda can hold no Arrow function."""
    return teds_of_tables(table_of_normal(output), table_of_normal(gold))


def teds_of_tables(x: Column, y: Column) -> Column:
    """F13 of two structs of F8."""
    a, b = table_nodes(x), table_nodes(y)
    score = 1 - table_distance(a, b) / F.greatest(F.size(a), F.size(b))
    return F.when(x.isNull() | y.isNull(), 0.0).otherwise(score)


def claim_tokens(answer: Column) -> Column:
    """the distinct numbers of a text without commas and closing dots, of three characters or more, sorted."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(RX_NUMBER), F.lit(0)), lambda x: F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"\.+$", ""))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: F.length(x) >= 3)))


def close_digit_gaps(text: Column) -> Column:
    """white space and commas between a digit and a digit or dot are removed."""
    return F.regexp_replace(text, RX_GAP, "")


def unsupported(answer: Column, page_text: Column, question: Column) -> Column:
    """F16: claim tokens of the answer that neither the question has nor the page text contains (as a substring, Q21)."""
    hay = F.coalesce(close_digit_gaps(page_text), F.lit(""))
    return F.filter(F.array_except(claim_tokens(answer), F.coalesce(claim_tokens(question), F.array().cast("array<string>"))), lambda t: F.instr(hay, t) == 0)


def citation(document: Column, page: Column, end_page: Column) -> Column:
    """F17."""
    return F.when(end_page > page, F.concat(document, F.lit(", pages "), page.cast("string"), F.lit(" to "), end_page.cast("string"))).otherwise(F.concat(document, F.lit(", page "), page.cast("string")))


def extract(document: Column, page: Column, text: Column) -> Column:
    """F24, one passage."""
    return F.concat(F.lit("["), document, F.lit(", page "), page.cast("string"), F.lit("]\n"), text)


def snippet(text: Column) -> Column:
    """squeezed, first 150 characters."""
    return F.substring(squeeze(text), 1, 150)


def published_date(text: Column) -> Column:
    """the first eight digits as an ISO date, null if there are fewer."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


#: Lowest kappa of each band, highest first.
BANDS = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.01, "slight"))


def band(kappa: Column) -> Column:
    """the first band whose floor the kappa reaches, else poor."""
    out = F.lit("poor")
    for floor, name in reversed(BANDS):
        out = F.when(kappa >= floor, name).otherwise(out)
    return F.when(kappa.isNotNull(), out)


def has_emoji(line: Column) -> Column:
    """other symbols beyond U+2100."""
    return line.rlike(r"[\p{So}&&[^\u0000-℀]]")


def usage_tokens(body: Column) -> Column:
    """struct<tokens_in, tokens_out> of a JSON usage record; a larger total gives the output as total - prompt."""
    number = lambda name: F.get_json_object(body, f"$.usage.{name}").cast("bigint")
    prompt, completion, total = number("prompt_tokens"), number("completion_tokens"), number("total_tokens")
    rest = F.when(total.isNotNull() & prompt.isNotNull() & (completion.isNull() | (total - prompt > completion)), total - prompt).otherwise(completion)
    return F.struct(prompt.alias("tokens_in"), rest.alias("tokens_out"))


def retry_delay(header: Column, body: Column) -> Column:
    """seconds to wait: the header, else the RetryInfo detail of the JSON error, else its message ('retry in 12.5s', '...ms').

    The error object may be wrapped in a list. Null if there is none.
    """
    error = F.coalesce(F.get_json_object(body, "$.error"), F.get_json_object(body, "$[0].error"))
    is_object = F.startswith(F.ltrim(error), F.lit("{"))
    details = F.from_json(F.get_json_object(error, "$.details"), "array<struct<`@type`:string,retryDelay:string>>")
    delays = F.transform(F.filter(details, lambda d: d["@type"].endswith("RetryInfo")), lambda d: F.regexp_replace(d["retryDelay"], "s+$", "").try_cast("double"))
    detail = F.get(F.filter(delays, lambda x: x.isNotNull()), F.lit(0))
    message = F.get_json_object(error, "$.message")
    value = F.nullif(F.regexp_extract(message, RX_RETRY, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(message, RX_RETRY, 2))
    return F.coalesce(header.try_cast("double"), F.when(is_object, F.coalesce(detail, F.when(unit == "ms", value / 1000).otherwise(value))))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """price per million tokens; null if anything is."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def word_count(text: Column) -> Column:
    """F32: tokens separated by white space; 0 for blank text."""
    return F.when(F.length(strip(text)) == 0, 0).otherwise(F.size(F.split(strip(text), r"(?U)\s+", -1)))


def mock_reply(messages: Column) -> Column:
    """F32: struct<text, tokens_in, tokens_out>: the reply that repeats the last user message of array<struct<role, content>>; an empty one if there is none."""
    asked = F.filter(messages, lambda m: m["role"] == "user")
    last = F.coalesce(F.get(asked, F.size(asked) - 1)["content"], F.lit(""))
    return F.struct(F.concat(F.lit("mock reply: "), last).alias("text"), word_count(last).alias("tokens_in"), (word_count(last) + 2).alias("tokens_out"))
