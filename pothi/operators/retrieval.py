"""Lexical and dense retrieval, fusion, gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pothi.functions import text as T

K1, B, EPSILON, RRF, FLOOR = 1.5, 0.75, 0.25, 60, 0.80
#: Scores of vectors and queries that are worked out at once (8 MB).
SCORES = 1 << 20
#: Questions of a block, and chunks whose scores are worked out together.
QUESTIONS, STRIPE = 512, 512
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
#: Numbers of a block of query vectors, at most (64 MB); more queries are several blocks.
QUERY_NUMBERS = 1 << 23


def once(chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per (run_id, document_id, ordinal): the one written last. columns: those kept beside the key (all by default)."""
    rest = columns or [c for c in chunks.columns if c not in ("run_id", "document_id", "ordinal", "written")]
    latest = chunks.groupBy("run_id", "document_id", "ordinal").agg(F.max_by(F.struct(*rest), "written").alias("_r"))
    return latest.select("run_id", "document_id", "ordinal", *[F.col("_r")[c].alias(c) for c in rest])


def term_stats(chunks: DataFrame) -> DataFrame:
    """A3: term, df (chunks that have it), length; the row without a term has the number of chunks and the sum of their lengths.

    One pass: a chunk sends its distinct terms, counted before the shuffle.
    """
    tokens = chunks.select(T.tokens(F.col("text")).alias("t"))
    of_chunk = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.coalesce(F.size("t"), F.lit(0)).alias("n")))
    terms = F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("term"), F.lit(0).alias("n")))
    rows = tokens.select(F.explode(F.concat(of_chunk, F.coalesce(terms, F.array().cast("array<struct<term:string,n:int>>")))).alias("x"))
    return rows.groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.n").alias("length"))


def _asked_terms(questions: DataFrame, by: tuple[str, ...]) -> dict[tuple, dict[str, int]]:
    """Every question's tokens and how often it has each."""
    rows = questions.select(*by, F.explode_outer(T.tokens(F.col("text"))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("times")).toArrow()
    found: dict[tuple, dict[str, int]] = {}
    for *key, term, times in zip(*[rows.column(c).to_pylist() for c in rows.column_names]):
        terms = found.setdefault(tuple(key), {})
        if term is not None:
            terms[term] = times
    return found


class _Ranked:
    """The k best chunks of each question so far, by rounded score, document and ordinal."""

    def __init__(self, k: int):
        self.k = k
        self.q, self.s = np.zeros(0, np.int64), np.zeros(0)
        self.doc, self.ordinal = np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, s: np.ndarray, doc: np.ndarray, ordinal: np.ndarray) -> None:
        """Scores (chunks, questions) of chunks that are in order of document and ordinal."""
        r = np.round(s, 9)
        k = min(self.k, len(r))
        least = np.partition(r, len(r) - k, axis=0)[len(r) - k]
        over, tie = r > least, r == least
        i, q = np.nonzero(over | (tie & (np.cumsum(tie, axis=0) <= k - over.sum(0))))
        q, s = np.concatenate([self.q, q]), np.concatenate([self.s, s[i, q]])
        doc, ordinal = np.concatenate([self.doc, doc[i]]), np.concatenate([self.ordinal, ordinal[i]])
        order = np.lexsort((ordinal, np.unique(doc, return_inverse=True)[1], -np.round(s, 9), q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        self.q, self.s, self.doc, self.ordinal = q[order], s[order], doc[order], ordinal[order]


def bm25(chunks: DataFrame, questions: DataFrame, k: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The key columns `by`, document_id, ordinal, score, rank: Okapi BM25 of every question (by, text) over all chunks.

    A negative idf becomes EPSILON times the mean idf. Repeated query tokens count repeatedly. Zero and negative scores are still returned:
    a question with fewer than k chunks above zero is filled from the others in order. Ties by (document_id, ordinal), on scores rounded to 9 digits.
    A null text has no token. No chunks, no rows.

    Two passes over the texts: one for the statistics, of which only the counts of each document frequency and of the questions' tokens reach
    the driver, one for the scores. There the stated questions are a matrix of tokens by questions, in blocks of QUESTIONS; a batch of chunks is a matrix of
    token weights, their product the scores. Only k rows per question and partition leave it: neither texts nor postings are shuffled.
    """
    spark = chunks.sparkSession
    kinds = dict(questions.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", document_id string, ordinal int, score double"
    found = _asked_terms(questions, by)
    words = sorted({t for terms in found.values() for t in terms})
    known = F.broadcast(spark.createDataFrame([(t,) for t in words], "own string"))  # the tokens of the stated questions
    stats = term_stats(chunks).join(known, F.col("term") == F.col("own"), "left")
    counted = stats.groupBy("own", F.col("term").isNull().alias("whole"), "df").agg(F.count("*").alias("terms"), F.sum("length").alias("length")).collect()
    n, length = next(((r["df"], r["length"]) for r in counted if r["whole"]), (0, 0))
    raw = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    vocabulary = sum(r["terms"] for r in counted if not r["whole"])
    floor = EPSILON * sum(r["terms"] * raw(r["df"]) for r in counted if not r["whole"]) / max(vocabulary, 1)
    mean = length / max(n, 1) or 1.0
    idf = {r["own"]: floor if raw(r["df"]) < 0 else raw(r["df"]) for r in counted if r["own"] is not None}
    keys = sorted(found, key=str)
    tokens = chunks.select("document_id", F.col("ordinal").cast("int").alias("ordinal"), F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    out = spark.createDataFrame([], schema)
    for at in range(0, len(keys), QUESTIONS):
        some = keys[at : at + QUESTIONS]
        terms = sorted({t for q in some for t in found[q] if t in idf})
        place = {t: i for i, t in enumerate(terms)}
        weight = np.zeros((len(terms), len(some)))
        for j, q in enumerate(some):
            for t, times in found[q].items():
                if t in place:
                    weight[place[t], j] = times * idf[t]
        shared = spark.sparkContext.broadcast((terms, weight, some))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, weight, some = shared.value
            listed, best = pa.array(terms, pa.string()), _Ranked(k)
            for b in batches:
                b = b.take(pc.sort_indices(b, [("document_id", "ascending"), ("ordinal", "ascending")]))
                doc = np.array([d or "" for d in b.column("document_id").to_pylist()], object)
                ordinal = b.column("ordinal").fill_null(-1).to_numpy().astype(np.int64)
                size = np.diff(b.column("t").offsets.to_numpy())
                which = pc.index_in(b.column("t").flatten(), listed).fill_null(-1).to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(b)), size)[which >= 0]
                which = which[which >= 0]
                for s in range(0, len(b), STRIPE):
                    e = min(s + STRIPE, len(b))
                    lo, hi = np.searchsorted(row, (s, e))
                    tf = np.bincount((row[lo:hi] - s) * len(terms) + which[lo:hi], minlength=(e - s) * len(terms)).reshape(e - s, len(terms)).astype(np.float64)
                    tf *= (K1 + 1) / (tf + K1 * (1 - B + B * size[s:e, None] / mean))
                    best.add(tf @ weight, doc[s:e], ordinal[s:e])
            keyed = list(zip(*[some[q] for q in best.q])) or [()] * len(by)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(keyed, arrow)], pa.array(best.doc, pa.string()), pa.array(best.ordinal, pa.int32()), pa.array(best.s)], schema=arrow)

        arrow = pa.schema([(c, _ARROW[kinds[c]]) for c in by] + [("document_id", pa.string()), ("ordinal", pa.int32()), ("score", pa.float64())])
        out = out.unionByName(tokens.mapInArrow(run, schema))
    return top(out, k, by)


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each query by (rounded score, document_id, ordinal), with their rank."""
    best = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "document_id", "ordinal")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the lists that are a direction (no null, no infinite number, not all zero), and the lists' sizes."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    full = ~np.asarray(column.is_null())
    sizes = np.where(full, sizes, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    norm = np.sqrt(np.bincount(row, flat * flat, len(sizes)))
    return np.flatnonzero(np.isfinite(norm) & (norm > 0)), sizes


def _directions(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_group(b: pa.RecordBatch, column: str) -> Iterator[tuple[tuple, np.ndarray, int]]:
    """((run_id, model, size), rows, size) of the vectors of a batch that are a direction."""
    rows, sizes = _unit_rows(b.column(column))
    groups: dict[tuple, list[int]] = {}
    runs, models = b.column("run_id").to_pylist(), b.column("model").to_pylist()
    for r in rows.tolist():
        groups.setdefault((runs[r], models[r], int(sizes[r])), []).append(r)
    for g, of in groups.items():
        yield g, np.array(of), g[2]


class _Best:
    """The k best vectors of each of the queries of a group so far: similarity to 6 digits, then id; each id once. least: the k-th similarity, where there is one."""

    def __init__(self, queries: int, k: int):
        self.k, self.q = k, np.zeros(0, np.int64)
        self.id, self.s, self.least = np.zeros(0, np.int64), np.zeros(0), np.full(queries, -np.inf)

    def add(self, ids: np.ndarray, s: np.ndarray, own: np.ndarray) -> None:
        """ids, in order and their similarities s (ids, queries) to the queries whose ids are `own`."""
        at = np.searchsorted(ids, own)  # ids are in order
        same = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == own)
        s[at[same], same] = -np.inf
        k = min(self.k, len(ids))
        # What is surely not among the k best, of this batch or so far, is left out before anything is rounded.
        least = np.maximum(np.partition(s, len(ids) - k, axis=0)[len(ids) - k], self.least) - 2e-6
        i, q = np.nonzero((s >= least) & (s > -np.inf))
        q, new, s = np.concatenate([self.q, q]), np.concatenate([self.id, ids[i]]), np.concatenate([self.s, s[i, q]])
        order = np.lexsort((new, -np.round(s, 6), q))
        q, new, s = q[order], new[order], s[order]
        _, first = np.unique(np.stack([q, new]), axis=1, return_index=True)
        first.sort()
        q, new, s = q[first], new[first], s[first]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.id, self.s = q[keep], new[keep], s[keep]
        full = np.flatnonzero(np.bincount(self.q, minlength=len(own)) == self.k)
        self.least[full] = self.s[np.searchsorted(self.q, full, "right") - 1]


def query_blocks(queries: DataFrame) -> list[list[tuple[tuple, np.ndarray, np.ndarray]]]:
    """The stated queries as matrices of at most QUERY_NUMBERS numbers: ((run_id, model, size), ids, directions) by group."""
    parts: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
    for b in queries.select("query_id", "run_id", "model", F.col("query").cast("array<float>").alias("query")).dropDuplicates(["query_id"]).toArrow().to_batches():
        for g, rows, size in _by_group(b, "query"):
            parts.setdefault(g, []).append((b.column("query_id").to_numpy()[rows], _directions(b.column("query"), rows, size)))
    blocks: list[list] = [[]]
    room = QUERY_NUMBERS
    for g, of in sorted(parts.items(), key=lambda x: str(x[0])):
        ids, x = np.concatenate([i for i, _ in of]), np.concatenate([m for _, m in of])
        step = max(1, QUERY_NUMBERS // g[2])
        for s in range(0, len(ids), step):
            if room < len(ids[s : s + step]) * g[2]:
                blocks.append([])
                room = QUERY_NUMBERS
            blocks[-1].append((g, ids[s : s + step], x[s : s + step]))
            room -= len(ids[s : s + step]) * g[2]
    return [b for b in blocks if b]


def _scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of every partition the k best of each query, in blocks of queries.

    A partition's vectors meet a block as one matrix product a batch; only k rows per query and partition leave it.
    """
    rows = vectors.select("vec_id", "run_id", "model", F.col("vector").cast("array<float>").alias("vector"))
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for block in query_blocks(queries):
        shared = vectors.sparkSession.sparkContext.broadcast({g: [(i, x) for h, i, x in block if h == g] for g, _, _ in block})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {g: [_Best(len(i), k) for i, _ in of] for g, of in shared.value.items()}
            for b in batches:
                for g, at, size in _by_group(b, "vector"):
                    ids, first = np.unique(b.column("vec_id").to_numpy()[at], return_index=True)
                    at, x = at[first], None
                    for (own, q), state in zip(shared.value.get(g, ()), best.get(g, ())):
                        x = _directions(b.column("vector"), at, size) if x is None else x
                        step = max(16, SCORES // max(len(own), 1))
                        for s in range(0, len(ids), step):
                            state.add(ids[s : s + step], x[s : s + step] @ q.T, own)
            for g, of in shared.value.items():
                for (own, _), state in zip(of, best[g]):
                    yield pa.RecordBatch.from_arrays([pa.array(own[state.q]), pa.array(state.id), pa.array(state.s)], ["query_id", "vec_id", "score"])

        out = out.unionByName(rows.mapInArrow(run, "query_id long, vec_id long, score double"))
    return out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, score, rank: exact cosine of every query vector (query_id, run_id, model, query) against all vectors
    (vec_id, run_id, model, vector) of its run and model. A vector is no hit of its own id; repeated vec_ids count once. Vectors of another size than the
    query's, and null, empty, infinite or all-zero ones take no part. Ties on 6 digits by vec_id. Empty input, no rows.

    The stated queries are sent to the vectors in blocks of bounded size; no vector is shuffled.
    """
    best = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "vec_id")
    return _scan(vectors, queries, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def index_vectors(vectors: DataFrame, chunks: DataFrame, run_id: str | None = None, model: str | None = None) -> DataFrame:
    """Vectors (run_id, document_id, ordinal, model, ...) with page, end_page and text of their chunk; of one run and model if given.

    Vectors whose chunk is gone have no row. No chunks, or none with a vector, is an error: the run was not embedded.
    """
    held = chunks if run_id is None else chunks.where(F.col("run_id") == run_id)
    some = vectors if run_id is None else vectors.where(F.col("run_id") == run_id)
    some = some if model is None else some.where(F.col("model") == model)
    if not held.limit(1).count():
        raise LookupError(f"no chunks to index: run {run_id}")
    rest = [c for c in some.columns if c not in ("page", "end_page", "text")]
    joined = some.select(*rest).join(held.select("run_id", "document_id", "ordinal", "page", "end_page", "text"), ["run_id", "document_id", "ordinal"])
    if not joined.limit(1).count():
        raise LookupError(f"no vectors of these chunks: run {run_id}, model {model}")
    return joined


def index_summary(index: DataFrame) -> DataFrame:
    """run_id, model, vectors, documents of an index."""
    return index.groupBy("run_id", "model").agg(F.count("*").alias("vectors"), F.count_distinct("document_id").alias("documents"))


def fuse(arms: list[DataFrame], key: list[str], limit: int = 5, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked arms (query_id, key columns, rank). Ties keep the order of first appearance, arm by arm."""
    parts = [a.select("query_id", *key, "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    scored = union.groupBy("query_id", *key).agg(F.sum(1 / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("_first"))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "_first")
    return scored.withColumn("fused_rank", F.row_number().over(best)).where(F.col("fused_rank") <= limit).drop("_first")


def compare(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """query_id, overlap (hits in both arms), agreed (equal first hit), by query of either arm."""
    both = first.select("query_id", *key, F.col("rank").alias("_a")).join(second.select("query_id", *key, F.col("rank").alias("_b")), ["query_id", *key], "full")
    return both.groupBy("query_id").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"), F.coalesce(F.max((F.col("_a") == 1) & (F.col("_b") == 1)), F.lit(False)).alias("agreed"))


def disagreeing(compared: DataFrame) -> DataFrame:
    """Probes, disagreeing (their first hits differ), mean overlap, of compare()."""
    return compared.agg(F.count("*").alias("probes"), F.count_if(~F.col("agreed")).alias("disagreeing"), F.avg("overlap").alias("overlap"))


def gate(questions: DataFrame, hits: DataFrame, floor: float = FLOOR) -> DataFrame:
    """query_id, top_score (0 without hits), refused."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("_s"))
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("_s", F.lit(0.0)).alias("top_score"), F.coalesce(F.col("_s") < floor, F.lit(True)).alias("refused"))


def context(hits: DataFrame, chunks: DataFrame, length: int = 1200) -> DataFrame:
    """query_id, context: the hits' extracts in rank order, each text cut to `length`; k rows per query at most are gathered."""
    rows = hits.join(chunks.select("document_id", "ordinal", "page", "text"), ["document_id", "ordinal"])
    part = F.struct("rank", T.extract(F.col("document_id"), F.col("page"), F.substring("text", 1, length)).alias("x"))
    joined = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return joined.select("query_id", F.coalesce(F.nullif(F.array_join(F.transform("p", lambda s: s["x"]), "\n\n"), F.lit("")), F.lit("(no passages retrieved)")).alias("context"))
