"""Hybrid retrieval for a batch of prompts, as one lazy plan."""

from __future__ import annotations

import array
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import description_line, exact_name, intent_tags, lexical_share, search_tokens, token_estimate, type_priority
from quillon.functions.vectors import cosine, l2, l2_to_cosine, recency
from quillon.operators import ranking
from quillon.operators.graph import proximity

#: Okapi constants of the lexical ranker.
K1, B = ranking.K1, ranking.B


@dataclass(frozen=True)
class Scoring:
    """Weights and settings of retrieval."""

    vector: float = 0.40
    graph: float = 0.15
    recency: float = 0.10
    type: float = 0.10
    project: float = 0.05
    lexical: float = 0.20
    fusion: str = "weighted_rrf"
    rrf_k: int = 60
    rrf_bm25: float = 0.75
    rrf_vector: float = 0.25
    lead: float = 0.85
    penalty: float = 0.85
    boost: float = 1.25
    k: int = 5
    budget: int = 800
    mmr: float = 0.7
    relations: tuple[str, ...] = field(default=("applies_to", "co_occurs_with", "supersedes", "derived_from"))


#: What ends a line of a text, \r\n as one.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Terms of prompts that are sent to every task as a set; of more, all terms of the documents are shuffled.
MOST_TERMS = 20_000
#: Vectors and queries of one block of an exact search.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Queries that are sent to every task where the result is all pairs, pairs of one batch of them, and pieces of text whose words are kept.
HELD, PAIRS, PIECES = 100_000, 1 << 18, 300_000
#: Hits that go to every task which reads texts; of more, what is shown of all texts is shuffled.
MOST_HITS = 500_000


def bm25(docs: DataFrame, prompts: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, id, score) of documents (id, text) for prompts (qid, prompt); with k, of each prompt at least the k best, as `top` ranks them.

    With k no pair of a prompt and a document is shuffled, and no word, while the prompts' terms fit a task. Else texts are searched for the
    prompts' terms only, where these are few enough for a set in every task; their counts come out of one row for each document.
    """
    wanted = prompts.select("qid", F.explode(F.array_distinct(search_tokens(F.col("prompt")))).alias("term"))
    if k is not None:
        held = wanted.select(F.col("qid").cast("long").alias("qid"), "term").distinct().limit(ranking.MOST_WANTED + 1).toArrow()
        if held.num_rows <= ranking.MOST_WANTED:
            counts, n, mean = ranking.counted(docs, pc.unique(held["term"]))
            return ranking.best(docs, held, counts, n, mean, k, texts=True)
    few = [r["term"] for r in wanted.select("term").distinct().limit(MOST_TERMS + 1).collect()]  # at most MOST_TERMS + 1 words
    words = F.coalesce(search_tokens(F.col("text")), F.array().cast("array<string>"))
    sized = docs.select("id", words.alias("w")).select("id", F.size("w").alias("dl"), (F.filter("w", lambda x: x.isin(*few)) if 0 < len(few) <= MOST_TERMS else F.col("w")).alias("w"))
    counts = term_counts(sized, None)
    stats = counts.where("term = ''").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("mean"))  # one row, or none without documents
    df = counts.where("term <> ''").select("term", "df")
    tf = sized.select("id", "dl", F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    joined = tf.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(stats))  # stats is one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    return joined.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def term_counts(docs: DataFrame, said: DataFrame | None) -> DataFrame:
    """(term, df, dl) over documents (dl, w), in one pass: the empty word, which is no term, stands once for each document.

    said: the terms to count (term), the empty word among them and ranking.MOST_WANTED others at most, or null if documents hold no others. Words
    meet them before they are counted, so that no other word is shuffled.
    """
    marked = docs.select("dl", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("w"))).alias("term"))
    marked = marked if said is None else marked.join(F.broadcast(said), "term", "left_semi")
    return marked.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))


def top(scored: DataFrame, k: int, score: str = "score", by: str = "qid", key: str = "id") -> DataFrame:
    """The first k rows of each query with their 0-based rank; scores are compared to nine digits, ties go to the smaller key."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, cosine, rank): exact nearest vectors (id, embedding) of queries (qid, vector).

    The queries are a stated set. Both sides are dealt into blocks, a pair of blocks is one task's matrix product, and
    only its k best of each query leave it, so neither side is broadcast.
    """
    nv, nq = (max(1, -(-df.count() // size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides' keys are ints: a long hashes to another partition than an int of the same value.
    left = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("e"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("v"), every(nq).alias("q"))
    right = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<float>").alias("e"), F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("q"), every(nv).alias("v"))

    def matrix(table: pa.Table) -> np.ndarray:
        x = pc.list_flatten(table.column("e").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if a.num_rows and b.num_rows:
            ids, x = a.column("id").to_numpy(), matrix(a)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            qids, y = b.column("qid").to_numpy(), matrix(b)
            for at in range(0, len(qids), 256):
                c = y[at : at + 256] @ x.T
                row, place = best_places(np.round(c, 9), k)
                out.append((qids[at + row], ids[place], c[row, place]))
        return pa.table(dict(zip(("qid", "id", "cosine"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    scored = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(product, "qid long, id long, cosine double")
    return top(scored, k, "cosine")


def best_places(value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the k largest values of each row of a matrix, ties to the smaller place; only those that reach the k-th are sorted."""
    value = np.where(np.isnan(value), -np.inf, value)
    n = value.shape[1]
    row, place = np.nonzero(value >= (np.partition(value, n - k, axis=1)[:, n - k, None] if n > k else -np.inf))
    order = np.lexsort((place, -value[row, place], row))
    row, place = row[order], place[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], place[first]


def every_pair(rows: DataFrame, queries: DataFrame, ready: Callable, kernel: Callable, schema: str) -> DataFrame | None:
    """kernel(batch of rows, ids of queries, ready(table of queries)) for all rows and HELD queries at most, in blocks of PAIRS pairs; null if there are more queries.

    The result is all pairs: its rows are yielded block by block where their row is read, so that neither memory nor shuffles follow them.
    """

    def ready_all(held: pa.Table) -> list[tuple]:
        blocks = [held.slice(q, QUERY_BLOCK).combine_chunks() for q in range(0, held.num_rows, QUERY_BLOCK)]
        return [(b.column("qid").to_numpy(), ready(b)) for b in blocks]

    def kernel_all(part: pa.RecordBatch, blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        return (kernel(part, qids, block) for qids, block in blocks)

    return every_row(rows, queries, ready_all, kernel_all, schema)


def every_row(rows: DataFrame, queries: DataFrame, ready: Callable, kernel: Callable, schema: str) -> DataFrame | None:
    """kernel(batch of rows, ready(table of all queries)), batch by batch, for HELD queries at most; null if there are more.

    A batch has so many rows that they make PAIRS pairs with a block of QUERY_BLOCK queries, or of all if these are fewer.
    """
    held = queries.limit(HELD + 1).toArrow()
    if held.num_rows > HELD:
        return None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, step = ready(held), max(1, PAIRS // max(1, min(QUERY_BLOCK, held.num_rows)))
        for part in parts:
            for at in range(0, part.num_rows, step):
                yield from kernel(part.slice(at, step), block)

    return rows.mapInArrow(run, schema)


def _sized(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of doubles) of the vectors of each size; null vectors have none."""
    lists = column.to_pylist()
    sizes = np.array([-1 if e is None else len(e) for e in lists], np.int64)
    return [(at, np.array([lists[i] for i in at], np.float64).reshape(len(at), n)) for n in np.unique(sizes[sizes >= 0]) for at in (np.flatnonzero(sizes == n),)]


def _pairs(qids: np.ndarray, ids: np.ndarray, value: np.ndarray, name: str, key: str = "id") -> pa.RecordBatch:
    """Rows of a matrix (queries, rows); NaN is null."""
    nq, n = value.shape
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.tile(ids, nq)), pa.array(value.ravel(), pa.float64(), from_pandas=True)], names=["qid", key, name])


def all_l2(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, id, cosine): every query (qid, vector) with every vector (id, embedding), the cosine by their distance.

    Where one is null or sizes differ it is 1, as in the scalar function and in SQL, whose `least` and `greatest` pass over null.
    """

    def ready(b: pa.Table) -> dict:
        return {x.shape[1]: (at, x) for at, x in _sized(b.column("vector"))}

    def kernel(a: pa.RecordBatch, qids: np.ndarray, other: dict) -> pa.RecordBatch:
        value = np.ones((len(qids), a.num_rows))
        for at, x in _sized(a.column("embedding")):
            if x.shape[1] in other:
                to, y = other[x.shape[1]]
                far = np.zeros((len(to), len(at)))
                for j in range(x.shape[1]):  # in order, as the scalar function adds
                    far += (x[:, j][None, :] - y[:, j][:, None]) ** 2
                value[np.ix_(to, at)] = np.clip(1 - far / 2, 0.0, 1.0)
        return _pairs(qids, a.column("id").to_numpy(), value, "cosine")

    e = lambda c: F.col(c).cast("array<double>").alias(c)
    v, q = vectors.select(F.col("id").cast("long").alias("id"), e("embedding")), queries.select(F.col("qid").cast("long").alias("qid"), e("vector"))
    made = every_pair(v, q, ready, kernel, "qid long, id long, cosine double")
    return made if made is not None else v.join(q, F.lit(True)).select("qid", "id", l2_to_cosine(l2(F.col("embedding"), F.col("vector"))).alias("cosine"))


def all_best_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, node_id, cosine): for every query (qid, vector), each qid once, the best cosine of every node's chunks (node_id, embedding).

    A node's chunks are brought together first, so a task has the best of a node without a shuffle of pairs. 0 where sizes differ or a norm is 0.
    """

    unit = lambda x: x / np.where((n := np.sqrt((x**2).sum(axis=1, keepdims=True))) == 0, 1, n)

    def ready(b: pa.Table) -> tuple:
        return pc.is_null(b.column("vector")).to_numpy(), {x.shape[1]: (at, unit(x)) for at, x in _sized(b.column("vector"))}

    def kernel(a: pa.RecordBatch, qids: np.ndarray, block: tuple) -> pa.RecordBatch:
        none, other = block
        lists = a.column("embeddings")
        node = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        flat = pc.list_flatten(lists)
        value = np.zeros((len(qids), len(flat)))
        value[:, pc.is_null(flat).to_numpy(zero_copy_only=False)] = np.nan
        value[none, :] = np.nan
        for at, x in _sized(flat):
            if x.shape[1] in other:
                to, y = other[x.shape[1]]
                value[np.ix_(to, at)] = y @ unit(x).T
        starts = np.searchsorted(node, np.arange(a.num_rows))
        return _pairs(qids, a.column("node_id").to_numpy(), np.fmax.reduceat(value, starts, axis=1), "cosine", "node_id")

    e = lambda c: F.col(c).cast("array<double>").alias(c)
    v, q = chunks.select(F.col("node_id").cast("long").alias("node_id"), e("embedding")), queries.select(F.col("qid").cast("long").alias("qid"), e("vector"))
    # A null is kept inside a struct: a list drops it.
    nodes = v.groupBy("node_id").agg(F.collect_list(F.struct("embedding")).alias("_e")).select("node_id", F.col("_e.embedding").alias("embeddings"))
    made = every_pair(nodes, q, ready, kernel, "qid long, node_id long, cosine double")
    return made if made is not None else best_chunk(v.join(q, F.lit(True)).select("qid", "node_id", cosine(F.col("embedding"), F.col("vector")).alias("cosine")))


def all_lexical(texts: DataFrame, prompts: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, id, lexical): the share of every prompt's words (qid, w) that stand anywhere in every text (id, text), to `digits` if given; both are in lower case.

    A text is read as its distinct runs of characters that words have, and such a piece passes one automaton of all prompts' words unless it is
    remembered. Prompts stand by their number of words: the k-th words of a block are one sum of rows of bytes over a block of texts, and a
    share is looked up by its count, rounded once for each count as Spark rounds.
    """

    def ready(held: pa.Table) -> tuple:
        lists = held.column("w").combine_chunks()
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        words = pc.unique(flat)
        code = pc.index_in(flat, value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.argsort(-size, kind="stable")
        size, first, qids = size[order], first[order], held.column("qid").to_numpy()[order]
        blocks = []
        for at in range(0, len(qids), QUERY_BLOCK):
            n, start = size[at : at + QUERY_BLOCK], first[at : at + QUERY_BLOCK]
            columns = [code[start[: np.searchsorted(-n, -k)] + k] for k in range(n[0])]  # the k-th word of the prompts that have one
            runs = np.append(np.flatnonzero(np.diff(n, prepend=-1)), len(n))  # prompts of one size
            blocks.append((qids[at : at + QUERY_BLOCK], columns, [(a, b, shares(int(n[a]))) for a, b in zip(runs[:-1], runs[1:], strict=True)]))
        return _finder(words.to_pylist()), len(words), blocks

    def shares(n: int) -> np.ndarray:
        made = [k / max(n, 1) for k in range(n + 1)]
        return np.array(made if digits is None else [float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for x in made])

    def kernel(a: pa.RecordBatch, block: tuple) -> Iterator[pa.RecordBatch]:
        found, words, blocks = block
        ids = a.column("id").to_numpy()
        text, codes = found(a.column("text").to_pylist())
        place = np.zeros(words, np.int64)
        place[codes] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(1, len(used) + 1)
        there = np.zeros((len(used) + 1, len(ids)), np.uint8)  # the first row is of words that no text has
        there[place[codes], text] = 1
        for qids, columns, runs in blocks:
            count = np.zeros((len(qids), len(ids)), np.min_scalar_type(len(columns)))
            for column in columns:
                count[: len(column)] += there.take(place[column], axis=0)
            yield _pairs(qids, ids, np.concatenate([share[count[x:y]] for x, y, share in runs]), "lexical")

    t, p = texts.select(F.col("id").cast("long").alias("id"), "text"), prompts.select(F.col("qid").cast("long").alias("qid"), "w")
    made = every_row(t, p, ready, kernel, "qid long, id long, lexical double")
    share = lexical_share(F.col("w"), F.col("text"))
    return made if made is not None else t.join(p, F.lit(True)).select("qid", "id", (share if digits is None else F.round(share, digits)).alias("lexical"))


def _finder(words: list[str]) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    """Which of the words stand in texts, as places of texts and of words, repeats among them; the answers for at least the PIECES last pieces are kept.

    A piece is a run of characters that some word has, so marks around it don't make it another one.
    """
    import ahocorasick

    reader = ahocorasick.Automaton()
    for k, w in enumerate(words):
        if w:
            reader.add_word(w, k)
    least = min((len(w) for w in words if w), default=0)
    if not least:
        return lambda texts: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    reader.make_automaton()
    pieces = re.compile(f"[{''.join(map(re.escape, sorted(set().union(*words))))}]{{{least},}}").findall
    places: dict[str, int] = {}
    ends, held = array.array("q", [0]), array.array("i")

    def learn(piece: str) -> int:
        held.extend({k for _, k in reader.iter(piece)})
        ends.append(len(held))
        places[piece] = len(ends) - 2
        return len(ends) - 2

    def find(texts: list) -> tuple[np.ndarray, np.ndarray]:
        if len(places) > PIECES:
            places.clear()
            del ends[1:], held[:]
        rows, n = [], []
        for t in texts:
            own = set(pieces(t)) if t else ()
            rows += [places[x] if x in places else learn(x) for x in own]
            n.append(len(own))
        end, at = np.frombuffer(ends, np.int64), np.array(rows, np.int64)
        sizes = end[at + 1] - end[at]
        before = np.cumsum(sizes) - sizes
        code = np.frombuffer(held, np.int32)[np.arange(sizes.sum()) + np.repeat(end[at] - before, sizes)] if len(held) else np.zeros(0, np.int32)
        return np.repeat(np.repeat(np.arange(len(texts)), n), sizes), code

    return find


def best_chunk(scored: DataFrame) -> DataFrame:
    """The best cosine of each (qid, node_id)."""
    return scored.groupBy("qid", "node_id").agg(F.max("cosine").alias("cosine"))


def relevance(s: Scoring, vector: Column, lexical: Column, bm25_rank: Column, vec_rank: Column) -> Column:
    """Fusion of the two rankers into [0, vector + lexical weight]; a null rank: not a candidate."""
    band = s.vector + s.lexical
    if s.fusion == "bm25_lead":
        return F.lit(band) * (s.lead * F.coalesce(1.0 / (1.0 + bm25_rank), F.lit(0.0)) + (1 - s.lead) * F.greatest(F.lit(0.0), vector))
    if s.fusion == "weighted_sum":
        return s.vector * vector + s.lexical * lexical
    raw = F.coalesce(s.rrf_bm25 / (s.rrf_k + 1 + bm25_rank), F.lit(0.0)) + F.coalesce(s.rrf_vector / (s.rrf_k + 1 + vec_rank), F.lit(0.0))
    return F.lit(band) * raw / ((s.rrf_bm25 + s.rrf_vector) / (s.rrf_k + 1))


def out_of_scope(scope: list[str], project: Column, base: Column) -> Column:
    """Strict isolation: not base, has a project, and that is outside the scope."""
    return ~base & project.isNotNull() & ~project.isin(*scope) if scope else F.lit(False)


def mmr(pool: DataFrame, k: int, lam: float) -> DataFrame:
    """(qid, id, pick): maximal marginal relevance over pools (qid, id, score, rank, embedding) of at most max(2k, 20) rows.

    Greedy choice needs the earlier picks, so each query's small pool goes to one grouped call.
    """
    def choose(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank")
        ids, score = g["id"].tolist(), g["score"].to_numpy(float)
        if lam >= 1 or len(ids) <= k:
            picked = list(range(min(k, len(ids))))
        else:
            span = score.max() - score.min()
            rel = (score - score.min()) / span if span else np.ones(len(score))
            unit = [None if e is None else np.asarray(e, float) / (np.linalg.norm(e) or 1) for e in g["embedding"]]
            near, picked = np.zeros(len(ids)), []
            left = list(range(len(ids)))
            while left and len(picked) < k:
                best = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * near[i], -i))
                picked.append(best)
                left.remove(best)
                if unit[best] is not None:
                    for i in left:
                        if unit[i] is not None and len(unit[i]) == len(unit[best]):
                            near[i] = max(near[i], float(unit[i] @ unit[best]))
        return pd.DataFrame({"qid": g["qid"].iloc[0], "id": [ids[i] for i in picked], "pick": range(len(picked))})

    return pool.groupBy("qid").applyInPandas(choose, "qid long, id long, pick long")


def pack(hits: DataFrame, budget: int, line: Column, body: Column | None = None) -> DataFrame:
    """hits (qid, rank, ...) up to the first whose line overflows the budget; with_body marks the first where its body still fits.

    Only lines and numbers of tokens pass through the window. Without a body hits have its body_tokens, so that no text need be joined.
    """
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = hits.withColumn("line_tokens", token_estimate(line)).withColumn("used", F.sum("line_tokens").over(order))
    counted = counted if body is None else counted.withColumn("body_tokens", token_estimate(body))
    kept = counted.where(F.col("used") <= budget)  # running sums only grow: all before the first overflow
    total = F.max("used").over(Window.partitionBy("qid"))
    return kept.withColumn("with_body", (F.col("rank") == 0) & (total + F.col("body_tokens") <= budget))


def with_text(hits: DataFrame, most: int, texts: DataFrame, name: str, made: Column) -> DataFrame:
    """hits (id, ...), `most` at most, with a column that is made of their texts (id, body).

    Hits follow the prompts and texts the documents, so hits go to where texts are read: no text is shuffled, and the column is made for hits only.
    """
    if most <= MOST_HITS:
        return texts.select("id", "body").join(F.broadcast(hits), "id").withColumn(name, made).select(*hits.columns, name)
    return hits.join(texts.select("id", made.alias(name)), "id")


def block(hits: DataFrame, intents: Column, tokens: Column, title: str = "## Relevant memory", prefix: str = "ref", most: int = 400) -> DataFrame:
    """(qid, block): hits (qid, rank, id, type, name, description, body) as a block of text for a prompt.

    One line a hit, below it the first `most` characters of its body, indented, and a line with intents, tokens and the number of hits. A query
    without hits has no block. A query has at most as many hits as its k.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.trim(F.regexp_replace(text("description"), "\n", " "))
    line = F.concat(F.lit(f"- [{prefix}:"), F.col("id").cast("string"), F.lit("]"), F.when(text("type") != "", F.concat(F.lit(" ["), "type", F.lit("]"))).otherwise(""), F.when(text("name") != "", F.concat(F.lit(" "), "name")).otherwise(""), F.when(said != "", F.concat(F.lit(": "), said)).otherwise(""))
    cut = F.when(F.length(text("body")) <= most, text("body")).otherwise(F.concat(F.rtrim(F.substring(text("body"), 1, most), F.lit(" \t\n\x0b\x0c\r")), F.lit("...")))
    rows = F.split(F.regexp_replace(cut, LINE_ENDS, "\n"), "\n", -1)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, 1, F.size(rows) - 1)).otherwise(rows)
    whole = F.array_join(F.concat(F.array(line), F.transform(rows, lambda x: F.concat(F.lit("  "), x))), "\n")
    of = hits.select("qid", F.struct("rank", whole.alias("x")).alias("h")).groupBy("qid").agg(F.sort_array(F.collect_list("h")).alias("h"))
    tail = F.concat(F.lit("\n\nintent: "), intents, F.lit(" | tokens used: "), tokens.cast("string"), F.lit(" | k: "), F.size("h").cast("string"))
    return of.select("qid", F.concat(F.lit(f"{title}\n\n"), F.array_join("h.x", "\n"), tail).alias("block"))


def candidates(nodes: DataFrame, vectors: DataFrame, edges: DataFrame, prompts: DataFrame, now: int, scope: list[str], s: Scoring = Scoring(), lexical: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The candidates of both rankers and of the graph with their six components and score, for prompts (qid, prompt, vector).

    nodes: the node table with a long id; vectors: (id, embedding); edges: (src, dst, relation, weight). Bodies are read for the
    rankers only and not carried. lexical: a ranker that gives (qid, id, score) for (qid, prompt) with at least the k best, such as the
    `bm25` of a stored index; without one the bodies are ranked.
    """
    pool = max(2 * s.k, 40)
    asked = prompts.select("qid", "prompt")
    b = top(lexical(asked, pool) if lexical else bm25(nodes.select("id", F.col("body").alias("text")), asked, pool), pool).select("qid", "id", F.col("rank").alias("bm25_rank"))
    v = knn(vectors, prompts.where("vector IS NOT NULL").select("qid", "vector"), pool).select("qid", "id", F.col("rank").alias("vec_rank"), "cosine")
    g = proximity(edges, v.select("qid", "id", F.greatest(F.col("cosine"), F.lit(0.0)).alias("score")), relations=s.relations, by=("qid",))
    asked = prompts.select("qid", "prompt", intent_tags(F.coalesce("prompt", F.lit(""))).alias("_tags"))
    c = b.join(v, ["qid", "id"], "full_outer").join(g, ["qid", "id"], "full_outer").join(nodes.select("id", "type", "name", "project_key", "base", "local_only", "updated_at"), "id").join(asked, "qid")
    c = c.select(
        "qid", "id", "type", "name", "local_only", "bm25_rank", "vec_rank",
        F.coalesce("cosine", F.lit(0.0)).alias("vector"),
        F.when(F.col("vec_rank").isNull(), F.coalesce("graph", F.lit(0.0))).otherwise(F.lit(0.0)).alias("graph"),
        recency(F.col("updated_at"), now).alias("recency"),
        type_priority(F.col("_tags"), F.col("type")).alias("type_score"),
        F.when(F.col("project_key").isin(*scope), 1.0).otherwise(0.0).alias("project") if scope else F.lit(0.0).alias("project"),
        reciprocal_rank(F.lit(0.0), F.col("bm25_rank")).alias("lexical"),
        F.coalesce(out_of_scope(scope, F.col("project_key"), F.col("base")), F.lit(False)).alias("out"),
        F.coalesce(exact_name(F.col("name"), F.coalesce("prompt", F.lit(""))), F.lit(False)).alias("named"),
    )
    raw = relevance(s, F.col("vector"), F.col("lexical"), F.col("bm25_rank"), F.col("vec_rank")) + s.graph * F.col("graph") + s.recency * F.col("recency") + s.type * F.col("type_score") + s.project * F.col("project")
    held = F.when(F.col("out"), raw * s.penalty).otherwise(raw)
    return c.withColumn("score", F.when(F.col("named"), held * s.boost).otherwise(held))


def reciprocal_rank(share: Column, rank: Column) -> Column:
    """The lexical component: the larger of a substring share and 1 / (1 + rank), a null rank counting 0."""
    return F.greatest(share, F.coalesce(1.0 / (1.0 + rank), F.lit(0.0)))


def retrieved(nodes: DataFrame, vectors: DataFrame, edges: DataFrame, prompts: DataFrame, now: int, scope: list[str], s: Scoring = Scoring(), exclude_local_only: bool = True, prefix: str = "ref", lexical: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(qid, id, pick, score, line, used, with_body, excluded): the whole retrieval as one plan for any table of prompts.

    Ranked candidates lose rows that may not leave the machine (excluded: how many), a pool of max(2k, 20) is diversified to
    k, and lines are packed to the token budget; bodies are joined for what is left.
    """
    c = candidates(nodes, vectors, edges, prompts, now, scope, s, lexical).select("qid", "id", "type", "name", "local_only", "score")
    if exclude_local_only:
        lost = F.count_if(F.coalesce("local_only", F.lit(False))).over(Window.partitionBy("qid"))
        c = c.withColumn("excluded", lost).where(~F.coalesce("local_only", F.lit(False)))
    else:
        c = c.withColumn("excluded", F.lit(0).cast("long"))
    pool = top(c, max(2 * s.k, 20))
    if s.mmr >= 1:
        picked = pool.where(F.col("rank") < s.k).select("qid", "id", F.col("rank").cast("long").alias("pick"))
    else:
        picked = mmr(pool.select("qid", "id", "score", "rank").join(vectors.select("id", "embedding"), "id", "left").select("qid", "id", "score", "rank", "embedding"), s.k, s.mmr)
    hits = picked.join(pool.drop("rank"), ["qid", "id"]).join(nodes.select("id", "description" if "description" in nodes.columns else F.lit(None).cast("string").alias("description"), token_estimate(F.col("body")).alias("body_tokens")), "id")
    line = description_line(prefix, F.col("id"), F.col("type"), F.coalesce("description", "name"))
    packed = pack(hits.select("qid", "id", F.col("pick").alias("rank"), "score", "excluded", line.alias("line"), "body_tokens"), s.budget, F.col("line"))
    return packed.select("qid", "id", F.col("rank").alias("pick"), "score", "line", "used", "with_body", "excluded")
