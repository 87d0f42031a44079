"""The text lane: postings, overlap scores, top-k.

Frames: documents (doc_id, text); queries (query, query_text, top_k) where query is an ordinal, so
that repeated query ids stay apart; hits (query, rank, doc_id, score). doc_id is a string
throughout and orders by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(documents: DataFrame) -> DataFrame:
    """(token, doc_id), each pair once: no frequencies, no positions."""
    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).select("token", "doc_id")


def inverted(post: DataFrame) -> DataFrame:
    """(token, doc_ids sorted), the long form grouped. For export; scoring joins the long form, whose rows a frequent token can spread."""
    return post.groupBy("token").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def ranked(hits: DataFrame, k: Column | int | None, score: str = "score") -> DataFrame:
    """Per query the k best (None: all) by score, ties by doc_id; the limit is applied before and after the shuffle."""
    order = W.partitionBy("query").orderBy(F.desc(score), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(order))
    return hits if k is None else hits.where(F.col("rank") <= k)


def overlap_scores(queries: DataFrame, post: DataFrame) -> DataFrame:
    """(query, doc_id, score): query tokens that the document holds, counted as often as the query has them."""
    asked = queries.select("query", F.explode(tokens(F.col("query_text"))).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))
    return post.join(asked, "token").groupBy("query", "doc_id").agg(F.sum("times").alias("score"))


def search(queries: DataFrame, post: DataFrame, limit: int | None = None) -> DataFrame:
    """Hits of all queries in one job. limit: one for all; None takes each query's top_k. Documents of score 0 never appear.

    The postings of query tokens are shuffled once, to their documents, whatever the number of queries; what
    a document scores is then known where its tokens are.
    """
    table = _asked(queries)
    if table is None:
        scores = overlap_scores(queries, post)
        if limit is None:
            scores = scores.join(queries.select("query", "top_k"), "query")
            return ranked(scores, F.col("top_k")).select("query", "rank", "doc_id", "score")
        return ranked(scores, limit).select("query", "rank", "doc_id", "score")
    return _scan(queries, table, _gathered(table, post), limit)


def _gathered(table: pa.Table, post: DataFrame) -> DataFrame:
    """(doc_id, tokens): the query tokens of each document that the postings have under them."""
    words = post.sparkSession.createDataFrame(table.group_by("token").aggregate([]))
    held = post.where("doc_id is not null").join(F.broadcast(words), "token", "left_semi")
    return held.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.collect_set("token").alias("tokens"))


#: Query tokens that travel to every task at once; more queries are answered by the join with postings.
MOST_TOKENS = 2_000_000
#: Scores that a task holds at a time.
TILE = 1 << 22
#: Summands of scores that a task holds at a time, besides those of one token.
PAIRS = 1 << 20
_HITS = pa.schema([("query", pa.int64()), ("doc_id", pa.string()), ("score", pa.int64())])


def _asked(queries: DataFrame) -> pa.Table | None:
    """(query, token, times), or none if there are too many to travel."""
    asked = queries.select("query", F.explode(tokens(F.col("query_text"))).alias("token")).groupBy("query", "token").agg(F.count(F.lit(1)).alias("times"))
    table = asked.limit(MOST_TOKENS + 1).toArrow()
    return table if len(table) <= MOST_TOKENS else None


def search_documents(queries: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """As search(queries, postings(documents), limit), where documents are scanned anyway.

    A document's tokens lie in its row, so its scores need no shuffle: the query tokens (their number
    is checked) go to the scan, and each batch of documents passes on a query's k best alone.
    """
    table = _asked(queries)
    if table is None:
        return search(queries, postings(documents), limit)
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.array_distinct(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).alias("tokens"))
    return _scan(queries, table, rows.where("doc_id is not null"), limit)


def _scan(queries: DataFrame, table: pa.Table, rows: DataFrame, limit: int | None, every: bool = False) -> DataFrame:
    """Hits of the queries, whose tokens the table holds, over rows (doc_id, tokens, each once). every: without a limit."""
    ids, query = np.unique(np.asarray(table["query"], np.int64), return_inverse=True)
    tops = np.full(len(ids), limit or 0)
    if limit is None and not every:
        wanted = queries.select("query", "top_k").toArrow()
        known = np.searchsorted(ids, np.asarray(wanted["query"], np.int64))
        fits = known < len(ids)
        fits[fits] = ids[known[fits]] == np.asarray(wanted["query"], np.int64)[fits]
        tops[known[fits]] = np.asarray(wanted["top_k"], np.int64)[fits]
    words = {w: i for i, w in enumerate(dict.fromkeys(table["token"].to_pylist()))}
    word = np.array([words[w] for w in table["token"].to_pylist()], np.int64)
    order = np.argsort(word, kind="stable")
    query, times = query[order], np.asarray(table["times"], np.float64)[order]
    starts = np.searchsorted(word[order], np.arange(len(words) + 1))

    def scored(names: list[str], lists: pa.ListArray) -> pa.RecordBatch:
        coded = lists.flatten().dictionary_encode()
        code = np.array([words.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)[np.asarray(coded.indices, np.int64)]
        owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        owner, code = owner[code >= 0], code[code >= 0]
        many = starts[code + 1] - starts[code]
        scores = np.zeros(len(lists) * len(ids), np.float64)
        # a token may be asked for by all queries, so its scores are summed in runs of bounded size
        run = (np.cumsum(many) - many) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(many)]
        for a, b in zip(cuts, cuts[1:]):
            n = many[a:b]
            upto = np.cumsum(n)
            at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts[code[a:b]] - upto + n, n)
            place = np.repeat(owner[a:b] * len(ids), n) + query[at]
            low = int(owner[a]) * len(ids) if b > a else 0  # the documents of a run are neighbours
            part = np.bincount(place - low, times[at])
            scores[low : low + len(part)] += part
        scores = scores.reshape(len(lists), -1)
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for q, k in enumerate(tops.tolist()):
            near = np.flatnonzero(scores[:, q])
            if len(near) > k > 0 and not every:
                near = near[scores[near, q] >= np.partition(scores[near, q], len(near) - k)[len(near) - k]]
            near = near[np.lexsort((place[near], -scores[near, q]))][: None if every else k]
            out.append((int(ids[q]), near, scores[near, q]))
        found = [names[i] for _, near, _ in out for i in near.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in out], [len(n) for _, n, _ in out]), pa.int64()), pa.array(found, pa.string()), pa.array(np.concatenate([s for _, _, s in out]).astype(np.int64))], schema=_HITS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (TILE // 8 if every else TILE) // max(1, len(ids)))
        for batch in batches:
            for a in range(0, batch.num_rows if len(ids) else 0, step):
                part = batch.slice(a, step)
                # a list array of its own, whose offsets start at 0
                yield scored(part.column("doc_id").to_pylist(), pa.concat_arrays([part.column("tokens")]))

    hits = rows.mapInArrow(scan, "query long, doc_id string, score long")
    if limit is None and not every:
        return ranked(hits.join(F.broadcast(queries.select("query", "top_k")), "query"), F.col("top_k")).select("query", "rank", "doc_id", "score")
    return ranked(hits, limit).select("query", "rank", "doc_id", "score")


def search_all(queries: DataFrame, post: DataFrame) -> DataFrame:
    """Hits without a limit."""
    table = _asked(queries)
    if table is None:
        return ranked(overlap_scores(queries, post), None).select("query", "rank", "doc_id", "score")
    return _scan(queries, table, _gathered(table, post), None, every=True)


def first_query(queries: DataFrame, lane: str = "text") -> DataFrame:
    """The first query, in file and line order, that a lane is eligible for ("text" also takes hybrid ones)."""
    fits = F.col("lane_eligibility.text") | F.col("lane_eligibility.hybrid") if lane == "text" else F.col(f"lane_eligibility.{lane}")
    return queries.where(fits).orderBy("file", "query").limit(1)


def same_postings(a: DataFrame, b: DataFrame) -> bool:
    """Whether two posting tables hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
