"""Search inside an archive: hits joined to pages and posts, stale ones dropped, with fixed-column snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.operators import search
from pagestrata.operators.text_index import TextIndex
from pagestrata.sources.tables import settle

LIMIT, SNIPPET_WORDS = 30, 12


def _best(texts: DataFrame, key: str, words: str, columns: tuple[str, ...], body: str, limit: int, kept: TextIndex | None) -> tuple[DataFrame, DataFrame]:
    """The best hits of words in columns of texts, found by a kept index of them if there is one; and the same with a snippet of body, which is read for these hits only."""
    weights = dict.fromkeys(columns, 1)
    hits = search.search(texts, words, weights).select(key, "score") if kept is None else kept.search(words, weights)
    # at most limit rows, which are met several times: the search runs once
    best = settle(hits.orderBy("score", key).limit(limit))
    phrases = search.query_words(words)
    shown = F.lit("")
    if phrases:
        # a text that is hit in other columns only shows its beginning
        shown = F.coalesce(search.best_snippet([F.col(body)], phrases, SNIPPET_WORDS, ("", "")), search.snippet(F.col(body), phrases[0], SNIPPET_WORDS, ("", "")))
    return best, _of_best(texts, best, key).join(F.broadcast(best), key).select(key, "score", shown.alias("snippet"))


def _of_best(rows: DataFrame, best: DataFrame, key: str) -> DataFrame:
    """Rows of the best hits: a semi-join reaches the scan, so nothing else is read as HTML or dealt."""
    return rows.join(F.broadcast(best.select(key)), key, "left_semi")


def page_results(texts: DataFrame, pages: DataFrame, words: str, limit: int = LIMIT, kept: TextIndex | None = None) -> DataFrame:
    """(page_id, title, norm, snippet, score): the best pages, best first; hits without a page are dropped after the limit, blank words find nothing."""
    found, best = _best(texts, "page_id", words, ("title", "body"), "body", limit, kept)
    return best.join(_of_best(pages.select("page_id", "title", "norm"), found, "page_id"), "page_id").orderBy("score", "page_id")


def post_results(texts: DataFrame, posts: DataFrame, pages: DataFrame, words: str, limit: int = LIMIT, kept: TextIndex | None = None) -> DataFrame:
    """(post_id, page_id, author, thread, norm, snippet, score): the best posts, by author, thread, URL and body."""
    _, best = _best(texts, "post_id", words, ("author", "thread", "url", "body"), "body", limit, kept)
    return best.join(posts.select("post_id", "page_id", "author", "thread"), "post_id").join(pages.select("page_id", "norm"), "page_id").orderBy("score", "post_id")
