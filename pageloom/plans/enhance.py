"""From prompts to the answers of a model that has read the pages found for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from pageloom.operators import search
from pageloom.session import stage


def enhance_prompts(
    prompts: DataFrame,
    pages: DataFrame,
    generated: Column,
    choose: Callable[[str], list[str]],
    open_model: Callable[[], Callable[[str], str]],
    limit: int = search.HITS_PER_QUERY,
    concurrency: int | None = None,
) -> DataFrame:
    """(prompt_id, prompt) and pages (url, html, reachable) to (prompt_id, status, failure_reason, answer)."""
    queries = search.expand_queries(prompts, generated)
    hits = stage(search.describe_hits(search.search_topk(queries, pages, limit), pages), "hits")
    messages = search.relevancy_message(prompts, queries, search.review_text(hits))
    # the model's choice is asked for once and then read by two steps
    picked = stage(search.ground_urls(search.relevant_urls(messages, choose), hits), "picked")
    scraped = search.scrape_pages(picked, pages)
    return search.summarise(search.assemble_context(prompts, scraped), open_model, concurrency)
