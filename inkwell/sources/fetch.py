"""Fetching pages with a pluggable transport: retries, waits, reason codes (SRC3)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tries, and the longest wait between two of them, in seconds.
TRIES, LONGEST_WAIT = 3, 60.0


@dataclass
class Reply:
    """What a transport gives: a status, a body, and how long it asks to wait."""

    status: int
    body: str = ""
    headers: dict[str, str] = field(default_factory=dict)


Transport = Callable[[str], Reply]


def wait_after(reply: Reply | None, attempt: int) -> float:
    """Seconds to wait: what the reply asks for, else twice as long each time, never over LONGEST_WAIT."""
    asked = (reply.headers.get("Retry-After") if reply else None) or ""
    return min(LONGEST_WAIT, float(asked) if asked.isdigit() else float(2**attempt))


def fetch_one(paper_id: str, get: Transport, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """(reason, html): ok, not_found, http_<status> or failed; only busy or broken servers are asked again."""
    reply, reason = None, "failed"
    for attempt in range(TRIES):
        try:
            reply = get(paper_id)
        except OSError:
            reply, reason = None, "failed"
        else:
            if reply.status == 200:
                return "ok", reply.body
            reason = "not_found" if reply.status == 404 else f"http_{reply.status}"
            if reply.status != 429 and reply.status < 500:
                return reason, None
        if attempt + 1 < TRIES:
            sleep(wait_after(reply, attempt))
    return reason, None


def fetch_pages(papers: DataFrame, make: Callable[[], Transport], known: DataFrame | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(paper_id, status, html) for papers: pages that are `known` (paper_id, html) come from there, others by a transport made once for each task."""
    schema = "paper_id string, status string, html string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make()
        for frame in frames:
            yield pd.DataFrame([(p, *fetch_one(p, get, sleep)) for p in frame["paper_id"]], columns=["paper_id", "status", "html"])

    wanted = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct()
    if known is None:
        return wanted.mapInPandas(run, schema)
    cached = wanted.join(known.select("paper_id", "html"), "paper_id").select("paper_id", F.lit("cached").alias("status"), "html")
    return cached.unionByName(wanted.join(known.select("paper_id"), "paper_id", "left_anti").mapInPandas(run, schema))
