"""Live sources: category pages and word associations behind an injectable opener, with retries; levels are fetched in parallel."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tries, and the longest waits in seconds, as asked for by a server and of our own.
TRIES, MOST_ASKED, MOST_OWN = 5, 60.0, 30.0
Reply = tuple[int, dict, str]


class FetchError(RuntimeError):
    """A source that did not answer; the message has its host only."""


def urllib_sender(agent: str, timeout: float = 30.0) -> Callable[[str], Reply]:
    """Sends by the standard library; a reply that is no success is a reply too, and a network that fails is status 0."""

    def send(url: str) -> Reply:
        request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return reply.status, dict(reply.headers), reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), ""
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            return 0, {}, ""

    return send


def _is_json(body: str) -> bool:
    try:
        json.loads(body)
    except ValueError:
        return False
    return True


def retrying(send: Callable[[str], Reply], sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """An opener over send(url) -> (status, headers, body): busy replies (429, 5xx, maxlag), a network that fails (0) and bodies that
    are no JSON are asked again, later each time."""

    def open_url(url: str) -> str:
        status = 0
        for i in range(TRIES):
            status, headers, body = send(url)
            busy = status in (0, 429) or status >= 500 or (status == 200 and not _is_json(body)) or '"code":"maxlag"' in body.replace(" ", "")
            if status == 200 and not busy:
                return body
            if not busy:
                break
            asked = str(headers.get("Retry-After", ""))
            if i + 1 < TRIES:
                sleep(min(float(asked), MOST_ASKED) if asked.isdigit() else min(2.0**i, MOST_OWN))
        raise FetchError(f"{urllib.parse.urlsplit(url).hostname} answered {status}")

    return open_url


def members_url(api: str, category: str, cursor: str | None = None) -> str:
    params = {"action": "query", "list": "categorymembers", "cmtitle": f"Category:{category}", "cmlimit": "500", "cmtype": "page|subcat", "format": "json", "maxlag": "5"}
    return f"{api}?{urllib.parse.urlencode(params | ({'cmcontinue': cursor} if cursor else {}))}"


def category_edges(spark: SparkSession, api: str, root: str, depth: int, opener: Callable[[str], str]) -> DataFrame:
    """(parent, ns, title) below a category: one round a level, its categories fetched by the tasks, pages followed to the last."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for parent in b["parent"]:
                cursor: str | None = None
                while True:
                    reply = json.loads(opener(members_url(api, parent, cursor)))
                    found = reply.get("query", {}).get("categorymembers", [])
                    yield pd.DataFrame({"parent": parent, "ns": [m["ns"] for m in found], "title": [m["title"].split(":", 1)[1] if m["ns"] == 14 else m["title"] for m in found]}).astype({"ns": "int32"})
                    cursor = reply.get("continue", {}).get("cmcontinue")
                    if not cursor:
                        break

    level = spark.createDataFrame([(root,)], "parent string")
    seen, edges = level, None
    for _ in range(depth + 1):
        # A level is fetched once: replies are paid for, so they are held while the next level is found.
        got = level.mapInPandas(fetch, "parent string, ns int, title string").persist()
        edges = got if edges is None else edges.unionByName(got)
        level = got.where("ns = 14").select(F.col("title").alias("parent")).distinct().join(seen, "parent", "left_anti")
        seen = seen.unionByName(level)
    return edges


def association_pairs(spark: SparkSession, api: str, seeds: list[str], opener: Callable[[str], str], most: int = 100) -> DataFrame:
    """(seed, word, score) of every seed."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["seed"]:
                found = json.loads(opener(f"{api}?{urllib.parse.urlencode({'rel_trg': s, 'max': most})}"))
                yield pd.DataFrame({"seed": s, "word": [x["word"] for x in found], "score": [int(x.get("score", 0)) for x in found]})

    return spark.createDataFrame([(s,) for s in seeds], "seed string").mapInPandas(fetch, "seed string, word string, score long")
