"""Connectors to remote collections.

The transport is a function the caller gives (url or query in, bytes or rows out), so that
everything but the network is here and testable: paging, exclusion, caps, rate limits,
landing, tickets.  Results become tables; nothing else in the library talks to a network.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .articles import descriptor_id, exists
from .seed_terms import seed_terms


@dataclass
class RateLimiter:
    """At most ``rate`` calls a second."""

    rate: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _last: float = field(default=float("-inf"))

    def wait(self) -> None:
        left = self._last + 1 / self.rate - self.clock()
        if left > 0:
            self.sleep(left)
        self._last = self.clock()


def search(page: Callable[[str, int, int], list[str]], query: str, most: int = 2000, exclude: Iterable[str] = (), page_size: int = 500) -> list[str]:
    """Ids of an open-access search, page by page, without the excluded ones, ``most`` at most."""
    out: list[str] = []
    gone, start = set(exclude), 0
    while len(out) < most:
        ids = page(f"({query}) AND open access[filter]", start, page_size)
        out += [str(i) for i in ids if str(i) not in gone]
        if len(ids) < page_size:
            break
        start += page_size
    return out[:most]


def land(fetch: Callable[[str], bytes], ids: Iterable[str], folder: str, most: int = 1000, limiter: RateLimiter | None = None) -> list[str]:
    """Files of articles, fetched where absent; ids that fail are left out."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for i in list(ids)[:most]:
        path = os.path.join(folder, f"{i}.xml")
        if not os.path.exists(path):
            if limiter:
                limiter.wait()
            try:
                content = fetch(i)
            except OSError:
                continue
            with open(f"{path}.part", "wb") as f:
                f.write(content)
            os.replace(f"{path}.part", path)
        out.append(path)
    return out


def related(link: Callable[[list[str]], list[str]], seed: Iterable[str], most: int = 1000, batch: int = 50) -> list[str]:
    """The seed and what it links to, asked for in batches until ``most`` are known; sorted, then cut."""
    seed = [str(s) for s in seed]
    known = set(seed)
    for k in range(0, len(seed), batch):
        if len(known) >= most:
            break
        known |= {str(x) for x in link(seed[k : k + batch])}
    return sorted(known)[:most]


def not_landed(ids: DataFrame, landed: DataFrame, key: str = "id") -> DataFrame:
    return ids.join(landed.select(key), key, "left_anti")


def terms_table(spark: SparkSession, records: Iterable[tuple[str, list[str]]], least: int = 3) -> DataFrame:
    """(term, concept_id) of records (uid, names): lower case, ``least`` characters or more."""
    rows = spark.createDataFrame([(str(u), list(n)) for u, n in records], "uid string, names array<string>")
    concept = F.concat(F.lit("D"), F.lpad(F.regexp_replace("uid", r"\D", ""), 6, "0"))
    long_id = F.when(F.char_length(F.regexp_replace("uid", r"\D", "")) > 6, F.concat(F.lit("D"), F.regexp_replace("uid", r"\D", ""))).otherwise(concept)
    named = rows.select(long_id.alias("concept_id"), F.explode("names").alias("term"))
    return named.where(F.char_length("term") >= least).select(F.lower("term").alias("term"), "concept_id").distinct()


def term_records(page: Callable[[list[str]], dict[str, object]], ids: Iterable[str], batch: int = 100, least: int = 3, limiter: RateLimiter | None = None) -> list[tuple[str, list[str]]]:
    """Records (uid, names) of summaries asked for in batches; a batch that fails is left out.

    Names of a list need ``least`` characters; a single name is taken as it is.
    """
    out: list[tuple[str, list[str]]] = []
    ids = [str(i) for i in ids]
    for k in range(0, len(ids), batch):
        if limiter:
            limiter.wait()
        try:
            found = page(ids[k : k + batch])
        except (OSError, ValueError):
            continue
        for uid in ids[k : k + batch]:
            names = found.get(uid) or []
            names = [names] if isinstance(names, str) else [n for n in names if n and len(n) >= least]
            out.append((uid, names))
    return [r for r in out if r[1]]


def load_terms(spark: SparkSession, cache: str, fetch: Callable[[], list[tuple[str, list[str]]]] | None = None) -> DataFrame:
    """(term, concept_id): the cached table if it has rows, else what ``fetch`` brings, else the seed
    terms; what was found is cached."""
    if exists(spark, cache):
        rows = spark.read.schema("term string, concept_id string").json(cache)
        if not rows.isEmpty():
            return rows
    try:
        records = fetch() if fetch else []
    except OSError:
        records = []
    terms = terms_table(spark, records, 1) if records else seed_terms(spark)
    terms.select("term", "concept_id").write.mode("overwrite").json(cache)
    return spark.read.schema("term string, concept_id string").json(cache)


class ConceptClient:
    """Searches a concept service: a ticket for granting tickets, one ticket a call, paced calls."""

    def __init__(self, post: Callable[[str, dict], str], get: Callable[[str, dict], dict], key: str, base: str, rate: float = 20):
        self.post, self.get, self.key, self.base = post, get, key, base
        self.limiter, self._granting = RateLimiter(rate), None

    def granting_ticket(self) -> str:
        if self._granting is None:
            self.limiter.wait()
            page = self.post(f"{self.base}/cas/v1/api-key", {"apikey": self.key})
            if 'action="' not in page:
                raise ConnectionError("no ticket was granted")
            self._granting = page.split('action="', 1)[1].split('"', 1)[0]
        return self._granting

    def ticket(self) -> str:
        self.limiter.wait()
        return self.post(self.granting_ticket(), {"service": self.base})

    def forget(self) -> None:
        self._granting = None

    def _results(self, path: str, **params: object) -> list[dict]:
        self.limiter.wait()
        result = self.get(f"{self.base}{path}", {**params, "ticket": self.ticket()}).get("result", [])
        return result.get("results", []) if isinstance(result, dict) else result

    def concepts(self, text: str, most: int = 25) -> list[dict]:
        found = self._results("/rest/search/current", string=text, pageSize=most)
        return [{k: r.get(k, "") for k in ("ui", "name", "rootSource")} for r in found if r.get("ui") != "NONE"]

    def relations(self, concept: str) -> list[dict]:
        return [{k: r.get(k, "") for k in ("relatedIdName", "relationLabel", "relatedId")} for r in self._results(f"/rest/content/current/CUI/{concept}/relations")]


__all__ = ["ConceptClient", "RateLimiter", "descriptor_id", "land", "load_terms", "not_landed", "related", "search", "term_records", "terms_table"]
