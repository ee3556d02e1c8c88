"""A paged service as a batch and streaming source that knows when to stop, and articles fetched by a policy."""

from __future__ import annotations

import datetime
import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..functions.text import host


def _mark(key: object) -> str:
    return hashlib.blake2b(str(key).encode(), digest_size=8).hexdigest()


def _date(value: object) -> datetime.date | None:
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    try:
        return datetime.date.fromisoformat(str(value)[:10])
    except ValueError:
        return None


@dataclass(frozen=True)
class Rules:
    """Where paging begins, how far a page is, and when it stops. ``key`` and ``date`` are places in a row."""

    key: int
    date: int | None = None
    start: int = 0
    step: int = 100
    max_pages: int = 1000
    max_links: int | None = None
    cutoff: datetime.date | None = None


@dataclass(frozen=True)
class Paging:
    """How far the paging of one site has come; small, so that a stream's offset can hold it.

    ``seen`` has a 64-bit mark of each key so far, at most ``max_links`` and a page of them.
    """

    offset: int
    pages: int = 0
    done: bool = False
    seen: list[str] = field(default_factory=list)

    def turned(self, rows: list[tuple], r: Rules) -> tuple[list[tuple], Paging]:
        """The new rows of the next page, and the state after it.

        It is the last if it is empty, has nothing new, reaches ``max_links`` or ``max_pages``, or holds a row before the cutoff;
        such rows themselves are left out.
        """
        known, fresh, oldest = set(self.seen), [], None
        for row in rows:
            day = _date(row[r.date]) if r.date is not None else None
            if day is not None:
                oldest = min(oldest or day, day)
                if r.cutoff and day < r.cutoff:
                    continue
            mark = _mark(row[r.key])
            if row[r.key] and mark not in known:
                known.add(mark)
                fresh.append(row)
        links = self.seen + [_mark(row[r.key]) for row in fresh]
        over = not fresh or (r.max_links is not None and len(links) >= r.max_links) or self.pages + 1 >= r.max_pages or (r.cutoff is not None and oldest is not None and oldest < r.cutoff)
        return fresh, Paging(self.offset + r.step, self.pages + 1, bool(over), links)


def _pages(site: str, state: Paging, rules: Rules, fetch: Callable, until: int | None = None) -> Iterator[tuple[list[tuple], Paging]]:
    while not state.done and (until is None or state.pages < until):
        fresh, state = state.turned(list(fetch(site, state.offset)), rules)
        yield fresh, state


class Service(DataSource):
    """Rows of paged services, a site a partition in batch, a page of each site a micro-batch in streams."""

    fetch: Callable[[str, int], list[tuple]]
    form: str
    #: The places of key and date in a row.
    key: int
    date: int | None

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str:
        return self.form

    def _rules(self) -> tuple[Rules, list[str]]:
        o = self.options
        given = {k: int(o[k]) for k in ("start", "step", "max_pages", "max_links") if k in o}
        rules = Rules(self.key, self.date, **given)
        return replace(rules, cutoff=datetime.date.fromisoformat(o["cutoff"]) if "cutoff" in o else None), [s for s in o.get("sites", "").split(",")]

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._rules(), type(self).fetch)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(*self._rules(), type(self).fetch)


class _Batch(DataSourceReader):
    def __init__(self, rules: Rules, sites: list[str], fetch: Callable):
        self.rules, self.sites, self.fetch = rules, sites, fetch

    def partitions(self):
        return [InputPartition(s) for s in self.sites]

    def read(self, partition):
        for fresh, _ in _pages(partition.value, Paging(self.rules.start), self.rules, self.fetch):
            yield from fresh


class _Stream(SimpleDataSourceStreamReader):
    """The offset holds every site's state, so a restarted query goes on where it was, with what it had seen."""

    def __init__(self, rules: Rules, sites: list[str], fetch: Callable):
        self.rules, self.sites, self.fetch = rules, sites, fetch

    def initialOffset(self) -> dict:
        return {s: asdict(Paging(self.rules.start)) for s in self.sites}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._read({s: v["pages"] + 1 for s, v in start.items()}, start)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._read({s: v["pages"] for s, v in end.items()}, start)[0]

    def _read(self, until: dict[str, int], start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], {}
        for site, value in start.items():
            state = Paging(**value)
            for fresh, state in _pages(site, state, self.rules, self.fetch, until[site]):  # noqa: B020
                rows += fresh
            end[site] = asdict(state)
        return iter(rows), end


def register(spark: SparkSession, name: str, schema: str, fetch: Callable[[str, int], list[tuple]], key: str, date: str | None = None) -> None:
    """Bind a source to ``fetch(site, offset)``, which gives a page's rows.

    Options: sites (comma-separated), start, step, max_pages, max_links (a site) and cutoff (a date).
    """
    names = StructType.fromDDL(schema).names
    spark.dataSource.register(type(name, (Service,), {"fetch": staticmethod(fetch), "form": schema, "key": names.index(key), "date": names.index(date) if date else None}))


@dataclass(frozen=True)
class Reply:
    status: int
    url: str
    body: str = ""


@dataclass(frozen=True)
class Policy:
    """How often an address is tried, how long one waits, and which final addresses count."""

    tries: int = 4
    allow: str = ""
    block: tuple[str, ...] = ()

    def get(self, url: str, opener: Callable[[str], Reply], sleep: Callable[[float], None]) -> dict:
        """One article. States: ok, skipped (403, 404), throttled (429 to the end), failed (any other error to the end), blocked."""
        waited, status, state = 0.0, None, "failed"
        for attempt in range(self.tries):
            try:
                reply = opener(url)
                status = reply.status
            except OSError:
                reply, status = None, None
            if status in (403, 404):
                return {"final_url": None, "state": "skipped", "status": status, "tries": attempt + 1, "waited": waited, "html": None}
            if reply is not None and status < 400:
                fits = re.search(self.allow, reply.url) and not any(re.search(p, reply.url) for p in self.block)
                return {"final_url": reply.url, "state": "ok" if fits else "blocked", "status": status, "tries": attempt + 1, "waited": waited, "html": reply.body if fits else None}
            state = "throttled" if status == 429 else "failed"
            if attempt + 1 < self.tries:
                pause = min(30.0, 2.5 * (attempt + 1)) if status == 429 else 1.0 + attempt
                sleep(pause)
                waited += pause
        return {"final_url": None, "state": state, "status": status, "tries": self.tries, "waited": waited, "html": None}


def fetched(urls: DataFrame, url: str, load: Callable[[], Callable[[str], Reply]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep, lanes: int = 4) -> DataFrame:
    """``urls`` with what fetching each gives, by ``policy``; ``load`` makes a task's opener, in the worker.

    A host's addresses are dealt to ``lanes`` lanes, and a lane is read by one task, one address after the other: a host never
    has more readers, and a large one isn't left to a single task.
    """
    schema = StructType([*urls.schema.fields, *StructType.fromDDL("final_url string, state string, status int, tries int, waited double, html string").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = load()
        for frame in frames:
            for i in range(0, len(frame), 64):
                part = frame.iloc[i : i + 64].reset_index(drop=True)
                got = pd.DataFrame([policy.get(u, opener, sleep) for u in part[url]], columns=["final_url", "state", "status", "tries", "waited", "html"])
                yield pd.concat([part, got.astype({"status": "Int32"})], axis=1)

    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = urls.where(F.col(url).isNotNull()).repartition(parts, host(url), F.pmod(F.xxhash64(url), F.lit(lanes)))
    return dealt.mapInPandas(run, schema)
