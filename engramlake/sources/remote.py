"""The other side of a synchronisation: pages of rows by cursor, and a stream and batch source of them.

The protocol is a page of each collection behind a cursor of its own.  The source asks with pages of
one row how far ids go by now (doubling steps, then halves), which is all the driver sees; ranges
of ids are then fetched page by page in tasks.  A stream's offset holds the cursor of each collection, so
a restarted stream reads on behind the last one that was committed."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.models import HttpError, with_retry

# fixed values: the collections' names, and those of their cursors in a request
COLLECTIONS = {"sdk_sessions": "sessions", "observations": "observations", "session_summaries": "summaries", "user_prompts": "prompts"}
AFTER = {"observations": "obs_after", "summaries": "sum_after", "prompts": "prompt_after", "sessions": "sess_after"}
PULLED = "collection string, id bigint, row string"
BEYOND = 1 << 62  # a cursor behind which there is nothing
NAME = "memory_pull"


@dataclass(frozen=True)
class HttpRemote:
    url: str
    machine: str
    key: str = ""
    timeout: float = 30.0

    def _ask(self, request: urllib.request.Request) -> dict:
        request.add_header("Authorization", f"Bearer {self.key}")

        def once() -> dict:
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                raise HttpError(error.code) from error
            except urllib.error.URLError as error:
                raise ConnectionError(str(error.reason)) from error

        return with_retry(once)

    def pull(self, after: dict[str, int], limit: int) -> dict[str, list[dict]]:
        """The next rows of each collection, in order of their ids; none of a collection without a cursor."""
        asked = {"machine_id": self.machine, "limit": limit} | {AFTER[c]: after.get(c, BEYOND) for c in AFTER}
        got = self._ask(urllib.request.Request(f"{self.url}/api/sync/pull?{urllib.parse.urlencode(asked)}"))
        return {c: got.get(c) or [] for c in AFTER if c in after}

    def push(self, body: str) -> dict[str, int]:
        return self._ask(urllib.request.Request(f"{self.url}/api/sync/push", data=body.encode(), headers={"Content-Type": "application/json"}, method="POST"))


def heads(remote: HttpRemote, known: dict[str, int]) -> dict[str, int]:
    """The largest id of each collection by now, at least the ``known`` ones: steps that double, then halves."""
    low, high, step = dict(known), {}, dict.fromkeys(known, 0)
    while probes := {c: (low[c] + high[c]) // 2 if c in high else low[c] + step[c] for c in low if c not in high or low[c] < high[c]}:
        got = remote.pull(probes, 1)
        for c, at in probes.items():
            if got[c]:
                low[c], step[c] = int(got[c][0]["id"]), 2 * step[c] or 1
            else:
                high[c] = at
    return low


@dataclass
class IdRange(InputPartition):
    collection: str
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__((self.collection, self.low, self.high))


class _Pull:
    def __init__(self, options: dict[str, str]):
        self.remote = HttpRemote(options["url"], options["machine"], options.get("key", ""))
        self.page, self.rows, self.tasks = int(options.get("page", 100)), int(options.get("rowsPerTask", 10_000)), int(options.get("tasks", 64))
        self.first = dict.fromkeys(AFTER, 0) | json.loads(options.get("after", "{}"))

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[IdRange]:
        out = []
        for c in AFTER:
            wide = max(self.rows, -(-(end[c] - start[c]) // self.tasks))
            out += [IdRange(c, low, min(low + wide, end[c])) for low in range(start[c], end[c], wide)]
        return out

    def fetch(self, part: IdRange | None) -> Iterator[tuple[str, int, str]]:
        if part is None:  # what Spark hands over if there are no ranges
            return
        at = part.low
        while at < part.high:
            rows = self.remote.pull({part.collection: at}, self.page)[part.collection]
            for row in rows:
                at = int(row["id"])
                if at > part.high:
                    return
                yield part.collection, at, json.dumps(row, ensure_ascii=False)
            if not rows:
                return


class PullReader(_Pull, DataSourceReader):
    def partitions(self) -> list[IdRange]:
        return self.ranges(self.first, heads(self.remote, self.first))

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return self.fetch(partition)


class PullStream(_Pull, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.head = dict(self.first)

    def initialOffset(self) -> dict:
        return self.first

    def latestOffset(self) -> dict:
        self.head = heads(self.remote, self.head)
        return self.head

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return self.ranges(start, end)

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return self.fetch(partition)


class PullSource(DataSource):
    """Rows (collection, id, row as JSON) that other machines have changed, by batch or as a stream.

    Options: url, machine, key; page (rows asked for at once), rowsPerTask and tasks (how ids are
    dealt), after (JSON: where each collection begins)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PULLED

    def reader(self, schema) -> PullReader:
        return PullReader(self.options)

    def streamReader(self, schema) -> PullStream:
        return PullStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PullSource)
