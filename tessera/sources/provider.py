"""A federated memory provider as a data source; what answers is a plain Python reader that the caller registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Bounds of a request and its answer.
MAX_QUERY, MAX_RESULTS, MAX_CHARS = 250, 100, 1_000_000

Reader = Callable[[str, int], list[dict]]
ACTIONS = {
    "search": ("text string, wing string, room string, source_file string, similarity double", ("text", "wing", "room", "source_file", "similarity")),
    "list": ("id string, wing string, room string, content string", ("id", "wing", "room", "content")),
    "get": ("id string, wing string, room string, content string", ("id", "wing", "room", "content")),
    "taxonomy": ("wing string, room string, n int", ("wing", "room", "n")),
    "status": ("key string, value string", ("key", "value")),
}


def provider_source(name: str, search: Reader, connect: Callable[[], None] | None = None, **actions: Reader) -> type[DataSource]:
    """A source class for spark.dataSource.register.

    Read it with the options action (search by default, list, get, taxonomy, status), query and
    limit; actions names the reader of each but search. taxonomy may answer with a map of wings to
    rooms and counts, status with a map. A transport that closes is connected and tried once more;
    any other failure is reported without the provider's own words, which may hold private text.
    """
    readers = {"search": search, **actions}

    class _Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.action = options.get("action", "search")
            self.query = options.get("query", "")[:MAX_QUERY]
            self.limit = max(1, min(MAX_RESULTS, int(options.get("limit", "20"))))

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if self.action not in readers:
                raise RuntimeError(f"{name}: no {self.action}")
            for attempt in (1, 2):
                try:
                    rows = readers[self.action](self.query, self.limit)
                    break
                except ConnectionError:
                    if attempt == 2:
                        raise RuntimeError(f"{name}: the connection was lost") from None
                    if connect:
                        connect()
                except Exception:  # noqa: BLE001
                    raise RuntimeError(f"{name}: the provider failed") from None
            if len(str(rows)) > MAX_CHARS:
                raise RuntimeError(f"{name}: malformed response")
            if isinstance(rows, dict):
                if self.action == "taxonomy":
                    rows = [{"wing": w, "room": r, "n": n} for w, rooms in rows.items() for r, n in rooms.items()]
                else:
                    rows = [{"key": str(k), "value": str(v)} for k, v in rows.items()]
            columns = ACTIONS[self.action][1]
            for r in rows if self.action in ("taxonomy", "status") else rows[: self.limit]:
                yield tuple(float(r.get(c) or 0.0) if c == "similarity" else r.get(c) for c in columns)

    class _Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ACTIONS.get(self.options.get("action", "search"), ACTIONS["search"])[0]

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options)

    return _Source
