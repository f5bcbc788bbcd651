"""Bars and net values as a data source of Spark: payload files by symbol, from several places in turn.

    spark.dataSource.register(PayloadSource)
    spark.read.format("payloads").option("places", "a;b").option("symbols", "x,y").option("start", "20240101").load()

A place is a folder, of any file system that pyarrow opens, of files `<symbol>.json`: an array of records
by field name (`file` gives another pattern, and may name folders of such files).  Each symbol is a partition of its own, so symbols are read side by side.  A place that
fails (no file, no JSON, no date in a record) is tried `attempts` times with waits that double, then the
next; a symbol that no place has is an error, or nothing with `missing` = skip.  Dates are clamped to
`start` and `end` as they are read; a schema given to the reader prunes the columns that are made.

As a stream its offset is, by symbol, the last date read: the high-water mark.  What a restart reads
begins after it, and what a batch has read is read alike when it is replayed.

Defined results: fields that a record lacks are null, values that are no numbers too; records are ordered
by date and of equal dates the last counts; dates are written yyyy-mm-dd or yyyymmdd.
"""

from __future__ import annotations

import datetime
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import DateType, StringType, StructType

BARS = "symbol string, bar_date date, open double, high double, low double, close double, volume double"
FIRST, LAST = "0001-01-01", "9999-12-31"


class Symbol(InputPartition):
    def __init__(self, name: str):
        self.name = name


def day(text: object) -> str:
    """yyyy-mm-dd of a date in either spelling; ValueError for anything else."""
    digits = str(text)[:10].replace("-", "")[:8]
    return datetime.date(int(digits[:4]), int(digits[4:6]), int(digits[6:8])).isoformat()


def number(value: object) -> float | None:
    try:
        return None if value is None or value == "" else float(str(value).replace(",", ""))
    except ValueError:
        return None


class Payloads:
    """What the options name, and how a symbol's records are fetched."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.places = [p for p in options.get("places", "").split(";") if p]
        self.symbols = [s.strip() for s in options.get("symbols", "").split(",") if s.strip()]
        if not self.places or not self.symbols:
            raise ValueError("the options places and symbols are needed")
        self.start, self.end = (day(options[k]) if k in options else default for k, default in (("start", FIRST), ("end", LAST)))
        self.attempts, self.wait = int(options.get("attempts", "1")), float(options.get("wait", "0.1"))
        self.skip = options.get("missing", "error") == "skip"
        self.schema, self.file = schema, options.get("file", "{symbol}.json")
        (self.date,) = [f.name for f in schema if isinstance(f.dataType, DateType)] or [options.get("date", "bar_date")]

    def records(self, symbol: str) -> dict[str, dict]:
        """By date, from the first place that has them."""
        faults = []
        for place in self.places:
            for attempt in range(self.attempts):
                if attempt:
                    time.sleep(self.wait * 2 ** (attempt - 1))
                try:
                    return self._fetch(place, symbol)
                except (OSError, ValueError, KeyError, TypeError) as fault:
                    faults.append(f"{place}: {fault!r}")
        if self.skip:
            return {}
        raise OSError(f"no place has {symbol}: " + "; ".join(faults))

    def _fetch(self, place: str, symbol: str) -> dict[str, dict]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
        path = f"{path}/{self.file.format(symbol=symbol)}"
        files = [path]
        if system.get_file_info(path).type == fs.FileType.Directory:  # as Spark writes a partition of a table of texts
            files = sorted(i.path for i in system.get_file_info(fs.FileSelector(path)) if i.is_file and i.base_name[0] not in "._")
        found: dict[str, dict] = {}
        for name in files:
            with system.open_input_stream(name) as f:
                found |= {day(r[self.date]): r for r in json.loads(f.read().decode())}
        return found

    def rows(self, symbol: str, after: str | None = None) -> Iterator[tuple]:
        """Rows of the schema, clamped, later than `after`."""
        found = self.records(symbol)
        for d in sorted(found):
            if self.start <= d <= self.end and (after is None or d > after):
                yield tuple(datetime.date.fromisoformat(d) if isinstance(f.dataType, DateType) else (symbol if f.name == "symbol" else found[d].get(f.name)) if isinstance(f.dataType, StringType) else number(found[d].get(f.name)) for f in self.schema)


class PayloadReader(DataSourceReader):
    def __init__(self, payloads: Payloads):
        self.payloads = payloads

    def partitions(self) -> list[Symbol]:
        return [Symbol(s) for s in self.payloads.symbols]

    def read(self, partition: Symbol) -> Iterator[tuple]:
        return self.payloads.rows(partition.name)


class PayloadStream(SimpleDataSourceStreamReader):
    """For symbols with some new rows a batch: those are read where the stream is planned."""

    def __init__(self, payloads: Payloads):
        self.payloads, self.at = payloads, payloads.schema.names.index(payloads.date)

    def initialOffset(self) -> dict:
        return {}

    def _after(self, start: dict) -> dict[str, list[tuple]]:
        return {s: list(self.payloads.rows(s, start.get(s))) for s in self.payloads.symbols}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._after(start)
        marks = start | {s: rows[-1][self.at].isoformat() for s, rows in found.items() if rows}
        return iter([r for rows in found.values() for r in rows]), marks

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for s, rows in self._after(start).items() for r in rows if r[self.at].isoformat() <= end.get(s, "")])

    def commit(self, end: dict) -> None:
        pass


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: StructType) -> PayloadReader:
        return PayloadReader(Payloads(self.options, schema))

    def simpleStreamReader(self, schema: StructType) -> PayloadStream:
        return PayloadStream(Payloads(self.options, schema))
