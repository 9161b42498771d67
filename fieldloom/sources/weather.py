"""Daily weather from a web service as a data source: one request for each station and period.

``spark.read.format("weather_service")`` plans partitions of some requests each. ``transport`` fetches
a request's parameters and returns ``(status, text)``; tests and other services give
their own. A request that fails after its tries is a row with ``error``, so a
station that fails loses nothing of the others. Filters on ``Date`` narrow the periods that are asked for.

Options: ``stations`` and ``periods`` (JSON), ``parameters``, ``url`` or ``transport`` (``module:function``, or
a pickled function by :func:`options_of`), ``tries``, ``wait``, ``requestsPerPartition``.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.tables import check_metadata
from . import shared

PARAMETERS = ("PRECTOTCORR", "T2M", "RH2M")
#: Seconds for a request, tries, and the first wait, which doubles.
TIMEOUT, TRIES, WAIT = 60, 5, 10
STATION = ("municipality", "ibge_code", "state", "latitude", "longitude")
#: Requests of one partition, and stations that are planned one by one; beyond, stations stay a DataFrame.
REQUESTS, MOST_STATIONS = 20, 100_000
PAYLOAD = "struct<properties:struct<parameter:map<string,map<string,double>>>>"


def fetch(transport: Callable[[dict], tuple[int, str]], params: dict, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer's text; too many requests and transport errors wait and try again."""
    last: object = None
    for attempt in range(tries):
        try:
            status, body = transport(params)
            if status == 200:
                return body
            last = f"status {status}"
            if status != 429 and 400 <= status < 500:
                break
        except OSError as failed:
            last = failed
        if attempt + 1 < tries:
            sleep(wait * 2**attempt)
    raise RuntimeError(f"The request failed after {tries} attempts: {last}")


def http_transport(url: str, timeout: float = TIMEOUT) -> Callable[[dict], tuple[int, str]]:
    """GET with the parameters in the query."""

    def get(params: dict) -> tuple[int, str]:
        from urllib.error import HTTPError
        from urllib.parse import urlencode
        from urllib.request import urlopen

        try:
            with urlopen(f"{url}?{urlencode(params)}", timeout=timeout) as answer:
                return answer.status, answer.read().decode()
        except HTTPError as failed:
            return failed.code, ""

    return get


def periods_of(stations: DataFrame, periods: Sequence[tuple[str, str]]) -> DataFrame:
    """Stations x periods ``(start, end)`` as ``YYYYMMDD``; a period stays within a calendar year."""
    for start, end in periods:
        if start[:4] != end[:4]:
            raise ValueError(f"Start and end must be in the same calendar year: {start}, {end}")
    return stations.withColumn("period", F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in periods)))).select("*", "period.*").drop("period")


def responses(requests: DataFrame, transport: Callable[[dict], tuple[int, str]], parameters: Sequence[str] = PARAMETERS, partitions: int = 8, **options) -> DataFrame:
    """``requests`` with ``body`` or ``error`` of each request."""
    out = requests.select(*STATION, "start", "end")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, errors = [], []
            for row in batch.to_pylist():
                params = {"parameters": ",".join(parameters), "community": "AG", "longitude": row["longitude"], "latitude": row["latitude"], "start": row["start"], "end": row["end"], "format": "JSON"}
                try:
                    body, error = fetch(transport, params, **options), None
                    found = json.loads(body).get("properties", {}).get("parameter", {})
                    if absent := [p for p in parameters if p not in found]:
                        body, error = None, f"The response lacks parameters: {absent}"
                except (RuntimeError, ValueError, AttributeError) as failed:
                    body, error = None, str(failed)
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "body", "error"])

    schema = out.withColumns({n: F.lit(None).cast("string") for n in ("body", "error")}).schema
    return out.repartition(partitions).mapInArrow(run, schema)


def daily_rows(answers: DataFrame, parameters: Sequence[str] = PARAMETERS) -> DataFrame:
    """JSON of ``parameter -> date -> number`` to one row by station and date; a date that a parameter lacks is null there."""
    keys = [c for c in answers.columns if c not in ("body", "error", "start", "end")]
    parsed = answers.where("body is not null").withColumn("parameter", F.from_json("body", PAYLOAD)["properties"]["parameter"])
    each = parsed.select(*keys, F.explode("parameter").alias("name", "values")).select(*keys, "name", F.explode("values").alias("day", "value"))
    wide = each.groupBy(*keys, "day").pivot("name", list(parameters)).agg(F.first("value"))
    return wide.select(F.to_date("day", "yyyyMMdd").alias("Date"), *parameters, *keys)


def _transport(name: str) -> Callable[[dict], tuple[int, str]]:
    if name.startswith("pickle:"):
        return cloudpickle.loads(base64.b64decode(name.removeprefix("pickle:")))
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


def _within_year(periods: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    for start, end in periods:
        if start[:4] != end[:4]:
            raise ValueError(f"Start and end must be in the same calendar year: {start}, {end}")
    return [tuple(p) for p in periods]


class Requests(InputPartition):
    def __init__(self, requests: list[tuple[dict, str, str]]):
        self.requests = requests


class WeatherSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weather_service"

    def __init__(self, options):
        super().__init__(options)
        self.stations = json.loads(options["stations"])
        self.periods = _within_year(json.loads(options["periods"]))
        self.parameters = options.get("parameters", ",".join(PARAMETERS)).split(",")
        self.transport, self.url = options.get("transport"), options.get("url")
        self.tries, self.wait = int(options.get("tries", TRIES)), float(options.get("wait", WAIT))
        self.step = int(options.get("requestsPerPartition", REQUESTS))

    def schema(self) -> str:
        numbers = ", ".join(f"`{p}` double" for p in self.parameters)
        return f"Date date, {numbers}, municipality string, ibge_code bigint, state string, latitude double, longitude double, start string, end string, error string"

    def reader(self, schema) -> DataSourceReader:
        return WeatherReader(self)


class WeatherReader(DataSourceReader):
    def __init__(self, source: WeatherSource):
        self.source = source
        self.first, self.last = date.min, date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on ``Date`` are kept here, so rows of failed requests, which have no date, stay."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("Date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, date):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + timedelta(days=isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, value - timedelta(days=isinstance(f, LessThan)))
            elif type(f).__name__ != "IsNotNull" or getattr(f, "attribute", None) != ("Date",):
                yield f

    def partitions(self) -> list[InputPartition]:
        low, high = (d.strftime("%Y%m%d") if d not in (date.min, date.max) else e for d, e in ((self.first, "0"), (self.last, "9")))
        periods = [(max(a, low), min(b, high)) for a, b in self.source.periods if max(a, low) <= min(b, high)]
        requests = [(s, a, b) for s in self.source.stations for a, b in periods]
        return [Requests(requests[k : k + self.source.step]) for k in range(0, len(requests), self.source.step)]

    def read(self, partition: Requests | None) -> Iterator[tuple]:
        if partition is None:  # nothing was planned
            return
        own = self.source
        transport = _transport(own.transport) if own.transport else http_transport(own.url)
        for station, start, end in partition.requests:
            tag = (*(station[c] for c in STATION), start, end)
            params = {"parameters": ",".join(own.parameters), "community": "AG", "longitude": station["longitude"], "latitude": station["latitude"], "start": start, "end": end, "format": "JSON"}
            try:
                found = json.loads(fetch(transport, params, own.tries, own.wait)).get("properties", {}).get("parameter")
                if found is None:
                    raise ValueError("The response lacks its structure.")
                if absent := [p for p in own.parameters if p not in found]:
                    raise ValueError(f"The response lacks parameters: {absent}")
                days = {d: datetime.strptime(d, "%Y%m%d").date() for p in own.parameters for d in found[p]}
                rows = [(days[d], *(None if (v := found[p].get(d)) is None else float(v) for p in own.parameters), *tag, None) for d in sorted(days) if self.first <= days[d] <= self.last]
            except (RuntimeError, ValueError, AttributeError, TypeError) as failed:
                rows = [(None, *([None] * len(own.parameters)), *tag, str(failed))]
            yield from rows


def options_of(stations: DataFrame, periods: Sequence[tuple[str, str]], transport: Callable[[dict], tuple[int, str]] | str | None = None, **options) -> dict[str, str]:
    """Options of the source. The stations' table is planned on the driver, so it may have ``MOST_STATIONS`` rows."""
    rows = stations.select(*STATION).limit(MOST_STATIONS + 1).collect()
    if len(rows) > MOST_STATIONS:
        raise ValueError(f"More than {MOST_STATIONS} stations: use responses()")
    out = {"stations": json.dumps([r.asDict() for r in rows]), "periods": json.dumps(_within_year(periods))} | {k: str(v) for k, v in options.items()}
    if transport is not None:
        out["transport"] = transport if isinstance(transport, str) else "pickle:" + base64.b64encode(cloudpickle.dumps(transport)).decode()
    return out


def read(stations: DataFrame, periods: Sequence[tuple[str, str]], transport: Callable[[dict], tuple[int, str]] | str | None = None, **options) -> DataFrame:
    """Rows of the source: days, and failed requests with ``error``. Nothing is asked for before an action, and anew in each."""
    spark = stations.sparkSession
    spark.dataSource.register(WeatherSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("weather_service").options(**options_of(stations, periods, transport, **options)).load()


def download(stations: DataFrame, periods: Sequence[tuple[str, str]], transport: Callable[[dict], tuple[int, str]], parameters: Sequence[str] = PARAMETERS, where: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Daily rows, and ``(municipality, ibge_code, error)`` of the failed requests; all failing is an error.

    Answers are written once they are there: no request is made twice. ``where`` is a condition on ``Date``.
    """
    check_metadata(stations)
    _within_year(periods)
    if stations.count() > MOST_STATIONS:
        raw = shared.keep(responses(periods_of(stations, periods), transport, parameters, **options))
        days, failed = daily_rows(raw, parameters), raw.where("error is not null")
    else:
        rows = read(stations, periods, transport, parameters=",".join(parameters), **options)
        rows = shared.keep(rows.where(where) if where else rows)
        days, failed = rows.where("error is null").select("Date", *parameters, *STATION), rows.where("error is not null")
    if days.isEmpty() and not failed.isEmpty():
        raise RuntimeError("All downloads failed.")
    return days, failed.select("municipality", "ibge_code", "error")
