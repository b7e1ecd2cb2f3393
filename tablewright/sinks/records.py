"""Rows as JSON records, batches of them, and the senders for table services and webhooks.

Conversion is a Spark expression; sending is one ordered sequence from the driver, which takes records partition by
partition and holds one batch at a time.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.dataset import ROW_KEY, Dataset
from tablewright.functions.exprs import col, finite, is_temporal

MOST_RECORDS, TABLE_BATCH, HOOK_BATCH, MOST_HOOK_BATCH = 250_000, 10, 500, 1_000
TABLE_PAUSE, HOOK_PAUSE, RETRY_PAUSE = 0.25, 0.05, 2.0
CONFIG_FORMAT, CONFIG_VERSION = "tablewright-export", 1


class ExportError(ValueError):
    """The export can't go on."""


@dataclass(frozen=True)
class TableService:
    base_id: str
    table: str
    typecast: bool = False


@dataclass(frozen=True)
class Webhook:
    url: str
    batch_size: int = HOOK_BATCH
    secret_header: str | None = None


@dataclass(frozen=True)
class ExportConfig:
    name: str
    destination: TableService | Webhook
    row_limit: int = MOST_RECORDS


@dataclass
class Report:
    total: int = 0
    sent: int = 0
    batches: int = 0
    failures: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.failures and self.sent == self.total


def json_records(df: DataFrame) -> DataFrame:
    """record: one JSON text per row; missing and non-finite values are left out, times are ISO 8601."""
    fields = []
    for f in df.schema:
        if f.name == ROW_KEY:
            continue
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = finite(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif is_temporal(f.dataType):
            micro = F.date_format(c, "SSSSSS")
            c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(F.lit("")))
        elif isinstance(f.dataType, (T.DecimalType, T.BinaryType)):
            c = c.cast("string")
        fields.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("record"))


def records(data: Dataset, row_limit: int = MOST_RECORDS) -> Iterator[dict]:
    """The first rows in order, one at a time."""
    if isinstance(row_limit, bool) or not isinstance(row_limit, int) or row_limit < 1:
        raise ExportError("the row limit must be at least 1")
    if row_limit > MOST_RECORDS:
        raise ExportError(f"at most {MOST_RECORDS} records can be sent")
    ordered = data.frame.orderBy(ROW_KEY).limit(row_limit)
    for row in json_records(ordered).toLocalIterator():
        yield json.loads(row["record"])


def batches(items: Iterable[dict], size: int) -> Iterator[list[dict]]:
    """Consecutive slices."""
    now: list[dict] = []
    for item in items:
        now.append(item)
        if len(now) == size:
            yield now
            now = []
    if now:
        yield now


# ---- HTTP ------------------------------------------------------------------------------------------------------------


def http(method: str, url: str, body: object | None, headers: dict[str, str], timeout: float = 30) -> tuple[int, str]:
    """Status and text; raises OSError where the server can't be reached."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers}, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as error:
        return error.code, error.read().decode("utf-8", "replace")


Send = Callable[[str, str, object | None, dict[str, str]], tuple[int, str]]


def check_service(destination: TableService, token: str) -> None:
    if not token.strip():
        raise ExportError("an access token is needed")
    if not re.fullmatch(r"app[A-Za-z0-9]{3,}", destination.base_id):
        raise ExportError("the base id is not valid")
    if not destination.table.strip():
        raise ExportError("a table name is needed")


def check_webhook(destination: Webhook, secret: str | None) -> None:
    parts = urllib.parse.urlsplit(destination.url)
    local = parts.hostname in ("localhost", "127.0.0.1", "::1")
    if not parts.hostname or parts.scheme != "https" and not (parts.scheme == "http" and local):
        raise ExportError("a webhook needs https, or http on this machine")
    size = destination.batch_size
    if isinstance(size, bool) or not isinstance(size, int) or not 1 <= size <= MOST_HOOK_BATCH:
        raise ExportError(f"a batch has 1 to {MOST_HOOK_BATCH} records")
    if destination.secret_header and not secret:
        raise ExportError("the secret header needs a value")


STATUS = {401: "the token was refused", 403: "the token lacks a permission", 404: "the base or table was not found", 422: "the fields were not accepted", 429: "too many requests"}


def service_body(batch: list[dict], destination: TableService) -> dict:
    return {"records": [{"fields": r} for r in batch], "typecast": destination.typecast}


def hook_body(batch: list[dict], name: str, index: int, count: int) -> dict:
    return {"source": "tablewright", "pipeline": name, "batch_index": index, "batch_count": count, "records": batch}


def preview(items: Iterable[dict], config: ExportConfig, total: int | None = None) -> dict:
    """Exactly the body of the first request. ``total`` is the number of items where these have no length."""
    total = len(items) if total is None else total
    if isinstance(config.destination, TableService):
        return service_body(list(islice(items, TABLE_BATCH)), config.destination)
    size = config.destination.batch_size
    return hook_body(list(islice(items, size)), config.name, 1, -(-total // size))


def push_service(items: Iterable[dict], destination: TableService, token: str, *, api_url: str, total: int | None = None, send: Send = http, sleep=time.sleep, progress=None) -> Report:
    """Appends records in batches of ten. A refused token or unknown table ends the run; other failures are noted."""
    check_service(destination, token)
    report = Report(total=len(items) if total is None else total)
    url = f"{api_url.rstrip('/')}/{destination.base_id}/{urllib.parse.quote(destination.table, safe='')}"
    headers = {"Authorization": f"Bearer {token}"}
    for i, batch in enumerate(batches(items, TABLE_BATCH), 1):
        if i > 1:
            sleep(TABLE_PAUSE)
        body = service_body(batch, destination)
        report.batches += 1
        try:
            status, _ = send("POST", url, body, headers)
            if status == 429:
                sleep(RETRY_PAUSE)
                status, _ = send("POST", url, body, headers)
        except OSError as error:
            report.failures.append(f"batch {i}: the service can't be reached ({error})")
            continue
        if status in (401, 403, 404):
            raise ExportError(STATUS[status])
        if status == 200:
            report.sent += len(batch)
        else:
            report.failures.append(f"batch {i}: {STATUS.get(status, f'status {status}')}")
        if progress:
            progress(report.sent, report.total)
    return report


def check_connection(destination: TableService, token: str, *, api_url: str, send: Send = http) -> None:
    """Reads one record."""
    check_service(destination, token)
    url = f"{api_url.rstrip('/')}/{destination.base_id}/{urllib.parse.quote(destination.table, safe='')}?maxRecords=1"
    try:
        status, _ = send("GET", url, None, {"Authorization": f"Bearer {token}"})
    except OSError as error:
        raise ExportError("the service can't be reached") from error
    if status != 200:
        raise ExportError(STATUS.get(status, f"status {status}"))


def push_webhook(items: Iterable[dict], destination: Webhook, *, secret: str | None = None, name: str = "export", total: int | None = None, send: Send = http, sleep=time.sleep, progress=None) -> Report:
    """Posts batches. A server that can't be reached at the first one ends the run; later failures are noted."""
    check_webhook(destination, secret)
    report = Report(total=len(items) if total is None else total)
    count = -(-report.total // destination.batch_size)
    headers = {destination.secret_header: secret} if destination.secret_header else {}
    for i, batch in enumerate(batches(items, destination.batch_size), 1):
        if i > 1:
            sleep(HOOK_PAUSE)
        report.batches += 1
        try:
            status, _ = send("POST", destination.url, hook_body(batch, name, i, count), headers)
        except OSError as error:
            if i == 1:
                raise ExportError("the webhook can't be reached") from error
            report.failures.append(f"batch {i}: the webhook can't be reached ({error})")
            continue
        if 200 <= status < 300:
            report.sent += len(batch)
        else:
            report.failures.append(f"batch {i}: status {status}")
        if progress:
            progress(report.sent, report.total)
    return report


# ---- Configuration ---------------------------------------------------------------------------------------------------


def config_to_json(config: ExportConfig) -> str:
    """Without credentials: a secret is named by its header, its value is given at run time."""
    kind = "table_service" if isinstance(config.destination, TableService) else "webhook"
    return json.dumps({"format": CONFIG_FORMAT, "version": CONFIG_VERSION, "name": config.name, "row_limit": config.row_limit, "kind": kind, "destination": dataclasses.asdict(config.destination)}, indent=2)


def config_from_json(text: str) -> ExportConfig:
    try:
        plain = json.loads(text)
    except ValueError as error:
        raise ExportError("the configuration is not JSON") from error
    if not isinstance(plain, dict) or plain.get("format") != CONFIG_FORMAT or plain.get("version") != CONFIG_VERSION:
        raise ExportError("this is not an export configuration of a known version")
    if plain.keys() != {"format", "version", "name", "row_limit", "kind", "destination"}:
        raise ExportError("the configuration has unknown or missing fields")
    name, limit = plain["name"], plain["row_limit"]
    if not isinstance(name, str) or not 1 <= len(name.strip()) <= 80:
        raise ExportError("a name has 1 to 80 characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ExportError("the row limit must be a positive whole number")
    made = {"table_service": TableService, "webhook": Webhook}.get(plain["kind"])
    if made is None or not isinstance(plain["destination"], dict) or plain["destination"].keys() - {f.name for f in dataclasses.fields(made)}:
        raise ExportError("the destination is not valid")
    try:
        return ExportConfig(name, made(**plain["destination"]), limit)
    except TypeError as error:
        raise ExportError("the destination lacks a field") from error


def run_export(data: Dataset, config: ExportConfig, *, secret: str | None = None, api_url: str = "", dry_run: bool = False, send: Send = http, sleep=time.sleep) -> Report | dict:
    """Records of the dataset to the destination; a dry run gives the first body instead."""
    items = records(data, config.row_limit)
    total = data.frame.limit(config.row_limit).count()
    if dry_run:
        return preview(items, config, total)
    if isinstance(config.destination, TableService):
        return push_service(items, config.destination, secret or "", api_url=api_url, total=total, send=send, sleep=sleep)
    return push_webhook(items, config.destination, secret=secret, name=config.name, total=total, send=send, sleep=sleep)


def main(arguments: list[str] | None = None) -> int:
    """Command line: data file, configuration, optional recipe; exit code 0 only if everything was sent."""
    import argparse

    from tablewright.operators.cleaning import read_recipe, replay
    from tablewright.session import get_session
    from tablewright.sources.load import load

    parser = argparse.ArgumentParser(prog="tablewright-export")
    parser.add_argument("data")
    parser.add_argument("config")
    parser.add_argument("--recipe")
    parser.add_argument("--api-url", default=os.environ.get("TABLEWRIGHT_API_URL", ""))
    parser.add_argument("--dry-run", action="store_true")
    options = parser.parse_args(arguments)
    with open(options.config, encoding="utf-8") as f:
        config = config_from_json(f.read())
    try:
        data = load(get_session(), options.data)
        if options.recipe:
            with open(options.recipe, encoding="utf-8") as f:
                data = replay(data, read_recipe(f.read()))
        out = run_export(data, config, secret=os.environ.get("TABLEWRIGHT_SECRET"), api_url=options.api_url, dry_run=options.dry_run)
    except ValueError as error:
        print(f"error: {error}")
        return 1
    if isinstance(out, dict):
        print(json.dumps(out, indent=2, ensure_ascii=False))
        return 0
    print(f"{out.sent} of {out.total} records in {out.batches} batches", *out.failures, sep="\n")
    return int(not out.ok)


if __name__ == "__main__":
    raise SystemExit(main())
