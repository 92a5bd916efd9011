"""Files of a link list fetched to a folder, with a row of outcome a link."""

from __future__ import annotations

import struct
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from geomill.operators.stages import written
from geomill.sources import clouds
from geomill.sources.ranges import Ranged, located, put

_OUTCOME = pa.schema([("name", pa.string()), ("url", pa.string()), ("ok", pa.bool_()), ("skipped", pa.bool_()), ("attempts", pa.int32()), ("bytes", pa.int64()), ("error", pa.string())])


def fetched(links: DataFrame, folder: str, attempts: int = 3, pause: float = 5.0, timeout: float = 300.0) -> DataFrame:
    """name, url, ok, skipped, attempts, bytes, error: a row for each of links(name, url), which are fetched once.

    http(s) links are tried `attempts` times, `pause` seconds apart; others are paths or file links and tried once. Files
    come under a name of their own and are checked before they are moved into place: point clouds by their header
    and length, others must hold a byte. A file that is there and passes is skipped, one that does not is replaced. Links
    of one name go to one task in order of link, so the second finds what the first brought; a lost task is
    run again and skips what it had. A null, empty or nested name, and a null link, is an error. Outcomes are written, so
    reading them twice fetches nothing twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([r | _outcome(r["name"], r["url"], folder, attempts, pause, timeout)], schema=_OUTCOME)

    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few links are not drawn into one task
    d = links.select("name", "url").repartition(parts, "name").sortWithinPartitions("name", "url")
    return written(d.mapInArrow(run, "name string, url string, ok boolean, skipped boolean, attempts int, bytes long, error string"), "outcomes")


def _outcome(name: str | None, url: str | None, folder: str, attempts: int, pause: float, timeout: float) -> dict:
    if not name or "/" in name or name.startswith(".") or not url:
        return {"ok": False, "skipped": False, "attempts": 0, "error": "no usable name or link"}
    check = clouds.whole if name.lower().endswith((".las", ".laz")) else _holds
    size = _there(folder, name, check)
    if size is not None:
        return {"ok": True, "skipped": True, "attempts": 0, "bytes": size}
    remote = url.lower().startswith(("http://", "https://"))
    tries = attempts if remote else 1
    for n in range(1, tries + 1):
        try:
            return {"ok": True, "skipped": False, "attempts": n, "bytes": put(folder, name, _loaded(url, timeout) if remote else _copied(url), check)}
        except (OSError, ValueError, struct.error, urllib.error.URLError) as e:
            error = str(e) or type(e).__name__
            if n < tries:
                time.sleep(pause)
    return {"ok": False, "skipped": False, "attempts": tries, "error": error}


def _holds(f: Ranged) -> None:
    if not f.size:
        raise ValueError("empty")


def _there(folder: str, name: str, check) -> int | None:
    """Bytes of a file that is there and passes; one that does not is removed."""
    system, place = located(f"{folder}/{name}")
    if system.get_file_info(place).type != fs.FileType.File:
        return None
    try:
        with Ranged(place, system=system) as f:
            check(f)
            return f.size
    except (ValueError, struct.error):
        system.delete_file(place)
        return None


def _copied(url: str) -> Iterator[bytes]:
    system, place = located(url)
    with system.open_input_stream(place) as f:
        while part := f.read(1 << 20):
            yield part


def _loaded(url: str, timeout: float) -> Iterator[bytes]:
    with urllib.request.urlopen(url, timeout=timeout) as f:
        while part := f.read(1 << 20):
            yield part
        if f.length:
            raise ValueError("cut short")
