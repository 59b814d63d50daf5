"""Versions of a stored table or index: parts are written beside those that are
there, and a small file of the next number says which of them are the state.
Readers hold the parts of the version that they opened, which stay until
`prune` removes them; a version file is made once and never changed."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from . import tables

FOLDER = "versions"
NAME = re.compile(r"(\d{12})\.json")


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a folder, oldest first."""
    store, target = tables.store_of(spark, f"{folder}/{FOLDER}")
    if not store.exists(target):
        return []
    found = (NAME.fullmatch(status.getPath().getName()) for status in store.listStatus(target))
    return sorted(int(m[1]) for m in found if m)


def current(spark: SparkSession, folder: str) -> tuple[int, dict] | None:
    """The newest version and what it says; None if there is none."""
    found = numbers(spark, folder)
    return (found[-1], json.loads(tables.get_text(spark, path(folder, found[-1])))) if found else None


def path(folder: str, number: int) -> str:
    return f"{folder}/{FOLDER}/{number:012d}.json"


def fresh_part(folder: str, kind: str) -> str:
    """The name of a part that no other writer uses."""
    return f"{kind}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, change: Callable[[dict | None], Mapping]) -> tuple[int, dict]:
    """Makes what `change` makes of the newest version the next one.  The file is
    written under another name and takes its own only if that is free; if another
    writer was first, the change is made of that one's version instead."""
    while True:
        found = current(spark, folder)
        number, body = (found[0] + 1 if found else 1), dict(change(found[1] if found else None))
        waiting = f"{folder}/{FOLDER}/{uuid.uuid4().hex}.new"
        tables.put_text(spark, waiting, json.dumps(body))
        try:
            if tables.move(spark, waiting, path(folder, number)):
                return number, body
        except Py4JJavaError:
            pass
        tables.remove(spark, waiting)
        if number not in numbers(spark, folder):
            raise OSError(f"could not write version {number} of {folder}")


def prune(spark: SparkSession, folder: str, parts_of: Callable[[dict], set[str]], keep: int = 2) -> list[str]:
    """Removes all but the newest versions, and the parts that only removed ones name."""
    found = numbers(spark, folder)
    bodies = {n: json.loads(tables.get_text(spark, path(folder, n))) for n in found}
    held = set().union(*(parts_of(bodies[n]) for n in found[-keep:]))
    gone = sorted(set().union(*(parts_of(bodies[n]) for n in found[:-keep])) - held) if found[:-keep] else []
    for n in found[:-keep]:
        tables.remove(spark, path(folder, n))
    for part in gone:
        tables.remove(spark, f"{folder}/{part}")
    return gone
