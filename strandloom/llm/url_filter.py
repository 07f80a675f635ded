"""URL filters: a trie over reversed host labels and then path segments, shipped to all tasks.

A rule is ``(verdict, host, path)``.  It fits its host and all subdomains when the URL's path starts with
the rule's path; the rule that reaches deepest wins: more host labels first, then the longer path.  At the
same place a block entry wins over an allow entry.

The trie's size is that of the rules, which ``max_bytes`` bounds; a larger list is refused, not cut.

Defined cases: a null URL, or one without ``://``, has an empty host and path; no rule fits it.  Repeated
rules count once.  URLs that no rule fits get the default verdict.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HOST = re.compile(r"[/?#]")
PATH = re.compile(r"[?#]")
UPPER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as written."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = HOST.search(rest)
    host, tail = (rest, "") if end is None else (rest[: end.start()], rest[end.start() :])
    return host.translate(UPPER), PATH.split(tail, maxsplit=1)[0]


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nodes are dictionaries: ``labels`` by next host label, ``paths`` by next path segment, ``ends``.

    A path's last segment need not end at a slash, so it is kept as an ending to compare by prefix.
    """
    root: dict = {"labels": {}, "paths": {}, "ends": {}}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(UPPER).split(".")):
            node = node["labels"].setdefault(label, {"labels": {}, "paths": {}, "ends": {}})
        *whole, last = path.split("/")
        for segment in whole:
            node = node["paths"].setdefault(segment, {"labels": {}, "paths": {}, "ends": {}})
        if node["ends"].get(last, ("", ""))[0] != "block":
            node["ends"][last] = (verdict, host.translate(UPPER) + path)
    return root


def _deepest(node: dict, path: str) -> tuple[str, str] | None:
    """The longest rule path below a host node that ``path`` starts with."""
    found, segments, i = None, path.split("/"), 0
    while True:
        rest = segments[i] if i < len(segments) else ""
        fits = [e for e in node["ends"] if rest.startswith(e)] if i < len(segments) else []
        if fits:
            found = node["ends"][max(fits, key=len)]
        # A whole segment is followed by a slash in the URL too.
        if i + 1 >= len(segments) or segments[i] not in node["paths"]:
            return found
        node, i = node["paths"][segments[i]], i + 1


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """``(verdict, rule)`` of the deepest rule that fits."""
    node, found = trie, None
    for label in reversed(host.split(".")):
        node = node["labels"].get(label)
        if node is None:
            break
        found = _deepest(node, path) or found
    return found


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """``<id>, host, path, rule, verdict`` of every row; ``rule`` is null where none fits."""
    trie = build_trie(rules)
    if len(pickle.dumps(trie)) > max_bytes:
        raise ValueError(f"the rules take more than {max_bytes} bytes; raise max_bytes if executors can hold them")
    shipped = pages.sparkSession.sparkContext.broadcast(trie)

    def run(batches):
        rules_by_place = shipped.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [match(rules_by_place, h, p) or (default, None) if h else (default, None) for h, p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([x[i] for x in parts], pa.string()) for i in (0, 1)],
                    pa.array([x[1] for x in found], pa.string()),
                    pa.array([x[0] for x in found], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))
    out = rows.mapInArrow(run, "id long, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
