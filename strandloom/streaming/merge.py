"""Clusters of signals from a stream that comes about in the order of positions.

Per contig and kind the rows of open islands are state.  An island is settled when no row can come within the window
any more: rows arrive with positions not more than ``lateness`` below the largest one seen, so that position less
``lateness`` is the watermark.  Settled islands go through the same ordered scan as in a batch, whole, and leave the
state.  Rows that come after their island was settled are not dropped: they are put out with ``late``.  With ``idle_ms``,
for streams that run on, a group without rows for that long is settled to its end; a run over what there is now
(``availableNow``) goes without it and leaves the last islands open for the next run.

The rows of one micro-batch's output are whole islands, so ``operators.merge.summarise`` on it (``foreachBatch``) gives
finished calls.

Defined cases: copies are counted as in a batch; a null position is late; a group's state is bounded by its open
islands, as the scan's is.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.operators.merge import OPTIONAL, SIGNATURE, VoteScan
from strandloom.params import MergeParams


def settled_islands(rows: Counter, at: int, limit: float, window: int) -> tuple[list[list[tuple]], Counter]:
    """Islands (runs with gaps of at most ``window`` in field ``at``) that end more than ``window`` below ``limit``; the rest."""
    order = sorted(rows, key=lambda r: r[at])
    islands: list[list[tuple]] = []
    for r in order:
        if not islands or r[at] - islands[-1][-1][at] > window:
            islands.append([])
        islands[-1].append(r)
    done = [x for x in islands if x[-1][at] + window < limit]
    return done, Counter({r: rows[r] for x in islands[len(done) :] for r in x})


def clustered(signals: DataFrame, p: MergeParams = MergeParams(), lateness: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Distinct signal rows with ``kind, island, cluster, n, is_mid, is_rt`` of settled islands, and ``late`` rows."""
    for c, t in OPTIONAL.items():
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(None).cast(t))
    if p.max_alleles is not None:
        raise ValueError("a limit on open clusters counts those of all kinds; a stream has them apart")
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("is_bp", "svtype", "ctg2")]
    rows = signals.drop("read").withColumn("kind", F.concat_ws("|", *own))
    attrs = sorted(c for c in rows.columns if c not in {"ctg", "kind", *SIGNATURE})
    names = [*SIGNATURE, *attrs]
    rows = rows.select("ctg", "kind", *names)
    whole = {f.name for f in rows.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))}
    tsd, tail = names.index("tsd_len"), names.index("polya_len")
    extra = [("island", T.LongType()), ("cluster", T.LongType()), ("n", T.LongType()), ("is_mid", T.BooleanType()), ("is_rt", T.BooleanType()), ("late", T.BooleanType())]
    out = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in extra]])

    def tuples(pdf: pd.DataFrame) -> Iterator[tuple]:
        cols = []
        for c in names:
            x = pdf[c].astype(object).where(pdf[c].notna(), None)
            cols.append([None if v is None else int(v) for v in x] if c in whole else [None if v is None else bool(v) for v in x] if c == "is_bp" else list(x))
        return zip(*cols)

    def scan(island: list[tuple], counts: Counter) -> Iterator[tuple]:
        found: list[tuple] = []
        votes = VoteScan(lambda batch, i, cluster, n, is_mid, is_rt: found.append((i, cluster, n, is_mid, is_rt)), p)
        arrival = sorted(island, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))
        for i, r in enumerate(arrival):
            votes.row(None, i, (*r[: len(SIGNATURE)], counts[r], r[tsd] is not None and r[tail] is not None))
        votes.close()
        first = island[0][0]
        for i, cluster, n, is_mid, is_rt in found:
            yield (*arrival[i], first, cluster, n, is_mid, is_rt, False)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, top, shut = pickle.loads(state.get[0]) if state.exists else (Counter(), None, None)
        made: list[tuple] = []
        if state.hasTimedOut:
            limit = float("inf")
        else:
            for pdf in frames:
                for r in tuples(pdf):
                    if r[0] is None or shut is not None and r[0] <= shut:
                        made.append((*r, None, None, 1, None, None, True))
                    else:
                        held[r] += 1
                        top = r[0] if top is None else max(top, r[0])
            limit = float("-inf") if top is None else top - lateness
        done, rest = settled_islands(held, 0, limit, p.window)
        for island in done:
            made += scan(island, held)
            shut = island[-1][0] + p.window
        state.update((pickle.dumps((rest, top, shut)),))
        if idle_ms is not None and not state.hasTimedOut:
            state.setTimeoutDuration(idle_ms)
        if made:
            pdf = pd.DataFrame([(*key, *m) for m in made], columns=out.names, dtype=object)
            for f in out.fields:
                if isinstance(f.dataType, (T.LongType, T.IntegerType)):
                    pdf[f.name] = pdf[f.name].astype("Int64" if isinstance(f.dataType, T.LongType) else "Int32")
            yield pdf

    grouped = rows.groupBy("ctg", "kind")
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return grouped.applyInPandasWithState(step, out, "held binary", "append", timeout)
