"""CIGAR, difference-string and base-sequence expressions.

Walks over the tokens of a string are Arrow functions of a few lines: as lambdas over arrays Spark interprets
them token by token, which cost more than the rest of an extraction.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

import strandloom

# The walks travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(strandloom)

# Token patterns of the alignment formats.
CIGAR_TOKEN = r"(\d+)([=XIDM])"
DIFF_TOKEN = r"([\+\-\*:])([A-Za-z\[\]0-9]+)"
FLANKED_SEQ = r"(?:\[([A-Za-z]+)\])?([A-Za-z]+)(?:\[([A-Za-z]+)\])?"

INDELS = {"st": "bigint", "en": "bigint", "len": "bigint", "qoff_l": "bigint", "qoff_r": "bigint"}
DIFFS = {"st": "bigint", "en": "bigint", "len": "bigint", "l": "string", "mid": "string", "r": "string", "polya": "bigint"}
# How far an offset moved by the flanks reaches, up to and including an indel.
DIFFS |= {"stl": "bigint", "enl": "bigint", "str": "bigint", "enr": "bigint"}


def reverse_complement(seq: Column) -> Column:
    """Lower-case reverse complement; ``n`` is removed."""
    return F.translate(F.reverse(F.lower(seq)), "acgtn", "tgca")


def _per_row(walk: Callable, fields: dict[str, str], *cols: str | Column) -> Column:
    """Array of structs of ``fields``: for each row the tuples that ``walk`` makes of the columns, or null."""
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    types = [arrow[t] for t in fields.values()]

    def run(*args: pa.Array) -> pa.Array:
        found, ends, missing = [], [0], []
        for values in zip(*[a.to_pylist() for a in args]):
            items = walk(*values)
            missing.append(items is None)
            found.extend(items or ())
            ends.append(len(found))
        parts = [pa.array(part, t) for part, t in zip(zip(*found) if found else [()] * len(types), types)]
        items = pa.StructArray.from_arrays(parts, names=list(fields))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array(missing, pa.bool_()))

    return F.arrow_udf(run, f"array<struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>>")(*cols)


def cigar_indels(cg: str, tst: str, qst: str, qen: str, strand: str, min_len: int) -> Column:
    """Insertions and deletions of at least ``min_len`` with reference and query coordinates.

    One pass over the tokens carrying the reference cursor ``x`` and the query cursor ``q``.
    """
    tokens = re.compile(CIGAR_TOKEN, re.ASCII).findall

    def walk(cg, tst, qst, qen, strand):
        if cg is None or tst is None or qst is None or qen is None:
            return None
        x, q, out = tst, 0, []
        for n, op in tokens(cg):
            n = int(n)
            if op == "I":
                if n >= min_len:
                    out.append((x, x, n, qen - q - n, qen - q) if strand == "-" else (x, x, n, qst + q, qst + q + n))
                q += n
            elif op == "D":
                if n >= min_len:
                    at = qen - q if strand == "-" else qst + q
                    out.append((x, x + n, -n, at, at))
                x += n
            else:
                x += n
                q += n
        return out

    return _per_row(walk, INDELS, cg, tst, qst, qen, strand)


def diff_indels(ds: str | Column, tst: str, min_len: int, penalty: int = 5, drop: int = 100) -> Column:
    """Long insertions and deletions of a difference string, their flanks split off, and the tail length of the rest."""
    tokens, flanked = re.compile(DIFF_TOKEN).findall, re.compile(FLANKED_SEQ).search
    tail = _tail_length(penalty, drop)

    def walk(ds, tst):
        if ds is None or tst is None:
            return None
        x, out, far = tst, [], (tst,) * 4
        for op, seq in tokens(ds):
            if op == ":":
                x += int(seq)
            elif op == "*":
                x += 1
            else:
                n = len(seq) - seq.count("[") - seq.count("]")
                if n >= min_len:
                    m = flanked(seq)
                    left, mid, right = (g or "" for g in m.groups()) if m else ("", "", "")
                    en = x if op == "+" else x + n
                    spots = (x - len(right), en - len(right), x + len(left), en + len(left))
                    far = tuple(map(max, far, spots)) if out else spots
                    out.append((x, en, n if op == "+" else -n, left, mid, right, tail(mid), *far))
                if op == "-":
                    x += n
        return out

    return _per_row(walk, DIFFS, ds, tst)


def _tail_length(penalty: int, drop: int) -> Callable[[str], int]:
    """Length of the poly-A tail of a sequence, or minus that of a leading poly-T run if it scores more.

    x-drop extension from the end and from the start: best score and the length reaching it first.  Works on runs of the
    base and runs of other bases: within a run the score is monotone, so the best score is met at the end of a run
    and the drop is exceeded by the end of one.
    """
    runs = {b: re.compile(f"([{b}{b.lower()}]+)|[^{b}{b.lower()}]+") for b in "AT"}

    def extend(seq: str, base: str) -> tuple[int, int]:
        score = best = at = 0
        for run in runs[base].finditer(seq):
            n = run.end() - run.start()
            score += n if run.group(1) else -penalty * n
            if score > best:
                best, at = score, run.end()
            elif best - score > drop:
                break
        return best, at

    def length(seq: str) -> int:
        (a, a_at), (t, t_at) = extend(seq[::-1], "A"), extend(seq, "T")
        return a_at if a >= t else -t_at

    return length


def poly_a_length(seq: str, penalty: int = 5, drop: int = 100) -> Column:
    """Length of the poly-A tail, or minus the length of a leading poly-T run if that scores more."""
    length = _tail_length(penalty, drop)

    def run(seqs: pa.Array) -> pa.Array:
        return pa.array([None if s is None else length(s) for s in seqs.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(seq)
