"""Operator parameters.  Defaults are the command-line defaults of the tool this library replaces."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass


def parse_size(text: str | int | float) -> int:
    """``"20k"`` -> 20000; suffixes k, m and g, fractions allowed, rounded to the nearest unit."""
    m = re.match(r"(\d*\.?\d*)([kmgKMG]?)", str(text))
    if not m.group(1) or m.group(1) == ".":
        raise ValueError(f"not a size: {text!r}")
    scale = {"": 1, "k": 1_000, "m": 1_000_000, "g": 1_000_000_000}[m.group(2).lower()]
    return math.floor(float(m.group(1)) * scale + 0.499)


def read_level_length(min_len: int, ratio: float) -> int:
    """Calls are read with a softer length bound than the one they are reported with."""
    return math.floor(min_len * ratio + 0.499)


@dataclass(frozen=True)
class ExtractParams:
    min_mapq: int = 5
    min_mapq_end: int = 30
    min_frac: float = 0.7
    min_len: int = 100
    min_aln_len_end: int = 2000
    min_aln_len_mid: int = 50
    max_indels_per_10kb: int = 3
    polya_penalty: int = 5
    polya_drop: int = 100
    source: str = "foo"


@dataclass(frozen=True)
class MergeParams:
    min_count: int = 4
    min_count_strand: int = 2
    min_count_rt: int = 1
    min_rt_len: int = 0
    window: int = 100
    max_len_diff: float = 0.05
    min_cen_dist: int = 500_000
    max_alleles: int | None = None  # no limit; a number closes the oldest open cluster early


@dataclass(frozen=True)
class CallParams:
    """What a call reader keeps."""

    min_read_len: int = 80
    min_count: int = 0
    ignore_filter: bool = False
    check_gt: bool = False


@dataclass(frozen=True)
class CompareParams:
    min_len: int = 100
    min_count: int = 0
    window: int = 500
    min_len_ratio: float = 0.6
    min_vaf: float = 0.0


@dataclass(frozen=True)
class UnionParams:
    min_len: int = 100
    group_min_count: int = 5
    window: int = 500
    min_len_ratio: float = 0.6
    collapsed: bool = False
