"""Graph-path geometry as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: one oriented segment of a graph path.
PATH_SEGMENT = r"([><])([^><:\s]+):(\d+)-(\d+)"
SEGMENT_TYPE = "array<struct<ctg:string,st:bigint,en:bigint,fwd:boolean,p_st:bigint,p_en:bigint>>"


def path_segments(path: str, tlen: str) -> Column:
    """Segments of a graph path with their offsets on the path; a contig is one forward segment."""
    pat = PATH_SEGMENT.replace("\\", "\\\\")
    part = lambda i: f"regexp_extract_all({path}, '{pat}', {i})"
    return F.expr(
        f"""
        if({path} rlike '^[><]',
          aggregate(
            transform(
              arrays_zip({part(1)}, {part(2)}, {part(3)}, {part(4)}),
              z -> named_struct('o', z.`0`, 'c', z.`1`, 'a', z.`2`, 'b', z.`3`)),
            cast(array() as {SEGMENT_TYPE}),
            (s, e) -> array_append(s, named_struct(
              'ctg', e.c, 'st', cast(e.a as bigint), 'en', cast(e.b as bigint), 'fwd', e.o = '>',
              'p_st', coalesce(get(s, size(s) - 1).p_en, 0L),
              'p_en', coalesce(get(s, size(s) - 1).p_en, 0L) + cast(e.b as bigint) - cast(e.a as bigint)))),
          cast(array(named_struct('ctg', {path}, 'st', 0L, 'en', cast({tlen} as bigint), 'fwd', true,
                                  'p_st', 0L, 'p_en', cast({tlen} as bigint))) as {SEGMENT_TYPE}))
        """
    )


def segment_index(segs: str, off: str, is_end: bool) -> str:
    """SQL text: index of the segment an offset falls in, or the number of segments past the end."""
    left_behind = "<" if is_end else "<="
    return f"size(filter({segs}, g -> g.p_en {left_behind} {off}))"


def on_contig(seg: str, off: str) -> str:
    """SQL text: contig coordinate of a path offset inside one segment."""
    return f"if({seg}.fwd, {seg}.st + ({off} - {seg}.p_st), {seg}.en - ({off} - {seg}.p_st))"
