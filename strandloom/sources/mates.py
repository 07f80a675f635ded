"""Which of the records that name each other as mates stay.

Records are read in line order.  One whose id is claimed is dropped; one that stays claims its own id and its
mate's.  So whether a record stays hangs on earlier records only, each of which names one mate: the claims form
trees that point forward.  They are settled from the ends (a record that nobody left claims stays, and drops the
record it claims) and shortened in between (a record with a single claimant is the opposite of it, so its claim can
be read off that claimant): a chain takes rounds in the order of the logarithm of its length, and the tables hold
only ids that are claimed by a record that is claimed itself.

Defined cases: an id of ``.`` or null is no id, such a record always stays and claims its mate; a record that names
itself, or a record before it, as mate claims nothing that matters; of records that repeat an id all but the first
are dropped, and these claim nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandloom.session import settle


def _ids(claims: DataFrame) -> DataFrame:
    """First line and mate of every id."""
    rows = claims.filter("svid is not null and svid != '.'")
    return rows.groupBy("file_id", "svid").agg(F.min("line_no").alias("line_no"), F.min_by("mate", "line_no").alias("mate"))


def staying_lines(claims: DataFrame) -> DataFrame:
    """``file_id, svid, stays`` of records ``file_id, line_no, svid, mate``: the line of each id that stays (null: none)."""
    claims = settle(claims)
    ids = _ids(claims)
    target = ids.select(F.col("file_id").alias("_file"), F.col("svid").alias("x"), F.col("line_no").alias("_at"))
    claimed = lambda df: df.join(
        target, (F.col("file_id") == F.col("_file")) & (F.col("mate") == F.col("x")) & (F.col("line_no") < F.col("_at"))
    )
    free = claimed(claims.filter("svid is null or svid = '.'").filter("mate is not null")).select("file_id", F.col("x").alias("svid")).distinct()
    # x is claimed by c; ``odd``: the claim holds if c is dropped instead of if it stays.
    links = claimed(ids.filter("mate is not null")).select("file_id", "x", F.col("svid").alias("c"), F.lit(False).alias("odd"))
    links = settle(links.join(free.withColumnRenamed("svid", "x"), ["file_id", "x"], "left_anti"))
    free = settle(free)
    known = free.select("file_id", F.col("svid").alias("c"), F.lit(False).alias("stays"))
    gone = [free]
    while not links.isEmpty():
        open_ids = links.select("file_id", F.col("x").alias("c")).distinct().withColumn("open", F.lit(True))
        seen = links.join(open_ids, ["file_id", "c"], "left").join(known, ["file_id", "c"], "left")
        holds = F.coalesce("stays", F.lit(True)) != F.col("odd")
        state = F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(holds)
        per = seen.groupBy("file_id", "x").agg(
            F.bool_or(F.coalesce(state, F.lit(False))).alias("hit"), F.count_if(state.isNull()).alias("left"), F.min(F.when(state.isNull(), F.struct("c", "odd"))).alias("only")
        )
        per = settle(per)
        done = per.filter("hit or left = 0").select("file_id", F.col("x").alias("c"), (~F.col("hit")).alias("stays"))
        known, now = known.unionByName(done), done.filter("not stays")
        gone.append(now.select("file_id", F.col("c").alias("svid")))
        rest = seen.filter(state.isNull()).select("file_id", "x", "c", "odd").join(done.select("file_id", F.col("c").alias("x")), ["file_id", "x"], "left_anti")
        single = per.filter("not hit and left = 1").select("file_id", F.col("x").alias("c"), F.col("only.c").alias("past"), F.col("only.odd").alias("turn"))
        hop = rest.join(single, ["file_id", "c"], "left")
        turned = F.col("odd") == F.col("turn")  # two turns and the opposite between them
        links = settle(hop.select("file_id", "x", F.coalesce("past", "c").alias("c"), F.when(F.col("past").isNull(), F.col("odd")).otherwise(turned).alias("odd")))
    lost = reduce(DataFrame.unionByName, gone).withColumn("lost", F.lit(True))
    line = F.when(F.col("lost").isNull(), F.col("line_no"))
    return ids.join(lost, ["file_id", "svid"], "left").select("file_id", "svid", line.alias("stays"))
