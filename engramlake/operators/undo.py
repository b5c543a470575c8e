"""Rollback of apply attempts as data: what is undone, what is refused, and what is left of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.steps import settled


def decided(contribs: DataFrame, attempts: DataFrame, rounds: int = 50) -> DataFrame:
    """attempt, status: undone, or refused where a later attempt that stays has an active contribution on one of its pages.

    contribs: attempt, page, active; attempts: those to undo. A refused attempt stays, and may so have an earlier one refused: that is a fixpoint, one join a round, over
    the attempts to undo. Of a page only the latest attempt that stays matters, which is one number, so a page with many contributions is a partial aggregate, not a group.
    Without contributions an attempt is undone. If `rounds` do not reach the fixpoint, that is an error.
    """
    wanted = settled(attempts.select("attempt").distinct())
    touched = settled(contribs.filter("page IS NOT NULL").groupBy("attempt", "page").agg(F.max(F.col("active").cast("int")).alias("live")))
    mine = settled(touched.join(wanted, "attempt", "left_semi").select("attempt", "page"))
    live = touched.filter("live = 1").select("attempt", "page")
    # of the attempts that stay anyhow only the last of each page counts
    others = live.join(wanted, "attempt", "left_anti").join(mine.select("page").distinct(), "page", "left_semi")
    last = others.groupBy("page").agg(F.max("attempt").alias("last"))
    held = settled(mine.join(last, "page").filter(F.col("last") > F.col("attempt")).select("attempt").distinct())
    own = live.join(mine.select("page").distinct(), "page", "left_semi")
    for _ in range(rounds):
        kept = own.join(held, "attempt", "left_semi").groupBy("page").agg(F.max("attempt").alias("last"))
        more = mine.join(kept, "page").filter(F.col("last") > F.col("attempt")).select("attempt").distinct().join(held, "attempt", "left_anti")
        more = settled(more)
        if more.isEmpty():
            break
        held = settled(held.unionByName(more))
    else:
        raise RuntimeError(f"attempts to undo depend on each other over more than {rounds} rounds")
    return wanted.join(held.withColumn("_held", F.lit(True)), "attempt", "left").select("attempt", F.when(F.col("_held"), "refused").otherwise("undone").alias("status"))


def rolled_back(contribs: DataFrame, journal: DataFrame, attempts: DataFrame) -> dict[str, DataFrame]:
    """Undo attempts by their inverse records, the last first.

    contribs: contribution_id, attempt, page, active. journal: seq, attempt, row (what was changed), before (its value before the change; null: it was not there). Results:

    - attempts: attempt, status, deactivated (contributions that were active).
    - rows: row, value (to be written; null: to be removed), undone (records replayed), and refused (records of undone attempts that stay, as another attempt has changed the row since).
      Replaying in reverse order ends with what was before the first record replayed, so each row is an aggregate over its records, not a walk.
    - pages: page, active (contributions left), orphaned (none is left).
    """
    status = settled(decided(contribs, attempts))
    gone = status.filter("status = 'undone'").select("attempt")
    live = contribs.filter("active").groupBy("attempt").agg(F.count(F.lit(1)).alias("n"))
    counted = status.join(live, "attempt", "left").select("attempt", "status", F.when(F.col("status") == "undone", F.coalesce("n", F.lit(0))).otherwise(0).alias("deactivated"))

    j = journal.join(gone.withColumn("_gone", F.lit(True)), "attempt", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    since = j.groupBy("row").agg(F.max(F.when(~F.col("_gone"), F.col("seq"))).alias("since"), F.max("_gone").alias("any")).filter("any")
    mine = j.filter("_gone").join(since.select("row", "since"), "row")
    free = F.col("since").isNull() | (F.col("seq") > F.col("since"))
    rows = mine.groupBy("row").agg(
        F.min_by("before", F.when(free, F.col("seq"))).alias("value"), F.count(F.when(free, 1)).alias("undone"), F.count(F.when(~free, 1)).alias("refused")
    )

    on = contribs.filter("page IS NOT NULL").join(gone.withColumn("_gone", F.lit(True)), "attempt", "left")
    left = on.groupBy("page").agg(F.count(F.when(F.col("active") & F.col("_gone").isNull(), 1)).alias("active"), F.max(F.coalesce("_gone", F.lit(False))).alias("_any"))
    return {"attempts": counted, "rows": rows, "pages": left.filter("_any").select("page", "active", (F.col("active") == 0).alias("orphaned"))}
