"""Analytics over a write-ahead log: analysis, redo and undo, outcomes of two-phase commit, commit index of a replicated log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_transactions(log: DataFrame) -> DataFrame:
    """Analysis: transactions whose last record is no COMMIT or ABORT, with that record."""
    ended = F.max(F.when(F.col("type").isin("COMMIT", "ABORT"), F.col("lsn")))
    by_tx = log.groupBy("tx_id").agg(F.max("lsn").alias("last_lsn"), ended.alias("ended"))
    return by_tx.where(F.col("ended").isNull() | (F.col("ended") < F.col("last_lsn"))).drop("ended")


def dirty_pages(log: DataFrame, flushed: DataFrame | None = None) -> DataFrame:
    """Analysis: the first record that each page may miss. flushed: page_id, page_lsn of pages on disk."""
    changes = log.where(F.col("page_id").isNotNull())
    if flushed is not None:
        known = flushed.select(F.col("page_id").alias("_p"), "page_lsn")
        changes = changes.join(known, F.col("page_id") == F.col("_p"), "left").where(F.col("lsn") > F.coalesce("page_lsn", F.lit(-1)))
    return changes.groupBy("page_id").agg(F.min("lsn").alias("rec_lsn"))


def redone(log: DataFrame, flushed: DataFrame | None = None) -> DataFrame:
    """Redo: the last image of each record of a page that the log has and the page on disk has not."""
    changes = log.where(F.col("page_id").isNotNull())
    if flushed is not None:
        known = flushed.select(F.col("page_id").alias("_p"), "page_lsn")
        changes = changes.join(known, F.col("page_id") == F.col("_p"), "left").where(F.col("lsn") > F.coalesce("page_lsn", F.lit(-1)))
    last = changes.groupBy("page_id", "slot").agg(F.max(F.struct("lsn", "after_image")).alias("v"), F.count("*").alias("redone"))
    return last.select("page_id", "slot", F.col("v.lsn").alias("page_lsn"), F.col("v.after_image").alias("image"), "redone")


def undone(log: DataFrame) -> DataFrame:
    """Undo: the image that each record of a loser goes back to (null: it is deleted).

    What a compensation record has undone is not undone again: its undo_next_lsn is the last record still to undo. Of a
    record's remaining changes the earliest holds the image before all of them.
    """
    losers = active_transactions(log).select(F.col("tx_id").alias("_t"))
    mine = log.join(losers, F.col("tx_id") == F.col("_t"), "left_semi")
    last_clr = mine.where("type = 'CLR'").groupBy("tx_id").agg(F.max(F.struct("lsn", "undo_next_lsn")).alias("c"))
    last_clr = last_clr.select(F.col("tx_id").alias("_c"), F.col("c.undo_next_lsn").alias("next"))
    left = mine.where(F.col("type").isin("INSERT", "UPDATE")).join(last_clr, F.col("tx_id") == F.col("_c"), "left")
    left = left.where(F.col("_c").isNull() | (F.col("lsn") <= F.coalesce("next", F.lit(0))))
    first = left.groupBy("page_id", "slot").agg(F.min(F.struct("lsn", "tx_id", "type", "before_image")).alias("v"), F.count("*").alias("undone"))
    image = F.when(F.col("v.type") == "UPDATE", F.col("v.before_image"))
    return first.select("page_id", "slot", F.col("v.tx_id").alias("tx_id"), image.alias("image"), "undone")


def compensation(log: DataFrame) -> DataFrame:
    """The compensation records that undo() would log: one for each change that is left, newest first, pointing at the
    next older one of its transaction."""
    losers = active_transactions(log).select(F.col("tx_id").alias("_t"))
    last_clr = log.where("type = 'CLR'").groupBy("tx_id").agg(F.max(F.struct("lsn", "undo_next_lsn")).alias("c"))
    last_clr = last_clr.select(F.col("tx_id").alias("_c"), F.col("c.undo_next_lsn").alias("next"))
    left = log.where(F.col("type").isin("INSERT", "UPDATE")).join(losers, F.col("tx_id") == F.col("_t"), "left_semi")
    left = left.join(last_clr, F.col("tx_id") == F.col("_c"), "left").where(F.col("_c").isNull() | (F.col("lsn") <= F.coalesce("next", F.lit(0))))
    return left.select("tx_id", F.col("lsn").alias("undoes_lsn"), F.lit("CLR").alias("type"), "page_id", "slot", F.col("before_image").alias("after_image"), F.col("prev_lsn").alias("undo_next_lsn"))


def recovered(log: DataFrame, flushed: DataFrame | None = None) -> dict[str, int]:
    """How much recovery does: active transactions, rolled back, operations redone and undone."""
    active = active_transactions(log).count()
    again = redone(log, flushed).agg(F.sum("redone")).first()[0] or 0
    back = undone(log).agg(F.sum("undone")).first()[0] or 0
    return {"active": active, "rolled_back": active, "redone": again, "undone": back}


def outcomes(log: DataFrame, tx: str, decided: Column, finished: Column | None = None) -> DataFrame:
    """Two-phase commit with presumed abort: COMMIT where the coordinator logged its decision, else ABORT. With
    finished, also whether the decision must be sent again."""
    commit = F.max(F.when(decided, 1).otherwise(0)) == 1
    columns = [F.when(commit, "COMMIT").otherwise("ABORT").alias("decision")]
    if finished is not None:
        columns.append((commit & (F.max(F.when(finished, 1).otherwise(0)) == 0)).alias("resend"))
    return log.groupBy(tx).agg(*columns)


# --- replicated logs


def commit_index(match: DataFrame, log: DataFrame, term: Column) -> DataFrame:
    """match: group_id, node_id, match_index (the leader's own among them); log: group_id, index, term. The largest index
    that a majority holds and that is of the current term; 0 without one."""
    held = match.groupBy("group_id").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("m"))  # a group's nodes
    majority = held.select("group_id", F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int")).alias("most"))
    own = log.where(F.col("term") == term).select(F.col("group_id").alias("_g"), "index")
    return majority.join(own, (F.col("group_id") == F.col("_g")) & (F.col("index") <= F.col("most")), "left").groupBy("group_id").agg(F.coalesce(F.max("index"), F.lit(0)).alias("commit_index"))


def up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    """Whether a candidate's last entry lets a voter grant its vote."""
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def conflict_index(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """Both: group_id, index, term. The first index at which the follower must take the leader's entries."""
    theirs = follower.select(F.col("group_id").alias("_g"), F.col("index").alias("_i"), F.col("term").alias("_t"))
    both = leader.join(theirs, (F.col("group_id") == F.col("_g")) & (F.col("index") == F.col("_i")), "left")
    return both.where(F.col("_t").isNull() | (F.col("_t") != F.col("term"))).groupBy("group_id").agg(F.min("index").alias("conflict_index"))


def can_read(read_index: Column, applied: Column, acks: Column, nodes: Column) -> Column:
    """ReadIndex: a leader that a majority has acknowledged may answer once it has applied that far."""
    return (acks * 2 > nodes) & (applied >= read_index)
