"""Change journals: events of a volume folded into a catalogue.

Event: frn, parent_frn, name, is_dir, usn, reason, drive. Bits of the reason tell what may have
happened; what has is looked up in the state of the file system, a table of
(path, status, size, allocated, mtime, ctime, flags) with status 'ok' or 'unknown' (could not be
read); a path that is not there is gone. So a batch is joins and latest-per-key, not a loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import paths
from quillon.sources.catalog import COLUMNS
from quillon.sources.scratch import durable

#: Bits of a reason (fixed values).
DATA_OVERWRITE, DATA_EXTEND, DATA_TRUNCATION = 0x1, 0x2, 0x4
FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW = 0x100, 0x200, 0x1000, 0x2000
BASIC_INFO, HARD_LINK = 0x8000, 0x10000
REFRESH = DATA_OVERWRITE | DATA_EXTEND | DATA_TRUNCATION | BASIC_INFO
MASK = REFRESH | FILE_CREATE | FILE_DELETE | RENAME_OLD | RENAME_NEW | HARD_LINK

EVENT = "drive string, frn long, parent_frn long, name string, is_dir boolean, usn long, reason long"


def of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a journal: users are records."""
    reason = F.create_map(*[F.lit(x) for kv in {"signup": FILE_CREATE, "error": FILE_DELETE, "purchase": RENAME_NEW, "click": BASIC_INFO, "view": DATA_EXTEND}.items() for x in kv])
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lit("D").alias("drive"), F.col("user_id").alias("frn"), F.lit(5).cast("long").alias("parent_frn"), F.concat(F.lit("u"), "user_id").alias("name"),
                    F.lit(False).alias("is_dir"), F.col("event_id").alias("usn"), F.element_at(reason, F.col("event_type")).cast("long").alias("reason"))


def has(reason: int):
    return F.col("reason").bitwiseAND(reason) != 0


def masked(events: DataFrame, mask: int = MASK) -> DataFrame:
    return events.where(has(mask))


def latest(events: DataFrame, key: list[str]) -> DataFrame:
    """The last event of each key: a maximum, kept as a partial one per task."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), "usn").alias("_e")).select(*key, "_e.*")


def refresh_once(events: DataFrame) -> DataFrame:
    """Of the events that only changed contents, the first of each record."""
    only = events.where(has(REFRESH) & ~has(FILE_CREATE | RENAME_NEW | HARD_LINK))
    rest = [c for c in events.columns if c not in ("drive", "frn")]
    return only.groupBy("drive", "frn").agg(F.min_by(F.struct(*rest), "usn").alias("_e")).select("drive", "frn", "_e.*")


def moved_subtree(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """What is below directory ``old``, under ``new``; the directory itself is not among it."""
    return catalog.withColumn("path", paths.rewrite_prefix(F.col("path"), old, new)).where(F.col("path").isNotNull())


@dataclass
class Applied:
    """The catalogue after a batch, half renames that wait for their other half, counts, and the
    batch's own share: paths that left the catalogue and rows that came or moved."""

    live: DataFrame
    dir_old: DataFrame
    stats: dict[str, int]
    removed: DataFrame
    delta: DataFrame


def _sub(*parts):
    return F.concat(parts[0], F.lit("\\"), *parts[1:])


def directories(live: DataFrame) -> DataFrame:
    """(drive, frn, path) of the directories of a catalogue, one path each."""
    some = live.where(F.col("is_dir") & F.col("frn").isNotNull())
    return some.groupBy(paths.drive_of("path").alias("drive"), "frn").agg(F.min_by("path", "id").alias("path"))


def placed(events: DataFrame, dirs: DataFrame) -> DataFrame:
    """Events with path: that of the parent's record in ``dirs`` (the root: 5) and the name; null if unknown."""
    known = dirs.select("drive", F.col("frn").alias("parent_frn"), F.col("path").alias("_parent"))
    e = events.withColumn("drive", F.upper("drive")).join(known, ["drive", "parent_frn"], "left")
    return e.withColumn("path", F.when(F.col("parent_frn") == 5, _sub(F.concat("drive", F.lit(":")), "name")).otherwise(_sub(F.col("_parent"), "name"))).drop("_parent")


def below_moves(df: DataFrame, path: str, old: DataFrame) -> DataFrame:
    """Rows of ``df`` at or below one of old(_to, old), with the deepest as _to and what follows it as
    _rest. One join of ancestors with the moves, however many there are."""
    marked = df.select(F.struct(*df.columns).alias("_row"), path)
    up = marked.select("_row", F.explode(F.array_append(paths.ancestors(path), F.col(path))).alias("_above")).withColumn("_ci", paths.fold_path("_above"))
    hits = up.join(old.select("_to", paths.fold_path("old").alias("_ci")), "_ci")
    best = hits.groupBy("_row").agg(F.max_by("_to", F.length("_above")).alias("_to"), F.max(F.length("_above")).alias("_n"))
    return best.select("_row.*", "_to", F.substring(F.col(f"_row.{path}"), F.col("_n") + 1, F.length(f"_row.{path}")).alias("_rest"))


def nearest_move(df: DataFrame, path: str, old: DataFrame) -> DataFrame:
    """All of ``df`` with _to and _rest; both null outside the moves."""
    out = below_moves(df, path, old)
    marked = df.withColumn("_row", F.struct(*df.columns))
    rest = marked.join(out.select(F.struct(*df.columns).alias("_row")), "_row", "left_anti")
    return out.union(rest.select("_row.*", F.lit(None).cast(old.schema["_to"].dataType).alias("_to"), F.lit(None).cast("string").alias("_rest")))


def names(events: DataFrame) -> DataFrame:
    """The names that a batch gave, over time: drive, frn, parent_frn, name, is_dir, reason, from_usn, to_usn.

    A name begins where its record was made, linked or renamed to it, and ends (to_usn) where the record
    is renamed away from it or deleted; null: it stands at the end of the batch. What a link event did is
    for the state to say. Contents that changed begin no name and end none, so they are left out, and
    a record that is written to all the time is no large group here.
    """
    e = events.where(has(FILE_CREATE | FILE_DELETE | RENAME_OLD | RENAME_NEW | HARD_LINK)).withColumn("drive", F.upper("drive"))
    after = Window.orderBy("usn").rowsBetween(1, Window.unboundedFollowing)
    renamed = F.min(F.when(has(RENAME_OLD), F.col("usn"))).over(after.partitionBy("drive", "frn", "parent_frn", "name"))
    gone = F.min(F.when(has(FILE_DELETE), F.col("usn"))).over(after.partitionBy("drive", "frn"))
    to = F.when(has(FILE_DELETE), F.col("usn")).otherwise(F.least("_renamed", "_gone"))
    spans = e.withColumn("_renamed", renamed).withColumn("_gone", gone).where(has(FILE_CREATE | RENAME_NEW | HARD_LINK))
    return spans.select("drive", "frn", "parent_frn", "name", "is_dir", "reason", F.col("usn").alias("from_usn"), to.alias("to_usn"))


def as_of(events: DataFrame, spans: DataFrame, live_dirs: DataFrame, depth: int = 4096) -> DataFrame:
    """Events with path_then: where the event's name stood at its own usn; null if a parent is unknown.

    A parent's name is that of the span of ``spans`` (see :func:`names`) which holds the usn, else the path of
    the record in ``live_dirs``, as it was when the batch began, if the parent was not made or renamed before.
    One join a level of directories that the batch names; ``depth`` ends a loop that no file system has.
    """
    key = ["drive", "parent_frn"]
    first = spans.where("is_dir").groupBy("drive", F.col("frn").alias("parent_frn")).agg(F.min("from_usn").alias("_first"))
    dirs = spans.where("is_dir").groupBy("drive", F.col("frn").alias("parent_frn"), "from_usn").agg(F.max_by(F.struct(F.col("parent_frn").alias("p"), F.col("name").alias("n")), F.struct("to_usn", "name")).alias("_up"))
    known = live_dirs.select("drive", F.col("frn").alias("parent_frn"), F.col("path").alias("_live"))
    todo = durable(events.withColumn("drive", F.upper("drive")).withColumn("_event", F.struct(*events.columns)).select("_event", "drive", "parent_frn", "usn", F.concat(F.lit("\\"), "name").alias("_tail")), "journal-as-of")
    done = None
    for _ in range(depth):
        root = todo.where("parent_frn = 5").select("_event", F.concat("drive", F.lit(":"), "_tail").alias("path_then"))
        rest = todo.where("parent_frn IS NULL OR parent_frn <> 5").join(known, key, "left").join(first, key, "left")
        named = rest.where("_first <= usn").drop("_live", "_first")
        ended = rest.where("_first IS NULL OR _first > usn").select("_event", F.concat("_live", "_tail").alias("path_then"))
        part = durable(root.union(ended), "journal-as-of")
        done = part if done is None else done.union(part)
        up = named.join(dirs, key).where(F.col("from_usn") <= F.col("usn")).groupBy("_event", "drive", "usn", "_tail").agg(F.max_by("_up", "from_usn").alias("_up"))
        todo = durable(up.select("_event", "drive", F.col("_up.p").alias("parent_frn"), "usn", F.concat(F.lit("\\"), "_up.n", "_tail").alias("_tail")), "journal-as-of")
        if todo.isEmpty():
            break
    return done.select("_event.*", "path_then")


def new_directories(spans: DataFrame, live_dirs: DataFrame, moved: DataFrame) -> DataFrame:
    """(drive, frn, path) of directories that the batch made or renamed, as they are at its end.

    A directory stands under its parent, wherever that is by now: a parent can be another of them, at any
    depth, or a live directory at or below one that ``moved`` (drive, frn, old). Its own path is not asked
    for: one that takes the name of a directory which moved does not follow it.
    """
    last = spans.where("is_dir").groupBy("drive", "frn").agg(F.max_by(F.struct("parent_frn", "name"), "from_usn").alias("_n")).select("drive", "frn", "_n.*")
    key = F.struct("drive", "frn")
    own = last.select(F.struct("drive", F.col("frn")).alias("_base")).distinct().withColumn("_own", F.lit(True))
    nodes = last.withColumn("_base", F.struct("drive", F.col("parent_frn").alias("frn"))).join(own, "_base", "left")
    inner = nodes.where("_own").select(key.alias("key"), F.col("_base").alias("base"), F.concat(F.lit("\\"), "name").alias("rest"))
    outer = nodes.where("_own IS NULL").join(live_dirs.select("drive", F.col("frn").alias("parent_frn"), F.col("path").alias("parent")), ["drive", "parent_frn"], "left")
    outer = outer.select(key.alias("key"), F.when(F.col("parent_frn") == 5, F.concat("drive", F.lit(":"))).otherwise(F.col("parent")).alias("parent"), "name").where("parent IS NOT NULL")
    follow = nearest_move(outer, "parent", moved.select(key.alias("_to"), "old"))
    named = lambda c: F.concat(c, F.lit("\\"), "name")
    waiting = durable(inner.union(follow.where("_to IS NOT NULL").select("key", F.col("_to").alias("base"), named("_rest").alias("rest"))), "journal-dirs")
    level = durable(follow.where("_to IS NULL").select("key", named("parent").alias("path")), "journal-level")
    found = level
    while not level.isEmpty():
        below = waiting.join(level.select(F.col("key").alias("base"), "path"), "base").select("key", F.concat("path", "rest").alias("path"))
        level = durable(below.join(found.select("key"), "key", "left_anti"), "journal-level")
        found = found.union(level)
    return found.select("key.drive", "key.frn", "path")


#: Where entries wait whose directory has lost its name to another and has no new one yet.
PARKED = "$Renaming"


def directory_moves(batch: DataFrame, spans: DataFrame, live_dirs: DataFrame, dir_old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new directories, moves, waiting): drive, frn and path of directories made or renamed; drive, frn, old,
    new of those that stood at ``old`` when the batch began; and drive, frn, old of those whose new name
    is still to come, with where their entries are now.

    Who moved is told by record, from where it stood at the begin (its live path, else where it waits) to
    where it is at the end, however often its name changed between. A record that the batch makes has no old
    place, even if its number was one's before. If a name is taken by another while its old directory
    waits for the second half of its rename, the entries of that one are parked under its number.
    """
    some = F.col("is_dir") & has(FILE_CREATE | RENAME_OLD | RENAME_NEW)
    if batch.where(some).isEmpty():  # no directory's name changes
        none = live_dirs.where("false")
        return none.select("drive", "frn", "path"), none.select("drive", "frn", F.col("path").alias("old"), F.col("path").alias("new")), dir_old.select("drive", "frn", "old")
    begin = dir_old.select("drive", "frn", "old").unionByName(live_dirs.join(dir_old, ["drive", "frn"], "left_anti").select("drive", "frn", F.col("path").alias("old")))
    key = ["drive", "frn"]
    asked = batch.where(some).groupBy(*key).agg(
        F.max(F.when(has(RENAME_NEW | FILE_CREATE), F.col("usn"))).alias("_new"), F.max(F.when(has(RENAME_OLD), F.col("usn"))).alias("_old"), F.max(has(FILE_CREATE)).alias("_made"))
    known = durable(begin.join(asked, key, "left").where(F.col("_new").isNotNull() | F.col("_old").isNotNull()).unionByName(
        dir_old.join(asked, key, "left_anti").select("drive", "frn", "old"), allowMissingColumns=True), "journal-begin")
    movers = known.where(F.col("_new").isNotNull() & ~F.col("_made")).select("drive", "frn", "old")
    fresh = durable(new_directories(spans, live_dirs, movers), "journal-new-dirs")
    moves = movers.join(fresh.withColumnRenamed("path", "new"), key)
    half = known.where(~F.coalesce("_made", F.lit(False)) & (F.col("_new").isNull() | (F.col("_old") > F.col("_new"))))
    still = half.where("_new IS NULL").select("drive", "frn", "old")
    taken = still.join(fresh.select(paths.fold_path("path").alias("_ci")).distinct(), paths.fold_path("old") == F.col("_ci"), "left_semi")
    parked = taken.withColumn("new", F.concat("drive", F.lit(f":\\{PARKED}\\"), F.col("frn").cast("string")))
    moves = durable(moves.unionByName(parked).where(paths.fold_path("old") != paths.fold_path("new")), "journal-moves")
    left = nearest_move(still.join(parked, key, "left_anti"), "old", moves.select(F.col("new").alias("_to"), F.col("old")))
    waiting = left.select("drive", "frn", F.when(F.col("_to").isNull(), F.col("old")).otherwise(F.concat("_to", "_rest")).alias("old")).unionByName(parked.select("drive", "frn", F.col("new").alias("old")))
    twice = half.where("_new IS NOT NULL").select("drive", "frn").join(fresh, key).withColumnRenamed("path", "old")
    return fresh, moves, waiting.unionByName(twice)


def apply(live: DataFrame, events: DataFrame, state: DataFrame | Callable[[DataFrame], DataFrame], dir_old: DataFrame) -> Applied:
    """One batch of events on the catalogue ``live`` (see :mod:`quillon.sources.catalog`).

    ``state`` is the table of the file system, or gives it for a table of paths, those of the events
    and those that the catalogue holds for their records.

    In this order: directories that moved take their subtrees along, of any size and number, in one
    join; names that an event may have ended go if the state lacks them or another entry has come to their
    place; names that stand at the end of the batch (see :func:`names`), or were written to, take the state's figures
    (unknown: zeros), each path once. Parents are looked up among the directories of the batch first,
    then among the live ones where they are now. Ids of new rows follow the largest there is.
    """
    spark = live.sparkSession
    batch = durable(masked(events).withColumn("drive", F.upper("drive")), "journal-batch")
    live_dirs = durable(directories(live), "journal-live-dirs")
    spans = durable(names(batch), "journal-names")
    fresh_dirs, pairs, waiting = directory_moves(batch, spans, live_dirs, dir_old.withColumn("drive", F.upper("drive")))
    waiting = durable(waiting, "journal-waiting")
    stats = {"applied": 0, "resolve_fail": 0, "subtree_moved": 0}
    live = live.select(*COLUMNS)
    moved, shifted = live, live.where("false").withColumn("_was", F.col("path"))
    ci = paths.fold_path("path")
    own = live.select("id", paths.drive_of("path").alias("drive"), "frn", ci.alias("_ci"))
    left_place = live.where("false").select("id")
    moves = not pairs.isEmpty()
    if moves:
        # what moved stands elsewhere now; its own row comes anew if the state has it
        left_place = own.join(pairs.select("drive", "frn", paths.fold_path("old").alias("_ci")), ["drive", "frn", "_ci"], "left_semi").select("id")
        under = below_moves(live, "path", pairs.select(F.col("new").alias("_to"), "old")).where("_rest <> ''")
        shifted = durable(under.withColumn("_was", F.col("path")).withColumn("path", F.concat("_to", "_rest")).drop("_to", "_rest"), "journal-moved")
        stats["subtree_moved"] = shifted.count()
        moved = live.join(shifted.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(shifted.select(*COLUMNS))
    now = directories(moved).join(fresh_dirs.select("drive", "frn"), ["drive", "frn"], "left_anti").unionByName(fresh_dirs)
    now = durable(now, "journal-dirs-now")
    at = durable(placed(batch, now), "journal-placed")
    stats["resolve_fail"] = at.where(F.col("path").isNull() & has(FILE_CREATE | RENAME_NEW | HARD_LINK)).count()
    # what may be gone: every name of a deleted or re-linked record, the old name of a renamed one
    ended = at.where(has(FILE_DELETE | HARD_LINK)).select("drive", "frn", F.lit(None).cast("string").alias("_only"))
    ended = ended.union(at.where(has(RENAME_OLD)).select("drive", "frn", "name")).distinct()
    keyed = moved.withColumn("drive", paths.drive_of("path")).withColumn("_ci", ci)
    if callable(state):
        held = keyed.join(at.select("drive", "frn").distinct(), ["drive", "frn"], "left_semi")
        state = durable(state(at.select("path").where("path IS NOT NULL").union(held.select("path")).distinct()), "journal-state")
    known = state.withColumn("_ci", ci).dropDuplicates(["_ci"])
    suspects = keyed.join(ended, ["drive", "frn"])
    named = suspects.withColumn("_fits", F.col("_only").isNull() | paths.same_name(F.col("path"), F.col("_only")))
    # a rename whose old name fits none doubts the first name of the record
    none = named.groupBy("drive", "frn").agg(F.max(F.col("_fits").cast("int")).alias("_any"), F.min("id").alias("_first"))
    doubted = named.join(none, ["drive", "frn"]).where(F.col("_fits") | ((F.col("_any") == 0) & (F.col("id") == F.col("_first")))).select("id", "_ci").distinct()
    retired = durable(doubted.join(known.select("_ci"), "_ci", "left_anti").select("id").distinct(), "journal-retired")
    # an entry that came along with its directory to the place of one that stayed
    landed = shifted.select(ci.alias("_ci")).distinct()
    replaced = keyed.join(shifted.select("id"), "id", "left_anti").join(landed, "_ci").select("id") if moves else left_place
    # what stands at the end, or was written to
    ends = spans.select("drive", "frn", "parent_frn", "name", F.col("from_usn").alias("usn"), F.coalesce(F.col("to_usn").isNull(), F.lit(False)).alias("_stands")).distinct()
    came = at.where(has(FILE_CREATE | RENAME_NEW | HARD_LINK) & F.col("path").isNotNull()).join(ends, ["drive", "frn", "parent_frn", "name", "usn"], "left")
    over = batch.groupBy("drive", "frn", "parent_frn", "name").agg(F.max(F.when(has(RENAME_OLD), F.col("usn"))).alias("_over"))
    fresh = refresh_once(at).where(F.col("path").isNotNull()).join(over, ["drive", "frn", "parent_frn", "name"], "left").where("_over IS NULL OR _over < usn")
    fresh = fresh.join(keyed.select("drive", "frn").distinct(), ["drive", "frn"], "left_semi")
    touched = came.select("path", "frn", "is_dir", "usn", F.lit(True).alias("_new"), "_stands").unionByName(fresh.select("path", "frn", "is_dir", "usn", F.lit(False).alias("_new"), F.lit(True).alias("_stands")))
    touched = touched.withColumn("_ci", ci).groupBy("_ci").agg(F.max_by(F.struct("path", "frn", "is_dir", "_new", "_stands"), F.struct("_stands", "_new", "usn")).alias("_t")).select("_ci", "_t.*")
    looked = durable(touched.join(known.drop("path"), "_ci", "left"), "journal-looked")
    seen = F.col("_stands") & ((F.col("status") == "ok") | ((F.col("status") == "unknown") & F.col("_new")))
    gone = F.col("status").isNull() & F.col("_new")
    upserts, vanished = looked.where(seen), looked.where(gone).select("_ci")
    # names of refreshed records under paths that are gone go too
    stale = keyed.join(upserts.where(~F.col("_new")).select("frn", F.col("_ci").alias("_at")), "frn").where(F.col("_ci") != F.col("_at")).join(known.select("_ci"), "_ci", "left_anti").select("id")
    every = moved.withColumn("_ci", ci)
    by_id = retired.union(stale).union(replaced).union(left_place).distinct()
    by_path = upserts.select("_ci").union(vanished).distinct()
    ended_ids = durable(every.join(by_id, "id", "left_semi").select("id", "path").union(every.join(by_path, "_ci", "left_semi").select("id", "path")).distinct(), "journal-ended")
    left = moved.join(ended_ids.select("id"), "id", "left_anti").select(*COLUMNS)
    top = moved.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
    zero = lambda c: F.when(F.col("status") == "ok", F.coalesce(c, F.lit(0))).otherwise(0)
    rows = upserts.select("path", "is_dir", zero(F.col("size")).cast("long").alias("size"), zero(F.col("allocated")).cast("long").alias("allocated"), zero(F.col("mtime")).cast("long").alias("mtime"),
                          zero(F.col("ctime")).cast("long").alias("ctime"), zero(F.col("flags")).cast("int").alias("flags"), "frn")
    from quillon.sources.catalog import numbered

    stats["applied"], stats["stat_gone"] = looked.agg(F.count_if(seen), F.count_if(gone)).first()
    stats["retired"] = retired.count()
    new = numbered(rows, ["path"], top + 1).select(*COLUMNS) if stats["applied"] else spark.createDataFrame([], live.select(*COLUMNS).schema)
    # a row that moved left its old path; one that ended after a move was never in the catalogue at the new one
    removed = ended_ids.join(shifted.select("id"), "id", "left_anti").select("path").union(shifted.select("_was")).distinct()
    delta = shifted.select(*COLUMNS).join(ended_ids.select("id"), "id", "left_anti").select(*COLUMNS).unionByName(new)
    return Applied(left.unionByName(new), waiting, stats, removed, delta)


def replay_status(stored: int, first: int, following: int) -> str:
    """'gap' (records are lost: rebuild), 'current' or 'replayable'."""
    if stored < first:
        return "gap"
    return "current" if following <= stored else "replayable"
