"""Incremental synchronisation: eligibility, debouncing, jobs, reconciliation and change application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Extensions that are taken by default.
DEFAULT_EXTENSIONS = (
    ".pdf", ".docx", ".doc", ".odt",
    ".pptx", ".ppt", ".odp",
    ".xlsx", ".xls", ".ods",
    ".txt", ".md", ".rst", ".csv", ".rtf",
    ".html", ".htm", ".xml", ".json",
    ".msg", ".eml",
)
#: Extensions of temporary and system files.
TEMPORARY_EXTENSIONS = (
    ".tmp", ".temp", ".swp", ".swo", ".swn",
    ".lock", ".lck", ".pid",
    ".bak", ".bak2", ".orig",
    ".ds_store", ".thumbs",
    "~",
)
#: How names of temporary files begin.
TEMPORARY_PREFIXES = ("~$", ".~", "._")
#: Parts of a path that are never taken.
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg",
    "__pycache__", ".pytest_cache",
    "node_modules",
    ".venv", "venv", "env",
    "Thumbs.db", ".DS_Store",
)
#: Largest file in MB, most files of one scan, days that a tombstone stays.
MOST_MB, MOST_SCANNED, RETENTION_DAYS = 9999, 10_000, 90


def ignore_reason(path: Column, supported: tuple[str, ...] = DEFAULT_EXTENSIONS, size: Column | None = None, excluded_dirs: tuple[str, ...] = (), excluded_extensions: tuple[str, ...] = (), most_mb: float = MOST_MB) -> Column:
    """Why an event's file is not taken, or null: the first of temporary extension, unsupported one (none at all passes), temporary name, excluded part of the path, extension that the settings exclude, size in bytes (an unknown one passes)."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(F.lower(name), r".(\.[^.]+)$", 1)
    begins = F.lit(False)
    for p in TEMPORARY_PREFIXES:
        begins = begins | name.startswith(p)
    parts = F.array(*[F.lit(d) for d in (*EXCLUDED_DIRS, *excluded_dirs)])
    reason = F.when(ext.isin(*TEMPORARY_EXTENSIONS), "temporary extension").when((ext != "") & ~ext.isin(*supported), "unsupported extension").when(begins, "temporary name")
    reason = reason.when(F.arrays_overlap(F.split(path, "/"), parts), "excluded folder")
    if excluded_extensions:
        reason = reason.when(ext.isin(*excluded_extensions), "excluded extension")
    return reason if size is None else reason.when(size > F.lit(most_mb * 1024 * 1024), "too large")


def debounced(events: DataFrame, key: str, ts: str, action: str, gap: str) -> DataFrame:
    """One row for each quiet-period session of a key: its bounds, number of events and last action. Works on batches and streams alike."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.max_by(action, ts).alias("last_action"), F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "last_action", "n_events")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row of each key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[o.desc() for o in order])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def backoff_seconds(attempts: Column, base: int = 60, most: int = 3600) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempts - 1), F.lit(most)).cast("long")


def after_failure(attempts: Column, most: int = 3) -> Column:
    return F.when(attempts >= most, "dead").otherwise("failed")


def reconciled(disk: DataFrame, indexed: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """New, modified, deleted and unchanged paths of two snapshots."""
    a, b = disk.select(path, F.col(digest).alias("_disk")), indexed.select(path, F.col(digest).alias("_known"))
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_disk").isNull(), "deleted").when(F.col("_disk") != F.col("_known"), "modified").otherwise("unchanged")
    return a.join(b, path, "full_outer").select(path, change.alias("change"))


def replaced(store: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``store`` with the rows of changed keys taken out and the new rows put in: an upsert as a rewrite."""
    return store.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def taken(path: Column, given: tuple[str, ...] = (), size: Column | None = None, folders: bool = False, most_mb: float = MOST_MB) -> Column:
    """Does a scan take the file? By the given extensions, with or without a point, else the default ones; a name without extension passes. With ``size`` (null: the file is gone) only files of at most ``most_mb``. ``folders`` also leaves out excluded folders."""
    allowed = tuple(x if x.startswith(".") else f".{x}" for x in map(str.lower, given)) or DEFAULT_EXTENSIONS
    reason = ignore_reason(path, allowed)
    good = reason.isNull() if folders else reason.isNull() | (reason == "excluded folder")
    return good if size is None else good & F.coalesce(size <= F.lit(most_mb * 1024 * 1024), F.lit(False))


def logged(events: DataFrame, path: Column, supported: tuple[str, ...]) -> DataFrame:
    """Raw events with ``ignored`` and ``reason``, on batches and streams alike."""
    return events.withColumn("reason", ignore_reason(path, supported)).withColumn("ignored", F.col("reason").isNotNull())


def recent(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest ``n`` rows."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return rows.join(parents.select(key), key, "left_semi")


def purged(store: DataFrame, children: DataFrame, key: str, now: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """A store (``status, deleted_at``) without tombstones older than the retention, and its children without those of purged rows."""
    old = (F.col("status") == "deleted") & (F.col("deleted_at") < now - F.make_dt_interval(F.lit(days)))
    left = store.where(~F.coalesce(old, F.lit(False)))
    return left, with_parent(children, left, key)


def at_path(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with the document that is at their ``path``; deleted documents are at none."""
    return jobs.join(documents.where("status <> 'deleted'").drop("status"), "path", "left")


def index_of(path: Column, watched: list[tuple[str, str | None]], default: str = "documents") -> Column:
    """The index that a file goes to: that of the first watched folder it is in, else the name of the first folder below that one, else the default."""
    out = None
    for folder, index in watched:
        root = folder.rstrip("/") + "/"
        below = F.split(F.substring(path, F.lit(len(root) + 1), F.length(path)), "/")
        name = F.lit(index) if index else F.coalesce(F.when(F.size(below) > 1, T.index_name(F.get(below, F.lit(0)), None, True)), F.lit(default))
        out = F.when(path.startswith(root), name) if out is None else out.when(path.startswith(root), name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
