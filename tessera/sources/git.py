"""What git knows of a working tree, as DataFrames: changed files with their ranges, and the history of a place.

git runs on the driver, where the working tree is; a failing call gives no rows for a history and
raises for a comparison, as an empty comparison would look like no changes.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.diff import git_log, parse_name_status

RANGES = "path string, diff string"
_TIMEOUT = 60


def run_git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=_TIMEOUT)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').splitlines()[0] if done.stderr else done.returncode}")
    return done.stdout.decode(errors="replace")


def changed_files(spark: SparkSession, root: str, base: str, worktree: bool = False) -> DataFrame:
    """(status, file_path, old_path, diff) of what differs from base, by path.

    Without worktree it is what HEAD has since it left base; with it, the working tree against
    that point, untracked files as added ones that are new from their first line to their last.
    """
    fork = run_git(root, "merge-base", base, "HEAD").strip()
    target = [fork] if worktree else [fork, "HEAD"]
    rows: list[tuple[str, str, str | None, str]] = []
    for status, path, old in parse_name_status(run_git(root, "diff", "--name-status", "-M", *target)):
        names = [n for n in (old, path) if n]
        diff = run_git(root, "diff", "-M", "--unified=0", *target, "--", *names) if not status.startswith("D") else ""
        rows.append((status, path, old, diff))
    if worktree:
        for path in filter(None, run_git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0")):
            file = Path(root) / path
            lines = len(file.read_bytes().splitlines()) if file.is_file() else 0
            rows.append(("??", path, None, f"@@ -0,0 +1,{lines} @@" if lines else ""))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "status string, file_path string, old_path string, diff string")


def history(spark: SparkSession, root: str, path: str, first: int | None = None, last: int | None = None, limit: int = 5) -> DataFrame:
    """(hash, date, author, message, diff) of the last commits that touched a file, or some of its lines; none if git can't tell."""
    place = [f"-L{first},{last}:{path}"] if first is not None and last is not None else ["-p", "--follow", "--", path]
    try:
        text = run_git(root, "log", f"-n{limit}", "--date=short", *place)
    except (RuntimeError, subprocess.TimeoutExpired, OSError):
        text = ""
    return git_log(spark.createDataFrame([(text,)], "text string").where(F.col("text") != ""), "text")
