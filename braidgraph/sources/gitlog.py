"""Trees and logs of a git repository as tables, through the git command."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import coalesced, tracked, tree_diff


class GitError(Exception):
    code = "E_NO_GIT_REPO"


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def is_repo(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git"))


def head(root: str) -> str:
    return _git(root, "rev-parse", "HEAD").strip()


def tree(spark: SparkSession, root: str, commit: str = "HEAD") -> DataFrame:
    """path, oid of all files of a commit."""
    rows = [(path, meta.split()[2]) for line in _git(root, "ls-tree", "-r", "-z", commit).split("\0") if line for meta, _, path in [line.partition("\t")]]
    return spark.createDataFrame(rows, "path string, oid string")


def log(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """commit, path, seq, type of the changes of each commit, oldest first."""
    kinds, rows, seq = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "T": "MODIFY"}, [], 0
    text = _git(root, "log", "--reverse", "--no-renames", "--name-status", "--format=%x01%H", *([f"{since}..HEAD"] if since else []))
    for block in text.split("\x01")[1:]:
        commit, _, rest = block.partition("\n")
        for line in rest.splitlines():
            kind, tab, path = line.partition("\t")
            if tab and kind[0] in kinds:
                seq += 1
                rows.append((commit.strip(), path, seq, kinds[kind[0]]))
    return spark.createDataFrame(rows, "commit string, path string, seq long, type string")


def changes(spark: SparkSession, root: str, last: str | None) -> DataFrame:
    """path, type since a commit, by comparing trees; by folding the whole log if the repository lacks that commit."""
    if last is None:
        raise GitError("no last commit is stored")
    try:
        before = tree(spark, root, last)
    except GitError:
        folded = coalesced(log(spark, root))
        return folded.where(tracked(F.col("path")))
    return tree_diff(before, tree(spark, root))
