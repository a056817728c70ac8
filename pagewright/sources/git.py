"""Changes and history of a git working copy, as DataFrames."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def parse_name_status(text: str) -> dict[str, str]:
    """path -> status of git's name-status lines; a rename is a deletion and an addition, a copy an addition."""
    out: dict[str, str] = {}
    for line in filter(None, text.split("\n")):
        code, *paths = line.split("\t")
        if code[0] == "R" and len(paths) == 2:
            out |= {paths[0]: "D", paths[1]: "A"}
        elif code[0] == "C" and len(paths) == 2:
            out[paths[1]] = "A"
        elif paths:
            out[paths[0]] = code[0]
    return out


def parse_porcelain(text: str) -> dict[str, str]:
    """path -> status of the NUL-separated porcelain form."""
    out: dict[str, str] = {}
    parts = iter(text.split("\0"))
    for p in parts:
        if len(p) < 4:
            continue
        code, path = p[:2].strip() or "M", p[3:]
        if code[0] == "R":
            out[next(parts, "")] = "D"
            out[path] = "A"
        else:
            out[path] = "A" if code == "??" else "D" if "D" in code else code[0]
    return out


def changes(spark: SparkSession, repo: str, since: str | None, subdir: str = "") -> DataFrame:
    """(path, status) since a commit and in the working tree, which wins."""
    found = parse_name_status(_git(repo, "diff", "--name-status", "-M", f"{since}..HEAD")) if since else {}
    found |= parse_porcelain(_git(repo, "status", "--porcelain", "-z", "-uall"))
    rows = [(p, s) for p, s in sorted(found.items()) if p.endswith(".md") and p.startswith(subdir)]
    return spark.createDataFrame(rows, "path string, status string")


def history(spark: SparkSession, repo: str, path: str = "", limit: int = 10, follow: bool = True) -> DataFrame:
    """(hash, date, message, author), newest first, of a path or of the whole repository."""
    args = ["log", "--format=%H%x1f%aI%x1f%s%x1f%an", f"-n{limit}"]
    args += ["--follow"] * bool(path and follow) + (["--", path] if path else [])
    rows = [tuple(line.split("\x1f")) for line in _git(repo, *args).split("\n") if line]
    return spark.createDataFrame(rows, "hash string, date string, message string, author string")


def init(repo: str) -> None:
    _git(repo, "init", "-q")


def head(repo: str) -> str:
    """Hash of the last commit; an empty text where there is none."""
    try:
        return _git(repo, "rev-parse", "--verify", "-q", "HEAD").strip()
    except subprocess.CalledProcessError:
        return ""


def commit(repo: str, message: str, paths: list[str] | None = None) -> str:
    """Commit all, or some paths; the hash, or an empty text if there is nothing to commit."""
    _git(repo, "add", "--", *(paths or ["."]))
    staged = subprocess.run(["git", "-C", repo, "diff", "--cached", "--quiet"], check=False).returncode
    if not staged:
        return ""
    named = subprocess.run(["git", "-C", repo, "var", "GIT_COMMITTER_IDENT"], check=False, capture_output=True).returncode == 0
    author = [] if named else ["-c", "user.name=pagewright", "-c", "user.email=pagewright@localhost"]
    _git(repo, *author, "commit", "-q", "-m", message, *(["--", *paths] if paths else []))
    return head(repo)
