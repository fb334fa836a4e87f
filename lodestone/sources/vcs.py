"""Text of version-control tools into rows; captured text is a source like any other."""

from __future__ import annotations

import configparser
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph_files import sqlite_table


def parse_log(text: str) -> list[tuple[str, str]]:
    """(commit, file) of a log that names files after each 40-digit hash."""
    commit, out = "", []
    for line in text.splitlines():
        line = line.strip()
        if re.fullmatch(r"[0-9a-f]{40}", line):
            commit = line
        elif line and commit:
            out.append((commit, line))
    return out


def parse_numstat(text: str) -> list[tuple[str, int, int]]:
    """(file, added, deleted); binary files, marked by dashes, are left out."""
    found = (re.fullmatch(r"(\d+)\t(\d+)\t(.+)", line) for line in text.splitlines())
    return [(m[3], int(m[1]), int(m[2])) for m in found if m]


def parse_log_frame(lines: DataFrame) -> DataFrame:
    """The same for a DataFrame (log, number, line) of many logs: each file line takes the last hash above
    it in its log."""
    is_hash = F.col("line").rlike("^[0-9a-f]{40}$")
    w = Window.partitionBy("log").orderBy("number")
    rows = lines.withColumn("commit", F.last(F.when(is_hash, F.col("line")), ignorenulls=True).over(w))
    return rows.where(~is_hash & (F.trim("line") != "") & F.col("commit").isNotNull()).select("log", "commit", F.trim("line").alias("file"))


def parse_blame(text: str) -> list[tuple[int, str, str]]:
    """(line, commit, author) of porcelain blame: a commit's author is told once and holds afterwards."""
    authors, out, commit, line = {}, [], "", 0
    for row in text.splitlines():
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
        elif row.startswith("author "):
            authors[commit] = row[7:]
        elif row.startswith("\t"):
            out.append((line, commit, authors.get(commit, "")))
    return out


def parse_submodules(text: str) -> list[tuple[str, str, str]]:
    """(name, path, url) of a submodules file."""
    c = configparser.ConfigParser()
    c.read_string(re.sub(r"^[ \t]+", "", text, flags=re.M))
    return [(s.split('"')[1], c[s].get("path", ""), c[s].get("url", "")) for s in c.sections() if s.startswith("submodule")]


def parse_timeline(text: str) -> list[tuple[str, str, str]]:
    """(date, time, message) of a timeline: days stand on lines of their own."""
    day, out = "", []
    for line in text.splitlines():
        if m := re.match(r"=== (\d{4}-\d{2}-\d{2})", line):
            day = m[1]
        elif m := re.match(r"(\d{2}:\d{2}:\d{2}) (.+)", line):
            out.append((day, m[1], m[2]))
    return out


def exit_code(errors: int, warnings: int) -> int:
    """For continuous integration: 0 clean, 1 errors, 2 warnings alone."""
    return 1 if errors else 2 if warnings else 0


def annotations(findings: list[dict]) -> list[str]:
    """One line for each finding in the form that build logs mark up."""
    return [f"::{'error' if f['severity'] == 'error' else 'warning'} file={f.get('offending_file', '')}::{f['message']}" for f in findings]


# What ticket tables call their columns, the likelier name first.
TICKET_COLUMNS = {
    "ticket_id": ("tkt_uuid", "uuid", "ticket_id"), "title": ("title", "summary"), "status": ("status", "tkt_status"), "type": ("type", "tkt_type"), "priority": ("priority", "tkt_priority"),
    "severity": ("severity", "tkt_severity"), "assignee": ("assignee", "assigned_to"), "resolution": ("resolution", "tkt_resolution"), "content": ("comment", "description"), "updated_at": ("tkt_mtime", "mtime"),
}


def fossil_timeline(spark: SparkSession, path: str) -> DataFrame:
    """(kind, at, user, comment) of a repository file's events; ``kind`` is theirs (ci check-in, w wiki, t ticket).
    A user or comment that was edited later counts as edited.  Read in ranges of row ids by tasks."""
    rows = sqlite_table(spark, path, "event", ["type", "mtime", "user", "euser", "comment", "ecomment"])
    at = F.timestamp_millis(F.round((F.col("mtime").cast("double") - 2440587.5) * 86_400_000).cast("long"))  # Julian days
    return rows.select(F.col("type").alias("kind"), at.alias("at"), F.coalesce("euser", "user").alias("user"), F.coalesce("ecomment", "comment").alias("comment"))


def fossil_tickets(spark: SparkSession, path: str) -> DataFrame:
    """(TICKET_COLUMNS, name) of a repository file's tickets; '' where a table lacks a column.  A ticket's name is
    its title, or its id; rows with neither are left out."""
    rows = sqlite_table(spark, path, "ticket", sorted({c for names in TICKET_COLUMNS.values() for c in names}))
    first = lambda names: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in names], F.lit(""))
    out = rows.select(*[first(names).alias(k) for k, names in TICKET_COLUMNS.items()])
    return out.withColumn("name", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("ticket_id"))).where("name <> ''")
