"""Rules of ignored paths: the last rule that matches decides, and a rule for a folder holds for all that is below it.

Rules are lines of an ignore file, in order: a leading ! takes paths back, a leading / ties the rule to the top, a final / means folders only, a
note @semantic-ignore leaves files in the snapshot but out of the analysis. Names without a slash match at any depth. Lines are few
and become one expression over the path, so a scan of files stays a scan; nothing is joined or shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.functions.paths import doublestar

NOTE = "@semantic-ignore"


class Rule(NamedTuple):
    pattern: str
    negated: bool
    folders: bool
    semantic: bool


def rule(line: str) -> Rule | None:
    """The rule of a line; None for an empty line or a comment."""
    text, semantic = line.strip(), NOTE in line
    if text.startswith("#"):
        return None
    if semantic:
        text = text[: text.index(NOTE)].strip()
    negated = text.startswith("!")
    text = text[negated:]
    folders = text.endswith("/")
    text = text.removesuffix("/")
    anchored = text.startswith("/")
    text = text[anchored:]
    if not text:
        return None
    if not anchored and "/" not in text:
        text = f"**/{text}"
    return Rule(doublestar(text), negated, folders, semantic)


def deciding(path: Column, lines: list[str], analysis: bool = False, is_folder: bool = False) -> tuple[Column, Column]:
    """Number of the last rule (from 1, by its line; 0 for none) that matches a path, and whether the path is ignored."""
    plain = F.regexp_replace(path, r"^\./", "")
    last, ignored = F.lit(0), F.lit(False)
    for number, line in enumerate(lines, 1):
        r = rule(line)
        if r is None or (r.semantic and not analysis):
            continue
        # A rule for folders matches a file only by what lies above it.
        hit = plain.rlike(f"^(?:{r.pattern})" + ("/.+$" if r.folders and not is_folder else "(?:/.*)?$"))
        last, ignored = F.when(hit, number).otherwise(last), F.when(hit, F.lit(not r.negated)).otherwise(ignored)
    return last, ignored


def judged(files: DataFrame, lines: list[str]) -> DataFrame:
    """files (path) with rule (that decides for the snapshot), captured and analysed."""
    number, out = deciding(F.col("path"), lines)
    unread = deciding(F.col("path"), lines, analysis=True)[1]
    return files.withColumns({"rule": number, "captured": ~out, "analysed": ~unread})

