"""Three-way merges of texts by lines and of files by units.

A text merge looks at the one range of base lines that each side replaces: what is left between the common beginning and the
common end. Ranges that do not meet are both applied, the earlier one first; ranges that only touch are apart, too. A unit merge joins
three versions of a file by unit, decides each unit by what changed and by its kind, and writes a file anew from its units only if none of
them is in conflict. Null texts count as empty ones; units with a null path or key are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloom.operators.history import common_prefix


def lines_of(text: Column) -> Column:
    """The lines of a text, each with its line end; a last one without is a line, too."""
    return F.filter(F.split(text, "(?<=\\n)"), lambda x: x != "")


def hunk(base: Column, other: Column, at: Column) -> Column:
    """start, end (from 0, end excluded) of the replaced lines of base and the lines that replace them; at is how many first lines are equal."""
    rest = lambda c: F.reverse(F.slice(c, (at + 1).cast("int"), F.size(c)))
    same = common_prefix(rest(base), rest(other))
    new = F.slice(other, (at + 1).cast("int"), (F.size(other) - at - same).cast("int"))
    return F.struct(at.alias("start"), (F.size(base) - same).alias("end"), new.alias("lines"))


def merged_texts(versions: DataFrame) -> DataFrame:
    """The rows (with base, left, right) with decision and merged: left, right or both sides' changes, or null in a conflict."""
    v = versions.withColumns({c: F.coalesce(c, F.lit("")) for c in ("base", "left", "right")})
    v = v.withColumns({f"_{c}": lines_of(F.col(c)) for c in ("base", "left", "right")})
    v = v.withColumns({f"_{c}_at": common_prefix(F.col("_base"), F.col(f"_{c}")) for c in ("left", "right")})
    v = v.withColumns({f"_{c}_hunk": hunk(F.col("_base"), F.col(f"_{c}"), F.col(f"_{c}_at")) for c in ("left", "right")})
    le, r, base = F.col("_left_hunk"), F.col("_right_hunk"), F.col("_base")
    part = lambda start, end: F.slice(base, (start + 1).cast("int"), F.greatest(F.lit(0), end - start).cast("int"))
    joined = lambda a, b: F.array_join(F.concat(part(F.lit(0), a["start"]), a["lines"], part(a["end"], b["start"]), b["lines"], part(b["end"], F.size(base))), "")
    decision = (
        F.when(F.col("base") == F.col("left"), "right").when((F.col("base") == F.col("right")) | (F.col("left") == F.col("right")), "left")
        .when(le["end"] <= r["start"], "left then right").when(r["end"] <= le["start"], "right then left").otherwise("conflict")
    )
    v = v.withColumn("decision", decision)
    kind = F.col("decision")
    text = F.when(kind == "right", F.col("right")).when(kind == "left", F.col("left")).when(kind == "left then right", joined(le, r)).when(kind == "right then left", joined(r, le))
    return v.select(*versions.columns, "decision", text.alias("merged"))


def sync_events(versions: DataFrame) -> DataFrame:
    """The rows (base, left: ours, right: theirs) with event: skip for equal contents, receive or push if one side alone changed, merge or conflict by what the lines allow."""
    kind = F.col("decision")
    event = F.when(F.col("left").eqNullSafe(F.col("right")), "skip").when(kind == "right", "receive").when(kind == "left", "push").when(kind == "conflict", "conflict").otherwise("merge")
    return merged_texts(versions).withColumn("event", event)


def merged_units(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """path, key, kind, decision, conflict, taken for units (path, key, kind, signature, content, line, col): taken is the unit that stays, null if none does.

    Units are equal by content. Decisions are base, left, right, deleted, conflict. Of units that change on both sides, a function or method stays with
    the side that alone changes its signature. Kinds: function, method, class, const, variable, import; others diverge as bodies do.
    """
    side = lambda df, name: df.where("path IS NOT NULL AND key IS NOT NULL").select("path", "key", F.struct("kind", "signature", "content", "line", "col").alias(name))
    rows = side(base, "b").join(side(left, "l"), ["path", "key"], "full").join(side(right, "r"), ["path", "key"], "full")
    b, le, r = F.col("b"), F.col("l"), F.col("r")
    equal = lambda x, y: x["content"].eqNullSafe(y["content"]) & (x.isNull() == y.isNull())
    kind = F.coalesce(b["kind"], le["kind"], r["kind"])
    function = kind.isin("function", "method")
    left_signed, right_signed = ~le["signature"].eqNullSafe(b["signature"]), ~r["signature"].eqNullSafe(b["signature"])
    diverged = (
        F.when(function & left_signed & right_signed & ~le["signature"].eqNullSafe(r["signature"]), "API_SIGNATURE_DIVERGED")
        .when(function & (left_signed != right_signed), F.lit(None)).when(equal(le, r), F.lit(None))
        .when(kind.isin("const", "variable"), "CONST_VALUE_CONFLICT").when(kind == "import", "IMPORT_ALIAS_CONFLICT").otherwise("BODY_DIVERGED")
    )
    both = b.isNotNull() & le.isNotNull() & r.isNotNull() & ~equal(b, le) & ~equal(b, r)
    conflict = (
        F.when(b.isNull() & le.isNotNull() & r.isNotNull() & ~equal(le, r), "CONCURRENT_CREATE")
        .when(b.isNotNull() & le.isNull() & r.isNotNull() & ~equal(b, r), "DELETE_vs_MODIFY").when(b.isNotNull() & r.isNull() & le.isNotNull() & ~equal(b, le), "MODIFY_vs_DELETE")
        .when(both, diverged)
    )
    decision = (
        F.when(conflict.isNotNull(), "conflict").when(equal(b, le) & equal(b, r), "base").when(b.isNull(), F.when(le.isNotNull(), "left").otherwise("right")).when(le.isNull() | r.isNull(), "deleted")
        .when(equal(b, r), "left").when(equal(b, le), "right").when(function & right_signed & ~left_signed, "right").otherwise("left")
    )
    rows = rows.select("path", "key", kind.alias("kind"), conflict.alias("conflict"), decision.alias("decision"), "b", "l", "r")
    taken = F.when(F.col("decision") == "base", b).when(F.col("decision") == "left", le).when(F.col("decision") == "right", r)
    return rows.select("path", "key", "kind", "decision", "conflict", taken.alias("taken"))


def rebuilt_files(units: DataFrame) -> DataFrame:
    """path, conflicts, content of merged units: the contents by line, then column, then key, an empty line between them; null if any unit is in conflict."""
    place = F.struct(F.col("taken.line").alias("line"), F.col("taken.col").alias("col"), "key", F.col("taken.content").alias("content"))
    files = units.groupBy("path").agg(F.count("conflict").alias("conflicts"), F.array_sort(F.collect_list(F.when(F.col("taken").isNotNull(), place))).alias("parts"))  # one file's units
    content = F.concat(F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n"), F.lit("\n"))
    return files.select("path", "conflicts", F.when(F.col("conflicts") == 0, content).alias("content"))
