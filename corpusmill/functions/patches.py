"""Unified diffs as columns: read by a fold over their lines, counted, judged
against a scope and applied to a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

LINE = "struct<file:string,sign:string,old_at:int,new_at:int,text:string>"
_HUNK = r"\A@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def read_patch(patch: Column) -> Column:
    """struct(lines, ok): every line of every hunk with its file, its sign
    (space, minus or plus) and its places in the old and the new text; ok if
    hunks hold as many lines as they say and nothing else stands inside them.

    Inside a hunk its counts say what is still to come, so a removed line that
    reads `-- a/x` or an added one that reads `++ b/x` opens no file.  A new
    file is named by its plus side, a deleted one by its minus side.  A null
    patch is null, an empty one has no lines and is ok.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("old_file"), F.lit(None).cast("string").alias("file"), *[F.lit(0).alias(x) for x in ("old_at", "new_at", "old_left", "new_left")],
        F.array().cast(f"array<{LINE}>").alias("lines"), F.lit(True).alias("ok"),
    )

    def step(s: Column, line: Column) -> Column:
        inside = (s["old_left"] > 0) | (s["new_left"] > 0)
        sign = F.when(line == "", " ").otherwise(F.left(line, F.lit(1)))
        note = sign == "\\"  # no newline at the end of the file
        minus, plus = inside & sign.isin(" ", "-"), inside & sign.isin(" ", "+")
        hunk = ~inside & line.rlike(_HUNK)
        part = lambda i: F.nullif(F.regexp_extract(line, _HUNK, i), F.lit("")).cast("int")
        count = lambda i: F.coalesce(part(i), F.lit(1))
        first = lambda i: part(i) + (count(i + 1) == 0).cast("int")  # noqa: E731  an empty side names the line before it
        name = lambda side: F.regexp_extract(line, rf"\A{side} (?:[ab]/)?([^\t]*)", 1)
        opens = ~inside & line.startswith("+++ ")
        strange = inside & ~note & ~sign.isin(" ", "-", "+")
        here = F.struct(s["file"].alias("file"), sign.alias("sign"), s["old_at"].alias("old_at"), s["new_at"].alias("new_at"), F.substring(line, 2, 1 << 30).alias("text"))
        one = lambda c: c.cast("int")
        return F.struct(
            F.when(~inside & line.startswith("--- "), name("---")).otherwise(s["old_file"]).alias("old_file"),
            F.when(opens, F.when(name(r"\+\+\+") == "/dev/null", s["old_file"]).otherwise(name(r"\+\+\+"))).otherwise(s["file"]).alias("file"),
            F.when(hunk, first(1)).otherwise(s["old_at"] + one(minus)).alias("old_at"),
            F.when(hunk, first(3)).otherwise(s["new_at"] + one(plus)).alias("new_at"),
            F.when(hunk, count(2)).otherwise(s["old_left"] - one(minus)).alias("old_left"),
            F.when(hunk, count(4)).otherwise(s["new_left"] - one(plus)).alias("new_left"),
            F.when(minus | plus, F.concat(s["lines"], F.array(here))).otherwise(s["lines"]).alias("lines"),
            (s["ok"] & ~strange & (s["old_left"] >= 0) & (s["new_left"] >= 0) & ~(hunk & s["file"].isNull())).alias("ok"),
        )

    end = lambda s: F.struct(s["lines"].alias("lines"), (s["ok"] & (s["old_left"] == 0) & (s["new_left"] == 0)).alias("ok"))
    text = F.regexp_replace(patch, r"\n\z", "")
    return F.when(patch.isNotNull(), F.aggregate(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1)), start, step, end))


def changes(lines: Column) -> Column:
    """The lines that were removed or added."""
    return F.filter(lines, lambda x: x["sign"] != " ")


def files_of(lines: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["file"])))


def in_scope(lines: Column, *prefixes: Column) -> Column:
    """Whether every changed file lies below one of these folders."""
    below = lambda f: F.exists(F.array(*prefixes), lambda p: f.startswith(p))
    return F.forall(files_of(lines), below)


def precision(lines: Column, wanted: Column) -> tuple[Column, Column]:
    """(relevant, total) changed lines: those that a patch that is known to be
    right has too, and all (MET-08)."""
    key = lambda x: F.struct(x["file"], x["sign"], x["text"])
    mine = F.transform(changes(lines), key)
    return F.size(F.filter(mine, lambda k: F.array_contains(F.transform(changes(wanted), key), k))).cast("long"), F.size(mine).cast("long")


def applies(lines: Column, old: Column, file: Column) -> Column:
    """Whether what a patch expects of a file, context and removed lines, is
    there, line by line."""
    return bound(F.filter(lines, lambda x: (x["file"] == file) & (x["sign"] != "+")), lambda own: F.forall(own, lambda x: F.coalesce(F.get(old, x["old_at"] - 1) == x["text"], F.lit(False))))


def patched(lines: Column, old: Column, file: Column) -> Column:
    """The lines of a file after the patch, null if it does not apply."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.slice(old, s["at"], F.greatest(x["old_at"] - s["at"], F.lit(0)))
        out = F.concat(s["out"], before, F.when(x["sign"] == "-", F.array().cast("array<string>")).otherwise(F.array(x["text"])))
        return F.struct((x["old_at"] + (x["sign"] != "+").cast("int")).alias("at"), out.alias("out"))

    end = lambda s: F.concat(s["out"], F.slice(old, s["at"], F.greatest(F.size(old) - s["at"] + 1, F.lit(0))))
    return F.when(applies(lines, old, file), F.aggregate(F.filter(lines, lambda x: x["file"] == file), start, step, end))
