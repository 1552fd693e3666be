"""History in Markdown: parsed with carried-forward state, latest entry per file, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scan import running

#: The headings and cells of the format.
DAY = (r"^##\s+(\d{4}-\d{2}-\d{2})\b", r"^##\s+.*?(\d{4}-\d{2}-\d{2})")
RUN = r"^###\s+\d{1,2}:\d{2}\s+[—-]\s+\d+\s+file\(s\)\s+(moved|renamed in place)\s*$"
SKIPPED_SECTION = r"(?i)^###\s+(Duplicates deleted|Renamed in destination|Skipped|Pending iteration)"
RULE = r"^\|\s*-+\s*(\|\s*-+\s*)+\|\s*$"
EMPTY_CELLS = ("—", "-", "–", "", "same")
COLUMNS = ("#", "Original", "Category", "Issuer", "New name", "Amount", "Destination")


def lines_of(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of files read whole, as (file, value)."""
    return files.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "line"))


def _empty(cell: Column) -> Column:
    return F.trim(cell).isin(*EMPTY_CELLS)


def parse(lines: DataFrame) -> DataFrame:
    """Entries of history files; needs (file, line_no, line).

    A day heading sets the day, makes the action a move and ends a skipped section.  Another third-level heading
    sets the action; a skipped section's leaves it as it was.  Rows are tables of seven cells and more that start
    with a number and whose destination is no deletion.

    Headings are state changes that leave out what they do not set, so that a range of lines adds up to one change.
    Ranges are summed up, the sums carried over later ranges, and applied (``scan.running``): a file of any length
    is spread.
    """
    t = lines.select("file", "line_no", F.rtrim("line").alias("line"))
    day = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in DAY])
    heading, skipped = F.startswith("line", F.lit("###")), F.col("line").rlike(SKIPPED_SECTION)
    t = t.withColumn("new_day", F.when(~heading & F.startswith("line", F.lit("##")), day))
    other = heading & ~skipped & F.col("new_day").isNull()
    run = F.when(F.regexp_extract("line", RUN, 1) == "renamed in place", F.lit("rename")).otherwise(F.lit("move"))
    t = t.withColumn("new_action", F.when(F.col("new_day").isNotNull(), F.lit("move")).when(other, run))
    skip = F.when(F.col("new_day").isNotNull() | other, F.lit(False)).when(heading & skipped, F.lit(True))
    t = t.withColumn("new_skip", skip)
    row = F.startswith("line", F.lit("|")) & ~F.col("line").rlike(RULE)
    t = t.where(F.col("new_skip").isNotNull() | row)  # a day or another heading always says whether to skip
    carried = {"last_day": F.col("new_day"), "last_action": F.col("new_action"), "last_skip": F.col("new_skip")}
    t = running(t, ["file"], ["line_no"], last=carried, name="history").select(
        "file",
        "line_no",
        "line",
        F.coalesce("last_day", F.lit("")).alias("day"),
        F.coalesce("last_action", F.lit("move")).alias("action_mode"),
        F.coalesce("last_skip", F.lit(False)).alias("skip"),
    )
    t = t.where(~F.col("skip") & F.startswith("line", F.lit("|")) & ~F.col("line").rlike(RULE))
    inner = F.btrim(F.replace("line", F.lit("\\|"), F.lit("\x01")), F.lit("|"))
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.replace(F.trim(c), F.lit("\x01"), F.lit("|")))
    t = t.withColumn("cells", cells).where((F.size("cells") >= 7) & F.get("cells", F.lit(0)).rlike(r"^-*[0-9]+$"))
    cell = lambda i: F.get(F.col("cells"), i)
    t = t.where(~F.upper(cell(6)).rlike("DELETED|DUPLICATE"))
    original = F.trim(F.regexp_replace(cell(1), r"\s*\([^)]+\)\s*$", ""))
    return t.select(
        "file",
        "line_no",
        original.alias("original_filename"),
        cell(2).alias("category"),
        F.when(~_empty(cell(3)), cell(3)).alias("issuer"),
        F.when(F.lower(cell(4)).isin(*EMPTY_CELLS), original).otherwise(cell(4)).alias("new_filename"),
        cell(6).alias("destination"),
        F.when(~_empty(cell(5)), cell(5)).alias("amount"),
        "day",
        "action_mode",
    )


def latest(entries: DataFrame) -> DataFrame:
    """The latest entry of each file name: the greatest day, then the last line."""
    order = F.struct("day", "file", "line_no")
    rest = [c for c in entries.columns if c != "original_filename"]
    best = entries.groupBy("original_filename").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select("original_filename", *[F.col(f"r.{c}").alias(c) for c in rest])


def escaped(cell: Column) -> Column:
    return F.replace(F.coalesce(cell, F.lit("—")), F.lit("|"), F.lit("\\|"))


def to_markdown(entries: DataFrame) -> DataFrame:
    """(day, body, markdown) per day: a section with a table per run, and the same under the day's heading; needs day,
    time, action_mode, position and the table's cells under the names of a parsed entry."""
    cells = [F.col("position").cast("string")] + [escaped(F.col(c)) for c in ("original_filename", "category", "issuer", "new_filename", "amount", "destination")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    runs = entries.groupBy("day", "time", "action_mode").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"),
        F.count(F.lit(1)).alias("n"),
    )
    done = F.when(F.col("action_mode") == "rename", F.lit("renamed in place")).otherwise(F.lit("moved"))
    head = F.concat(F.lit("### "), F.col("time"), F.lit(" — "), F.col("n").cast("string"), F.lit(" file(s) "), done)
    table = F.lit("| " + " | ".join(COLUMNS) + " |\n|" + " --- |" * len(COLUMNS))
    section = F.concat_ws("\n", head, F.lit(""), table, F.col("rows"), F.lit(""))
    days = runs.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "action_mode", section.alias("s")))), lambda x: x["s"]), "\n").alias("body"))
    return days.select("day", "body", F.concat(F.lit("## "), F.col("day"), F.lit("\n\n"), F.col("body")).alias("markdown"))


def with_section(text: str, day: str, body: str) -> str:
    """A history's text with a run's section at the end of its day; a day that is new comes last."""
    lines = text.rstrip("\n").split("\n")
    starts = [i for i, line in enumerate(lines) if line.startswith("## ") and day in line]
    if not starts:
        return "\n".join([*lines, "", f"## {day}", "", body.rstrip("\n"), ""])
    end = next((i for i in range(starts[-1] + 1, len(lines)) if lines[i].startswith("## ")), len(lines))
    while lines[end - 1] == "":
        end -= 1
    return "\n".join([*lines[:end], "", body.rstrip("\n"), "", *lines[end:]]).rstrip("\n") + "\n"
