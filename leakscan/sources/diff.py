"""Unified diffs: file blocks, hunks and new-file line numbers.

Where the text of a diff stands in one row, an Arrow function numbers the lines of whole batches and nothing is shuffled or
sorted, so a task holds a slice of its batch only. Rows that are lines of diffs already are numbered by window expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of diffs that are cut to lines at once, about (a larger diff stands alone).
SLICE = 4 << 20
#: The path at the end of a file's first line, as the JVM's dots and line ends have it.
NAMED = r"^[^\r\x{85}\x{2028}\x{2029}]* b/(?P<p>[^\r\x{85}\x{2028}\x{2029}]*)[\r\x{85}\x{2028}\x{2029}]?$"
WHOLE = (Window.unboundedPreceding, 0)


def diff_lines(df: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
    """(key, ord, raw) of each line of each diff text."""
    return df.select(key, F.posexplode(F.split(diff, "\n")).alias("ord", "raw"))


def file_blocks(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """``lines`` with file_ord, hunk_ord, kind and the new file's line number of each line.

    A hunk ends at an empty line, at the next hunk and at the next file; other prefixes than plus, minus, blank and
    backslash neither show nor advance."""
    raw = F.col("raw")
    by_diff = Window.partitionBy(key).orderBy("ord")  # the one order of all that follows: one exchange, one sort
    so_far, before = by_diff.rowsBetween(*WHOLE), by_diff.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(so_far)
    is_file, is_hunk = F.startswith(raw, F.lit("diff --git ")), F.startswith(raw, F.lit("@@"))
    a = lines.withColumns({"is_file": is_file, "is_hunk": is_hunk})
    a = a.withColumn("file_ord", F.sum(F.col("is_file").cast("int")).over(so_far)).withColumn("hunks", F.sum(F.col("is_hunk").cast("int")).over(so_far))
    a = a.withColumn("opened", last(F.col("is_file") | F.col("is_hunk"), F.col("ord"))).withColumn("blank", last(raw == "", F.col("ord")))
    a = a.withColumn("start", last(F.col("is_hunk"), F.coalesce(F.nullif(F.regexp_extract("raw", r"^[^+]*\+([0-9]+)", 1), F.lit("")).cast("long"), F.lit(1).cast("long"))))
    a = a.withColumn("hunks_above", last(F.col("is_file"), F.col("hunks"))).withColumn("hunk_ord", F.col("hunks") - F.col("hunks_above"))
    a = a.withColumn("inside", (F.col("hunk_ord") > 0) & ~F.col("is_hunk") & ~F.coalesce(F.col("blank") > F.col("opened"), F.lit(False)))
    first = F.substring(raw, 1, 1)
    step = F.when(F.col("inside") & first.isin("+", " "), F.lit(1)).otherwise(F.lit(0))
    a = a.withColumn("steps", F.coalesce(F.sum(step).over(before), F.lit(0))).withColumn("steps_above", last(F.col("is_hunk"), F.col("steps")))
    kind = F.when(F.col("inside") & (first == "+"), "added").when(~F.col("inside"), "header").otherwise("other")
    line_no = F.when(F.col("hunk_ord") > 0, (F.col("start") + F.col("steps") - F.col("steps_above")).cast("int"))
    return a.where("file_ord > 0").select(*lines.columns, "file_ord", "hunk_ord", kind.alias("kind"), line_no.alias("line_no"))


def files(blocks: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, file_ord, path, is_new, is_deleted, is_renamed, is_binary): the flags and path of each file block."""
    raw, head = F.col("raw"), F.col("kind") == "header"
    starts = lambda p: F.max(head & F.startswith(raw, F.lit(p)))
    named = F.when(F.startswith(raw, F.lit("diff --git ")), F.regexp_extract("raw", r"^.* b/(.*)$", 1))
    moved = F.when(head & F.startswith(raw, F.lit("+++ b/")), F.substring(raw, 7, 1 << 30))
    binary = F.max(head & ((F.startswith(raw, F.lit("Binary files ")) & F.endswith(raw, F.lit(" differ"))) | F.startswith(raw, F.lit("GIT binary patch"))))
    return blocks.groupBy(key, "file_ord").agg(
        F.coalesce(F.max_by(moved, F.when(moved.isNotNull(), F.col("ord"))), F.max(named), F.lit("")).alias("path"),
        starts("new file mode").alias("is_new"), starts("deleted file mode").alias("is_deleted"), (starts("rename from") | starts("rename to")).alias("is_renamed"), binary.alias("is_binary"),
    )


def _after(text: pa.Array, n: int) -> pa.Array:
    """The texts without their first ``n`` characters."""
    return pc.utf8_slice_codeunits(text, n)


class Blocks:
    """The lines of a slice of diffs as arrays: their diff, place, file, hunk, kind and new line number, as ``file_blocks`` has them."""

    def __init__(self, texts: pa.Array) -> None:
        parts = pc.split_pattern(texts.cast(pa.string()), "\n")
        per, raw = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
        starts = lambda p: pc.starts_with(raw, p).to_numpy(zero_copy_only=False)
        n = len(raw)
        place, self.raw = np.arange(n), raw
        self.diff = np.repeat(np.arange(len(texts)), per)
        top = np.repeat(np.cumsum(per) - per, per)  # the diff's first line
        self.ord = place - top
        is_file, is_hunk = starts("diff --git "), starts("@@")
        last = lambda test: np.maximum.accumulate(np.where(test, place, -1), dtype=np.int64)

        def since(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The sum of ``x`` from the line ``at`` to each line, both included."""
            total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return total[1:] - total[np.maximum(at, 0)]

        file_at, hunk_at = last(is_file), last(is_hunk)
        self.file = since(is_file, top)
        self.in_file = self.file > 0
        self.hunk = np.where(self.in_file, since(is_hunk, np.maximum(file_at, top)), 0)
        blank = last(pc.equal(raw, "").to_numpy(zero_copy_only=False))
        self.first_line = is_file
        inside = (self.hunk > 0) & ~is_hunk & (blank <= np.maximum(file_at, hunk_at))
        plus = starts("+")
        before = since(inside & (plus | starts(" ")), hunk_at) - (inside & (plus | starts(" ")))
        number = pc.struct_field(pc.extract_regex(raw.filter(pa.array(is_hunk)), r"^[^+]*\+(?P<n>[0-9]+)"), "n")
        start = np.zeros(n, np.int64)
        start[is_hunk] = pc.fill_null(pc.cast(number, pa.int64()), 1).to_numpy(zero_copy_only=False)
        self.line_no = np.where(self.hunk > 0, start[np.maximum(hunk_at, 0)] + before, 0)
        self.added, self.header = inside & plus, ~inside

    def files(self) -> dict[str, np.ndarray | pa.Array]:
        """Of each file block in order: diff, file and what ``files`` gives."""
        at = np.flatnonzero(self.first_line)
        block = np.cumsum(self.first_line) - 1  # of lines that are in a file

        def any_of(*tests: pa.Array) -> np.ndarray:
            hit = np.zeros(len(block), bool)
            for t in tests:
                hit |= t.to_numpy(zero_copy_only=False)
            out = np.zeros(len(at), bool)
            out[block[hit & self.header & self.in_file]] = True
            return out

        starts = lambda p: pc.starts_with(self.raw, p)
        moved = np.flatnonzero(starts("+++ b/").to_numpy(zero_copy_only=False) & self.header & self.in_file)
        final = np.full(len(at), -1)
        final[block[moved]] = moved  # the last one of a block stays
        named = pc.fill_null(pc.struct_field(pc.extract_regex(self.raw.take(pa.array(at)), NAMED), "p"), "")
        to = _after(self.raw.take(pa.array(final[final >= 0])), 6)
        return {
            "diff": self.diff[at], "file_ord": self.file[at], "path": pc.replace_with_mask(named, pa.array(final >= 0), to),
            "is_new": any_of(starts("new file mode")), "is_deleted": any_of(starts("deleted file mode")),
            "is_renamed": any_of(starts("rename from"), starts("rename to")),
            "is_binary": any_of(pc.and_(starts("Binary files "), pc.ends_with(self.raw, " differ")), starts("GIT binary patch")),
        }


def _by_slice(df: DataFrame, diff: str, key: str, ddl: str, rows) -> DataFrame:
    """(key, *fields of ``ddl``): what ``rows`` makes of the ``Blocks`` of each slice: the diffs' places and the columns."""
    schema = T.StructType([df.select(key).schema[0], *T.StructType.fromDDL(ddl).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, a = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
            while a < b.num_rows:
                stop = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")), a + 1)
                part = b.slice(a, stop - a)
                of, columns = rows(Blocks(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], schema.names)
                a = stop

    return df.select(key, F.col(diff).cast("string")).mapInArrow(run, schema)


def diff_files(df: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
    """(key, file_ord, path, is_new, is_deleted, is_renamed, is_binary) of each file block of each diff text."""

    def rows(blocks: Blocks):
        f = blocks.files()
        return f.pop("diff"), f.values()

    return _by_slice(df, diff, key, "file_ord long, path string, is_new boolean, is_deleted boolean, is_renamed boolean, is_binary boolean", rows)


def added_lines(df: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
    """(key, file_ord, path, line_no, line) of all lines that scannable files of the diffs gain."""

    def rows(b: Blocks):
        f = b.files()
        block = np.cumsum(b.first_line) - 1
        at = np.flatnonzero(b.added)
        at = at[~(f["is_deleted"] | f["is_binary"])[block[at]]]
        return b.diff[at], (b.file[at], f["path"].take(pa.array(block[at])), pa.array(b.line_no[at]).cast(pa.int32()), _after(b.raw.take(pa.array(at)), 1))

    return _by_slice(df, diff, key, "file_ord long, path string, line_no int, line string", rows)
