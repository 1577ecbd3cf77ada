"""CSV files read by many tasks each, though quoted values may hold line breaks.

Spark deals a file's byte blocks to tasks, which see lines. Whether a block begins inside a quoted value isn't known to its
task, so that a first pass over the lines with quotes finds, for either case, whether the block ends inside one: a
transition between two states. Chained along each file these say how each block begins; a second pass joins lines to
records, cut where they truly end. The parts of a record that spans blocks are put together apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

MOST_BLOCKS = 500_000  # of one scan, about 60 MB to broadcast: 60 TB in blocks of 128 MB

_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
WHOLE, CONTINUED, BEGUN = 0, 1, 2


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted value is open after ``line``, if one was (``inside``) or wasn't before. A quote opens a value only at its start."""
    if inside:
        at = 0
    elif line.startswith('"'):
        at = 1
    elif (at := line.find(',"') + 2) == 1:
        return False
    while closed := _CLOSED.match(line, at):
        if (at := line.find(',"', closed.end()) + 2) == 1:
            return False
    return True


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("_metadata.file_path", F.col("_metadata.file_block_start").alias("block"), F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """The stretches of a batch that come from one block of one file: (file and block, begin, end)."""
    if batch.num_rows == 0:
        return
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    turns = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for begin, end in zip([0, *turns], [*turns, batch.num_rows]):
        yield (files.dictionary[int(codes[begin])].as_py(), int(blocks[begin])), int(begin), int(end)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of a task's lines with quotes: whether it ends inside a value, if it begins outside and if inside one."""
    place, out_, in_, out = None, False, True, []
    for batch in batches:
        lines = batch.column(2).to_pylist()
        for now, begin, end in _runs(batch):
            if now != place:
                if place:
                    out.append((*place, out_, in_))
                place, out_, in_ = now, False, True
            for line in lines[begin:end]:
                if out_ == in_:  # both cases have met
                    out_ = in_ = inside_after(line, out_)
                else:
                    out_, in_ = inside_after(line, out_), inside_after(line, in_)
    if place:
        out.append((*place, out_, in_))
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["file_path", "block", "from_out", "from_in"])


def block_states(lines: DataFrame) -> DataFrame:
    """(file_path, block, inside, leaves_inside) of all blocks: how each begins and ends. One row a block, chained along each file."""
    own = lines.filter(F.contains("line", F.lit('"'))).mapInArrow(_transitions, "file_path string, block long, from_out boolean, from_in boolean")
    blocks = lines.select("file_path", "block").distinct().join(own, ["file_path", "block"], "left")
    step = F.struct("block", F.coalesce("from_out", F.lit(False)).alias("from_out"), F.coalesce("from_in", F.lit(True)).alias("from_in"))
    chained = blocks.groupBy("file_path").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # a file has few blocks
    ends = F.expr("""aggregate(steps, array(false), (states, s) -> concat(states, array(if(element_at(states, -1), s.from_in, s.from_out))))""")
    each = chained.withColumn("states", ends).select("file_path", F.posexplode("steps").alias("k", "step"), "states")
    return each.select("file_path", "step.block", F.get("states", F.col("k")).alias("inside"), F.get("states", F.col("k") + 1).alias("leaves_inside"))


class _Joiner:
    """Lines of one block to records: whole ones, and the parts of those that other blocks begin or end."""

    def __init__(self, place: tuple[str, int], inside: bool) -> None:
        self.place, self.inside, self.held = place, inside, []
        self.kind, self.header = (CONTINUED if inside else WHOLE), place[1] == 0

    def ended(self, whole: list[str], parts: list[tuple]) -> None:
        record, self.held = "\n".join(self.held), []
        if self.header:
            self.header = False
        elif self.kind != WHOLE:
            parts.append((*self.place, self.kind, record))
        elif record:
            whole.append(record)
        self.kind = WHOLE

    def take(self, lines: list[str], quoted: list[int], whole: list[str], parts: list[tuple]) -> None:
        """The next lines; ``quoted`` are the numbers of those with a quote. Only these can change the state."""
        at = 0
        for k in [*quoted, len(lines)]:
            if self.inside:
                self.held += lines[at:k]
            else:
                if self.header and k > at:
                    self.header, at = False, at + 1
                whole += filter(None, lines[at:k])
            if k < len(lines):
                self.held.append(lines[k])
                self.inside = inside_after(lines[k], self.inside)
                if not self.inside:
                    self.ended(whole, parts)
            at = k + 1

    def finish(self, parts: list[tuple]) -> None:
        if self.held:
            parts.append((*self.place, CONTINUED if self.kind == CONTINUED else BEGUN, "\n".join(self.held)))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with how their block begins to records; only parts name their file and block. Headers and blank lines are left out."""
    joiner = None

    def batch_of(whole: list[str], parts: list[tuple]) -> pa.RecordBatch:
        n = len(whole)
        columns = [pa.array([None] * n + [p[i] for p in parts], t) for i, t in ((0, pa.string()), (1, pa.int64()))]
        columns += [pa.array([WHOLE] * n + [p[2] for p in parts], pa.int32()), pa.array(whole + [p[3] for p in parts], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file_path", "block", "kind", "record"])

    for batch in batches:
        whole, parts = [], []
        lines, begins = batch.column(2).to_pylist(), batch.column(3)
        marked = np.flatnonzero(pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False))
        for now, begin, end in _runs(batch):
            if joiner is None or now != joiner.place:
                if joiner:
                    joiner.finish(parts)
                joiner = _Joiner(now, begins[begin].as_py())
            quoted = marked[np.searchsorted(marked, begin) : np.searchsorted(marked, end)] - begin
            joiner.take(lines[begin:end], quoted.tolist(), whole, parts)
        yield batch_of(whole, parts)
    if joiner:
        parts = []
        joiner.finish(parts)
        yield batch_of([], parts)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record) of files with a header line each: the text of every record, with the line breaks of its quoted values.

    All files' blocks are read in parallel. A value that is never closed is one record with all that follows in its file.
    """
    lines = _lines(spark, path)
    states = written(block_states(lines), "csv-blocks")
    n, spans = states.agg(F.count(F.lit(1)), F.count_if("inside")).first()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks of files are more than one scan takes ({MOST_BLOCKS}); scan them in lots or raise spark.sql.files.maxPartitionBytes")
    known = lines.join(F.broadcast(states.select("file_path", "block", "inside")), ["file_path", "block"])
    schema = "file_path string, block long, kind int, record string"
    whole = known.select("file_path", "block", "line", "inside").mapInArrow(_records, schema)
    if not spans:
        return whole.select("record")
    edges = states.filter("inside or leaves_inside")
    parts = lines.join(F.broadcast(edges.select("file_path", "block", "inside")), ["file_path", "block"]).select("file_path", "block", "line", "inside").mapInArrow(_records, schema)
    parts = parts.filter(F.col("kind") != WHOLE)
    began = F.count_if(F.col("kind") == BEGUN).over(Window.partitionBy("file_path").orderBy("block", "kind"))  # at most two parts a block
    put = parts.withColumn("nth", began).groupBy("file_path", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return whole.filter(F.col("kind") == WHOLE).select("record").unionByName(put.select("record"))
