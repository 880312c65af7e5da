"""Line-oriented sources: pure parsers over a ``value`` column plus readers.

Every parser takes a DataFrame with the raw line (and an order column), so the
same code serves files, tables and streams.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbascope.functions.text import WS, strip_ws, tokens

# --------------------------------------------------------------------------
# utterance lines
# --------------------------------------------------------------------------


def utterance_line(value: Column) -> tuple[Column, Column]:
    """``utt_id text…``: (id, text); the text is NULL when there is none."""
    line = strip_ws(value)
    parts = F.split(line, " ", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def tab_line(value: Column) -> Column:
    """Text of a tab-separated utterance: the fifth field, or the last of two to
    four; NULL for comments, blanks and single fields."""
    line = strip_ws(value)
    f = F.split(line, "\t")
    text = F.when(F.size(f) >= 5, F.try_element_at(f, F.lit(5))).when(F.size(f) >= 2, F.element_at(f, -1))
    return F.when((line != "") & ~line.startswith("#"), text)


def prefixed_line(value: Column) -> Column:
    """Drop the ``utt_N utt start end -X`` prefix, keep other lines as they are."""
    line = strip_ws(value)
    body = F.regexp_extract(line, r"^utt_\d+\s+\S+\s+\S+\s+\S+\s+-\S+\s+(.*)$", 1)
    return F.nullif(F.coalesce(F.nullif(body, F.lit("")), line), F.lit(""))


def pipe_token(value: Column) -> Column:
    """Word of a pipe-delimited token line: leading mark + token + trailing mark."""
    f = F.split(value, r"\|")
    mark = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)), F.lit(""))
    ok = (F.size(f) >= 2) & ~value.startswith("token|") & (strip_ws(value) != "")
    return F.when(ok, F.concat(mark(6), f[0], mark(5)))


def ordered_text(rows: DataFrame, key: str, order: str, value: Column, sep: str = " ") -> DataFrame:
    """``key, text``: non-null parsed values joined in order."""
    parts = rows.select(key, order, value.alias("_v")).where("_v IS NOT NULL AND _v <> ''")
    ordered = F.array_sort(F.collect_list(F.struct(order, "_v")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_v"]), sep).alias("text"))


# Fixed format: names of the settings a cue may carry.
CUE_SETTINGS = ("align", "position", "line")


def _payload(block: Column) -> Column:
    """Text lines of one cue: what follows its timing line, or all of a block without one."""
    lines = F.transform(F.split(block, "\n"), strip_ws)
    timed = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    return F.slice(lines, timed + 1, F.size(lines))


def _spoken(line: Column) -> Column:
    """A payload line without tags, cut at its first setting; empty for a counter or a clock time."""
    shape = F.translate(line, "0123456789", "0000000000")
    words = F.regexp_replace(line, "<[^>]+>", "")
    ends = [F.nullif(F.instr(words, f"{name}:"), F.lit(0)) for name in CUE_SETTINGS]
    cut = F.coalesce(F.least(*ends) - 1, F.length(words))
    number_or_clock = (F.translate(shape, "0", "") == "") | shape.startswith("00:00:00")
    return F.when(number_or_clock, F.lit("")).otherwise(strip_ws(F.left(words, cut)))


def subtitle_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Plain text of a VTT/SRT file, read as blocks between blank lines.

    A block is a header, or a cue of counter, timing and payload. Of the payload lines
    tags and cue settings go, and a line equal to the one before it.
    """
    blocks = F.filter(F.split(F.col(text), r"\n[ \t]*(?=\n)"), lambda b: ~strip_ws(b).startswith("WEBVTT"))
    lines = F.transform(F.flatten(F.transform(blocks, _payload)), _spoken)
    return df.select(key, F.array_join(_drop_adjacent(F.filter(lines, lambda x: x != "")), " ").alias("text"))


def _drop_adjacent(lines: Column) -> Column:
    """Remove each entry equal to its predecessor (pairs the list with its shift)."""
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))))
    zipped = F.arrays_zip(lines.alias("l"), shifted.alias("p"))
    return F.transform(F.filter(zipped, lambda x: ~x["l"].eqNullSafe(x["p"])), lambda x: x["l"])


def captions_text(parts: Column) -> Column:
    """Captions (array) to flat text."""
    return F.array_join(F.filter(F.transform(parts, strip_ws), lambda x: x != ""), " ")


# Fixed format: the fields of a log line that are series, by kind of line.
TRAIN_SERIES = {"train loss": "train", "tokens/sec": "throughput", "peak mem gb": "memory"}
VAL_SERIES = {"val loss": "val"}


def _log_fields(line: Column) -> tuple[Column, Column]:
    """(iteration, map of field name to number) of ``Iter N: name value, name value unit, ...``."""
    low = F.lower(line)
    said = F.substr(low, F.instr(low, "iter ") + 5)
    step = strip_ws(F.substring_index(said, ":", 1)).try_cast("int")
    fields = F.split(F.substr(said, F.instr(said, ":") + 1), ",")

    def named(field: Column) -> Column:
        parts = tokens(field)
        number = F.filter(parts, lambda w: w.try_cast("double").isNotNull())
        name = F.array_join(F.filter(parts, lambda w: w.try_cast("double").isNull()), " ")
        return F.struct(name.alias("name"), F.try_element_at(number, F.lit(1)).try_cast("double").alias("value"))

    # Of a name that repeats the first field counts.
    known = F.aggregate(
        F.transform(fields, named), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")),
        lambda m, x: F.when(F.map_contains_key(m, x["name"]), m).otherwise(F.map_concat(m, F.create_map(x["name"], x["value"]))),
    )
    return F.when(F.contains(low, F.lit("iter ")), step), known


def training_log(df: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """``iter, series, value`` with the series train, val, throughput, memory.

    A line that has all fields of a train line is never read as a validation line.
    """
    keys = keys or []
    step, fields = _log_fields(F.col(value))
    rows = df.select(*keys, step.alias("iter"), fields.alias("_f")).where("iter IS NOT NULL")

    def points(series: dict[str, str]) -> tuple[Column, Column]:
        held = [F.try_element_at("_f", F.lit(name)) for name in series]
        every = F.array(*[F.struct(F.lit(s).alias("series"), v.alias("value")) for s, v in zip(series.values(), held)])
        return functools.reduce(lambda a, b: a & b, [v.isNotNull() for v in held]), every

    (is_train, train), (is_val, val) = points(TRAIN_SERIES), points(VAL_SERIES)
    found = F.when(is_train, train).when(is_val, val)
    return rows.withColumn("_p", found).where("_p IS NOT NULL").select(*keys, "iter", F.inline("_p"))


def word_xml_words(content: Column) -> Column:
    """Trimmed, non-empty ``<w>`` texts of one word-XML file, in file order."""
    grabbed = F.regexp_extract_all(content, F.lit(r"<w(?:\s[^>]*)?>([^<]+)</w>"), F.lit(1))
    plain = lambda s: F.replace(F.replace(F.replace(F.replace(F.replace(s, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(grabbed, lambda s: strip_ws(plain(s))), lambda s: s != "")


# --------------------------------------------------------------------------
# sentence chunks
# --------------------------------------------------------------------------


class SentenceEnds:
    """Where sentences of a text end, by kind of mark, found in one pass."""

    # Fixed format: the marks in the order of preference.
    MARKS = (r"\. ", r"\? ", r"! ", r"\n")

    def __init__(self, text: str):
        self.ends = [[(m.start(), m.end()) for m in re.finditer(mark, text)] for mark in self.MARKS]

    def last(self, low: int, high: int) -> int | None:
        """End of the last mark of the most preferred kind that lies wholly in [low, high)."""
        for ends in self.ends:
            at = bisect.bisect_right(ends, high, key=lambda e: e[1]) - 1
            if at >= 0 and ends[at][0] >= low:
                return ends[at][1]
        return None


def cut_points(text: str, size: int, overlap: int, look_back: int) -> Iterator[tuple[int, int]]:
    """Chunks of at most ``size`` characters, each but the last cut behind the sentence
    end the look-back prefers, each but the first begun ``overlap`` before the cut."""
    marks = SentenceEnds(text) if len(text) > size else None
    begin = 0
    while len(text) - begin > size:
        cut = marks.last(max(begin + size - look_back, begin + 1), begin + size) or begin + size
        yield begin, cut
        begin = max(cut - overlap, begin + 1)
    yield begin, len(text)


# Characters of chunks that one frame holds, but for one text of more.
CHUNK_CHARS = 4_000_000


def _chunk_frames(batches, names: list[str], text: str, size: int, overlap: int, look_back: int):
    """Frames of bounded size: the chunks of a whole batch of texts are never held at once."""
    columns = [*names, "chunk_no", "start", "end", "text"]
    for batch in batches:
        rows, held = [], 0
        for *key, body in zip(*(batch[c].tolist() for c in (*names, text))):
            body = body or ""
            for no, (a, b) in enumerate(cut_points(body, size, overlap, look_back)):
                rows.append((*key, no, a, b, body[a:b]))
            held += len(body)
            if held >= CHUNK_CHARS:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def sentence_chunks(df: DataFrame, keys: list[str], text: str, size: int = 5000, overlap: int = 200, look_back: int = 500) -> DataFrame:
    """``keys, chunk_no, start, end, text``: overlapping chunks cut at sentence ends.

    Each cut depends on the one before it, so the cutting runs in Arrow batches;
    a text is read once, whole.
    """
    fields = [f for f in df.schema.fields if f.name in keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]

    def run(batches):
        return _chunk_frames(batches, names, text, size, overlap, look_back)

    return df.select(*names, text).mapInPandas(run, schema=f"{ddl}, chunk_no int, start int, end int, text string")


# --------------------------------------------------------------------------
# readers
# --------------------------------------------------------------------------


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("file_name"), "value")
    )


def read_word_xml(spark: SparkSession, path: str) -> DataFrame:
    """``meeting_id, text`` from one XML file per meeting and speaker."""
    f = _whole_files(spark, path, "*.xml").withColumn("meeting_id", F.split_part("file_name", F.lit("."), F.lit(1)))
    words = f.select("meeting_id", "file_name", word_xml_words(F.col("value")).alias("ws")).where(F.size("ws") > 0)
    return ordered_text(words, "meeting_id", "file_name", F.array_join("ws", " "))


def read_utterances(spark: SparkSession, path: str, glob: str = "*.trans.txt") -> DataFrame:
    """``utt_id, text`` of every line of the matching files, recursively."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    uid, text = utterance_line(F.col("value"))
    return lines.select(uid.alias("utt_id"), text.alias("text")).where("text IS NOT NULL AND utt_id <> ''")


def read_ordered_lines(spark: SparkSession, path: str, glob: str, parser) -> DataFrame:
    """``file_id, text`` of line files: whole file split, parsed, joined in order."""
    f = _whole_files(spark, path, glob).withColumn("file_id", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    lines = f.select("file_id", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return ordered_text(lines, "file_id", "n", parser(F.col("line")))


def read_subtitles(spark: SparkSession, path: str, glob: str = "*.{vtt,srt}") -> DataFrame:
    f = _whole_files(spark, path, glob).withColumn("file_id", F.regexp_replace("file_name", r"\..*$", ""))
    return subtitle_text(f, "file_id", "value")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return training_log(spark.read.text(path))
