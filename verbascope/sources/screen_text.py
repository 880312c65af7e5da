"""Screen-text XML: parsing and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbascope.functions.text import format_mmss, parse_mmss, strip_ws

# Fixed format: a frame of the screen-text document, its attributes in this order.
FRAME_RE = r'(?s)<frame\s+timestamp="([^"]+)"\s+type="([^"]+)">\s*(.*?)\s*</frame>'


def frame_body(content: Column) -> Column:
    """The text tag's content; the whole body when there is neither a text nor a
    visuals tag; otherwise empty."""
    inside = lambda tag: F.when(
        F.instr(content, f"<{tag}>") > 0,
        F.substr(content, F.instr(content, f"<{tag}>") + len(tag) + 2),
    )
    closed = lambda tag: F.when(F.contains(inside(tag), F.lit(f"</{tag}>")), F.substring_index(inside(tag), f"</{tag}>", 1))
    text, visuals = closed("text"), closed("visuals")
    return F.when(text.isNotNull(), strip_ws(text)).when(visuals.isNotNull(), F.lit("")).otherwise(strip_ws(content))


def parse_frames(df: DataFrame, xml: str, keys: list[str]) -> DataFrame:
    """One row per non-empty frame: ``keys, frame_no, ts, timestamp, type, text``.

    Pattern-based because the input need not be well-formed XML.
    """
    grab = lambda g: F.regexp_extract_all(F.col(xml), F.lit(FRAME_RE), F.lit(g))
    zipped = F.arrays_zip(grab(1).alias("stamp"), grab(2).alias("type"), grab(3).alias("body"))
    rows = df.select(*keys, F.posexplode(zipped).alias("frame_no", "f"))
    return rows.select(
        *keys, "frame_no", parse_mmss("f.stamp").alias("ts"), F.col("f.stamp").alias("timestamp"),
        F.col("f.type").alias("type"), frame_body(F.col("f.body")).alias("text"),
    ).where("text <> ''")


def escape_xml(text: Column, quotes: bool = True) -> Column:
    out = text
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if quotes else out


def frames_to_xml(frames: DataFrame, quotes: bool = True) -> DataFrame:
    """``file_id, xml`` from frames in time order, with or without quote escaping."""
    block = F.concat(
        F.lit('  <frame timestamp="'), format_mmss("ts"), F.lit('" type="slide">\n    <text>'),
        escape_xml(F.col("text"), quotes), F.lit("</text>\n  </frame>"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", block.alias("b"))))
    return frames.groupBy("file_id").agg(
        F.concat(F.lit("<ocr-extraction>\n"), F.array_join(F.transform(ordered, lambda x: x["b"]), "\n"), F.lit("\n</ocr-extraction>")).alias("xml")
    )
