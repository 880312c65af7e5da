"""Chat records of many layouts as canonical turns, and a reversible chat template.

A record is a JSON text. Its fingerprint is the hash of its sorted nested field
paths, as far as any layout knows them, and selects a declarative mapping that turns
the record into (role, text) turns. Formatting marks every turn and escapes control
strings inside texts so that parsing gives the same turns back.

Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. ``array``: path of a list of turns with ``role`` and
    ``text`` keys in its items; else ``parts``: (fixed role or path of the role, paths
    of the texts to join with a line feed), a turn each. ``turn``: path of its number."""

    name: str
    paths: tuple[str, ...]
    array: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turn: str = ""

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()


LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), array="messages", role="role", text="content"),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), array="conversations", role="from", text="value"),
    Layout("prompt_completion", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction_output", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system_prompt_completion", ("system", "prompt", "completion"), parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("turn_row", ("role", "text", "turn"), parts=(("$role", ("text",)),), turn="turn"),
)
VARIANT_BYTES = 16_000_000  # records up to this length surely fit a variant
# Names that other layouts give the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

OPEN, CLOSE = "<|turn_start|>", "<|turn_end|>"
# Control strings of common templates, escaped inside texts along with the template's own marks.
CONTROL = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ANY_CONTROL = "|".join(re.escape(c) for c in CONTROL)


def field_paths(schema: Column) -> Column:
    """Sorted nested field paths out of a variant's schema text; items of a list are ``[]``."""
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`: |[^<>,: `]+: |OBJECT<|ARRAY<|>)"), 1)
    state = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(t, ": $", ""), "^`|`$", "")
        path = F.concat(F.array_join(s["open"], ""), name)
        into = F.concat(s["name"], F.when((t == "OBJECT<") & (s["name"] != "") & ~s["name"].endswith("[]"), ".").otherwise(""))
        opened = F.when(t == "ARRAY<", F.concat(s["name"], F.lit("[]"))).otherwise(into)
        opened = F.when((t == "OBJECT<") & s["name"].endswith("[]"), ".").otherwise(opened)
        stack = F.when(t == ">", F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0)))).when(t.endswith("<"), F.array_append(s["open"], opened)).otherwise(s["open"])
        after = F.when(t == "ARRAY<", "[]").when(t.endswith(": "), name).otherwise("")
        return F.struct(stack.alias("open"), after.alias("name"), F.when(t.endswith(": "), F.array_append(s["paths"], path)).otherwise(s["paths"]).alias("paths"))

    return F.array_sort(F.array_distinct(F.transform(F.aggregate(tokens, state, step, lambda s: s["paths"]), lambda p: F.regexp_replace(p, r"\.\[\]|\[\]\[\]", "[]"))))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the record's field paths that some layout knows; other fields do not count.

    ``record`` is a variant. A record without known fields has the hash of no path.
    """
    known = F.array(*[F.lit(p) for p in sorted({p for x in layouts for p in x.paths})])
    return F.sha2(F.array_join(F.array_intersect(field_paths(F.schema_of_variant(record)), known), "\n").cast("binary"), 256)


def _turns(record: Column, layout: Layout) -> Column:
    def get(path: str) -> Column:
        return F.try_variant_get(record, f"$.{path}", "string")

    if layout.array:
        items = F.try_variant_get(record, f"$.{layout.array}", f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>")
        return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("turn"), x[layout.role].alias("role"), x[layout.text].alias("text")))
    return _parts(layout, get)


def _long_json(value: Column, kind: str) -> Column:
    return F.from_json(value, kind, {"maxStringLen": str(2**31 - 1)})


def _holds(name: str):
    return lambda item: F.map_contains_key(item, F.lit(name))


def _long_paths(fields: Column, layouts: tuple[Layout, ...]) -> Column:
    """Which of the layouts' field paths a record has, from its top-level fields as text."""
    items = {x.array: _long_json(F.try_element_at(fields, F.lit(x.array)), "array<map<string,string>>") for x in layouts if x.array}
    found = []
    for p in sorted({p for x in layouts for p in x.paths}):
        top, _, inner = p.partition("[].")
        here = F.exists(items[top], _holds(inner)) if inner else F.map_contains_key(fields, F.lit(p))
        found.append(F.when(here, F.lit(p)))
    return F.array_compact(F.array(*found))


def _long_turns(fields: Column, layout: Layout) -> Column:
    """As ``_turns``, of a record too long for a variant."""
    def get(path: str) -> Column:
        return F.try_element_at(fields, F.lit(path))

    if layout.array:
        items = _long_json(get(layout.array), "array<map<string,string>>")
        part = lambda x, name: F.try_element_at(x, F.lit(name))
        return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("turn"), part(x, layout.role).alias("role"), part(x, layout.text).alias("text")))
    return _parts(layout, get)


def _parts(layout: Layout, get) -> Column:
    turns = []
    for k, (role, texts) in enumerate(layout.parts):
        number = get(layout.turn).cast("bigint") if layout.turn else F.lit(k).cast("long")
        said = get(role[1:]) if role[:1] == "$" else F.lit(role)
        # An empty optional part (an instruction's input) adds no line.
        text = get(texts[0]) if len(texts) == 1 else F.array_join(F.filter(F.array(*[get(t) for t in texts]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
        turns.append(F.struct(number.alias("turn"), said.alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical_turns(records: DataFrame, record: str = "record", id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, turn, role, text): the turns of every JSON record.

    A NULL text is empty, a NULL role too; other layouts' names of roles are made canonical,
    but a row that names its role itself keeps it. Texts of any length are taken whole. A record that is no JSON, or of no known layout, gives one row with a NULL layout,
    turn, role and text, so that it is not lost. Repeated records give repeated turns.
    """
    # A variant holds 16 MB at most; a longer record is read by its top-level fields as text.
    parsed = records.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{record}`").alias("r")).withColumn("v", F.try_parse_json("r"))
    long = F.when(F.col("v").isNull() & (F.octet_length("r") > VARIANT_BYTES), _long_json(F.col("r"), "map<string,string>"))
    parsed = parsed.withColumn("f", long).drop("r")
    names = F.create_map(*[F.lit(x) for p in layouts for x in (p.fingerprint, p.name)])
    long_print = F.sha2(F.array_join(_long_paths(F.col("f"), layouts), "\n").cast("binary"), 256)
    print_ = F.when(F.col("v").isNotNull(), fingerprint(F.col("v"), layouts)).when(F.col("f").isNotNull(), long_print)
    marked = parsed.withColumn("layout", F.element_at(names, print_))
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        here = F.when(F.col("v").isNotNull(), _turns(F.col("v"), x).cast(TURNS)).otherwise(_long_turns(F.col("f"), x).cast(TURNS))
        turns = F.when(F.col("layout") == x.name, here).otherwise(turns)
    rows = marked.select("id", "layout", F.explode_outer(turns.cast(TURNS)).alias("t"))
    role = F.coalesce("t.role", F.lit(""))
    other = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in ROLE_NAMES.items() for x in p]), role), role)
    renamed = F.when(F.col("layout").isin(*[x.name for x in layouts if any(r[:1] == "$" for r, _ in x.parts)]), role).otherwise(other)
    full = F.col("layout").isNotNull()
    return rows.select(F.col("id").alias(id_col), "layout", "t.turn", F.when(full, renamed).alias("role"), F.when(full, F.coalesce("t.text", F.lit(""))).alias("text"))


def escape(text: Column) -> Column:
    """A backslash before every control string; one that has backslashes before it gets one more."""
    return F.regexp_replace(text, f"({ANY_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({ANY_CONTROL})", "$1")


def format_chat(turns: DataFrame, id_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """(id, formatted, segments): one row for a conversation.

    A turn is its opening mark, its role (URL-encoded, so on one line), a line feed,
    the escaped text, a line feed and its closing mark. ``segments`` cuts
    ``formatted`` into struct(text, loss); their texts joined are ``formatted``, and
    ``loss`` marks the texts of ``loss_role``. Turns lie in the order of turn, role and
    text, NULL turns first. A conversation is one value, as long as its turns together.
    """
    line = F.struct("turn", "role", escape(F.col("text")).alias("text"))
    rows = turns.where(F.col("role").isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_list(line)).alias("turns"))

    def pieces_of(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"))
        return F.array(*[F.struct(x.alias("text"), y.alias("loss")) for x, y in ((head, F.lit(False)), (t["text"], t["role"] == loss_role), (F.lit("\n" + CLOSE), F.lit(False)))])

    cut = rows.select(id_col, F.flatten(F.transform("turns", pieces_of)).alias("segments"))
    return cut.select(id_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """array<struct(role, text)>: the turns of a formatted conversation.

    Marks inside texts have a backslash before them and the template's own marks never.
    """
    cut = F.split(formatted, rf"(?<!\\){re.escape(OPEN)}")
    turns = F.slice(cut, 2, F.size(cut))
    tail = len("\n" + CLOSE)

    def turn(t: Column) -> Column:
        role = F.substring_index(t, "\n", 1)
        start = F.length(role) + 2
        text = F.substring(t, start, F.length(t) - start + 1 - tail)
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def chat_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the output."""
    turns = parse_chat(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = formatted.select(id_col, F.size(turns).cast("long").alias("n_turns"), spoken.alias("spoken"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(id_col, "n_turns", F.sha2("spoken", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
