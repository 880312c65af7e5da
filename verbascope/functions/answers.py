"""Tolerant parsing of JSON answers given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbascope.functions.text import _c, strip_ws, tokens

SUSPECT = "struct<word:string,likely_correct:string,reason:string,needs_avsr:boolean,needs_ocr:boolean>"


# Fixed format: a flat object with a list of suspects, as it stands inside prose.
SUSPECTS_IN_PROSE = r'(?s)\{[^{}]*"suspects"[^{}]*\[.*?\][^{}]*\}'


def _json(col: Column, ddl: str) -> Column:
    return F.from_json(col, ddl, {"mode": "PERMISSIVE"})


def detection_suspects(response) -> Column:
    """Array of suspects: fences removed, ``suspects`` or ``errors``, both words
    present and at most 40 characters; a JSON object inside prose is salvaged."""
    raw = _c(response)
    bare = strip_ws(F.regexp_replace(raw, "```(?:json)?", ""))
    ddl = f"suspects array<{SUSPECT}>, errors array<{SUSPECT}>"
    whole = _json(F.when(bare.startswith("{"), bare), ddl)
    inner = _json(F.nullif(F.regexp_extract(raw, SUSPECTS_IN_PROSE, 0), F.lit("")), ddl)
    found = F.coalesce(whole["suspects"], whole["errors"], inner["suspects"])
    cleaned = F.transform(
        found,
        lambda s: s.withField("word", strip_ws(s["word"])).withField("likely_correct", strip_ws(s["likely_correct"])),
    )
    ok = lambda s: (F.length(s["word"]).between(1, 40)) & (F.length(s["likely_correct"]).between(1, 40))
    return F.filter(cleaned, lambda s: F.coalesce(ok(s), F.lit(False)))


def _unquote(part: Column) -> Column:
    return F.btrim(strip_ws(part), F.lit("'\""))


def reconciled_answer(response, original) -> Column:
    """struct(text, swaps, confidence) of a reconciliation answer.

    Swaps need exactly one arrow, one word on each side, and a real change.
    Without a usable text the original comes back with confidence 0.
    """
    body = F.nullif(F.regexp_extract(_c(response), r"(?s)\{.*\}", 0), F.lit(""))
    p = _json(body, "text string, swaps array<string>, changes array<string>, confidence double")
    ok = F.coalesce(strip_ws(p["text"]), F.lit("")) != ""
    halves = F.transform(
        F.filter(F.coalesce(p["swaps"], p["changes"], F.array().cast("array<string>")), lambda s: F.size(F.split(s, "→")) == 2),
        lambda s: F.struct(_unquote(F.split(s, "→")[0]).alias("old"), _unquote(F.split(s, "→")[1]).alias("new")),
    )
    real = F.filter(
        halves,
        lambda s: (F.lower(s["old"]) != F.lower(s["new"])) & (F.size(tokens(s["old"])) == 1) & (F.size(tokens(s["new"])) == 1),
    )
    none = F.array().cast("array<struct<old:string,new:string>>")
    return F.struct(
        F.when(ok, strip_ws(p["text"])).otherwise(_c(original)).alias("text"),
        F.when(ok, real).otherwise(none).alias("swaps"),
        F.when(ok, F.coalesce(p["confidence"], F.lit(0.9))).otherwise(F.lit(0.0)).alias("confidence"),
    )


def _up_to_last(text: Column, mark: str) -> Column:
    """The text up to the last of a character; NULL without one."""
    rest = F.length(F.substring_index(text, mark, -1))
    return F.when(F.contains(text, F.lit(mark)), F.left(text, F.length(text) - rest))


def term_array(raw) -> Column:
    """Array of struct(term, category, type) out of a possibly cut-off answer.

    Tried in order: the bracketed part, the part from the first ``[`` sealed at
    the last ``}``, the bracketed part cut at its last ``}``. NULL if none parses.
    """
    ddl = "array<struct<term:string,category:string,type:string>>"
    text = _c(raw)
    # Fences hold no brackets, so they are looked for only in what stands between brackets.
    open_ = F.instr(text, "[")
    tail = F.when(open_ > 0, F.substr(text, open_))
    bare = lambda s: F.when(F.contains(s, F.lit("```")), F.regexp_replace(s, r"(?m)^```(?:json)?\s*|\s*```$", "")).otherwise(s)
    boxed, open_end = _up_to_last(tail, "]"), _up_to_last(tail, "}")
    sealed = F.concat(bare(open_end), F.lit("]"))
    cut = F.concat(bare(_up_to_last(boxed, "}")), F.lit("]"))

    def parse(text: Column) -> Column:
        # A failed parse of the wrapper object leaves a NULL array behind.
        return _json(F.concat(F.lit('{"a":'), text, F.lit("}")), f"a {ddl}")["a"]

    first = F.when(boxed.isNotNull(), parse(bare(boxed))).otherwise(parse(sealed))
    return F.coalesce(first, parse(cut))


def correction_answer(response) -> Column:
    """struct(corrected, changes, confidence, need_lip) with safe defaults."""
    body = F.nullif(F.regexp_extract(_c(response), r"(?s)\{.*\}", 0), F.lit(""))
    p = _json(body, "corrected string, changes array<string>, confidence double, need_lip boolean")
    return F.struct(
        p["corrected"].alias("corrected"),
        F.coalesce(p["changes"], F.array().cast("array<string>")).alias("changes"),
        F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(p["need_lip"], F.lit(False)).alias("need_lip"),
    )


def topic_answer(response) -> Column:
    """struct(field, topic, description, suggested_vocab), unknown by default."""
    body = F.nullif(F.regexp_extract(_c(response), r"(?s)\{.*\}", 0), F.lit(""))
    p = _json(body, "field string, topic string, description string, suggested_vocab array<string>")
    return F.struct(
        F.coalesce(p["field"], F.lit("unknown")).alias("field"),
        F.coalesce(p["topic"], F.lit("unknown")).alias("topic"),
        F.coalesce(p["description"], F.lit("")).alias("description"),
        F.coalesce(p["suggested_vocab"], F.array().cast("array<string>")).alias("suggested_vocab"),
    )


def verdict(response, expect_no_change) -> Column:
    """PASS / FAIL / of a probe: changes came back exactly when they should."""
    p = _json(_c(response), "changes array<string>")
    changed = F.when(p["changes"].isNull() & ~_c(response).rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(True)).otherwise(
        F.coalesce(F.size(p["changes"]) > 0, F.lit(False))
    )
    return F.when(changed != _c(expect_no_change), F.lit("PASS")).otherwise(F.lit("FAIL"))
