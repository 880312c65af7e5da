"""Text normalisation, slicing and classification as Column expressions.

Java's and RE2's ``\\w`` are ASCII only, the reference behaviour is Unicode, so
character classes are spelled with ``\\p{L}`` / ``\\p{N}``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as one class.
WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
WORDISH = r"\p{L}\p{N}_"

# Characters stripped from both ends of a word.
EDGE_PUNCT = ".,!?;:'\"()[]"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable.

    A lambda body is evaluated per array element together with everything it
    captures, so a costly captured expression must be bound first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ws(col) -> Column:
    """Drop white space at both ends."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+$", "")


def norm_ws(col) -> Column:
    """Lower-case, trim, runs of white space to one blank."""
    return F.trim(F.regexp_replace(F.lower(_c(col)), f"{WS}+", " "))


def norm_wer(col) -> Column:
    """Lower-case and keep letters, digits, apostrophe and blank.

    Everything else is deleted, not blanked: ``a-b`` becomes ``ab`` and a line
    break glues its neighbours, exactly as the error-rate metric expects.
    """
    kept = F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}' ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def norm_metric(col) -> Column:
    """Lower-case, punctuation to blank (underscore stays), single blanks."""
    blanked = F.regexp_replace(F.lower(_c(col)), f"[^{WORDISH}]", " ")
    return F.trim(F.regexp_replace(blanked, " +", " "))


def tokens(col) -> Column:
    """Words split on white space; an empty text has no words."""
    return F.filter(F.split(_c(col), f"{WS}+"), lambda w: w != "")


def n_words(col) -> Column:
    return F.size(tokens(col))


def strip_punct(col) -> Column:
    """Lower-cased word without edge punctuation; NULL below two characters."""
    cls = re.escape(EDGE_PUNCT).replace('"', '\\"')
    w = F.regexp_replace(F.lower(_c(col)), f"^[{cls}]+|[{cls}]+$", "")
    return F.when(F.length(w) >= 2, w)


def slice_around(text, pos, window: int, width=None) -> Column:
    """Characters ``[pos - window, pos + window)`` (0-based position)."""
    p = _c(pos)
    lo = F.greatest(p - window, F.lit(0))
    return F.substr(_c(text), lo + 1, F.greatest(p + window - lo, F.lit(0)))


def context(text, pos, window: int = 80) -> Column:
    """Context window of the normalised text."""
    return slice_around(norm_ws(text), pos, window)


def raw_context(text, pos, window: int = 80) -> Column:
    """Context window of the text as it is."""
    return slice_around(text, pos, window)


def dotted_context(text, pos, window: int = 60) -> Column:
    """Normalised context between ellipses."""
    return F.concat(F.lit("..."), context(text, pos, window), F.lit("..."))


def last_index(text, needle: str) -> Column:
    """0-based position of the last occurrence, -1 when there is none."""
    t = _c(text)
    at = F.instr(F.reverse(t), needle[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(t) - at - len(needle) + 1)


def truncate_at_sentence(text, max_chars: int) -> Column:
    """Cut at the last sentence mark in the final 40 %, else at the last blank.

    The marks are tried in a fixed order of preference, so an early full stop
    beats a later question mark.
    """
    t = _c(text)
    head = F.substring(t, 1, max_chars)
    floor_at = max_chars * 0.6
    picks = []
    for mark in (". ", "! ", "? ", "; ", "\n"):
        at = last_index(head, mark)
        picks.append(F.when(at >= floor_at, F.substr(head, F.lit(1), at + 1)))
    blank = last_index(head, " ")
    picks.append(F.when(blank > 0, F.substr(head, F.lit(1), blank)))
    return F.when(F.length(t) <= max_chars, t).otherwise(F.coalesce(*picks, head))


def rebuild_text(parts, trim: bool = True) -> Column:
    """Join an ordered array of segment texts with blanks."""
    arr = _c(parts)
    if trim:
        arr = F.filter(F.transform(arr, strip_ws), lambda x: x != "")
    return F.array_join(arr, " ")


def word_chunks(text, size: int = 50, overlap: int = 10) -> Column:
    """Overlapping word windows as an array of texts.

    Full windows start every ``size - overlap`` words. A tail window of the last
    ``size`` words is added when the remainder is larger than half a window.
    """
    step = size - overlap
    no_ints, no_text = F.array().cast("array<int>"), F.array().cast("array<string>")

    def cut(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(no_ints)
        full = F.transform(starts, lambda s: F.array_join(F.slice(ws, s + 1, size), " "))
        has_tail = (n > size) & (n % step > size // 2)
        tail = F.when(has_tail, F.array(F.array_join(F.slice(ws, n - size + 1, size), " "))).otherwise(no_text)
        return F.concat(full, tail)

    return let(tokens(text), cut)


def parse_mmss(ts) -> Column:
    """``HH:MM:SS`` or ``MM:SS`` to seconds, anything else to 0."""
    p = F.split(F.trim(_c(ts)), ":")
    n = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    return (
        F.when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2])
        .when(F.size(p) == 2, n[0] * 60 + n[1])
        .otherwise(F.lit(0))
        .cast("double")
    )


def format_mmss(seconds) -> Column:
    s = F.floor(_c(seconds)).cast("int")
    return F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60)


# Interface phrases that are not content (matched at line start).
UI_PHRASES = (
    r"(?:un)?mute my microphone",
    "connecting to audio",
    "phone call",
    "computer audio",
    "join audio by computer",
    "turn on microphone",
    "let everyone send messages",
    "when you leave the call",
    "join later",
    "you can pin a message",
)

# Fragments that mark a screen line as noise.
NOISE_FRAGMENTS = (
    "http", "://", "&quot;", "&amp;", "{", "}", "[", "]", "index", "logprobs",
    "finish_reason", 'content"', "In-call messages", "access this chat",
)


def is_ui_noise(line) -> Column:
    """Interface text or a line of at most one character."""
    l = strip_ws(line)
    return (F.length(l) <= 1) | l.rlike(f"(?i)^(?:{'|'.join(UI_PHRASES)})")


def is_fragment_noise(line) -> Column:
    """Too short, too long, or carrying a noise fragment."""
    l = strip_ws(line)
    pattern = "|".join(f"\\Q{f}\\E" for f in NOISE_FRAGMENTS)
    return (F.length(l) <= 3) | (F.length(l) > 80) | l.rlike(pattern)


def word_category(word) -> Column:
    """proper_noun, tech_acronym, numeric_term or content_word by spelling."""
    w = _c(word)
    return (
        F.when(w.rlike(r"^\p{Lu}") & (F.length(w) > 1), F.lit("proper_noun"))
        .when((F.length(w) >= 2) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"), F.lit("tech_acronym"))
        .when(w.rlike(r"\p{Nd}"), F.lit("numeric_term"))
        .otherwise(F.lit("content_word"))
    )


def caps_dominant(text) -> Column:
    """More than 60 % of the letters are capitals."""
    t = _c(text)
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    upper = F.regexp_count(t, F.lit(r"\p{Lu}"))
    return F.coalesce(upper / F.nullif(letters, F.lit(0)) > 0.6, F.lit(False))


# Capitalised function words that are no acronyms.
FUNCTION_CAPS = ("THE", "AND", "FOR", "YOU", "BUT", "NOT", "ALL", "ANY", "CAN")
ACRONYM = r"\b[A-Z]{2,}(?:-?\d+)?\b"


def acronyms(text) -> Column:
    """Distinct acronyms, none when the text is mostly capitals."""
    t = _c(text)
    # Java's \b is Unicode-aware only with the flag, and the test must be Unicode:
    # an accented letter next to capitals is a letter.
    found = F.array_except(
        F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?U){ACRONYM}"), F.lit(0))),
        F.array(*[F.lit(w) for w in FUNCTION_CAPS]),
    )
    return F.when(caps_dominant(t), F.array().cast("array<string>")).otherwise(found)


def entity_words(text) -> Column:
    """Distinct capitalised words of four or more characters."""
    return F.array_distinct(
        F.filter(
            F.regexp_extract_all(_c(text), F.lit(r"(?U)\b[A-Z][a-zA-Z0-9]+\b"), F.lit(0)),
            lambda w: F.length(w) >= 4,
        )
    )


def term_variants(term) -> Column:
    """The lower-cased term and the term without hyphens."""
    t = F.lower(strip_ws(term))
    return F.array_distinct(F.array(t, F.replace(t, F.lit("-"), F.lit(""))))


def clean_label(col) -> Column:
    """``some_label`` to ``Some Label``."""
    return F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def typed_cell(col) -> Column:
    """A CSV cell as struct(kind, i, d, s): integer, else number, else text."""
    c = _c(col)
    i = F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("bigint"))
    d = c.try_cast("double")
    return F.struct(
        F.when(i.isNotNull(), F.lit("int"))
        .when(d.isNotNull(), F.lit("float"))
        .otherwise(F.lit("string"))
        .alias("kind"),
        i.alias("i"),
        d.alias("d"),
        c.alias("s"),
    )


def matches_search(query: str, *cols) -> Column:
    """Free-text filter over several columns, case-insensitive."""
    hay = F.lower(F.concat_ws(" ", *[_c(c) for c in cols]))
    return F.contains(hay, F.lit(query.lower()))


# The evidence lines, by what is known of a face.
HINT_LINES = {
    "none": "No face detected in video segment",
    "words": "Visual speech suggests: '%s' (confidence: %.2f)",
    "speaking": "Speaker detected and actively speaking (confidence: %.2f)",
    "quiet": "Face detected but low speaking activity (confidence: %.2f)",
    "faces": " [active speaker from %d faces]",
}


def speaking_hint(face, confidence, transcript, n_faces) -> Column:
    """The evidence line for a lip hint, out of the table of lines by the kind of evidence."""
    sure, said = _c(confidence), F.nullif(_c(transcript), F.lit(""))
    lines = F.create_map(
        F.lit("words"), F.format_string(HINT_LINES["words"], F.coalesce(said, F.lit("")), sure),
        F.lit("speaking"), F.format_string(HINT_LINES["speaking"], sure),
        F.lit("quiet"), F.format_string(HINT_LINES["quiet"], sure),
    )
    kind = F.coalesce(F.when(said.isNotNull(), "words"), F.when(sure > 0.5, "speaking"), F.lit("quiet"))
    many = F.coalesce(F.when(_c(n_faces) > 1, F.format_string(HINT_LINES["faces"], _c(n_faces))), F.lit(""))
    return F.when(~_c(face), F.lit(HINT_LINES["none"])).otherwise(F.concat(lines[kind], many))


def local_time(ts, zone: str = "Asia/Colombo", pattern: str = "dd MMM yyyy, HH:mm") -> Column:
    """UTC timestamp shown in the display zone."""
    return F.date_format(F.from_utc_timestamp(_c(ts), zone), pattern)


def time_ago(ts, now, zone: str = "Asia/Colombo") -> Column:
    """Relative age: minutes, hours, days, up to three weeks, then the date."""
    sec = F.unix_micros(_c(now)) - F.unix_micros(_c(ts))
    minutes = F.floor(sec / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    weeks = F.floor(days / 7)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, say(minutes, "m"))
        .when(hours < 24, say(hours, "h"))
        .when(days < 7, say(days, "d"))
        .when(weeks < 4, say(weeks, "w"))
        .otherwise(local_time(ts, zone, "dd MMM yyyy"))
    )


def parse_iso(col) -> Column:
    """ISO timestamp with or without ``Z``; NULL when it is none."""
    return F.try_to_timestamp(_c(col))


def pct(num, den, digits: int = 2) -> Column:
    """Guarded percentage, 0 when the denominator is 0."""
    return F.coalesce(F.round(_c(num) / F.nullif(_c(den), F.lit(0)) * 100, digits), F.lit(0.0))


def unit_hash(key, salt: str) -> Column:
    """A reproducible number in [0, 1) from a key: first 32 bits of the MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), _c(key).cast("string"))), 1, 8), 16, 10)
    return h.cast("double") / F.lit(4294967296.0)
