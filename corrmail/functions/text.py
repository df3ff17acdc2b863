"""Text functions over columns: subjects, similarity, quoted parts, sentences, guards."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reply and forward prefixes, what is stripped from subjects, lines that start a quoted part.
_ANY_PREFIX = "Re|RE|re|Fw|FW|fw|Fwd|FWD|fwd|回复|答复|转发"
_REPLY_PREFIX = "Re|RE|re|回复|答复"
_FORWARD_PREFIX = "Fw|FW|Fwd|FWD|转发"
_OWN_REPLY_PREFIX = "Re|RE|回复|答复"
_EDGE = "【】[]()（）ー- "
QUOTE_MARKERS = (r">+\s*", r"-{3,}\s*原始邮件", r"-{3,}\s*Original Message", "发件人[:：]", "From[:：]", r"在\s+\d{4}", r"On\s+\w+,?\s+\w+", r"\*{3}\s*", "_{3,}")
_SENTENCE_END = r"[。！？\n;；.!?]+"
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stripped(c: Column | str) -> Column:
    """Without white space (of any kind) at both ends; null is empty."""
    return F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")


def half_width(c: Column | str) -> Column:
    return F.translate(_text(c), _FULL, _HALF)


def normalize_subject(c: Column | str) -> Column:
    """Subject without reply and forward prefixes, half width, single spaces, no brackets at the ends, lower case."""
    bare = F.regexp_replace(stripped(c), rf"(?U)^(?:\s*(?:{_ANY_PREFIX})\s*[:：]\s*)+", "")
    single = F.regexp_replace(half_width(bare), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(single, rf"^[{''.join(chr(92) + x for x in _EDGE)}]+|[{''.join(chr(92) + x for x in _EDGE)}]+$", ""))


def has_reply_prefix(c: Column | str) -> Column:
    return stripped(c).rlike(rf"(?U)^(?:{_REPLY_PREFIX})\s*[:：]")


def has_forward_prefix(c: Column | str) -> Column:
    return stripped(c).rlike(rf"(?U)^(?:{_FORWARD_PREFIX})\s*[:：]")


def is_own_reply(c: Column | str) -> Column:
    """A subject that says the owner has answered something."""
    return stripped(c).rlike(rf"(?U)^(?:{_OWN_REPLY_PREFIX})\s*[:：]")


def subject_prefix(c: Column | str) -> Column:
    """What stands before the normalized subject in the original one."""
    at = F.instr(F.lower(_text(c)), normalize_subject(c))
    return F.when((normalize_subject(c) != "") & (at > 1), F.substring(_text(c), F.lit(1), at - 1)).otherwise("")


def letters_of(c: Column | str) -> Column:
    """The distinct characters of a normalized subject, spaces apart."""
    return F.array_distinct(F.filter(F.split(F.replace(normalize_subject(c), F.lit(" "), F.lit("")), ""), lambda x: x != ""))


def letter_jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def subjects_similar(a: Column | str, b: Column | str, threshold: float = 0.7) -> Column:
    na, nb = normalize_subject(a), normalize_subject(b)
    return (na != "") & (nb != "") & ((na == nb) | (letter_jaccard(letters_of(a), letters_of(b)) >= threshold))


def _quote_line(c: Column | str) -> Column:
    """Number of the first line that starts the quoted part, from 1; 0 if none does."""
    marker = "(?U)^(?:" + "|".join(QUOTE_MARKERS) + ")"
    return F.array_position(F.transform(F.split(_text(c), "\n"), lambda x: stripped(x).rlike(marker)), True)


def new_content(c: Column | str) -> Column:
    """The part of a body before the first quote marker."""
    lines, at = F.split(_text(c), "\n"), _quote_line(c).cast("int")
    return F.when(at == 0, stripped(c)).otherwise(stripped(F.array_join(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), "\n")))


def quoted_content(c: Column | str) -> Column:
    lines, at = F.split(_text(c), "\n"), _quote_line(c).cast("int")
    return F.when(at == 0, "").otherwise(stripped(F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")))


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(_text(c), _SENTENCE_END), stripped), lambda x: x != "")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def found_words(c: Column, words: Iterable[str]) -> Column:
    """Which of ``words`` occur, in their order."""
    return F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]))


def evidence(c: Column | str, words: Iterable[str], most: int = 5, shortest: int = 4) -> Column:
    """The first sentences that have one of the words."""
    words = tuple(words)
    hit = F.filter(sentences(c), lambda x: (F.length(x) >= shortest) & contains_any(x, words))
    return F.slice(hit, 1, most)


def truncated(c: Column | str, most: int = 200) -> Column:
    return F.when(F.length(_text(c)) > most, F.concat(F.substring(_text(c), 1, most), F.lit("..."))).otherwise(_text(c))


def formula_guard(c: Column | str) -> Column:
    """Cells that a spreadsheet would take for a formula get an apostrophe."""
    return F.when(_text(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), _text(c))).otherwise(_text(c))


def normalize_email(c: Column | str) -> Column:
    return F.lower(stripped(c))


def is_academic(c: Column | str, domains: Iterable[str]) -> Column:
    return contains_any(F.lower(_text(c)), domains)


def content_hash(message_id: Column | str, subject: Column | str, body: Column | str) -> Column:
    """16 hexadecimal digits that tell messages apart by id, subject and the start of the body."""
    return F.substring(F.sha2(F.concat_ws("|", _text(message_id), _text(subject), F.substring(_text(body), 1, 500)).cast("binary"), 256), 1, 16)


def html_text(c: Column | str) -> Column:
    """Text of html by patterns alone: no scripts and styles, a line for each piece between tags, no blank lines."""
    bare = F.regexp_replace(_text(c), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    lines = F.transform(F.split(F.regexp_replace(bare, r"<[^>]+>", "\n"), "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def format_datetime(c: Column | str) -> Column:
    """A time to the minute; empty where there is none."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))
