"""Masking of private data, and warnings about it."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: An address in text, and what log lines must not show.  Java's ``\w`` takes marks and joiners but no number signs.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
_SECRETS = (
    (r"(授权码|auth_code|password|passwd|token)\s*[:=]\s*\S+", r"\1=***REDACTED***"),
    (r"sk-[a-zA-Z0-9]{10,}", "***API_KEY***"),
    (L.PHONE, "***PHONE***"),
    (L.NATIONAL_ID, "***ID_CARD***"),
)


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mask_phone(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), L.PHONE, L.PHONE_MASK)


def mask_national_id(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), L.NATIONAL_ID, L.NATIONAL_ID_MASK)


def mask_address(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), "(?d)" + L.ADDRESS, L.ADDRESS_MASK)


def mask_emails(c: Column | str, keep: Iterable[str] = ()) -> Column:
    """Addresses lose their local part but for its first letter, those in ``keep`` stay."""
    text, kept = _text(c), [k.lower() for k in keep]
    found = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))

    def masked(x: Column) -> Column:
        user = F.substring_index(x, "@", 1)
        domain = F.substring(x, F.length(user) + 2, F.length(x))
        short = F.when(F.length(user) > 2, F.substring(user, 1, 1)).otherwise("")
        hidden = F.concat(short, F.lit("***@"), domain)
        return F.when(F.lower(x).isin(kept), x).otherwise(hidden) if kept else hidden

    parts = F.arrays_zip(F.split(text, EMAIL).alias("plain"), F.transform(found, masked).alias("mask"))
    pieces = F.flatten(F.transform(parts, lambda p: F.array(p["plain"], p["mask"])))  # joined once: linear in the text
    return F.when(F.contains(text, F.lit("@")), F.array_join(pieces, "")).otherwise(text)


def mask_all(c: Column | str, keep: Iterable[str] = ()) -> Column:
    return mask_emails(mask_address(mask_national_id(mask_phone(c))), keep)


def prepared(c: Column | str, keep: Iterable[str] = (), most: int = 3000) -> Column:
    """Masked text of at most ``most`` characters, with a mark where it was cut."""
    masked = mask_all(c, keep)
    return F.when(F.length(masked) > most, F.concat(F.substring(masked, 1, most), F.lit(L.CUT_MARK))).otherwise(masked)


def warnings(c: Column | str) -> Column:
    n = F.size(F.regexp_extract_all(_text(c), F.lit(EMAIL), F.lit(0)))
    return F.array_compact(
        F.array(
            F.when(_text(c).rlike(L.PHONE), "包含手机号码"),
            F.when(_text(c).rlike(L.NATIONAL_ID), "包含身份证号码"),
            F.when(n > 0, F.concat(F.lit("包含 "), n.cast("string"), F.lit(" 个邮箱地址"))),
        )
    )


class Redacted(logging.Filter):
    """Hides secrets in the driver's log lines."""

    def filter(self, record: logging.LogRecord) -> bool:
        line = record.getMessage()
        for pattern, shown in _SECRETS:
            line = re.sub(pattern, shown, line, flags=re.IGNORECASE)
        record.msg, record.args = line, ()
        return True
