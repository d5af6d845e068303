"""Text expressions. Every helper takes and returns Columns and stays inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a JavaScript-style trim removes, the ASCII
# letters that case-insensitive matching folds, and the replacement texts and
# patterns of the redaction rules.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
KEY_PATTERN = (
    r"sk-[A-Za-z0-9]{16,}|ghp_[A-Za-z0-9]{20,}|gho_[A-Za-z0-9]{20,}"
    r"|AKIA[A-Z0-9]{12,}|Bearer\s+[A-Za-z0-9._-]{10,}"
)
KEY_STARTS = ("sk-", "ghp_", "gho_", "AKIA", "Bearer")
EMAIL_PATTERN = r"[\w.+-]{1,64}@[\w.-]{1,255}\.\w{2,24}"
HOME_PATTERN = r"/home/[^/\s]+"
SECRET_NAME_PARTS = ("KEY", "TOKEN", "SECRET", "PASSWORD", "PASS")
SECRET_MIN_LENGTH = 8
NO_PRICE = "—"
DEFAULT_STEM = "resultat"


def trim_ws(col: Column | str) -> Column:
    """Strip Unicode white space, not only blanks, from both ends."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITESPACE))


def ascii_lower(col: Column | str) -> Column:
    return F.translate(col, UPPER, LOWER)


def like_ascii(col: Column | str, needle: str) -> Column:
    """``col LIKE '%needle%'`` folding ASCII letters only.

    ``%`` and ``_`` in the needle stay wild; a backslash is an ordinary
    character, so it is doubled for Spark's default escape.
    """
    folded = needle.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(col).like(f"%{folded}%")


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def csv_cell(col: Column) -> Column:
    """Quote a cell only when it holds a quote, comma, CR or LF; NULL is empty."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in cells])


def format_price(kr: Column) -> Column:
    """Whole kronor with no-break-space grouping, or a dash when unknown."""
    grouped = F.regexp_replace(F.format_number(kr, 0), ",", "\u00a0")
    # The Swedish number format writes U+2212 for a minus sign.
    grouped = F.regexp_replace(grouped, "^-", "\u2212")
    return F.when(kr.isNull(), NO_PRICE).otherwise(F.concat(grouped, F.lit(" kr")))


def normalise_email(col: Column | str) -> Column:
    return F.lower(trim_ws(col))


def safe_filename(col: Column | str) -> Column:
    """File name stem that is safe inside a quoted header parameter."""
    stem = F.regexp_replace(F.regexp_replace(col, r"\.[^.]+$", ""), r"[^\w.\- ]+", "_")
    return F.coalesce(blank_to_null(stem), F.lit(DEFAULT_STEM))


def secret_values(settings: dict[str, str]) -> list[str]:
    """Values of settings whose name marks them as secret and that are long enough to mask."""
    return [
        value
        for name, value in settings.items()
        if len(value) >= SECRET_MIN_LENGTH and any(part in name.upper() for part in SECRET_NAME_PARTS)
    ]


def redact(col: Column | str, settings: dict[str, str] | None = None) -> Column:
    """Mask known secrets, key-like tokens, e-mail addresses and home paths, in that order."""
    out = F.col(col) if isinstance(col, str) else col
    for value in secret_values(settings or {}):
        out = F.replace(out, F.lit(value), F.lit("[REDACTED]"))
    out = _replace_where(out, KEY_STARTS, KEY_PATTERN, "[REDACTED]")
    out = _replace_where(out, ("@",), EMAIL_PATTERN, "[EMAIL REDACTED]")
    return _replace_where(out, ("/home/",), HOME_PATTERN, "/home/[user]")


def _replace_where(col: Column, parts: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """``regexp_replace`` on texts holding one of the parts every match has.

    Most texts hold none, and a plain search is far cheaper than the pattern.
    """
    present = F.contains(col, F.lit(parts[0]))
    for part in parts[1:]:
        present = present | F.contains(col, F.lit(part))
    return F.when(present, F.regexp_replace(col, pattern, replacement)).otherwise(col)
