"""Masking of sensitive columns and the rules that choose it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Replacement texts.
NO_EMAIL = "***@masked.com"
PHONE_PREFIX, NO_PHONE = "***-***-", "***"
CARD_PREFIX = "****-****-****-"
SHORT_EMAIL, NO_CARD = "***@***.com", "****-****-****-****"


def _email(c: Column) -> Column:
    return F.when(
        c.contains("@"), F.concat(F.substring(c, 1, 2), F.lit("***@"), F.split_part(c, F.lit("@"), F.lit(2)))
    ).otherwise(NO_EMAIL)


def _phone(c: Column) -> Column:
    return F.when(F.length(c) >= 4, F.concat(F.lit(PHONE_PREFIX), F.right(c, F.lit(4)))).otherwise(NO_PHONE)


def _card(c: Column) -> Column:
    return F.concat(F.lit(CARD_PREFIX), F.coalesce(F.right(c, F.lit(4)), F.lit("")))


def _email_last_part(c: Column) -> Column:
    return F.when(
        c.contains("@"), F.concat(F.substring(c, 1, 2), F.lit("***@"), F.substring_index(c, "@", -1))
    ).otherwise(NO_EMAIL)


def _card_or_null(c: Column) -> Column:
    return F.concat(F.lit(CARD_PREFIX), F.right(c, F.lit(4)))


def _email_short(c: Column) -> Column:
    return F.when(F.instr(c, "@") > 1, F.concat(F.left(c, F.lit(1)), F.lit(SHORT_EMAIL))).otherwise(SHORT_EMAIL)


def _phone_ends(c: Column) -> Column:
    return F.when(
        F.length(c) >= 4, F.concat(F.left(c, F.lit(3)), F.lit("****"), F.right(c, F.lit(2)))
    ).otherwise(NO_PHONE)


def _card_checked(c: Column) -> Column:
    return F.when(F.length(c) >= 4, F.concat(F.lit(CARD_PREFIX), F.right(c, F.lit(4)))).otherwise(NO_CARD)


def _md5_upper(c: Column) -> Column:
    return F.upper(F.md5(F.encode(c, "UTF-16LE")))


_COMMON: dict[str, Callable[[Column], Column]] = {
    "MD5_HASH": lambda c: F.md5(c),
    "MASK_EMAIL": _email,
    "MASK_PHONE": _phone,
    "MASK_CARD": _card,
    "NULL_OUT": lambda c: F.lit(None).cast("string"),
}
# the three source families differ in how they cut e-mail, phone and card text
DIALECTS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "ansi": _COMMON,
    "last_part": {**_COMMON, "MASK_EMAIL": _email_last_part, "MASK_CARD": _card_or_null},
    "short": {
        **_COMMON,
        "MD5_HASH": _md5_upper,
        "MASK_EMAIL": _email_short,
        "MASK_PHONE": _phone_ends,
        "MASK_CARD": _card_checked,
    },
}


def mask(df: DataFrame, rules: Mapping[str, str], dialect: str = "ansi") -> DataFrame:
    """Apply one masking per column; EXCLUDE leaves the column out, NONE keeps it."""
    masks = DIALECTS[dialect]
    kept = []
    for c in df.columns:
        rule = rules.get(c, "NONE")
        if rule == "EXCLUDE":
            continue
        kept.append(F.col(c) if rule == "NONE" else masks[rule](F.col(c).cast("string")).alias(c))
    return df.select(*kept) if kept else df.select(F.lit(1).alias("placeholder"))


# Parts of column names, tried in this order.
SENSITIVE_NAMES = (
    ("EXCLUDE", ("password", "secret", "token", "salt", "hash", "auth_key")),
    ("MASK_CARD", ("card", "credit", "cvv", "bank_acc", "pan")),
    ("MD5_HASH", ("ssn", "tax_id", "cccd", "cmnd", "identity", "passport")),
    ("MASK_EMAIL", ("email", "mail")),
    ("MASK_PHONE", ("phone", "mobile", "tel", "sdt")),
)
CURSOR_NAMES = ("update", "modify", "edit", "create")
CONTENT_PATTERNS = (
    ("email_share", r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"),
    ("phone_share", r"^\+?[0-9][0-9 .()-]{6,18}[0-9]$"),
    ("card_share", r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$"),
)


def mask_for_name(name: str) -> str:
    low = name.lower()
    return next((rule for rule, parts in SENSITIVE_NAMES if any(p in low for p in parts)), "NONE")


def is_cursor(name: str, kind: str) -> bool:
    timed = "time" in kind.lower() or "date" in kind.lower()
    return timed and any(p in name.lower() for p in CURSOR_NAMES)


def classify_columns(df: DataFrame) -> DataFrame:
    """One row per column: sensitivity by name, cursor use, and pattern shares of text columns.

    The shares of all text columns come from one aggregate pass.
    """
    texts = [name for name, kind in df.dtypes if kind == "string"]
    shares = [
        F.avg(F.col(c).rlike(pattern).cast("int")).alias(f"_{i}_{label}")
        for i, c in enumerate(df.columns)
        if c in texts
        for label, pattern in CONTENT_PATTERNS
    ]
    measured = df.agg(*shares, F.count(F.lit(1)).alias("_rows"))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.lit(name).alias("column"),
                F.lit(mask_for_name(name) != "NONE").alias("sensitive"),
                F.lit(mask_for_name(name)).alias("mask"),
                F.lit(is_cursor(name, kind)).alias("is_cursor"),
                *[
                    (F.col(f"_{i}_{label}") if name in texts else F.lit(None)).cast("double").alias(label)
                    for label, _ in CONTENT_PATTERNS
                ],
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    return measured.select(F.inline(rows))
