"""Text normalisation, html text, size extraction and display text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules

# White space as ECMAScript defines it (Java's \s is ASCII only).
SPACES = (
    "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A Column that is mentioned twice is evaluated twice when the mentions sit
    in different branches; binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def made_once(df: DataFrame, keep: Callable[[Column], Column] | None = None, **columns: Column) -> DataFrame:
    """Add columns, dropping rows for which ``keep`` fails.

    The columns are made as one struct that is exploded (none or one per row).
    A plain projection would be merged with later ones, and a plain filter would
    be pushed below it; both compute the expressions again.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    if keep is not None:
        made = F.filter(made, keep)
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(made).alias("_made")).select(*rest, "_made.*")


def ascii_regex(pattern: str, ignore_case: bool = True) -> str:
    """Java form of a pattern whose leading / trailing ``\\b`` is an ASCII boundary."""
    if pattern.startswith(r"\b"):
        pattern = r"(?<!\w)" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + r"(?!\w)"
    return ("(?i)" if ignore_case else "") + pattern


def any_match(c: Column, patterns: list[str]) -> Column:
    """True where one of the patterns is found: one scan.

    Patterns that are whole words on both sides share their boundary tests, so
    most positions of a long text fail on the first test.
    """
    whole = [p[2:-2] for p in patterns if p.startswith(r"\b") and p.endswith(r"\b")]
    rest = [p for p in patterns if not (p.startswith(r"\b") and p.endswith(r"\b"))]
    parts = [f"(?:{ascii_regex(p, False)})" for p in rest]
    if whole:
        parts.insert(0, rf"(?<!\w)(?:{'|'.join(whole)})(?!\w)")
    return c.rlike("(?i)" + "|".join(parts))


def present(c: Column | str) -> Column:
    """The value, with the empty string read as absent."""
    return F.nullif(as_col(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    """Collapse white space and trim."""
    # Single blanks stay as they are, so clean text has nothing to replace.
    return F.trim(F.regexp_replace(as_col(c), f"{SPACES}{{2,}}|(?! ){SPACES}", " "))


def norm_token(c: Column | str) -> Column:
    """Lower case, quotes dropped, every other run of non [a-z0-9-] one blank."""
    bare = F.replace(F.replace(F.lower(as_col(c)), F.lit("'"), F.lit("")), F.lit('"'), F.lit(""))
    return F.trim(F.regexp_replace(bare, "[^a-z0-9-]+", " "))


def split_tokens(
    c: Column | str, drop_low_signal: bool = True, low_signal: list[str] | None = None
) -> Column:
    """Array of tokens, in order, repeats kept."""
    stop = rules.LOW_SIGNAL_TOKENS if low_signal is None else low_signal
    tokens = F.split(norm_token(c), "[ -]+")
    if drop_low_signal:
        return F.filter(tokens, lambda t: (t != "") & ~t.isin(*stop))
    return F.filter(tokens, lambda t: t != "")


def _code_point(hex8: Column) -> Column:
    """Character for eight hex digits of an assigned code point."""
    return F.decode(F.unhex(hex8), "UTF-32")


def _entity(token: Column) -> Column:
    low = F.lower(token)
    hexa = F.upper(F.regexp_replace(F.regexp_extract(low, "^&#x([0-9a-f]+);$", 1), "^0+(?=.)", ""))
    hexa = F.lpad(hexa, 8, "0")
    deci = F.regexp_replace(F.regexp_extract(low, r"^&#(\d+);$", 1), "^0+(?=.)", "")
    deci8 = F.lpad(F.hex(deci.try_cast("long")), 8, "0")

    def char(raw_len_ok: Column, hex8: Column) -> Column:
        surrogate = (hex8 >= "0000D800") & (hex8 <= "0000DFFF")
        return (
            F.when(~raw_len_ok | (hex8 > "0010FFFF"), token)
            .when(surrogate, F.lit("�"))
            .otherwise(_code_point(hex8))
        )

    named = F.lit(None).cast("string")
    for name, text in reversed(list(rules.NAMED_ENTITIES.items())):
        named = F.when(low == f"&{name};", F.lit(text)).otherwise(named)
    hex_digits = F.length(F.regexp_replace(F.regexp_extract(low, "^&#x([0-9a-f]+);$", 1), "^0+", ""))
    return (
        F.when(low.rlike("^&#x[0-9a-f]+;$"), char(hex_digits <= 6, hexa))
        .when(low.rlike(r"^&#\d+;$"), char(F.length(deci) <= 7, deci8))
        .otherwise(F.coalesce(named, token))
    )


def html_decode(c: Column | str) -> Column:
    """Decode numeric and the known named entities, one pass.

    A code point above the Unicode range is kept as written; a lone surrogate
    becomes U+FFFD, which is what any UTF-8 writer makes of it.
    """

    def decode(t: Column) -> Column:
        pieces = F.regexp_extract_all(
            t, F.lit(r"(?is)&#x[0-9a-f]+;|&#\d+;|&(?:amp|quot|apos|nbsp);|[^&]+|&"), F.lit(0)
        )
        decoded = F.transform(pieces, lambda x: F.when(x.startswith("&"), _entity(x)).otherwise(x))
        return F.when(F.instr(t, "&") > 0, F.array_join(decoded, "")).otherwise(t)

    return let(as_col(c), decode)


def offer_text(c: Column | str) -> Column:
    """Decoded and squeezed text of a title or model."""
    return squeeze(html_decode(c))


def strip_tags(c: Column | str) -> Column:
    no_tags = F.regexp_replace(as_col(c), "<[^>]+>", " ")
    return squeeze(F.replace(F.replace(no_tags, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


def _trim_separators(c: Column) -> Column:
    c = F.regexp_replace(c, r"^\s*[-|/,;:]+\s*", "")
    c = F.regexp_replace(c, r"\s*[-|/,;:]+\s*$", "")
    c = F.regexp_replace(c, r"\(\s*\)", " ")
    return offer_text(F.regexp_replace(c, r"\[\s*\]", " "))


def _size_format(c: Column, pattern: str, fmt: str) -> Column:
    parts = []
    for piece in re.split(r"(\{\d\})", fmt):
        group = re.fullmatch(r"\{(\d)\}", piece)
        if group:
            parts.append(F.upper(F.regexp_extract(c, pattern, int(group.group(1)))))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def size_parts(c: Column | str) -> Column:
    """struct(cleaned, size_range) by the first size pattern that occurs."""

    def parts(text: Column) -> Column:
        def pair(cleaned: Column, size: Column) -> Column:
            return F.struct(cleaned.alias("cleaned"), size.alias("size_range"))

        out = pair(text, F.lit(None).cast("string"))
        for raw, fmt in reversed(rules.SIZE_PATTERNS):
            pattern = ascii_regex(raw)
            # The lazy prefix keeps the replacement to the first occurrence.
            first = "(?is)^(.*?)" + ascii_regex(raw, False)
            without = _trim_separators(F.regexp_replace(text, first, "$1 "))
            out = F.when(text.rlike(pattern), pair(without, _size_format(text, pattern, fmt))).otherwise(out)
        # Every size pattern starts like this; most titles have none.
        maybe = text.rlike(r"(?i)(?<!\w)(?:[mw]|us|eu|size)\s*:?\s*\d")
        return F.when(maybe, out).otherwise(pair(text, F.lit(None).cast("string")))

    return let(offer_text(c), parts)


def norm_for_match(c: Column | str) -> Column:
    """Slug of a title without gender and category words."""
    from offerloom.functions.names import norm_model

    words = ascii_regex(rf"\b(?:{'|'.join(rules.MATCH_NOISE_WORDS)})\b")
    return norm_model(F.regexp_replace(as_col(c), words, ""))


def _title_run(run: Column) -> Column:
    return F.when(
        run.rlike("^[A-Za-z]"), F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, 2, 1 << 30)))
    ).otherwise(run)


def model_display(c: Column | str) -> Column:
    """Title-cased model; tokens of two or more capitals stay as they are."""
    cleaned = squeeze(F.regexp_replace(as_col(c), "[-_]+", " "))

    def show(token: Column) -> Column:
        letters = F.regexp_replace(token, "[^A-Za-z]", "")
        caps = (F.length(letters) >= 2) & (letters == F.upper(letters))
        runs = F.regexp_extract_all(token, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
        return F.when(caps, token).otherwise(F.array_join(F.transform(runs, _title_run), ""))

    return F.array_join(F.transform(F.split(cleaned, " "), show), " ")


def size_display(c: Column | str) -> Column:
    return present(squeeze(F.regexp_replace(as_col(c), "_+", " ")))


def excerpt(c: Column | str, limit: int = rules.WARNING_EXCERPT, empty: str = "None") -> Column:
    return let(
        squeeze(c),
        lambda t: F.when(t == "", F.lit(empty))
        .when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("...")))
        .otherwise(t),
    )


def file_slug(c: Column | str) -> Column:
    """Lower-case slug for a report name."""
    c = F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9-]+", "-")
    return F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-|-$", "")
