"""Brand, model, category and gender of a title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions.text import as_col, let, norm_token, present, squeeze


#: (token, category) in order, or a table of them.
TokenRules = list[tuple[str, str]] | DataFrame


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def norm_brand(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Canonical brand for a known alias, else the squeezed text; absent stays absent."""
    table = rules.BRAND_ALIASES if aliases is None else aliases
    return let(present(c), lambda raw: F.coalesce(_lookup(norm_token(raw), table), squeeze(raw)))


def norm_model(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Model slug, or the alias target."""
    table = rules.MODEL_ALIASES if aliases is None else aliases
    return let(norm_token(c), lambda t: F.coalesce(_lookup(t, table), F.replace(t, F.lit(" "), F.lit("-"))))


def extract_brand(c: Column | str, aliases: dict[str, str] | None = None) -> Column:
    """Brand of the first alias (table order) found anywhere in the text."""
    table = rules.BRAND_ALIASES if aliases is None else aliases
    return let(
        norm_token(c),
        lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(a)), F.lit(b)) for a, b in table.items()]),
    )


def infer_category(c: Column | str) -> Column:
    return F.when(F.contains(norm_token(c), F.lit("trail")), F.lit("trail")).otherwise(F.lit("running"))


def infer_gender(c: Column | str) -> Column:

    def pick(token: Column) -> Column:
        out = F.lit(None).cast("string")
        for gender, words in reversed(rules.GENDER_WORDS):
            out = F.when(token.rlike(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)"), F.lit(gender)).otherwise(out)
        return out

    return let(norm_token(c), pick)


#: Rows a table of token rules has at most: rules are settings, which become part of the expression.
RULE_ROWS = 1_000


def listed_rules(rules: DataFrame) -> list[tuple[str, str]]:
    """A table of token rules (pos, token, category) in order; a table that is too large for settings is refused."""
    rows = rules.orderBy("pos", "token").limit(RULE_ROWS + 1).select("token", "category").collect()
    if len(rows) > RULE_ROWS:
        raise ValueError(f"more than {RULE_ROWS} token rules")
    return [(r["token"], r["category"]) for r in rows]


def forced_category(title: Column | str, token_rules: TokenRules) -> Column:
    """Category of the first rule whose token occurs in the title, else null.

    Rules become part of the expression and need no join; those of a table (pos, token, category) are read when the
    expression is made, so that they can change without the code.
    """
    if isinstance(token_rules, DataFrame):
        token_rules = listed_rules(token_rules)
    if not token_rules:
        return F.lit(None).cast("string")
    return let(
        norm_token(title),
        lambda token: F.coalesce(
            *[F.when(F.contains(token, norm_token(F.lit(t))), F.lit(cat)) for t, cat in token_rules]
        ),
    )


def decide_category(title: Column | str, category: Column | str, token_rules: TokenRules) -> Column:
    return F.coalesce(forced_category(title, token_rules), present(category), infer_category(as_col(title)))
