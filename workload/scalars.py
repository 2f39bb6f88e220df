"""Scalar functions over part, documents, customer and lineitem columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerloom import rules
from offerloom.functions import ids, labels, money, names, text, urls
from offerloom.operators.similarity import jaccard, token_set
from workload.base import query, quoted, sql_discount, sql_excerpt, sql_id, sql_round, sql_squeeze, sql_token, spread_table, table

# Raw spellings derived from part rows; read the same in both engines.
RAW_BRAND = (
    "CASE WHEN p_size % 6 = 0 THEN 'nb' WHEN p_size % 6 = 1 THEN '  New   Balance ' WHEN p_size % 6 = 2 THEN 'ASICS' "
    "WHEN p_size % 6 = 3 THEN '' WHEN p_size % 6 = 4 THEN 'Hoka' ELSE concat(' ', p_brand, '  ', p_type) END"
)
RAW_MODEL = (
    "CASE WHEN p_size % 7 = 0 THEN 'Gel Kayano  30' WHEN p_size % 7 = 1 THEN 'GELKAYANO 30' "
    "WHEN p_size % 7 = 2 THEN 'gel-kayano 30' WHEN p_size % 7 = 3 THEN 'Pegasus_41' "
    "ELSE concat(p_name, ' \"', p_type, '\" ', cast(p_size as string)) END"
)
RAW_TITLE = (
    "CASE WHEN p_size % 8 = 0 THEN concat(p_name, ' Men''s Running Shoes') "
    "WHEN p_size % 8 = 1 THEN concat('WOMENS ', p_name, ' Trail') WHEN p_size % 8 = 2 THEN concat('émen ', p_name) "
    "WHEN p_size % 8 = 3 THEN concat(p_name, ' youth unisex') WHEN p_size % 8 = 4 THEN concat(p_name, ' Unisex shoe') "
    "WHEN p_size % 8 = 5 THEN concat('Sunburst trailing ', p_type) WHEN p_size % 8 = 6 THEN concat('HOKA men women ', p_name) "
    "ELSE concat(p_brand, ' ', p_name, ' ', p_type) END"
)
RAW_SKU = "concat(' ', p_brand, '-', cast(p_partkey as string), ' m_', cast(p_size as string), ' ')"
RAW_GTIN = (
    "CASE WHEN p_size % 5 = 0 THEN 'none' WHEN p_size % 5 = 1 THEN concat('ean 19360423', cast(p_partkey as string)) "
    "ELSE concat('1936042330011', cast(p_partkey as string), '-', cast(p_size as string)) END"
)


@query("norm_ws", f"SELECT doc_id, {sql_squeeze('text')} AS norm FROM documents")
def norm_ws(spark, d):
    return spread_table(spark, d, "documents").select("doc_id", text.squeeze("text").alias("norm"))


@query("norm_token", f"SELECT doc_id, {sql_token('text')} AS norm FROM documents")
def norm_token(spark, d):
    return spread_table(spark, d, "documents").select("doc_id", text.norm_token("text").alias("norm"))


def sql_brand(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in rules.BRAND_ALIASES.items())
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL ELSE CASE {sql_token(x)} {cases} ELSE {sql_squeeze(x)} END END"


def sql_model(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in rules.MODEL_ALIASES.items())
    return f"CASE {sql_token(x)} {cases} ELSE replace({sql_token(x)}, ' ', '-') END"


@query("norm_brand", f"SELECT p_partkey, {sql_brand('raw')} AS brand FROM (SELECT p_partkey, {RAW_BRAND} AS raw FROM part)")
def norm_brand(spark, d):
    return table(spark, d, "part").select("p_partkey", names.norm_brand(F.expr(RAW_BRAND)).alias("brand"))


@query("norm_model", f"SELECT p_partkey, {sql_model('raw')} AS model FROM (SELECT p_partkey, {RAW_MODEL} AS raw FROM part)")
def norm_model(spark, d):
    return table(spark, d, "part").select("p_partkey", names.norm_model(F.expr(RAW_MODEL)).alias("model"))


STOP_SQL = ", ".join(quoted(t) for t in rules.LOW_SIGNAL_TOKENS)


def sql_tokens(x: str, drop: bool = True) -> str:
    cond = f"t <> '' AND t NOT IN ({STOP_SQL})" if drop else "t <> ''"
    return f"list_filter(string_split_regex({sql_token(x)}, '[ -]+'), lambda t: {cond})"


@query(
    "split_tokens",
    f"""SELECT doc_id, array_to_string({sql_tokens('text')}, '|') AS tokens,
      len({sql_tokens('text', False)}) AS all_tokens FROM documents""",
)
def split_tokens(spark, d):
    return spread_table(spark, d, "documents").select(
        "doc_id",
        F.array_join(text.split_tokens("text"), "|").alias("tokens"),
        F.size(text.split_tokens("text", drop_low_signal=False)).alias("all_tokens"),
    )


SKU_SQL = "nullif(upper(regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')), '')"
GTIN_SQL = (
    "CASE WHEN length(digits) < 14 THEN lpad(digits, 14, '0') ELSE digits END"
)


@query("norm_sku", f"SELECT p_partkey, {SKU_SQL} AS sku FROM (SELECT p_partkey, {RAW_SKU} AS raw FROM part)")
def norm_sku(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.norm_sku(F.expr(RAW_SKU)).alias("sku"))


@query(
    "norm_gtin",
    f"""SELECT p_partkey, {GTIN_SQL} AS gtin FROM (
      SELECT p_partkey, nullif(regexp_replace({RAW_GTIN}, '[^0-9]', '', 'g'), '') AS digits FROM part)""",
)
def norm_gtin(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.norm_gtin(F.expr(RAW_GTIN)).alias("gtin"))


@query(
    "norm_identifiers",
    f"""SELECT p_partkey, sku, {GTIN_SQL} AS gtin, sku IS NOT NULL OR digits IS NOT NULL AS any_id FROM (
      SELECT p_partkey, {SKU_SQL} AS sku, nullif(regexp_replace({RAW_GTIN}, '[^0-9]', '', 'g'), '') AS digits
      FROM (SELECT *, {RAW_SKU} AS raw FROM part))""",
)
def norm_identifiers(spark, d):
    found = ids.norm_identifiers(F.expr(RAW_SKU), F.expr(RAW_GTIN))
    return table(spark, d, "part").select(
        "p_partkey", found["sku"].alias("sku"), found["gtin"].alias("gtin"), found.isNotNull().alias("any_id")
    )


@query(
    "infer_category",
    f"""SELECT p_partkey, CASE WHEN contains({sql_token(RAW_TITLE)}, 'trail') THEN 'trail' ELSE 'running' END AS category
      FROM part""",
)
def infer_category(spark, d):
    return table(spark, d, "part").select("p_partkey", names.infer_category(F.expr(RAW_TITLE)).alias("category"))


GENDER_SQL = "CASE " + " ".join(
    rf"WHEN regexp_matches({sql_token('raw')}, '\b({'|'.join(w.replace(chr(39), chr(39) * 2) for w in ws)})\b') THEN '{g}'"
    for g, ws in rules.GENDER_WORDS
) + " END"


@query("infer_gender", f"SELECT p_partkey, {GENDER_SQL} AS gender FROM (SELECT p_partkey, {RAW_TITLE} AS raw FROM part)")
def infer_gender(spark, d):
    return table(spark, d, "part").select("p_partkey", names.infer_gender(F.expr(RAW_TITLE)).alias("gender"))


EXTRACT_BRAND_SQL = "CASE " + " ".join(
    f"WHEN contains({sql_token('raw')}, {quoted(a)}) THEN {quoted(b)}" for a, b in rules.BRAND_ALIASES.items()
) + " END"


@query(
    "extract_brand",
    f"""SELECT kind, id, {EXTRACT_BRAND_SQL} AS brand FROM (
      SELECT 'part' AS kind, p_partkey AS id, {RAW_TITLE} AS raw FROM part
      UNION ALL SELECT 'document', doc_id, text FROM documents)""",
)
def extract_brand(spark, d):
    rows = (
        table(spark, d, "part")
        .select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.expr(RAW_TITLE).alias("raw"))
        .union(spread_table(spark, d, "documents").select(F.lit("document"), "doc_id", "text"))
    )
    return rows.select("kind", "id", names.extract_brand("raw").alias("brand"))


NOISE_SQL = rf"regexp_replace(raw, '(?i)\b({'|'.join(rules.MATCH_NOISE_WORDS)})\b', '', 'g')"


@query(
    "norm_for_match",
    f"SELECT p_partkey, {sql_model(NOISE_SQL)} AS slug FROM (SELECT p_partkey, {RAW_TITLE} AS raw FROM part)",
)
def norm_for_match(spark, d):
    return table(spark, d, "part").select("p_partkey", text.norm_for_match(F.expr(RAW_TITLE)).alias("slug"))


ORIGINAL = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0e0 ELSE l_extendedprice END"
CURRENT = "l_extendedprice * (1e0 + 0.01e0 * CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END - l_discount)"
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "discount_pct",
    f"""SELECT {', '.join(LI_KEY)}, {sql_discount('cur', 'org')} AS discount_pct FROM (
      SELECT *, {ORIGINAL} AS org, {sql_round(CURRENT.join('()'), 2)} AS cur FROM lineitem)""",
)
def discount_pct(spark, d):
    return (
        table(spark, d, "lineitem")
        .withColumn("cur", money.js_round(F.expr(CURRENT), 2))
        .select(*LI_KEY, money.discount_pct("cur", F.expr(ORIGINAL)).alias("discount_pct"))
    )


ENTITIES = " Men&#x27;s&nbsp;&#8217;&#128512; &#xzz; &#99999999; &QUOT;q&apos; &AMP;&#00065;&#X41; &amp;#39; &lt;"
DECODED = " Men's \u2019\U0001F600 &#xzz; &#99999999; \"q' &AA &#39; &lt;"


@query(
    "html_decode",
    f"""SELECT page_id, d || {quoted(DECODED)} AS decoded, {sql_squeeze(f"d || {quoted(DECODED)}")} AS offer_text FROM (
      SELECT page_id, replace(replace(replace(replace(html, '&nbsp;', ' '), '&quot;', '"'), '&apos;', ''''),
        '&amp;', '&') AS d FROM pages)""",
)
def html_decode(spark, d):
    raw = F.concat("html", F.lit(ENTITIES))
    return spread_table(spark, d, "pages").select(
        "page_id", text.html_decode(raw).alias("decoded"), text.offer_text(raw).alias("offer_text")
    )


RAW_SIZED = (
    "concat(p_name, CASE WHEN p_size % 9 = 0 THEN concat(' M', cast(p_size as string), ' / w 8.5') "
    "WHEN p_size % 9 = 1 THEN concat(' m7 w', cast(p_size as string), ' x m9') "
    "WHEN p_size % 9 = 2 THEN concat(' W', cast(p_size as string), ' M8 -') "
    "WHEN p_size % 9 = 3 THEN concat(' (w', cast(p_size as string), ') - ') "
    "WHEN p_size % 9 = 4 THEN concat(' US ', cast(p_size as string), '.5 EU 44') "
    "WHEN p_size % 9 = 5 THEN concat(' | Size: ', cast(p_size as string)) "
    "WHEN p_size % 9 = 6 THEN ' Guide 19' WHEN p_size % 9 = 7 THEN concat(' ém', cast(p_size as string)) ELSE ' [size 10] ;' END)"
)


def sql_clean(x: str) -> str:
    x = f"regexp_replace({x}, '^\\s*[-|/,;:]+\\s*', '')"
    x = f"regexp_replace({x}, '\\s*[-|/,;:]+\\s*$', '')"
    x = f"regexp_replace({x}, '\\(\\s*\\)', ' ', 'g')"
    return sql_squeeze(f"regexp_replace({x}, '\\[\\s*\\]', ' ', 'g')")


def _size_sql() -> tuple[str, str]:
    clean, size = [], []
    for pattern, fmt in rules.SIZE_PATTERNS:
        p = "(?i)" + pattern
        found = f"regexp_matches(raw, '{p}')"
        clean.append(f"WHEN {found} THEN {sql_clean(f'''regexp_replace(raw, '{p}', ' ')''')}")
        out = fmt
        parts = []
        while out:
            if out[0] == "{":
                parts.append(f"upper(regexp_extract(raw, '{p}', {out[1]}))")
                out = out[3:]
            else:
                n = out.find("{") if "{" in out else len(out)
                parts.append(quoted(out[:n]))
                out = out[n:]
        size.append(f"WHEN {found} THEN {' || '.join(parts)}")
    return f"CASE {' '.join(clean)} ELSE raw END", f"CASE {' '.join(size)} END"


CLEAN_SQL, SIZE_SQL = _size_sql()


@query(
    "size_range",
    f"""SELECT p_partkey, {CLEAN_SQL} AS cleaned, {SIZE_SQL} AS size_range
      FROM (SELECT p_partkey, {sql_squeeze(RAW_SIZED)} AS raw FROM part)""",
)
def size_range(spark, d):
    return (
        table(spark, d, "part")
        .select("p_partkey", text.size_parts(F.expr(RAW_SIZED)).alias("s"))
        .select("p_partkey", "s.cleaned", "s.size_range")
    )


STRIP_SQL = sql_squeeze("replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")


@query("strip_tags", f"SELECT page_id, {STRIP_SQL} AS body FROM pages")
def strip_tags(spark, d):
    return spread_table(spark, d, "pages").select("page_id", text.strip_tags("html").alias("body"))


MESSY = (
    "CASE WHEN l_linenumber = 1 THEN concat('$ ', amount, ' CAD') WHEN l_linenumber = 2 THEN concat('CA$&nbsp;', replace(amount, '.', ',')) "
    "WHEN l_linenumber = 3 THEN concat('1,', amount) WHEN l_linenumber = 4 THEN 'call us' "
    "WHEN l_linenumber = 5 THEN concat(amount, '-', amount) WHEN l_linenumber = 6 THEN concat('-', amount) ELSE concat(amount, '.') END"
)


@query(
    "parse_number",
    f"""SELECT {', '.join(LI_KEY)}, try_cast(nullif(replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?i)&nbsp;', ' ', 'g'),
        '[^0-9.,-]+', '', 'g'), '(\\d),(\\d{{2}})$', '\\1.\\2'), ',', ''), '') AS DOUBLE) AS parsed
      FROM (SELECT *, {MESSY} AS raw FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM lineitem))""",
)
def parse_number(spark, d):
    return (
        table(spark, d, "lineitem")
        .withColumn("amount", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
        .select(*LI_KEY, money.parse_number(F.expr(MESSY)).alias("parsed"))
    )


PRICED = (
    "concat(html, ' <b>Now</b> $1,', cast(100 + page_id % 900 as string), '.50 was CAD ', cast(page_id as string), ',99 or C$ 12 . 30')"
)
BARE = "concat('sale ', cast(10 + page_id % 990 as string), '.25 from 19.99 to 3000.00 ', url)"


def sql_amounts(pattern: str, x: str) -> str:
    number = (
        "try_cast(nullif(replace(regexp_replace(regexp_replace(p, '[^0-9.,-]+', '', 'g'), '(\\d),(\\d{2})$', '\\1.\\2'), ',', ''), '') AS DOUBLE)"
    )
    return f"list_transform(regexp_extract_all({x}, '{pattern}', 1), lambda p: {number})"


def sql_prices(x: str) -> str:
    body = sql_squeeze(f"replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")
    body = f"regexp_replace({body}, '(\\d),(\\d{{3}})([^\\d]|$)', '\\1\\2\\3', 'g')"
    body = f"regexp_replace({body}, '(\\d)\\s*[.,]\\s*(\\d{{2}})', '\\1.\\2', 'g')"
    marked = f"list_filter({sql_amounts('(?i)' + rules.MARKED_PRICE, body)}, lambda p: p > 0)"
    bare = f"list_filter({sql_amounts(rules.BARE_PRICE, body)}, lambda p: p > 20 AND p < 2500)"
    return (
        f"CASE WHEN len({marked}) > 0 THEN {marked} WHEN regexp_matches({body}, '(?i){rules.PRICE_WORD}') THEN {bare} ELSE [] END"
    )


def sql_money_list(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda p: printf('%.2f', p)), ' ')"


def money_list(c):
    return F.array_join(F.transform(c, money.fixed2), " ")


@query(
    "price_list",
    f"SELECT page_id, {sql_money_list(sql_prices(PRICED))} AS marked, {sql_money_list(sql_prices(BARE))} AS bare FROM pages",
)
def price_list(spark, d):
    return spread_table(spark, d, "pages").select(
        "page_id",
        money_list(money.price_list(F.expr(PRICED))).alias("marked"),
        money_list(money.price_list(F.expr(BARE))).alias("bare"),
    )


@query("stable_id", f"SELECT p_partkey, {sql_id('shoe', 'p_name', 'p_brand', 'p_type')} AS id FROM part")
def stable_id(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", ids.stable_id("shoe", F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("id")
    )


CONFIDENCE_IN = {
    "brand": "CASE WHEN l_linenumber % 2 = 0 THEN 'b' WHEN l_linenumber = 1 THEN '' END",
    "model": "CASE WHEN l_returnflag <> 'A' THEN 'm' END",
    "sku": "CASE WHEN l_linestatus = 'O' THEN 'x' END",
    "org": "CASE WHEN l_tax > 0.02e0 THEN l_extendedprice END",
    "cur": "l_extendedprice * (1e0 - l_discount)",
    "fixture": "l_suppkey % 3 = 0",
}
CONFIDENCE_SQL = (
    "greatest(0e0, least(1e0, "
    + sql_round(
        "(0.45e0 + CASE WHEN coalesce(brand, '') <> '' THEN 0.1e0 ELSE 0e0 END + CASE WHEN model IS NOT NULL THEN 0.1e0 ELSE 0e0 END"
        " + CASE WHEN sku IS NOT NULL THEN 0.2e0 ELSE 0e0 END + CASE WHEN org > cur THEN 0.1e0 ELSE 0e0 END"
        " - CASE WHEN fixture THEN 0.1e0 ELSE 0e0 END)",
        2,
    )
    + "))"
)
CONFIDENCE_COLS = ", ".join(f"{e} AS {n}" for n, e in CONFIDENCE_IN.items())


@query("confidence", f"SELECT {', '.join(LI_KEY)}, {CONFIDENCE_SQL} AS score FROM (SELECT *, {CONFIDENCE_COLS} FROM lineitem)")
def confidence(spark, d):
    rows = table(spark, d, "lineitem").withColumns({n: F.expr(e) for n, e in CONFIDENCE_IN.items()})
    score = money.source_confidence("brand", "model", "sku", F.lit(None).cast("string"), "cur", "org", "fixture")
    return rows.select(*LI_KEY, score.alias("score"))


OWN = "l_discount * 7e0 + 0.3e0"
MATCHED = "0.6e0 + l_tax * 5e0"


@query(
    "confidence_blend",
    f"""SELECT {', '.join(LI_KEY)}, greatest(own, {sql_round('((own + hit) / 2e0)', 2)}) AS blended
      FROM (SELECT *, {OWN} AS own, {MATCHED} AS hit FROM lineitem)""",
)
def confidence_blend(spark, d):
    rows = table(spark, d, "lineitem").withColumn("own", F.expr(OWN)).withColumn("hit", F.expr(MATCHED))
    return rows.select(*LI_KEY, money.blend_confidence("own", "hit").alias("blended"))


TRUST = "0.5e0 + l_quantity / 100e0"


@query(
    "trust_band",
    f"""SELECT {', '.join(LI_KEY)}, CASE WHEN c >= 0.9e0 THEN 'High trust' WHEN c >= 0.75e0 THEN 'Moderate trust' ELSE 'Low trust' END AS trust,
      CAST(floor(c * 100e0 + 0.5e0) AS BIGINT) AS trust_pct FROM (SELECT *, {TRUST} AS c FROM lineitem)""",
)
def trust_band(spark, d):
    c = F.expr(TRUST)
    return table(spark, d, "lineitem").select(
        *LI_KEY, money.trust_label(c).alias("trust"), money.trust_pct(c).alias("trust_pct")
    )


@query(
    "price_fmt",
    f"""SELECT {', '.join(LI_KEY)}, '$' || format('{{:,.2f}}', l_extendedprice) AS price, '$' || printf('%.2f', l_extendedprice) || ' CAD' AS card_price,
      CASE WHEN l_discount > 0 THEN 'Up to ' || CAST(CAST(round(l_discount * 100e0) AS INTEGER) AS VARCHAR) || '% off' END AS discount FROM lineitem""",
)
def price_fmt(spark, d):
    return table(spark, d, "lineitem").select(
        *LI_KEY,
        money.price_text("l_extendedprice").alias("price"),
        money.card_price_text("l_extendedprice").alias("card_price"),
        money.discount_text(F.col("l_discount") * F.lit(100.0)).alias("discount"),
    )


@query(
    "excerpt",
    f"""SELECT doc_id, {sql_excerpt('text', 130, 'None')} AS warning, {sql_excerpt('text', 180, 'No response body.')} AS response
      FROM documents""",
)
def excerpt(spark, d):
    return spread_table(spark, d, "documents").select(
        "doc_id",
        text.excerpt("text").alias("warning"),
        text.excerpt("text", rules.RESPONSE_EXCERPT, "No response body.").alias("response"),
    )


RAW_TIME = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' WHEN event_id % 5 = 2 THEN concat('bad ', event_type) ELSE stamp END"


@query(
    "ts_label",
    f"""SELECT event_id, CASE WHEN raw IS NULL OR raw = '' THEN 'Not available' WHEN try_cast(raw AS TIMESTAMP) IS NULL THEN 'Invalid timestamp'
      ELSE strftime(try_cast(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS label
      FROM (SELECT event_id, {RAW_TIME} AS raw FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events))""",
)
def ts_label(spark, d):
    rows = table(spark, d, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.select("event_id", labels.time_label(F.expr(RAW_TIME)).alias("label"))


RAW_DISPLAY = "concat(lower(p_name), '-v', cast(p_size as string), '_', p_type, '--GTX 2e')"


@query(
    "model_display",
    f"""SELECT p_partkey, array_to_string(list_transform(string_split({sql_squeeze("regexp_replace(raw, '[-_]+', ' ', 'g')")}, ' '),
        lambda t: CASE WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 2
            AND regexp_replace(t, '[^A-Za-z]', '', 'g') = upper(regexp_replace(t, '[^A-Za-z]', '', 'g')) THEN t
          ELSE array_to_string(list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]+'),
            lambda r: upper(substr(r, 1, 1)) || lower(substr(r, 2))), '') END), ' ') AS shown,
      nullif({sql_squeeze("regexp_replace(raw, '_+', ' ', 'g')")}, '') AS size_shown
      FROM (SELECT p_partkey, {RAW_DISPLAY} AS raw FROM part)""",
)
def model_display(spark, d):
    raw = F.expr(RAW_DISPLAY)
    return table(spark, d, "part").select(
        "p_partkey", text.model_display(raw).alias("shown"), text.size_display(raw).alias("size_shown")
    )


LEFT_TITLE = "concat(p_name, ' ', p_type, ' ', cast(p_size % 4 as string))"
RIGHT_TITLE = "concat(p_type, ' shoes ', p_name, ' x', cast(p_size % 3 as string), ' ', p_brand)"


@query(
    "jaccard_pair",
    f"""SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS together,
      {sql_round('(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))))', 2)} AS score
      FROM (SELECT p_partkey, list_distinct({sql_tokens(LEFT_TITLE)}) AS a, list_distinct({sql_tokens(RIGHT_TITLE)}) AS b FROM part)""",
)
def jaccard_pair(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", token_set(F.expr(LEFT_TITLE)).alias("a"), token_set(F.expr(RIGHT_TITLE)).alias("b")
    )
    return rows.select(
        "p_partkey",
        F.size(F.array_intersect("a", "b")).alias("shared"),
        F.size(F.array_union("a", "b")).alias("together"),
        jaccard(F.col("a"), F.col("b")).alias("score"),
    )


PART_URL = (
    "concat('https://www.Shop.example.com/Products/', replace(p_name, ' ', '-'), '_', lower(p_type), '%20p-', "
    "cast(p_size as string), CASE WHEN p_size % 2 = 0 THEN '.html' ELSE '/?sku=1' END)"
)


@query(
    "slug_title",
    f"""SELECT id, CASE WHEN length(t) >= 8 THEN t END AS title FROM (
      SELECT id, {sql_squeeze(r"regexp_replace(regexp_replace(regexp_replace(url_decode(seg), '(?i)\.[a-z0-9]{2,5}$', ''), '[-_]+', ' ', 'g'), '(?i)\b(pdp|product|products|pd|p)\b', ' ', 'g')")} AS t
      FROM (SELECT id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1) AS seg FROM (
        SELECT 'u' || page_id AS id, url FROM pages UNION ALL SELECT 'p' || p_partkey, {PART_URL} FROM part)))""",
)
def slug_title(spark, d):
    rows = (
        spread_table(spark, d, "pages")
        .select(F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("id"), "url")
        .union(table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.expr(PART_URL)))
    )
    return rows.select("id", urls.slug_title("url").alias("title"))
