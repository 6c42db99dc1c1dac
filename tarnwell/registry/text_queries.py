"""Text functions over documents, conversations, pages and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import html as ht
from tarnwell.functions import phones as ph
from tarnwell.functions import text as tx
from tarnwell.functions.fuzzy import fuzzy_ratio
from tarnwell.operators.layout import format_image_description, sanitise_description
from tarnwell.plans.retrieval import best_snippets
from tarnwell.registry import query
from tarnwell.registry.inputs import SOURCE_SQL, source_documents, table

_DASHES = tx.DASH_CHARS + tx.NO_BREAK_SPACE + tx.ZERO_WIDTH_CHARS
_TITLE_SQL = f"trim(regexp_replace(translate({{x}}, '{_DASHES}', '{'-' * 8} '), '\\s+', ' ', 'g'))"
_NO_PDF_SQL = "regexp_replace(trim(name), '(?i)\\.pdf\\s*$', '')"


def title_sql(x: str) -> str:
    return _TITLE_SQL.format(x=x)


def phrase_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ,;:-')"


def dedupe_sql(arr: str) -> str:
    """Ordered distinct of a list ignoring case, blanks dropped."""
    kept = f"list_filter(list_transform({arr}, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')"
    return f"list_filter({kept}, lambda x, i: list_position(list_transform({kept}, lambda y: lower(y)), lower(x)) = i)"


@query("title_norm", f"WITH {SOURCE_SQL} SELECT doc_id, {title_sql('name')} AS title FROM source")
def title_norm(spark: SparkSession, sf: str) -> DataFrame:
    return source_documents(spark, sf).select("doc_id", tx.normalize_title("name").alias("title"))


@query(
    "scenario_skip",
    f"""WITH {SOURCE_SQL} SELECT doc_id, {title_sql(_NO_PDF_SQL)} AS title FROM source
    WHERE NOT regexp_matches({title_sql(_NO_PDF_SQL)}, '(?i)\\bscenario\\s*\\d+')""",
)
def scenario_skip(spark: SparkSession, sf: str) -> DataFrame:
    rows = source_documents(spark, sf).where(~tx.is_scenario_title("name"))
    return rows.select("doc_id", tx.normalize_title(tx.strip_file_suffix("name")).alias("title"))


_NUMBER_SQL = """CASE WHEN starts_with(replace(upper(trim({x})), ' ', ''), 'KB')
    AND regexp_replace(replace(upper(trim({x})), ' ', '')[3:], '\\D+', '', 'g') <> ''
    THEN 'KB' || regexp_replace(replace(upper(trim({x})), ' ', '')[3:], '\\D+', '', 'g') END"""


@query("kb_number", f"WITH {SOURCE_SQL} SELECT doc_id, {_NUMBER_SQL.format(x='number')} AS kb FROM source")
def kb_number(spark: SparkSession, sf: str) -> DataFrame:
    return source_documents(spark, sf).select("doc_id", tx.normalize_kb_number("number").alias("kb"))


_FROM_NAME = f"nullif(regexp_extract({_NO_PDF_SQL}, '(?i)^(KB-?\\d+)[_\\s]', 1), '')"
DOC_KEY_SQL = f"coalesce({_NUMBER_SQL.format(x='number')}, {_NUMBER_SQL.format(x=_FROM_NAME)}, 'SRC:' || id)"


@query("doc_key", f"WITH {SOURCE_SQL} SELECT doc_id, {DOC_KEY_SQL} AS doc_key FROM source")
def doc_key(spark: SparkSession, sf: str) -> DataFrame:
    return source_documents(spark, sf).select("doc_id", tx.doc_key("number", "name", "id").alias("doc_key"))


def clean_sql(x: str) -> str:
    t = x
    for pattern, mark in (
        (tx.SAFELINK_PATTERN, ""), (tx.ORIGINAL_URL_PATTERN, ""), (tx.DATA_IMAGE_PATTERN, tx.IMAGE_MARK),
        (tx.DATA_IMAGE_TAG_PATTERN, tx.IMAGE_MARK), (tx.ENCODED_PATTERN, tx.ENCODED_MARK),
        ("\\r\\n?", "\n"), ("\\n{3,}", "\n\n"), ("[ \\t]+", " "), ("[^\\S\\n]*\\n[^\\S\\n]*", "\n"), ("^\\s+|\\s+\\z", ""),
    ):
        quoted = pattern.replace("'", "''")
        t = f"regexp_replace({t}, '{quoted}', '{mark}', 'g')"
    return t


@query("clean_content", f"SELECT doc_id, md5(c) AS digest, length(c) AS n FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents)")
def clean_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tx.clean_content("text").alias("c"))
    return rows.select("doc_id", F.md5(F.col("c").cast("binary")).alias("digest"), F.length("c").cast("long").alias("n"))


@query(
    "clean_html_bodies",
    f"SELECT page_id, md5(c) AS digest FROM (SELECT page_id, {clean_sql('html')} AS c FROM pages)",
)
def clean_html_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(tx.clean_content("html").cast("binary")).alias("digest"))


@query(
    "clean_phrases",
    f"""SELECT doc_id, string_agg({phrase_sql('s')}, '|' ORDER BY i) AS phrases
    FROM (SELECT doc_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM documents) GROUP BY doc_id""",
)
def clean_phrases(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.transform(F.split("text", r"\."), lambda s: tx.clean_phrase(s))
    return table(spark, sf, "documents").select("doc_id", F.array_join(parts, "|").alias("phrases"))


@query(
    "looks_specific",
    """SELECT doc_id, count(*) FILTER (regexp_matches(s, '\\d|[A-Z]{2,}')
      OR (regexp_matches(s, '\\S\\s+\\S') AND regexp_matches(s, '(^|\\s)\\p{Lu}'))) AS specific, count(*) AS parts
    FROM (SELECT doc_id, trim(unnest(string_split(text, ','))) AS s FROM documents) GROUP BY doc_id""",
)
def looks_specific(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", ",")).alias("s"))
    return parts.groupBy("doc_id").agg(
        F.count_if(tx.looks_specific(F.trim("s"))).alias("specific"), F.count(F.lit(1)).alias("parts")
    )


# Accented letters count as letters at a word edge in Java, so the twin makes them plain ones.
_ACRONYMS_SQL = "regexp_extract_all(regexp_replace({x}, '[\\x{{C0}}-\\x{{24F}}]', 'a', 'g'), '\\b[A-Z][A-Z0-9]{{1,}}\\b')"


@query(
    "acronyms",
    f"SELECT doc_id, array_to_string({dedupe_sql(_ACRONYMS_SQL.format(x='text'))}[1:8], '|') AS acronyms FROM documents",
)
def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.infer_acronyms("text"), "|").alias("acronyms"))


_LABEL_SQL = """CASE p_size % 5 WHEN 0 THEN ' Hardware ' WHEN 1 THEN 'software' WHEN 2 THEN 'BOTH' WHEN 3 THEN NULL ELSE p_type END"""


def _label_column():
    return (
        F.when(F.col("p_size") % 5 == 0, " Hardware ").when(F.col("p_size") % 5 == 1, "software")
        .when(F.col("p_size") % 5 == 2, "BOTH").when(F.col("p_size") % 5 == 3, F.lit(None)).otherwise(F.col("p_type"))
    )


@query(
    "categories",
    f"""SELECT p_partkey, CASE WHEN lower(trim(c)) IN ('hardware', 'software', 'both') THEN lower(trim(c)) ELSE 'both' END AS asked,
      CASE lower(trim(c)) WHEN 'hardware' THEN 'Hardware' WHEN 'both' THEN 'Both' ELSE 'Software' END AS indexed
    FROM (SELECT p_partkey, {_LABEL_SQL} AS c FROM part)""",
)
def categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumn("c", _label_column())
    return rows.select("p_partkey", tx.query_category("c").alias("asked"), tx.index_category("c").alias("indexed"))


_TYPES_SQL = """CASE p_size % 7 WHEN 0 THEN 'Setup' WHEN 1 THEN ' troubleshooting' WHEN 2 THEN 'POLICY' WHEN 3 THEN 'how to'
    WHEN 4 THEN 'reference' WHEN 5 THEN 'Setup/Installation' ELSE p_brand END"""


@query(
    "article_types",
    f"""SELECT p_partkey, CASE WHEN t IN ('setup', 'installation', 'setup/installation') THEN 'Setup/Installation'
      WHEN t = 'troubleshooting' THEN 'Troubleshooting' WHEN t IN ('policy', 'process', 'policy/process') THEN 'Policy/Process'
      WHEN t = 'reference' THEN 'Reference' ELSE 'How-To' END AS article_type
    FROM (SELECT p_partkey, lower(trim({_TYPES_SQL})) AS t FROM part)""",
)
def article_types(spark: SparkSession, sf: str) -> DataFrame:
    names = ["Setup", " troubleshooting", "POLICY", "how to", "reference", "Setup/Installation"]
    t = F.col("p_brand")
    for i, name in reversed(list(enumerate(names))):
        t = F.when(F.col("p_size") % 7 == i, name).otherwise(t)
    return table(spark, sf, "part").select("p_partkey", tx.article_type(t).alias("article_type"))


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1)"


@query("tokens", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def _turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.select("conv_id", "turn", "text").join(nxt, ["conv_id", "turn"])


@query(
    "jaccard",
    f"""SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE
      / len(list_distinct(list_concat(a, b))) END, 6) AS overlap
    FROM (SELECT c.conv_id, c.turn, {tokens_sql('c.text')} AS a, {tokens_sql('n.text')} AS b
      FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)""",
)
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turn_pairs(spark, sf).withColumn("a", tx.tokenize("text")).withColumn("b", tx.tokenize("reply"))
    return rows.select("conv_id", "turn", F.round(tx.jaccard("a", "b"), 6).alias("overlap"))


@query("fuzzy_ratio")
def fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return _turn_pairs(spark, sf).select("conv_id", "turn", F.round(fuzzy_ratio("text", "reply"), 6).alias("similarity"))


@query("snippet")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text", F.substring_index("text", ".", 1).alias("asked"))
    return best_snippets(rows, "text", "asked").select("doc_id", "snippet")


@query(
    "canonical_key",
    f"""WITH {SOURCE_SQL} SELECT doc_id, coalesce('topic:' || nullif(trim(lower(topic)), ''),
      'title:' || nullif(trim(regexp_replace(regexp_replace(lower(trim(title)), '(?i)\\s*-\\s*scenario\\s*\\d+\\s*$', ''), '\\s+', ' ', 'g')), ''), 'id:' || id) AS family
    FROM (SELECT doc_id, id, CASE WHEN doc_id % 3 = 0 THEN ' ' || collection || ' ' END AS topic,
      CASE WHEN doc_id % 3 = 1 THEN {title_sql(_NO_PDF_SQL)} END AS title FROM source)""",
)
def canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = source_documents(spark, sf).select(
        "doc_id", "id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "knowledgebase_collection_id", F.lit(" "))).alias("topic"),
        F.when(F.col("doc_id") % 3 == 1, tx.normalize_title(tx.strip_file_suffix("name"))).alias("title"),
    )
    return rows.select("doc_id", tx.canonical_key("topic", "title", "id").alias("family"))


@query(
    "candidate_text",
    """SELECT doc_id, concat_ws(chr(10), 'Title: ' || nullif(trim(split_part(text, chr(10), 1)), ''), 'Summary: ' || nullif(trim(source), ''),
      'Triggers: ' || nullif(trim(lang), ''), 'Relevant content: ' || nullif(trim(text), ''),
      CASE WHEN length(k) < 200 AND k <> '' THEN 'Keywords: ' || k END) AS body
    FROM (SELECT *, concat_ws(' ', nullif(trim(source), ''), nullif(trim(split_part(text, '.', 1)), '')) AS k FROM documents)""",
)
def candidate_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    body = tx.candidate_text(
        F.substring_index("text", "\n", 1), "source", "lang", "text", "source", F.substring_index("text", ".", 1)
    )
    return d.select("doc_id", body.alias("body"))


@query(
    "rerank_query_text",
    """SELECT item_id, concat_ws(' ', text, nullif(array_to_string(list_filter(a, lambda x: trim(x) <> ''), ' '), ''), nullif(array_to_string(b, ' '), ''),
      nullif(array_to_string(list_filter(a, lambda x: trim(x) <> ''), ' '), ''), nullif(array_to_string(b, ' '), ''), nullif(trim(split_part(text, ' ', 1)), '')) AS asked
    FROM (SELECT item_id, text, string_split(text, ',') AS a, regexp_extract_all(text, '[A-Z]\\w+') AS b FROM benchmark)""",
)
def rerank_query_text(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select(
        "item_id", "text", F.split("text", ",").alias("a"), F.regexp_extract_all("text", F.lit(r"[A-Z]\w+"), F.lit(0)).alias("b"),
        F.array().cast("array<string>").alias("e"),
    )
    return b.select(
        "item_id", tx.rerank_query_text("text", "a", "b", "a", "e", "b", "e", F.substring_index("text", " ", 1)).alias("asked")
    )


@query("normalize_name", "SELECT p_partkey, trim(regexp_replace('  ' || p_name || '   ' || p_type || chr(9), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit("\t"))
    return table(spark, sf, "part").select("p_partkey", tx.normalize_name(raw).alias("name"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.GENERIC_STOPWORDS) + "]"


def query_generic_sql(arr: str) -> str:
    words = f"""list_transform({arr}, lambda p: array_to_string(list_filter(regexp_split_to_array(lower(p), '\\s+'),
      lambda w: w <> '' AND NOT list_contains({_STOP}, w)), ' '))"""
    return f"{dedupe_sql(words)}[1:10]"


@query(
    "query_generic_terms",
    f"SELECT conv_id, turn, array_to_string({query_generic_sql('a')}, '|') AS terms FROM (SELECT conv_id, turn, string_split(text, ',') AS a FROM conversations)",
)
def query_generic_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(tx.query_generic_terms(F.split("text", ",")), "|").alias("terms"))


def index_generic_sql(arr: str) -> str:
    tidy = f"list_transform({arr}, lambda p: regexp_replace(trim(regexp_replace(lower(p), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\-/]', '', 'g'))"
    return dedupe_sql(f"list_filter({tidy}, lambda p: length(p) >= 2)")


@query(
    "index_generic_terms",
    f"SELECT conv_id, turn, array_to_string({index_generic_sql('a')}, '|') AS terms FROM (SELECT conv_id, turn, string_split(text, ',') AS a FROM conversations)",
)
def index_generic_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(tx.index_generic_terms(F.split("text", ",")), "|").alias("terms"))


@query(
    "dedupe_terms",
    f"SELECT conv_id, turn, array_to_string({dedupe_sql('a')}, ' ') AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations)",
)
def dedupe_terms(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(tx.distinct_ignoring_case(F.split("text", " ")), " ").alias("words"))


def phrase_list_sql(arr: str, n: int, lower: bool = False) -> str:
    one = phrase_sql("p")
    one = f"lower({one})" if lower else one
    return f"{dedupe_sql(f'list_transform({arr}, lambda p: {one})')}[1:{n}]"


@query(
    "phrase_list",
    f"""SELECT conv_id, turn, array_to_string({phrase_list_sql('a', 8)}, '|') AS phrases, array_to_string({phrase_list_sql('a', 12, True)}, '|') AS lowered
    FROM (SELECT conv_id, turn, string_split(text, ',') AS a FROM conversations)""",
)
def phrase_list(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("text", ",")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(tx.clean_phrase_list(parts, 8), "|").alias("phrases"),
        F.array_join(tx.clean_phrase_list(parts, 12, lowercase=True), "|").alias("lowered"),
    )


def search_phrases_sql(raw: str, spec: str, gen: str, issues: str, use: str) -> str:
    joined = phrase_sql("(xs || ' ' || xg)")
    pairs = f"flatten(list_transform({spec}[1:3], lambda xs: list_transform({gen}[1:2], lambda xg: {joined})))"
    own = f"CASE WHEN {raw} <> '' AND length(trim({raw})) <= 120 THEN [{phrase_sql(raw)}] ELSE []::VARCHAR[] END"
    parts = f"list_concat(list_concat({own}, {use}[1:3]), list_concat({pairs}, {issues}[1:2]))"
    return f"{dedupe_sql(parts)}[1:8]"


@query(
    "search_phrases",
    f"""SELECT conv_id, turn, array_to_string({search_phrases_sql('text', 'spec', 'gen', 'iss', 'uses')}, '|') AS phrases
    FROM (SELECT conv_id, turn, text, regexp_extract_all(text, '[A-Z][a-z]+') AS spec, regexp_extract_all(text, '[a-z]{{6,}}') AS gen,
      string_split(text, ',') AS iss, string_split(text, '.') AS uses FROM conversations)""",
)
def search_phrases(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("s"),
        F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0)).alias("g"), F.split("text", ",").alias("i"), F.split("text", r"\.").alias("u"),
    )
    return c.select("conv_id", "turn", F.array_join(tx.derive_search_phrases("text", "s", "g", "i", "u"), "|").alias("phrases"))


@query("html_text")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return ht.html_to_text(table(spark, sf, "pages"), "page_id")


@query("image_refs")
def image_refs(spark: SparkSession, sf: str) -> DataFrame:
    picture = F.concat(F.lit('<img src="/pic'), F.col("page_id").cast("string"), F.lit('.jpg" alt="a"><img src="data:image/gif;base64,QUJD"><h1>'))
    pages = table(spark, sf, "pages").select("page_id", "url", F.replace("html", F.lit("<h1>"), picture).alias("html"))
    return ht.image_refs(pages, "page_id", base_url="url").withColumn("data", F.length("data"))


@query(
    "image_description",
    """SELECT event_id, CASE WHEN value < 1 OR event_type = 'error' THEN ''
      WHEN event_type = 'signup' THEN trim(props) WHEN event_type = 'click' THEN '[Action: ' || event_type || ']' || ' ' || t
      WHEN event_type = 'view' AND user_id % 2 = 0 THEN '[Result: ' || t || ']'
      WHEN event_type = 'view' THEN '[Dialog: ' || t || ' Options available: ' || event_type || ', ' || t || ']'
      ELSE '[Image: ' || t || ']' || ' (UI elements: ' || event_type || ', ' || t || ')' END AS told
    FROM (SELECT *, trim(translate(props, '[]`"\\', '()''''')) AS t FROM events)""",
)
def image_description(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", sanitise_description(F.col("props")))
    kind = F.col("event_type")
    told = format_image_description(
        F.col("t"), F.col("value") >= 1, kind == "error", F.when(kind == "view", "dialog_box").otherwise("photo"), kind == "click",
        kind == "signup", F.col("props"), kind, (kind == "view") & (F.col("user_id") % 2 == 0), F.array(kind, F.col("t")),
    )
    return e.select("event_id", told.alias("told"))


@query("slug", "SELECT c_custkey, 'agent-worker-' || trim(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment || '!'), '[^a-z0-9-]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM customer")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("c_name", F.lit(" / "), "c_mktsegment", F.lit("!"))
    return table(spark, sf, "customer").select("c_custkey", ph.worker_slug(name).alias("slug"))


_REF_SQL = """CASE p_size % 3 WHEN 0 THEN 'reg:5000/' || lower(p_type) || '@sha256:' || md5(p_name) WHEN 1 THEN 'reg:5000/' || lower(p_type) || ':' || p_size ELSE 'reg:5000/' || lower(p_type) END"""


@query(
    "image_tag",
    f"""SELECT p_partkey, CASE WHEN contains(r, '@') THEN regexp_extract(r, '@(.*)$', 1)
      WHEN contains(string_split(r, '/')[-1], ':') THEN string_split(r, ':')[-1] END AS tag FROM (SELECT p_partkey, {_REF_SQL} AS r FROM part)""",
)
def image_tag(spark: SparkSession, sf: str) -> DataFrame:
    base = F.concat(F.lit("reg:5000/"), F.lower("p_type"))
    ref = (
        F.when(F.col("p_size") % 3 == 0, F.concat(base, F.lit("@sha256:"), F.md5(F.col("p_name").cast("binary"))))
        .when(F.col("p_size") % 3 == 1, F.concat(base, F.lit(":"), F.col("p_size").cast("string"))).otherwise(base)
    )
    return table(spark, sf, "part").select("p_partkey", ph.image_tag(ref).alias("tag"))


_PHONE_SQL = """CASE o_orderstatus WHEN 'O' THEN '+1' || (2000000000 + o_orderkey) WHEN 'F' THEN '  44' || (700000000 + o_custkey) || ' ' ELSE 'tel:+49-' || o_custkey END"""


def _phone():
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("+1"), (F.lit(2000000000) + key).cast("string")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("  44"), (F.lit(700000000) + F.col("o_custkey")).cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.lit("tel:+49-"), cust))
    )


_DIGITS = "regexp_replace(trim(p), '^\\+', '')"


@query(
    "phones",
    f"""SELECT o_orderkey, regexp_matches(p, '^\\+[1-9]\\d{{1,14}}$') AS e164, regexp_matches({_DIGITS}, '^\\d+$') AS msisdn_ok,
      CASE WHEN regexp_matches({_DIGITS}, '^\\d+$') THEN '+' || {_DIGITS} END AS e164_form,
      CASE WHEN starts_with(trim(p), 'sip:') THEN trim(p) ELSE 'sip:' || trim(p) END AS uri,
      CASE WHEN regexp_matches(regexp_replace(trim(p), '^tel:', ''), '^\\+[1-9]\\d{{1,14}}$') THEN 'tel:' || regexp_replace(trim(p), '^tel:', '') END AS transfer,
      CASE WHEN regexp_matches(regexp_replace(trim(p), '^tel:', ''), '^\\+[1-9]\\d{{1,14}}$') THEN NULL ELSE 'number is not E.164' END AS reason
    FROM (SELECT o_orderkey, {_PHONE_SQL} AS p FROM orders)""",
)
def phones(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", _phone().alias("p"))
    return rows.select(
        "o_orderkey", ph.is_e164("p").alias("e164"), ph.is_msisdn("p").alias("msisdn_ok"), ph.to_e164("p").alias("e164_form"),
        ph.sip_uri("p").alias("uri"), ph.transfer_destination("p").alias("transfer"), ph.transfer_reject_reason("p").alias("reason"),
    )


_UUID_SQL = "CASE WHEN event_id % 2 = 0 THEN md5(CAST(event_id AS VARCHAR)) ELSE 'call-' || event_id END"


@query("uuid_check", f"SELECT event_id, regexp_matches(r, '(?i)^[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}}$') AS ok FROM (SELECT event_id, {_UUID_SQL} AS r FROM events)")
def uuid_check(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.when(F.col("event_id") % 2 == 0, F.md5(F.col("event_id").cast("string").cast("binary"))).otherwise(F.concat(F.lit("call-"), F.col("event_id").cast("string")))
    return table(spark, sf, "events").select("event_id", ph.is_uuid(ref).alias("ok"))


@query(
    "session_fields",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'sip' WHEN event_type = 'view' THEN 'chat' ELSE 'webrtc' END AS session_type,
      CASE WHEN event_type = 'click' THEN 'sip_' || user_id END AS participant_identity,
      CASE WHEN event_type = 'error' THEN '+1' || user_id ELSE nullif(split_part(room, '_', 2), '') END AS phone_number,
      CASE WHEN event_type = 'signup' THEN '+2' || user_id END AS transfer_phone_number,
      CASE WHEN event_type = 'purchase' THEN 'c' || event_id ELSE nullif(split_part(room, '_', 3), '') END AS call_id,
      split_part(room, '_', 2) AS room_phone, split_part(room, '_', 3) AS room_call
    FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'call' WHEN 1 THEN 'call_+' || user_id ELSE 'call_+' || user_id || '_' || event_id END AS room FROM events)""",
)
def session_fields(spark: SparkSession, sf: str) -> DataFrame:
    e, user, eid, kind = table(spark, sf, "events"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type")
    phone = F.concat(F.lit("call_+"), user)
    room = F.when(F.col("event_id") % 3 == 0, "call").when(F.col("event_id") % 3 == 1, phone).otherwise(F.concat(phone, F.lit("_"), eid))
    attributes = F.create_map(
        F.lit("channel"), F.when(kind == "view", "chat").otherwise(""),
        F.lit("sip.phoneNumber"), F.when(kind == "error", F.concat(F.lit("+1"), user)).otherwise(""),
        F.lit("transfer.phoneNumber"), F.when(kind == "signup", F.concat(F.lit("+2"), user)),
        F.lit("sip.callID"), F.when(kind == "purchase", F.concat(F.lit("c"), eid)),
    )
    rows = e.select(
        "event_id", room.alias("room"), attributes.alias("attributes"), F.when(kind == "click", "sip").alias("kind"),
        F.concat(F.lit("sip_"), user).alias("identity"),
    )
    return rows.select(
        "event_id", F.inline(F.array(ph.session_fields("room", "kind", "identity", "attributes"))), "room"
    ).select("*", ph.room_phone("room").alias("room_phone"), ph.room_call_id("room").alias("room_call")).drop("room")


@query(
    "agent_name",
    """SELECT c_custkey, CASE WHEN regexp_matches(n, '^[\\p{L}\\p{N}_-]+$') THEN n END AS name
    FROM (SELECT c_custkey, replace(lower(trim(' ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment || ' Agent' END || ' ')), ' ', '_') AS n FROM customer)""",
)
def agent_name(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" Agent")))
    return table(spark, sf, "customer").select("c_custkey", ph.normalize_agent_name(F.concat(F.lit(" "), raw, F.lit(" "))).alias("name"))


@query(
    "url_params",
    """SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '')
      || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END || regexp_extract(url, '#.*$') AS url
    FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND lower(split_part(p, '=', 1)) <> 'ref') AS k FROM pages)""",
)
def url_params(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.normalize_scheme(tx.strip_query_params("url", ["ref"])).alias("url"))


@query("features", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , ,' || p_type, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS features, nullif(trim(CASE WHEN p_size % 2 = 0 THEN ' ' ELSE p_brand END), '') AS brand FROM part")
def features(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", F.array_join(tx.split_features(F.concat("p_name", F.lit(" , ,"), "p_type")), "|").alias("features"),
        tx.blank_to_null(F.when(F.col("p_size") % 2 == 0, " ").otherwise(F.col("p_brand"))).alias("brand"),
    )


@query(
    "short_text",
    """SELECT doc_id, CASE WHEN length(t) > 56 THEN t[1:55] || chr(8230) ELSE t END AS brief, format('{:.4f}', n_chars / 8.0) AS size4
    FROM (SELECT doc_id, n_chars, trim(replace(text, chr(10), ' ')) AS t FROM documents)""",
)
def short_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", tx.short("text", 56).alias("brief"), tx.four_decimals(F.col("n_chars") / 8.0).alias("size4")
    )


@query("join_list", "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, ','), lambda x: trim(x) <> ''), ', ') AS joined FROM conversations")
def join_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.join_list(F.split("text", ",")).alias("joined"))


@query(
    "number_records",
    f"""SELECT o_orderkey, upper(CASE WHEN o_orderstatus = 'F' THEN 'gb' ELSE 'us' END) AS country,
      CASE WHEN regexp_matches({_DIGITS}, '^\\d+$') THEN {_DIGITS} END AS msisdn, 'VOICE|SMS' AS features, o_orderpriority AS number_type,
      CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cost, CASE WHEN regexp_matches({_DIGITS}, '^\\d+$') THEN '+' || {_DIGITS} END AS e164
    FROM (SELECT *, {_PHONE_SQL} AS p FROM orders)""",
)
def number_records(spark: SparkSession, sf: str) -> DataFrame:
    fin = F.col("o_orderstatus") == "F"
    rows = table(spark, sf, "orders").select(
        "o_orderkey", _phone().alias("p"), F.when(fin, "gb").otherwise("").alias("country"), F.when(fin, " ").otherwise(F.col("o_custkey").cast("string")).alias("cost"),
        "o_orderpriority",
    )
    record = ph.number_record("country", F.lit("us"), "p", F.lit("VOICE, SMS,"), F.lit(""), "o_orderpriority", "cost")
    return rows.select("o_orderkey", F.inline(F.array(record))).withColumn("features", F.array_join("features", "|"))
