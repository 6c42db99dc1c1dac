"""Text clean-up, keys and phrase lists as Column expressions.

Every function takes Columns (or column names) and returns a Column, so the work stays in
the JVM. ``lower`` stands for case folding. Patterns use ``(?U)`` where accented letters and
unusual blanks must count as word characters and white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Characters a title may hold and what they become.
ZERO_WIDTH_CHARS = "\u200b\u200c\u200d\ufeff"
DASH_CHARS = "\u2010\u2011\u2012\u2013\u2014\u2212\u00ad\u2043"
NO_BREAK_SPACE = "\u00a0"

# What marks noise in a document body.
SAFELINK_PATTERN = r"https://eur01\.safelinks\.protection\.outlook\.com/\?url=[^\s)\"']+"
ORIGINAL_URL_PATTERN = r"(?i)Original URL:[^\n]*Click or tap if you trust this link\."
DATA_IMAGE_PATTERN = r"data:image/[^;]+;base64,[A-Za-z0-9+/=]+"
DATA_IMAGE_TAG_PATTERN = r"(?i)<img[^>]*src=[\"']data:image/[^\"']*[\"'][^>]*>"
ENCODED_PATTERN = r"\b[A-Za-z0-9+/]{200,}={0,2}\b"
IMAGE_MARK = "[IMAGE_REMOVED]"
ENCODED_MARK = "[ENCODED_CONTENT_REMOVED]"

# Phrase edges, scenario titles, article keys.
PHRASE_EDGE_CHARS = " ,;:-"
SCENARIO_PATTERN = r"(?i)\bscenario\s*\d+"
SCENARIO_SUFFIX_PATTERN = r"(?i)\s*-\s*scenario\s*\d+\s*$"
FILE_KEY_PATTERN = r"(?i)^(KB-?\d+)[_\s]"
ACRONYM_PATTERN = r"\b[A-Z][A-Z0-9]{1,}\b"

# Words that carry no meaning in a support question.
FILLER_TERMS = [
    "a", "an", "the", "help", "issue", "issues", "problem", "problems", "support",
    "please", "need", "with", "for", "from", "that", "this", "my", "our", "their",
    "system", "computer", "device", "thing", "something",
]
GENERIC_STOPWORDS = FILLER_TERMS + [
    "user", "users", "team", "teams", "getting", "having", "facing", "unable",
]

# Categories and article types of the index.
INDEX_CATEGORIES = {"hardware": "Hardware", "software": "Software", "both": "Both"}
ARTICLE_TYPES = {
    "setup/installation": "Setup/Installation",
    "setup": "Setup/Installation",
    "installation": "Setup/Installation",
    "troubleshooting": "Troubleshooting",
    "policy/process": "Policy/Process",
    "policy": "Policy/Process",
    "process": "Policy/Process",
    "how-to": "How-To",
    "how to": "How-To",
    "reference": "Reference",
}


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Inside a lambda Spark does not share common subexpressions; binding keeps list
    functions from recomputing their input for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value: ColumnLike) -> Column:
    trimmed = F.trim(col(value))
    return F.when(trimmed != "", trimmed)


def collapse_spaces(value: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(col(value), r"(?U)\s+", " "))


def strip(value: ColumnLike) -> Column:
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+\z", "")


def normalize_title(title: ColumnLike) -> Column:
    mapped = F.translate(
        F.coalesce(col(title), F.lit("")),
        DASH_CHARS + NO_BREAK_SPACE + ZERO_WIDTH_CHARS,
        "-" * len(DASH_CHARS) + " ",
    )
    return collapse_spaces(mapped)


def strip_file_suffix(name: ColumnLike) -> Column:
    return F.regexp_replace(F.trim(col(name)), r"(?i)\.pdf\s*$", "")


def is_scenario_title(name: ColumnLike) -> Column:
    return normalize_title(strip_file_suffix(name)).rlike(SCENARIO_PATTERN)


def normalize_kb_number(value: ColumnLike) -> Column:
    compact = F.replace(F.upper(F.trim(col(value))), F.lit(" "), F.lit(""))
    digits = F.regexp_replace(F.substring(compact, F.lit(3), F.char_length(compact)), r"\D+", "")
    return F.when(F.startswith(compact, F.lit("KB")) & (digits != ""), F.concat(F.lit("KB"), digits))


def kb_number_from_name(name: ColumnLike) -> Column:
    found = F.regexp_extract(strip_file_suffix(name), FILE_KEY_PATTERN, 1)
    return F.when(found != "", normalize_kb_number(found))


def doc_key(number: ColumnLike, name: ColumnLike, source_id: ColumnLike) -> Column:
    return F.coalesce(
        normalize_kb_number(number),
        kb_number_from_name(name),
        F.concat(F.lit("SRC:"), col(source_id).cast("string")),
    )


def clean_content(body: ColumnLike, max_chars: int | None = None) -> Column:
    """Body without tracking links and encoded blobs, with tidy lines and paragraphs."""
    text = F.coalesce(col(body), F.lit(""))
    for pattern, mark in (
        (SAFELINK_PATTERN, ""),
        (ORIGINAL_URL_PATTERN, ""),
        (DATA_IMAGE_PATTERN, IMAGE_MARK),
        (DATA_IMAGE_TAG_PATTERN, IMAGE_MARK),
        (ENCODED_PATTERN, ENCODED_MARK),
    ):
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = strip(F.regexp_replace(text, r"[^\S\n]*\n[^\S\n]*", "\n"))
    return F.substring(text, 1, max_chars) if max_chars else text


def clean_phrase(value: ColumnLike) -> Column:
    collapsed = F.regexp_replace(F.coalesce(col(value), F.lit("")), r"(?U)\s+", " ")
    return F.btrim(collapsed, F.lit(PHRASE_EDGE_CHARS))


def looks_specific(term: ColumnLike) -> Column:
    """A digit, two capitals in a row, or several words with one of them capitalised."""
    value = col(term)
    return (
        value.rlike(r"\d|[A-Z]{2,}")
        | (value.rlike(r"(?U)\S\s+\S") & value.rlike(r"(?U)(^|\s)\p{Lu}"))
    )


def distinct_ignoring_case(items: ColumnLike) -> Column:
    """Ordered distinct of a list: first spelling kept, blanks dropped."""
    kept = F.filter(
        F.transform(F.coalesce(col(items), F.array().cast("array<string>")), lambda x: F.trim(x)),
        lambda x: x.isNotNull() & (x != ""),
    )
    return bind(
        bind(kept, lambda k: F.struct(k.alias("items"), F.transform(k, lambda x: F.lower(x)).alias("keys"))),
        lambda s: F.transform(
            F.array_distinct(s["keys"]),
            lambda key: F.get(s["items"], F.array_position(s["keys"], key).cast("int") - 1),
        ),
    )


def infer_acronyms(text: ColumnLike, limit: int = 8) -> Column:
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(ACRONYM_PATTERN), F.lit(0))
    return F.slice(distinct_ignoring_case(found), 1, limit)


def clean_phrase_list(items: ColumnLike, limit: int, lowercase: bool = False) -> Column:
    def tidy(x: Column) -> Column:
        phrase = clean_phrase(x)
        return F.lower(phrase) if lowercase else phrase

    cleaned = F.transform(F.coalesce(col(items), F.array().cast("array<string>")), tidy)
    return F.slice(distinct_ignoring_case(cleaned), 1, limit)


def query_category(value: ColumnLike) -> Column:
    norm = F.lower(F.trim(col(value)))
    return F.when(norm.isin("hardware", "software", "both"), norm).otherwise(F.lit("both"))


def _lookup(value: ColumnLike, table: dict[str, str], default: str) -> Column:
    norm = F.lower(F.trim(col(value)))
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, norm), F.lit(default))


def index_category(value: ColumnLike) -> Column:
    return _lookup(value, INDEX_CATEGORIES, "Software")


def article_type(value: ColumnLike) -> Column:
    return _lookup(value, ARTICLE_TYPES, "How-To")


def tokenize(text: ColumnLike) -> Column:
    """Lower-case ASCII words of two or more characters, in order."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(spaced), " "), lambda t: F.length(t) > 1)


def search_text(text: ColumnLike) -> Column:
    """Lower-case words of any script separated by one blank: the full-text form."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.trim(spaced)


def search_tokens(text: ColumnLike) -> Column:
    return F.filter(F.split(search_text(text), " "), lambda t: t != "")


def jaccard(left: ColumnLike, right: ColumnLike) -> Column:
    union = F.size(F.array_union(col(left), col(right)))
    shared = F.size(F.array_intersect(col(left), col(right)))
    return F.when(
        (F.size(col(left)) > 0) & (F.size(col(right)) > 0), shared.cast("double") / union
    ).otherwise(F.lit(0.0))


def canonical_key(topic: ColumnLike, title: ColumnLike, doc_id: ColumnLike) -> Column:
    """Family of an article: its topic, else its title without a scenario number, else its id."""
    topic_key = blank_to_null(F.lower(F.trim(col(topic))))
    title_key = blank_to_null(
        collapse_spaces(F.regexp_replace(F.lower(F.trim(col(title))), SCENARIO_SUFFIX_PATTERN, ""))
    )
    return F.coalesce(
        F.concat(F.lit("topic:"), topic_key),
        F.concat(F.lit("title:"), title_key),
        F.concat(F.lit("id:"), F.trim(col(doc_id).cast("string"))),
    )


def candidate_text(
    title: ColumnLike,
    summary: ColumnLike,
    triggers: ColumnLike,
    content: ColumnLike,
    acronyms: ColumnLike,
    entities: ColumnLike,
) -> Column:
    keywords = F.concat_ws(" ", blank_to_null(acronyms), blank_to_null(entities))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), blank_to_null(title)),
        F.concat(F.lit("Summary: "), blank_to_null(summary)),
        F.concat(F.lit("Triggers: "), blank_to_null(triggers)),
        F.concat(F.lit("Relevant content: "), blank_to_null(content)),
        F.when((keywords != "") & (F.length(keywords) < 200), F.concat(F.lit("Keywords: "), keywords)),
    )


def _joined(items: ColumnLike) -> Column:
    kept = F.array_join(F.filter(col(items), lambda x: F.trim(x) != ""), " ")
    return F.when(kept != "", kept)


def rerank_query_text(
    raw: ColumnLike,
    specific: ColumnLike,
    issues: ColumnLike,
    usecase: ColumnLike,
    search_phrases: ColumnLike,
    generic: ColumnLike,
    acronyms: ColumnLike,
    kind: ColumnLike,
) -> Column:
    return F.concat_ws(
        " ",
        col(raw),
        _joined(specific),
        _joined(issues),
        _joined(usecase),
        _joined(search_phrases),
        _joined(generic),
        _joined(acronyms),
        blank_to_null(kind),
    )


def normalize_name(value: ColumnLike) -> Column:
    return collapse_spaces(value)


def query_generic_terms(items: ColumnLike, limit: int = 10) -> Column:
    """Generic words of a question: stop phrases and stop words removed."""
    stop = F.array(*[F.lit(w) for w in GENERIC_STOPWORDS])

    def content_words(phrase: Column) -> Column:
        words = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: (w != "") & ~F.array_contains(stop, w))
        return F.array_join(words, " ")

    lowered = F.transform(col(items), lambda x: F.lower(x))
    return F.slice(distinct_ignoring_case(F.transform(lowered, content_words)), 1, limit)


def index_generic_terms(items: ColumnLike) -> Column:
    """Generic words of an article: odd characters removed, one-letter rests dropped."""
    tidy = F.transform(
        col(items),
        lambda x: F.regexp_replace(collapse_spaces(F.lower(x)), r"(?U)[^\w\s\-/]", ""),
    )
    return distinct_ignoring_case(F.filter(tidy, lambda x: F.length(x) >= 2))


def derive_search_phrases(
    raw: ColumnLike,
    specific: ColumnLike,
    generic: ColumnLike,
    issues: ColumnLike,
    usecases: ColumnLike,
    limit: int = 8,
) -> Column:
    text = F.coalesce(col(raw), F.lit(""))
    own = F.when(
        (text != "") & (F.length(strip(text)) <= 120), F.array(clean_phrase(text))
    ).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(
        F.transform(
            F.slice(col(specific), 1, 3),
            lambda s: F.transform(
                F.slice(col(generic), 1, 2), lambda g: clean_phrase(F.concat_ws(" ", s, g))
            ),
        )
    )
    parts = F.concat(own, F.slice(col(usecases), 1, 3), pairs, F.slice(col(issues), 1, 2))
    return F.slice(distinct_ignoring_case(parts), 1, limit)


def split_features(text: ColumnLike) -> Column:
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_list(items: ColumnLike) -> Column:
    return F.array_join(F.filter(col(items), lambda x: F.trim(x) != ""), ", ")


def short(text: ColumnLike, limit: int) -> Column:
    flat = F.trim(F.replace(F.coalesce(col(text), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("\u2026"))).otherwise(flat)


def four_decimals(value: ColumnLike, default: str = "") -> Column:
    number = col(value).try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%.4f", number)).otherwise(F.lit(default))


def strip_query_params(url: ColumnLike, names: list[str]) -> Column:
    """Remove the named query parameters of a url; the others keep their order."""
    value = col(url)
    fragment = F.regexp_extract(value, r"#.*$", 0)
    bare = F.regexp_replace(value, r"#.*$", "")
    base = F.regexp_replace(bare, r"\?.*$", "")
    dropped = [n.lower() for n in names]
    kept = F.filter(
        F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(dropped),
    )
    query = F.array_join(kept, "&")
    return F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), fragment)


def normalize_scheme(url: ColumnLike) -> Column:
    """The short scheme name becomes the full one."""
    return F.regexp_replace(col(url), r"^postgres://", "postgresql://")
