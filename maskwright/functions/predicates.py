"""Predicates that pick out the texts of requests that a person wrote, and where they may come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of JSON fields that hold a person's text, or that stand above such fields.
CONTENT_KEYS = ["text", "content", "input", "prompt", "message", "msg", "body", "value"]
CONTENT_PARENTS = ["messages", "contents", "parts", "prompts", "completion"]
MIN_BODY, LAST_CANDIDATES = 8, 4
# What a person's text is not, file names' endings, and kinds of content that are text.
BARE_ID, BARE_HEX = r"^[A-Za-z0-9_\-./:]+$", r"(?i)^[0-9a-f-]{8,}$"
DOCUMENT_ENDINGS = "docx|pptx|xlsx|pdf"
TEXT_ENDINGS = (
    "txt|text|csv|tsv|md|markdown|json|jsonl|ndjson|log|xml|htm|html|rtf|tex|srt|vtt|sql|yml|yaml|toml|ini|cfg|conf|sh|bash|ps1|"
    "py|js|ts|jsx|tsx|c|h|cpp|cc|java|rb|go|rs|php|css|scss"
)
TEXT_KINDS = r"^(text/|application/(json|x-ndjson|xml|csv|x-yaml|yaml|sql|toml))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def looks_like_prose(text: Column | str) -> Column:
    """12 characters or more, white space among them, and neither an identifier nor hexadecimal."""
    text = _col(text)
    return (F.length(text) >= 12) & text.rlike(r"(?U)\s") & ~text.rlike(BARE_ID) & ~text.rlike(BARE_HEX)


def is_content_path(path: Column | str) -> Column:
    """Whether a path of field names ends in a name for texts, or any of it is a name that stands above them."""
    low = F.transform(_col(path), lambda p: F.lower(p))
    last = F.coalesce(F.array_contains(F.array(*map(F.lit, CONTENT_KEYS)), F.element_at(low, -1)), F.lit(False))
    return (F.size(low) > 0) & (last | F.arrays_overlap(low, F.array(*map(F.lit, CONTENT_PARENTS))))


def last_candidates(items: Column | str, most: int = LAST_CANDIDATES) -> Column:
    items = _col(items)
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), F.lit(most))


def is_blank(text: Column | str) -> Column:
    """Nothing but Unicode white space."""
    return _col(text).rlike(r"(?U)^\s*$")


def worth_reading(body: Column | str) -> Column:
    """Whether a request's body is long enough to hold a person's text."""
    return F.coalesce(F.length(_col(body)) >= MIN_BODY, F.lit(False))


def upload_kind(name: Column | str, mime: Column | str | None = None) -> Column:
    """document, text or other: by a file name's ending, else by the kind of its content."""
    name = F.lower(F.coalesce(_col(name), F.lit("")))
    kind = F.lower(F.coalesce(_col(mime), F.lit(""))) if mime is not None else F.lit("")
    text = name.rlike(rf"\.({TEXT_ENDINGS})$") | kind.rlike(TEXT_KINDS)
    return F.when(name.rlike(rf"\.({DOCUMENT_ENDINGS})$"), "document").when(text, "text").otherwise("other")


def url_route(url: Column | str, routes: list[tuple[str, str, str]], method: Column | str) -> Column:
    """The name of the first route, (name, method, pattern of host and path), that a request takes."""
    url, method = _col(url), F.upper(_col(method))
    target = F.concat(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce(*[F.when((method == m) & target.rlike(p), F.lit(n)) for n, m, p in routes], F.lit(None).cast("string"))


def origin_allowed(origin: Column | str, prefixes: list[str], exact: list[str]) -> Column:
    origin = _col(origin)
    out = origin.isin(exact) if exact else F.lit(False)
    for p in prefixes:
        out = out | F.startswith(origin, F.lit(p))
    return F.coalesce(out, F.lit(False))


def extension_id(value: Column | str) -> Column:
    """32 letters from a to p."""
    return _col(value).rlike("^[a-p]{32}$")


def query_param(url: Column | str, name: str) -> Column:
    return F.try_url_decode(F.try_parse_url(_col(url), F.lit("QUERY"), F.lit(name)))


def with_query_param(url: Column | str, name: str, value: Column | str) -> Column:
    """The URL with that parameter's value replaced; unchanged without it."""
    put = F.concat(F.lit("$1"), F.replace(F.url_encode(_col(value)), F.lit("$"), F.lit("\\$")))
    return F.regexp_replace(_col(url), F.lit(rf"([?&]{name}=)[^&#]*"), put)
