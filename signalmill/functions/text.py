"""Text functions as Column expressions; a pandas UDF only where the JVM has no counterpart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: White space as Unicode text has it, not ASCII only.
SPACE = "(?U)[\\s\\x1c-\\x1f]"
MIN_CHARS = 40


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-case text with white space collapsed."""
    return F.sha2(collapsed(F.lower(text)), 256)


def short_hash(text: Column) -> Column:
    """The first 20 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(20))


def too_short(text: Column, least: int = MIN_CHARS) -> Column:
    return F.length(collapsed(F.coalesce(text, F.lit("")))) < least


def link_only(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*https?://\S+\s*$")


def blank_to_null(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def strip_markup(text: Column) -> Column:
    """A title without heading and emphasis marks."""
    bare = F.regexp_replace(F.trim(text), r"^#+\s*", "")
    return collapsed(F.replace(F.replace(bare, F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))


def normalize_title(title: Column) -> Column:
    """The key under which a story's title is deduplicated: no trailing bracket, letters and digits only."""
    bare = F.regexp_replace(strip_markup(title), r"\([^)]*\)\s*$", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def sanitize_links(body: Column) -> Column:
    """Markdown links as their text, bare URLs gone."""
    linked = F.regexp_replace(body, r"(?s)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^)]*\)", "$1")
    return F.regexp_replace(linked, r"https?://\S+", "")


# Wording after which the rest of a mail is behind a paywall.
PAYWALL = r"(?i)^(#+\s*)?(subscribe to .{1,80} to unlock the rest|continue reading this post for free in the substack app)"


def free_lines(body: Column) -> Column:
    """The lines before the first paywall mark."""
    lines = F.split(body, "\n")
    first = F.array_position(F.transform(lines, lambda ln: F.trim(ln).rlike(PAYWALL)), True)
    return F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)


def content_lines(lines: Column) -> Column:
    """Trimmed lines that hold a letter or digit."""
    return F.filter(F.transform(lines, lambda ln: F.trim(ln)), lambda ln: ln.rlike(r"(?U)[^\W_]"))


@pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Entities decoded as HTML 5 has them, those without semicolon too."""
    import html

    return text.map(html.unescape, na_action="ignore")


@pandas_udf(StringType())
def unescape_closed(text: pd.Series) -> pd.Series:
    """Entities that end in a semicolon decoded; an ampersand without one stays as it is."""
    import html
    import re
    from html.entities import html5

    closed = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|([A-Za-z][A-Za-z0-9]*));")
    decoded = lambda m: html5.get(m[1] + ";", m[0]) if m[1] else html.unescape(m[0])
    return text.map(lambda t: closed.sub(decoded, t), na_action="ignore")


# Entities that the builtin variant decodes; the ampersand comes last so that nothing is decoded twice.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def without_tags(html: Column) -> Column:
    """Attribute-less block tags as line feeds, other tags gone."""
    broken = F.regexp_replace(html, r"(?i)<\s*/?\s*(p|br|div|li|blockquote)\s*/?>", "\n")
    return F.regexp_replace(broken, "<[^>]+>", "")


def _finish(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def clean_html(html: Column, closed_only: bool = False) -> Column:
    """Plain text of an HTML fragment; with ``closed_only`` entities without a semicolon stay as they are."""
    return _finish((unescape_closed if closed_only else unescape)(without_tags(html)))


def clean_html_builtin(html: Column) -> Column:
    """The same for fragments that use common entities only; stays in the JVM."""
    text = without_tags(html)
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return _finish(text)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\x00", "")


def strip_nul_deep(value: Column, dtype) -> Column:
    """NUL characters gone from every string of a nested value."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructType

    if isinstance(dtype, StringType):
        return strip_nul(value)
    if isinstance(dtype, ArrayType):
        return F.transform(value, lambda x: strip_nul_deep(x, dtype.elementType))
    if isinstance(dtype, StructType):
        return F.when(value.isNotNull(), F.struct(*[strip_nul_deep(value[f.name], f.dataType).alias(f.name) for f in dtype]))
    if isinstance(dtype, MapType):
        return F.transform_values(value, lambda k, v: strip_nul_deep(v, dtype.valueType))
    return value


def publication_name(sender: Column, fallback: Column) -> Column:
    """The display name of an address header, else the part before the at sign, else ``fallback``."""
    name = F.trim(F.regexp_replace(F.regexp_extract(sender, r"^\s*(.*?)\s*<[^>]*>\s*$", 1), '^"(.*)"$', "$1"))
    local = F.regexp_extract(sender, r"<?([^<@>\s]+)@", 1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(local, F.lit("")), fallback)


def thread_key(thread_id: Column, item_id: Column, source: Column | None = None) -> Column:
    """The thread, or the item itself where there is none; with ``source``, threads of two sources are kept apart."""
    key = F.coalesce(F.nullif(thread_id, F.lit("")), F.concat(F.lit("_item:"), item_id.cast("string")))
    return key if source is None else F.concat(source, F.lit("/"), key)


def split_db_url(url: Column) -> Column:
    """user, password, host, port, database and project of a connection URL: last at sign, first colon, nothing decoded."""
    rest = F.regexp_replace(url, "^[a-z]+://", "")
    login, place = F.regexp_extract(rest, "^(.*)@", 1), F.regexp_extract(rest, "([^@]*)$", 1)
    host = F.regexp_extract(place, "^([^:/]*)", 1)
    return F.struct(
        F.regexp_extract(login, "^([^:]*)", 1).alias("user"), F.regexp_extract(login, "^[^:]*:(.*)$", 1).alias("password"), host.alias("host"),
        F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(place, ":([0-9]+)", 1), F.lit("")), F.lit("99999")).cast("int"), F.lit(5432)).alias("port"),
        F.regexp_extract(place, "/([^?]*)", 1).alias("database"), F.regexp_extract(host, r"^(?:db\.)?([^.]+)\.", 1).alias("project"),
    )
