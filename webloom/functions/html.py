"""Text, title, keywords, metadata and anchors of an HTML page as column expressions.

The input of every function but `clean_html` is HTML that went through `clean_html`. Quantifiers over tag attributes are
possessive, the others are lazy up to a fixed terminator.

Where the markup is broken the rules are: an unclosed <b> ends at the next block tag, an unclosed <a> at the next <a>,
an unclosed heading at the next heading, and a tag that is not closed before the next "<" is not a tag. Every match thus
ends where the next one can begin, and no page makes a pattern scan the same text again and again.
"""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.arrays import let

# Tags that separate words in the visible text.
BLOCK_TAGS = (
    "html|head|body|title|meta|link|noscript|article|section|nav|aside|header|footer|main|hgroup|address|"
    "p|h1|h2|h3|h4|h5|h6|div|blockquote|pre|hr|br|ul|ol|li|dl|dt|dd|menu|figure|figcaption|details|summary|dialog|"
    "form|fieldset|legend|table|caption|colgroup|col|thead|tbody|tfoot|tr|td|th|"
    "video|audio|canvas|svg|math|template|center|frame|frameset|ins|del|plaintext"
)
BREAKING_BLOCK_TAGS = BLOCK_TAGS.replace("hr|br|", "hr|")

ATTRS = r"""[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+"""
# The alternatives share their first character, so that all others are passed over by one comparison.
NOT_VISIBLE = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|[!?][^<>]*>)"
)
BLOCK_TAG = rf"(?i)</?(?:{BLOCK_TAGS})\b{ATTRS}>"
ANY_TAG = rf"</?[a-zA-Z]{ATTRS}>"
TITLE = r"(?is)<title\b[^<>]*>(.*?)(?:</title\s*>|\z)"
META = rf"(?i)<meta\b({ATTRS})>"
BASE = rf"(?i)<base\b({ATTRS})>"
ANCHOR = rf"(?is)<a\s{ATTRS}>.*?(?=</a\s*>|<a\s|\z)"
ANCHOR_TAG = rf"(?i)^<a({ATTRS})>"
HEADING = rf"<h[123]\b{ATTRS}>.*?(?=</?h[1-6]\b|\z)"
BOLD = rf"<b(?:\s{ATTRS})?>.*?(?=</b\s*>|</?(?:{BREAKING_BLOCK_TAGS})\b|\z)"
VOID_TAGS = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
CHILD = rf"(?is)<(?!(?:{VOID_TAGS})\b)(\w+)\b{ATTRS}>.*?(?:</\1\s*>|\z)"
ATTR = r"""[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?"""
# Runs of white space that are not one blank already.
SPACE = r"[\t\n\f\r\x{A0}][ \t\n\f\r\x{A0}]*+| [ \t\n\f\r\x{A0}]++"
ENTITY = "&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)"
STRICT_ENTITY = "&(?:#[0-9]++;|#[xX][0-9a-fA-F]++;|[A-Za-z][A-Za-z0-9]*+;)"


def _entity_table(names: Iterable[str]) -> Column:
    """Map from names to code points in decimal, two of them joined by a blank where a name stands for two."""
    pairs = ",".join(f"{name}={' '.join(str(ord(c)) for c in html5[name])}" for name in names)
    return F.expr(f"str_to_map('{pairs}', ',', '=')")


def _common_names() -> list[str]:
    """Names that pages use: those of HTML 4, with a semicolon, and those that need none."""
    return [f"{n};" for n in name2codepoint if f"{n};" in html5] + [n for n in html5 if not n.endswith(";")]


def _character(code: Column) -> Column:
    """The character of a code point, NULL if there is none."""

    def valid(c: Column) -> Column:
        known = (c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32"))

    return let(code, valid)


def _decoded_entity(entity: Column) -> Column:
    """The characters for one reference, or the reference itself if it is unknown or out of range."""
    digits = F.regexp_extract(entity, "#[xX]?0*+([0-9a-fA-F]*)", 1)
    hexadecimal = F.lower(entity).startswith("&#x")
    # Longer numbers than these are beyond the last code point; leading zeros are gone.
    number = F.when(hexadecimal & (F.length(digits) <= 6), F.conv(digits, 16, 10)).when(
        ~hexadecimal & (F.length(digits) <= 7), digits
    )
    name = F.substring(entity, F.lit(2), F.length(entity))
    rest = sorted(set(html5) - set(_common_names()))
    points = F.coalesce(
        F.try_element_at(_entity_table(_common_names()), name), F.try_element_at(_entity_table(rest), name)
    )
    named = F.array_join(F.transform(F.split(points, " "), lambda p: _character(p.cast("int"))), "")
    return F.coalesce(F.when(F.startswith(entity, F.lit("&#")), _character(number.try_cast("int"))).otherwise(named), entity)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Replace character references in one pass, so that '&amp;lt;' becomes '&lt;'. `text` is evaluated once."""
    pattern = F.lit(STRICT_ENTITY if attribute else ENTITY)

    def decoded(t: Column) -> Column:
        joined = F.array_join(
            F.zip_with(
                F.split(t, pattern, -1),
                F.transform(F.regexp_extract_all(t, pattern, F.lit(0)), _decoded_entity),
                lambda plain, char: F.concat(plain, F.coalesce(char, F.lit(""))),
            ),
            "",
        )
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, decoded)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_html(html: Column) -> Column:
    """Drop comments, scripts, styles and declarations, in document order."""
    return F.regexp_replace(html, NOT_VISIBLE, "")


def visible_text(fragment: Column) -> Column:
    spaced = F.regexp_replace(fragment, BLOCK_TAG, " ")
    return collapse_space(decode_entities(F.regexp_replace(spaced, ANY_TAG, "")))


def title(clean: Column) -> Column:
    return collapse_space(decode_entities(F.regexp_extract(clean, TITLE, 1)))


def attributes(attrs: Column) -> Column:
    """array<struct(name, value, bare)> of the attribute part of a tag."""
    return F.transform(
        F.regexp_extract_all(attrs, F.lit(ATTR), F.lit(0)),
        lambda token: let(
            F.regexp_extract(token, r"(?s)=\s*(.*)$", 1),
            lambda v: F.struct(
                F.lower(F.regexp_extract(token, r"^([^\s=]+)", 1)).alias("name"),
                decode_entities(
                    F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v), attribute=True
                ).alias("value"),
                (~F.contains(token, F.lit("="))).alias("bare"),
            ),
        ),
    )


def attribute(parsed: Column, name: str) -> Column:
    """Value of the first attribute called `name`, NULL if it is absent."""
    return F.get(F.filter(parsed, lambda a: a["name"] == name), F.lit(0))["value"]


def metas(clean: Column) -> Column:
    """Parsed attributes of every <meta> tag in document order."""
    return F.transform(F.regexp_extract_all(clean, F.lit(META), F.lit(1)), attributes)


def metadata(meta_attributes: Column) -> Column:
    """Attribute text of all metas, concatenated: ` name="value"` each."""

    def printed(a: Column) -> Column:
        value = F.replace(F.replace(a["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        return F.concat(
            F.lit(" "), a["name"], F.when(a["bare"], F.lit("")).otherwise(F.concat(F.lit('="'), value, F.lit('"')))
        )

    return F.array_join(F.transform(F.flatten(meta_attributes), printed), "")


def keywords(clean: Column, meta_attributes: Column) -> Column:
    """Text of heading children and bold runs, then the contents of description and keyword metas."""

    def heading_children(fragment: Column) -> Column:
        inner = F.regexp_replace(fragment, rf"(?i)^<h[123]\b{ATTRS}>", "")
        children = F.regexp_extract_all(inner, F.lit(CHILD), F.lit(0))
        return F.flatten(
            F.transform(
                children,
                lambda c: F.concat(
                    F.array(visible_text(c)),
                    F.transform(
                        F.regexp_extract_all(F.regexp_replace(c, rf"^<{ATTRS}>", ""), F.lit(f"(?is){BOLD}"), F.lit(0)),
                        visible_text,
                    ),
                ),
            )
        )

    marked = F.regexp_extract_all(clean, F.lit(f"(?is){HEADING}|{BOLD}"), F.lit(0))
    texts = F.flatten(
        F.transform(
            marked,
            lambda m: F.when(m.rlike("(?i)^<h"), heading_children(m)).otherwise(F.array(visible_text(m))),
        )
    )
    contents = F.transform(
        F.filter(
            meta_attributes,
            lambda m: let(
                F.coalesce(attribute(m, "name"), F.lit("")),
                lambda n: F.contains(n, F.lit("description")) | F.contains(n, F.lit("keyword")),
            ),
        ),
        lambda m: F.concat(F.coalesce(attribute(m, "content"), F.lit("")), F.lit(" ")),
    )
    return F.concat(F.array_join(texts, " "), F.lit(" "), F.array_join(contents, ""))


def base_href(clean: Column) -> Column:
    """href of the first <base> tag, NULL if there is none."""
    return attribute(attributes(F.regexp_extract(clean, BASE, 1)), "href")


def raw_anchors(clean: Column) -> Column:
    """array<struct(pos, href, text)> of every <a href>, in document order, href as written."""
    found = F.transform(
        F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(0)),
        lambda a, i: F.struct(
            i.alias("pos"),
            attribute(attributes(F.regexp_extract(a, ANCHOR_TAG, 1)), "href").alias("href"),
            visible_text(F.regexp_replace(a, ANCHOR_TAG, "")).alias("text"),
        ),
    )
    return F.filter(found, lambda a: a["href"].isNotNull())
