"""SQL fragments for the DuckDB side of the checks, written independently of the DataFrame code.

The patterns here only cover the markup that occurs in the tables; odd markup is covered by unit tests.
"""

from __future__ import annotations

URL = (
    r"(?s)^(\w+)://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::(\d*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)
BLOCKS = "html|head|body|title|meta|article|nav|footer|p|h1|div|br|ul|li"


def with_ctes(*ctes: str, select: str) -> str:
    """WITH clause over the given CTE texts, each once, in order."""
    seen = list(dict.fromkeys(ctes))
    return "WITH RECURSIVE " + ",\n".join(seen) + "\n" + select


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{URL}', {group})"


def host(url: str) -> str:
    return f"nullif(lower({part(url, 2)}), '')"


def domain_of_host(h: str) -> str:
    return rf"nullif(regexp_extract({h}, '([^.]+\.[^.]+)$', 1), '')"


def default_scheme(url: str) -> str:
    return rf"CASE WHEN regexp_matches({url}, '^\w+://.+') THEN {url} ELSE 'http://' || {url} END"


def site_key(link: str) -> str:
    return f"regexp_replace({link}, '^https?://', '')"


def anchor_key(link: str) -> str:
    return rf"regexp_replace({site_key(link)}, '^www\.', '')"


# Canonical URLs of a relation raw_urls(url): one row per distinct url, query parameters unnested and folded again.
CANONICAL = rf"""
url_pieces AS (
  SELECT url, lower({part('url', 1)}) AS scheme, regexp_replace(lower({part('url', 2)}), '^www\.', '') AS host,
         {part('url', 3)} AS port, regexp_replace({part('url', 4)}, '/$', '') AS path, {part('url', 5)} AS query
  FROM (SELECT DISTINCT url FROM raw_urls)
),
url_params AS (
  SELECT url, url_decode(replace(split_part(pair, '=', 1), '+', ' ')) AS k, i,
         url_decode(replace(regexp_extract(pair, '^[^=]*=(.*)$', 1), '+', ' ')) AS v
  FROM (SELECT url, unnest(string_split(query, '&')) AS pair, generate_subscripts(string_split(query, '&'), 1) AS i
        FROM url_pieces WHERE query <> '')
  WHERE pair <> ''
),
url_queries AS (
  SELECT url, string_agg(url_encode(k) || '=' || url_encode(v), '&' ORDER BY k) AS query
  FROM (SELECT url, k, max_by(v, i) AS v FROM url_params GROUP BY url, k)
  WHERE NOT starts_with(k, 'utm_') AND NOT contains(k, 'session')
  GROUP BY url
),
canonical AS (
  SELECT p.url, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN
           scheme || '://' || host || CASE WHEN port IN ('', '80') THEN '' ELSE ':' || port END || path
           || coalesce('?' || q.query, '') END AS link
  FROM url_pieces p LEFT JOIN url_queries q ON p.url = q.url
)"""

PAGE_URLS = f"raw_urls AS (SELECT {default_scheme('url')} AS url FROM pages)"

# page_id, url, link, clean
PAGE_LINKS = rf"""
page_links AS (
  SELECT page_id, p.url, link,
         regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<![^>]*>', '', 'g') AS clean
  FROM pages p JOIN canonical c ON c.url = {default_scheme('p.url')}
  WHERE link IS NOT NULL
)"""


def entities(text: str) -> str:
    out = text
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"')):
        out = f"replace({out}, '{name}', '{char}')"
    return f"regexp_replace({out}, '&amp;?', '&', 'g')"


def spaces(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def visible(html: str) -> str:
    spaced = rf"regexp_replace({html}, '(?i)</?(?:{BLOCKS})\b[^>]*>', ' ', 'g')"
    return spaces(entities(f"regexp_replace({spaced}, '</?[a-zA-Z][^>]*>', '', 'g')"))


TITLE = spaces(entities("regexp_extract(clean, '(?is)<title>(.*?)</title>', 1)"))
TEXT = visible("clean")
KEYWORDS = (
    r"array_to_string(list_transform(regexp_extract_all(clean, "
    rf"'(?is)<b>(.*?)(?:</b>|</?(?:{BLOCKS.replace('|br', '')})\b|\z)', 1), lambda b: {visible('b')}), ' ') || ' '"
)
METADATA = (
    "array_to_string(list_transform(regexp_extract_all(clean, '(?i)<meta ([^>]*)>', 1), lambda m: ' ' || m), '')"
)

# page_id, link, pos, href, text of every anchor
ANCHORS = rf"""
anchors AS (
  SELECT page_id, link, pos, regexp_extract(tag, 'href="([^"]*)"', 1) AS href,
         {visible("regexp_replace(tag, '^<a [^>]*>', '')")} AS text
  FROM (SELECT page_id, link, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos
        FROM (SELECT page_id, link, regexp_extract_all(clean, '(?is)<a [^>]*>.*?</a>') AS tags FROM page_links))
)"""

# page_id, link, pos, resolved, text
RESOLVED = r"""
resolved AS (
  SELECT page_id, link, pos, CASE WHEN text = '' THEN 'empty' ELSE text END AS text,
         CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
              WHEN starts_with(href, '/') THEN regexp_extract(link, '^\w+://[^/?#]*') || href END AS resolved
  FROM anchors
)"""

# The targets of these pages are host-relative paths without query, so canonical form only drops a last slash.
TARGETS = r"""
targets AS (
  SELECT page_id, link, pos, text, resolved,
         CASE WHEN regexp_matches(resolved, '(?i)^https?://') THEN regexp_replace(resolved, '/$', '') END AS dst
  FROM resolved
)"""

_EVERY_ANCHOR = """
  SELECT page_id, link, dst, string_agg(text, ', ' ORDER BY pos) AS anchor_text, min(pos) AS pos
  FROM targets WHERE dst IS NOT NULL GROUP BY page_id, link, dst
  UNION ALL
  SELECT page_id, link, link, 'empty', 0 FROM page_links
  WHERE page_id NOT IN (SELECT page_id FROM targets WHERE dst IS NOT NULL)"""
PAGE_ANCHORS = f"""
page_anchors AS ({_EVERY_ANCHOR}
)"""

LINKS = f"""
links AS (
  SELECT src, dst, anchor_text, version FROM (
    SELECT {site_key('link')} AS src, {anchor_key('dst')} AS dst, anchor_text, page_id AS version,
           row_number() OVER (PARTITION BY {site_key('link')}, {anchor_key('dst')}
                              ORDER BY page_id DESC, pos DESC) AS rn
    FROM page_anchors) WHERE rn = 1
)"""

TO_PAGE_LINKS = (PAGE_URLS, CANONICAL, PAGE_LINKS)
TO_RESOLVED = (*TO_PAGE_LINKS, ANCHORS, RESOLVED, TARGETS)
TO_ANCHORS = (*TO_RESOLVED, PAGE_ANCHORS)

# page_id, id, link, domain, title, text, keywords, metadata
PAGE_SITES = f"""
page_sites AS (
  SELECT page_id, sha256({site_key('link')}) AS id, link, {host('link')} AS domain, {TITLE} AS title, {TEXT} AS text,
         {KEYWORDS} AS keywords, {METADATA} AS metadata
  FROM page_links
)"""
TO_PAGE_SITES = (*TO_PAGE_LINKS, PAGE_SITES)

# Language profiles and scores: lang, n, gram, cnt over the words of the labelled documents.
WORDS_PATTERN = r"[\p{L}]+"


def words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORDS_PATTERN}')"


def grams(source: str, keys: str, text: str) -> str:
    """SELECT of `keys`, gram and cnt over the 1- to 3-grams of the padded words of `text`."""
    return f"""
  SELECT {keys}, substring(w, i, n) AS gram, n, sum(c) AS cnt
  FROM (SELECT {keys}, ' ' || word || ' ' AS w, count(*) AS c
        FROM (SELECT {keys}, unnest({words(text)}) AS word FROM {source}) GROUP BY ALL) AS ws,
       (VALUES (1), (2), (3)) AS sizes(n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) AS starts
  WHERE substring(w, i, n) <> ' '
  GROUP BY ALL"""


PROFILES = f"""
profiles AS ({grams('(SELECT lang, text FROM documents)', 'lang', 'text')}
),
profile_totals AS (SELECT lang, n, sum(cnt) AS total FROM profiles GROUP BY lang, n),
profile_sizes AS (SELECT n, count(DISTINCT gram) AS vocabulary FROM profiles GROUP BY n)"""


def detection(name: str, source: str, key: str) -> str:
    """CTE `name(key, language)`: best language of the texts of `source(key, text)`; 'error' without letters."""
    return f"""
{name}_grams AS ({grams(source, key, 'text')}
),
{name}_scores AS (
  SELECT g.{key}, t.lang, sum(g.cnt * (ln(coalesce(p.cnt, 0) + 1) - ln(t.total + s.vocabulary))) AS score,
         sum(g.cnt) AS n_grams
  FROM {name}_grams g JOIN profile_totals t ON t.n = g.n JOIN profile_sizes s ON s.n = g.n
  LEFT JOIN profiles p ON p.lang = t.lang AND p.gram = g.gram
  GROUP BY g.{key}, t.lang
),
{name} AS (
  SELECT d.{key}, coalesce(b.language, 'error') AS language
  FROM (SELECT {key} FROM {source}) d LEFT JOIN (
    SELECT {key}, lang AS language FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round(score / n_grams, 9) DESC, lang) AS rn
      FROM {name}_scores) WHERE rn = 1) b ON b.{key} = d.{key}
)"""


PAGE_LANGUAGE = detection("page_language", "page_sites", "page_id")

# Latest document per (language, id).
SITES = """
sites AS (
  SELECT language, id, link, domain, title, text, keywords, metadata, page_id AS version FROM (
    SELECT s.*, l.language, row_number() OVER (PARTITION BY l.language, s.id ORDER BY s.page_id DESC) AS rn
    FROM page_sites s JOIN page_language l ON l.page_id = s.page_id) WHERE rn = 1
)"""
TO_SITES = (*TO_PAGE_SITES, PROFILES, PAGE_LANGUAGE, SITES)
ACCEPTED = "('en', 'fa', 'ar', 'ru', 'es')"


def anchors_of(languages: str) -> str:
    """page_anchors of the pages in the given languages."""
    return f"""
page_anchors AS (
  SELECT a.* FROM ({_EVERY_ANCHOR}) a JOIN page_language l ON l.page_id = a.page_id WHERE language IN {languages}
)"""


# Only pages of accepted languages contribute links, and only English ones reach the link table.
_TO_SPOKEN = (*TO_RESOLVED, PAGE_SITES, PROFILES, PAGE_LANGUAGE)
TO_ACCEPTED_ANCHORS = (*_TO_SPOKEN, anchors_of(ACCEPTED))
TO_LINKS = (*_TO_SPOKEN, anchors_of("('en')"), LINKS)
