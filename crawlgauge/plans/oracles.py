"""DuckDB SQL that computes each registered query on the same tables, written independently of the Spark code.

Only for checking results. Look-around and back-references do not exist in DuckDB's regex engine, so those operators
are phrased differently here.
"""

from __future__ import annotations

from ..functions import text as T
from ..sources import dimensions as dim
from . import derived as D

# --- building blocks -------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+"
FETCHED = "CAST(DATE '2024-01-01' + CAST(page_id % 400 AS INT) AS TIMESTAMP)"


def sql(body: str, **ctes: str) -> str:
    """WITH name AS (...), ... body"""
    parts = ",\n".join(f"{name} AS ({text})" for name, text in ctes.items())
    return f"WITH {parts}\n{body}" if parts else body


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


def attr(tag: str, name: str) -> str:
    return rf"""regexp_extract_all({tag}, '(?i)(?:^|[^\w:-]){name}\s*=\s*"([^"]*)"', 1)[-1]"""


def has_attr(tag: str, name: str) -> str:
    return f"({attr(tag, name)} IS NOT NULL)"


def without(x: str, tags) -> str:
    for t in tags:
        x = rf"regexp_replace({x}, '(?is)<{t}\b.*?</{t}>', '', 'g')"
    return x


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group})"


def n_of(x: str, pattern: str) -> str:
    return f"len({every(x, pattern)})"


def paras(body: str) -> str:
    return rf"list_transform({every(body, r'(?is)<p\b[^>]*>(.*?)</p>', 1)}, lambda x: {strip('x')})"


def heads(body: str, level: int) -> str:
    return rf"list_transform({every(body, rf'(?is)<h{level}\b[^>]*>(.*?)</h{level}>', 1)}, lambda x: {strip('x')})"


def ext(src: str) -> str:
    return f"split_part(string_split(lower({src}), '.')[-1], '?', 1)"


def contains_any(x: str, needles) -> str:
    return "(" + " OR ".join("contains(" + x + ", '" + n.replace("'", "''") + "')" for n in needles) + ")"


def mean(*parts: str) -> str:
    """Mean of the parts that are not NULL."""
    total = " + ".join(f"coalesce(CAST({p} AS DOUBLE), 0)" for p in parts)
    n = " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END" for p in parts)
    return f"(({total}) / nullif({n}, 0))"


def whole(x: str) -> str:
    return f"CAST(coalesce(floor({x}), 0) AS BIGINT)"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} / {b} * 100 END"


PG = f"SELECT {D.SITE} AS site, page_id, url, {D.PATH} AS path, {D.HTML} AS html, {FETCHED} AS fetched_at FROM pages"
SITES = f"SELECT {D.SITE} AS site, min(page_id) AS k FROM pages GROUP BY 1"
RES = " UNION ALL ".join(
    f"SELECT site, '{path}' AS path, {text} AS content FROM sites WHERE {test}" for path, test, text in D.RESOURCE_RULES
)
HDR = " UNION ALL ".join(
    f"SELECT site, '{n}' AS name, '{v}' AS value, {i} AS o FROM sites WHERE {t}" for i, (n, v, t) in enumerate(D.HEADER_RULES)
)
ASSETS = (
    f"SELECT {D.SITE} AS site, concat('i/', CAST(page_id AS STRING), '.webp') AS path, {D.OWN_IMAGE_BYTES} AS bytes "
    "FROM pages WHERE page_id % 4 = 1 UNION ALL "
    + " UNION ALL ".join(f"SELECT site, {p}, {b} FROM sites" for p, b in D.SHARED_ASSETS)
)
CSS = " UNION ALL ".join(f"SELECT site, 'css/s{i}.css' AS path, {D.css_text(i)} AS content FROM sites" for i in range(1, D.N_CSS + 1))
PSI = f"""SELECT concat(url, '#', CAST(page_id AS STRING)) AS url,
 CASE WHEN page_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS strategy, CAST({D.PSI_BODY} AS JSON) AS v FROM pages"""
PROBES = f"""SELECT a.conv_id, a.turn, concat('provider-', CAST(a.conv_id % 4 AS STRING)) AS provider, q.text AS query,
 CASE WHEN a.conv_id % 11 = 0 THEN '' ELSE {D.ANSWER} END AS response_text,
 CASE WHEN a.conv_id % 11 = 0 THEN 'HTTP 500' ELSE '' END AS error
 FROM conversations a LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
 WHERE a.role = 'assistant'"""
LAYERS = f"SELECT concat('site-', CAST(user_id AS STRING)) AS site, {D.LAYER} AS layer, ts AS run_ts, event_id AS tie, value AS score FROM events"
HISTORY = """SELECT concat('site-', CAST(user_id AS STRING)) AS site, date_trunc('day', ts) AS run_ts, event_type AS check_id,
 CASE WHEN min(value) < 4 THEN 'fail' ELSE 'ok' END AS status FROM events GROUP BY ALL"""
TYPES = "SELECT concat('site-', CAST(user_id AS STRING)) AS site, CAST(date_trunc('day', ts) AS TIMESTAMP) AS run_ts, event_type AS schema_type FROM events"
ABOUT = "SELECT site, concat('https://', site) AS base_url, concat('Site ', site) AS site_name, concat('About ', site) AS description FROM sites"

# --- page signals ----------------------------------------------------------------------------------------------

BODY = without("html", ("head", "script", "style", "nav", "footer"))
KW_BODY = without("html", ("head", "script", "style", "nav", "footer", "aside"))
FULL_BODY = without("html", ("head", "script", "style"))
IMGS = every("html", r"(?i)<img\b([^>]*)>", 1)
INPUTS = every("html", r"(?i)<input\b([^>]*)>", 1)
LABELS = every("html", r"""(?i)<label\b[^>]*for\s*=\s*["'']([^"'']+)["'']""", 1)
HREFS = every("html", r"""(?is)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>""", 1)
CSS_TAGS = every("html", r"""(?i)<link\b[^>]*rel\s*=\s*["'']stylesheet["''][^>]*>""")
SCRIPT_TAGS = (
    "list_filter(" + every("html", r"(?i)<script\b[^>]*\bsrc=[^>]*>")
    + r""", lambda t: NOT regexp_matches(t, '(?i)\b(async|defer)\b') AND NOT regexp_matches(t, '(?i)type\s*=\s*["'']module["'']'))"""
)
HEADINGS = every(
    "html", "(?is)" + "|".join(rf"<h{i}\b[^>]*>.*?</h{i}>" for i in range(1, 7))
)
LEVELS = f"list_transform({HEADINGS}, lambda h: CAST(h[3] AS BIGINT))"
BLOBS = every("html", r"""(?is)<script\s+type=["'']application/ld\+json["'']>(.*?)</script>""", 1)
# Fixed patterns: identifiers, authorities, numbers, years, names
DOI = r"""\b10\.\d{4,}/[^\s<>"]+"""
AUTH = r"https?://(?:www\.)?(?:pubmed|ncbi\.nlm\.nih\.gov|scholar\.google|arxiv\.org|biorxiv\.org)/\S+"
NUM = r"\b\d+(?:[.,]\d+)?(?:%|°C|°F|kg|mg|μg|ng|min|sek|h|ms|mm|cm|m|km|x)?\b"
NUM_KW = r"\b\d+(?:[.,]\d+)?(?:%|°C|°F|kg|mg|μg|min|sek|h|ms|mm|cm|m|km|x)?\b"
YEAR = r"\b(19|20)\d{2}\b"
CAP = r"[A-ZĄĆĘŁŃÓŚŹŻ][a-ząćęłńóśźż]+"
# a proper-name run must not start inside a word; RE2's \b only knows ASCII letters
PROPER = rf"(?:^|[^\p{{L}}\p{{N}}_]){CAP}(?:\s+{CAP}){{1,3}}"


def meta(key: str) -> str:
    tags = every("html", r"(?i)<meta\b([^>]*)/?>", 1)
    k = f"lower(coalesce(nullif({attr('m', 'property')}, ''), {attr('m', 'name')}))"
    return f"list_filter(list_transform({tags}, lambda m: CASE WHEN {k} = '{key}' THEN nullif({attr('m', 'content')}, '') END), lambda c: c IS NOT NULL)[1]"


def cited(source: str, fragments) -> str:
    links = f"len(list_filter({HREFS}, lambda h: {contains_any('lower(h)', fragments)}))"
    return f"greatest({links}, {n_of(source, DOI)} + {n_of(source, AUTH)})"


def sentence_count(text: str) -> str:
    return f"CASE WHEN trim({text}) = '' THEN 0 ELSE len({sentence_ends(text)}) + 1 END"


def protected(text: str) -> str:
    abbr = "|".join(a.replace(".", r"\.") for a in T.POLISH.abbreviations)
    return (
        rf"regexp_replace(regexp_replace({text}, '\.{{3,}}', '…', 'g'), "
        rf"'(?i)(^|[^\p{{L}}\p{{N}}_])({abbr})\.', concat('\1\2', chr(1)), 'g')"
    )


def sentence_ends(text: str) -> str:
    return every(protected(text), r"[.!?]\s+[A-ZĄĆĘŁŃÓŚŹŻ]")


def hard_words(text: str) -> str:
    return f"len(list_filter({every(f'lower({text})', WORD)}, lambda w: len(regexp_extract_all(w, '[aąeęioóuyźż]+')) >= 4))"


LATIN_VOWELS = "aàáâãäåąeèéêëęiìíîïoòóôõöøuùúûüyýÿ"


def latin_sentence_count(text: str) -> str:
    """Without abbreviations; a sentence ends before any capital."""
    found = every(f"regexp_replace({text}, '\\.{{3,}}', '…', 'g')", r"[.!?]\s+\p{Lu}")
    return f"CASE WHEN trim({text}) = '' THEN 0 ELSE len({found}) + 1 END"


def latin_hard_words(text: str) -> str:
    return f"len(list_filter({every(f'lower({text})', WORD)}, lambda w: len(regexp_extract_all(w, '[{LATIN_VOWELS}]+')) >= 4))"


SPACES = r"\s+"


def tokens_by_space(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


# per-sentence word counts: mark the ends, cut there, count the tokens
def sentence_words(text: str) -> str:
    marked = rf"regexp_replace({protected(text)}, '([.!?])\s+([A-ZĄĆĘŁŃÓŚŹŻ])', concat('\1', chr(2), '\2'), 'g')"
    # neighbouring ends ("A. B. C") share no character, but the capital is consumed: run it twice
    again = rf"regexp_replace({marked}, '([.!?])\s+([A-ZĄĆĘŁŃÓŚŹŻ])', concat('\1', chr(2), '\2'), 'g')"
    return f"list_transform(list_filter(string_split({again}, chr(2)), lambda s: trim(s) <> ''), lambda s: len({tokens_by_space('s')}))"


SIG_BASE = f"""SELECT *, {IMGS} AS imgs, {INPUTS} AS inps, {LABELS} AS labels, {LEVELS} AS lv, {BODY} AS body FROM pg"""
SIG_TEXT = f"""SELECT *, {paras('body')} AS ps FROM sig_base"""
SIG_FULL = "SELECT *, array_to_string(ps, ' ') AS txt FROM sig_text"
SRC = attr("i", "src")
SIG = f"""SELECT site, page_id, path, html, txt,
 CAST(strlen(html) AS BIGINT) AS html_bytes,
 contains(lower(html), '<picture>') AS has_picture,
 len({CSS_TAGS}) AS n_stylesheets,
 len({SCRIPT_TAGS}) AS n_blocking_scripts,
 regexp_matches(html, '(?i)<link\\b[^>]*rel\\s*=\\s*["'']preload["''][^>]*as\\s*=\\s*["'']font["'']') AS has_font_preload,
 len(imgs) AS n_img,
 len(list_filter(imgs, lambda i: {has_attr('i', 'alt')})) AS n_img_alt,
 len(list_filter(imgs, lambda i: coalesce({attr('i', 'alt')}, '') <> '')) AS n_img_described,
 len(list_filter(imgs, lambda i: {attr('i', 'alt')} = '')) AS n_img_decorative,
 len(list_filter(imgs, lambda i: coalesce({SRC}, '') <> '')) AS n_img_src,
 len(list_filter(imgs, lambda i: coalesce({SRC}, '') <> '' AND {ext(SRC)} IN ('webp', 'avif'))) AS n_img_src_modern,
 len(list_filter(imgs, lambda i: coalesce({SRC}, '') <> '' AND {attr('i', 'loading')} = 'lazy')) AS n_img_src_lazy,
 len(list_filter(imgs, lambda i: coalesce({SRC}, '') <> '' AND {has_attr('i', 'alt')})) AS n_img_src_alt,
 regexp_extract(html, '(?i)<html\\b[^>]*\\blang\\s*=\\s*["'']([^"'']+)["'']', 1) AS lang,
 regexp_matches(html, '(?i)<html\\b[^>]*\\blang\\s*=\\s*["'']([^"'']+)["'']') AS has_lang,
 {contains_any('html', ('skip-link', 'skip-to-main', 'href="#main', "href='#main"))} AS has_skip_link,
 {' + '.join(f"CAST(contains(lower(html), '{m}') AS BIGINT)" for m in ('<header', '<main', '<nav', '<aside', '<footer'))} AS n_landmarks,
 len(list_filter(lv, lambda v: v = 1)) AS n_h1,
 len(list_filter(range(2, len(lv) + 1), lambda n: lv[n] - lv[n - 1] > 1)) > 0 AS skips_level,
 len(list_filter(inps, lambda i: lower(coalesce({attr('i', 'type')}, 'text')) NOT IN ('hidden', 'submit', 'button', 'reset'))) AS n_inputs,
 len(list_filter(inps, lambda i: lower(coalesce({attr('i', 'type')}, 'text')) NOT IN ('hidden', 'submit', 'button', 'reset')
   AND NOT (list_contains(labels, coalesce({attr('i', 'id')}, '')) OR {has_attr('i', 'aria-label')} OR {has_attr('i', 'aria-labelledby')}))) AS n_inputs_unlabelled,
 {n_of('html', '(?s)<h[23][^>]*>.*?' + chr(92) + '?</h[23]>')} AS n_question_headings,
 contains(html, 'role="doc-bibliography"') OR contains(lower(html), 'bibliography') AS has_bibliography,
 contains(html, 'itemprop="author"') OR contains(replace(html, ' ', ''), '"@type":"Person"') AS has_author,
 contains(html, 'og:image') AS has_og_image,
 contains(html, 'data-nosnippet') AS has_nosnippet,
 contains(html, 'fonts.googleapis.com') AS uses_google_fonts,
 contains(lower(path), '/artykul') OR contains(lower(html)[1:1000], 'article') AS is_article,
 length(txt) >= 200 AS judged,
 {n_of('txt', WORD)} AS n_words,
 {n_of('txt', NUM)} + {n_of('txt', YEAR)} + {n_of('txt', PROPER)} AS n_facts,
 {cited('body', dim.AUTHORITIES_CONTENT)} AS n_cited,
 {heads('body', 2)} AS h2,
 {hard_words('txt')} AS n_hard,
 {sentence_count('txt')} AS n_sent,
 {sentence_words('txt')} AS sent_words,
 array_to_string({tokens_by_space("array_to_string(ps[1:3], ' ')")}[1:150], ' ') AS intro,
 {meta('article:published_time')} AS pub, {meta('article:modified_time')} AS mod
 FROM sig_full"""
SIGNALS = f"""SELECT * EXCLUDE (txt, n_facts, n_cited, h2, n_hard, n_sent, sent_words, intro, pub, mod, html),
 CASE WHEN judged THEN n_sent END AS n_sentences,
 CASE WHEN judged THEN CAST(list_sum(sent_words) AS BIGINT) END AS sum_sentence_words,
 CASE WHEN judged THEN len(list_filter(sent_words, lambda n: n > 35)) END AS n_long_sentences,
 CASE WHEN judged THEN (n_words / n_sent + n_hard / n_words * 100) / 3 END AS fog,
 CASE WHEN judged AND n_words >= 100 THEN n_facts / n_words * 100 END AS fact_density,
 CASE WHEN judged AND n_words >= 100 THEN n_cited / n_words * 1000 END AS citation_density,
 CASE WHEN judged AND len(h2) > 0 THEN len(list_filter(h2, lambda h: contains(h, '?'))) / len(h2) * 100 END AS h2_question_pct,
 judged AND {n_of('intro', chr(92) + 'b' + chr(92) + 'd+(?:[.,]' + chr(92) + 'd+)?' + chr(92) + 'b')} >= 2 AND {n_of('intro', CAP)} >= 1 AS has_tldr,
 CASE WHEN pub IS NOT NULL THEN date_diff('day', CAST(coalesce(mod, pub) AS DATE), DATE '2025-06-01') END AS age_days
 FROM sig"""
SIG_CTES = dict(pg=PG, sig_base=SIG_BASE, sig_text=SIG_TEXT, sig_full=SIG_FULL, sig=SIG, s=SIGNALS)

ELEMENTS = f"""SELECT site, page_id, 'img' AS kind, {attr('t', 'src')} AS ref, {ext(attr('t', 'src'))} AS ext
 FROM (SELECT site, page_id, unnest({IMGS}) AS t FROM pg) WHERE coalesce({attr('t', 'src')}, '') <> ''
 UNION ALL SELECT site, page_id, 'css', regexp_extract(t, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1), NULL FROM (SELECT site, page_id, unnest({CSS_TAGS}) AS t FROM pg)
 UNION ALL SELECT site, page_id, 'js', regexp_extract(t, '(?i)src\\s*=\\s*["'']([^"'']+)["'']', 1), NULL FROM (SELECT site, page_id, unnest({SCRIPT_TAGS}) AS t FROM pg)"""
SIZED = """SELECT e.site, e.page_id, e.kind, e.ref, coalesce(a.bytes, 0) AS bytes FROM el e LEFT JOIN assets a
 ON a.site = e.site AND a.path = ltrim(e.ref, '/') AND NOT regexp_matches(e.ref, '^(https?://|//|data:)')"""

ARTICLES = f"""SELECT site, page_id AS doc, {strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
 {strip("regexp_extract(kb, '(?is)<h1" + chr(92) + "b[^>]*>(.*?)</h1>', 1)")} AS h1, {heads('kb', 2)} AS h2_list, {heads('kb', 3)} AS h3_list,
 regexp_extract(html, '(?i)<meta\\b[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']', 1) AS meta_description,
 {every('html', '''(?i)<meta''' + chr(92) + '''b[^>]*property=["'']article:tag["''][^>]*content=["'']([^"'']*)["'']''', 1)} AS article_tags,
 array_to_string({paras('kb')}, ' ') AS body_text,
 {cited('html', dim.AUTHORITIES_KEYWORDS)} AS citation_count
 FROM (SELECT *, {KW_BODY} AS kb FROM pg)"""
ART = f"""SELECT *, {n_of('body_text', WORD)} AS word_count,
 array_to_string({tokens_by_space('body_text')}[1:200], ' ') AS first_200,
 {n_of('body_text', NUM_KW)} + {n_of('body_text', YEAR)} AS fact_count FROM art0"""
# an article has 100 words or more
ART_CTES = dict(pg=PG, art0=ARTICLES, art1=ART, art="SELECT * FROM art1 WHERE word_count >= 100")
DOC_ART = f"SELECT source AS site, doc_id AS doc, text AS body_text, {n_of('text', WORD)} AS word_count, '' AS title, '' AS h1, '' AS boost FROM documents"


def tokens(text: str) -> str:
    return (
        f"list_filter(list_transform({every(text, WORD)}, lambda w: lower(w)), lambda w: length(w) >= 3 "
        rf"AND NOT regexp_matches(w, '^\d+$') AND w NOT IN ({text_list(dim.STOPWORDS)}))"
    )


def keyword_ctes(source: str, boost: str, title: str, h1: str, top: int = 15) -> dict[str, str]:
    """tok, grams, terms, df, kw over a table of articles named ``source``."""
    return dict(
        tok=f"SELECT site, doc, word_count, {boost} AS boost, {title} AS title, {h1} AS h1, {tokens('body_text')} AS t FROM {source}",
        grams="""SELECT site, doc, word_count, boost, title, h1, unnest(g) AS term, generate_subscripts(g, 1) AS pos FROM (
 SELECT *, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])
 || list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g FROM tok)""",
        terms="SELECT site, doc, term, any_value(word_count) AS word_count, any_value(boost) AS boost, any_value(title) AS title, any_value(h1) AS h1, count(*) AS tf, min(pos) AS first_pos FROM grams GROUP BY site, doc, term",
        ns=f"SELECT site, count(*) AS n FROM {source} GROUP BY site",
        df="SELECT site, term, any_value(n) AS n, count(*) AS df, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM terms JOIN ns USING (site) GROUP BY site, term",
        scored="""SELECT site, doc, term, first_pos, idf, round(tf / greatest(word_count, 1) * idf * 1000
 * CASE WHEN contains(boost, term) THEN 3 ELSE 1 END * CASE WHEN contains(title, term) OR contains(h1, term) THEN 2 ELSE 1 END, 9) AS score
 FROM terms JOIN df USING (site, term) WHERE tf >= 2""",
        kw=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, doc ORDER BY score DESC, first_pos) AS rank FROM scored) WHERE rank <= {top}""",
    )


DOC_KW = dict(docs0=DOC_ART, docs="SELECT * FROM docs0 WHERE word_count >= 100", **keyword_ctes("docs", "''", "''", "''"))
PAGE_KW = dict(
    **ART_CTES,
    **keyword_ctes(
        "art",
        "lower(array_to_string([title, h1] || h2_list || [meta_description] || article_tags, ' '))",
        "lower(title)",
        "lower(h1)",
    ),
)

# --- structured data -------------------------------------------------------------------------------------------

BLOB = f"SELECT site, page_id, unnest({BLOBS}) AS blob, generate_subscripts({BLOBS}, 1) - 1 AS blob_pos FROM pg"
BLOB_OK = "SELECT *, json_valid(blob) AS is_valid FROM b0"
ROOTS = "SELECT site, page_id, blob_pos, CAST(blob AS JSON) AS v FROM b WHERE is_valid"
OBJS = """SELECT site, page_id, blob_pos, unnest(os) AS obj, unnest(range(len(os))) AS obj_pos FROM (SELECT *, list_filter(CASE
 WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(v, '$."@graph"') = 'ARRAY' THEN CAST(json_extract(v, '$."@graph"') AS JSON[])
 ELSE [v] END, lambda o: json_type(o) = 'OBJECT') AS os FROM roots)"""
OBJ = """SELECT *, coalesce(CASE json_type(obj, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(obj, '$."@type"[0]')
 WHEN 'VARCHAR' THEN json_extract_string(obj, '$."@type"') END, '') AS schema_type FROM o0"""
JSON_CTES = dict(pg=PG, b0=BLOB, b=BLOB_OK, roots=ROOTS, o0=OBJS, o=OBJ)
RULES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', '{kind}', '{f}', {'NULL' if fmt is None else repr(fmt)})" for t, kind, f, fmt, _ in dim.schema_rule_rows()
) + ") AS r(schema_type, kind, field, fmt)"
VALUES = """SELECT o.*, r.kind, r.field, r.fmt, json_extract(obj, concat('$."', r.field, '"')) AS val FROM o JOIN rules r USING (schema_type)"""
EMPTY = """(val IS NULL OR CAST(val AS VARCHAR) IN ('null', '""', '[]', '{}'))"""
STR = "json_extract_string(val, '$')"
# Fixed patterns of the format checks
URL_RE = r'^https?://[^\s<>"]+$'
REL_RE = r'^(?:https?://[^\s<>"]+|/[^\s<>"]*|\.{0,2}/[^\s<>"]*)$'
DATE_RE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
DUR_RE = r"^P(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+S)?)?$"
FORMAT = rf"""CASE
 WHEN fmt = 'url' AND json_type(val) = 'VARCHAR' AND NOT regexp_matches({STR}, '{URL_RE}') THEN 'bad_url'
 WHEN fmt = 'url_or_imageobject' AND json_type(val) = 'VARCHAR' AND NOT regexp_matches({STR}, '{REL_RE}') THEN 'bad_url'
 WHEN fmt = 'iso_date' AND json_type(val) = 'VARCHAR' AND NOT regexp_matches({STR}, '{DATE_RE}') THEN 'bad_date'
 WHEN fmt = 'iso_duration' AND json_type(val) = 'VARCHAR' AND NOT regexp_matches({STR}, '{DUR_RE}') THEN 'bad_duration'
 WHEN fmt = 'lang_code' AND json_type(val) = 'VARCHAR' AND NOT regexp_matches({STR}, '^[a-z]{{2,3}}(-[A-Z]{{2}})?$') THEN 'bad_language'
 WHEN fmt = 'int' AND json_type(val) NOT IN ('UBIGINT', 'BIGINT', 'BOOLEAN') THEN 'not_integer'
 WHEN fmt = 'breadcrumb_items' AND (json_type(val) <> 'ARRAY' OR json_array_length(val) < 2) THEN 'fewer_than_two_items'
 WHEN fmt = 'faq_questions' AND json_extract_string(val, '$[0]."@type"') <> 'Question' THEN 'item_not_question'
 WHEN fmt = 'faq_questions' AND json_extract_string(val, '$[0].acceptedAnswer.text') IS NULL THEN 'question_without_answer'
 WHEN fmt = 'howto_steps' AND json_type(val) <> 'ARRAY' THEN 'not_a_list' END"""
ISSUES = f"""SELECT site, page_id, blob_pos, schema_type, CASE WHEN kind = 'recommended' THEN 'warning' ELSE 'error' END AS severity,
 kind AS rule, field, CASE WHEN kind = 'check' THEN {FORMAT} ELSE 'missing' END AS detail FROM vals
 WHERE (kind IN ('required', 'recommended') AND {EMPTY}) OR (kind = 'check' AND NOT {EMPTY} AND {FORMAT} IS NOT NULL)
 UNION ALL SELECT site, page_id, blob_pos, schema_type, 'error', 'any_of', string_agg(field, '|' ORDER BY field), 'none_given' FROM vals
 WHERE kind = 'any_of' GROUP BY site, page_id, blob_pos, schema_type, CAST(obj AS VARCHAR) HAVING bool_and({EMPTY})"""
ISSUE_CTES = dict(**JSON_CTES, rules=RULES, vals=VALUES, iss=ISSUES)
REPORTS = """SELECT pg.site, pg.page_id, coalesce(t.n, 0) AS n_types, coalesce(t.types, '') AS types, coalesce(i.e, 0) AS errors,
 coalesce(i.w, 0) + CASE WHEN coalesce(t.n, 0) = 0 THEN 1 ELSE 0 END AS warnings FROM pg
 LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(schema_type, ',' ORDER BY blob_pos, obj_pos) AS types FROM o WHERE schema_type <> '' GROUP BY page_id) t USING (page_id)
 LEFT JOIN (SELECT page_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM iss GROUP BY page_id) i USING (page_id)"""
REPORT_CTES = dict(**ISSUE_CTES, rep=REPORTS)
VALIDATOR = "SELECT site, count(*) AS pages, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, greatest(0, 100 - 5 * CAST(sum(errors) AS BIGINT) - CAST(sum(warnings) AS BIGINT)) AS score FROM rep GROUP BY site"
ANY_TYPES = r"""SELECT DISTINCT site, page_id, unnest(regexp_extract_all(x, '"([^"]*)"', 1)) AS schema_type FROM (
 SELECT site, page_id, unnest(regexp_extract_all(CAST(v AS VARCHAR), '"@type":("[^"]*"|\[[^\]]*\])', 1)) AS x FROM roots)"""

# --- core audit ------------------------------------------------------------------------------------------------

FW = "SELECT sites.site, " + ", ".join(
    f"max(CASE WHEN path = '{p}' THEN content END) AS \"{p}\"" for p in dim.EXPECTED_FILES
) + " FROM sites LEFT JOIN res ON res.site = sites.site GROUP BY sites.site"
ROBOT_LINES = r"""SELECT site, i AS pos, lower(trim(split_part(line, ':', 1))) AS field, trim(regexp_replace(line, '^[^:]*:?', '')) AS value FROM (
 SELECT site, trim(regexp_replace(unnest(string_split("robots.txt", chr(10))), '#.*$', '')) AS line, unnest(range(len(string_split("robots.txt", chr(10))))) AS i
 FROM fw WHERE "robots.txt" IS NOT NULL) WHERE lower(trim(split_part(line, ':', 1))) IN ('user-agent', 'allow', 'disallow')"""
ROBOT_GROUPS = """SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY pos) AS grp FROM (SELECT *, CASE WHEN field = 'user-agent'
 AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM rl)"""
BOTS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{b}')" for i, (b, _, _) in enumerate(dim.AI_BOTS)) + ") AS b(ord, bot)"
BLOCK = r"""regexp_extract(c, concat('(?is)User-agent:\s*', bot, '\b(.*?)(?:\n\s*User-agent:|\n\s*$|$)'), 1)"""
CLEAN = rf"""regexp_replace(lower({BLOCK}), 'disallow:\s*/(data|admin|api|private)\b[^\n]*', '', 'g')"""
VERDICTS = rf"""SELECT f.site, bots.ord, bots.bot, CASE WHEN v.blocked IS NULL THEN 'fail' WHEN v.blocked THEN 'warn' ELSE 'ok' END AS status,
 CASE WHEN NOT contains(lower(c), lower(bot)) THEN 'fail' WHEN regexp_matches(c, concat('(?i)User-agent:\s*', bot, '\b'))
 AND NOT regexp_matches({CLEAN}, '(?m)disallow:\s*/\s*$') THEN 'ok' ELSE 'warn' END AS compat_status
 FROM (SELECT site, "robots.txt" AS c FROM fw WHERE "robots.txt" IS NOT NULL) f CROSS JOIN bots
 LEFT JOIN (SELECT a.site, lower(a.value) AS agent, bool_or(g.blocked) AS blocked FROM rg a
 JOIN (SELECT site, grp, bool_or(field = 'disallow' AND value = '/') AS blocked FROM rg GROUP BY site, grp) g USING (site, grp)
 WHERE a.field = 'user-agent' GROUP BY ALL) v ON v.site = f.site AND v.agent = lower(bots.bot)"""
ROBOT_CTES = dict(rl=ROBOT_LINES, rg=ROBOT_GROUPS, bots=BOTS, verdicts=VERDICTS)
FILE_CTES = dict(sites=SITES, res=RES, fw=FW)


def finding(module: str, check: str, ord_: int, status: str, value: str = "NULL", detail: str = "NULL", source: str = "fw") -> str:
    return (
        f"SELECT site, '{module}' AS module, '{check}' AS check_id, {status} AS status, CAST({value} AS DOUBLE) AS value, "
        f"CAST({detail} AS VARCHAR) AS detail, CAST({ord_} AS BIGINT) AS ord FROM {source}"
    )


def ok_or(test: str, other: str = "fail", given: str | None = None) -> str:
    case = f"CASE WHEN {test} THEN 'ok' ELSE '{other}' END"
    return case if given is None else f"CASE WHEN {given} THEN {case} END"


def _q(path: str) -> str:
    return f'"{path}"'


L, LF, R, SM, HT = (_q(p) for p in ("llms.txt", "llms-full.txt", "robots.txt", "sitemap.xml", ".htaccess"))
FILE_FINDINGS = [
    finding("ai_files", "llms_txt", 101, ok_or(f"{L} IS NOT NULL"), f"len(string_split(trim({L}, concat(' ', chr(10))), chr(10)))"),
    finding("ai_files", "llms_txt_articles", 102, ok_or(f"contains(lower({L}), 'articles') OR contains(lower({L}), '# artykuly')", given=f"{L} IS NOT NULL")),
    finding("ai_files", "llms_full_txt", 103, ok_or(f"{LF} IS NOT NULL"), f"len({tokens_by_space(LF)})"),
    finding("robots", "robots_txt", 201, ok_or(f"{R} IS NOT NULL")),
    finding("robots", "sitemap_declared", 298, ok_or(f"contains(lower({R}), 'sitemap:')", given=f"{R} IS NOT NULL")),
    finding("robots", "llms_declared", 299, ok_or(f"contains({R}, 'llms.txt') OR contains({R}, 'llms-full.txt')", "warn", f"{R} IS NOT NULL")),
    finding("sitemap", "sitemap_xml", 401, ok_or(f"{SM} IS NOT NULL"), f"coalesce(nullif(len(string_split({SM}, '<url>')) - 1, 0), len(string_split({SM}, '<loc>')) - 1)"),
    finding("sitemap", "sitemap_images", 402, ok_or(f"contains({SM}, 'image:')", given=f"{SM} IS NOT NULL")),
    finding("sitemap", "sitemap_lastmod", 403, ok_or(f"contains({SM}, '<lastmod>')", "warn", f"{SM} IS NOT NULL")),
    finding("sitemap", "sitemap_changefreq", 404, f"CASE WHEN contains({SM}, '<changefreq>') THEN 'ok' END"),
    finding("sitemap", "sitemap_priority", 405, f"CASE WHEN contains({SM}, '<priority>') THEN 'ok' END"),
    finding("pwa", "service_worker", 601, ok_or('"sw.js" IS NOT NULL')),
    finding("pwa", "manifest", 602, ok_or('"manifest.json" IS NOT NULL')),
]
HEADER_FINDINGS = (
    [finding("security", "headers", 501, ok_or("d IS NOT NULL"), source="hd")]
    + [
        finding("security", c, 502 + i, ok_or(f"contains(d, '{h.lower()}')", given="d IS NOT NULL"), source="hd")
        for i, (h, c) in enumerate(dim.SECURITY_HEADERS)
    ]
    + [
        finding("security", "compression", 508, ok_or("contains(d, 'content-encoding')", given="d IS NOT NULL"), source="hd"),
        finding("security", "cache", 509, ok_or("contains(d, 'cache-control') OR contains(d, 'max-age')", given="d IS NOT NULL"), source="hd"),
    ]
)
HTACCESS_FINDINGS = (
    [finding("security", "htaccess", 501, ok_or(f"{HT} IS NOT NULL"))]
    + [
        finding("security", c, 502 + i, ok_or(f"contains(lower({HT}), '{h.lower()}')", given=f"{HT} IS NOT NULL"))
        for i, (h, c) in enumerate(dim.SECURITY_HEADERS)
    ]
    + [
        finding("security", "compression", 508, ok_or(f"contains({HT}, 'mod_deflate') OR contains({HT}, 'AddOutputFilterByType')", given=f"{HT} IS NOT NULL")),
        finding("security", "cache", 509, ok_or(f"contains({HT}, 'ExpiresByType') OR contains({HT}, 'max-age')", given=f"{HT} IS NOT NULL")),
    ]
)
HEADER_DUMP = "SELECT sites.site, string_agg(lower(concat(name, ': ', value)), chr(10) ORDER BY o) FILTER (name IS NOT NULL) AS d FROM sites LEFT JOIN h ON h.site = sites.site GROUP BY sites.site"
FONT_FINDINGS = [
    finding("fonts", "google_fonts", 703, ok_or("p IS NULL"), detail="p", source="(SELECT site, arg_min(page_id, (path, page_id)) FILTER (uses_google_fonts) AS p FROM s GROUP BY site)"),
    finding("fonts", "own_fonts", 701, ok_or("n IS NOT NULL"), "n", source="wf"),
    finding("fonts", "own_fonts_kb", 702, "CASE WHEN n IS NOT NULL THEN 'info' END", "floor(b / 1024)", source="wf"),
]
OWN_FONTS = r"SELECT sites.site, f.n, f.b FROM sites LEFT JOIN (SELECT site, count(*) AS n, sum(bytes) AS b FROM assets WHERE regexp_matches(path, '^fonts/[^/]*\.woff2$') GROUP BY site) f ON f.site = sites.site"
MARK_FINDINGS = [
    finding("content_marks", name, 801 + i, "'info'", value, "n", f"(SELECT site, count(*) AS n, {agg} AS v FROM s GROUP BY site)".replace("AS v", f"AS {value}"))
    for i, (name, agg, value) in enumerate(
        [
            ("question_headings", "sum(n_question_headings)", "v"),
            ("bibliography_pages", "count(*) FILTER (has_bibliography)", "v"),
            ("author_pages", "count(*) FILTER (has_author)", "v"),
            ("og_image_pages", "count(*) FILTER (has_og_image)", "v"),
            ("nosnippet_pages", "count(*) FILTER (has_nosnippet)", "v"),
        ]
    )
]
BROKEN = "SELECT sites.site, count(b.page_id) AS n FROM sites LEFT JOIN b ON b.site = sites.site AND NOT b.is_valid GROUP BY sites.site"
SCHEMA_FINDINGS = (
    [
        finding("structured_data", "jsonld_syntax", 301, "CASE WHEN n = 0 THEN 'ok' END", "n", source="broken"),
        finding("structured_data", "jsonld_syntax", 301, "'fail'", detail="page_id", source="(SELECT * FROM b WHERE NOT is_valid)"),
    ]
    + [
        finding(
            "structured_data", f"type:{t}", 302 + i, ok_or("t IS NOT NULL", "fail" if i < 5 else "info"),
            source=f"(SELECT sites.site, x.t FROM sites LEFT JOIN (SELECT DISTINCT site, 1 AS t FROM anyt WHERE schema_type = '{t}') x ON x.site = sites.site)",
        )
        for i, t in enumerate([*dim.REQUIRED_TYPES, *dim.OPTIONAL_TYPES])
    ]
)
BOT_FINDINGS = ["SELECT site, 'robots' AS module, concat('bot:', bot) AS check_id, status, NULL AS value, compat_status AS detail, CAST(ord + 202 AS BIGINT) AS ord FROM verdicts"]


def all_of(findings: list[str]) -> str:
    return "SELECT * FROM (" + "\nUNION ALL ".join(findings) + ") WHERE status IS NOT NULL"


CORE_CTES = dict(
    **SIG_CTES, b0=BLOB, b=BLOB_OK, roots=ROOTS, anyt=ANY_TYPES, **FILE_CTES, **ROBOT_CTES, h=HDR, hd=HEADER_DUMP,
    assets=ASSETS, wf=OWN_FONTS, broken=BROKEN,
    fi=all_of(FILE_FINDINGS + HEADER_FINDINGS + FONT_FINDINGS + MARK_FINDINGS + SCHEMA_FINDINGS + BOT_FINDINGS),
    core="SELECT *, CAST(floor(ok / greatest(ok + fail, 1) * 100) AS BIGINT) AS score FROM (SELECT site, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'warn') AS warn FROM fi GROUP BY site)",
)

# --- quality modules -------------------------------------------------------------------------------------------

PERF = f"""SELECT *, {whole(mean('modern_pct', 'lazy_pct', 'alt_pct', 'CASE WHEN avg_html_bytes < 100000 THEN 100 WHEN avg_html_bytes < 200000 THEN 60 ELSE 20 END', 'CASE WHEN font_preload_pages > 0 THEN 100 END'))} AS score
 FROM (SELECT *, html_bytes / pages AS avg_html_bytes, {pct('n_img_src_modern', 'n_img_src')} AS modern_pct, {pct('n_img_src_lazy', 'n_img_src')} AS lazy_pct, {pct('n_img_src_alt', 'n_img_src')} AS alt_pct
 FROM (SELECT site, count(*) AS pages, CAST(sum(html_bytes) AS BIGINT) AS html_bytes, CAST(sum(n_img_src) AS BIGINT) AS n_img_src, CAST(sum(n_img_src_modern) AS BIGINT) AS n_img_src_modern,
 CAST(sum(n_img_src_lazy) AS BIGINT) AS n_img_src_lazy, CAST(sum(n_img_src_alt) AS BIGINT) AS n_img_src_alt, count(*) FILTER (has_picture) AS picture_pages,
 CAST(sum(n_stylesheets) AS BIGINT) AS n_stylesheets, CAST(sum(n_blocking_scripts) AS BIGINT) AS n_blocking_scripts, count(*) FILTER (has_font_preload) AS font_preload_pages FROM s GROUP BY site))"""
PERF_SIZES = "SELECT site, " + ", ".join(
    f"CAST(coalesce(sum(bytes) FILTER (kind = '{k}'), 0) AS BIGINT) AS {k}_bytes" for k in ("img", "css", "js")
) + " FROM sized GROUP BY site"
PERF_ALL = "SELECT perf.*, coalesce(img_bytes, 0) AS img_bytes, coalesce(css_bytes, 0) AS css_bytes, coalesce(js_bytes, 0) AS js_bytes FROM perf LEFT JOIN ps ON ps.site = perf.site"
A11Y = f"""SELECT *, {whole(mean('lang_pages / pages * 100', 'CASE WHEN skip_link_pages > 0 THEN skip_link_pages / pages * 100 ELSE 50 END', pct('n_img_alt', 'n_img'), '(pages - level_skip_pages) / pages * 100', 'landmark_pages / pages * 100', pct('(n_inputs - n_inputs_unlabelled)', 'n_inputs')))} AS score
 FROM (SELECT site, count(*) AS pages, count(*) FILTER (has_lang) AS lang_pages, count(*) FILTER (has_skip_link) AS skip_link_pages, CAST(sum(n_img) AS BIGINT) AS n_img,
 CAST(sum(n_img_alt) AS BIGINT) AS n_img_alt, CAST(sum(n_img_described) AS BIGINT) AS n_img_described, CAST(sum(n_img_decorative) AS BIGINT) AS n_img_decorative,
 count(*) FILTER (n_h1 > 1) AS multi_h1_pages, count(*) FILTER (skips_level) AS level_skip_pages, count(*) FILTER (n_landmarks >= 3) AS landmark_pages,
 CAST(sum(n_inputs) AS BIGINT) AS n_inputs, CAST(sum(n_inputs_unlabelled) AS BIGINT) AS n_inputs_unlabelled FROM s GROUP BY site)"""
CONTENT = f"""SELECT site, pages, fog, avg_sentence_words, long_sentence_pct, fact_density, citation_density, h2_question_pct, tldr_pages, stale_pages,
 {whole(mean('CASE WHEN fog IS NOT NULL THEN greatest(0, least(100, 100 - (fog - 9) * 6)) END', *(f'CASE WHEN {c} IS NOT NULL THEN least(100, {c} * {k}) END' for c, k in (('fact_density', 10), ('citation_density', 15), ('h2_question_pct', 2))), 'tldr_pages / pages * 100'))} AS score
 FROM (SELECT site, count(*) AS pages, avg(fog) AS fog, sum(sum_sentence_words) / nullif(sum(n_sentences), 0) AS avg_sentence_words,
 sum(n_long_sentences) / nullif(sum(n_sentences), 0) * 100 AS long_sentence_pct, avg(fact_density) AS fact_density, avg(citation_density) AS citation_density,
 avg(h2_question_pct) AS h2_question_pct, count(*) FILTER (has_tldr) AS tldr_pages, count(*) FILTER (judged AND age_days > 365) AS stale_pages
 FROM s WHERE is_article OR site NOT IN (SELECT site FROM s WHERE is_article) GROUP BY site)"""
MODULES = "SELECT p.site, p.score AS performance, a.score AS accessibility, c.score AS content, CAST(floor((p.score + a.score + c.score) / 3) AS BIGINT) AS avg_score FROM perf p JOIN a11y a ON a.site = p.site JOIN content c ON c.site = p.site"
QUALITY_CTES = dict(perf=PERF, a11y=A11Y, content=CONTENT, modules=MODULES)


def quality_finding(ord_: int, module: str, name: str, source: str, status: str, value: str) -> str:
    detail = "concat(text_colour, '/', background_colour)" if name == "contrast" else "NULL"
    return f"SELECT site, '{module}' AS module, '{name}' AS check_id, {status} AS status, CAST({value} AS DOUBLE) AS value, {detail} AS detail, {1000 + ord_} AS ord FROM {source}"


def banded(value: str, ok: str, warn: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN NULL WHEN {value} >= {ok} THEN 'ok' WHEN {value} >= {warn} THEN 'warn' ELSE 'fail' END"


QUALITY_FINDINGS = [
    ("performance", "html_weight", "pa", "CASE WHEN avg_html_bytes > 200000 THEN 'fail' WHEN avg_html_bytes > 100000 THEN 'warn' ELSE 'ok' END", "avg_html_bytes"),
    ("performance", "modern_images", "pa", banded("modern_pct", "80", "50"), "modern_pct"),
    ("performance", "lazy_images", "pa", banded("lazy_pct", "80", "30"), "lazy_pct"),
    ("performance", "image_alt", "pa", "CASE WHEN n_img_src > 0 THEN CASE WHEN alt_pct >= 95 THEN 'ok' ELSE 'fail' END END", "alt_pct"),
    ("performance", "picture", "pa", "CASE WHEN picture_pages > 0 THEN 'ok' END", "picture_pages"),
    ("performance", "css_weight", "pa", "CASE WHEN css_bytes > 150000 THEN 'warn' END", "css_bytes"),
    ("performance", "blocking_scripts", "pa", "CASE WHEN js_bytes > 0 AND n_blocking_scripts > 0 THEN 'warn' END", "n_blocking_scripts"),
    ("performance", "font_preload", "pa", "CASE WHEN font_preload_pages > 0 THEN 'ok' ELSE 'fail' END", "font_preload_pages"),
    ("accessibility", "html_lang", "a11y", "CASE WHEN lang_pages = pages THEN 'ok' ELSE 'fail' END", "pages - lang_pages"),
    ("accessibility", "skip_link", "a11y", "CASE WHEN skip_link_pages > 0 THEN 'ok' ELSE 'warn' END", "skip_link_pages"),
    ("accessibility", "alt_coverage", "a11y", "CASE WHEN n_img > 0 THEN 'info' END", pct("n_img_alt", "n_img")),
    ("accessibility", "single_h1", "a11y", "CASE WHEN multi_h1_pages = 0 THEN 'ok' ELSE 'warn' END", "multi_h1_pages"),
    ("accessibility", "heading_order", "a11y", "CASE WHEN level_skip_pages = 0 THEN 'ok' ELSE 'fail' END", "level_skip_pages"),
    ("accessibility", "landmarks", "a11y", "CASE WHEN landmark_pages = pages THEN 'ok' ELSE 'warn' END", "landmark_pages"),
    ("accessibility", "input_labels", "a11y", "CASE WHEN n_inputs > 0 THEN CASE WHEN n_inputs_unlabelled = 0 THEN 'ok' ELSE 'fail' END END", "n_inputs_unlabelled"),
    ("accessibility", "contrast", "contrast", "CASE WHEN band IN ('AAA', 'AA') THEN 'ok' WHEN band = 'large_text_only' THEN 'warn' ELSE 'fail' END", "ratio"),
    ("content", "readability", "content", "CASE WHEN fog < 13 THEN 'ok' WHEN fog < 17 THEN 'warn' WHEN fog IS NOT NULL THEN 'fail' END", "fog"),
    ("content", "sentence_length", "content", "CASE WHEN avg_sentence_words > 25 THEN 'warn' WHEN avg_sentence_words IS NOT NULL THEN 'info' END", "avg_sentence_words"),
    ("content", "fact_density", "content", banded("fact_density", "8", "4"), "fact_density"),
    ("content", "citation_density", "content", banded("citation_density", "5", "2"), "citation_density"),
    ("content", "question_headings", "content", "CASE WHEN h2_question_pct IS NOT NULL THEN CASE WHEN h2_question_pct >= 30 THEN 'ok' ELSE 'warn' END END", "h2_question_pct"),
    ("content", "tldr", "content", "'info'", "tldr_pages"),
    ("content", "stale", "content", "CASE WHEN stale_pages > 0 THEN 'info' END", "stale_pages"),
]
CARDS = """SELECT site, CAST(floor(avg(p)) AS BIGINT) AS performance, CAST(floor(avg(a)) AS BIGINT) AS accessibility, CAST(floor(avg(b)) AS BIGINT) AS best_practices, CAST(floor(min(q)) AS BIGINT) AS seo FROM (
 SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, round(100 * CAST(v->>'$.lighthouseResult.categories.performance.score' AS DOUBLE)) AS p,
 round(100 * CAST(v->>'$.lighthouseResult.categories.accessibility.score' AS DOUBLE)) AS a, round(100 * CAST(v->>'$.lighthouseResult.categories."best-practices".score' AS DOUBLE)) AS b,
 coalesce(round(100 * CAST(v->>'$.lighthouseResult.categories.seo.score' AS DOUBLE)), 0) AS q FROM psi) GROUP BY site"""


def channel(hex6: str, at: int) -> str:
    c = f"(CAST(concat('0x', substr({hex6}, {at}, 2)) AS BIGINT) / 255)"
    return f"CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def luminance(colour: str) -> str:
    digits = f"CASE WHEN length({colour}) = 4 THEN concat({colour}[2], {colour}[2], {colour}[3], {colour}[3], {colour}[4], {colour}[4]) ELSE {colour}[2:7] END"
    return f"(0.2126 * ({channel(f'({digits})', 1)}) + 0.7152 * ({channel(f'({digits})', 3)}) + 0.0722 * ({channel(f'({digits})', 5)}))"


# --- citations -------------------------------------------------------------------------------------------------

HIT = r"(acme\.example|acme)"
CITES = rf"""SELECT *, count > 0 AS cited, CASE WHEN count > 0 THEN length(regexp_extract(t, '(?s)^(.*?){HIT}', 1)) END AS first FROM (
 SELECT *, lower(response_text) AS t, len(regexp_extract_all(lower(response_text), '{HIT}')) AS count FROM pr)"""
CITED = f"""SELECT conv_id, turn, provider, query, error, count AS citation_count, cited, round(first / greatest(length(t), 1) * 100, 1) AS position,
 regexp_matches(t, 'https?://(?:www\\.)?acme\\.example') AS has_url,
 CASE WHEN NOT cited THEN 'n/a' WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment FROM (
 SELECT *, len(list_filter([{text_list(dim.POSITIVE_STEMS)}], lambda k: contains(ctx, k))) AS pos, len(list_filter([{text_list(dim.NEGATIVE_STEMS)}], lambda k: contains(ctx, k))) AS neg
 FROM (SELECT *, t[greatest(first - 100, 0) + 1 : first + 100] AS ctx FROM cites))"""
CITE_CTES = dict(pr=PROBES, cites=CITES, c=CITED)

# --- history ---------------------------------------------------------------------------------------------------

CHANGES = """SELECT *, score - prev_score AS delta, CASE WHEN score - prev_score <= -5 THEN 'regression' WHEN score - prev_score >= 5 THEN 'improvement' END AS change
 FROM (SELECT *, lag(score) OVER (PARTITION BY site, layer ORDER BY run_ts, tie) AS prev_score FROM ls)"""


def set_changes(facts: str, key: str, runs: str) -> str:
    """New and gone keys between consecutive runs of a site."""
    return f"""SELECT r.site, r.next_ts AS run_ts, f.{key}, 'gone' AS change FROM {runs} r JOIN (SELECT DISTINCT site, run_ts, {key} FROM {facts}) f ON f.site = r.site AND f.run_ts = r.run_ts
 WHERE r.next_ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {facts} g WHERE g.site = r.site AND g.run_ts = r.next_ts AND g.{key} = f.{key})
 UNION ALL SELECT r.site, r.next_ts, f.{key}, 'new' FROM {runs} r JOIN (SELECT DISTINCT site, run_ts, {key} FROM {facts}) f ON f.site = r.site AND f.run_ts = r.next_ts
 WHERE NOT EXISTS (SELECT 1 FROM {facts} g WHERE g.site = r.site AND g.run_ts = r.run_ts AND g.{key} = f.{key})"""


HIST_CTES = dict(
    ls=LAYERS,
    ch=CHANGES,
    ah=HISTORY,
    fails="SELECT * FROM ah WHERE status = 'fail'",
    runs="SELECT site, run_ts, lead(run_ts) OVER (PARTITION BY site ORDER BY run_ts) AS next_ts FROM (SELECT DISTINCT site, run_ts FROM ah)",
    fc=set_changes("fails", "check_id", "runs"),
    th=TYPES,
    tc=set_changes("th", "schema_type", "runs"),
    days="SELECT site, CAST(date_trunc('day', run_ts) AS TIMESTAMP) AS run_ts, change FROM ch",
    diff="""SELECT site, run_ts, CAST(sum(r) AS BIGINT) AS regressions, CAST(sum(i) AS BIGINT) AS improvements FROM (
 SELECT site, run_ts, count(*) FILTER (change = 'regression') AS r, count(*) FILTER (change = 'improvement') AS i FROM days GROUP BY ALL
 UNION ALL SELECT site, run_ts, count(*) FILTER (change = 'new'), count(*) FILTER (change = 'gone') FROM fc GROUP BY ALL
 UNION ALL SELECT site, run_ts, count(*) FILTER (change = 'gone'), count(*) FILTER (change = 'new') FROM tc GROUP BY ALL) GROUP BY ALL""",
    st="SELECT *, CASE WHEN regressions > improvements THEN 'REGRESSION' WHEN improvements > 0 THEN 'IMPROVEMENT' ELSE 'STABLE' END AS status FROM diff",
)

CONTRAST = f"""SELECT site, t AS text_colour, b AS background_colour, round(ratio, 6) AS ratio,
 CASE WHEN ratio >= 7 THEN 'AAA' WHEN ratio >= 4.5 THEN 'AA' WHEN ratio >= 3 THEN 'large_text_only' ELSE 'fail' END AS band FROM (
 SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(ratio, 9), t, b) AS rn FROM (
 SELECT site, t, b, (greatest({luminance('t')}, {luminance('b')}) + 0.05) / (least({luminance('t')}, {luminance('b')}) + 0.05) AS ratio
 FROM (SELECT site, unnest(regexp_extract_all(content, '--color-(text|ink|fg)[^:]*:\\s*(#[0-9a-fA-F]+)', 2)) AS t FROM css)
 JOIN (SELECT site, unnest(regexp_extract_all(content, '--color-(bg|background|surface)[^:]*:\\s*(#[0-9a-fA-F]+)', 2)) AS b FROM css) USING (site)
 WHERE lower(t) <> lower(b))) WHERE rn = 1"""
FINDING_CTES = dict(
    **SIG_CTES, sites=SITES, assets=ASSETS, el=ELEMENTS, sized=SIZED, perf=PERF, ps=PERF_SIZES, pa=PERF_ALL, a11y=A11Y, content=CONTENT, css=CSS, contrast=CONTRAST,
    qf="SELECT * FROM (" + " UNION ALL ".join(quality_finding(i, *f) for i, f in enumerate(QUALITY_FINDINGS)) + ") WHERE status IS NOT NULL",
)
