"""SQL of the core queries, for an engine with RE2 regular expressions and list functions.

What the engine's own modules state (patterns, lists, thresholds) is stated here a second time and
in another form, not imported, so that a mistake there shows as a difference.
"""

from __future__ import annotations

#: What may stand where in a URL; the check of the host's labels is apart (``valid``).
_FORM = r"^(?i:https?|ftps?)://(?:[^\s/?#@]+@)?[^\s/?#@:]+(?::[0-9]{1,5})?(?:[/?#]\S*)?$"
_HOST = r"^(?:localhost|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|(?:[\p{L}\p{N}](?:[\p{L}\p{N}_-]*[\p{L}\p{N}])?\.)+\p{L}{2,63})$"
_MONTH, _DAY, _SEP = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])", "[-/.]"
_YEAR = "[0-9]{4}"
DATE = f"(?:{_YEAR}{_SEP}{_MONTH}{_SEP}{_DAY}|{_MONTH}{_SEP}{_DAY}{_SEP}[0-9]{{2,4}}|{_DAY}{_SEP}{_MONTH}{_SEP}[0-9]{{2,4}})"
YEAR_MONTH = f"{_YEAR}{_SEP}{_MONTH}"
#: Of the keys that are dropped, those the tables hold.
DROPPED = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'do', 'rev', 'idx', 'action', 'format', 'version', 'at'"
UNITS, DOMAIN = "'ics', 'cs', 'informatics', 'stat'", "mereford.example"
MONTHS = "'jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'"
MAX_BYTES, REDIRECTS = 26214400, "301, 302, 303, 307, 308"
BAD = (
    "css js bmp gif jpg jpeg ico png tif tiff mid mp2 mp3 mp4 wav avi mov mpeg ram m4v mkv ogg ogv pdf ps eps tex ppt pptx doc docx xls xlsx names "
    "data dat exe bz2 tar msi bin 7z psd dmg iso epub dll cnf tgz sha1 thmx mso arff rtf jar csv rm smil wmv swf wma zip rar gz java war sql sh svg "
    "fig conf class txt xml c h cc cpp cxx hpp hh hxx m mm rs go py rb pl lua ts tsx jsx kt swift scala el lisp clj hs ml f f90 asm s ipynb"
)


def rest(url: str) -> str:
    """What follows the scheme."""
    return f"regexp_replace({url}, '^[^:/?#]+:', '')"


def split(url: str, group: int) -> str:
    """Scheme, authority, path, query, fragment."""
    bare = f"string_split({url}, '#')[1]"
    return {
        1: f"regexp_extract({url}, '^([^:/?#]+):', 1)",
        2: f"regexp_extract({rest(url)}, '^//([^/?#]*)', 1)",
        3: f"regexp_replace(regexp_extract({rest(url)}, '^[^?#]*'), '^//[^/]*', '')",
        4: f"CASE WHEN contains({bare}, '?') THEN {bare}[length(string_split({bare}, '?')[1]) + 2:] ELSE '' END",
        5: f"CASE WHEN contains({url}, '#') THEN {url}[length({bare}) + 2:] ELSE '' END",
    }[group]


def valid(url: str) -> str:
    name = f"regexp_replace(regexp_replace({split(url, 2)}, '^.*@', ''), ':[0-9]*$', '')"
    return f"(regexp_matches({url}, '{_FORM}') AND regexp_matches({name}, '{_HOST}') AND list_max([length(x) FOR x IN string_split({name}, '.')]) <= 63)"


def host(url: str) -> str:
    return f"regexp_replace(lower(string_split({split(url, 2)}, ':')[1]), '/+$', '')"


def netloc(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def dedup_path(path: str) -> str:
    return f"coalesce(nullif(rtrim({path}, '/'), ''), '/')"


def decoded(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def encoded(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def clean_query(query: str) -> str:
    key, value = decoded("string_split(p, '=')[1]"), decoded("regexp_replace(p, '^[^=]*=', '')")
    pairs = f"list_sort([{{'k': {key}, 'v': {value}}} FOR p IN string_split({query}, '&') IF regexp_matches(p, '^[^=]*=.') AND {key} NOT IN ({DROPPED})])"
    sort = f"len([x FOR x IN {pairs} IF NOT (x.k IN ('C', 'O') AND regexp_matches(x.v, '^[A-Za-z](?:;[CO]=[A-Za-z])*$'))]) = 0"
    joined = f"array_to_string([concat({encoded('x.k')}, '=', {encoded('x.v')}) FOR x IN {pairs}], '&')"
    return f"CASE WHEN {query} = '' OR {sort} THEN '' ELSE {joined} END"


def path_pattern(path: str) -> str:
    items = f"string_split({path}, '/')"
    leaf = f"list_max([CASE WHEN {items}[j] <> '' THEN j ELSE 0 END FOR j IN range(1, len({items}) + 1)])"
    x = f"{items}[i]"
    piece = f"""CASE WHEN {x} = '' THEN '/' WHEN regexp_matches({x}, '^\\p{{N}}+$') THEN '{{NUMBER}}/'
      WHEN regexp_matches({x}, '^{DATE}$') THEN '{{DATE}}/' WHEN regexp_matches({x}, '^{YEAR_MONTH}$') THEN '{{YEAR_MONTH}}/'
      WHEN length({x}) >= 128 THEN '{{LARGE}}/'
      WHEN contains({x}, ':') THEN concat(lower(replace(regexp_replace({x}, ':[^:]*$', ''), ':', '/')), '/{{PAGE}}/')
      WHEN i = {leaf} AND contains({x}, '.') THEN '{{FILE}}/' ELSE concat(lower({x}), '/') END"""
    return f"regexp_replace(array_to_string([{piece} FOR i IN range(1, len({items}) + 1)], ''), '/+$', '')"


def url_hash(url: str) -> str:
    path = split(url, 3)
    return (
        f"sha256(concat_ws('/', {split(url, 2)}, regexp_replace({path}, ';[^/]*$', ''), regexp_extract({path}, ';([^/]*)$', 1),"
        f" {split(url, 4)}, {split(url, 5)}))"
    )


def in_scope(name: str) -> str:
    labels = f"string_split({name}, '.')"
    return f"(len({labels}) >= 3 AND array_to_string({labels}[-2:], '.') = '{DOMAIN}' AND {labels}[-3] IN ({UNITS}))"


NORMALIZED = f"""
SELECT log_id, log_id AS seq, text, {valid("fetch_url")} AS ok, fetch_url AS u,
       lower({split("fetch_url", 1)}) AS scheme, {host("fetch_url")} AS host, {split("fetch_url", 3)} AS path,
       {clean_query(split("fetch_url", 4))} AS query
FROM pagelog"""

URL_NORMALIZE = f"""
WITH n AS ({NORMALIZED}),
f AS (SELECT *, regexp_replace(host, '^www\\.', '') AS net, CASE WHEN query = '' THEN '' ELSE concat('?', query) END AS tail FROM n)
SELECT log_id, CASE WHEN ok THEN concat(scheme, '://', host, path, tail) END AS clean_url,
       CASE WHEN ok THEN concat('http://', net, {dedup_path("path")}, tail) END AS page_key,
       CASE WHEN ok THEN {path_pattern("path")} END AS bucket_key,
       CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN net END AS netloc, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN query END AS query
FROM f"""

FIRST = f"""
named AS ({NORMALIZED}),
keyed AS (
  SELECT seq, text, regexp_replace(host, '^www\\.', '') AS host, concat(regexp_replace(host, '^www\\.', ''), {dedup_path("path")}) AS page_key,
         concat(scheme, '://', host, path, CASE WHEN query = '' THEN '' ELSE concat('?', query) END) AS url
  FROM named WHERE ok),
first AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY page_key ORDER BY seq) = 1)
"""
WORD = "[a-z]+(?:''[a-z]+)?"
COUNTED = f"{FIRST}, counted AS (SELECT seq, url, len(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS word_count FROM first)"
FREQUENCIES = f"""{FIRST},
each AS (SELECT seq, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM first),
found AS (SELECT seq, unnest(range(len(w))) AS pos, unnest(w) AS word FROM each),
stops AS (SELECT word FROM stop_words WHERE word IS NOT NULL UNION SELECT unnest([{MONTHS}])),
freq AS (
  SELECT word, count(*) AS n, min({{'s': seq, 'p': pos}}) AS f FROM found
  WHERE length(word) > 1 AND word NOT IN (SELECT word FROM stops) GROUP BY word)
"""


def header(name: str) -> str:
    return f"list_filter(map_entries(raw.headers), lambda e: lower(e.key) = '{name}')[1].value"


RESPONSE_FILTER = f"""
WITH r AS (SELECT resp_id, status, raw, lower({header("content-type")}) AS kind, try_cast(trim({header("content-length")}) AS BIGINT) AS size FROM responses)
SELECT resp_id, CASE
  WHEN status IN (601, 608, 700) OR status BETWEEN 400 AND 599 THEN 'bad-status'
  WHEN raw IS NULL THEN 'no-body'
  WHEN status IN ({REDIRECTS}) THEN 'redirect'
  WHEN octet_length(raw.content) > {MAX_BYTES} THEN 'too-large'
  WHEN NOT coalesce(contains(kind, 'text/html') OR contains(kind, 'application/xhtml+xml'), false) OR coalesce(size > {MAX_BYTES}, false) THEN 'bad-headers'
  ELSE 'page' END AS outcome
FROM r"""

FEATURES = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_SUMS = " | ".join(f"(CASE WHEN sum(n * (2 * CAST((h >> {b}) & 1 AS INT) - 1)) > 0 THEN {1 << b}::UBIGINT ELSE 0::UBIGINT END)" for b in range(64))


def signed(u: str) -> str:
    return f"CASE WHEN {u} >= 9223372036854775808 THEN ({u}::HUGEINT - 18446744073709551616)::BIGINT ELSE {u}::BIGINT END"


def simhashes(of: str, key: str) -> str:
    """CTEs up to ``prints`` (key, simhash) over key and text of a relation."""
    return f"""
tok AS (SELECT {key}, unnest({FEATURES}) AS w FROM {of}),
cnt AS (SELECT {key}, md5_number_upper(w)::UBIGINT AS h, count(*) AS n FROM tok GROUP BY 1, 2),
hashed AS (SELECT {key}, {_SUMS} AS u FROM cnt GROUP BY {key}),
prints AS (SELECT d.{key}, coalesce({signed("u")}, 0) AS simhash FROM {of} d LEFT JOIN hashed h ON d.{key} = h.{key})
"""


SIMHASH = simhashes("documents", "doc_id")


def near(values: str) -> str:
    return f"""
v AS (SELECT DISTINCT simhash AS x FROM {values} WHERE simhash IS NOT NULL)
SELECT a.x AS value_a, b.x AS value_b, CAST(bit_count(xor(a.x, b.x)) AS INT) AS distance
FROM v a JOIN v b ON a.x < b.x AND bit_count(xor(a.x, b.x)) <= 3"""


LOGGED = f"logged AS (SELECT {signed('simhash')} AS simhash FROM pagelog)"

#: Thresholds of a crawl, and low ones by which every kind of ban falls in the tables.
USUAL = {"min_pages": 20, "max_urls": 10000, "trigger": 20, "distance": 3, "min_words": 50, "low": 20, "min_requests": 20, "percent": 80, "subtree": 3}
LOW = {"min_pages": 3, "max_urls": 40, "trigger": 2, "distance": 3, "min_words": 50, "low": 3, "min_requests": 4, "percent": 30, "subtree": 2}

LEAST = LOW | {"max_urls": 2, "min_pages": 1, "trigger": 0, "min_words": 200, "low": 1}


def events(of: str = "trap_events", t: dict = USUAL) -> str:
    return f"""
ev AS (SELECT DISTINCT host, pattern, seq, status, simhash, n_features FROM {of} WHERE host IS NOT NULL AND pattern IS NOT NULL AND seq IS NOT NULL),
run AS (
  SELECT *, sum(CASE WHEN status BETWEEN 100 AND 599 THEN 1 ELSE 0 END) OVER w AS requests,
         sum(CASE WHEN status BETWEEN 400 AND 499 THEN 1 ELSE 0 END) OVER w AS errors,
         sum(CASE WHEN simhash IS NOT NULL THEN 1 ELSE 0 END) OVER w AS page_no,
         sum(CASE WHEN simhash IS NOT NULL AND coalesce(n_features, 0) < {t['min_words']} THEN 1 ELSE 0 END) OVER w AS low_no
  FROM ev WINDOW w AS (PARTITION BY host, pattern ORDER BY seq ROWS UNBOUNDED PRECEDING))
"""


def bans(of: str = "trap_events", t: dict = USUAL) -> str:
    """CTEs up to ``bans`` and ``subs``."""
    return f"""{events(of, t)},
pages AS (SELECT host, pattern, seq, simhash, page_no FROM run WHERE simhash IS NOT NULL AND page_no <= {t['max_urls']}),
dups AS (
  SELECT a.host, a.pattern, a.seq, count(*) AS n
  FROM pages a JOIN pages b ON a.host = b.host AND a.pattern = b.pattern AND b.seq < a.seq AND bit_count(xor(a.simhash, b.simhash)) <= {t['distance']}
  WHERE a.page_no - 1 > {t['min_pages']} GROUP BY ALL),
cand AS (
  SELECT host, pattern, seq, 0 AS prio, 'error_rate' AS reason FROM run
  WHERE status BETWEEN 100 AND 599 AND requests > {t['min_requests']} AND errors * 100 > requests * {t['percent']}
  UNION ALL SELECT host, pattern, seq, 1, 'url_cap' FROM run WHERE simhash IS NOT NULL AND page_no > {t['max_urls']}
  UNION ALL SELECT host, pattern, seq, 2, 'near_dup' FROM dups WHERE n > {t['trigger']}
  UNION ALL SELECT host, pattern, seq, 3, 'low_value' FROM run
  WHERE simhash IS NOT NULL AND coalesce(n_features, 0) < {t['min_words']} AND low_no > {t['low']}),
bans AS (SELECT host, pattern, seq, reason FROM cand QUALIFY row_number() OVER (PARTITION BY host, pattern ORDER BY seq, prio) = 1),
parts AS (SELECT host, pattern, seq, string_split(pattern, '/') AS p FROM bans),
above AS (SELECT host, pattern, seq, unnest([array_to_string(p[1:i], '/') FOR i IN range(1, len(p))]) AS subtree FROM parts),
deep AS (SELECT * FROM above WHERE length(subtree) - length(replace(subtree, '/', '')) >= 2),
subs AS (
  SELECT host, subtree, seq FROM deep QUALIFY row_number() OVER (PARTITION BY host, subtree ORDER BY seq, pattern) = {t['subtree']})
"""


REPLAY = f"""
named AS ({NORMALIZED}),
known AS (
  SELECT m.seq, regexp_replace(m.host, '^www\\.', '') AS host, m.path, m.query, coalesce(m.text, '') AS text, p.bucket_keys, p.simhash AS logged
  FROM named m JOIN pagelog p ON p.log_id = m.log_id WHERE m.ok),
unhashed AS (SELECT seq, text FROM known WHERE logged IS NULL AND text <> ''),
{simhashes("unhashed", "seq")},
replayed AS (
  SELECT k.host, unnest(CASE WHEN len(coalesce(k.bucket_keys, [])) > 0 THEN k.bucket_keys ELSE [{path_pattern("k.path")}] END) AS pattern, k.seq,
         NULL::INT AS status, coalesce({signed("k.logged")}, s.simhash) AS simhash, len({FEATURES.replace("text", "k.text")}) AS n_features,
         concat('http://', k.host, {dedup_path("k.path")}, CASE WHEN k.query = '' THEN '' ELSE concat('?', k.query) END) AS dedup_key
  FROM known k LEFT JOIN prints s ON s.seq = k.seq)
"""

#: Latin-1 where UTF-8 fails; each byte is its character. Pages in UTF-16 look like HTML only
#: without their zero bytes, so they have links but no visible text.
HTML = """
SELECT resp_id, coalesce(raw.url, url) AS base, raw.content AS c,
       coalesce(TRY(decode(raw.content)), array_to_string([chr(('0x' || substr(hex(raw.content), 2 * i + 1, 2))::INT) FOR i IN range(octet_length(raw.content))], ''), '') AS html
FROM responses"""
_HIDDEN = "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("head", "nav", "script", "style", "title", "noscript", "header", "footer", "aside"))
PAGES = f"""
checked AS ({RESPONSE_FILTER}),
pages AS (SELECT h.* FROM ({HTML}) h JOIN checked k ON k.resp_id = h.resp_id WHERE k.outcome = 'page'),
texts AS (
  SELECT resp_id, CASE WHEN regexp_matches(lower(substr(html, 1, 8192)), '<html|<body|<!doctype') THEN array_to_string([
    t FOR t IN [trim(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), chr(9) || chr(10) || chr(13) || ' ') FOR x IN string_split(regexp_replace(regexp_replace(html, '(?is){_HIDDEN}', chr(1), 'g'), '(?s)<!--.*?-->|<[!/a-zA-Z][^>]*>', chr(1), 'g'), chr(1))]
    IF t <> ''], chr(10)) ELSE '' END AS text
  FROM pages)
"""


def resolved(base: str, target: str) -> str:
    """Of absolute targets and those from the root of the site, which are all there are here."""
    root = f"concat({split(base, 1)}, '://', {split(base, 2)})"
    return f"CASE WHEN regexp_matches({target}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {target} WHEN starts_with({target}, '/') THEN concat({root}, {target}) END"


def fetch_url(u: str) -> str:
    query = clean_query(split(u, 4))
    return f"CASE WHEN {valid(u)} THEN concat(lower({split(u, 1)}), '://', {host(u)}, {split(u, 3)}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) END"


REDIRECT_TARGETS = f"""
WITH checked AS ({RESPONSE_FILTER}),
moved AS (SELECT r.resp_id, r.url, {header("location")} AS place FROM responses r JOIN checked k ON k.resp_id = r.resp_id WHERE k.outcome = 'redirect'),
met AS (SELECT resp_id, {resolved("url", "nullif(place, '')")} AS u FROM moved)
SELECT resp_id, {fetch_url("u")} AS target FROM met"""
LINKS = f"""{PAGES},
raws AS (SELECT resp_id, base, regexp_extract_all(replace(html, chr(0), ''), '(?i)<a\\s+href="\\s*([^"]+?)\\s*"', 1) AS hrefs FROM pages),
each AS (SELECT resp_id, base, unnest(range(len(hrefs))) AS spot, unnest(hrefs) AS href FROM raws),
met AS (SELECT resp_id, spot, {resolved("base", "href")} AS u FROM each),
normal AS (SELECT resp_id, spot, {fetch_url("u")} AS link FROM met),
firsts AS (SELECT resp_id, link, min(spot) AS spot FROM normal WHERE link IS NOT NULL GROUP BY 1, 2),
links AS (SELECT resp_id, row_number() OVER (PARTITION BY resp_id ORDER BY spot) - 1 AS pos, link FROM firsts)
"""


def disabled(of: str) -> str:
    return f"""off AS (
  SELECT DISTINCT q.host, q.pattern FROM {of} q JOIN bans b ON b.host = q.host AND b.pattern = q.pattern
  UNION SELECT DISTINCT q.host, q.pattern FROM {of} q JOIN subs s ON s.host = q.host AND (q.pattern = s.subtree OR starts_with(q.pattern, concat(s.subtree, '/'))))"""


STATE = f"""
hashed AS (SELECT {url_hash("url")} AS url_hash, url, seq, coalesce(completed, false) AS completed FROM frontier WHERE url IS NOT NULL AND seq IS NOT NULL),
state AS (SELECT url_hash, arg_min(url, seq) AS url, max(completed) AS completed, min(seq) AS seq FROM hashed GROUP BY url_hash)
"""


def verdicts(of: str) -> str:
    """CTEs up to ``verdict`` over url and seq of a relation; expects bans and subs."""
    bad = BAD.replace(" ", "|")
    return f"""
vn AS (SELECT url, seq, {valid("url")} AS ok, {netloc("url")} AS net, {split("url", 3)} AS path, lower({split("url", 1)}) AS scheme,
              {clean_query(split("url", 4))} AS query FROM {of}),
vf AS (
  SELECT url, seq, path, CASE WHEN ok THEN net END AS host, CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN {path_pattern("path")} END AS pattern,
         CASE WHEN ok THEN concat('http://', net, {dedup_path("path")}, CASE WHEN query = '' THEN '' ELSE concat('?', query) END) END AS dedup_key
  FROM vn),
vs AS (SELECT *, coalesce({in_scope("host")}, false) AS inside FROM vf),
vk AS (SELECT host, dedup_key, min(seq) AS first_seq FROM vs WHERE inside GROUP BY 1, 2),
vp AS (SELECT DISTINCT host, pattern FROM vs WHERE inside),
{disabled("vp")},
verdict AS (
  SELECT vs.seq, vs.url, vs.host, vs.dedup_key, vs.pattern, CASE
    WHEN NOT inside THEN 'out-of-scope' WHEN vk.first_seq IS NULL OR vk.first_seq <> vs.seq THEN 'seen' WHEN off.host IS NOT NULL THEN 'banned-bucket'
    WHEN vs.scheme NOT IN ('http', 'https') THEN 'bad-scheme'
    WHEN regexp_matches(lower(regexp_replace(vs.path, ';[^/]*$', '')), '\\.(?:{bad})$') THEN 'bad-extension' ELSE 'accept' END AS verdict
  FROM vs LEFT JOIN vk ON vk.host = vs.host AND vk.dedup_key = vs.dedup_key LEFT JOIN off ON off.host = vs.host AND off.pattern = vs.pattern)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "subdomain_counts": f"WITH {FIRST} SELECT host, count(*) AS n_pages FROM first GROUP BY host",
        "url_normalize": URL_NORMALIZE,
        "url_pattern": f"SELECT seq, {split('url', 3)} AS path, {path_pattern(split('url', 3))} AS pattern FROM frontier WHERE url IS NOT NULL",
        "url_hash": f"SELECT seq, {url_hash('url')} AS hash FROM frontier WHERE url IS NOT NULL",
        "scope_filter": f"SELECT seq, {netloc('url')} AS host FROM frontier WHERE {in_scope(netloc('url'))}",
        "admission_verdict": f"WITH {bans(t=LOW)}, {verdicts('frontier')} SELECT seq, host, dedup_key, pattern, verdict FROM verdict",
        "first_wins_dedup": f"WITH {FIRST} SELECT seq, page_key, host, url FROM first",
        "unique_pages": f"WITH {FIRST} SELECT count(*) AS n_pages FROM first",
        "longest_page": f"WITH {COUNTED} SELECT url, word_count FROM counted WHERE word_count > 0 ORDER BY word_count DESC, seq LIMIT 1",
        "largest_pages_top10": f"WITH {COUNTED} SELECT row_number() OVER (ORDER BY word_count DESC, url DESC) AS rank, url, word_count FROM counted QUALIFY rank <= 10",
        "word_counts_top50": f"WITH {FREQUENCIES} SELECT row_number() OVER (ORDER BY n DESC, f) AS rank, word, n FROM freq QUALIFY rank <= 50",
        "word_frequencies": f"WITH {FREQUENCIES} SELECT word, n FROM freq",
        "response_filter": RESPONSE_FILTER,
        "response_redirects": REDIRECT_TARGETS,
        "html_links": f"WITH {LINKS} SELECT resp_id, CAST(pos AS INT) AS pos, link FROM links",
        "html_text": f"WITH {PAGES} SELECT resp_id, text FROM texts",
        "response_events": f"""WITH {PAGES}, {simhashes("texts", "resp_id")}
SELECT {netloc("r.url")} AS host, {path_pattern(split("r.url", 3))} AS pattern, r.resp_id AS seq, r.status, p.simhash,
       CASE WHEN t.resp_id IS NOT NULL THEN len({FEATURES.replace("text", "t.text")}) END AS n_features
FROM responses r LEFT JOIN texts t ON t.resp_id = r.resp_id LEFT JOIN prints p ON p.resp_id = r.resp_id WHERE {valid("r.url")}""",
        "log_order": f"""WITH n AS ({NORMALIZED}), k AS (SELECT log_id, fetch_url, regexp_replace(host, '^www\\.', '') AS host FROM n JOIN pagelog USING (log_id) WHERE ok)
SELECT row_number() OVER (ORDER BY concat(host, '/'), log_id) - 1 AS seq, log_id, host FROM k""",
        "replay_events": f"WITH {REPLAY} SELECT host, pattern, seq, simhash, n_features, dedup_key FROM replayed",
        "low_bans": f"WITH {bans(t=LOW)} SELECT host, pattern, seq, reason FROM bans",
        "replay_bans": f"WITH {REPLAY}, {bans('replayed', LEAST)} SELECT host, pattern, seq, reason FROM bans",
        "frontier_enqueue": f"""WITH {LINKS}, {STATE},
found AS (SELECT {url_hash("link")} AS url_hash, link AS url, resp_id * 100000 + pos AS seq FROM links),
fresh AS (SELECT url_hash, arg_min(url, seq) AS url, min(seq) AS seq FROM found GROUP BY url_hash)
SELECT url_hash, url, CAST(seq AS BIGINT) AS seq FROM fresh WHERE url_hash NOT IN (SELECT url_hash FROM state)""",
        "doc_features": f"SELECT doc_id, len({FEATURES}) AS n_features, len(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS n_words FROM documents",
        "doc_simhash": f"WITH {SIMHASH} SELECT doc_id, simhash FROM prints",
        "near_dup_values": f"WITH {SIMHASH}, {near('prints')}",
        "near_dup_search": f"""WITH {SIMHASH}, v AS (SELECT simhash AS value, count(*) AS n_entries FROM prints GROUP BY 1)
SELECT p.doc_id, v.value, CAST(bit_count(xor(p.simhash, v.value)) AS INT) AS distance, v.n_entries
FROM prints p JOIN v ON bit_count(xor(p.simhash, v.value)) <= 3 WHERE p.doc_id % 20 = 0""",
        "near_dup_log_values": f"WITH {LOGGED}, {near('logged')}",
        "low_value_docs": f"SELECT doc_id, len({FEATURES}) AS n_features FROM documents WHERE len({FEATURES}) < 50",
        "running_error_rate": f"WITH {events()} SELECT host, pattern, seq, CAST(requests AS BIGINT) AS requests, CAST(errors AS BIGINT) AS errors FROM run WHERE status BETWEEN 100 AND 599",
        "pattern_bans": f"WITH {bans()} SELECT host, pattern, seq, reason FROM bans",
        "streamed_bans": f"WITH {bans()} SELECT host, pattern, seq, reason FROM bans",
        "subtree_bans": f"WITH {bans(t=LOW)} SELECT host, subtree, seq FROM subs",
        "enabled_after_bans": f"WITH {bans(t=LOW)}, q AS (SELECT DISTINCT host, pattern FROM ev), {disabled('q')} SELECT host, pattern FROM q EXCEPT SELECT host, pattern FROM off",
        "frontier_state": f"WITH {STATE} SELECT url_hash, url, completed, seq FROM state",
        "frontier_load": f"""WITH {bans(t=LOW)}, {STATE}, todo AS (SELECT * FROM state WHERE NOT completed), {verdicts("todo")}
SELECT t.url_hash, t.url, t.seq FROM todo t JOIN verdict v ON v.seq = t.seq WHERE v.verdict = 'accept'""",
        "frontier_dequeue": f"""WITH {bans(t=LOW)}, {STATE},
todo AS (SELECT *, CASE WHEN {valid("url")} THEN {netloc("url")} END AS host, {path_pattern(split("url", 3))} AS pattern FROM state WHERE NOT completed),
{disabled("todo")}
SELECT row_number() OVER (ORDER BY seq DESC) AS rank, url_hash, url, seq FROM todo
WHERE host IS NULL OR NOT EXISTS (SELECT 1 FROM off WHERE off.host = todo.host AND off.pattern = todo.pattern) QUALIFY rank <= 100""",
    }
