"""DuckDB fragments that the check queries are put together from."""

from corpuscope.functions import lexicon as lx

ATTRS = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')?)*"""
BLOCKS = (
    "address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure"
    "|footer|form|h[1-6]|header|hgroup|hr|html|li|listing|main|menu|nav|ol|p|plaintext|pre|search|section"
    "|summary|table|td|th|tr|ul"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def members(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def let(value: str, name: str, then: str) -> str:
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def block(name: str) -> str:
    return rf"<{name}(?:[\s/]{ATTRS})?>.*?</{name}\s*>"


def tag(name: str) -> str:
    return rf"(?is)<{name}(?:[\s/]{ATTRS})?>"


RAW = "(?is)<!--.*?-->|" + "|".join(block(n) for n in ("script", "style", "iframe"))
HIDDEN = "(?is)" + "|".join(block(n) for n in ("noscript", "template", "svg"))
ANY_TAG = rf"</?[a-zA-Z]{ATTRS}>|<[!?/][^>]*>"

_NAMED = "MAP {'amp': '&', 'lt': '<', 'gt': '>', 'quot': '\"', 'nbsp': chr(160), 'copy': '©', 'middot': '·', 'apos': ''''}"


def unescape(x: str) -> str:
    char = (
        f"CASE WHEN n = '' THEN NULL WHEN n ILIKE '#x%' THEN chr(CAST('0x' || n[3:] AS INT))"
        f" WHEN n LIKE '#%' THEN chr(CAST(n[2:] AS INT)) ELSE {_NAMED}[n] END"
    )
    one = let(
        "regexp_extract(p, '^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);', 1)",
        "n", f"coalesce({char} || substr(p, length(n) + 2), '&' || p)",
    )
    return let(x, "u", f"CASE WHEN contains(u, '&') THEN string_split(u, '&')[1] || array_to_string(list_transform(string_split(u, '&')[2:], lambda p: {one}), '') ELSE u END")


def trim(x: str) -> str:
    return rf"regexp_replace(replace({x}, chr(160), ' '), '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(replace({x}, chr(160), ' '), '\s+', ' ', 'g'))"


def text_of(x: str) -> str:
    return squeeze(unescape(f"regexp_replace({x}, {q(ANY_TAG)}, '', 'g')"))


def attr(t: str, name: str) -> str:
    pair = q(r"""([^\s=>"'/<]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
    raw = let(
        t, "g",
        f"regexp_extract_all(g, {pair}, 2)[nullif(list_position(list_transform(regexp_extract_all(g, {pair}, 1), lambda k: lower(k)), {q(name)}), 0)]",
    )
    return unescape(f"regexp_replace({raw}, {q(chr(94) + '[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$')}, '', 'g')")


def attr_text(t: str, name: str) -> str:
    return f"nullif({trim(attr(t, name))}, '')"


# ---- URLs -------------------------------------------------------------------------------

def scheme(x):
    return f"lower(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1))"


def authority(x):
    return f"lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def host(x):
    return rf"regexp_replace(regexp_replace({authority(x)}, '^.*@', ''), ':\d*$', '')"


def bare_host(x):
    return rf"regexp_replace({host(x)}, '^www\.', '')"


def origin(x):
    return rf"regexp_replace({scheme(x)} || '://' || regexp_replace({authority(x)}, '^.*@', ''), '^(http://[^/?#]*):80$|^(https://[^/?#]*):443$', '\1\2')"


def path(x):
    return f"coalesce(nullif(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"


def query(x):
    return rf"regexp_extract({x}, '^[^?#]*(\?[^#]*)', 1)"


def fragment(x):
    return f"regexp_extract({x}, '^[^#]*(#.*)$', 1)"


def clean_path(x):
    dots = rf"""CASE WHEN regexp_matches(v, '/\.\.?(/|$)') THEN array_to_string(list_reduce(string_split(regexp_replace(v, '(/\.\.?)$', '\1/'), '/'),
      lambda acc, s: CASE WHEN s = '..' THEN CASE WHEN len(acc) > 1 THEN acc[:-2] ELSE acc END WHEN s = '.' THEN acc ELSE list_append(acc, s) END, CAST([] AS VARCHAR[])), '/') ELSE v END"""
    coded = "array_to_string(list_transform(string_split(w, ''), lambda ch: CASE WHEN ch IN (' ', '\"', '<', '>', '`', '{', '}') OR ord(ch) > 127 THEN url_encode(ch) ELSE ch END), '')"
    return let(let(x, "v", dots), "w", coded)


def resolve(href, base):
    joined = (
        f"CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN {href} LIKE '//%' THEN {scheme(base)} || ':' || {href}"
        f" WHEN {href} LIKE '/%' THEN {origin(base)} || {href} WHEN {href} LIKE '?%' THEN {origin(base)} || {path(base)} || {href}"
        f" WHEN {href} LIKE '#%' THEN {origin(base)} || {path(base)} || {query(base)} || {href}"
        f" ELSE {origin(base)} || regexp_replace({path(base)}, '[^/]*$', '') || {href} END"
    )
    tidy = f"{origin('r')} || {clean_path(path('r'))} || {query('r')} || {fragment('r')}"
    return let(joined, "r", f"CASE WHEN {scheme('r')} NOT IN ('http', 'https') THEN r WHEN {host('r')} <> '' THEN {tidy} END")


def url_key(x):
    return f"lower({origin(x)} || coalesce(nullif(regexp_replace({path(x)}, '/+$', ''), ''), '/'))"


def role(p, title, h1):
    whens = []
    for name, pattern in lx.ROLE_PATTERNS:
        test = f"regexp_matches({p}, {q(pattern)})"
        if name == "FAQ":
            test += f" OR contains({p} || ' ' || lower(coalesce({title}, '')) || ' ' || lower(array_to_string({h1}, ' ')), 'faq')"
        whens.append(f"WHEN {test} THEN {q(name)}")
    return f"CASE WHEN {p} IN ('/', '') THEN 'HOME' {' '.join(whens)} ELSE 'OTHER' END"


def priority(x):
    p = f"lower({path(x)})"
    whens = " ".join(f"WHEN regexp_matches({p}, {q(pat)}) THEN {n}" for n, pat in lx.CRAWL_PRIORITY_PATTERNS)
    return f"CASE WHEN {p} = '/' THEN 0 {whens} ELSE 11 + least(8, len(list_filter(string_split({p}, '/'), lambda s: s <> ''))) END"


def half_up(x):
    return f"CAST(floor({x} + 0.5) AS BIGINT)"
