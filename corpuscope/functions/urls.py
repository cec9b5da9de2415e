"""URL expressions: parse, resolve, normalise, classify (as SQL text)."""

from corpuscope.functions import lexicon as lx
from corpuscope.functions.html import blank_to_null, extract, matches, replace, trim_ws
from corpuscope.functions.sqltext import concat, each, fn, keep, let, listed, q

ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
# A reference to a path of the same origin that needs no change: no empty or dotted segments, nothing to encode.
_PLAIN = r"^/(?![/?#])" + r"(?:[a-zA-Z0-9_~!$&'()*+,;=:@%-][a-zA-Z0-9._~!$&'()*+,;=:@%-]*+(?:/(?![/.]))?+)*+(?:[?#][!-~]*+)?+\z"
_DEFAULT_PORT = r"^(http://[^/?#]*):80$|^(https://[^/?#]*):443$"


def scheme(url: str) -> str:
    return f"lower({extract(url, r'^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)})"


def authority(url: str) -> str:
    return f"lower({extract(url, _AUTHORITY, 1)})"


def host(url: str) -> str:
    """Lower-cased host name without user info and port; '' when there is none."""
    return replace(replace(authority(url), r"^.*@"), r":\d*$")


def bare_host(url: str) -> str:
    """Host without a leading ``www.`` - the key we group sites by."""
    return replace(host(url), r"^www\.")


def origin(url: str) -> str:
    return replace(concat(scheme(url), "'://'", replace(authority(url), r"^.*@")), _DEFAULT_PORT, "$1$2")


def path(url: str) -> str:
    """Path, '/' when empty."""
    return f"coalesce({blank_to_null(extract(url, _PATH, 1))}, '/')"


def query(url: str) -> str:
    """Query with its '?', '' when absent."""
    return extract(url, r"^[^?#]*(\?[^#]*)", 1)


def fragment(url: str) -> str:
    return extract(url, r"^[^#]*(#.*)$", 1)


def encode_path(p: str) -> str:
    """Percent-encode what a browser would encode inside a path."""
    out = p
    for plain, coded in [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"),
                         ("{", "%7B"), ("}", "%7D")]:
        out = f"replace({out}, {q(plain)}, {q(coded)})"
    wide = r"[^\x00-\x7f]"

    def coded_chars(v):
        one = lambda ch: f"CASE WHEN {matches(ch, wide)} THEN url_encode({ch}) ELSE {ch} END"
        return f"CASE WHEN {matches(v, wide)} THEN array_join({each(f"split({v}, '')", one)}, '') ELSE {v} END"

    return let(out, coded_chars)


def drop_dots(p: str) -> str:
    """Resolve '.' and '..' segments of an absolute path."""

    def without_dots(v):
        segments = f"split({replace(v, r'/\.\.?$', '$0/')}, '/')"
        step = (
            "(acc, s) -> CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, least(size(acc), 1)))"
            " WHEN s = '.' THEN acc ELSE concat(acc, array(s)) END"
        )
        kept = f"aggregate({segments}, CAST(array() AS ARRAY<STRING>), {step})"
        return f"CASE WHEN {matches(v, r'/\.\.?(/|$)')} THEN array_join({kept}, '/') ELSE {v} END"

    return let(p, without_dots)


def base_parts(base: str) -> str:
    """What ``resolve_on`` needs of a page's URL."""
    return (
        f"named_struct('scheme', {scheme(base)}, 'origin', {origin(base)}, 'path', {path(base)}, 'query', {query(base)},"
        f" 'host', {bare_host(base)})"
    )


def is_plain(href: str, base: str) -> str:
    """Whether ``href`` is a path that stands as it is behind the origin of a page with these ``base_parts``."""
    return f"({base}.scheme IN ('http', 'https') AND {base}.host <> '' AND NOT contains({base}.host, ':') AND {matches(href, _PLAIN)})"


def resolve_on(href: str, base: str) -> str:
    """Absolute form of ``href`` on a page with these ``base_parts``, as a browser prints it: lower-cased origin,
    no default port, a path, no dot segments, encoded characters; null when it cannot be read."""

    def joined(ref):
        return (
            f"CASE WHEN {matches(ref, ABSOLUTE)} THEN {ref}"
            f" WHEN startswith({ref}, '//') THEN {concat(f'{base}.scheme', q(':'), ref)}"
            f" WHEN startswith({ref}, '/') THEN {concat(f'{base}.origin', ref)}"
            f" WHEN startswith({ref}, '?') THEN {concat(f'{base}.origin', f'{base}.path', ref)}"
            f" WHEN startswith({ref}, '#') THEN {concat(f'{base}.origin', f'{base}.path', f'{base}.query', ref)}"
            f" ELSE {concat(f'{base}.origin', replace(f'{base}.path', '[^/]*$'), ref)} END"
        )

    def tidy(p):
        at = replace(concat(f"{p}.scheme", "'://'", f"{p}.at"), _DEFAULT_PORT, "$1$2")
        whole = concat(at, encode_path(drop_dots(path(f"{p}.url"))), query(f"{p}.url"), fragment(f"{p}.url"))
        named = f"{replace(f'{p}.at', r':\d*$')} <> ''"  # a host
        return f"CASE WHEN {p}.scheme NOT IN ('http', 'https') THEN {p}.url WHEN {named} THEN {whole} END"

    parts = let(let(href, joined), lambda v: f"named_struct('url', {v}, 'scheme', {scheme(v)}, 'at', {replace(authority(v), r'^.*@')})")
    return let(parts, tidy)


def resolve(href: str, base: str) -> str:
    """``resolve_on`` for a single reference."""
    return let(base_parts(base), lambda b: resolve_on(href, b))


def key(url: str) -> str:
    """Identity of a page: lower-cased origin and path, no trailing slashes, query or fragment."""
    trimmed = blank_to_null(replace(path(url), r"/+$"))
    return f"lower({concat(origin(url), f'coalesce({trimmed}, {q(chr(47))})')})"


def with_scheme(raw: str) -> str:
    """Trimmed input, https assumed when no scheme is given."""
    return let(
        trim_ws(f"coalesce({raw}, '')"),
        lambda t: f"CASE WHEN {matches(t, ABSOLUTE)} THEN {t} ELSE concat('https://', {t}) END",
    )


def kept_query(query_text: str) -> str:
    """Query re-printed without tracking parameters."""
    kept = keep(
        f"split(substr({query_text}, 2), '&')",
        lambda p: f"{p} <> '' AND substring_index({p}, '=', 1) NOT IN {listed(lx.TRACKING_PARAMS)}",
    )
    printed = each(kept, lambda p: f"replace(CASE WHEN contains({p}, '=') THEN {p} ELSE concat({p}, '=') END, '%20', '+')")
    return let(f"array_join({printed}, '&')", lambda v: f"CASE WHEN {v} <> '' THEN concat('?', {v}) ELSE '' END")


def normalize(raw: str) -> str:
    """Printed form without tracking parameters and fragment."""
    return let(with_scheme(raw), lambda v: concat(origin(v), encode_path(drop_dots(path(v))), kept_query(query(v))))


# ---- addresses --------------------------------------------------------------------------

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_V4_TAIL = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def ipv4_number(ip: str) -> str:
    parts = each(f"split({ip}, '[.]')", lambda x: f"try_cast({x} AS BIGINT)")
    return f"CASE WHEN {matches(ip, IPV4)} THEN aggregate({parts}, 0L, (acc, x) -> acc * 256 + x) END"


def cidr_bounds(cidr: str) -> tuple[int, int]:
    net, bits = cidr.split("/")
    n = 0
    for part in net.split("."):
        n = n * 256 + int(part)
    size = 1 << (32 - int(bits))
    lo = n - n % size
    return lo, lo + size - 1


def ip_version(ip: str) -> str:
    """4, 6 or 0."""

    def six(z):
        t = extract(z, _V4_TAIL)
        bad = fn(lambda g: f"{g} <> '' AND NOT {matches(g, r'^[0-9a-f]{1,4}$')}")
        return (
            f"regexp_count({z}, '::') <= 1 AND ({t} = '' OR {matches(t, IPV4)})"
            f" AND NOT exists(split({replace(z, _V4_TAIL)}, ':'), {bad})"
        )

    zone_free = f"lower(substring_index({ip}, '%', 1))"
    return f"CASE WHEN {matches(ip, IPV4)} THEN 4 WHEN contains({ip}, ':') AND {let(zone_free, six)} THEN 6 ELSE 0 END"


def classify_v4(ip: str) -> str:
    """Rejection code of an IPv4 literal, null when it is public."""

    def by_range(n):
        whens = " ".join(
            f"WHEN {n} BETWEEN {cidr_bounds(c)[0]}L AND {cidr_bounds(c)[1]}L THEN {q(code)}" for c, code in lx.BLOCKED_V4_CIDRS
        )
        return f"CASE {whens} END"

    return f"CASE WHEN {ip} IN {listed(lx.METADATA_ADDRESSES_V4)} THEN 'METADATA_ENDPOINT' ELSE {let(ipv4_number(ip), by_range)} END"


def classify_v6(ip: str) -> str:
    """Rejection code of an IPv6 literal, null when it is public."""

    def code(v):
        embedded = extract(v, _V4_TAIL)
        return (
            f"CASE WHEN {v} IN {listed(lx.METADATA_ADDRESSES_V6)} THEN 'METADATA_ENDPOINT'"
            f" WHEN {v} IN ('::', '::1') THEN 'LOOPBACK_ADDRESS'"
            f" WHEN startswith({v}, '::') AND {embedded} <> '' THEN {let(embedded, classify_v4)}"
            f" WHEN {matches(v, r'^(fe80|fe9|fea|feb)')} THEN 'LINK_LOCAL_ADDRESS'"
            f" WHEN {matches(v, r'^(fc|fd|ff)')} THEN 'PRIVATE_ADDRESS' END"
        )

    return let(f"lower(substring_index({replace(ip, r'^\[|\]$')}, '%', 1))", code)


def registrable_domain(hostname: str) -> str:
    """Last two labels, or three under a two-label public suffix; addresses stay whole."""

    def cut(h):
        labels = f"split({h}, '[.]')"
        return (
            f"CASE WHEN size({labels}) <= 2 OR {ip_version(h)} <> 0 THEN {h}"
            f" WHEN get({labels}, size({labels}) - 2) IN {listed(lx.SECOND_LEVEL_SUFFIXES)} THEN substring_index({h}, '.', -3)"
            f" ELSE substring_index({h}, '.', -2) END"
        )

    return let(replace(replace(f"lower({hostname})", r"^\[|\]$"), r"^www\."), cut)


def _host_rules(u: str, hostport: str) -> str:
    port = f"try_cast({extract(hostport, r':(\d*)$', 1)} AS BIGINT)"
    name = replace(replace(hostport, r":\d*$"), r"\.$")

    def rules(p):
        literal = replace(f"{p}.name", r"^\[|\]$")
        suffix = " OR ".join(f"endswith({p}.name, {q(s)})" for s in lx.BLOCKED_SUFFIXES)
        by_address = let(
            f"named_struct('ip', {literal}, 'v', {ip_version(literal)})",
            lambda a: f"CASE WHEN {a}.v = 4 THEN {classify_v4(f'{a}.ip')} WHEN {a}.v = 6 THEN {classify_v6(f'{a}.ip')}"
            f" WHEN {p}.name IN {listed(lx.BLOCKED_HOSTNAMES)} OR {suffix} OR NOT contains({p}.name, '.') THEN 'BLOCKED_HOSTNAME' END",
        )
        default = f"{p}.port = CASE WHEN {scheme(u)} = 'http' THEN 80 ELSE 443 END"
        by_port = f"CASE WHEN {p}.port = 0 OR (NOT {default} AND {p}.port IN {listed(lx.BLOCKED_PORTS)}) THEN 'BLOCKED_PORT' END"
        broken = (
            f"{p}.name = '' OR {matches(f'{p}.name', r'[\s<>\\^`{|}%]')}"
            f" OR (contains({p}.name, ':') AND NOT startswith({p}.name, '[')) OR coalesce({p}.port, 0) > 65535"
        )
        who = extract(authority(u), r"^(.*)@", 1)
        return (
            f"CASE WHEN {broken} THEN 'MALFORMED' WHEN {who} NOT IN ('', ':') THEN 'CREDENTIALS_IN_URL'"
            f" ELSE coalesce({by_address}, {by_port}) END"
        )

    return let(f"named_struct('name', {name}, 'port', {port})", rules)


def rejection_code(raw: str) -> str:
    """First rule an address breaks, null when it may be audited."""

    def rules(v):
        return (
            f"CASE WHEN {scheme(v)} NOT IN ('http', 'https') THEN 'UNSUPPORTED_SCHEME'"
            f" ELSE {let(replace(authority(v), r'^.*@'), lambda hp: _host_rules(v, hp))} END"
        )

    blank = trim_ws(f"coalesce({raw}, '')")
    return f"CASE WHEN {blank} = '' THEN 'EMPTY' ELSE {let(with_scheme(raw), rules)} END"


# ---- what a page is ---------------------------------------------------------------------


def page_role(lower_path: str, title: str, h1: str) -> str:
    """Role of a page from its path; an 'faq' in title or main headings also counts."""
    hay = f"concat_ws(' ', {lower_path}, lower(coalesce({title}, '')), lower(array_join({h1}, ' ')))"

    def chain(p):
        whens = []
        for role, pattern in lx.ROLE_PATTERNS:
            hit = matches(p, pattern)
            if role == "FAQ":
                hit = f"{hit} OR contains({hay}, 'faq')"
            whens.append(f"WHEN {hit} THEN {q(role)}")
        return f"CASE WHEN {p} IN ('/', '') THEN 'HOME' {' '.join(whens)} ELSE 'OTHER' END"

    return let(lower_path, chain)


def crawl_priority(url: str) -> str:
    """0 home ... 10 article, deeper pages later."""

    def chain(p):
        whens = " ".join(f"WHEN {matches(p, pattern)} THEN {rank}" for rank, pattern in lx.CRAWL_PRIORITY_PATTERNS)
        depth = f"size({keep(f'split({p}, {q(chr(47))})', lambda s: f'{s} <> {q(str())}')})"
        return f"CASE WHEN {p} IN ('/', '') THEN 0 {whens} ELSE 11 + least(8, {depth}) END"

    return let(f"lower({path(url)})", chain)
