"""Built-in expressions that read markup: tags, attributes, entities, text (as SQL text).

Everything stays inside the JVM.  The patterns use possessive quantifiers, so neither a missing
quote nor a very long tag makes them backtrack or recurse.  The engine tries a pattern at every
character of a page: what all alternatives start with stands before them, so that most characters cost one test.
"""

from html.entities import name2codepoint

from corpuscope.functions.sqltext import concat, each, first, keep, let, q, rx, tail

WORD_START = r"(?i)\b"

# Inside a tag: anything up to ">", where a quoted value right after "=" may itself hold ">".
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
ANY_TAG = rf"<(?:/?[a-zA-Z]{ATTRS}>|[!?/][^>]*>)"


def tag(name: str) -> str:
    """Pattern of one start tag."""
    return rf"(?is)<{name}(?:[\s/]{ATTRS})?>"


def _element(name: str) -> str:
    """An element without its first "<"."""
    return rf"{name}(?:[\s/]{ATTRS})?>.*?</{name}\s*>"


RAW_BLOCKS = "(?is)<(?:!--.*?-->|" + "|".join(_element(n) for n in ("script", "style", "iframe")) + ")"
HIDDEN_BLOCKS = "(?is)<(?:" + "|".join(_element(n) for n in ("noscript", "template", "svg")) + ")"
SCRIPTS = "(?is)<(?:!--.*?-->|" + _element("script") + ")"
# A new one of these, or the end of one, also ends an open paragraph.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset"
    "|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|listing|main|menu|nav|ol|p"
    "|plaintext|pre|search|section|summary|table|td|th|tr|ul"
)

# White space as a browser counts it: more than the ASCII characters of the regex engine's own class.
# The outer class turns down letters before the long one is tried.
_WIDE = "".join(f"\\u{n:04x}" for n in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
SPACE_NOT_BLANK = rf"[\x00-\x1f\x7f-\uffff&&[\t\n\x0b\f\r\xa0{_WIDE}]]"
SPACE = rf"[\x00-\x20\x7f-\uffff&&[ \t\n\x0b\f\r\xa0{_WIDE}]]"
_ASCII_BLANKS = " \t\n\x0b\f\r"
_BLANKS = " \t\n\x0b\f\r\xa0" + _WIDE.encode().decode("unicode_escape")  # the characters of SPACE
_ATTR = r"""[^\s=>"'/<]++\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]+)"""


def matches(c: str, pattern: str) -> str:
    return f"rlike({c}, {rx(pattern)})"


def matches_word(c: str, starts: str, pattern: str) -> str:
    """``matches`` for ``(?i)\\b`` and a rest that starts with one of the word characters ``starts``: the rest is tried once
    for each word, and words are passed in runs."""
    hit = f"(?=[{starts}])(?:{pattern.removeprefix(WORD_START)})"
    return matches(c, rf"(?i)^\W*+(?:(?!{hit})\w++\W*+)*+{hit}")


def count_matches(c: str, pattern: str) -> str:
    return f"regexp_count({c}, {rx(pattern)})"


def extract(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({c}, {rx(pattern)}, {group})"


def extract_all(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, {rx(pattern)}, {group})"


def replace(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {rx(pattern)}, {q(by)})"


def blank_to_null(c: str) -> str:
    return f"nullif({c}, '')"


def trim_ws(c: str) -> str:
    return f"trim(BOTH {q(_BLANKS)} FROM {c})"


def squeeze(c: str) -> str:
    """Collapse runs of white space and trim."""
    return f"trim({replace(c, f'(?:{SPACE_NOT_BLANK}| (?={SPACE})){SPACE}*+', ' ')})"  # a lone blank stays as it is


def entity_table() -> dict[str, str]:
    """Character references: HTML 4 names from the standard library, and the windows-1252
    reading of numeric references 128-159."""
    often = ["amp", "quot", "lt", "gt", "nbsp", "copy", "middot"]
    table = {n: chr(name2codepoint[n]) for n in often}
    table["apos"] = "'"
    for n in range(0x80, 0xA0):
        try:
            table[f"#{n}"] = table[f"#x{n:x}"] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    for n, cp in name2codepoint.items():
        table.setdefault(n, chr(cp))
    return table


_PACKED = "\u0002".join(f"{name}\u0001{char}" for name, char in entity_table().items())
ENTITIES = f"str_to_map({q(_PACKED)}, '\u0002', '\u0001')"  # folded to a constant


def _char_of(code_point: str) -> str:
    def usable(cp):
        ok = f"{cp} BETWEEN 1 AND 1114111 AND NOT {cp} BETWEEN 55296 AND 57343"
        return f"hex(CASE WHEN {ok} THEN {cp} ELSE 65533L END)"

    return f"decode(unhex(lpad({let(code_point, usable)}, 8, '0')), 'UTF-32')"


def unescape(c: str) -> str:
    """Decode character references in one pass (so ``&amp;lt;`` becomes ``&lt;``)."""

    def char(n):
        return (
            f"CASE WHEN startswith({n}, '#') THEN coalesce(try_element_at({ENTITIES}, lower({n})),"
            f" CASE WHEN startswith(lower({n}), '#x') THEN {_char_of(f'CAST(conv(substr({n}, 3), 16, 10) AS BIGINT)')}"
            f" ELSE {_char_of(f'try_cast(substr({n}, 2) AS BIGINT)')} END)"
            f" WHEN {n} <> '' THEN try_element_at({ENTITIES}, {n}) END"
        )

    def piece(p):
        name = extract(p, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        return let(name, lambda n: f"coalesce({concat(char(n), f'substr({p}, length({n}) + 2)')}, concat('&', {p}))")

    def joined(parts):
        return concat(first(parts), f"array_join({each(tail(parts), piece)}, '')")

    split = lambda v: let(f"split({v}, '&')", joined)
    return let(c, lambda v: f"CASE WHEN contains({v}, '&') THEN {split(v)} ELSE {v} END")


def strip_tags(c: str) -> str:
    return let(c, lambda v: f"CASE WHEN contains({v}, '<') THEN {replace(v, ANY_TAG)} ELSE {v} END")


def text_of(c: str) -> str:
    """Visible text of a fragment: tags removed, references decoded, white space squeezed."""
    return squeeze(unescape(strip_tags(c)))


def _value(found: str, name: str) -> str:
    """Value of the first attribute called ``name`` of those found, without its quotes."""
    def bare(v):
        quoted = " OR ".join(f"(startswith({v}, {q(mark)}) AND endswith({v}, {q(mark)}))" for mark in ('"', "'"))
        return f"CASE WHEN length({v}) > 1 AND ({quoted}) THEN substr({v}, 2, length({v}) - 2) ELSE {v} END"

    named = first(keep(found, lambda a: f"{a}.n = {q(name)}")) + ".a"
    return let(named, lambda a: let(f"ltrim({q(_ASCII_BLANKS)}, substr({a}, instr({a}, '=') + 1))", bare))


def _attributes(t: str) -> str:
    """Attributes of a tag as they stand, each with its name in lower case; no name holds "=" and no value starts with a blank."""
    return each(extract_all(t, _ATTR), lambda a: f"named_struct('a', {a}, 'n', lower(rtrim({q(_ASCII_BLANKS)}, substring_index({a}, '=', 1))))")


def attr(tag_text: str, name: str) -> str:
    """Value of the first attribute called ``name``, decoded; null when the tag has none."""

    def read(t):
        return f"CASE WHEN contains(lower({t}), {q(name)}) THEN {let(_attributes(t), lambda a: _value(a, name))} END"

    return unescape(let(tag_text, read))


def attrs(tag_text: str, fields: dict[str, str]) -> str:
    """Struct of several attributes (field -> name), as ``attr`` reads each; the tag is taken apart once."""
    return let(_attributes(tag_text), lambda p: "named_struct(" + ", ".join(f"{q(k)}, {unescape(_value(p, a))}" for k, a in fields.items()) + ")")


def attr_text(tag_text: str, name: str) -> str:
    """Attribute trimmed, null when blank."""
    return blank_to_null(trim_ws(attr(tag_text, name)))
