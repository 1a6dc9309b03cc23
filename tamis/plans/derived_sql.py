"""The derived tables and common expressions in SQL."""

from __future__ import annotations

from tamis.functions import normalize
from tamis.sources import derived


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A rule's pattern as a literal for an engine that folds case by Unicode anyway."""
    return lit(pattern.replace("(?iu)", "(?i)"))


def pick(items: list[str], index: str) -> str:
    return f"([{', '.join(map(lit, items))}])[1 + CAST(({index}) % {len(items)} AS INT)]"


def fill(c: str, n: str, m: str | None = None) -> str:
    c = f"replace({c}, '{{n}}', CAST({n} AS VARCHAR))"
    return c if m is None else f"replace({c}, '{{m}}', CAST({m} AS VARCHAR))"


INBOX = f"inbox AS (SELECT * REPLACE (coalesce(text, '') || chr(10) || {pick(derived.PHRASES, 'doc_id')} AS text) FROM documents)"
NOTICES = f"notices AS (SELECT * REPLACE (coalesce(text, '') || chr(10) || {pick(derived.NOTICES, 'doc_id')} AS text) FROM documents)"
VAULT = f"vault AS (SELECT * REPLACE (coalesce(text, '') || chr(10) || {fill(pick(derived.CREDENTIALS, 'doc_id'), 'doc_id % 10')} AS text) FROM documents)"
COMMANDS = f"commands AS (SELECT event_id, user_id, ts, {fill(pick(derived.COMMANDS, 'event_id'), 'user_id')} AS command, {fill(pick(derived.PATHS, 'event_id'), 'user_id')} AS path, {fill(pick(derived.ADDRESSES, 'event_id'), 'user_id')} AS url FROM events)"
_KIND = pick([k for k, _ in derived.SNIPPETS], "doc_id")
FILES = f"""files AS (SELECT 'src/d' || (doc_id // 64) || '/' || CASE WHEN {_KIND} = 'env' THEN '.env.' || doc_id ELSE 'f' || doc_id || '.' || {_KIND} END AS path,
{fill(pick([s for _, s in derived.SNIPPETS], 'doc_id'), 'doc_id', 'greatest(doc_id - doc_id % 8 + 1, 0)')} AS content, make_timestamp((1700000000 + (doc_id * 7919) % 20000000) * 1000000) AS mtime FROM documents)"""
_AT = "(conv_id * 7 + turn)"
TRANSCRIPTS = f"""transcripts AS (SELECT * REPLACE (concat_ws(chr(10), coalesce(text, ''), CASE role WHEN 'user' THEN {pick(derived.USER_SAYS, _AT)} WHEN 'assistant' THEN {pick(derived.ASSISTANT_SAYS, _AT)} ELSE '' END) AS text),
CASE WHEN role = 'assistant' THEN list_transform(list_slice([{', '.join(map(lit, derived.TOOLS))}], {_AT} % 4 + 1, {_AT} % 4 + {_AT} % 3), lambda t: {{'name': t, 'path': '/work/p' || (conv_id % 5) || '/src/a' || ({_AT} % 6) || {pick(['.ts', '.py', '.md'], _AT)}, 'result': CASE WHEN {_AT} % 5 = 0 THEN 'Error: exit code 1' ELSE 'ok' END}}) ELSE [] END AS calls FROM conversations)"""


def _shown(c: str) -> str:
    """The native steps before white space."""
    c = f"regexp_replace({c}, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2069}}\\x{{FEFF}}\\x{{202A}}-\\x{{202E}}]', '', 'g')"
    c = f"translate({c}, '{''.join(normalize.LOOK_ALIKES)}', '{''.join(normalize.LOOK_ALIKES.values())}')"
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    return f"translate({c}, {lit(wide)}, {lit(narrow)})"


def _blanks(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '[ \\t\\r\\f\\x0B]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def normalized(c: str) -> str:
    """The native normalisation steps."""
    return _blanks(_shown(c))


def decoded(c: str) -> str:
    """Those steps, and letters for the digits and signs that stand for them; nothing else is coded in these tables."""
    word = "regexp_extract(w, '^[@$|!]*(.*?)[@$|!]*$', 1)"
    swapped = f"regexp_extract(w, '^[@$|!]*') || translate({word}, '01345789@$|!', 'oieastbgasli') || regexp_extract(w, '[@$|!]*$')"
    each = f"CASE WHEN length({word}) >= 3 AND regexp_matches({word}, '[a-zA-Z]') AND regexp_matches({word}, '[0-9@$|!]') THEN {swapped} ELSE w END"
    return _blanks(f"array_to_string(list_transform(regexp_extract_all({_shown(c)}, '[a-zA-Z0-9@$|!]+|[^a-zA-Z0-9@$|!]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-zA-Z0-9@$|!]') THEN {each} ELSE w END), '')")


def words(c: str) -> str:
    """tokens() in SQL."""
    from tamis.functions import text as tx

    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z가-힣0-9 \\t\\n\\r\\f-]', ' ', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 1 AND NOT list_contains([{stop}], w))"
