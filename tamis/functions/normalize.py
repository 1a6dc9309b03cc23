"""Normalisation of text before it is scanned: invisible characters, look-alikes, full width, white space. Native."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters and what they look like. Fixed values.
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "і": "i", "ј": "j", "һ": "h", "ѕ": "s", "ї": "i", "х": "x", "К": "K", "А": "A", "В": "B", "Е": "E", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "З": "3", "Ч": "4"}
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{2060}-\\x{2069}\\x{FEFF}\\x{202A}-\\x{202E}]"


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def fold_look_alikes(c: Column) -> Column:
    return F.translate(c, "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))


def to_half_width(c: Column) -> Column:
    """Full-width forms of ASCII to ASCII."""
    return F.translate(c, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks to one blank, three line ends or more to two."""
    return F.regexp_replace(F.regexp_replace(c, "[ \\t\\r\\f\\x0B]{2,}", " "), "\\n{3,}", "\n\n")


STEPS = {"invisible": strip_invisible, "look_alikes": fold_look_alikes, "full_width": to_half_width, "blanks": collapse_blanks}


def normalized(c: str) -> tuple[Column, Column]:
    """(text after all steps, names of the steps that changed it)."""
    at, changed = F.coalesce(F.col(c), F.lit("")), []
    for name, step in STEPS.items():
        after = step(at)
        changed.append(F.when(after != at, F.lit(name)))
        at = after
    return at, F.array_compact(F.array(*changed))


def trigrams(word: Column) -> Column:
    """Character trigrams of a word padded with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(word), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of trigrams; 1 for equal words, 0 where either has fewer than three characters."""
    both, either = F.size(F.array_intersect(trigrams(a), trigrams(b))), F.size(F.array_union(trigrams(a), trigrams(b)))
    return F.when(a == b, 1.0).when((F.length(a) < 3) | (F.length(b) < 3), 0.0).otherwise(both / either)


#: Named entities that hide text. Fixed values.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "tab": "\t", "newline": "\n", "colon": ":", "semi": ";", "lpar": "(", "rpar": ")", "lsqb": "[", "rsqb": "]", "lcub": "{", "rcub": "}", "sol": "/", "bsol": "\\", "equals": "=", "plus": "+", "minus": "-", "excl": "!", "num": "#", "percnt": "%", "commat": "@", "hat": "^", "lowbar": "_", "grave": "`", "tilde": "~", "period": ".", "comma": ","}
#: Digits and signs that stand for letters. Fixed values.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l", "!": "i"})
#: What a text must hold for one of the steps that Python does. A text without it never leaves the JVM's side of the plan.
HIDDEN = "[A-Za-z0-9+/]{16}|\\\\[xu]|&[#A-Za-z]|[A-Za-z][0-9@$|!]|[0-9@$|!][A-Za-z]"


_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ").__contains__


def _base64(text: str) -> str:
    def one(m):
        raw = m.group(0)
        try:
            out = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode("utf-8")
        except ValueError:
            return raw
        return out if re.fullmatch(r"[\x20-\x7E\t\n\r]+", out) else raw

    return re.sub(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,}={0,2}(?![A-Za-z0-9+/=])", one, text)


def _code_points(text: str, pattern: str, least: int = 0) -> str:
    def one(m):
        digits = next(g for g in m.groups() if g is not None)
        n = int(digits, 10 if len(m.groups()) > 1 and m.group(2) is not None else 16)
        return chr(n) if least <= n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else m.group(0)

    return re.sub(pattern, one, text)


def _entities(text: str) -> str:
    if "&" not in text:
        return text
    named = re.sub("&(" + "|".join(ENTITIES) + ");", lambda m: ENTITIES[m.group(1).lower()], text, flags=re.I)
    return _code_points(named, r"&#x([0-9A-Fa-f]{1,6});|&#(\d{1,7});", 1)


_SIGNS = re.compile("[0-9@$|!]+")
_MIXED = re.compile("[a-zA-Z0-9@$|!]*")
_WORD = re.compile(r"\b[a-zA-Z0-9@$|!]{3,}\b", re.A)


def _leet(text: str) -> str:
    def one(m):
        word = m.group(0)
        return word.translate(LEET) if re.search("[a-zA-Z]", word) and re.search("[0-9@$|!]", word) else word

    out, done, known = [], 0, -1
    # only stretches in which a sign stands beside a letter can hold a word of both; they are read with what is around them
    for m in _SIGNS.finditer(text):
        a, b = m.span()
        if a < known or not (_LETTER(text[a - 1 : a]) or _LETTER(text[b : b + 1])):
            continue
        known = _MIXED.match(text, b).end()
        while a > done and (_LETTER(text[a - 1]) or text[a - 1] in "0123456789@$|!"):
            a -= 1
        before, after = max(a - 1, 0), min(known + 1, len(text))
        stretch = text[before:after]
        changed = _WORD.sub(one, stretch)
        if changed != stretch:
            out += [text[done:before], changed[: len(changed) - (after - known)]]
            done = known
    return "".join([*out, text[done:]]) if out else text


#: Steps that need a function for each match, in order, between the first and the other native steps.
_DECODED = [("base64", _base64), ("hex_escapes", lambda t: _code_points(t, r"\\x([0-9A-Fa-f]{2})")), ("unicode_escapes", lambda t: _code_points(t, r"\\u\{?([0-9A-Fa-f]{1,6})\}?")), ("entities", _entities)]


#: Texts that become Python strings at a time.
_ROWS = 64


def _in_order(c: Column, steps) -> Column:
    """(text, changed) after the steps, for the texts that may hold something for them; text is null where nothing changed,
    so that a batch holds no second copy of its texts."""

    @F.arrow_udf("text string, changed array<string>")
    def run(texts):
        import pyarrow as pa

        out, changed = [], []
        for first in range(0, len(texts), _ROWS):
            for text in texts.slice(first, _ROWS).to_pylist():
                done = []
                for name, step in steps if text is not None else ():
                    after = step(text)
                    if after != text:
                        done.append(name)
                        text = after
                out.append(text if done else None)
                changed.append(done)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(changed, pa.list_(pa.string()))], ["text", "changed"])

    # else the optimiser repeats the function, and all that leads to it, wherever its result is used
    return run.asNondeterministic()(F.when(c.rlike(HIDDEN), c))


_INVISIBLE = re.compile("[\u200B-\u200F\u2060-\u2069\uFEFF\u202A-\u202E]")
_LETTERS = {ord(a): b for a, b in LOOK_ALIKES.items()} | {0xFEE0 + c: chr(c) for c in range(0x21, 0x7F)}
_OTHER_LETTER = re.compile(f"[{''.join(map(chr, _LETTERS))}]")
#: For Arrow, what a text must hold for any step to change it.
_ANY_STEP = f"{HIDDEN}|[\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2069}}\\x{{FEFF}}\\x{{202A}}-\\x{{202E}}\\x{{FF01}}-\\x{{FF5E}}{''.join(LOOK_ALIKES)}]|[ \\t\\r\\f\\x0B]{{2}}|\\n{{3}}"
_RUN = "[A-Za-z0-9+/]{16}"


def normalized_text(text: str, run: bool | None = None) -> str:
    """What normalize_corpus() makes of a text. run, if known: whether 16 of the letters of base64 stand in a row."""
    if not text.isascii():
        shown = _INVISIBLE.sub("", text)
        text, run = shown, run if shown == text else None
    if run or (run is None and re.search(_RUN, text)):
        text = _base64(text)
    if "\\" in text or "&" in text:
        for _, step in _DECODED[1:]:
            text = step(text)
    if not text.isascii() and _OTHER_LETTER.search(text):
        text = text.translate(_LETTERS)
    text = _leet(text)
    if any(x in text for x in ("  ", "\t", "\r", "\f", "\x0B")):
        text = re.sub("[ \\t\\r\\f\\x0B]{2,}", " ", text)
    return re.sub("\n{3,}", "\n\n", text) if "\n\n\n" in text else text


def normalized_texts(texts):
    """An Arrow column of normalized_text() of a column without nulls, null where it is the text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[str | None] = [None] * len(texts)
    runs = pc.match_substring_regex(texts, _RUN).to_pylist()
    for i in pc.indices_nonzero(pc.match_substring_regex(texts, _ANY_STEP)).to_pylist():
        text = texts[i].as_py()
        after = normalized_text(text, runs[i])
        if after != text:
            out[i] = after
    return pa.array(out, pa.string())


def normalize_corpus(docs, text_col: str = "text"):
    """docs with normalized and transforms, the names of the steps that changed the text, in order: invisible characters,
    base64, hex and Unicode escapes, entities, look-alikes, full width, leetspeak, blanks. Only texts that may hold a coded
    stretch are sent to Python, for the others a null; null texts are empty."""
    before = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda flag, name: F.when(flag, F.lit(name))
    rows = docs.withColumn("_t", strip_invisible(before)).withColumn("_d", _in_order(F.col("_t"), _DECODED)).withColumn("_u", F.coalesce("_d.text", "_t"))
    rows = rows.withColumn("_a", fold_look_alikes(F.col("_u"))).withColumn("_b", to_half_width(F.col("_a"))).withColumn("_l", _in_order(F.col("_b"), [("leetspeak", _leet)])).withColumn("_m", F.coalesce("_l.text", "_b"))
    rows = rows.withColumn("normalized", collapse_blanks(F.col("_m")))
    steps = [F.array(named(F.col("_t") != before, "invisible")), F.col("_d.changed"), F.array(named(F.col("_a") != F.col("_u"), "look_alikes"), named(F.col("_b") != F.col("_a"), "full_width")), F.col("_l.changed"), F.array(named(F.col("normalized") != F.col("_m"), "blanks"))]
    return rows.withColumn("transforms", F.array_compact(F.concat(*steps))).drop("_t", "_d", "_u", "_a", "_b", "_l", "_m")
