"""Script-aware folding, tokenizing and matching as Column expressions.

Two folds exist because an index and a verification step differ: the index fold keeps hamza on its own and
on the tooth and folds three Persian letters; the verification fold drops more marks and folds hamza.
Everything here stays inside the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the index fold: letters, what they become, and the marks that are dropped.
INDEX_LETTERS = "ٱآأإىؤةگپچ"
INDEX_BECOME = "اااايوهكبج"
INDEX_DROP = "ًٌٍَُِّْٰـ"
#: Fixed values of the verification fold; the last letter is dropped.
VERIFY_LETTERS = "آأإٱىةؤئء"
VERIFY_BECOME = "اااايهوي"
VERIFY_DROP = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
#: Letter and combining mark, and the letter that composes them.
COMPOSE = {
    "آ": "آ", "أ": "أ", "إ": "إ", "ؤ": "ؤ", "ئ": "ئ",
    "ۀ": "ۀ", "ۂ": "ۂ", "ۓ": "ۓ",
}
EASTERN_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
#: What may be written onto a bare word, and the article with what may stand before it (the last one contracted).
ON_BARE_WORD = ("", "و", "ف", "ب", "ك", "ل")
ON_ARTICLE = ("ال", "وال", "فال", "بال", "كال", "لل")
PLACEHOLDER_PART = "الكتاب"
UNKNOWN_YEAR = 99999


def index_fold(c: Column) -> Column:
    return F.translate(c, INDEX_LETTERS + INDEX_DROP, INDEX_BECOME)


def compose_marks(c: Column) -> Column:
    """Canonical composition of the Arabic letters that have a combining form."""
    for pair, one in COMPOSE.items():
        c = F.replace(c, F.lit(pair), F.lit(one))
    return c


def verify_fold(c: Column) -> Column:
    return F.translate(F.regexp_replace(compose_marks(c), VERIFY_DROP, ""), VERIFY_LETTERS, VERIFY_BECOME)


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, "<[^>]*>", by)


def plain_text(c: Column) -> Column:
    """Mark-up removed and carriage returns as line feeds: the displayed form of a page."""
    return F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("\r"), F.lit("\n"))


def _son(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t == "ابن", F.lit("بن")).otherwise(t))


def index_tokens(c: Column) -> Column:
    """Tokens of the index: letter and digit runs of the folded text; null gives an empty list."""
    return _son(F.regexp_extract_all(index_fold(strip_tags(F.coalesce(c, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1))


def verify_tokens(c: Column) -> Column:
    """Tokens of phrase and proximity checks: runs of the Arabic block (its comma and digits included)."""
    return _son(F.regexp_extract_all(verify_fold(strip_tags(F.coalesce(c, F.lit("")))), F.lit("([؀-ۿ]+)"), 1))


def exact_fold(c: Column, diacritics: bool = False, hamza: bool = False, digits: bool = False) -> Column:
    """The text at a chosen exactness: each flag keeps what it names; tatweel and mark-up always go."""
    c = F.replace(strip_tags(compose_marks(c)), F.lit("ـ"), F.lit(""))
    if not diacritics:
        c = F.regexp_replace(c, VERIFY_DROP, "")
    if not hamza:
        c = F.translate(c, VERIFY_LETTERS, VERIFY_BECOME)
    if not digits:
        c = F.translate(c, EASTERN_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def arabize(c: Column) -> Column:
    """Digits in Arabic form; null gives the empty string."""
    return F.coalesce(F.translate(c.cast("string"), "0123456789", EASTERN_DIGITS), F.lit(""))


def century(year: Column) -> Column:
    return (F.floor((year - 1) / 100) + 1).cast("int")


def known_year(year: Column) -> Column:
    """Null where the year is absent, not positive, or the unknown mark."""
    return F.when((year > 0) & (year != UNKNOWN_YEAR), year)


def clean_part(part: Column) -> Column:
    p = F.trim(part)
    return F.when((p != "") & (p != PLACEHOLDER_PART), p)


def printed_label(part: Column, page: Column) -> Column:
    """part/ page, or the page, or null without a page."""
    return F.when(page.isNotNull(), F.concat(F.coalesce(F.concat(clean_part(part), F.lit("/ ")), F.lit("")), page.cast("string")))


_SEPARATOR = r"[,;،؛|/&\t\r\n\[\]]"
#: Quotations in a packed field that open an entry and hold more than a number.
_QUOTED = rf"(^|{_SEPARATOR})\s*(?:" + "|".join(rf"{a}(?!\s*[0-9]+\s*{b})(?:[^{b}]|{b}{b})*{b}" for a, b in ('""', "“”", "«»", "''")) + rf")(?=\s*(?:$|{_SEPARATOR}))"
_NUMBER_ENTRY = rf"(?:^|{_SEPARATOR})\s*[\"'“«]?\s*([0-9]+)\s*[\"'”»]?\s*(?=$|{_SEPARATOR})"


def id_list(csv: Column) -> Column:
    """The entries of a packed id field that are numbers, in order, digits of any of the three kinds; numbers in names and beyond an INT are none."""
    plain = F.translate(F.coalesce(csv, F.lit("")), EASTERN_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)
    numbers = F.regexp_extract_all(F.regexp_replace(plain, _QUOTED, "$1x"), F.lit(_NUMBER_ENTRY), 1)
    return F.filter(F.transform(numbers, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


#: Affixes of a published light stemmer.
STEM_PREFIXES = "وال|فال|بال|كال|ال|لل"
STEM_SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ه", "ي")


def light_stem(t: Column) -> Column:
    """An approximate stem of an index token: conjunction, article and the common endings removed."""
    t = F.regexp_replace(t, "^و(.{3,})$", "$1")
    t = F.regexp_replace(t, f"^(?:{STEM_PREFIXES})(.{{2,}})$", "$1")
    for s in STEM_SUFFIXES:
        t = F.regexp_replace(t, f"^(.{{2,}}){s}$", "$1")
    return t


def stem_of(token: str) -> str:
    """light_stem() of a string."""
    for pattern in ("^و(.{3,})$", f"^(?:{STEM_PREFIXES})(.{{2,}})$", *[f"^(.{{2,}}){x}$" for x in STEM_SUFFIXES]):
        token = re.sub(pattern, r"\1", token)
    return token


# --- the query's side, on the driver -------------------------------------------------------------


def fold_token(token: str) -> str:
    out = token.translate(str.maketrans(INDEX_LETTERS, INDEX_BECOME, INDEX_DROP)).strip()
    return "بن" if out == "ابن" else out


def fold_query(query: str | None) -> list[str]:
    """Folded terms of a query, without a cap on their number."""
    return [t for w in (query or "").split() if (t := fold_token(w))]


def fold_verify(text: str) -> str:
    import unicodedata

    out = re.sub(VERIFY_DROP, "", unicodedata.normalize("NFC", text))
    return out.translate(str.maketrans(VERIFY_LETTERS[:-1], VERIFY_BECOME, VERIFY_LETTERS[-1]))


def query_tokens(text: str) -> list[str]:
    """verify_tokens() of a query string."""
    return ["بن" if t == "ابن" else t for t in re.findall("[؀-ۿ]+", fold_verify(re.sub("<[^>]*>", " ", text)))]


def fold_exact(text: str, diacritics: bool = False, hamza: bool = False, digits: bool = False) -> str:
    """exact_fold() of a query string."""
    import unicodedata

    s = re.sub("<[^>]*>", " ", unicodedata.normalize("NFC", text)).replace("ـ", "")
    if not diacritics:
        s = re.sub(VERIFY_DROP, "", s)
    if not hamza:
        s = s.translate(str.maketrans(VERIFY_LETTERS[:-1], VERIFY_BECOME, VERIFY_LETTERS[-1]))
    if not digits:
        s = s.translate(str.maketrans(EASTERN_DIGITS + PERSIAN_DIGITS, "0123456789" * 2))
    return re.sub(r"\s+", " ", s).strip()


def glob_pattern(term: str) -> str:
    """A whole-token regular expression of a term with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in term) + "$"


# --- patterns: the folds turned around, so that text is matched as it is stored --------------------


def _kin(letters: str, become: str) -> dict[str, str]:
    """Folded letter to all letters that fold to it."""
    return {b: b + "".join(x for x, y in zip(letters, become) if y == b) for b in set(become)}


def _spelled(word: str, kin: dict[str, str], drop: str) -> str:
    out = "".join(f"[{re.escape(kin.get(c, c))}]{drop}*" for c in word)
    # the one word that is also written with an alif
    return f"(?:[{kin.get('ا', 'ا')}]{drop}*)?{out}" if word == "بن" else out


def _tokens_pattern(words: list[str], kin: dict[str, str], drop: str, token: str, between: str) -> str:
    """token: what tokens are made of, as the inside of a class. Before the first word stands what ends a token, and any number of dropped marks."""
    return f"(?:^|[^{token}{drop[1:-1]}]){drop}*" + between.join(_spelled(w, kin, drop) for w in words) + f"(?!{drop}*[{token}&&[^{drop[1:-1]}]])"


def index_pattern(term: str) -> str:
    """Finds a folded term as a whole index token in unfolded text without mark-up."""
    return _tokens_pattern([term], _kin(INDEX_LETTERS, INDEX_BECOME), f"[{INDEX_DROP}]", r"\p{L}\p{N}", "")


def index_part_pattern(part: str) -> str:
    """Finds a part of a folded token in unfolded text."""
    return "".join(f"[{re.escape(_kin(INDEX_LETTERS, INDEX_BECOME).get(c, c))}][{INDEX_DROP}]*" for c in part)


def verify_pattern(words: list[str]) -> str:
    """Finds verification tokens next to each other in unfolded text without mark-up."""
    drop = VERIFY_DROP[:-1] + VERIFY_LETTERS[-1] + "]"
    kin = _kin(VERIFY_LETTERS, VERIFY_BECOME)
    for pair, one in COMPOSE.items():
        kin.setdefault(one, one)
    block = r"؀-ۿ"
    return _tokens_pattern(words, kin, drop, block, f"[^{block}](?:[^{block}]|{drop})*")


def exact_pattern(needle: str, diacritics: bool = False, hamza: bool = False, digits: bool = False) -> str:
    """Finds a needle folded by fold_exact() in text without mark-up, at the same exactness."""
    drop = "[ـ" + ("" if diacritics else VERIFY_DROP[1:-1]) + ("" if hamza else VERIFY_LETTERS[-1]) + "]"
    pairs: dict[str, list[str]] = {}
    for pair, one in COMPOSE.items():
        pairs.setdefault(pair[0], []).append(pair[1])
    kin = {} if hamza else _kin(VERIFY_LETTERS[:-1], VERIFY_BECOME)
    parts = {one: pair for pair, one in COMPOSE.items()}
    out = []
    for c in needle:
        if c == " ":
            out.append(rf"\s(?:\s|{drop})*")
            continue
        if not digits and c.isascii() and c.isdigit():
            one = f"[{c}{EASTERN_DIGITS[int(c)]}{PERSIAN_DIGITS[int(c)]}]"
        elif c in kin:
            composed = [re.escape(pair) for pair, x in COMPOSE.items() if x in kin[c]]
            one = "(?:" + "|".join([*composed, f"[{kin[c]}]"]) + ")"
        elif c in parts:
            one = f"(?:{c}|{parts[c]})"
        elif c in pairs:
            one = f"{c}(?![{''.join(pairs[c])}])"
        elif c in "".join(COMPOSE):
            one = f"(?<![{''.join(b for b, ms in pairs.items() if c in ms)}]){c}"  # else it is part of a letter
        else:
            one = re.escape(c)
        out.append(one + drop + "*")
    return "".join(out)


def prefix_variants(word: str) -> list[str]:
    """Written forms of a word: bare or with the article, each with every particle that may stand before it."""
    word = fold_token(word)
    bare = re.fullmatch(f"(?:{ON_ARTICLE[0]})?(.+)", word, re.DOTALL)
    if bare is None or len(word) < 2:
        return [word]
    written = [start + bare[1] for start in ON_BARE_WORD + ON_ARTICLE]
    return sorted({w for w in written if len(w) > 1}, key=lambda w: (w != word, len(w), w))
