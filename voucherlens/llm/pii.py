"""Surrogates for personal data, in DataFrame functions only.

Method: entities are detected by one pattern; each is replaced by a keyed surrogate of its own type and format (letter
case, digit groups, punctuation, check digits, country and top-level parts, and for names script, syllable pattern and the
ending that tells the gender). The surrogate depends on the key and the entity's canonical form alone, so one entity has
one surrogate in the whole corpus, however it is written, and a family name alone has that of the full name.

Within a type and format, surrogates are a keyed permutation without fixed points of all strings of that format: a Feistel
network over the characters, each within its own alphabet. So two entities never share a surrogate, none keeps its own, and
no supply of surrogates can run out. `collisions` checks this on all distinct entities of a corpus. Texts are rewritten
where they lie: no row meets another.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlens.llm.common import column_name

# Titles, alphabets of a format (a character stays within its own), country calling codes of one or two digits.
_TITLES = "Mrs Ms Miss Madame Mme Frau Señora Sra Doña госпожа Госпожа Mr Mister Monsieur Herr Señor Sr Don господин Господин Dr Prof".split()
_DIGITS, _LETTERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdef"
_VOWELS, _CONSONANTS = ["aeiouy", "àáâäãåèéêëìíîïòóôöõùúûü", "аеёиоуыэюя"], ["bcdfghjklmnpqrstvwxz", "çñšžčć", "бвгджзйклмнпрстфхцчшщ"]
_CALLING = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_TITLE = "|".join(_TITLES)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2}[ \-]\d{1,7})(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[.\-])\d{3}[ .\-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[0-9a-f]{0,127}\d)(?=[0-9a-f]{0,127}[a-f])[0-9a-f]{16,128}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][A-Za-z0-9_\-]{16,128})(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’\-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'’\-]{{1,40}}){{0,2}}",
}
# What every pattern needs is looked at first: a likely first character, and none but digits go on right after a letter.
_ANY = r"(?=[A-Za-z0-9._%+(\-гГ])(?:(?<![A-Za-z])|(?=\d))(?:" + "|".join(PATTERNS.values()) + ")"
_HINT = rf"[@\d]|(?=[ASsPpGgXx])(?:AKIA|sk[_\-]|pk[_\-]|gh[po][_\-]|xox[bp][_\-])|(?=[ADFHMPSгГ])(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}"


def entities(text: Column) -> Column:
    """All candidates of a text in order; an empty array if it is null or has none. Those of a null kind are none after all."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(f"({_ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def kind(e: Column) -> Column:
    """The kind of a candidate; null for a number as long as a card's whose check digit is wrong."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(e.contains("@"), "email").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^(\d{13,19}|\d{4}([ \-]\d{4}){2}[ \-]\d{1,7})$"), F.when(F.substring(digits, -1, 1) == _luhn(_but_last(digits)), "card"))
        .when(e.rlike(r"^([0-9a-f]{16,128}|AKIA[0-9A-Z]{16}|(sk|pk|ghp|gho|xoxb|xoxp)[_\-].*)$"), "secret")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(e.rlike(r"^\p{L}"), "person").otherwise("phone")
    )


def canonical(e: Column, k: Column) -> Column:
    """What of an entity tells it from others: not letter case, spacing or a title."""
    digits = F.regexp_replace(e, r"\D", "")
    return (
        F.when(k == "email", F.lower(e)).when(k.isin("ssn", "card"), digits).when(k == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), digits))
        .when(k == "iban", F.regexp_replace(e, " ", "")).when(k == "person", F.regexp_replace(_name(e), r"['’]s$", "")).otherwise(e)
    )


def _name(e: Column) -> Column:
    return F.regexp_replace(e, r"^\p{L}+\.? ", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value worked out once: named twice as a plain column, it would stand twice in the plan."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _but_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _styles(style: Column) -> Column:
    """The alphabets of a style: a character stays within its own."""
    lists = {"name": _VOWELS + _CONSONANTS, "secret": [_DIGITS, _HEX, _LETTERS[6:]], "ip": [_DIGITS + _HEX], "plain": [_DIGITS, _LETTERS]}
    out = F.array(*map(F.lit, lists.pop("plain")))
    for name, alphabets in lists.items():
        out = F.when(style == name, F.array(*map(F.lit, alphabets))).otherwise(out)
    return out


@lru_cache(maxsize=1)
def _blocks() -> str:
    """Letters of every script by blocks of 64 codes, as "block:letters,…": the alphabets of letters that no style lists.

    Of letters with a case the small ones, if the capital is one letter that leads back; a block has two at least.
    """
    listed = set("".join(_VOWELS + _CONSONANTS) + _LETTERS)
    found: dict[int, str] = {}
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) in ("Ll", "Lo") and c not in listed and (c.upper() == c or (len(c.upper()) == 1 and c.upper().lower() == c)):
            found[code // 64] = found.get(code // 64, "") + c
    return ",".join(f"{block}:{letters}" for block, letters in found.items() if len(letters) > 1)


def permuted(text: Column, key: str, tweak: Column, style: Column) -> Column:
    """`text` under a keyed permutation of the strings of its format, none of which stays as it is.

    A character of the style's alphabets goes to one of its own alphabet and letter case; in names a letter of any other
    script goes to one of its block; others stay. Four Feistel rounds, the first letter moved on by one, and the rounds
    undone: a permutation like the move, so without a fixed point. A name with no letter to move becomes a keyed word.
    """
    block = lambda c: F.try_element_at(F.str_to_map(F.lit(_blocks()), F.lit(","), F.lit(":")), F.floor(F.ascii(F.lower(c)) / 64).cast("string"))
    other = lambda c: F.when((style == "name") & c.rlike(r"[^\x00-\x7F]"), _let(block(c), lambda a: F.when(F.instr(a, F.lower(c)) > 0, a)))
    of = lambda c, lists: F.coalesce(F.get(F.filter(lists, lambda a: (c != "") & (F.instr(a, F.lower(c)) > 0)), F.lit(0)), other(c))
    word = F.initcap(F.translate(F.substring(F.sha2(F.concat(F.lit(f"{key}|"), tweak, F.lit("|"), text), 256), 1, 16), _DIGITS, "ghijklmnop"))
    chars = _let(_styles(style), lambda lists: F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), of(c, lists).alias("of"))))
    own = lambda all_: F.transform(F.filter(all_, lambda x: x["of"].isNotNull()), lambda x: F.struct(x["of"].alias("of"), (F.instr(x["of"], F.lower(x["c"])) - 1).alias("at"), F.length(x["of"]).alias("many")))
    return _let(chars, lambda all_: _let(own(all_), lambda mine: F.when(F.size(mine) == 0, F.when((style == "name") & (text != ""), word).otherwise(text)).otherwise(_let(_moved(mine, key, tweak), lambda new: _spelt(all_, new)))))


def _moved(own: Column, key: str, tweak: Column) -> Column:
    """The places in their alphabets that the letters `own` go to: rounds of (half to turn, seed, sign); half 2 moves the first letter on."""
    half = F.floor(F.size(own) / 2).cast("int")
    plan = F.array(*[F.struct(F.lit(n % 2 if n >= 0 else 2).alias("half"), F.lit(f"{key}|{n}|").alias("seed"), F.lit(sign).alias("sign")) for n, sign in [(0, 1), (1, 1), (2, 1), (3, 1), (-1, 1), (3, -1), (2, -1), (1, -1), (0, -1)]])
    shape = F.concat_ws(",", F.transform(own, lambda x: x["of"]))

    def turn(state: Column, r: Column) -> Column:
        other = F.when(r["half"] == 0, F.slice(state, half + 1, F.size(state))).otherwise(F.slice(state, F.lit(1), half))
        seed = F.sha2(F.concat(r["seed"], tweak, F.lit("|"), shape, F.lit("|"), F.concat_ws(",", F.transform(other, lambda x: x.cast("string")))), 256)
        by = lambda s, i: F.when(r["half"] == 2, F.when(i == 0, 1).otherwise(0)).when((i < half) == (r["half"] == 0), r["sign"] * F.pmod(F.xxhash64(s, i), F.lit(1 << 31)).cast("int")).otherwise(0)
        return _let(seed, lambda s: F.transform(state, lambda x, i: F.pmod(x + by(s, i).cast("long"), F.get(own, i)["many"].cast("long")).cast("int")))

    return F.aggregate(plan, F.transform(own, lambda x: x["at"].cast("int")), turn)


def _spelt(all_: Column, new: Column) -> Column:
    """The characters of a text, its letters at their `new` places."""

    def one(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(all_, F.lit(1), i), lambda y: y["of"].isNotNull()))
        low = F.substring(x["of"], F.get(new, before) + 1, F.lit(1))
        return F.when(x["of"].isNull(), x["c"]).when(x["c"] != F.lower(x["c"]), F.upper(low)).otherwise(low)

    return F.array_join(F.transform(all_, one), "")


def _filled(e: Column, digits: Column) -> Column:
    """`e` with its digits replaced, in order, by `digits`."""
    before = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"\D", ""))
    return F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(r"\d"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _luhn(payload: Column) -> Column:
    """The check digit that follows `payload`."""
    n = F.length(payload)
    value = lambda c, i: (c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1)).cast("int")
    total = F.aggregate(F.transform(F.split(payload, ""), value), F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _rest97(text: Column) -> Column:
    """`text` modulo 97, letters read as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def _checked(e: Column, new: Column) -> Column:
    """The account number `new` in e's spacing, its check digits right or as wrong as e's."""
    plain = F.regexp_replace(e, " ", "")
    country, check, account = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substring(plain, F.lit(5), F.length(plain))
    due = lambda x: F.pmod(98 - _rest97(F.concat(x, country, F.lit("00"))), F.lit(97))
    digits = F.when(check.isin("00", "01", "99"), check).otherwise(F.lpad((2 + F.pmod(due(new) - due(account) + check.cast("int") - 2, F.lit(97))).cast("string"), 2, "0"))
    shown = lambda x: F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(x, F.length(F.regexp_replace(F.substring(e, F.lit(1), i), " ", "")) + 1, F.lit(1)))), "")
    return _let(F.concat(country, digits, new), shown)


def _pieces(e: Column, k: Column) -> Column:
    """What of an entity is permuted, as structs: head and tail stay, core is permuted under its tweak and style."""
    piece = lambda head, core, tail, tweak, style="plain": F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((head, "head"), (core, "core"), (tail, "tail"), (tweak, "tweak"), (style, "style"))])
    digits, plain = F.regexp_replace(e, r"\D", ""), F.regexp_replace(e, " ", "")
    # the host is the same in all addresses, its last part stays
    host, top = F.substring_index(e, "@", -1), F.substring_index(e, ".", -1)
    email = F.array(piece("", F.substring_index(e, "@", 1), "@", "email"), piece("", F.substring(host, F.lit(1), F.length(host) - F.length(top)), top, "host"))
    # numbers of 0 to 255 as pairs of sixteenths
    wide = F.array_join(F.transform(F.split(e, r"\."), lambda x: F.lower(F.lpad(F.hex(x.cast("int")), 2, "0"))), ".")
    issuer = F.substring(digits, 1, 1)
    card = piece(issuer, F.substring(digits, F.lit(2), F.length(digits) - 2), "", F.concat(F.lit("card|"), issuer))
    # the country's code, told by its digits, stays
    code = F.when(e.startswith("+"), F.regexp_extract(digits, rf"^({_CALLING}|\d{{1,3}})", 1)).otherwise("")
    phone = piece(code, F.substring(digits, F.length(code) + 1, F.length(digits)), "", F.concat(F.lit("phone|"), F.substring(e, 1, 1) == "+", F.lit("|"), code))
    prefix = F.regexp_extract(e, r"^(AKIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-])?", 1)
    secret = piece(prefix, F.substring(e, F.length(prefix) + 1, F.length(e)), "", F.concat(F.lit("secret|"), prefix), "secret")
    iban = piece("", F.substring(plain, F.lit(5), F.length(plain)), "", F.concat(F.lit("iban|"), F.substring(plain, 1, 2)))
    # word by word, so that one part alone matches the full name's; a last vowel is kept, which tells the gender
    ending = "[" + "".join(_VOWELS) + "]"
    tail = lambda w: F.regexp_extract(w, rf"((?:(?<=.{{2}}){ending})?(?:['’]s)?)$", 1)
    title = F.regexp_extract(e, r"^(\p{L}+\.?) ", 1)
    person = F.transform(F.split(_name(e), " "), lambda w, i: piece(F.when(i == 0, F.concat(title, F.lit(" "))).otherwise(" "), F.substring(w, F.lit(1), F.length(w) - F.length(tail(w))), tail(w), "name", "name"))
    return (
        F.when(k == "email", email).when(k == "ip", F.array(piece("", wide, "", "ip", "ip"))).when(k == "ssn", F.array(piece("", digits, "", "ssn")))
        .when(k == "card", F.array(card)).when(k == "secret", F.array(secret)).when(k == "iban", F.array(iban)).when(k == "person", person).otherwise(F.array(phone))
    )


def surrogate(e: Column, k: Column, key: str) -> Column:
    """The surrogate of entity `e` of kind `k`, in e's own format; `e` itself where the kind is null."""
    new = F.array_join(F.transform(_pieces(e, k), lambda p: F.concat(p["head"], permuted(p["core"], key, p["tweak"], p["style"]), p["tail"])), "")
    shown = lambda x: (
        F.when(k.isin("email", "secret", "person"), x).when(k == "ip", F.array_join(F.transform(F.split(x, r"\."), lambda y: F.conv(y, 16, 10)), "."))
        .when(k == "card", _filled(e, F.concat(x, _luhn(x)))).when(k == "iban", _checked(e, x)).otherwise(_filled(e, x))
    )
    return F.when(k.isNull(), e).otherwise(_let(new, shown))


def collisions(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(kind, new, many): surrogates that distinct entities share, or that are their entity itself; empty unless something is broken."""
    # explode_outer: the filter Spark infers for explode would look for the entities again
    e = docs.select(F.explode_outer(entities(F.col(text_col))).alias("e")).where("e is not null").select("e", kind(F.col("e")).alias("kind")).where("kind is not null")
    own = e.withColumn("canon", canonical(F.col("e"), F.col("kind"))).groupBy("kind", "canon").agg(F.min("e").alias("e"))
    own = own.select("kind", "canon", canonical(surrogate(F.col("e"), F.col("kind"), key), F.col("kind")).alias("new"))
    return own.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("many"), F.max(F.col("canon") == F.col("new")).alias("same")).where("many > 1 or same").select("kind", "new", "many")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False, check: bool = False) -> DataFrame:
    """`docs` with surrogates in the text; all rows and columns as they were (`counts` adds n_entities and entity_kinds).

    A full name that a title marks in a text is also replaced where it stands in that text without one. Null, empty and
    clean texts are unchanged, and each row is rewritten by itself. `check` holds all distinct entities of the corpus
    against each other first and raises an error if two share a surrogate.
    """
    if check and (bad := collisions(docs, key, text_col).where("many > 1").first()) is not None:
        raise RuntimeError(f"surrogates collide for a {bad.kind}")
    found, new = column_name(docs, "pii_found"), column_name(docs, "pii_new")
    kinds = lambda: F.transform(found, lambda x: kind(x))
    rows = docs.withColumn(found, entities(F.col(text_col))).withColumn(new, F.transform(found, lambda x: _let(kind(x), lambda k: surrogate(x, k, key))))
    plain = lambda x: F.regexp_replace(_name(x), r"['’]s$", "")
    pairs = F.zip_with(found, new, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    full = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"].rlike(rf"^(?:{_TITLE})\.? [^ ]+ [^ ]")), lambda p: F.struct(plain(p["a"]).alias("a"), plain(p["b"]).alias("b"))))
    gap = lambda g: F.aggregate(full, g, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})\Q"), n["a"], F.lit(r"\E(?!\p{L})")), n["b"]))
    gaps = F.split(F.col(text_col), _ANY)
    joined = F.zip_with(gaps, new, lambda g, s: F.concat(gap(g), F.coalesce(s, F.lit(""))))
    text = F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(F.col(text_col))
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        real = F.filter(kinds(), lambda k: k.isNotNull())
        out += [F.size(real).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(real)), ",").alias("entity_kinds")]
    return rows.select(*out)
