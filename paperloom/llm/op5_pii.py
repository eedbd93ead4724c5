"""Personal data replaced by keyed surrogates of the same type, with DataFrame functions only.

Detected: e-mail and IP addresses, payment cards (Luhn), IBANs (mod 97), US social security numbers, telephone numbers
(international, North American, and national ones that begin with a zero), and names after a title or beginning with one
of a list of first names; a name with neither is not known as one. IPv6 addresses are found in full, compressed ("::") and with
an IPv4 tail; compressed ones need a group of three hex digits or that tail, as 1::2 and a::b are slices and scopes, and
::1 and :: name no one. One regular expression finds them; a text is cut at its
matches and joined again around their surrogates, so nothing else changes.

A surrogate comes from a Feistel network over the entity's letters and digits (octets for IPv4, the 32 hex digits for IPv6,
whose surrogates are written in full, so that one address gets one surrogate in each of its forms), keyed by SHA-512: each
character moves within its own alphabet, of any script, so script, case, length and punctuation stay. Between the network
and its inverse every character moves on by one, so the whole is a permutation without a fixed point: distinct entities get
distinct surrogates, none its own, while one entity gets the same surrogate wherever it occurs and however it is
punctuated or cased. Kept or recomputed: the issuer and check digit of cards, country and check digits of IBANs, country
code and plausible first digits of telephone numbers, the area of social security numbers, the top-level domain of e-mail
addresses, the first group of IPv6 addresses, and the ending that tells a Cyrillic surname's gender. In names vowels stay
vowels. Known first names are permuted within their gender and script; titles stay.

The key decides everything and is a secret: give it, or set PAPERLOOM_KEY, to have the same surrogates in another run.
Without either a random one is drawn once a Spark application and never shown.

Before use, the corpus' distinct entities are checked for surrogates that collide (they are pre-aggregated map-side and
only entities are shuffled); a collision changes the nonce, so the replacement stays one consistent mapping.

A null text stays null, an empty one empty. A null doc_id stays null; repeated rows give a row each. Only doc_id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import random
import secrets
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, table

ROUNDS, NONCES = 4, 8
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Srta|Господин|Госпожа"
#: First names by (script, gender), each list permuted within itself.
FIRST_NAMES = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter Hans Klaus Jürgen Wolfgang Stefan Günther Pierre Jean François Michel Philippe Antoine José Juan Carlos Miguel Javier Alejandro Pablo",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Lisa Emily Laura Anna Emma Ursula Monika Petra Sabine Renate Marie Jeanne Françoise Isabelle Nathalie Sylvie Céline María Carmen Ana Isabel Pilar Lucía Dolores",
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Павел Владимир",
    ("cyrillic", "f"): "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила",
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþœ"]
#: Letters with marks, tried after those: Latin, Cyrillic, Greek. Lower case, as tokens are.
ALPHABETS += ["āăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĸĺļľŀłńņňŋōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżž", "ѐђѓєѕіїјљњћќѝўџґ", "άέήίόύώϊϋς"]
PHONE_DIGITS = ["01", "23456789"]
NAME_LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь"]
_GENDER = "(?:ова|ева|ёва|ина|ская|цкая|ов|ев|ёв|ин|ский|цкий)$"


def _letter_runs() -> list[tuple[int, int]]:
    """(first code point, length) of runs of letters or digits of one script that the alphabets lack; upper case is left out, as tokens have none."""
    known = set("".join(ALPHABETS))
    out: list[tuple[int, int]] = []
    script = None
    for c in range(0xAA, 0x323B0):
        x = chr(c)
        fits = unicodedata.category(x) in ("Ll", "Lo", "Lm", "Nd") and x not in known and len(x.upper()) == 1 and x.lower() == x
        name = unicodedata.name(x, "").split(" ")[0] if fits else None
        if fits and name == script and out[-1][0] + out[-1][1] == c:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        elif fits:
            out.append((c, 1))
        script = name
    return [r for r in out if r[1] > 1]


#: The runs in order, each as 6 hex digits of its first code point and 5 of its length: one literal, whatever the scripts.
LETTER_RUNS = ",".join(f"{c:06X}{n:05X}" for c, n in _letter_runs())
_FIRST = "|".join(n for names in FIRST_NAMES.values() for n in names.split())
_NAME = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.\d)"
#: Forms with an IPv4 tail come first, as their beginnings are addresses too; n groups stand before the "::".
_IPV6_FORMS = [
    rf"(?:{_HEX}:){{6}}{_IPV4}",
    rf"::(?:{_HEX}:){{0,5}}{_IPV4}",
    *(rf"(?:{_HEX}:){{{n}}}(?::{_HEX}){{0,{5 - n}}}:{_IPV4}" for n in range(1, 6)),
    rf"(?:{_HEX}:){{7}}{_HEX}",
    *(rf"(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:{_HEX}:){{{n}}}(?::{_HEX}){{1,{7 - n}}}" for n in range(1, 7)),
    rf"(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:(?:{_HEX}:){{1,7}}:|:(?::{_HEX}){{1,7}})",
]
_IPV6 = rf"(?={_HEX}:|::)(?<![\p{{L}}\p{{N}}]|::|(?<![\p{{L}}\p{{N}}]){_HEX}:)(?:{'|'.join(_IPV6_FORMS)})(?![\p{{L}}\p{{N}}]|:[\p{{L}}\p{{N}}:])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}\-]{0,62})\.){1,8}\p{L}[\p{L}\p{M}]{1,23}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv6": _IPV6,
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![\d+])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)|(?<![\d+])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}(?:[ .\-/]?\(?\d{1,4}\)?){2,6}|(?:1[ .\-])?\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?:1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}|(?<![.,\-/])(?:\(0\d{1,4}\) ?|0\d{1,4}[ /\-])\d{3,9}(?:[ \-]\d{2,6}){0,2})(?!\d|[.,\-/]\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLES})\.? {_NAME}(?: {_NAME})?|(?:{_FIRST}) {_NAME})(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match holds: an @, + or (, a run of digits and delimiters, two colons around at most four hex digits, a title
#: or a first name, or the head of an IBAN.
HINT = rf"[@+(]|\d[\d.\-: /]{{5}}|:[0-9A-Fa-f]{{0,4}}:|(?<!\p{{L}})(?:{TITLES}|{_FIRST})(?!\p{{L}})|[A-Z]{{2}}\d\d"
_HEAD = rf"^(?:(?:{TITLES})\.? )?(?:(?:{_FIRST}) (?={_NAME}))?"


def secret_key(spark: SparkSession) -> str:
    """PAPERLOOM_KEY, or a random key of this Spark application."""
    own = os.environ.get("PAPERLOOM_KEY")
    if own:
        return own
    sc = spark.sparkContext
    if not hasattr(sc, "_paperloom_key"):
        sc._paperloom_key = secrets.token_hex(32)
    return sc._paperloom_key


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _tokens(c: Column) -> Column:
    """Letters and digits in lower case, one by one."""
    return F.filter(F.split(F.lower(c), ""), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _ipv6_tokens(raw: Column) -> Column:
    """The 32 hex digits of an IPv6 address in any of its forms."""
    octet = lambda i: F.regexp_extract(raw, r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", i).cast("int")
    tail = F.format_string("%x:%x", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4))
    sides = F.split(F.when(raw.contains("."), F.concat(F.regexp_replace(raw, "[^:]+$", ""), tail)).otherwise(F.lower(raw)), "::", 2)
    groups = F.transform(sides, lambda s: F.filter(F.split(F.lower(s), ":"), lambda g: g != ""))
    none = F.array().cast("array<string>")
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(F.flatten(groups)))
    all8 = F.concat(F.get(groups, F.lit(0)), zeros, F.coalesce(F.get(groups, F.lit(1)), none))
    return _chars(F.array_join(F.transform(all8, lambda g: F.lpad(g, 4, "0")), ""))


def _luhn(digits: Column, check: bool) -> Column:
    """Luhn sum of digit tokens, from the right; ``check``: as if a check digit followed."""
    n = F.size(digits)
    terms = F.transform(digits, lambda d, i: F.when((n - i) % 2 == (1 if check else 0), (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _mod97(tokens: Column) -> Column:
    """Number of an IBAN's tokens in the order given, modulo 97."""
    value = lambda t: F.when(t.rlike(r"\d"), t.cast("int")).otherwise(F.ascii(t) - 87)
    return F.aggregate(tokens, F.lit(0), lambda a, t: (a * F.when(value(t) > 9, 100).otherwise(10) + value(t)) % 97)


def _rotated(tokens: Column) -> Column:
    return F.concat(F.slice(tokens, 5, 64), F.slice(tokens, 1, 4))


def kind_of(raw: Column) -> Column:
    """Type of a match; null for what its check digits disown."""
    tokens = _tokens(raw)
    out = F.when(raw.contains("@"), F.lit("email"))
    for kind in ("iban", "ipv6", "ip", "card", "ssn", "phone", "name"):
        test = raw.rlike(f"^(?:{PATTERNS[kind]})$")
        if kind == "iban":
            test = test & (_mod97(_rotated(tokens)) == 1)
        elif kind == "card":
            test = test & (_luhn(tokens, False) % 10 == 0)
        elif kind == "phone":
            test = test & F.size(tokens).between(8, 15)
        out = out.when(test, F.lit(kind))
    return out


def entities(text: Column) -> Column:
    """Array of struct(raw, kind) of a text's matches, in order."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.transform(found, lambda x: F.struct(x.alias("raw"), kind_of(x).alias("kind")))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moved(token: Column, alphabet: Column, k: Column) -> Column:
    at = F.instr(alphabet, token)
    return F.substring(alphabet, F.pmod(at - 1 + k, F.length(alphabet)) + 1, F.lit(1))


def _other_step(token: Column, k: Column) -> Column:
    """A letter of any other script moves on in its run of code points; one that stands alone stays."""
    point = F.ascii(token)
    found = F.element_at(F.filter(F.split(F.lit(LETTER_RUNS), ","), lambda r: F.substring(r, 1, 6) <= F.lpad(F.hex(point), 6, "0")), -1)

    def move(run: Column) -> Column:
        first, n = (F.conv(F.substring(run, a, size), 16, 10).cast("int") for a, size in ((1, 6), (7, 5)))
        return F.when(point < first + n, F.decode(F.unhex(F.lpad(F.hex(first + F.pmod(point - first + k, n)), 8, "0")), "UTF-32")).otherwise(token)

    return F.coalesce(_with(found, move), token)


def _alphabet_step(token: Column, kind: Column, k: Column) -> Column:
    own = None
    for only, alphabet in [("phone", a) for a in PHONE_DIGITS] + [("name", a) for a in NAME_LETTERS] + [(None, a) for a in ALPHABETS]:
        test = F.contains(F.lit(alphabet), token)
        test = test if only is None else test & (kind == only)
        own = F.when(test, F.lit(alphabet)) if own is None else own.when(test, F.lit(alphabet))
    return _with(own, lambda alphabet: F.when(alphabet.isNull(), _other_step(token, k)).otherwise(_moved(token, alphabet, k)))


def _octet_step(token: Column, first: Column, k: Column) -> Column:
    v = token.cast("int")
    return F.when(first, F.when(v.between(1, 223), F.pmod(v - 1 + k, F.lit(223)) + 1).otherwise(v)).otherwise(F.pmod(v + k, F.lit(256))).cast("string")


def _hex_step(token: Column, k: Column) -> Column:
    return _moved(token, F.lit("0123456789abcdef"), k)


def _step(token: Column, kind: Column, first: Column, k: Column) -> Column:
    """``token`` moved on by k in its alphabet."""
    return F.when(kind == "ip", _octet_step(token, first, k)).when(kind == "ipv6", _hex_step(token, k)).otherwise(_alphabet_step(token, kind, k))


def feistel(tokens: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """Keyed permutation of token arrays that leaves each token in its alphabet, or its inverse."""
    half = F.floor(F.size(tokens) / 2).cast("int")
    start = F.struct(F.slice(tokens, F.lit(1), half).alias("l"), F.slice(tokens, half + 1, F.size(tokens) - half).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        kept, moved = (s["l"], s["r"]) if inverse else (s["r"], s["l"])
        stream = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), F.array_join(kept, ",")), 512)

        def step(t: Column, j: Column) -> Column:
            k = F.conv(F.substring(stream, (j % 42 * 3 + 1).cast("int"), F.lit(3)), 16, 10).cast("int")
            return _step(t, kind, (j == 0) & (i % 2 == 0), -k if inverse else k)

        done = F.transform(moved, step)
        return F.struct(done.alias("l"), kept.alias("r")) if inverse else F.struct(kept.alias("l"), done.alias("r"))

    rounds = F.array(*(F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))))
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["l"], s["r"]))


def first_name_map(key: str) -> dict[str, str]:
    """A permutation without fixed points of each list of first names."""
    out = {}
    for group, names in FIRST_NAMES.items():
        order = names.split()
        random.Random(hashlib.sha256(f"{key}|{group}".encode()).digest()).shuffle(order)
        out.update(zip(order, order[1:] + order[:1]))
    return out


def surrogates(found: Column, key: str) -> Column:
    """Array of struct(raw, kind, norm, new) from entities(): norm tells entities apart, new is what takes the place of raw."""
    names = F.create_map(*(F.lit(x) for pair in first_name_map(key).items() for x in pair))

    def cut(e: Column) -> Column:
        raw, kind = e["raw"], e["kind"]
        tokens = F.when(kind == "ip", F.split(raw, r"\.")).when(kind == "ipv6", _ipv6_tokens(raw)).otherwise(_tokens(raw))
        head = (
            F.when(kind == "card", 1)
            .when(kind.isin("iban", "ipv6"), 4)
            .when(kind == "ssn", 3)
            .when((kind == "phone") & raw.startswith("+"), F.when(raw.rlike(r"^\+[17]"), 1).otherwise(F.least(F.size(_tokens(F.regexp_extract(raw, r"^\+\d{1,3}", 0))), F.lit(2))))
            .when((kind == "phone") & raw.rlike(r"^\(?0"), 1)
            .when(kind == "name", F.size(_tokens(F.regexp_extract(raw, _HEAD, 0))))
            .otherwise(0)
        )
        gender = F.size(_tokens(F.regexp_extract(F.lower(raw), _GENDER, 0)))
        tail = F.when(kind == "card", 1).when((kind == "name") & (F.size(tokens) - head - gender >= 2), gender).when(kind == "email", F.size(_tokens(F.regexp_extract(raw, r"\.([\p{L}\p{M}]+)$", 1)))).otherwise(0)
        return F.struct(raw.alias("raw"), kind.alias("kind"), tokens.alias("t"), head.alias("h"), tail.alias("z"))

    def scramble(e: Column) -> Column:
        t, h, z = e["t"], e["h"], e["z"]
        body = feistel(F.slice(t, h + 1, F.greatest(F.size(t) - h - z, F.lit(0))), e["kind"], key)
        moved = F.transform(body, lambda x, j: _step(x, e["kind"], j == 0, F.lit(1)))
        return F.struct(e["raw"], e["kind"], t.alias("t"), h.alias("h"), z.alias("z"), moved.alias("m"))

    def mix(e: Column) -> Column:
        t, h, z = e["t"], e["h"], e["z"]
        new = F.concat(F.slice(t, F.lit(1), h), feistel(e["m"], e["kind"], key, inverse=True))
        return F.struct(e["raw"], e["kind"], t.alias("t"), new.alias("n"), F.slice(t, F.size(t) - z + 1, z).alias("z"))

    def finish(e: Column) -> Column:
        n, kind = e["n"], e["kind"]
        check = F.lpad((98 - _mod97(F.concat(F.slice(n, 5, 64), F.slice(n, 1, 2), F.array(F.lit("0"), F.lit("0"))))).cast("string"), 2, "0")
        out = F.when(kind == "card", F.concat(n, F.array((F.pmod(-_luhn(n, True), F.lit(10))).cast("string"))))
        out = out.when(kind == "iban", F.concat(F.slice(n, 1, 2), _chars(check), F.slice(n, 5, 64))).otherwise(F.concat(n, e["z"]))
        return F.struct(e["raw"], kind.alias("kind"), e["t"], out.alias("n"))

    def write(e: Column) -> Column:
        raw, n, kind = e["raw"], e["n"], e["kind"]

        def put(s: Column, c: Column) -> Column:
            token = F.get(n, s["k"])
            cased = F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(token)).otherwise(token)
            is_token = c.rlike(r"[\p{L}\p{N}]")
            return F.struct((s["k"] + is_token.cast("int")).alias("k"), F.concat(s["s"], F.when(is_token, cased).otherwise(c)).alias("s"))

        text = F.aggregate(_chars(raw), F.struct(F.lit(0).alias("k"), F.lit("").alias("s")), put, lambda s: s["s"])
        first = F.regexp_extract(raw, rf"^(?:(?:{TITLES})\.? )?({_FIRST}) (?={_NAME})", 1)
        title = F.regexp_extract(raw, rf"^(?:(?:{TITLES})\.? )?", 0)
        named = F.when(F.length(first) > 0, F.concat(title, F.coalesce(F.element_at(names, first), first), F.substring(text, F.length(title) + F.length(first) + 1, F.length(raw)))).otherwise(text)
        full = F.rtrim(F.regexp_replace(F.array_join(n, ""), "(.{4})", "$1:"), F.lit(":"))
        full = F.when(raw == F.lower(raw), full).otherwise(F.upper(full))
        new = F.when(kind.isNull(), raw).when(kind == "ip", F.array_join(n, ".")).when(kind == "ipv6", full).when(kind == "name", named).otherwise(text)
        norm = F.when(kind == "ip", F.array_join(e["t"], ".")).otherwise(F.array_join(e["t"], ""))
        return F.struct(raw.alias("raw"), kind.alias("kind"), norm.alias("norm"), new.alias("new"))

    return F.transform(F.transform(F.transform(F.transform(F.transform(found, cut), scramble), mix), finish), write)


def collisions(docs: DataFrame, key: str) -> DataFrame:
    """Surrogates (kind, new) that stand for more than one entity of ``docs``, or for themselves; none are expected."""
    ents = docs.select(F.explode(surrogates(entities(F.col("text").cast("string")), key)).alias("e")).where("e.kind is not null")
    new = F.when(F.col("e.kind") == "ip", F.col("e.new")).otherwise(F.array_join(_tokens(F.col("e.new")), ""))
    pairs = ents.select("e.kind", "e.norm", new.alias("new")).distinct()
    return pairs.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("new") == F.col("norm")).alias("own")).where("n > 1 or own")


def checked_key(docs: DataFrame, key: str | None = None) -> str:
    """``key`` with the first nonce under which no two entities of ``docs`` share a surrogate."""
    key = key or secret_key(docs.sparkSession)
    for nonce in range(NONCES):
        if collisions(docs, f"{key}#{nonce}").isEmpty():
            return f"{key}#{nonce}"
    raise ValueError("no nonce keeps all surrogates apart")


def _replaced(text: Column, found: Column) -> Column:
    """``text`` with each match replaced."""
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.transform(found, lambda e: e["new"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text replaced, and column _found of struct(raw, kind, norm, new)."""
    text = F.col("text").cast("string")
    found = docs.withColumn("_found", surrogates(entities(text), key))
    return found.withColumn("text", _replaced(text, F.col("_found")))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text, n_entities and kinds (of each replaced entity, in order, comma-separated) of each row of ``docs``."""
    out = with_surrogates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), checked_key(docs.select("text"), key))
    kinds = F.filter(F.transform(F.coalesce(F.col("_found"), F.array()), lambda e: e["kind"]), lambda k: k.isNotNull())
    return out.select("doc_id", "text", F.size(kinds).cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))


def without_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with texts replaced and n_chars of the new texts, with the columns of documents."""
    docs = docs.select(*DOC_COLUMNS)
    out = with_surrogates(docs, checked_key(docs.select("text"), key))
    return out.withColumn("n_chars", F.when(F.size("_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOC_COLUMNS)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"))
