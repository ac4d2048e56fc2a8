"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern. A surrogate is the entity's canonical form under a keyed permutation of all forms of the
same shape: a Feistel network over its characters, each of which moves inside its own class (digits, letters of one script
and case, octets of one address block). A permutation gives different entities different surrogates whatever their number
and needs no table of those met; equal entities get equal surrogates in all documents. What makes the type stays: country
codes, top level domains, private address blocks, honorifics, and the check digits of cards and IBANs are right again.
Names become pronounceable ones word by word, by a code that can be undone, with the ending of the title's gender.

A surrogate may equal another entity of the data, or in a tiny domain its own; it never equals another's surrogate.
`collisions` checks that over a table, by aggregation.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_or_empty

EDGE, FREE = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
TITLES = {"m": r"Mr|Herr|Señor|Monsieur|г-н", "f": r"Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Mlle|г-жа", "n": r"Dr|Prof"}
TITLE = rf"(?:{TITLES['f']}|{TITLES['m']}|{TITLES['n']})\.? "
NAME_WORD = r"\p{Lu}[\p{L}'\-]{1,40}"
SECRET_NAME = r"(?i:token|secret|password|passwd|api[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
#: What an entity of each kind looks like.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}._+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){1,8}",
    "secret": EDGE + SECRET_NAME + r"(?=[\p{L}_\-+/]*\d|[\p{L}_\-+/]{12})[\p{L}\p{N}_\-+/]{6,}+",
    "key": EDGE + r"AKIA[0-9A-Z]{12,28}" + FREE,
    "iban": EDGE + r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}" + FREE,
    "ip": r"(?<![\p{L}\p{N}.])" + OCTET + r"(?:\." + OCTET + r"){3}(?!\.?[\p{L}\p{N}])",
    "phone": EDGE + r"(?:\+\d{1,3}[ .\-]?(?:\(\d{2,4}\)|\d{2,4})[ .\-]?\d{3}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}[.\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})" + FREE,
    "ssn": EDGE + r"\d{3}-\d{2}-\d{4}" + FREE,
    "card": EDGE + r"(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4})" + FREE,
    "name": EDGE + TITLE + NAME_WORD + rf"(?: {NAME_WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity without one of these.
HINT = rf"[0-9@]|{TITLE}\p{{Lu}}|{SECRET_NAME}"
#: Code point ranges inside which a letter or digit moves.
RANGES = [
    (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9),
    (0x410, 0x42F), (0x430, 0x44F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
#: In secrets hexadecimal letters stay hexadecimal.
HEX_RANGES = [(0x30, 0x39), (0x41, 0x46), (0x47, 0x5A), (0x61, 0x66), (0x67, 0x7A), *RANGES[3:]]
#: Syllables of invented names: first letters, vowels, last letters; first letters of a lone last syllable.
SOUNDS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "aeiou", "nrlstmd", "bdklmt", {"m": "nrsx", "f": "aeae"}),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "бвгджзклмнпрстфхцчшщ", "аеиоуя", "нрлсткмдв", "бдклмт", {"m": "нвкр", "f": "аяая"}),
}
ROUNDS = 6


def symbols(text: Column, ranges: list[tuple[int, int]], fixed: int | Column = 0) -> Column:
    """Array of (base, size, at) per character: it may become any of base..base+size-1. The first `fixed` ones stay."""

    def one(c: Column, i: Column) -> Column:
        def of(cp: Column) -> Column:
            block = cp - cp % 16
            free = c.rlike(r"^\p{L}")
            for a, z in ranges:
                free = free & ~((block <= z) & (block + 15 >= a))
            span = lambda base, size: F.struct(base.cast("int").alias("base"), size.cast("int").alias("size"), (cp - base).cast("int").alias("at"))
            out = F.when(i < fixed, span(cp, F.lit(1)))
            for a, z in ranges:
                out = out.when(cp.between(a, z), span(F.lit(a), F.lit(z - a + 1)))
            return out.when(free, span(block, F.lit(16))).otherwise(span(cp, F.lit(1)))

        return let(F.ascii(c), of)

    chars = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.transform(chars, one)


def permuted(key: str, domain: Column, syms: Column) -> Column:
    """The `at` of each symbol under the keyed permutation of the domain: halves shift one another in turn."""

    def stream(other: Column, r: Column, n: Column) -> Column:
        """Four hexadecimal digits for each of n symbols."""
        head = F.concat_ws("|", F.lit(key), domain, r.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        return let(head, lambda h: F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda b: F.sha2(F.concat_ws("|", h, b.cast("string")), 256))))

    def shifted(at: Column, sizes: Column, other: Column, r: Column) -> Column:
        return let(stream(other, r, F.size(at)), lambda s: F.transform(at, lambda a, i: (a + F.conv(F.substring(s, i * 4 + 1, F.lit(4)), 16, 10).cast("int")) % F.get(sizes, i)))

    def network(s: Column) -> Column:
        half = F.floor(F.size(s) / 2).cast("int")
        part = lambda field, side: F.transform(F.slice(s, F.lit(1), half) if side == 0 else F.slice(s, half + 1, F.size(s)), lambda x: x[field])

        def turn(state: Column, r: Column) -> Column:
            left = F.when(r % 2 == 0, shifted(state["l"], part("size", 0), state["r"], r)).otherwise(state["l"])
            right = F.when(r % 2 == 1, shifted(state["r"], part("size", 1), state["l"], r)).otherwise(state["r"])
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(part("at", 0).alias("l"), part("at", 1).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda state: F.concat(state["l"], state["r"]))

    return let(syms, network)


def spelled(codes: Column) -> Column:
    """Text of an array of code points."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 8, "0")), "")), "UTF-32")


def moved(key: str, domain: Column, text: Column, ranges: list[tuple[int, int]] = RANGES, fixed: int | Column = 0) -> Column:
    """text under the keyed permutation of all texts of its shape."""
    return let(symbols(text, ranges, fixed), lambda s: spelled(F.zip_with(s, permuted(key, domain, s), lambda x, at: x["base"] + at)))


def luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn test."""
    each = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))), F.lit(10)).cast("string")


def iban_digits(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN."""
    step = lambda a, c: F.when(c.rlike(r"\d"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def kind_of(value: Column) -> Column:
    """The kind of a match; null for what only looks like a card or an IBAN: its check digits are wrong."""
    card = lambda d: luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1))
    iban = iban_digits(F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))) == F.substring(value, 3, 2)
    return (
        F.when(value.rlike("^" + SECRET_NAME), "secret").when(F.contains(value, F.lit("@")), "email").when(value.rlike(r"^AKIA[0-9A-Z]{12}"), "key")
        .when(value.rlike(r"^[A-Z]{2}\d"), F.when(iban, "iban")).when(value.rlike(rf"^(?:{TITLE})?{NAME_WORD}(?: {NAME_WORD})?$"), "name")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(value.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone")
        .otherwise(F.when(let(digits_of(value), card), "card"))
    )


def bare(value: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(value, "^" + TITLE, "")


def title_gender(value: Column) -> Column:
    return F.when(value.rlike(rf"^(?:{TITLES['f']})\.? "), "f").when(value.rlike(rf"^(?:{TITLES['m']})\.? "), "m").otherwise("n")


def canonical(kind: Column, value: Column, gender: Column) -> Column:
    """What makes two mentions the same entity: digits of numbers, the value of a secret, a name's words and gender."""
    plus = F.when(value.startswith("+"), "+").otherwise("")
    return (
        F.when(kind == "phone", F.concat(plus, digits_of(value))).when(kind.isin("card", "ssn"), digits_of(value))
        .when(kind == "secret", F.regexp_replace(value, "^" + SECRET_NAME, "")).when(kind == "name", F.concat(gender, F.lit(":"), F.lower(bare(value))))
        .when(kind.isin("key", "iban"), value).otherwise(F.lower(value))
    )


def octet_symbols(parts: Column) -> Column:
    """Octets move inside address blocks, so that private and loopback addresses stay what they are."""
    first = F.get(parts, F.lit(0)).cast("int")

    def one(p: Column, i: Column) -> Column:
        v = p.cast("int")
        span = lambda a, z: F.struct(F.lit(a).alias("base"), F.lit(z - a + 1).alias("size"), (v - a).alias("at"))
        chain = None
        blocks = [(i == 0, a, z) for a, z in ((10, 10), (127, 127), (172, 172), (192, 192), (0, 9), (11, 126), (128, 171), (173, 191))] + [(i == 0, 193, 255)]
        blocks += [((i == 1) & (first == 192), a, z) for a, z in ((168, 168), (0, 167), (169, 255))] + [((i == 1) & (first == 172), a, z) for a, z in ((16, 31), (0, 15), (32, 255))]
        for where, a, z in blocks:
            test = where & v.between(a, z)
            chain = F.when(test, span(a, z)) if chain is None else chain.when(test, span(a, z))
        return chain.otherwise(span(0, 255))

    return F.transform(parts, one)


def named(key: str, gender: Column, words: Column) -> Column:
    """Surrogate of a lower-case name. A last name hangs on itself alone, so mentions of one family stay related."""

    def coded(script: str, p: Column) -> Column:
        """Two letters to a syllable of three, an odd last one to one of two: a code that can be undone."""
        letters, heads, vowels, tails, lone, _ = SOUNDS[script]
        sub = lambda text, at: F.substring(F.lit(text), at.cast("int") + 1, F.lit(1))
        rank = lambda c: F.instr(F.lit(letters), c) - 1

        def syllable(pair: Column) -> Column:
            def two(v: Column) -> Column:
                return F.concat(sub(heads, F.floor(v / (len(vowels) * len(tails)))), sub(vowels, F.floor(v / len(tails)) % len(vowels)), sub(tails, v % len(tails)))

            one = let(rank(pair), lambda v: F.concat(sub(lone, F.floor(v / len(vowels))), sub(vowels, v % len(vowels))))
            return F.when(F.length(pair) == 2, let(rank(F.substring(pair, 1, 1)) * len(letters) + rank(F.substring(pair, 2, 1)), two)).otherwise(one)

        return F.concat_ws("", F.transform(F.regexp_extract_all(p, F.lit("..?"), F.lit(0)), syllable))

    def run(role: Column, r: Column) -> Column:
        p = moved(key, F.concat(F.lit("name|"), role), r)
        new = let(p, lambda x: F.when(r.rlike("^[a-z]+$"), coded("latin", x)).when(r.rlike("^[а-я]+$"), coded("cyrillic", x)).otherwise(x))
        return let(new, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, F.lit(2), F.length(n))))

    def ending(w: Column) -> Column:
        pick = F.ascii(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ending"), w), 256)) % 4 + 1
        by = lambda script: F.when(gender == "m", F.substring(F.lit(SOUNDS[script][5]["m"]), pick, F.lit(1))).when(gender == "f", F.substring(F.lit(SOUNDS[script][5]["f"]), pick, F.lit(1))).otherwise("")
        return F.when(w.rlike("[a-z]$"), by("latin")).when(w.rlike("[а-я]$"), by("cyrillic")).otherwise("")

    def word(w: Column, last: Column) -> Column:
        role = F.when(last, "last").otherwise(F.concat(F.lit("first-"), gender))
        tokens = F.transform(F.regexp_extract_all(w, F.lit(r"[^'\-]+|['\-]"), F.lit(0)), lambda t: F.when(t.rlike(r"^['\-]"), t).otherwise(run(role, t)))
        return F.concat(F.concat_ws("", tokens), F.when(last, "").otherwise(ending(w)))

    return let(F.split(words, " "), lambda ws: F.array_join(F.transform(ws, lambda w, i: word(w, i == F.size(ws) - 1)), " "))


def fake(key: str, kind: Column, canon: Column) -> Column:
    """The canonical form of the surrogate (a name without gender, in title case)."""
    domain = lambda name: F.lit(name)
    at = F.instr(canon, "@")
    host = F.substring(canon, at + 1, F.length(canon))
    tail = F.regexp_extract(host, r"((?:\.example)?\.[^.@]+)$", 1)
    head = F.substring(host, F.lit(1), F.length(host) - F.length(tail))
    mail = F.concat(moved(key, F.concat(F.lit("local|"), host), F.substring(canon, F.lit(1), at - 1)), F.lit("@"), moved(key, domain("host"), head), tail)
    code = F.when(canon.startswith("+"), F.when(canon.rlike(r"^\+[17]"), 2).otherwise(3)).otherwise(0)
    address = let(octet_symbols(F.split(canon, r"\.")), lambda s: F.array_join(F.transform(F.zip_with(s, permuted(key, domain("ip"), s), lambda x, a: x["base"] + a), lambda v: v.cast("string")), "."))
    card = let(moved(key, domain("card"), F.substring(canon, F.lit(1), F.length(canon) - 1), fixed=1), lambda b: F.concat(b, luhn_digit(b)))
    country = F.substring(canon, 1, 2)
    iban = let(moved(key, F.concat(F.lit("iban|"), country), F.substring(canon, F.lit(5), F.length(canon))), lambda b: F.concat(country, iban_digits(country, b), b))
    return (
        F.when(kind == "email", mail).when(kind == "secret", moved(key, domain("secret"), canon, HEX_RANGES)).when(kind == "key", moved(key, domain("key"), canon, fixed=4))
        .when(kind == "iban", iban).when(kind == "ip", address).when(kind == "phone", moved(key, domain("phone"), canon, fixed=code)).when(kind == "ssn", moved(key, domain("ssn"), canon))
        .when(kind == "card", card).when(kind == "name", named(key, F.substring(canon, 1, 1), F.substring(canon, F.lit(3), F.length(canon)))).otherwise(canon)
    )


def poured(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the format of this mention: separators, prefixes and case as they are here."""

    def number() -> Column:
        digits = digits_of(new)
        step = lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["out"], F.substring(digits, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))
        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]

    cased = F.concat_ws("", F.zip_with(F.split(value, ""), F.split(new, ""), lambda o, c: F.when(o.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)))
    name = F.concat(F.regexp_extract(value, "^" + TITLE, 0), F.when(bare(value).rlike(r"\p{Ll}"), new).otherwise(F.upper(new)))
    return F.when(kind.isin("phone", "card", "ssn"), number()).when(kind == "secret", F.concat(F.regexp_extract(value, "^" + SECRET_NAME, 0), new)).when(kind == "name", name).when(kind == "email", cased).otherwise(new)


def titled(text: Column) -> Column:
    """Array of the names that follow a title."""
    return F.when(text.rlike(rf"{TITLE}\p{{Lu}}"), F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def pattern_for(names: Column) -> Column:
    """The pattern of a document: ANY, and the names that it has after titles wherever else they stand, whole or word by
    word, longer ones first. Names hold letters, apostrophes and hyphens only."""
    alone = F.transform(names, bare)
    every = F.array_distinct(F.concat(alone, F.flatten(F.transform(alone, lambda n: F.split(n, " ")))))
    ordered = F.transform(F.sort_array(F.transform(every, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: x["n"])
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{ANY}|{EDGE}(?:"), F.array_join(ordered, "|"), F.lit(f"){FREE}"))).otherwise(F.lit(ANY))


def found(text: Column, names: Column, pattern: Column) -> Column:
    """Array of (kind, value, canon) in the order of the text; kind null: no entity after all."""

    def gender(v: Column) -> Column:
        """By the mention's own title, else by one that the same name has elsewhere in the document."""
        words = F.concat(F.lit(" "), bare(v), F.lit(" "))
        kin = F.filter(names, lambda n: title_gender(n).isin("m", "f") & F.contains(F.concat(F.lit(" "), bare(n), F.lit(" ")), words))
        return F.when(title_gender(v) != "n", title_gender(v)).otherwise(F.coalesce(title_gender(F.get(kin, F.lit(0))), F.lit("n")))

    raw = F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(raw, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    return F.transform(typed, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), canonical(e["kind"], e["value"], gender(e["value"])).alias("canon")))


def entities_of(docs: DataFrame, text: str) -> DataFrame:
    """docs with _pattern and _found."""
    body = text_or_empty(F.col(text))
    rows = docs.withColumn("_names", titled(body)).withColumn("_pattern", pattern_for(F.col("_names")))
    return rows.withColumn("_found", found(body, F.col("_names"), F.col("_pattern"))).drop("_names")


def surrogate_text(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with `text` rewritten and _n_entities (long).

    A null text stays null and an empty one empty, with 0 entities; repeated rows are each rewritten alike; an empty table
    stays empty. Other columns pass through, but columns named _n_entities, _names, _pattern or _found are replaced or
    dropped. Rows are judged one by one: nothing is shuffled.
    """
    rows = entities_of(docs, text)
    new = F.transform("_found", lambda e: F.when(e["kind"].isNull(), e["value"]).otherwise(let(fake(key, e["kind"], e["canon"]), lambda n: poured(e["kind"], e["value"], n))))
    woven = F.concat_ws("", F.flatten(F.zip_with(F.split(F.col(text), F.col("_pattern"), -1), new, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))))
    rows = rows.withColumn("_n_entities", F.size(F.filter("_found", lambda e: e["kind"].isNotNull())).cast("long"))
    return rows.withColumn(text, F.when(F.col("_n_entities") > 0, woven).otherwise(F.col(text))).drop("_found", "_pattern")


def collisions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(kind, surrogate, n): surrogates shared by n > 1 entities of docs, names told apart by gender only in their first
    word. Empty, unless the permutation is broken."""
    each = entities_of(docs, text).select(F.explode("_found").alias("e")).where("e.kind is not null").select("e.kind", "e.canon").distinct()
    each = each.withColumn("surrogate", fake(key, F.col("kind"), F.col("canon")))
    own = F.when((F.col("kind") == "name") & ~F.contains("canon", F.lit(" ")), F.substring("canon", F.lit(3), F.length("canon"))).otherwise(F.col("canon"))
    return each.withColumn("canon", own).groupBy("kind", "surrogate").agg(F.count_distinct("canon").alias("n")).where("n > 1")


def configured_key(spark: SparkSession) -> str:
    """The key in spark.reportlake.surrogateKey; without one a fresh random key, under which surrogates agree within this
    call only and nobody can compute them again."""
    return spark.conf.get("spark.reportlake.surrogateKey", None) or secrets.token_hex(32)
