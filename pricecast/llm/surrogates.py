"""Surrogates for personal data.

Entities are found by patterns: addresses of mail, secrets after a key word, account numbers, network
addresses, card and social security numbers, phone numbers, and names after a title or a common given name. Each
entity (a name: each of its words) gets a replacement derived from a secret key, so the same entity is replaced in the
same way in all documents. The replacement has the same type and format: separators, letter case and
country codes stay, card numbers keep their network digit and pass the same checksum test, account numbers get valid
check digits, names keep gender (by title or given name) and script.

Distinctness is checked over the whole corpus: the table of distinct entities gets its replacements, and where two
entities of a kind share one, or one equals an entity that occurs, the later ones (by a fixed order) try again with
the next attempt until none is left. Attempts above zero are the exception; only documents that hold such an entity are
joined with them, all others are replaced from their own row alone.

Only SQL functions are used. Entities are aggregated before they are shuffled. Texts are shuffled only where there are
exceptions, and then only if the table of texts that hold one is too large for adaptive execution to send out.

Groups in patterns repeat a bounded number of times, since each round takes a place on the stack: a mail domain has at
most 128 labels (as in the name system), what stands before the sign at most 256 characters.

Defined results: very long texts are treated like others; a null text stays null, an empty one empty; repeated rows are replaced alike; an empty table gives an
empty one; all columns are kept, the text is replaced in place, and the two added columns take free names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricecast.llm.common import free_name
from pricecast.sources.scratch import settle

# Titles and given names with the gender they tell.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Hans Klaus Jürgen Wolfgang Pierre Jean Jacques François José Juan Carlos Luis Miguel Иван Сергей Алексей Дмитрий Γιώργος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Emma Julia Petra Sabine Ursula Marie Sophie Camille Isabelle Nathalie María Carmen Ana Lucía Elena Анна Мария Ольга Наталья Ελένη".split(),
}
# Syllables and endings of invented names, by script.
SYLLABLES = {
    "latin": ["bel", "cor", "dan", "fer", "gal", "hol", "jan", "kel", "lor", "mar", "nor", "pel", "ros", "sel", "tor", "val"],
    "cyrillic": ["бел", "вор", "гал", "дан", "жар", "кол", "лар", "мар", "нор", "пел", "рос", "сол", "тор", "фед", "хол", "яр"],
    "greek": ["βελ", "γαλ", "δαν", "θερ", "καρ", "λορ", "μαρ", "νικ", "παλ", "ροδ", "σελ", "τορ", "φιλ", "χαρ", "ψαλ", "ζην"],
}
ENDINGS = {
    ("latin", "given_m"): ["on", "us", "ert", "in"],
    ("latin", "given_f"): ["a", "ia", "ette", "ine"],
    ("latin", "family"): ["ley", "mann", "ier", "ez"],
    ("cyrillic", "given_m"): ["ий", "ан", "ор", "ей"],
    ("cyrillic", "given_f"): ["а", "ия", "ина", "ея"],
    ("cyrillic", "family"): ["енко", "ук", "ич", "ян"],
    ("greek", "given_m"): ["ος", "ης", "ων", "ας"],
    ("greek", "given_f"): ["α", "η", "ια", "ώ"],
    ("greek", "family"): ["ίδης", "άκης", "όπουλος", "άτος"],
}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"\p{Lu}[\p{L}'’-]++"
_titles = "|".join(t for ts in TITLES.values() for t in ts)
_given = "|".join(g for gs in GIVEN.values() for g in gs)
SECRET_KEYS = r"(?i:pass(?:word|wd)|pwd|secret|token|api[_-]?key|access[_-]?key)"

# By kind; where two could begin at a place of the text, the earlier one is tried first.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,256}+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?){0,126}\.[A-Za-z]{2,}",
    "secret": rf"(?=[PpSsTtAa]){SECRET_KEYS}\s{{0,2}}[=:]\s{{0,2}}\"?[0-9A-Za-z_+/-]{{8,}}+",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{32,64})(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}|(?<![.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?:(?:{_titles})\.? {WORD}(?: {WORD})?|(?:{_given}) {WORD})",
}
WITH_LETTERS, WITH_DIGITS = ("email", "secret", "key", "iban", "name"), ("email", "key", "ip", "ssn", "phone", "card")
# An entity begins where a word or number does; most places of a text are passed by with that one look back.
ANY = (
    r"(?<![0-9\p{L}])(?:(?=\p{L})(?:"
    + "|".join(PATTERNS[k] for k in WITH_LETTERS)
    + r")|(?=[0-9+(._%-])(?:"
    + "|".join(PATTERNS[k] for k in WITH_DIGITS)
    + "))"
)
UNIT = "struct<kind:string,norm:string>"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(mention: Column) -> Column:
    found = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def secret_value(mention: Column) -> Column:
    return F.regexp_extract(mention, r"([0-9A-Za-z_+/-]{8,})$", 1)


def name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, rf"^(?:{_titles})\.? ", ""), " ")


def title_of(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^((?:{_titles})\.? )", 1)


def gender_of(mention: Column) -> Column:
    """From the title, else from the given name, else by the key alone."""
    title = F.regexp_replace(title_of(mention), r"[. ]", "")
    given = F.get(name_words(mention), F.lit(0))
    return (
        F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").when(given.isin(*GIVEN["m"]), "m").when(given.isin(*GIVEN["f"]), "f")
        .otherwise(F.when(F.crc32(given) % 2 == 0, "m").otherwise("f"))
    )


def units_of(mention: Column, kind: Column) -> Column:
    """array<struct<kind, norm>>: what a mention refers to, in a form free of its format."""

    def one(k: Column, norm: Column) -> Column:
        return F.struct(k.alias("kind"), norm.alias("norm"))

    words = name_words(mention)
    digits = digits_of(mention)
    norm = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "secret", secret_value(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind.isin("card", "ssn"), digits)
        .otherwise(mention)
    )
    names = F.transform(
        words,
        lambda w, i: one(F.when((i == 0) & (F.size(words) > 1), F.concat(F.lit("given_"), gender_of(mention))).otherwise("family"), F.lower(w)),
    )
    # A secret and a bare key of the same value are the same entity.
    return F.when(kind == "name", names).otherwise(F.array(one(F.when(kind == "key", "secret").otherwise(kind), norm)))


def stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """512 keyed bits as 128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)


def number(bits: Column, at: Column, size: int) -> Column:
    """A number from ``size`` hexadecimal digits of the stream, which repeats."""
    return F.conv(F.substr(bits, F.pmod(at * size, F.lit(128 - size)) + 1, F.lit(size)), 16, 10).cast("long")


def redrawn(text: Column, bits: Column, digits_only: bool = False) -> Column:
    """Digits for digits and letters for letters of the same case, everything else as it is; hexadecimal stays so."""
    hexadecimal = text.rlike("^([0-9a-f]+|[0-9A-F]+)$")

    def draw(c: Column, i: Column) -> Column:
        n = number(bits, i.cast("int"), 4)
        letters = F.when(hexadecimal, 6).otherwise(26)
        out = F.when(c.rlike("[0-9]"), F.substr(F.lit(DIGITS), (n % 10 + 1).cast("int"), F.lit(1)))
        if not digits_only:
            out = out.when(c.rlike("[a-z]"), F.substr(F.lit(LOWER), (n % letters + 1).cast("int"), F.lit(1)))
            out = out.when(c.rlike("[A-Z]"), F.substr(F.lit(UPPER), (n % letters + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo ten; zero for a valid number."""
    # Doubled digits of 5 and more count as their digit sum.
    folded = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(folded, F.lit(0), lambda a, x: a + x) % 10


def with_check_digit(body: Column, remainder: Column) -> Column:
    """``body`` and the last digit that gives the Luhn sum the wanted remainder."""
    return let(body, lambda b: F.concat(b, F.pmod(remainder - luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def iban_check(rest: Column, country: Column) -> Column:
    """The two check digits of an account number."""
    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)

    total = F.aggregate(
        F.split(F.concat(rest, country, F.lit("00")), ""),
        F.lit(0),
        lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97),
    )
    return F.lpad((98 - total).cast("string"), 2, "0")


def invented_name(kind: Column, norm: Column, attempt: Column, bits: Column) -> Column:
    """Two syllables and an ending; each further attempt may add a syllable, so there are names enough."""
    script = F.when(norm.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def pick(values: list[str], at: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), (number(bits, at, 4) % len(values)).cast("int"))

    made = None
    for s, syllables in SYLLABLES.items():
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1) + attempt.cast("int")), lambda i: pick(syllables, i)), "")
        for k in ("given_m", "given_f", "family"):
            name = F.concat(stem, pick(ENDINGS[s, k], F.lit(29)))
            here = (script == s) & (kind == k)
            made = F.when(here, name) if made is None else made.when(here, name)
    return made


def replacement(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The replacement of an entity in the form of ``norm``: a function of key, kind, norm and attempt."""
    return let(stream(key, kind, norm, attempt), lambda bits: drawn_from(bits, kind, norm, attempt))


def drawn_from(bits: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    local = F.substring_index(norm, "@", 1)
    mail = F.concat(redrawn(local, bits), F.lit("@"), F.concat(F.lit("m"), F.substring(bits, 97, 8), F.lit(".example.org")))
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, 1 + number(bits, i, 8) % 223).otherwise(number(bits, i, 8) % 256).cast("string"))
    card = F.concat(F.substring(norm, 1, 1), redrawn(F.substr(norm, F.lit(2), F.length(norm) - 2), bits, True))
    account = redrawn(F.substr(norm, F.lit(5), F.length(norm)), bits)
    country = F.substring(norm, 1, 2)
    phone = F.concat((2 + number(bits, F.lit(30), 4) % 8).cast("string"), redrawn(F.substr(norm, F.lit(2), F.length(norm)), bits, True))
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", with_check_digit(card, luhn(norm)))
        .when(kind == "iban", let(account, lambda a: F.concat(country, iban_check(a, country), a)))
        .when(kind == "phone", phone)
        .when(kind.isin("given_m", "given_f", "family"), invented_name(kind, norm, attempt, bits))
        .otherwise(redrawn(norm, bits))
    )


def in_format(mention: Column, characters: Column) -> Column:
    """``characters`` put one by one in the places of the last digits and letters of the mention."""
    return let(characters, lambda c: filled(mention, c))


def filled(mention: Column, characters: Column) -> Column:
    cells = F.split(mention, "")
    size = F.length(F.regexp_replace(mention, "[^0-9A-Za-z]", ""))
    start = F.struct(F.lit("").alias("out"), (F.length(characters) - size).cast("int").alias("at"))

    def put(a: Column, c: Column) -> Column:
        real = c.rlike("[0-9A-Za-z]")
        new = F.when(real & (a["at"] >= 0), F.substr(characters, a["at"] + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(a["out"], new).alias("out"), F.when(real, a["at"] + 1).otherwise(a["at"]).alias("at"))

    return F.aggregate(cells, start, put, lambda a: a["out"])


def cased(name: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(F.initcap(name))


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def found_units(mentions: Column) -> Column:
    return F.flatten(F.transform(mentions, lambda m: let(kind_of(m), lambda kind: units_of(m, kind))))


def substituted(mention: Column, key: str, attempts: Column) -> Column:
    """The text that stands for a mention; ``attempts`` is array<struct<kind, norm, attempt>>, null for none."""

    def drawn(unit: Column) -> Column:
        again = F.filter(attempts, lambda x: (x["kind"] == unit["kind"]) & (x["norm"] == unit["norm"]))
        attempt = F.coalesce(F.get(again, F.lit(0))["attempt"], F.lit(0))
        return let(attempt, lambda a: replacement(key, unit["kind"], unit["norm"], a))

    def put(kind: Column, new: Column) -> Column:
        first, value = F.get(new, F.lit(0)), secret_value(mention)
        return (
            F.when(kind == "name", F.concat(title_of(mention), F.array_join(F.zip_with(new, name_words(mention), cased), " ")))
            .when(kind == "secret", F.concat(F.substr(mention, F.lit(1), F.length(mention) - F.length(value)), first))
            .when(kind.isin("phone", "card", "ssn", "iban"), in_format(mention, first))
            .otherwise(first)
        )

    return let(kind_of(mention), lambda kind: let(F.transform(units_of(mention, kind), drawn), lambda new: put(kind, new)))


def entities(docs: DataFrame, text: str) -> DataFrame:
    """kind, norm: the distinct entities of all documents."""
    # Outer, so that no filter on the size of the array is derived, which would search each text again.
    units = docs.select(F.explode_outer(found_units(mentions_of(F.col(text)))).alias("u")).where("u IS NOT NULL")
    return units.select("u.kind", "u.norm").distinct()


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt of the entities whose first replacement would not be distinct."""
    pending, done, accepted = known.withColumn("attempt", F.lit(0)), [], None
    while True:
        tried = settle(pending.withColumn("new", replacement(key, F.col("kind"), F.col("norm"), F.col("attempt"))))
        taken = known.select("kind", F.col("norm").alias("new"))
        if accepted is not None:
            taken = taken.unionByName(accepted.select("kind", "new"))
        first = tried.groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        good = settle(first.join(taken, ["kind", "new"], "left_anti").join(tried.select("kind", "norm", "attempt"), ["kind", "norm"]))
        accepted = good if accepted is None else accepted.unionByName(good)
        done.append(good.where("attempt > 0").select("kind", "norm", "attempt"))
        pending = settle(tried.join(good, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        if pending.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns, the text with its entities replaced, and ``n_entities`` and ``entity_kinds``."""
    names = docs.columns
    n_name, kinds_name = free_name(names, "n_entities"), free_name(names, "entity_kinds")
    again = settle(exceptions(settle(entities(docs, text)), key))
    marked = docs.withColumn("_mentions", F.coalesce(mentions_of(F.col(text)), F.array().cast("array<string>")))
    if again.isEmpty():
        marked = marked.withColumn("_attempts", F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        # The texts that hold an exception, found from their entities, under a digest of the text.
        units = docs.select(F.sha2(text, 256).alias("_digest"), F.explode_outer(found_units(mentions_of(F.col(text)))).alias("u"))
        units = units.where("u IS NOT NULL").select("_digest", "u.kind", "u.norm")
        hit = units.join(again, ["kind", "norm"]).groupBy("_digest")
        hit = settle(hit.agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("_attempts")))
        marked = marked.withColumn("_digest", F.when(F.size("_mentions") > 0, F.sha2(text, 256))).join(hit, "_digest", "left")
    mentions = F.col("_mentions")
    new = F.transform(mentions, lambda m: substituted(m, key, F.col("_attempts")))
    pieces = F.split(F.col(text), ANY, -1)  # only of texts with an entity
    put = F.array_join(F.zip_with(pieces, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    replaced = F.when(F.size(mentions) > 0, put).otherwise(F.col(text))
    return marked.select(
        *(replaced.alias(c) if c == text else F.col(f"`{c}`") for c in names),
        F.size(mentions).cast("long").alias(n_name),
        F.array_join(F.array_sort(F.array_distinct(F.transform(mentions, kind_of))), ",").alias(kinds_name),
    )
