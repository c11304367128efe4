"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities are replaced by values of the same kind: same length, script,
letter case and punctuation, card numbers with the same Luhn status, IBANs with
right check digits, addresses from reserved ranges and domains, names of the same
script and gender; a shortened IPv6 address becomes one of the range for documentation
and may be longer, and a secret's letters without case become Latin ones. A surrogate
depends on a secret key and the entity alone, so an entity is the same surrogate in all
documents, a family name with and without a given name, and a domain, whatever its case,
in all its addresses.

A name's gender is that of its form of address. Behind a form that tells none (Dr) a given
name has the gender that it has elsewhere in the text, else the one it has most often in
the corpus, so that one person keeps one name. Names are found behind a form of address
or a greeting only, all words of them, and then wherever the whole name stands in the same text. A
word of it that stands alone is replaced too, unless it is a common word (``COMMON``) or the text has it in
lower case as well: "It took a Long time" is not about Mr Long.

The distinct entities of the corpus are checked, of all kinds together: where two share a
surrogate, or a surrogate is itself an entity, the later one draws again, until none does.
Then different entities stay different. Where a form has too few values, as an address of
one letter has, later draws are longer by more and more characters, so an end comes always.

The texts are searched once and written with what was found; only what was found is
shuffled apart from them, and only texts with an entity meet their replacements in a join.

Edge cases. Null and empty texts stay as they are. Rows are told apart by a number of their
own, so null and repeated doc_ids are like any other. Other columns pass through, whatever their names; of columns
named ``n_entities`` or ``kinds`` in the input, the result has its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, plain_names, written

# Forms of address with the gender that they tell.
FORMS = {
    "m": ["Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "Don", "Sir", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Signora", "Lady", "Госпожа", "Κυρία"],
    "n": ["Mx", "Dr", "Prof", "Dear"],
}
# Whom a letter greets without a name.
GREETED = "Sir Sirs Madam All Team Customer Customers Friend Friends Reader Readers Editor Colleague Colleagues Members Student Students Parents Guest Guests Everyone God Lord".split()
# Names that are common words too, in lower case. A mention of one alone is not taken for the person.
COMMON = (
    "will may june april august mark bill rose grace hope faith joy long young brown white black green gray grey king hill wood woods stone park field day price rich frank grant chase hunter page little best cross case bush rice lake "
    "short small sharp smart savage summer autumn dawn art gene pat sue jack rob drew miles wade dale glen ray ward bell bond book banks brook brooks cook fish fox frost gold hall hand hart head hood house hunt law lane love major marsh "
    "mason moon moore noble north south east west pearl pope power reed sage sands shields skinner snow spring steel strong sweet temple turner walker wall waters wise wolf worth"
).split()
# Syllables of made-up names by script, and endings by role.
SYLLABLES = {
    "latin": "ba ke li mo nu ra se ti vo da fe gi jo lu na pe".split(),
    "cyrillic": "ба ке ли мо ну ра се ти во да фе ги зо лу на пе".split(),
    "greek": "βα κε λι μο νυ ρα σε τι φο δα θε γι ζο λυ να πε".split(),
}
ENDINGS = {
    "latin": {"m": "ldo", "f": "lia", "n": "len", "family": "rson"},
    "cyrillic": {"m": "слав", "f": "лина", "n": "ша", "family": "ренко"},
    "greek": {"m": "νος", "f": "νια", "n": "νι", "family": "δης"},
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
_NAME = r"\p{Lu}[\p{L}'’]++(?:-\p{Lu}[\p{L}'’]++)*+"
_FORM = "|".join(f for fs in FORMS.values() for f in fs)
_WORD = rf"(?!(?:{_FORM}|{'|'.join(GREETED)})(?!\p{{L}})){_NAME}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: What stands before a secret's value.
_SECRET = r"(?i:password|passwd|pwd|secret|api_?key)[\"']?[ \t]*+[=:][ \t]*+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kinds in the order in which they are tried. A domain has at most 127 labels by its standard.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ip6": rf"(?<![:\w])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![:\w]|\.\d)",
    # A quoted value goes up to the quote that closes it, a bare one up to a space.
    "secret": rf"(?<![A-Za-z]){_SECRET}(?:" + "|".join(rf"{q}(?![^{q}\r\n]{{0,5}}{q})[^\r\n]{{6,}}?(?<!\\){q}" for q in "\"'") + r"|[\"']?[^\s\"'<>|]{6,}+)",
    "cloud_key": r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "token": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+.,-])(?:(?<!\d )0\d{2,4}[ /-]\d{3,4}[ -]\d{3,4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_FORM})\.? {_WORD}(?: {_WORD})*+",
}


def _plain(pattern: str) -> str:
    """Without capturing groups, to stand in an alternation."""
    return pattern.replace(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}", r"\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}")


PATTERN = "|".join(_plain(p) for p in KINDS.values())
#: A text without this has no entity.
_HINT = rf"[0-9@]|{_SECRET}|[A-Fa-f]{{32}}|(?<!\p{{L}})(?:{_FORM})\.? \p{{Lu}}"


@dataclass(frozen=True)
class Surrogates:
    """``key`` is the secret that surrogates depend on. Draws up to ``plain`` keep to an entity's form, later ones are longer."""

    key: str = field(repr=False)
    plain: int = 6


def _kind(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(match.rlike(rf"^(?:{_plain(pattern)})$"), kind).otherwise(out)
    return out


def _gender(match: Column) -> Column:
    form = F.regexp_extract(match, r"^(\p{L}+)", 1)
    return F.when(form.isin(FORMS["m"]), "m").when(form.isin(FORMS["f"]), "f").otherwise("n")


def _units(match: Column) -> Column:
    """What is looked up for a match: (kind, entity). The words of a name, an address and its domain, the value of a secret, else the match."""
    kind = _kind(match)
    words = F.slice(F.split(match, " "), 2, F.length(match))
    unit = lambda k, e: F.struct(k.alias("kind"), e.alias("entity"))
    names = F.transform(words, lambda w, i: unit(F.when(i == F.size(words) - 1, F.lit("family")).otherwise(_gender(match)), w))
    value = F.regexp_extract(match, rf"(?s)^{_SECRET}[\"']?(.*?)[\"']?\z", 1)
    domain = F.lower(F.regexp_extract(match, "@(.*)$", 1))
    address = F.array(unit(kind, F.concat(F.regexp_extract(match, "^([^@]*@)", 1), domain)), unit(F.lit("domain"), domain))
    return F.when(kind == "name", names).when(kind == "email", address).when(kind == "secret", F.array(unit(kind, value))).otherwise(F.array(unit(kind, match)))


def _digest(key: str, *parts: Column) -> Column:
    """A keyed digest of 128 hexadecimal characters; the key goes in twice, inside and out."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 256)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}\u0002{i}"), inner), 256) for i in range(2)])


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (2 * F.pmod(i, F.lit(64)) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _shaped(text: Column, digest: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Digits to digits, letters to letters of the same case; all else stays."""

    def char(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        pick = lambda s: F.substring(F.lit(s), F.pmod(b, F.lit(len(s))) + 1, F.lit(1))
        return F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike(r"^\p{Ll}$"), pick(letters)).when(c.rlike(r"^\p{Lu}$"), pick(letters.upper())).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of an array of digits."""
    n = F.size(digits)

    def weigh(d: Column, i: Column) -> Column:
        twice = F.when(F.pmod(n - i, F.lit(2)) == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(entity: Column, digest: Column) -> Column:
    """Keeps the first digit, the grouping, and whether the Luhn check passes."""
    digits = F.transform(F.split(F.regexp_replace(entity, "[^0-9]", ""), ""), lambda c: c.cast("int"))
    valid = _luhn(digits) == 0
    drawn = F.transform(digits, lambda d, i: F.when(i == 0, d).when(i == F.size(digits) - 1, F.lit(0)).otherwise(F.pmod(_byte(digest, i), F.lit(10))))
    check = F.pmod(10 - _luhn(drawn), F.lit(10))
    last = F.when(valid, check).otherwise(F.pmod(check + 1 + F.pmod(_byte(digest, F.lit(63)), F.lit(9)), F.lit(10)))
    flat = F.concat(F.array_join(F.transform(F.slice(drawn, 1, F.size(drawn) - 1), lambda d: d.cast("string")), ""), last.cast("string"))
    sep = F.regexp_extract(entity, "([ -])", 1)
    grouped = F.concat_ws(" ", *[F.substring(flat, 4 * k + 1, 4) for k in range(3)], F.substring(flat, 13, 7))
    return F.when(sep == "", flat).otherwise(F.translate(grouped, " ", sep) if isinstance(sep, str) else F.regexp_replace(grouped, F.lit(" "), sep))


def _iban(entity: Column, digest: Column) -> Column:
    """Keeps the country and grouping; the check digits are right."""
    country = F.substring(entity, 1, 2)
    rest = _shaped(F.substring(entity, 5, 64), digest)
    chars = F.split(F.concat(F.regexp_replace(rest, " ", ""), country, F.lit("00")), "")

    def add(a: Column, c: Column) -> Column:
        v = F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(F.when(v > 9, a * 100 + v).otherwise(a * 10 + v), F.lit(97))

    check = 98 - F.aggregate(chars, F.lit(0), add)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _name(kind: Column, entity: Column, digest: Column, attempt: Column) -> Column:
    """Syllables of the entity's script and an ending of its gender or role; later draws are longer."""

    def made(script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        stem = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: F.element_at(parts, F.pmod(_byte(digest, i), F.lit(16)) + 1)), "")
        ending = F.lit(ENDINGS[script]["n"])
        for role in ("m", "f", "family"):
            ending = F.when(kind == role, ENDINGS[script][role]).otherwise(ending)
        return F.concat(stem, ending)

    low = made("latin")
    for script, sign in SCRIPTS.items():
        low = F.when(entity.rlike(sign), made(script)).otherwise(low)
    title = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 99))
    return F.when((F.length(entity) > 1) & (F.upper(entity) == entity), F.upper(low)).otherwise(title)


def surrogate(kind: Column, entity: Column, attempt: Column, o: Surrogates) -> Column:
    """A value like ``entity`` that depends on the key, the entity and the draw. That of an address has the old domain still."""
    d = _digest(o.key, kind, entity, attempt.cast("string"))
    more = lambda after: F.translate(F.substring(d, F.lit(65), F.greatest(F.lit(0), attempt - after)), "0123456789", "ghijklmnop")
    zone = F.regexp_extract(entity, r"\.(com|net|org)$", 0)
    labels = F.transform(F.split(F.regexp_extract(entity, r"^(.*)\.[^.]*$", 1), r"\."), lambda x: F.regexp_replace(x, "^-|-$", "x"))
    host = F.concat(_shaped(F.array_join(labels, "."), d), more(1), F.lit(".example"), zone)
    octet = lambda i: _byte(d, F.lit(i)).cast("string")
    drawn = (
        F.when(kind == "email", F.concat(_shaped(F.regexp_extract(entity, "^([^@]*)@", 1), d), more(1), F.regexp_extract(entity, "(@.*)$", 1)))
        .when(kind == "domain", host)
        .when(kind == "ip", F.concat_ws(".", (240 + F.pmod(_byte(d, F.lit(0)), F.lit(15))).cast("string"), octet(1), octet(2), octet(3)))
        .when((kind == "ip6") & entity.contains("::"), F.concat(F.lit("2001:db8::"), F.concat_ws(":", *[F.substring(d, 4 * i + 1, 4) for i in range(4)])))
        .when(kind.isin("ip6", "token"), _shaped(entity, d, "abcdef"))
        .when(kind == "secret", _shaped(F.when(attempt < 4, F.regexp_replace(entity, r"[\p{L}&&[^\p{Lu}\p{Ll}]]", "x")).otherwise(F.regexp_replace(entity, r"[^\p{Lu}\p{Ll}0-9]", "x")), d))
        .when(kind == "cloud_key", F.concat(F.substring(entity, 1, 4), _shaped(F.substring(entity, 5, 16), d)))
        .when(kind == "iban", _iban(entity, d))
        .when(kind == "phone", F.concat(F.regexp_extract(entity, r"^(\+\d{1,3}(?=\D))?", 0), _shaped(F.regexp_replace(entity, r"^\+\d{1,3}(?=\D)", ""), d)))
        .when(kind == "ssn", F.concat(F.lit("9"), _shaped(F.substring(entity, 2, 99), d)))
        .when(kind == "card", _card(entity, d))
        .when(kind.isin("m", "f", "n", "family"), _name(kind, entity, d, attempt))
        .otherwise(_shaped(entity, d))
    )
    longer = (attempt > o.plain) & ~kind.isin("email", "domain", "m", "f", "n", "family")
    return F.when(longer, F.concat(drawn, F.when(kind == "token", "").otherwise("-"), F.substring(d, F.lit(65), attempt))).otherwise(drawn)


def assigned(entities: DataFrame, o: Surrogates) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity), no two surrogates alike and none an entity.

    Each round of draws has fewer entities than the one before that need another, and from some draw on
    the values for them grow by a factor with each round.
    """
    # Entities are small rows that cost much, so they are dealt out by number and not by size.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = entities.withColumn("attempt", F.lit(0))
    taken = cut(entities.select(F.col("entity").alias("surrogate")).distinct())
    while True:
        e = cut(e.repartition(tasks, "kind", "entity").withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), o)))
        order = Window.partitionBy("surrogate").orderBy("attempt", "kind", "entity")
        e = e.withColumn("again", F.row_number().over(order) > 1).join(taken.withColumn("taken", F.lit(True)), "surrogate", "left")
        e = cut(e.select("kind", "entity", "attempt", "surrogate", (F.col("again") | F.col("taken").isNotNull()).alias("again")))
        if e.where("again").isEmpty():
            return e.select("kind", "entity", "surrogate")
        e = e.select("kind", "entity", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def _gendered(units: DataFrame) -> DataFrame:
    """``role`` of each unit: its kind, but of a given name without a gender the one of its text, else of the corpus."""
    told = units.where("kind in ('m', 'f')")
    here = told.groupBy("_row", "entity").agg(F.min("kind").alias("least"), F.max("kind").alias("most")).where("least = most").select("_row", "entity", F.col("least").alias("here"))
    there = told.groupBy("entity").agg(F.sum(F.when(F.col("kind") == "m", 1).otherwise(-1)).alias("more"))
    there = there.select("entity", F.when(F.col("more") > 0, "m").when(F.col("more") < 0, "f").alias("there"))
    open_ = units.where("kind = 'n'").join(here, ["_row", "entity"], "left").join(there, "entity", "left")
    found = open_.select("_row", "kind", "entity", F.coalesce("here", "there", F.lit("n")).alias("role"))
    return units.where("kind != 'n'").withColumn("role", F.col("kind")).unionByName(found)


def replace_entities(docs: DataFrame, o: Surrogates, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and with ``n_entities`` and ``kinds`` (in order of place)."""
    docs, named = plain_names(docs, ("n_entities", "kinds"))
    text = named[text]
    hint = F.coalesce(F.col(text).rlike(_HINT), F.lit(False))
    found = F.when(hint, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.select("*", found.alias("_found"), F.monotonically_increasing_id().alias("_row"))
    names = list(named.values())
    docs = written(docs)
    clean = docs.where(F.size("_found") == 0).select(*names, F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    some = docs.where(F.size("_found") > 0)
    units = some.select("_row", F.explode(F.array_distinct(F.flatten(F.transform("_found", _units)))).alias("u")).select("_row", "u.kind", "u.entity")
    units = _gendered(cut(units))
    known = assigned(units.select(F.col("role").alias("kind"), "entity").distinct(), o)
    label = lambda k, e: F.concat(k, F.lit(":"), e)
    pairs = units.join(known.withColumnRenamed("kind", "role"), ["role", "entity"]).select("_row", F.struct(label(F.col("kind"), F.col("entity")).alias("unit"), "surrogate").alias("pair"))
    maps = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_set("pair")).alias("_map")).hint("shuffle_hash")
    joined = some.join(maps, "_row")

    def replaced(m: Column) -> Column:
        new = F.transform(_units(m), lambda u: F.element_at("_map", label(u["kind"], u["entity"])))
        address = F.concat(F.regexp_extract(new[0], "^([^@]*@)", 1), new[1])
        head, tail = F.regexp_extract(m, rf"^({_SECRET}[\"']?)", 1), F.regexp_extract(m, r"([\"']?)\z", 1)
        kind = _kind(m)
        return (
            F.when(kind == "name", F.concat(F.regexp_extract(m, r"^(\S+ )", 1), F.array_join(new, " ")))
            .when(kind == "email", address)
            .when(kind == "secret", F.concat(head, new[0], tail))
            .otherwise(new[0])
        )

    # Each as a column of its own: they are used several times, and their expressions are long.
    joined = joined.withColumns({"_kinds": F.transform("_found", _kind), "_new": F.transform("_found", replaced)})
    between = F.split(F.col(text), PATTERN, -1)
    whole = F.array_join(F.zip_with(between, "_new", lambda s, r: F.concat(F.coalesce(s, F.lit("")), F.coalesce(r, F.lit("")))), "")
    # Mentions of a name elsewhere in the same text: first whole names, then their words one by one.
    plain = lambda m: F.regexp_replace(m, r"^\S+ ", "")
    said = F.filter(F.arrays_zip("_kinds", "_found", "_new"), lambda n: (n["_kinds"] == "name") & F.contains(plain(n["_found"]), F.lit(" ")))
    joined = joined.withColumns({"_whole": whole, "_names": F.array_distinct(F.transform(said, lambda n: F.struct(plain(n["_found"]).alias("old"), plain(n["_new"]).alias("new"))))})
    alone = lambda word: F.concat(F.lit(r"(?<!\p{L})\Q"), word, F.lit(r"\E(?!\p{L})"))
    joined = joined.withColumn("_whole", F.aggregate("_names", F.col("_whole"), lambda t, n: F.regexp_replace(t, alone(n["old"]), n["new"])))
    word_of = lambda e: F.regexp_extract(e["key"], "^[a-z]+:(.*)$", 1)
    # A word that the text has in lower case too, or that is a common one, is not taken for the person where it stands alone.
    common = lambda w: F.lower(w).isin(COMMON) | (F.lower(w) != w) & F.rlike(F.col(text), alone(F.lower(w)))
    words = F.filter(F.map_entries("_map"), lambda e: e["key"].rlike("^(m|f|n|family):") & ~common(word_of(e)))
    joined = joined.withColumn("_words", F.transform(words, lambda e: F.struct(word_of(e).alias("old"), e["value"].alias("new"))))
    mended = F.aggregate("_words", F.col("_whole"), lambda t, n: F.regexp_replace(t, alone(n["old"]), n["new"]))
    out = joined.select(*[mended.alias(text) if c == text else F.col(c) for c in names], F.size("_found").alias("n_entities"), F.col("_kinds").alias("kinds"))
    return clean.unionByName(out).select(*[F.col(n).alias(c) for c, n in named.items()], "n_entities", "kinds")
