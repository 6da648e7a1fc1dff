"""Personal data replaced by keyed, type-consistent surrogates, in DataFrame operations only.

One pattern finds e-mail addresses, phone, card, social-security and account numbers, IP
addresses of both versions, secrets and names (after a title, or a known given name before up to three names;
then also the bare surname anywhere in the same document). Every
different value of the corpus becomes an entity (type, canonical form); an entity has one
surrogate everywhere, whatever its spelling, so mentions that belong together stay together:
numbers in any punctuation, addresses in any case, a surname with or without a given name.

A surrogate is drawn from SHA-256 of key, type, attempt and canonical form: digits become
digits and letters letters of the same case, numbers keep country code, length and check
digits, names keep script and gender. Draws that equal another entity's surrogate or any
original are rejected and drawn again, until all are distinct; phone and social security
numbers, secrets and addresses grow longer after many rejected draws, as names do, so a class
with few values does not run out. Surrogates are written back
in the spelling (punctuation, case) of each mention.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import written

# Given names whose gender is known. Fixed values.
FEMALE = ["Anna", "Maria", "Mary", "Emma", "Laura", "Sofia", "Julia", "Clara", "Elena", "Alice", "Marie", "Lucia", "Carmen", "Ingrid", "Jane", "Sarah", "Анна", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη"]
MALE = ["John", "James", "Peter", "Paul", "Thomas", "Martin", "Carlos", "Hans", "Pierre", "Luis", "David", "Karl", "Robert", "Michael", "Иван", "Пётр", "Сергей", "Γιώργος", "Νίκος"]
# Titles and the gender they tell. Fixed values.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"]
OPEN_TITLES = ["Dr", "Prof"]

# Every pattern begins where no letter, digit or underscore stands before; GUARD says so once for
# all of them, and the first character then leaves only the patterns that can begin with it, so
# most positions of a text are passed with one look back.
GUARD = r"(?<![\p{L}\p{N}_])"
EMAIL = r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}(?![\p{L}\p{N}-])"
IP = r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"
IP6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,20}[0-9])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])"
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = (
    r"(?<!\+)\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
    r"|(?<![.,/-])0(?=(?:[ /-]?\d){8,12}(?!\d))\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,6}){0,3}(?![\w/-])"
)
# Numbers of 13 to 15 digits are cards only with the first digits that cards of that length have.
CARD = r"(?<!\.)(?:(?=[3-6])\d(?:[ -]?\d){12,18}|\d(?:[ -]?\d){15,18})(?!\w)"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
ASSIGNED = (
    r"(?:(?:[A-Za-z0-9]{1,30}+_){0,4}(?i:password|passwd|pwd|secret|token|api_?key|access_?key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?"
    r"|(?i:bearer)[ ](?=[A-Za-z0-9._~+/=-]{16})(?=[A-Za-z._~+/=-]{0,99}[0-9]))"
)
SECRET = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]++)?|AKIA[0-9A-Z]{16}(?!\w)|(?:sk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}+"
# Values of symbols only hide nothing.
ASSIGNED_VALUE = r"(?=[_/+.!@#$%^&*?~=:|-]*+[\p{L}\p{N}])[\p{L}\p{N}_/+.!@#$%^&*?~=:|-]{8,}+"
# Words after a title or given name that make it a post, a brand or a place. Fixed values.
POSTS = ["Developer", "Engineer", "Manager", "Director", "Analyst", "Architect", "Consultant", "Officer", "Pepper", "Martens", "Quixote"]
PLACES = ["Street", "Road", "Avenue", "Square", "Airport", "University", "Hospital", "Strasse", "Straße", "Platz", "Allee", "Weg"]
NAME_WORD = r"\p{Lu}[\p{L}'’-]++"
NO_PLACE = rf"(?![ ](?:{'|'.join(PLACES)})(?!\p{{L}}))"
TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OPEN_TITLES)
TITLED = rf"(?:{TITLES})(?!\p{{L}})\.?[ ](?!(?:{'|'.join(POSTS)})(?!\p{{L}})){NAME_WORD}(?:[ ]{NAME_WORD}){{0,2}}+{NO_PLACE}"
GIVEN = rf"(?:{'|'.join(n for name in FEMALE + MALE for n in (name, name.upper()))})[ ]{NAME_WORD}(?:[ ](?!(?:{'|'.join(PLACES)})(?!\p{{L}})){NAME_WORD}){{0,2}}+{NO_PLACE}"
BARE = rf"{GUARD}\p{{Lu}}\p{{L}}++(?:['’-]\p{{L}}++)*+"
PATTERN = (
    rf"{GUARD}(?:{EMAIL}|(?=[0-9+(])(?:{IP}|{SSN}|{PHONE}|{CARD})|(?=[0-9A-Fa-f]{{1,4}}:)(?:{IP6})|(?=[A-Z][A-Z][0-9])(?:{IBAN})"
    rf"|(?=[A-Za-z0-9])(?:{ASSIGNED}{ASSIGNED_VALUE}|{SECRET})|(?=\p{{Lu}})(?:{TITLED}|{GIVEN}))"
)

CONSONANTS = "bdfgklmnprstvz"
VOWELS = "aeiou"
LATIN = [c + v for c in CONSONANTS for v in VOWELS]
CYRILLIC = [c + v for c in "бвгдзклмнпрстф" for v in "аеиоу"]
GREEK = [c + v for c in "βγδζκλμνπρστφχ" for v in "αειου"]
ENDINGS = {"latin": ("la", "ren", "lis"), "cyrillic": ("ла", "рен", "лис"), "greek": ("λα", "ρεν", "λις")}
ROUNDS = 64
SHAPED = 200  # characters; longer secrets get hexadecimal digits


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def entities(match: Column) -> Column:
    """Array of (type, canon) that a match mentions, in order."""
    digits = F.regexp_replace(match, "[^0-9+]", "")

    def one(kind: str, canon: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("type"), canon.alias("canon")))

    title = F.regexp_extract(match, rf"^({TITLES})\.?[ ]\p{{Lu}}", 1)
    names = F.split(F.when(title != "", F.regexp_replace(match, rf"^(?:{TITLES})\.?[ ]", "")).otherwise(match), " ")
    first = F.initcap(F.element_at(names, 1))
    gender = (
        F.when(title.isin(FEMALE_TITLES) | ((title == "") | title.isin(OPEN_TITLES)) & first.isin(FEMALE), "given_f")
        .when(title.isin(MALE_TITLES) | ((title == "") | title.isin(OPEN_TITLES)) & first.isin(MALE), "given_m")
        .otherwise("given_x")
    )
    people = F.transform(
        names,
        # A known given name alone after a title stays a given name, as where the whole name stands.
        lambda x, i: F.struct(F.when((i == F.size(names) - 1) & ~((i == 0) & first.isin(FEMALE + MALE)), "family").otherwise(gender).alias("type"), F.lower(x).alias("canon")),
    )
    return (
        F.when(match.contains("@") & _whole(match, EMAIL), one("email", F.lower(match)))
        .when(_whole(match, IP), one("ip", match))
        .when(match.contains(":") & _whole(match, IP6), one("ip6", F.lower(match)))
        .when(_whole(match, SSN), one("ssn", digits))
        .when(_whole(match, PHONE), one("phone", digits))
        .when(match.rlike(f"^{ASSIGNED}"), one("secret", F.regexp_replace(match, f"^{ASSIGNED}", "")))
        .when(_whole(match, SECRET), one("secret", match))
        .when(_whole(match, IBAN), one("iban", F.regexp_replace(match, " ", "")))
        .when(_whole(match, CARD), one("card", digits))
        .otherwise(people)
    )


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substring(stream, (at * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(seed: Column, length: Column) -> Column:
    """At least `length` keyed bytes, in hexadecimal."""
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((length - 1) / 32), F.lit(0)).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", seed, b.cast("string")), 256)), "")


def _pick(letters: str, byte: Column) -> Column:
    return F.substring(F.lit(letters), (byte % len(letters) + 1).cast("int"), F.lit(1))


def _same_shape(value: Column, seed: Column) -> Column:
    """Digits for digits, letters for letters of the same case, the rest of ASCII as it is."""
    stream = _stream(seed, F.length(value))

    def change(i: Column) -> Column:
        c, b = F.substring(value, i, F.lit(1)), _byte(stream, i)
        return (
            F.when(c.between("0", "9"), _pick("0123456789", b)).when(c.between("a", "z"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.between("A", "Z"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .when(F.ascii(c) > 127, _pick("abcdefghijklmnopqrstuvwxyz", b)).otherwise(c)
        )

    return F.when(F.length(value) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), change), "")).otherwise("")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit in its own place."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The number spelled by digits and letters (A = 10) modulo 97."""
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def _name(kind: Column, canon: Column, seed: Column, attempt: Column) -> Column:
    """A made-up name of the same script and gender; longer after many rejected draws."""
    script = F.when(canon.rlike("^[\\u0400-\\u04FF]"), "cyrillic").when(canon.rlike("^[\\u0370-\\u03FF]"), "greek").otherwise("latin")
    length = F.when(kind == "family", 3).otherwise(2) + F.floor(attempt / 4).cast("int")
    stream = _stream(seed, length)

    def spoken(syllables: list[str]) -> Column:
        letters, k = F.lit("".join(syllables)), len(syllables)
        return F.array_join(F.transform(
            F.sequence(F.lit(1), length), lambda i: F.substring(letters, ((_byte(stream, i) % k) * 2 + 1).cast("int"), F.lit(2))), "")

    out = F.lit(None).cast("string")
    for label, syllables in (("latin", LATIN), ("cyrillic", CYRILLIC), ("greek", GREEK)):
        body, (female, male, open_ending) = spoken(syllables), ENDINGS[label]
        ending = F.when(kind == "given_f", female).when(kind == "given_m", male).when(kind == "given_x", open_ending).otherwise("")
        out = F.when(script == label, F.concat(body, ending)).otherwise(out)
    return out


def with_surrogate(df: DataFrame, attempt: int, key: str) -> DataFrame:
    """Add `surrogate`, the draw number `attempt` for each entity (type, canon), in canonical form.

    Parts that several expressions need are columns of their own, so that they are computed once.
    """
    kind, canon, n = F.col("type"), F.col("canon"), F.length("canon")
    drawn, seed, body, account = F.col("__drawn"), F.col("__seed"), F.col("__body"), F.col("__account")

    def tail(column: Column, start) -> Column:
        return F.substring(column, F.lit(start) if isinstance(start, int) else start, F.lit(1_000_000))

    domain, ending = F.substring_index(canon, "@", -1), F.substring_index(canon, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    # One more character for every eight rejected draws.
    more = F.translate(F.substring(_stream(F.concat_ws("|", seed, F.lit("more")), F.lit(1)), 1, attempt // 8), "abcdef", "012345")
    # The domain depends on the domain alone, so colleagues stay colleagues.
    email = F.concat(F.substring_index(drawn, "@", 1), more, F.lit("@"), _same_shape(host, F.concat_ws("|", F.lit(key), F.lit("domain"), host)), F.lit("."), ending)
    code = F.when(~canon.startswith("+"), 0).when(F.substring(canon, 2, 1).isin("1", "7"), 2).otherwise(3)
    number = tail(drawn, code + 1)
    # Numbers within a country keep their leading 0.
    home = F.concat(F.lit("0"), F.translate(F.substring(drawn, 2, 1), "0", "5"), tail(drawn, 3), more)
    phone = F.when(canon.startswith("0"), home).otherwise(F.concat(F.substring(canon, F.lit(1), code), F.when(number.startswith("0"), F.concat(F.lit("5"), tail(number, 2))).otherwise(number), more))
    check = ((F.lit(10) - _luhn_sum(body) % 10) % 10).cast("string")
    card = F.concat(F.substring(body, F.lit(1), n - 1), F.when(_luhn_sum(canon) % 10 == 0, check).otherwise(F.substring(drawn, n, F.lit(1))))
    octets = _stream(seed, F.lit(4))
    ip = F.concat_ws(".", (_byte(octets, F.lit(1)) % 223 + 1).cast("string"), *[(_byte(octets, F.lit(i)) % 254 + 1).cast("string") for i in (2, 3, 4)])
    # The documentation prefix, then groups of keyed digits.
    ip6 = F.concat(F.lit("2001:db8"), F.regexp_replace(F.substring(_stream(seed, F.lit(12)), 1, 24), "(.{4})", ":$1"))
    iban = F.concat(F.substring(canon, 1, 2), F.lpad((F.lit(98) - _mod97(account)).cast("string"), 2, "0"), tail(drawn, 5))
    kept = F.regexp_extract(canon, "^(eyJ|AKIA|(?:sk|ghp|gho|xox[abp])[-_])", 1)
    secret = F.concat(kept, tail(drawn, F.length(kept) + 1), more)
    return (
        df.withColumn("__seed", F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)), canon))
        .withColumn("__drawn", F.when(n > SHAPED, F.substring(_stream(seed, F.ceil(n / 2)), F.lit(1), n)).otherwise(_same_shape(canon, seed)))
        .withColumn("__body", F.concat(F.substring(canon, 1, 1), F.substring(drawn, F.lit(2), n - 2), F.lit("0")))
        .withColumn("__account", F.concat(tail(drawn, 5), F.substring(canon, 1, 2), F.lit("00")))
        .withColumn(
            "surrogate",
            F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ip6", ip6)
            .when(kind == "ssn", F.concat(F.lit("9"), tail(drawn, 2), more)).when(kind == "iban", iban).when(kind == "secret", secret)
            .otherwise(_name(kind, canon, seed, F.lit(attempt))),
        )
        .drop("__seed", "__drawn", "__body", "__account")
    )


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate) for the distinct (type, canon) of `found`; surrogates distinct.

    Each round draws for all entities still open; of equal draws the smallest canonical form
    keeps it, and draws that an earlier round gave away or that are themselves an original
    are not taken. Open entities get longer draws, so no format is too small.
    """
    originals = written(found.select("type", "canon").distinct(), "entities")
    taken: list[DataFrame] = []
    pending = originals
    for attempt in range(ROUNDS):
        draws = with_surrogate(pending, attempt, key)
        firsts = draws.groupBy("type", "surrogate").agg(F.min("canon").alias("canon"))
        free = firsts.join(originals.select("type", F.col("canon").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if taken:
            given = reduce(DataFrame.unionAll, taken)
            free = free.join(given.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        won = written(free.select("type", "canon", "surrogate"), "surrogates")
        taken.append(won)
        pending = written(pending.join(won, ["type", "canon"], "left_anti"), "open")
        if pending.isEmpty():
            return reduce(DataFrame.unionAll, taken)
    raise ValueError(f"no distinct surrogates after {ROUNDS} draws")


def _spelled(match: Column, parts: Column) -> Column:
    """A match with its entities' surrogates, in the punctuation and case of the match."""
    kind, first = F.element_at(parts, 1)["type"], F.element_at(parts, 1)["surrogate"]
    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"))

    def fill(state: Column, i: Column) -> Column:
        c = F.substring(match, i, F.lit(1))
        used = c.rlike("[0-9A-Za-z+]")
        return F.struct(
            F.concat(state["o"], F.when(used, F.substring(first, state["k"] + 1, F.lit(1))).otherwise(c)).alias("o"),
            (state["k"] + used.cast("int")).alias("k"),
        )

    filled = F.aggregate(F.sequence(F.lit(1), F.length(match)), start, fill, lambda s: F.concat(s["o"], F.substring(first, s["k"] + 1, F.lit(1_000_000))))
    cased = F.when((match == F.upper(match)) & (match != F.lower(match)), F.upper(first)).otherwise(first)
    title = F.regexp_extract(match, rf"^((?:{TITLES})\.?[ ])\p{{Lu}}", 1)
    words = F.split(F.substring(match, F.length(title) + 1, F.lit(1_000_000)), " ")
    people = F.concat(title, F.array_join(F.zip_with(words, parts, lambda w, p: F.when(
        (w == F.upper(w)) & (F.length(w) > 1), F.upper(p["surrogate"])).otherwise(F.initcap(p["surrogate"]))), " "))
    return (
        F.when(kind == "email", cased).when(kind.isin("ip", "ip6"), first)
        .when(kind == "secret", F.concat(F.regexp_extract(match, f"^({ASSIGNED})", 1), first))
        .when(kind.isin("phone", "card", "ssn", "iban"), filled)
        .otherwise(people)
    )


def _bare(piece: Column, families: Column) -> tuple[Column, Column]:
    """A piece between matches with bare surnames of its document replaced, and how many there are."""
    words = F.regexp_extract_all(piece, F.lit(BARE), F.lit(0))

    def surrogate(w: Column) -> Column:
        base = F.regexp_replace(w, "['’][sS]$", "")
        new = F.try_element_at(families, F.lower(base))
        return F.concat(F.when((base == F.upper(base)) & (F.length(base) > 1), F.upper(new)).otherwise(F.initcap(new)), F.substring(w, F.length(base) + 1, F.lit(2)))

    new = F.concat(F.transform(words, lambda w: F.coalesce(surrogate(w), w)), F.array(F.lit("")))
    text = F.array_join(F.flatten(F.zip_with(F.split(piece, BARE, -1), new, lambda p, n: F.array(p, n))), "")
    return text, F.size(F.filter(words, lambda w: surrogate(w).isNotNull()))


def replace_entities(docs: DataFrame, text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """`docs` with personal data in `text_col` replaced; all other columns stay.

    Adds __entities, the number of mentions replaced. Null and empty texts stay as they are.
    What is replaced depends on the text alone, so repeated rows get equal texts, and rows
    are told apart by a digest of the text, not by their id.
    """
    text = F.col(text_col)
    dirty = docs.where(text.rlike(PATTERN)).withColumn("__digest", F.sha2(text.cast("binary"), 256))
    mentions = dirty.groupBy("__digest").agg(F.first(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("m"))
    listed = mentions.select("__digest", F.posexplode("m").alias("at", "match"))
    found = written(listed.select("__digest", "at", "match", F.posexplode(entities(F.col("match"))).alias("part", "e"))
                    .select("__digest", "at", "match", "part", "e.type", "e.canon"), "mentions")
    named = found.join(dictionary(found, key), ["type", "canon"])
    spelled = named.groupBy("__digest", "at", "match").agg(F.array_sort(F.collect_list(F.struct("part", "type", "surrogate"))).alias("parts"))
    spelled = spelled.select("__digest", "at", _spelled(F.col("match"), F.col("parts")).alias("new"))
    by_text = spelled.groupBy("__digest").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("__new"))
    families = named.where("type = 'family'").groupBy("__digest").agg(F.map_from_entries(F.collect_set(F.struct("canon", "surrogate"))).alias("__families"))
    by_text = by_text.join(families, "__digest", "left")
    known = F.col("__families")
    split = F.split(text, PATTERN, -1)
    pieces = F.when(known.isNull(), split).otherwise(F.transform(split, lambda p: _bare(p, known)[0]))
    bare = F.when(known.isNull(), 0).otherwise(F.aggregate(split, F.lit(0), lambda n, p: n + _bare(p, known)[1]))
    new = F.concat(F.transform("__new", lambda x: x["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, new, lambda p, n: F.array(p, n))), "")
    changed = dirty.join(by_text, "__digest").withColumn("__entities", (F.size("__new") + bare).cast("long")).withColumn(text_col, rebuilt)
    clean = docs.where(text.isNull() | ~text.rlike(PATTERN)).withColumn("__entities", F.lit(0).cast("long"))
    return changed.select(*docs.columns, "__entities").unionAll(clean.select(*docs.columns, "__entities"))
