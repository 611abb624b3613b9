"""Surrogates for personal data (DataFrame functions only).

E-mail addresses, phone numbers, IPv4 addresses, card, social-security and account numbers, secrets after
a keyword, and names after a title are found by one pattern. An entity has units: a name's are its words
(given names by gender, the family name), any other entity is one. A unit's canonical form leaves out what
spellings differ in (separators, a country code that is set apart, the case of addresses and names, the title), and
a keyed digest of it draws the surrogate, which is then laid into the format at hand: so +1 (386) 555-3733 and
386-555-3733 get one number, and "Mr Smith", "Dr. Smith" and a later bare "Smith" of the same text one name.

Digits become digits and letters letters of their kind; separators, country codes, top-level domains, the
words before secrets and titles stay, cards keep a valid check digit where they had one, IPv4 stays in range.
Names are drawn from lists of given names by gender and built from parts of family names, in Latin, Cyrillic
or Greek letters (other scripts get Latin ones). Names without a title aren't looked for, as that takes a gazetteer.

Collision check: over the whole table no two units of a kind may share a surrogate in canonical form, and no
surrogate may be a unit that the table holds. All but the first of a clash are drawn again with a higher attempt
number until there is none. From the third attempt on a surrogate is longer by one character (a name by one part) an
attempt, so the room grows and the rounds end, however many units a short format has; IPv4 addresses alone
can't grow and have 254^4 surrogates.

Dates, times of day and ISBNs are no one's data and stay as they are.

Null text stays null; texts without entities are untouched. Repeated rows are rewritten alike. Empty
table: empty result. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import materialize, release, settled

P = "__vp_"
#: Titles with the gender that they show, by language: fixed values.
TITLES = {"m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Don", "г-н", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Mlle", "Doña", "г-жа", "Κυρία"], "n": ["Dr", "Prof"]}
_TITLE = "|".join(sorted((t for v in TITLES.values() for t in v), key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}"
_SECRET = r"(?i:password|passwd|token|secret|api_?key)\s*[=:]"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}+@[\w-]+(?:\.[\w-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "account": r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,5}){1,3}(?![\d-]*\d)|(?<![\d+])\+\d{8,15}(?!\d)",
    "secret": _SECRET + r"\s*\"?[A-Za-z0-9_\-]{8,}+",
    "name": rf"(?<![\p{{L}}.])(?:{_TITLE})\.? {_NAME}",
}
_DAY, _MONTH, _YEAR = r"(?:3[01]|[12]\d|0?[1-9])", r"(?:1[0-2]|0?[1-9])", r"(?:1[5-9]|20)\d{2}"
#: Numbers that are nobody's: dates, alone or with a time, times of day and ISBNs. They are found first and stay.
PLAIN = rf"(?<![\d.-])(?:{_YEAR}([-./]){_MONTH}\1{_DAY}|{_DAY}([-./]){_MONTH}\2{_YEAR}|{_MONTH}([-./]){_DAY}\3{_YEAR})(?![.-]?\d)(?:[T ]+\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?(?!\d))?|(?<![\d:])\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?(?![\d:])|(?i:isbn)(?:-1[03])?:? ?(?:\d[ -]?){{9,12}}[\dXx]|(?<![\d-])(?=(?:\d[ -]?){{13}}(?![\d-]*\d))97[89][ -]\d{{1,5}}[ -]\d{{1,7}}[ -]\d{{1,7}}[ -]\d"
ANY = "|".join(f"(?:{p})" for p in (PLAIN, *PATTERNS.values()))
#: Characters of a text that holds any entity; most texts have none and are passed over.
HINT = rf"[@0-9]|(?:{_TITLE})\.? \p{{Lu}}|{_SECRET}"
#: Letters by kind and case, and digits: fixed values.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789"]
#: Given names by script and gender: fixed values.
GIVEN = {
    ("latin", "m"): ["Adam", "Albert", "Bruno", "Carl", "Daniel", "David", "Erik", "Felix", "Frank", "Gabriel", "Hugo", "Jonas", "Karl", "Leo", "Lucas", "Marcel", "Martin", "Oscar", "Pablo", "Paul", "Robert", "Simon", "Thomas", "Victor"],
    ("latin", "f"): ["Adela", "Alice", "Anna", "Bianca", "Clara", "Diana", "Elena", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Lena", "Lucia", "Maria", "Marta", "Nina", "Olga", "Paula", "Rosa", "Sara", "Vera"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев", "Максим", "Олег", "Павел", "Роман"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "Софья"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Κώστας", "Λάμπρος", "Νίκος", "Πέτρος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: First and last parts of family names by script and, where it shows, gender: fixed values.
FIRST = {"latin": ["Ash", "Berg", "Black", "Brad", "Brook", "Clay", "Craw", "Dal", "Ed", "Fair", "Green", "Hart", "Hol", "Kings", "Lang", "Lind", "Mar", "Nor", "Oak", "Red", "Stan", "Thorn", "Wal", "Wood"], "cyrillic": ["Баран", "Волк", "Голуб", "Журавл", "Зайц", "Козл", "Лебед", "Медвед", "Орл", "Сокол", "Сом", "Чернышк"], "greek": ["Αλεξ", "Βασιλ", "Γεωργ", "Δημητρ", "Νικολ", "Παπαδ"]}
LAST = {("latin", "m"): ["bach", "berg", "born", "by", "dale", "don", "feld", "field", "ford", "ham", "hurst", "land", "ley", "man", "stein", "ton"], ("cyrillic", "m"): ["ов", "ин", "овский"], ("cyrillic", "f"): ["ова", "ина", "овская"], ("greek", "m"): ["όπουλος", "άκης", "ίδης"], ("greek", "f"): ["οπούλου", "άκη", "ίδου"]}
LAST["latin", "f"] = LAST["latin", "m"]


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(entity: Column) -> Column:
    """The type whose pattern the whole entity is; null for dates, times and ISBNs."""
    out = F.lit(None).cast("string")
    for name, p in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return F.when(~_plain(entity), out)


def _plain(entity: Column) -> Column:
    return entity.rlike(f"^(?:{PLAIN})$")


def _head(entity: Column, kind: Column) -> Column:
    """The start of an entity that stays as it is."""
    out = F.when(kind == "phone", F.regexp_extract(entity, r"^\+\d{1,3}(?=[ .(-])", 0)).when(kind == "account", F.substring(entity, F.lit(1), F.lit(2)))
    return out.when(kind == "secret", F.regexp_extract(entity, r"^(?i:[a-z_]+)\s*[=:]\s*\"?", 0)).when(kind == "name", F.regexp_extract(entity, rf"^(?:{_TITLE})\.? ", 0)).otherwise("")


def _after(entity: Column, head: Column) -> Column:
    return F.substring(entity, F.length(head) + 1, F.length(entity))


def _gender(entity: Column) -> Column:
    """m or f: of the title, or of the ending of the first given name."""
    out = F.when(F.regexp_extract(entity, rf"^(?:{_TITLE})", 0).isin(*TITLES["m"]), "m").when(F.regexp_extract(entity, rf"^(?:{_TITLE})", 0).isin(*TITLES["f"]), "f")
    return out.when(F.regexp_extract(entity, rf"^(?:{_TITLE})\.? (\S+) ", 1).rlike("[aаяαη]$"), "f").otherwise("m")


def units(entity: Column, kind: Column) -> Column:
    """The units of an entity, in order, as strings `kind|canonical form`."""
    rest = _after(entity, _head(entity, kind))
    words = F.split(rest, " ")
    named = F.transform(words, lambda w, k: F.concat(F.when(k == F.size(words) - 1, "family").otherwise("given"), F.lit("_"), _gender(entity), F.lit("|"), F.lower(w)))
    plain = F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "ssn", "phone", "account"), F.concat(F.when(kind == "account", F.substring(entity, F.lit(1), F.lit(2))).otherwise(""), F.regexp_replace(rest, "[^0-9A-Za-z]", ""))).otherwise(rest)
    # a family name is one unit whatever its bearer's gender; the gender goes into the ending only
    return F.when(kind == "name", F.transform(named, lambda u: F.regexp_replace(u, r"^family_[mf]\|", "family|"))).otherwise(F.array(F.concat(kind, F.lit("|"), plain)))


def _byte(digest: Column, k) -> Column:
    return F.conv(F.substring(digest, F.lit(1) + F.pmod(k * 2, F.lit(126)), F.lit(2)), 16, 10).cast("int")


def _mapped(s: Column, digest: Column) -> Column:
    """Each character of s mapped within its kind by the digest's hexadecimal pairs; others stay."""

    def one(i):
        c, out = F.substring(s, i, F.lit(1)), F.substring(s, i, F.lit(1))
        for letters in LETTERS:
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), F.pmod(_byte(digest, i), F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return F.when(c.rlike(r"[^\x00-\x7F]") & c.rlike(r"\p{L}"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(_byte(digest, i), F.lit(26)) + 1, F.lit(1))).otherwise(out)

    return F.when(F.length(s) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """Sum of the check rule over a string of digits, the last one counted once."""
    n = F.length(digits)

    def add(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(n - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), add), F.lit(0), lambda a, x: a + x)


def _card(real: Column, made: Column) -> Column:
    """made with the last digit that makes it valid, if real was."""
    start = F.substring(made, F.lit(1), F.length(made) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(start, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(_luhn(real), F.lit(10)) == 0, F.concat(start, check.cast("string"))).otherwise(made)


def _octets(digest: Column) -> Column:
    part = lambda k: (F.lit(1) + F.pmod(F.conv(F.substring(digest, F.lit(k), F.lit(4)), 16, 10).cast("int"), F.lit(254))).cast("string")
    return F.concat_ws(".", *(part(1 + 4 * k) for k in range(4)))


def _pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))


def _script(form: Column) -> Column:
    return F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _number(digest: Column, k) -> Column:
    """32 bits of the digest, the k-th of sixteen."""
    return F.conv(F.substring(digest, F.lit(1) + F.pmod(k, F.lit(16)) * 8, F.lit(7)), 16, 10).cast("long")


def _of_script(form: Column, make) -> Column:
    out = make("latin")
    for script in ("cyrillic", "greek"):
        out = F.when(_script(form) == script, make(script)).otherwise(out)
    return out


def drawn(unit: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit in canonical form; of a family name without the ending that shows gender."""
    kind, form = F.substring_index(unit, "|", 1), F.substring(unit, F.instr(unit, "|") + 1, F.length(unit))
    digest = F.sha2(F.concat_ws("|", F.lit(key), unit, attempt.cast("string")), 512)
    more = F.greatest(attempt - 1, F.lit(0))

    def made(x):
        d = x["digest"]
        longer = F.when(x["more"] > 0, F.substring(F.translate(d, "abcdef", "012345"), F.lit(100), x["more"])).otherwise("")
        parts = F.transform(F.sequence(F.lit(0), x["more"]), lambda k: _of_script(form, lambda s: F.concat(_pick(FIRST[s], _number(d, 2 * k)), F.lit("|"), F.pmod(_number(d, 2 * k + 1), F.lit(len(LAST[s, "m"]))).cast("string"))))
        given = {g: F.transform(F.sequence(F.lit(0), x["more"]), lambda k: _of_script(form, lambda s: _pick(GIVEN[s, g], _number(d, k)))) for g in "mf"}  # noqa: B023
        tld = F.regexp_extract(form, r"\.[\w-]+$", 0)
        out = F.when(kind == "ip", _octets(d)).when(kind == "family", F.array_join(parts, "-"))
        out = out.when(kind == "given_m", F.array_join(given["m"], "-")).when(kind == "given_f", F.array_join(given["f"], "-"))
        out = out.when(kind == "email", F.concat(longer, _mapped(F.substring(form, F.lit(1), F.length(form) - F.length(tld)), d), tld))
        out = out.when(kind == "account", F.concat(F.substring(form, F.lit(1), F.lit(2)), _mapped(F.substring(form, F.lit(3), F.length(form)), d), longer))
        whole = F.concat(_mapped(form, d), longer)
        return out.when(kind == "card", let(whole, lambda m: _card(form, m))).otherwise(whole)

    return let(F.struct(digest.alias("digest"), more.cast("int").alias("more")), made)


def _ended(made: Column, gender: Column) -> Column:
    """A family name from its parts, `first|number of the ending`."""

    def part(p):
        first, k = F.substring_index(p, "|", 1), F.substring_index(p, "|", -1).cast("int")
        out = lambda s: F.when(gender == "f", _pick(LAST[s, "f"], k)).otherwise(_pick(LAST[s, "m"], k))
        return F.concat(first, _of_script(first, out))

    return F.array_join(F.transform(F.split(made, "-"), part), "-")


def _laid(body: Column, made: Column) -> Column:
    """made's characters in the places of body's letters and digits, what is left over after the last."""

    def one(i):
        c = F.substring(body, i, F.lit(1))
        at = F.length(F.regexp_replace(F.substring(body, F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(made, at, F.lit(1))).otherwise(c)

    places = F.length(F.regexp_replace(body, "[^0-9A-Za-z]", ""))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(body)), one), ""), F.substring(made, places + 1, F.length(made)))


def _cased(like: Column, made: Column) -> Column:
    """made in capitals where the word is."""
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(made)).otherwise(made)


def surrogate(entity: Column, kind: Column, attempt_of, key: str) -> Column:
    """What stands for an entity. attempt_of: unit -> its attempt number."""
    head = _head(entity, kind)

    def made(x):
        draw = lambda u: drawn(u, attempt_of(u), key)
        words = F.split(_after(entity, x["head"]), " ")
        named = F.zip_with(x["units"], words, lambda u, w: _cased(w, let(draw(u), lambda m: F.when(u.startswith("family|"), _ended(m, _gender(entity))).otherwise(m))))
        one = draw(F.get(x["units"], F.lit(0)))
        plain = let(one, lambda m: F.when(kind.isin("card", "ssn", "phone"), F.concat(x["head"], _laid(_after(entity, x["head"]), m))).when(kind == "account", F.concat(x["head"], _laid(_after(entity, x["head"]), F.substring(m, F.lit(3), F.length(m))))).when(kind == "email", F.when(entity == F.upper(entity), F.upper(m)).otherwise(m)).otherwise(F.concat(x["head"], m)))
        return F.when(kind == "name", F.concat(x["head"], F.array_join(named, " "))).otherwise(plain)

    return let(F.struct(head.alias("head"), units(entity, kind).alias("units")), made)


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def all_units(docs: DataFrame) -> DataFrame:
    """Distinct units of all texts: unit."""
    found = docs.select(F.explode(_found(F.col("text"))).alias("entity")).distinct().withColumn("kind", kind_of(F.col("entity"))).where("kind IS NOT NULL")
    return found.select(F.explode(units(F.col("entity"), F.col("kind"))).alias("unit")).distinct()


def _shown(unit: str, made: str):
    """The surrogate as a unit of its kind, in canonical form."""
    kind = F.substring_index(unit, "|", 1)
    return F.concat(F.regexp_replace(kind, "^given_[mf]$", "given"), F.lit("|"), F.when(kind == "family", F.lower(F.regexp_replace(_ended(F.col(made), F.lit("m")), r"\|", ""))).when(kind.startswith("given"), F.lower(made)).otherwise(F.col(made)))


def dictionary(docs: DataFrame, key: str) -> DataFrame:
    """unit, attempt, surrogate for all units of the table, after the collision check."""
    base = materialize(all_units(docs), "units")
    real = base.select(F.regexp_replace("unit", r"^given_[mf]\|", "given|").alias("shown")).distinct()
    draw = lambda df: df.withColumn("surrogate", drawn(F.col("unit"), F.col("attempt"), key)).withColumn("shown", _shown("unit", "surrogate"))
    made = materialize(draw(base.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        shared = made.groupBy("shown").agg(F.min("unit").alias("first"), F.max("unit").alias("last")).where("first <> last").select("shown", "first")
        taken = made.select("shown").join(real, "shown", "left_semi").distinct().withColumn("first", F.lit(None).cast("string"))
        clash = materialize(shared.join(taken.select("shown"), "shown", "left_anti").unionByName(taken), "clashes")
        if clash.isEmpty():
            release(clash)
            return made
        again = made.join(clash.withColumn("hit", F.lit(True)), "shown", "left").select("unit", (F.col("attempt") + F.when(F.col("hit") & (F.col("first").isNull() | (F.col("unit") != F.col("first"))), 1).otherwise(0)).alias("attempt"))
        after = materialize(draw(again), "surrogates")
        release(made, clash)
        made = after


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text and the number of entities in `n_entities` (after the columns of docs; a column of
    that name is replaced). key: kept secret, as it leads from a guess to its surrogate; there is no default."""
    names = [c for c in docs.columns if c != "n_entities"]
    # Surrogates of the first attempt are made in place; the few of later attempts are looked up.
    later = settled(lambda: dictionary(docs, key).where("attempt > 0").select("unit", "attempt"), "later")
    df = docs.withColumn(f"{P}found", F.coalesce(_found(F.col("text")), F.array().cast("array<string>")))
    if later.isEmpty():
        df = df.withColumn(f"{P}tries", F.lit(None).cast("map<string,int>"))
    else:
        hit = docs.select("text").where(F.col("text").rlike(HINT)).select(F.sha2("text", 256).alias(f"{P}text"), F.explode(_found(F.col("text"))).alias("entity")).distinct()
        hit = hit.withColumn("kind", kind_of(F.col("entity"))).where("kind IS NOT NULL").select(f"{P}text", F.explode(units(F.col("entity"), F.col("kind"))).alias("unit")).distinct()
        tries = settled(lambda: hit.join(later, "unit").groupBy(f"{P}text").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias(f"{P}tries")), "tries")
        df = df.join(tries, F.when(F.size(f"{P}found") > 0, F.sha2("text", 256)) == F.col(f"{P}text"), "left")
    attempt_of = lambda u: F.coalesce(F.element_at(F.col(f"{P}tries"), u), F.lit(0))
    pieces = F.split("text", ANY, -1)

    def one(x):
        return let(kind_of(x), lambda kind: F.when(kind.isNull(), x).otherwise(surrogate(x, kind, attempt_of, key)))

    # family names that the text gives after a title, where they stand alone
    titled = F.filter(F.col(f"{P}found"), lambda x: x.rlike(f"^(?:{PATTERNS['name']})$"))
    bare = F.array_distinct(F.transform(titled, lambda x: F.struct(F.regexp_extract(x, r"(\S+)$", 1).alias("word"), _gender(x).alias("gender"))))

    def without(piece):
        family = lambda f: _ended(drawn(F.concat(F.lit("family|"), F.lower(f["word"])), attempt_of(F.concat(F.lit("family|"), F.lower(f["word"]))), key), f["gender"])
        return F.when(F.size(bare) == 0, piece).otherwise(F.aggregate(bare, piece, lambda t, f: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'-])"), f["word"], F.lit(r"(?![\p{L}-])")), _cased(f["word"], family(f)))))

    made = F.concat(F.transform(f"{P}found", one), F.array(F.lit("")))
    new = F.when(F.size(f"{P}found") > 0, F.array_join(F.zip_with(F.transform(pieces, without), made, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    return df.select(*(new.alias("text") if c == "text" else F.col(f"`{c}`") for c in names), F.size(F.filter(f"{P}found", lambda x: ~_plain(x))).cast("long").alias("n_entities"))
