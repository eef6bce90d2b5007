"""Personal data: detected entities get keyed surrogates of their own type and form.

Only DataFrame functions are used.  One expression finds all mentions of a text in order; a mention
has a type and a canonical value, so that the spellings of one number or name are one entity.
Surrogates are made of a keyed hash of that value.  A surrogate that two entities would share, or
that is itself a value in the corpus, is made anew with another number until there is none, so that
distinct entities stay distinct.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut

#: The words that stand before a secret, in any case.
KEYS = r"(?i:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)"
#: What the types look like (Java expressions), in order of precedence.  The only group
#: is a secret known by the word before it: six characters or more up to a quote or blank, five of them letters or digits.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})(?:\.[A-Za-z0-9\-]{1,63}){1,8}(?<![.\-])",
    "secret": (
        r"((?<=[\"'=:\s])(?=(?:[^\sA-Za-z0-9\"']*+[A-Za-z0-9]){5})(?<=(?<![A-Za-z0-9])" + KEYS + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"']{6,}+)"
        r"|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"
    ),
    "iban": r"(?=[A-Z]{2}\d\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?=\d{4})(?<![\w.])(?:\d{13,16}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w|\.\d)",
    "ssn": r"(?=\d{3}-)(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": (
        r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\w)"
        r"|(?<![\w.\-+])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
        r"|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)"
    ),
    "name": (
        r"(?=\p{Lu}\p{Ll})(?<=\s)(?<=\b(?:Mr|Mrs|Ms|Miss|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Dr|Prof|Doctor|Professor"
        r"|Господин|Госпожа|[Mm]y name is|[Nn]ame:)\.?\s)\p{Lu}\p{Ll}{1,30}(?:[ \-]\p{Lu}\p{Ll}{1,30}){0,2}"
    ),
}
#: A text without a digit, a key word or one of these has no mention: every pattern needs one of them.
HINTS = (
    "@ AKIA ghp_ gho_ ghu_ ghs_ ghr_ sk- Mr Ms Miss Sir Madam Herr Frau Monsieur Mme Señor Sr Dr Prof Doctor Господин Госпожа ame:"
).split() + ["y name is"]
FEMALE = r"\b(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|Sra|Госпожа)\.?\s$"
#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    "f-latin": "Anna Clara Elena Emma Eva Ines Julia Laura Lena Lucia Maria Nora Olivia Rosa Sofia Vera".split(),
    "m-latin": "Adam Anton Bruno Daniel David Emil Felix Hugo Ivan Jonas Leo Lucas Marco Oscar Paul Victor".split(),
    "f-cyrillic": "Анна Вера Дарья Елена Ирина Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия".split(),
    "m-cyrillic": "Антон Борис Виктор Григорий Дмитрий Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Семён Фёдор".split(),
}
SYLLABLES = {
    "latin": "ba ber da del fo gan ka lan mar nel or pa ros sen tor vin".split(),
    "cyrillic": "ба бер да дел фо ган ка лан мар нел ор па рос сен тор вин".split(),
}
#: A given name of these lists and a name after it are a name without any title.
PATTERNS["name"] += r"|(?=\p{Lu}\p{Ll})(?<!\p{L})(?:" + "|".join(x for names in GIVEN.values() for x in names) + r")(?:[ \-]\p{Lu}\p{Ll}{1,30}){1,2}(?!\p{L})"
HINTS += [x for names in GIVEN.values() for x in names]
#: A mention begins where no letter, digit or underscore stands before, which is looked at first.
WHOLE = "(?<![A-Za-z0-9_])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


#: After so many rounds a type's surrogates are taken to be used up.
ATTEMPTS = 60


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def luhn_sum(number: Column) -> Column:
    """The sum of the digits, every second one from the right doubled and its digits added."""

    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    def total(v: Column) -> Column:
        n = F.length(v)
        places = F.sequence(F.lit(0), n - 1)
        return F.aggregate(places, F.lit(0), lambda s, i: s + let(F.substring(v, n - i, F.lit(1)).cast("int"), lambda d: worth(d, i)))

    return let(number, total)


def luhn(number: Column) -> Column:
    """Whether the last of the digits is the check digit of the others."""
    return luhn_sum(number) % 10 == 0


def type_of(value: Column) -> Column:
    """The type of a mention, by the first pattern that fits it whole; null where none does.

    What stands before a mention of a secret or a name is not part of it, so these are what is left.
    """
    out = F.when(value.rlike("^" + PATTERNS["email"] + "$"), F.lit("email"))
    out = out.when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), F.lit("iban"))
    out = out.when(value.rlike("^" + PATTERNS["ip"] + "$"), F.lit("ip"))
    card = value.rlike("^" + PATTERNS["card"] + "$")
    out = out.when(card & luhn(digits(value)), F.lit("card")).when(card & (F.length(digits(value)) != 15) & value.rlike("^[0-9]+$"), F.lit(None))
    for kind in ("ssn", "phone"):
        out = out.when(value.rlike("^(?:" + PATTERNS[kind] + ")$"), F.lit(kind))
    return out.when(value.rlike(r"^\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}\p{Ll}+)*$"), F.lit("name")).when(F.length(value) >= 12, F.lit("secret"))


def canonical(kind: Column, value: Column) -> Column:
    """The value behind the spellings of one entity."""
    number = digits(value)
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "phone", F.when(number.rlike("^1[0-9]{10}$"), F.substring(number, 2, 10)).otherwise(number))
        .when(kind.isin("card", "ssn"), number)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind.rlike("^(given|family)-"), F.lower(value))
        .otherwise(value)
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that depend on the key, the entity and the attempt."""
    base = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(base, F.lit(f"\x1f{i}")), 256) for i in range(4)))


def _pick(stream: Column, at: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % len(values) + 1)


def _family(stream: Column, script: str, at: int, attempt: Column) -> Column:
    """A family name of three syllables, and of one more for each further attempt up to eight."""
    more = [F.when(attempt > i, _pick(stream, at + 12 + 4 * i, SYLLABLES[script])).otherwise(F.lit("")) for i in range(5)]
    return F.initcap(F.concat(*(_pick(stream, at + 4 * i, SYLLABLES[script]) for i in range(3)), *more))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of an entity."""
    return let(_stream(key, kind, value, attempt), lambda stream: _from_stream(stream, kind, value, attempt))


def _from_stream(stream: Column, kind: Column, value: Column, attempt: Column) -> Column:
    byte = lambda at: F.conv(F.substring(stream, at, 4), 16, 10).cast("int")
    number = F.translate(stream, "abcdef", "234567")
    host = F.concat(*(_pick(stream, 40 + 4 * i, SYLLABLES["latin"]) for i in range(4)))
    email = F.concat(F.lower(_pick(stream, 1, GIVEN["f-latin"] + GIVEN["m-latin"])), F.lit("."), F.lower(_family(stream, "latin", 109, attempt)),
                     (byte(30) % 100).cast("string"), F.lit("@"), host, F.lit(".example"))
    address = F.concat_ws(".", (byte(1) % 223 + 1).cast("string"), *((byte(1 + 4 * i) % 256).cast("string") for i in (1, 2, 3)))
    phone = let(number, lambda x: F.concat(
        F.translate(F.substring(x, 1, 1), "01", "23"), F.substring(x, 2, 2),
        F.when(attempt < 3, F.lit("555")).otherwise(F.substring(x, 10, 3)), F.substring(x, 6, 4),
    ))
    body = F.concat(F.substring(value, 1, 1), F.substring(number, F.lit(1), F.length(value) - 2))
    card = let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
    out = F.when(kind == "email", email).when(kind == "ip", address)
    # the country code before ten digits stays
    code = F.greatest(F.length(value) - 10, F.lit(0))
    longer = F.concat(F.substring(value, F.lit(1), code), F.substring(number, F.lit(1), F.length(value) - code))
    out = out.when(kind == "phone", F.when(F.length(value) == 10, phone).otherwise(longer))
    # no number issued begins with 9, as long as there are enough of these
    out = out.when(kind == "card", card).when(kind == "ssn", F.when(attempt < 8, F.concat(F.lit("9"), F.substring(number, 2, 8))).otherwise(F.substring(number, 1, 9)))
    for script in SYLLABLES:
        out = out.when(kind == f"family-{script}", _family(stream, script, 109, attempt))
    for name, given in GIVEN.items():
        more = F.when(attempt > 0, F.lower(_family(stream, name.split("-")[1], 109, attempt))).otherwise(F.lit(""))
        out = out.when(kind == f"given-{name}", F.concat(_pick(stream, 1, given), more))
    out = out.when(kind == "iban", let(_reshaped(value, stream, F.lit(2)), checked_iban))
    # the prefix that tells what a secret is stays
    prefix = F.when(value.rlike("^(?:AKIA|gh[pousr]_)"), 4).when(value.startswith("sk-"), 3).otherwise(0)
    return out.otherwise(let(prefix, lambda keep: _reshaped(value, stream, keep)))


def checked_iban(value: Column) -> Column:
    """The account number with the check digits (the third and fourth character) that make it 1 modulo 97."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 2), F.lit("00"))
    worth = lambda c: F.conv(c, 36, 10).cast("int")
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(worth(c) > 9, 100).otherwise(10) + worth(c)) % 97)
    return F.concat(F.substring(value, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(value, F.lit(5), F.length(value)))


def _reshaped(value: Column, stream: Column, keep: Column) -> Column:
    """The value with every letter and digit after the first ``keep`` replaced by another of its class."""

    def one(i: Column, letters: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        at = F.conv(F.substring(stream, (i * 2) % 254 + 1, F.lit(2)), 16, 10).cast("int")
        return (
            F.when(i <= keep, c)
            .when(c.rlike("[0-9]"), (at % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(at % letters + 97))
            .when(c.rlike("[A-Z]"), F.char(at % 26 + 65))
            .when(c.rlike(r"\p{L}"), F.char(at % 26 + 97))
            .otherwise(c)
        )

    places = F.sequence(F.lit(1), F.length(value))
    letters = F.when(value.rlike("^[0-9a-f]+$"), F.lit(6)).otherwise(F.lit(26))
    return let(letters, lambda n: F.array_join(F.transform(places, lambda i: one(i, n)), ""))


def written(kind: Column, value: Column, made: Column) -> Column:
    """A canonical surrogate in the form of the mention: its separators, its prefix, its case."""
    n = F.length(digits(value))
    extra = F.greatest(n - F.length(made), F.lit(0))  # the digits of a country code stay

    def one(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        seen = F.length(digits(F.substring(value, F.lit(1), i)))
        return F.when(c.rlike("[0-9]") & (seen > extra), F.substring(made, seen - extra, F.lit(1))).otherwise(c)

    numbered = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")
    grouped = F.when(value.contains(" "), F.rtrim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    cased = F.when(value == F.upper(value), F.upper(made)).otherwise(made)
    return F.when(kind.isin("phone", "card", "ssn"), numbered).when(kind == "iban", grouped).when(kind == "email", cased).otherwise(made)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, value, made`` with a surrogate of its own for each entity, none of them an entity's value."""
    held = entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    real = cut(held.select("kind", F.col("value").alias("plain")))
    plain = F.when(F.col("kind").rlike("^(given|family)-"), F.lower("made")).otherwise(F.col("made"))
    for _ in range(ATTEMPTS):
        made = cut(held.withColumn("made", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))).withColumn("plain", plain))
        again = made.selectExpr("kind", "value", "row_number() OVER (PARTITION BY kind, plain ORDER BY attempt DESC, value) AS n")
        clash = again.where("n > 1").select("kind", "value").union(made.join(real, ["kind", "plain"], "left_semi").select("kind", "value"))
        clash = cut(clash.distinct().withColumn("clash", F.lit(1)))
        if clash.isEmpty():
            return made.select("kind", "value", "made")
        held = made.join(clash, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("clash", F.lit(0))).alias("attempt"))
    raise ValueError("there are more entities of a type than surrogates of its form")


def name_parts(said: Column, female: Column) -> Column:
    """The words of a name as entities of their own, so that a full name and a later mention of a part of it agree.

    The last word is a family name, and so is a single one unless it is a given name of the lists; the gender of
    a given name is that of the lists, else of the title.
    """
    lists = {kind: [x.lower() for x in names] for kind, names in GIVEN.items()}
    script = F.when(said.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    words = F.split(said, "[ -]")

    def part(word: Column, i: Column) -> Column:
        low = F.lower(word)
        listed = reduce(lambda x, kind: x.when(low.isin(lists[kind]), F.lit(f"given-{kind}")), lists, F.when(F.lit(False), F.lit("")))
        given = F.coalesce(listed, F.concat(F.lit("given-"), F.when(female, F.lit("f-")).otherwise(F.lit("m-")), script))
        family = F.concat(F.lit("family-"), script)
        n = F.size(words)
        kind = F.when(i < n - 1, given).when(n == 1, F.coalesce(listed, family)).otherwise(family)
        return F.struct(kind.alias("kind"), low.alias("value"))

    return F.transform(words, part)


def replace_entities(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with surrogates in the text and ``n_entities``, the number of mentions replaced.

    The result column replaces an input column of its name.  The same key gives the same surrogates
    for the same corpus.  A null text stays null and an empty one empty, with no entities; texts
    without a mention pass by every shuffle; rows with equal ids and texts are replaced alike; an
    empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")
    )
    hinted = reduce(lambda x, hint: x | F.contains("text", F.lit(hint)), [*HINTS, "Sr "], F.col("text").rlike("[0-9]|" + KEYS))
    hinted = F.coalesce(hinted, F.lit(False))
    mentions = F.when(hinted, F.regexp_extract_all("text", F.lit(WHOLE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("mentions", mentions)
    some = rows.where(F.size("mentions") > 0).withColumn("digest", F.sha2("text", 256))
    # a secret after a key word is one whatever it looks like, so the match is carried
    keyed = F.when(F.col("text").rlike(KEYS), F.regexp_extract_all("text", F.lit(WHOLE), F.lit(1))).otherwise(F.transform("mentions", lambda m: F.lit("")))
    titles = F.transform(F.split("text", WHOLE, -1), lambda x: x.rlike(FEMALE))
    listed = (
        some.select("id", "digest", "mentions", titles.alias("titles"), keyed.alias("keyed"))
        .dropDuplicates(["id", "digest"])
        .select("id", "digest", F.posexplode(F.arrays_zip("mentions", "titles", "keyed")).alias("at", "m"))
        .where("m.mentions IS NOT NULL")
        .select("id", "digest", "at", F.col("m.mentions").alias("said"), F.when(F.col("m.keyed") != "", F.lit("secret")).otherwise(type_of(F.col("m.mentions"))).alias("kind"), "m.titles")
    )
    parts = F.when(F.col("kind") == "name", name_parts(F.col("said"), F.col("titles")))
    parts = parts.otherwise(F.array(F.struct("kind", canonical(F.col("kind"), F.col("said")).alias("value"))))
    listed = cut(listed.select("id", "digest", "at", "said", "kind", F.posexplode(parts).alias("nth", "p")).select("id", "digest", "at", "said", F.col("kind").alias("type"), "nth", "p.kind", "p.value"))
    made = distinct_surrogates(listed.where("kind IS NOT NULL"), key)
    put = F.when(F.col("type") == "name", F.col("made")).otherwise(written(F.col("type"), F.col("said"), F.col("made")))
    new = (
        listed.join(made, ["kind", "value"], "left")
        .groupBy("id", "digest", "at", "said")
        .agg(F.sort_array(F.collect_list(F.struct("nth", put.alias("put")))).alias("puts"), F.bool_or(F.col("made").isNotNull()).alias("hit"))
    )
    # the words of a name keep what stood between them
    joints = F.concat(F.slice(F.split("said", r"[^ \-]+", -1), 2, 1000), F.array(F.lit("")))
    spelled = F.array_join(F.zip_with("puts", F.slice(joints, F.lit(1), F.size("puts")), lambda x, y: F.concat(x["put"], F.when(F.size("puts") > 1, y).otherwise(F.lit("")))), "")
    new = new.select("id", "digest", "at", F.when(F.col("hit"), spelled).otherwise(F.col("said")).alias("new"), "hit")
    texts = new.groupBy("id", "digest").agg(
        F.array_sort(F.collect_list(F.struct("at", "new"))).alias("news"), F.count_if("hit").cast("int").alias("n_entities")
    )
    woven = F.zip_with(F.split("text", WHOLE, -1), F.concat(F.col("news.new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    done = some.join(texts, some["id"].eqNullSafe(texts["id"]) & (some["digest"] == texts["digest"]))
    done = done.select("row", F.array_join(woven, "").alias("text"), "n_entities")
    none = rows.where(F.size("mentions") == 0).select("row", "text", F.lit(0).alias("n_entities"))
    return none.unionByName(done).select(
        *(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns), "n_entities"
    )
