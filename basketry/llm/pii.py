"""Surrogates for personal data, by DataFrame functions alone.

Every detected entity is replaced by one of the same type and format that a key and the entity
determine, so mentions of one entity agree over the whole corpus and nothing needs to be looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import spare, stage

# Titles by gender, and syllables of invented names by script.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа"),
    "n": ("Dr", "Prof"),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то ва ве во за зо".split(),
}
ENDINGS = {
    ("latin", "m"): ("n", "rd", "s"),
    ("latin", "f"): ("na", "lia", "ra"),
    ("latin", "n"): ("l", "r", "m"),
    ("cyrillic", "m"): ("н", "рт", "с"),
    ("cyrillic", "f"): ("на", "лия", "ра"),
    ("cyrillic", "n"): ("л", "р", "м"),
}

_TITLE = "(?:" + "|".join(t for titles in TITLES.values() for t in titles) + ")\\.?"
_SECRET = "(?i:password|passwd|secret|token|api_?key)\\s{0,2}[=:]\\s{0,2}[\"']?"
_COUNTRY = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# A domain of any number of labels. A label with its dot is taken for good where two letters or another label
# and dot follow, so nothing is tried again and long ones need no stack; where the end then doesn't fit, the
# first two labels may.
_DOMAIN = "(?=[A-Za-z0-9])(?:[A-Za-z0-9-]*+\\.(?=[A-Za-z]{2}|[A-Za-z0-9-]*+\\.))++[A-Za-z]{2,24}+"
_SHORT_DOMAIN = "[A-Za-z0-9][A-Za-z0-9-]*+\\.[A-Za-z]{2,24}+"

#: Kinds of entities with the Java patterns that find them, in the order in which they are tried. A
#: secret is found with the word before it and a name with its title; both words stay.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", f"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:{_DOMAIN}|{_SHORT_DOMAIN})(?![A-Za-z0-9])"),
    ("secret", _SECRET + "[A-Za-z0-9+/_-]{6,}"),
    ("key", "(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", f"(?<![0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![0-9]|\\.[0-9])"),
    ("ssn", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", "(?<![0-9.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"),
    (
        "phone",
        "(?<![0-9+])(?:\\+[0-9]{1,3}[ .-]?)?(?:\\([0-9]{2,4}\\)|[0-9]{3})[ .-][0-9]{3}[ .-]?[0-9]{4}(?![0-9-])"
        "|(?<![0-9+])\\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9-])",
    ),
    ("name", f"(?<!\\p{{L}}){_TITLE}\\s\\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)?"),
)
#: Attempts after which a surrogate may leave the original's length or network, since the free ones may be too few.
WIDENED = 4

PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
_CHARACTERS = 64


def _hinted(text: Column) -> Column:
    """Whether a text holds what every entity holds: a digit, an address sign, a title or a mark of a secret."""
    hint = text.rlike("[0-9@=:]")
    for titles in TITLES.values():
        for title in titles:
            hint = hint | text.contains(title)
    return hint


def _kind(e: Column) -> Column:
    """The kind of an entity, by its own form; the first pattern that fits found it."""
    form = F.when(e.rlike("^[A-Za-z0-9._%+-]+@"), "email").when(e.rlike(f"^{_SECRET}"), "secret")
    form = form.when(e.rlike(f"^{_TITLE}\\s\\p{{Lu}}"), "name")
    for kind, pattern in PATTERNS:
        if kind not in ("email", "secret", "name"):
            form = form.when(e.rlike(f"^(?:{pattern})$"), kind)
    return form.otherwise("secret")


def _value(kind: Column, e: Column) -> Column:
    """The part of an entity that is replaced."""
    return (
        F.when(kind == "secret", F.regexp_replace(e, f"^{_SECRET}", ""))
        .when(kind == "name", F.regexp_replace(e, f"^{_TITLE}\\s", ""))
        .otherwise(e)
    )


def _gender(e: Column) -> Column:
    form = F.lit("n")
    for gender in ("m", "f"):
        form = F.when(e.rlike("^(?:" + "|".join(TITLES[gender]) + ")\\.?\\s"), gender).otherwise(form)
    return form


def _country(e: Column) -> Column:
    """Digits of the country code of a phone number: none without plus sign; no code begins another."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.when(e.startswith("+"), F.length(F.regexp_extract(digits, f"^{_COUNTRY}", 0))).otherwise(0)


def _canonical(kind: Column, e: Column) -> Column:
    """What mentions of the same entity share: digits of numbers (of phones without country), lower case of addresses and names."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "name"), F.lower(e))
        .when(kind == "phone", F.substring(digits, _country(e) + 1, F.length(digits)))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .otherwise(e)
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, not for every character that needs it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _byte(h: Column, at: Column) -> Column:
    """Byte ``at`` (from 0, wrapping) of a hash in hex."""
    return F.conv(F.substring(h, (at % _CHARACTERS * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letters(h: Column, text: Column, ranked: bool = False) -> Column:
    """Every ASCII letter and digit replaced by one of its class and case; the rest stays.

    Places are counted over all characters, or (``ranked``, for short texts) over letters and digits only.
    """

    def one(c: Column, i: Column) -> Column:
        rank = F.length(F.regexp_replace(F.substring(text, F.lit(1), i.cast("int")), "[^A-Za-z0-9]", ""))
        b = _byte(h, rank if ranked else i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(b % 26 + 97))
            .when(c.rlike("[A-Z]"), F.char(b % 26 + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(h: Column, text: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        digit = F.substring(h, (i % (2 * _CHARACTERS) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[A-F]"), F.upper(digit)).when(c.rlike("[0-9a-f]"), digit).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(h: Column, text: Column, keep: Column | int = 0) -> Column:
    """Digits replaced, counted from the end so that the same number in other formats agrees.

    The first ``keep`` digits stay; a leading digit other than 0 stays other than 0.
    """
    n = F.length(F.regexp_replace(text, "[^0-9]", ""))

    def one(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(F.substring(text, F.lit(1), (i + 1).cast("int")), "[^0-9]", ""))
        b = _byte(h, n - seen)
        return (
            F.when(~c.rlike("[0-9]") | (seen <= keep), c)
            .when((seen == keep + 1) & (c != "0"), (b % 9 + 1).cast("string"))
            .otherwise((b % 10).cast("string"))
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    reverse = F.split(F.reverse(digits), "")

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(reverse, one), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10


def _card(h: Column, e: Column) -> Column:
    """A card number, valid by its check digit exactly if the original is."""
    made = _digits(h, e)
    plain, was = F.regexp_replace(made, "[^0-9]", ""), F.regexp_replace(e, "[^0-9]", "")
    last = F.right(plain, F.lit(1)).cast("int")
    fits = (last + 10 - _luhn(plain)) % 10
    off = F.when(last == fits, (last + 1) % 10).otherwise(last)
    end = F.when(_luhn(was) == 0, fits).otherwise(off)
    return F.concat(F.substring(made, F.lit(1), F.length(made) - 1), end.cast("string"))


def _ip(h: Column, e: Column, attempt: Column) -> Column:
    """An address; octets that mark a private network stay, or give way to those of a larger private one."""
    kept = F.when(e.startswith("10."), 1).when(e.startswith("192.168."), 2).when(e.startswith("127."), 1).otherwise(0)
    wide = (kept == 2) & (attempt > WIDENED)

    def one(o: Column, i: Column) -> Column:
        own = F.when((i < kept) & ~wide, o).otherwise((_byte(h, i) % 254 + 1).cast("string"))
        return F.when(wide & (i == 0), "10").otherwise(own)

    return F.array_join(F.transform(F.split(e, "\\."), one), ".")


def _email(h: Column, e: Column, key: str) -> Column:
    """An address; equal domains get equal surrogates, the last label stays."""
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(domain, ".", -1)
    stem = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    home = F.sha2(F.concat(F.lit(key + "|domain|"), F.lower(domain)), 512)
    return F.concat(_letters(h, local), F.lit("@"), _once(home, lambda own: _letters(own, stem)), top)


def _name(e: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Invented names word by word, so that a surname alone agrees with the full name.

    Of two words the first is a given name with an ending of the title's gender; names keep script
    and upper case.
    """
    words = F.split(e, " ")

    def one(w: Column, i: Column) -> Column:
        given = (F.size(words) > 1) & (i == 0)
        ending = F.when(given, gender).otherwise(F.lit("n"))
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), ending, F.lower(w), attempt.cast("string")), 512)
        forms = []
        for script, syllables in SYLLABLES.items():
            parts = F.array(*[F.lit(s) for s in syllables])
            stem = F.concat(*[F.element_at(parts, _byte(h, F.lit(k)) % len(syllables) + 1) for k in range(3)])
            end = F.lit("")
            for g in ("m", "f", "n"):
                ends = F.array(*[F.lit(x) for x in ENDINGS[script, g]])
                end = F.when(ending == g, F.element_at(ends, _byte(h, F.lit(9)) % 3 + 1)).otherwise(end)
            forms.append(F.initcap(F.concat(stem, end)))
        made = F.when(w.rlike("\\p{IsCyrillic}"), forms[1]).otherwise(forms[0])
        return F.when(w.rlike("^\\p{Lu}+$"), F.upper(made)).otherwise(made)

    return F.array_join(F.transform(words, one), " ")


def _surrogate(s: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity given as (kind, e, canonical, gender)."""
    kind, e = s["kind"], s["e"]
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, s["canonical"], attempt.cast("string")), 512)
    hexadecimal = e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    more = F.when(attempt > WIDENED, attempt.cast("string")).otherwise("")
    port = F.when(attempt > 3 * WIDENED, F.concat(F.lit(":"), attempt.cast("string"))).otherwise("")

    def made(h: Column) -> Column:
        return (
            F.when(kind == "email", F.concat(more, _email(h, e, key)))
            .when(kind == "phone", F.concat(_digits(h, e, _country(e)), more))
            .when(kind == "ssn", F.concat(_digits(h, e), more))
            .when(kind == "card", F.concat(_card(h, e), more))
            .when(kind == "ip", F.concat(_ip(h, e, attempt), port))
            .when(kind == "key", F.concat(F.lit("AKIA"), _letters(h, F.substring(e, 5, 16)), more))
            .when(
                kind == "iban",
                F.concat(F.substring(e, 1, 2), _letters(h, F.substring(e, F.lit(3), F.length(e)), ranked=True), more),
            )
            .when(kind == "name", F.concat(_name(e, s["gender"], attempt, key), more))
            .otherwise(F.concat(F.when(hexadecimal, _hex(h, e)).otherwise(_letters(h, e)), more))
        )

    return _once(digest, made)


def _entities(text: Column) -> Column:
    """All entities of a text in order, as (whole, kind, e, canonical, gender); e is what is replaced."""
    raw = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    found = F.when(_hinted(text), raw).otherwise(F.array().cast("array<string>"))
    typed = F.transform(found, lambda w: F.struct(w.alias("whole"), _kind(w).alias("kind"), _gender(w).alias("gender")))
    valued = F.transform(
        typed, lambda s: F.struct(s["whole"], s["kind"], _value(s["kind"], s["whole"]).alias("e"), s["gender"])
    )
    return F.transform(
        valued,
        lambda s: F.struct(
            s["whole"], s["kind"], s["e"], _gendered(_canonical(s["kind"], s["e"]), s["e"], s["kind"], s["gender"]).alias("canonical"), s["gender"]
        ),
    )


def _gendered(canonical: Column, e: Column, kind: Column, gender: Column) -> Column:
    """The canonical form, for a full name under a title of a gender with this gender."""
    full = (kind == "name") & (gender != "n") & e.contains(" ")
    return F.when(full, F.concat(canonical, F.lit("|"), gender)).otherwise(canonical)


def _plain(kind: Column, canonical: Column) -> Column:
    return F.when(kind == "name", F.regexp_replace(canonical, "\\|[mf]$", "")).otherwise(canonical)


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """Entities whose first surrogate is taken, with the attempt that gives them one of their own.

    ``entities``: distinct kind, canonical, e, gender. A surrogate is taken if an entity of the kind
    is called so (under whatever title), or if another entity with a smaller canonical form has it. Rounds go on until all
    surrogates are distinct. They end also where a form has fewer free surrogates than entities: after ``WIDENED``
    attempts the number of the attempt is put to the surrogate (an address of a small private network
    goes to a large one first), so that every round draws from values of its own and settles a share of what is left.
    """
    state = stage(entities.withColumn("attempt", F.lit(0)))
    real = entities.select(F.col("kind").alias("_k"), _plain(F.col("kind"), F.col("canonical")).alias("_made")).distinct()
    while True:
        s = F.struct("kind", "e", "canonical", "gender")
        made = stage(state.withColumn("made", _surrogate(s, F.col("attempt"), key)))
        made = made.withColumn("_made", _canonical(F.col("kind"), F.col("made")))
        owner = made.groupBy(F.col("kind").alias("_k"), "_made").agg(
            F.min(F.struct("attempt", "canonical")).alias("owner"), F.count(F.lit(1)).alias("n")
        )
        shared = owner.filter("n > 1").select("_k", "_made", F.col("owner.canonical").alias("_first"))
        taken = real.withColumn("_first", F.lit(None).cast("string")).union(shared)
        blocked = taken.groupBy("_k", "_made").agg(
            F.max(F.col("_first").isNull()).alias("_real"), F.max("_first").alias("_first")
        )
        same = (made["kind"] == blocked["_k"]) & (made["_made"] == blocked["_made"])
        joined = made.join(blocked, same, "left").select(
            "kind",
            "canonical",
            "e",
            "gender",
            "attempt",
            (F.coalesce("_real", F.lit(False)) | (F.col("_first").isNotNull() & (F.col("_first") != F.col("canonical")))).alias("_again"),
        )
        joined = stage(joined)
        if joined.filter("_again").isEmpty():
            return joined.filter("attempt > 0").select("kind", "canonical", "attempt")
        state = stage(joined.withColumn("attempt", F.col("attempt") + F.col("_again").cast("int")).drop("_again"))


def replaced(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs`` with every detected entity replaced in ``text``, ``n_entities`` and ``kinds``.

    Kinds: email, phone, ip, card, ssn, iban, key (cloud access key), secret (value after password,
    token and the like) and name (after a title). The surrogate follows from key, kind and the entity's
    canonical form: equal entities agree everywhere, also in other formats; case, separators, country
    code, check digit, script and gender are kept. A full name under titles of both genders is two
    entities; under a title without gender it is the one with a gender, if there is just one such. Distinct entities get distinct surrogates: the
    distinct entities, counted in the tasks first, are checked for collisions, and the few entities
    that need another attempt are joined to the documents that hold them, by the listed mentions. Spark picks the join by
    the size of what was written; without collisions texts don't move.

    A null text stays null; other texts keep every character outside entities. Repeated rows give
    repeated rows. Columns named like a result are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, own, held, fixes = (spare(f"_pii_{part}", docs) for part in ("doc", "text", "found", "fix"))
    keys = {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), own: F.xxhash64("text")}
    rows = docs.drop("n_entities", "kinds").withColumns({**keys, held: _entities(text)})
    listed = stage(
        rows.select(*keys, F.explode(held).alias("s")).select(*keys, "s.kind", "s.canonical", "s.e", "s.gender")
    )
    named = listed.filter("kind = 'name'").groupBy(_plain(F.col("kind"), F.col("canonical")).alias("_name"))
    genders = named.agg(*[F.max(F.col("canonical").endswith(f"|{g}")).alias(f"_{g}") for g in "mf"])
    settled = genders.filter("_m <> _f").select(
        F.lit("name").alias("kind"), F.col("_name").alias("canonical"), F.when(F.col("_m"), "m").otherwise("f").alias("_settled")
    )
    listed = listed.join(stage(settled), ["kind", "canonical"], "left").select(
        *keys,
        "kind",
        F.concat_ws("|", "kind", "canonical").alias("_mention"),
        F.concat_ws("|", "canonical", "_settled").alias("canonical"),
        "e",
        F.coalesce("_settled", "gender").alias("gender"),
        "_settled",
    )
    listed = stage(listed)
    distinct = stage(listed.groupBy("kind", "canonical").agg(F.min("e").alias("e"), F.max("gender").alias("gender")))
    touched = (
        listed.join(collisions(distinct, key), ["kind", "canonical"], "left")
        .filter("attempt > 0 or _settled is not null")
        .select(*keys, "_mention", F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), "_settled").alias("fix"))
        .distinct()
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_mention", "fix"))).alias(fixes))
    )
    met = rows.join(stage(touched), [*keys], "left")

    def swapped(s: Column) -> Column:
        fix = F.try_element_at(fixes, F.concat_ws("|", s["kind"], s["canonical"]))
        attempt = F.coalesce(fix["attempt"], F.lit(0))
        gender = F.coalesce(fix["_settled"], s["gender"])
        word = F.substring(s["whole"], F.lit(1), F.length(s["whole"]) - F.length(s["e"]))
        settled = F.struct(s["kind"].alias("kind"), s["e"].alias("e"), F.concat_ws("|", s["canonical"], fix["_settled"]).alias("canonical"), gender.alias("gender"))
        return F.concat(word, _surrogate(settled, attempt, key))

    made = F.concat(F.transform(held, swapped), F.array(F.lit("")))
    parts = F.split(text, PATTERN, -1)
    line = F.array_join(F.flatten(F.zip_with(parts, made, lambda p, s: F.array(p, s))), "")
    kept = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    return met.select(
        *[F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.when(F.size(held) == 0, F.col("text")).otherwise(line)).alias("text") if c == "text" else F.col(c) for c in kept],
        F.size(held).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.col(f"{held}.kind"))), ",").alias("kinds"),
    )


def op7_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by surrogates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replaced(docs).select("doc_id", "n_entities", "kinds", "text")
