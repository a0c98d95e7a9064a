"""PII: each detected entity is replaced by a keyed surrogate of its type, format and script.

Mail addresses, phone, card, bank and social security numbers, IP addresses, secrets, and names after a
form of address are found by patterns. An entity has a canonical spelling (digits of a number, lower case
of an address or name), and a keyed digest of it chooses the surrogate, laid out again as each mention is
written: separators, case, script and length stay, a card number keeps its check sum, a given name its
gender, settled once over all forms of address it has. Equal entities get equal surrogates in every text. In a
text with such a name, capitalised words equal to one of its given names or surnames are mentions of it too, so
references still match; other names without a form of address are not found.

Different entities must stay different, and no surrogate may be an entity of the data: surrogates that
meet are drawn again with the next attempt number until none meet. From attempt ``RELAX`` on they get
longer, so the rounds end even where a format has few values.

Texts without a digit, ``@`` or form of address pass through. The others are split at their mentions; the
mentions shuffle by entity and return by row. Null text stays null. Repeated rows are replaced each. Column
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.operators.clean import evaluate_once
from rentlens.session import stage

RELAX = 6

# --- fixed values: forms of address by gender, and names by script and gender ---
FEMALE = "Mrs Ms Miss Frau Señora Sra Madame Mme Signora Госпожа Κυρία".split()
MALE = "Mr Herr Señor Sr Monsieur Signor Господин Κύριος".split()
ANY = "Dr Prof".split()
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Emma Greta Helen Ida Julia Laura Lena Maria Nora Olivia Paula Rosa Sara".split(),
    ("latin", "m"): "Adam Anton Bruno David Emil Felix Georg Hugo Jakob Karl Leon Martin Oscar Paul Simon Viktor".split(),
    ("latin", "n"): "Alex Andrea Chris Dominique Jamie Jordan Kim Luca Morgan Noel Robin Sam Sascha Taylor Toni Val".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Олег Павел Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Ζωή Μαρία Νίκη Σοφία Χαρά".split(),
    ("greek", "m"): "Άρης Γιώργος Δήμος Κώστας Νίκος Πέτρος Σπύρος Φώτης".split(),
}
SURNAMES = {
    "latin": "Abbott Becker Calder Dorn Ellery Farrow Garner Holm Iversen Jarvis Keller Linden Mercer Norden Osborn Porter".split(),
    "cyrillic": "Белов Волков Громов Егоров Зимин Котов Лосев Морозов".split(),
    "greek": "Βλάχος Δήμου Ζώης Κάππος Λάμπρου Μάνος Ρήγας Τσάκος".split(),
}

# --- fixed values: patterns of entities, tried in this order at each place ---
TITLES = "|".join(sorted(FEMALE + MALE + ANY, key=len, reverse=True))
# repeated groups are possessive or bounded: the matcher of the JVM recurses once for each turn of any other
_WORD = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
BARE = rf"(?<![\p{{L}}\p{{N}}]){_WORD}"
NAME = rf"(?<![\p{{L}}])(?:{TITLES})\b\.?(?:\s(?!(?:{TITLES})\b){_WORD})++"
# an address begins where its run of characters does, and a domain has at most as many labels as the net allows
MAIL = r"(?<![\p{L}\p{N}][._%+-]{0,8})[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,126}\.\p{L}{2,}"
SECRET = r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|(?=[a-f]*[0-9])[0-9a-f]{32,128}|(?=[A-F]*[0-9])[0-9A-F]{32,128})(?![\p{L}\p{N}])"
BANK = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
KINDS = [("name", NAME), ("mail", MAIL), ("secret", SECRET), ("bank", BANK), ("address", ADDRESS), ("social", SOCIAL), ("phone", PHONE), ("card", CARD)]
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)
HINT = rf"[0-9@]|(?:{TITLES})"

_LETTERS = [  # letters are replaced by letters of the same row
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àáâäçèéêëíîïñóôöúûüß"), (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÚÛÜ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "一二三四五六七八九十天地山水火木金土日月"), (r"[\p{L}\p{N}]", "abcdefghijklmnopqrstuvwxyz"),
]


def kind(mention: Column) -> Column:
    """Which pattern a whole mention fits first."""
    return F.coalesce(*[F.when(F.regexp_like(mention, F.lit(f"^(?:{p})$")), F.lit(name)) for name, p in KINDS])


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^({TITLES})", 1)


def _name(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{TITLES})\b\.?\s", "")


def _script(name: Column) -> Column:
    return F.when(F.regexp_like(name, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(name, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def entities(mentions: DataFrame) -> DataFrame:
    """``mention``, ``kind`` and ``parts`` of distinct mentions: what each is made of, an array of (kind, canonical).

    What the parts of a name share is a column before they are made, since a lambda works it out again for each.
    """
    mention = F.col("mention")
    gender = F.when(_title(mention).isin(FEMALE), "f").when(_title(mention).isin(MALE), "m").otherwise("n")
    split = evaluate_once(mentions.select("mention"), {"kind": kind(mention), "words": F.split(_name(mention), r"\s"), "gender": gender})
    split = evaluate_once(split, {"script": _script(F.col("words")[0])})
    what, words = F.col("kind"), F.col("words")
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canonical"))
    surname = one(F.concat(F.lit("surname_"), F.col("script")), F.lower(F.element_at(words, -1)))
    of_given = F.concat(F.lit("given_"), F.col("gender"), F.lit("_"), F.col("script"))
    given = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda p: one(of_given, F.lower(p)))
    digits = F.regexp_replace(mention, "[^0-9]", "")
    plain = F.when(what.isin("card", "social"), digits).when(what == "phone", F.substring(digits, -10, 10)).when(what == "bank", F.replace(mention, F.lit(" "), F.lit("")))
    parts = F.when(what == "name", F.concat(given, F.array(surname))).otherwise(F.array(one(what, plain.otherwise(F.lower(mention)))))
    return split.select("mention", "kind", parts.alias("parts"))


def _draw(digest: Column, i: Column) -> Column:
    """Byte ``i`` of a hex digest, which is used again from its beginning when it ends."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, *parts: Column) -> Column:
    message = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(message, 256), F.sha2(F.concat(message, F.lit("\x1f+")), 256))


def _letters(text: Column, digest: Column, rows=_LETTERS) -> Column:
    """Each letter or digit replaced by one of its row, everything else kept."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for pattern, row in rows:
            drawn = F.substring(F.lit(row), _draw(digest, i) % len(row) + 1, F.lit(1))
            fits = F.regexp_like(c, F.lit(f"^{pattern}$"))
            out = F.when(fits, drawn) if out is None else out.when(fits, drawn)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """Check sum of a card number, 0 for a valid one. The last digit counts once, the one before it twice."""
    backward = F.split(F.reverse(digits), "")

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(backward, one), F.lit(0), lambda a, b: a + b) % 10


def _from(pool: list[str], byte: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), byte % len(pool) + 1)


def _site(canonical: Column) -> Column:
    """What an address has between the @ and its last dot."""
    return F.regexp_extract(F.substring_index(canonical, "@", -1), r"^(.*)\.[^.]*$", 1)


def surrogate(what: Column, canonical: Column, attempt: Column) -> Column:
    """Replacement of an entity for an attempt, in canonical spelling, by the columns ``digest`` and ``site_digest``."""
    digest = F.col("digest")
    drawn = lambda i: _draw(digest, F.lit(i))
    longer = F.when(attempt >= RELAX, F.concat_ws("", *[(drawn(40 + i) % 10).cast("string") for i in range(4)], attempt.cast("string"))).otherwise("")
    hexes = [("[0-9a-f]", "0123456789abcdef")]
    card = F.concat(F.substring(canonical, 1, 1), _letters(F.expr("substring(canonical, 2, length(canonical) - 2)"), digest))
    check = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(card, d.cast("string"))) == luhn(canonical)), 1)
    local, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    site, top = _site(canonical), F.substring_index(domain, ".", -1)
    mail = F.concat(_letters(local, digest), longer, F.lit("@"), _letters(site, F.col("site_digest")), F.lit("."), top)
    ip = F.concat_ws(".", *[(drawn(i) % 254 + 1).cast("string") for i in range(4)])
    out = F.when(what == "card", F.concat(card, check.cast("string"), longer)).when(what == "mail", mail).when(what == "address", F.concat(ip, longer))
    out = out.when(what == "bank", F.concat(F.substring(canonical, 1, 2), _letters(F.expr("substring(canonical, 3, length(canonical))"), digest), longer))
    out = out.when(what == "secret", F.concat(F.when(F.regexp_like(canonical, F.lit("^[0-9a-f]+$")), _letters(canonical, digest, hexes)).otherwise(
        F.concat(F.regexp_extract(canonical, "^(akia|gh._|sk-)?", 0), _letters(F.regexp_replace(canonical, "^(akia|gh._|sk-)", ""), digest))), longer))
    suffix = F.when(attempt >= RELAX, F.translate(longer, "0123456789", "abcdefghij")).otherwise("")
    for (script, gender), pool in GIVEN.items():
        second = F.when(attempt >= 2, F.concat(F.lit("-"), _from(pool, drawn(1)))).otherwise("")
        kinds = [f"given_{gender}_{script}"] + ([f"given_n_{script}"] if (script, "n") not in GIVEN and gender == "f" else [])
        out = out.when(what.isin(kinds), F.concat(_from(pool, drawn(0)), second, suffix))
    for script, pool in SURNAMES.items():
        second = F.when(attempt >= 1, F.concat(F.lit("-"), _from(pool, drawn(1)))).otherwise("")
        out = out.when(what == f"surname_{script}", F.concat(_from(pool, drawn(0)), second, suffix))
    return out.otherwise(F.concat(_letters(canonical, digest), longer))


def distinct_surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canonical``, ``surrogate`` for distinct entities: no two alike, none an entity itself."""
    known = stage(found.select("kind", "canonical").distinct(), "pii-entities")
    settled, waiting, attempt = None, known, 0
    while True:
        seen = {"digest": _digest(key, F.col("kind"), F.col("canonical"), F.lit(str(attempt))), "site_digest": _digest(key, F.lit("site"), _site(F.col("canonical")))}
        tried = evaluate_once(waiting, seen).withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt)))
        tried = stage(tried.drop(*seen).withColumn("spelt", F.lower("surrogate")), "pii-tried")
        first = tried.groupBy("kind", "spelt").agg(F.min("canonical").alias("canonical"))
        taken = known.select("kind", F.col("canonical").alias("spelt"))
        if settled is not None:
            taken = taken.unionByName(settled.select("kind", "spelt"))
        good = tried.join(first, ["kind", "spelt", "canonical"], "left_semi").join(taken, ["kind", "spelt"], "left_anti")
        good = stage(good.select("kind", "canonical", "surrogate", "spelt"), "pii-settled")
        settled = good if settled is None else settled.unionByName(good)
        waiting = stage(waiting.join(good, ["kind", "canonical"], "left_anti"), "pii-waiting")
        if waiting.isEmpty():
            return settled.drop("spelt")
        attempt += 1


def _laid_out(mention: Column, new: Column) -> Column:
    """Surrogate letters and digits put from the right into a number's mention; what is left of it stays."""
    chars = F.split(mention, "")
    place = lambda i: F.length(F.regexp_replace(F.array_join(F.slice(chars, i + 1, F.size(chars)), ""), r"[^\p{L}\p{N}]", ""))
    one = lambda c, i: F.when(F.regexp_like(c, F.lit(r"[\p{L}\p{N}]")) & (place(i) <= F.length(new)), F.substring(new, F.length(new) - place(i) + 1, F.lit(1))).otherwise(c)
    extra = F.substring(new, F.lit(1), F.greatest(F.length(new) - F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")), F.lit(0)))
    return F.concat(extra, F.array_join(F.transform(chars, one), ""))


def replacement(mention: Column, what: Column, new: Column) -> Column:
    """How a mention is written with the surrogates of its entities, an array in order."""
    upper = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    whole = F.when(upper, F.upper(new[0])).otherwise(new[0])
    title = F.regexp_extract(mention, rf"^(?:{TITLES})\b\.?\s", 0)
    return F.when(what == "name", F.concat(title, F.array_join(new, " "))).when(what.isin("mail", "address", "secret"), whole).otherwise(_laid_out(mention, new[0]))


def _one_gender(parts: DataFrame) -> DataFrame:
    """The parts with one kind for each given name of a script: of the one gender its forms of address have, else neutral."""
    base, sex = F.regexp_replace("kind", "^given_[fmn]_", "given_").alias("_base"), F.regexp_extract("kind", "^given_([fmn])_", 1)
    known = parts.where(F.col("kind").startswith("given_")).groupBy(base, F.col("canonical").alias("_of")).agg(F.max(sex == "f").alias("f"), F.max(sex == "m").alias("m"))
    script = F.replace("_base", F.lit("given_"), F.lit(""))
    neutral = F.when(script.isin([s for s, g in GIVEN if g == "n"]), "n").otherwise("f")
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise(neutral)
    known = known.select("_base", "_of", F.concat(F.lit("given_"), gender, F.lit("_"), script).alias("_kind"))
    joined = parts.join(known, (F.regexp_replace("kind", "^given_[fmn]_", "given_") == F.col("_base")) & (F.col("canonical") == F.col("_of")), "left")
    return joined.withColumn("kind", F.coalesce("_kind", "kind")).drop("_base", "_of", "_kind")


def _with_bare_words(split: DataFrame) -> DataFrame:
    """Rows with ``mentions`` as (mention, bare): in texts with a name, capitalised words of the gaps become bare mentions."""
    named = F.exists("mentions", lambda m: F.regexp_like(m, F.lit(rf"^(?:{TITLES})\b\.?\s")))
    tagged = lambda m, bare: F.struct(m.alias("mention"), F.lit(bare).alias("bare"))
    none = F.array().cast("array<struct<mention:string,bare:boolean>>")
    held = lambda i: F.when(i < F.size("mentions"), F.array(tagged(F.get("mentions", i), False))).otherwise(none)
    words = lambda g: F.transform(F.regexp_extract_all(g, F.lit(BARE), F.lit(0)), lambda w: tagged(w, True))
    said = F.flatten(F.transform("gaps", lambda g, i: F.concat(words(g), held(i))))
    gaps = F.flatten(F.transform("gaps", lambda g: F.split(g, BARE, -1)))
    plain = split.where(~named).select("whole", "row", "gaps", F.transform("mentions", lambda m: tagged(m, False)).alias("mentions"))
    return plain.unionByName(split.where(named).select("whole", "row", gaps.alias("gaps"), said.alias("mentions")))


def replace_entities(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in ``text`` and ``n_replaced``, the number of mentions. A column of that name is replaced."""
    names = [c for c in documents.columns if c != "n_replaced"]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text)
    hinted = F.coalesce(F.regexp_like(F.col(text), F.lit(HINT)), F.lit(False))
    rest = documents.where(~hinted).select(whole.alias("whole"), F.col(text).alias("new_text"), F.lit(0).cast("long").alias("n_replaced"))
    split = documents.where(hinted).select(
        whole.alias("whole"), F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0)).alias("mentions"), F.split(F.col(text), ENTITY, -1).alias("gaps"))
    split = stage(split.withColumn("row", F.monotonically_increasing_id()), "pii-split")
    split = stage(_with_bare_words(split), "pii-words")
    every = split.select("row", F.posexplode("mentions").alias("at", "said")).select("row", "at", "said.*")
    said, bare = every.where("not bare").drop("bare"), every.where("bare").drop("bare")
    distinct = stage(entities(said.groupBy("mention").agg(F.count("*").alias("n"))), "pii-mentions")
    parts = distinct.select("mention", F.col("kind").alias("what"), F.posexplode("parts").alias("part", "entity")).select("mention", "what", "part", "entity.kind", "entity.canonical")
    parts = stage(_one_gender(parts), "pii-parts")
    drawn = distinct_surrogates(parts, key)
    new = parts.join(drawn, ["kind", "canonical"]).groupBy("mention", "what").agg(F.sort_array(F.collect_list(F.struct("part", "surrogate"))).alias("new"))
    written = stage(new.select(F.col("mention").alias("_mention"), replacement(F.col("mention"), F.col("what"), F.col("new.surrogate")).alias("written")), "pii-written")
    # a text's own names, for its bare mentions; a word that is both is the surname
    own = said.join(parts.where("what = 'name'").select(F.col("mention").alias("_mention"), "kind", "canonical"), F.col("mention") == F.col("_mention"))
    own = own.groupBy(F.col("row").alias("_row"), "canonical").agg(F.max("kind").alias("kind")).join(drawn, ["kind", "canonical"])
    looked = bare.join(own.select("_row", "canonical", "surrogate"), (F.col("row") == F.col("_row")) & (F.lower("mention") == F.col("canonical")), "left")
    upper = F.upper("mention") == F.col("mention")
    again = F.when(upper, F.upper("surrogate")).otherwise(F.col("surrogate"))
    looked = looked.select("row", "at", F.coalesce(again, "mention").alias("written"), F.col("surrogate").isNotNull().cast("long").alias("hit"))
    told = said.join(written, F.col("mention") == F.col("_mention")).select("row", "at", "written", F.lit(1).cast("long").alias("hit")).unionByName(looked)
    back = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "written"))).alias("said"), F.sum("hit").alias("hits"))
    joined = split.join(back.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    filled = F.array_join(F.zip_with("gaps", F.coalesce(F.col("said.written"), F.array().cast("array<string>")), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    changed = joined.select("whole", filled.alias("new_text"), F.coalesce("hits", F.lit(0)).cast("long").alias("n_replaced"))
    out = rest.unionByName(changed)
    return out.select(*[F.col("new_text").alias(c) if i == at else F.col(f"whole.c{i}").alias(c) for i, c in enumerate(names)], "n_replaced")
