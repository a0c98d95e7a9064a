import re

from pyspark.sql import functions as F

from rentlens.llm import surrogates

SHAPE = "doc_id long, text string, n_replaced string, row string"


def replaced(spark, texts, key="key"):
    documents = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SHAPE)
    out = surrogates.replace_entities(documents, key)
    assert out.columns == ["doc_id", "text", "row", "n_replaced"]
    return {r.doc_id: (r.text, r.n_replaced) for r in out.collect()}


def test_format_gender_script_and_coreference(spark):
    out = replaced(spark, [
        "Mrs. Ann Smith met Mr. Smith; Госпожа Анна Иванова.", "call 017-555-7713 or +1 (017) 555-7713", "4111 1111 1111 1111 and 4111-1111-1111-1111",
        "JOE.B@SITE.COM joe.b@site.com", "from 10.2.3.4!!", None, "", "version 4.0 of 2020", "ssn 123-45-6789 " * 3, "DE89 3704 0044 0532 0130 00", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"",
    ])
    first, n = out[0]
    names = re.match(r"Mrs\. ([\w-]+) ([\w-]+) met Mr\. ([\w-]+); Госпожа ([\w-]+) ([\w-]+)\.$", first)
    assert n == 3 and names[2] == names[3] and names[1].split("-")[0] in surrogates.GIVEN["latin", "f"]
    assert names[4].split("-")[0] in surrogates.GIVEN["cyrillic", "f"] and re.match("[А-Я]", names[5])
    phones = re.match(r"call (\d{3}-\d{3}-\d{4}) or \+1 \((\d{3})\) (\d{3}-\d{4})$", out[1][0])
    assert phones[1] == f"{phones[2]}-{phones[3]}" != "017-555-7713"
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", out[2][0])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] != "4111111111111111"
    odd = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits[0]))]
    assert sum(d - 9 if d > 9 else d for d in odd) % 10 == 0
    upper, lower = out[3][0].split()
    assert upper == upper.upper() and upper.lower() == lower != "joe.b@site.com" and re.match(r"[a-z]{3}\.[a-z]@[a-z]{4}\.com$", lower)
    assert re.match(r"from \d+\.\d+\.\d+\.\d+!!$", out[4][0]) and "10.2.3.4" not in out[4][0]
    assert out[5] == (None, 0) and out[6] == ("", 0) and out[7] == ("version 4.0 of 2020", 0)
    assert len(set(out[8][0].split()[1::2])) == 1 and out[8][1] == 3
    assert re.match(r"DE\d\d( \d{4}){4} \d\d$", out[9][0]) and re.match(r'token = "[0-9a-f]{40}"$', out[10][0])


def test_bare_names_and_one_gender(spark):
    out = replaced(spark, [
        "Mr Karl Weber came. Weber said: Karl, Weber's car. WEBER! Berlin", "Dr Anna Maria Schmidt; Schmidt and Maria", "Dr Andrea Lang", "Mrs Andrea Lang", "Weber alone, a@b.com",
        "Herr Dr Klein met Mrs Lang Mr Klein"])
    given, last, *rest = re.match(r"Mr ([\w-]+) ([\w-]+) came\. ([\w-]+) said: ([\w-]+), ([\w-]+)'s car\. ([\w-]+)! Berlin$", out[0][0]).groups()
    assert rest == [last, given, last, last.upper()] and out[0][1] == 5
    assert last != "Weber" and given != "Karl"
    a, b, c, d, e = re.match(r"Dr ([\w-]+) ([\w-]+) ([\w-]+); ([\w-]+) and ([\w-]+)$", out[1][0]).groups()
    assert (d, e) == (c, b) and len({a, b, c}) == 3 and not {a, b, c} & {"Anna", "Maria", "Schmidt"}
    assert out[2][0].split()[1:] == out[3][0].split()[1:] and out[3][0].split()[1].split("-")[0] in surrogates.GIVEN["latin", "f"]
    assert out[4][0].startswith("Weber alone, ") and out[4][1] == 1
    x, y, z = re.match(r"Herr Dr ([\w-]+) met Mrs ([\w-]+) Mr ([\w-]+)$", out[5][0]).groups()
    assert x == z != y == out[2][0].split()[2]


def test_surrogates_depend_on_the_key_only(spark):
    texts = [f"mail u{i}@host.com" for i in range(20)]
    assert replaced(spark, texts) == replaced(spark, texts)
    assert replaced(spark, texts) != replaced(spark, texts, "other")


def test_different_entities_stay_different(spark):
    # far more surnames than the list has, and one-letter addresses
    found = spark.range(2000).select(F.lit("surname_latin").alias("kind"), F.concat(F.lit("name"), F.col("id").cast("string")).alias("canonical"))
    letters = spark.range(26).select(F.lit("mail").alias("kind"), F.concat(F.chr(F.col("id") + 97), F.lit("@a.com")).alias("canonical"))
    rows = surrogates.distinct_surrogates(found.unionByName(letters), "k").collect()
    assert len(rows) == 2026
    assert len({(r.kind, r.surrogate.lower()) for r in rows}) == 2026
    assert not {r.surrogate.lower() for r in rows} & {r.canonical for r in rows}


def test_long_repeated_and_no_rows(spark):
    out = replaced(spark, ["word " * 200_000 + "a.b@c.org", "7.7.7.7 " * 3000, "7.7.7.7 " * 3000])
    assert out[0][1] == 1 and "a.b@c.org" not in out[0][0] and len(out[0][0]) == len("word " * 200_000 + "a.b@c.org")
    assert out[1] == out[2] and out[1][1] == 3000 and "7.7.7.7" not in out[1][0]
    assert surrogates.replace_entities(spark.createDataFrame([], SHAPE), "k").count() == 0


def test_column_functions_only(spark):
    plan = surrogates.replace_entities(spark.createDataFrame([(1, "a@b.com", "x", "y")], SHAPE), "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|NestedLoop|Cartesian", plan)


def test_very_long_names_addresses_and_domains(spark):
    names = "Mr " + " ".join(f"N{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    texts = [names, "a." * 250_000 + "b@site.com tail", "x" * 1_000_000 + "@site.com", "me@" + "a." * 100 + "com", "me@" + "a." * 50_000 + "com", "w" * 1_000_000, "O’" * 50_000 + " 7"]
    out = replaced(spark, texts)
    assert out[0][1] == 1 and out[0][0].startswith("Mr ") and out[0][0].count(" ") == names.count(" ") and out[0][0] != names
    assert out[1][1] == 1 and out[1][0].endswith(" tail") and out[2][1] == 1 and len(out[2][0]) == len(texts[2])
    assert out[3][1] == 1 and out[4] == (texts[4], 0)  # no domain has so many labels
    assert out[5] == (texts[5], 0) and out[6] == (texts[6], 0)
