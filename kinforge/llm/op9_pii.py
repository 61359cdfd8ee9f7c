"""Surrogates for personal data, in DataFrame operations only.

Entities are found by pattern: e-mail addresses, IPv4 and IPv6 addresses, payment-card numbers,
bank account numbers (IBAN), social security numbers, phone numbers, long hexadecimal secrets, and
names behind a form of address or a known given name; a token of a name found is also found
wherever else it stands capitalised in the same document. A name with neither a form of address
nor a listed given name is not found. Each distinct value gets a surrogate of its type from a
keyed hash: letters stay letters of the same script and case, digits digits, separators where they
are; an e-mail address keeps its last label, an IBAN its country; octets stay octets; card numbers
and IBANs that pass their check get ones that pass too; given names become given names of the same
gender and script by a keyed permutation of their list that moves every name, surnames made-up
surnames. Every token of a name is replaced by itself, so that a surname alone keeps its bearer's
surrogate; bare mentions count as entities. Equal values get equal surrogates in all documents
(coreference). A surrogate that two values share, or that is itself a value found, is drawn again
for all but the least value until all are distinct, from a space that widens with the draws where
the format allows it; a given name's is distinct by its permutation, though it can be another
given name found. Should a format have no room for so many values, an error is raised.

Defined cases: null and empty texts hold nothing and are returned as they are; repeated rows are
treated alike; an empty table gives no rows; an input column named n_entities is replaced, others
keep their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, no_null, stored, table

#: used where spark.kinforge.surrogateKey is unset, as in tests
KEY = "kinforge-surrogates"
#: draws after which a format counts as full, and surrogates get longer than their values
ATTEMPTS = 24
#: most distinct values that are broadcast; the salts that a value is dealt out over beyond it
SIDE_LIMIT, SALTS = 200_000, 32

#: fixed values: given names by gender and script
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Thomas Charles Daniel Peter Paul Hans Karl Pierre Jean Carlos Miguel Antonio Ivan Marko Janez Franc Andrej Luka Matej Jože Anton Josip Stefan Martin Jan Tomaž Giovanni Marco Luca "
    "Mario Klaus Jürgen Wolfgang Heinrich Louis François Henri Jacques Juan José Luis Pedro George Edward Henry Richard Joseph Christopher Matthew Andrew Mark Steven Kevin Brian".split(),
    ("f", "latin"): "Mary Anna Linda Susan Sarah Karen Laura Julia Emma Alice Marie Claire Greta Heidi Carmen Lucia Elena Sofia Ana Marija Maja Nina Petra Tanja Barbara Katarina Eva Helena Jana Ivana Giulia Francesca Chiara "
    "Ursula Ingrid Monika Sabine Catherine Isabelle Sophie Camille Isabel Pilar Teresa Elizabeth Jennifer Patricia Margaret Jessica Nancy Lisa Sandra Ashley Emily Rebecca Michelle Amanda".split(),
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Александр Владимир Юрий Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Юлия".split(),
}
#: fixed values: syllables of made-up surnames
SYLLABLES = {"latin": "ba be bor da del den fa fer gal gan hal hen kar kel la lan mar men nor pel ral ren sal tor van wel".split(), "cyrillic": "ба бе бор да дел ден ва вер гал ган кар кел ла лан мар мен нор пел рал рен сал тор".split()}
TITLE = r"(?:Mrs|Mr|Ms|Dr|Prof|Herr|Frau|Señora|Señor|Madame|Monsieur)\.?"

GIVEN_ANY = "|".join(n for names in GIVEN.values() for n in names)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "ipv6": r"(?<![\w:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){2,6}(?::[0-9a-fA-F]{1,4}){1,6}|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){2,6}|[0-9a-fA-F]{3,4}::[0-9a-fA-F]{1,4}))(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){3}(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|AKIA[0-9A-Z]{16})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # area code and number; international without separators, or in groups; national in pairs of digits
    "phone": r"(?<![\w.+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]\d{2,4}){2,5}|0\d(?:[ .-]\d{2}){4})(?!\w)",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{TITLE}[ ]\p{{Lu}}\p{{Ll}}+(?:[ ]\p{{Lu}}\p{{Ll}}+)?|(?:{GIVEN_ANY})[ ]\p{{Lu}}\p{{Ll}}+)(?!\p{{L}})",
}
CAPITALISED = r"(?<!\p{L})\p{Lu}\p{Ll}+(?!\p{L})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(value: Column) -> Column:
    out = F.when(value.rlike(rf"\A(?:{PATTERNS['email']})\z"), "email")
    for k in ("ip", "ipv6", "iban", "card", "secret", "ssn", "phone"):
        out = out.when(value.rlike(rf"\A(?:{PATTERNS[k]})\z"), k)
    return out.otherwise("name")


def draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def letter(alphabet: str, at: Column) -> Column:
    return F.substring(F.lit(alphabet), at + 1, F.lit(1))


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя"


def same_shape(value: Column, seed: Column) -> Column:
    """Each letter or digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), draw(seed, i, 10).cast("string"))
            .when(c.rlike("[a-z]"), letter(LATIN, draw(seed, i, 26)))
            .when(c.rlike("[A-Z]"), letter(LATIN.upper(), draw(seed, i, 26)))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), letter(CYRILLIC, draw(seed, i, len(CYRILLIC))))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), letter(CYRILLIC.upper(), draw(seed, i, len(CYRILLIC))))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def check_sum(digits: Column) -> Column:
    """The weighted sum of a card number's digits, right to left, modulo 10."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring(digits, n - i, F.lit(1)).cast("int").alias("d"), (i % 2 == 1).alias("twice"))),
        F.lit(0),
        lambda t, x: t + F.when(x["twice"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]),
    ) % 10


def concat_with(sep: Column, *parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, sep, p)
    return out


def card(value: Column, seed: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    new = F.concat(F.substring(digits, 1, 1), F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits) - 2), lambda i: draw(seed, i, 10).cast("string")), ""))
    last = F.when(check_sum(digits) == 0, F.pmod(10 - check_sum(F.concat(new, F.lit("0"))), F.lit(10))).otherwise(draw(seed, 99, 10)).cast("string")
    full = F.concat(new, last)
    return concat_with(F.regexp_extract(value, r"\A\d{4}([ -]?)", 1), F.substring(full, 1, 4), F.substring(full, 5, 4), F.substring(full, 9, 4), F.substring(full, 13, 4))


def secret(value: Column, seed: Column) -> Column:
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), lambda i: letter("0123456789abcdef", draw(seed, i, 16))), "")
    return F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(F.upper(hexed), 5, 16))).otherwise(hexed)


def remainder_97(text: Column) -> Column:
    """The number that the text spells, letters as 10 to 35, modulo 97."""
    digit = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + digit(c)).when(c.rlike("[A-Z]"), r * 100 + digit(c)).otherwise(r) % 97)


def iban(value: Column, seed: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    country, body = F.substring(compact, 1, 2), same_shape(F.substring(compact, F.lit(5), F.length(compact)), seed)
    valid = remainder_97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1
    check = F.when(valid, F.lpad((98 - remainder_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(same_shape(F.substring(compact, 3, 2), F.sha2(seed, 256)))
    whole = F.concat(country, check, body)
    return F.when(value.contains(" "), F.regexp_replace(whole, r"(.{4})(?=.)", "$1 ")).otherwise(whole)


def hexadecimal(value: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), letter("0123456789abcdef", draw(seed, i, 16))).when(c.rlike("[A-F]"), letter("0123456789ABCDEF", draw(seed, i, 16))).otherwise(c)), "")


def email(value: Column, seed: Column, attempt: Column) -> Column:
    """Its shape but for the last label; every eighth draw has a letter more."""
    more = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 8).cast("int")), lambda i: F.when(i > 0, letter(LATIN, draw(seed, i + 1000, 26))).otherwise("")), "")
    return F.concat(more, same_shape(F.regexp_extract(value, r"(?s)\A(.*\.)", 1), seed), F.regexp_extract(value, r"([^.]*)\z", 1))


def permuted(names: list[str], key: str) -> dict[str, str]:
    """Each name's successor in a circle dealt by the key: no name keeps its place, no two share one."""
    ring = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
    return dict(zip(ring, ring[1:] + ring[:1]))


def name_token(value: Column, seed: Column, attempt: Column, key: str = KEY) -> Column:
    """A given name of the same gender and script, or a made-up surname of the same script; every eighth draw has a syllable more."""
    out = None
    for names in GIVEN.values():
        own = F.create_map(*[F.lit(n) for pair in permuted(names, key).items() for n in pair])[value]
        out = (F if out is None else out).when(value.isin(names), own)
    made = {}
    for script, parts in SYLLABLES.items():
        made[script] = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + F.floor(attempt / 8).cast("int")), lambda i: F.element_at(F.array(*[F.lit(p) for p in parts]), F.pmod(F.xxhash64(seed, i), F.lit(len(parts))).cast("int") + 1)), ""))
    return out.when(value.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).otherwise(made["latin"])


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 256)
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (1 + draw(seed, i, 254)).cast("string")), ".")
    own = {"ip": octets, "ipv6": hexadecimal(value, seed), "iban": iban(value, seed), "card": card(value, seed), "secret": secret(value, seed), "email": email(value, seed, attempt), "token": name_token(value, seed, attempt, key)}
    out = None
    for k, new in own.items():
        out = (F if out is None else out).when(kind == k, new)
    return out.otherwise(same_shape(value, seed))


def parts_of(value: Column, kind: Column) -> Column:
    """The (kind, value) of what is replaced: an entity itself, or a name's tokens without the form of address."""
    tokens = F.filter(F.split(value, " "), lambda t: ~t.rlike(rf"\A{TITLE}\z"))
    return F.when(kind == "name", F.transform(tokens, lambda t: F.struct(F.lit("token").alias("kind"), t.alias("value")))).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def distinct_surrogates(values: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, value, surrogate`` for distinct (kind, value); surrogates of a kind are distinct."""
    given = F.col("value").isin([n for names in GIVEN.values() for n in names])
    done = values.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))
    done = cut(done)
    attempt = 0
    while True:
        attempt += 1
        first = done.where(~given).groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.where("n > 1").select("kind", "surrogate", "first")
        taken = first.join(values.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "surrogate", F.lit(None).cast("string").alias("first"))
        clash = cut(shared.unionByName(taken).groupBy("kind", "surrogate").agg(F.max("first").alias("first"), F.max(F.col("first").isNull()).alias("all")))
        if clash.isEmpty():
            return done.select("kind", "value", "surrogate")
        d = done.join(clash, ["kind", "surrogate"], "left")
        again = ~given & F.col("all").isNotNull() & (F.col("all") | (F.col("value") != F.col("first")))
        new = surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key)
        if attempt >= ATTEMPTS:  # in place of a form that is left, one of the same kind and longer
            new = F.concat(new, F.lit("x"), F.lower(F.hex(F.xxhash64(F.lit(key), F.lit(attempt), "value"))))
        done = cut(d.select("kind", "value", F.when(again, attempt).otherwise(F.col("attempt")).alias("attempt"), F.when(again, new).otherwise(F.col("surrogate")).alias("surrogate")))


def with_surrogates(each: DataFrame, names: DataFrame) -> DataFrame:
    """``each`` (_row, kind, value, ...) with the surrogate; a value that many rows hold is no hot key."""
    names = cut(names)
    if names.count() <= SIDE_LIMIT:  # three short strings a row
        return each.join(F.broadcast(names), ["kind", "value"])
    dealt = names.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return each.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS))).join(dealt, ["kind", "value", "_salt"]).drop("_salt")


def replace(docs: DataFrame, key: str = "doc_id", text: str = "text", secret_key: str = KEY) -> DataFrame:
    """The documents with surrogates in ``text``, and n_entities."""
    body = no_null(text)
    columns = [c for c in docs.columns if c != "n_entities"]
    # the patterns run over a text once; what they find is kept with the rows, in the shared folder
    looked = docs.select(F.struct(*columns).alias("_d"), F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)).alias("_found"))
    looked = stored(looked, "entities")
    plain = looked.where(F.size("_found") == 0).select("_d.*", F.lit(0).cast("long").alias("n_entities"))
    found = looked.where(F.size("_found") > 0)
    found = found.withColumn("_parts", F.transform("_found", lambda v: parts_of(v, kind_of(v))))
    each = found.select("_row", F.posexplode("_parts").alias("_i", "_p")).select("_row", "_i", F.posexplode("_p").alias("_j", "p")).select("_row", "_i", "_j", "p.kind", "p.value")
    names = distinct_surrogates(each.select("kind", "value").distinct(), secret_key)
    new = with_surrogates(each, names).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_i", "_j", "surrogate", "kind", "value"))).alias("_new"))
    tokens = F.array_distinct(F.transform(F.filter("_new", lambda x: x["kind"] == "token"), lambda x: F.struct(x["value"].alias("value"), x["surrogate"].alias("surrogate"))))
    d = found.join(new, "_row").withColumn("_tokens", F.map_from_entries(tokens))
    d = d.withColumn("_gaps", F.split(F.col("_d")[text], ANY, -1))
    words = F.transform("_gaps", lambda g: F.regexp_extract_all(g, F.lit(CAPITALISED), F.lit(0)))
    d = d.withColumn("_words", F.when(F.size("_tokens") > 0, words))
    bare = F.aggregate("_words", F.lit(0), lambda n, w: n + F.size(F.filter(w, lambda x: F.col("_tokens")[x].isNotNull())))

    def mentions(gap: Column, found: Column) -> Column:
        rest = F.split(gap, CAPITALISED, -1)
        new = F.transform(found, lambda x: F.coalesce(F.col("_tokens")[x], x))
        return F.concat(F.element_at(rest, 1), F.array_join(F.zip_with(new, F.slice(rest, F.lit(2), F.size(new)), lambda a, b: F.concat(a, b)), ""))

    d = d.withColumn("_bare", F.coalesce(bare, F.lit(0)))
    d = d.withColumn("_gaps", F.when(F.col("_bare") > 0, F.zip_with("_gaps", "_words", mentions)).otherwise(F.col("_gaps")))
    gaps = F.col("_gaps")

    def one(v: Column, i: Column) -> Column:
        mine = F.transform(F.filter("_new", lambda x: x["_i"] == i), lambda x: x["surrogate"])
        title = F.regexp_extract(v, rf"\A(?:{TITLE} )+", 0)
        return F.concat(F.when(v.rlike(rf"\A{TITLE} "), title).otherwise(F.lit("")), F.array_join(mine, " "))

    put = F.transform("_found", one)
    joined = F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(put, F.slice(gaps, F.lit(2), F.size(put)), lambda a, b: F.concat(a, b)), ""))
    changed = d.select(*[(joined if c == text else F.col("_d")[c]).alias(c) for c in columns], (F.size("_found") + F.col("_bare")).cast("long").alias("n_entities"))
    return plain.unionByName(changed)


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_key=spark.conf.get("spark.kinforge.surrogateKey", KEY))
