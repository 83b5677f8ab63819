"""Personal data and secrets: detection and keyed surrogates, with DataFrame functions only.

Patterns find e-mail addresses, phone, card, account and security numbers, network addresses, secrets, and names behind a title. Each
distinct entity gets a surrogate drawn from a keyed hash: characters of the same class in the same places, a card's check digit,
a phone's country code, an address's top-level domain, a name's gender and script stay. Parts that say the same (a mail domain, a family
name, a number written in two ways) get the same replacement everywhere. Surrogates that two entities share, or that are
somebody's real data, are found by a join over the distinct entities and drawn again until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import saved

# Titles by gender, and the patterns of each kind in the order in which they are tried.
MALE_TITLES = ["mr", "herr", "monsieur", "sr", "señor", "господин", "г-н"]
FEMALE_TITLES = ["mrs", "ms", "frau", "mme", "madame", "sra", "señora", "госпожа", "г-жа"]
PATTERNS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])",
    "secret": r"(?<!\w)(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?\"?[A-Za-z0-9+/_.-]{5,}[A-Za-z0-9+/_]|(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|gh[pousr]_[A-Za-z0-9]{36}(?!\w))|(?<=\")[0-9a-f]{32,64}(?=\")",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w(+-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])",
    "card": r"(?<![\w.+-])[3-6](?:[ -]?\d){12,18}(?![\w-])",
    "name": r"(?<![\w-])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Mme|Madame|Sra?|Señora?|Господин|Госпожа|господин|госпожа|г-н|г-жа)\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}",
}
GIVEN = {
    "latin-m": ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon"],
    "latin-f": ["Anna", "Clara", "Diana", "Elena", "Flora", "Helga", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia"],
    "latin-n": ["Alex", "Andrea", "Kim", "Nicola", "Robin", "Sascha"],
    "cyrillic-m": ["Андрей", "Борис", "Виктор", "Денис", "Иван", "Павел"],
    "cyrillic-f": ["Алла", "Вера", "Дарья", "Елена", "Ирина", "Ольга"],
    "cyrillic-n": ["Женя", "Саша", "Валя"],
}
FAMILY = {"latin": ["Adler", "Berg", "Costa", "Durand", "Fischer", "Garner", "Holm", "Lindner", "Moreno", "Novak", "Palmer", "Weber"], "cyrillic": ["Белов", "Громов", "Зимин", "Лапин", "Орлов", "Соколов"]}
SYLLABLES = {"latin": "ba be da do fa ga ha jo ka la le ma mi na no pa ra re sa si ta to va wi".split(), "cyrillic": "ба ве да ге жо ка ла ми на по ра се та ву".split()}
ENDINGS = {"latin-m": "n", "latin-f": "na", "latin-n": "l", "cyrillic-m": "н", "cyrillic-f": "на", "cyrillic-n": "ня"}

#: What each kind can begin with. Looked at first, it spares most words of a text the longer patterns.
FIRST = {"email": r"[A-Za-z0-9._%+-]", "secret": r"[AGPSTagpst0-9a-f]", "iban": r"[A-Z]{2}\d", "ip": r"\d", "ssn": r"\d", "phone": r"[\d(+]", "card": r"[3-6]", "name": r"[DFHMPSГг]"}
#: One pattern for all kinds, none of which begins within a word.
ANY = r"(?<!\w)(?:" + "|".join(f"(?={FIRST[kind]})(?:{pattern})" for kind, pattern in PATTERNS.items()) + ")"
#: What a text has at least if it has any of them: cheap to look for.
SIGNS = r"[0-9@=:\"]", r"A[KS]IA|gh[pousr]_|[DFHMPSГг](?:rs?|s|onsieur|me|adame|rof|err|rau|ra?|eñora?|осподин|оспожа|-н|-жа)\.? \p{Lu}"


def _found(text: Column) -> Column:
    """All pieces of a text that meet a pattern, in their order; null for a null text."""
    return F.when(text.rlike(SIGNS[0]) | text.rlike(SIGNS[1]), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).when(text.isNotNull(), F.array().cast("array<string>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _kind(raw: Column) -> Column:
    """Which pattern a found piece of text meets."""
    kind = F.lit("secret")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _parts(raw: Column, kind: Column) -> Column:
    """The entities in a found piece: an array of kind and normal form; one but for names, which have one for each word."""
    words = F.split(raw, " ")
    title = F.regexp_replace(F.lower(words[0]), r"\.", "")
    gender = F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").otherwise("n")
    script = F.when(raw.rlike(r" \p{IsCyrillic}"), "cyrillic").otherwise("latin")
    count = F.size(words)
    named = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), count)),
        lambda i: F.struct(
            F.when(i < count, F.concat(F.lit("given-"), script, F.lit("-"), gender)).when(script == "cyrillic", F.concat(F.lit("family-cyrillic-"), gender)).otherwise("family-latin").alias("kind"),
            F.lower(F.element_at(words, F.least(i, count))).alias("norm"),
        ),
    )
    digits = _digits(raw)
    value = F.regexp_replace(raw, r"^(?i:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?\"?|^AKIA|^ASIA|^gh[pousr]_", "")
    norm = (
        F.when(kind == "email", F.lower(raw)).when(kind == "ip", raw).when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)).otherwise(value)
    )
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), norm.alias("norm"))))


def _draw(key: str, salt: str, below: str) -> str:
    """SQL for a number from 0 to ``below`` - 1 out of a keyed hash."""
    return f"pmod(CAST(conv(substring(sha2(concat_ws('|', '{key}', {salt}), 256), 1, 13), 16, 10) AS BIGINT), {below})"


def _alike(text: str, first: str, salt: str, key: str) -> str:
    """SQL for ``text`` with every letter and digit drawn anew in its class, from place ``first`` on."""
    draw = lambda n: _draw(key, f"{salt}, i", str(n))
    return f"""array_join(transform(sequence(1, length({text})), i -> CASE
        WHEN i < {first} THEN substring({text}, i, 1)
        WHEN rlike(substring({text}, i, 1), '[0-9]') THEN CAST({draw(10)} AS STRING)
        WHEN rlike(substring({text}, i, 1), '[a-f]') THEN substring('abcdef', CAST({draw(6)} AS INT) + 1, 1)
        WHEN rlike(substring({text}, i, 1), '[g-z]') THEN substring('ghijklmnopqrstuvwxyz', CAST({draw(20)} AS INT) + 1, 1)
        WHEN rlike(substring({text}, i, 1), '[A-Z]') THEN chr(65 + {draw(26)})
        ELSE substring({text}, i, 1) END), '')"""


def _luhn(digits: str) -> str:
    twice = f"2 * CAST(substring(reverse({digits}), i, 1) AS INT)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN CAST(substring(reverse({digits}), i, 1) AS INT) WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END) % 10"


def _from_list(words: list[str], salt: str, key: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({listed}), CAST({_draw(key, salt, str(len(words)))} AS INT) + 1)"


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` for an entity (``kind, norm``) and its ``attempt``."""
    salt = "kind, norm, CAST(attempt AS STRING)"
    plain = _alike("norm", "1", salt, key)
    # A mail domain is drawn for itself, all but its top-level part; late attempts lengthen the local part.
    domain = "substring_index(norm, '@', -1)"
    host = f"substring({domain}, 1, length({domain}) - length(substring_index({domain}, '.', -1)) - 1)"
    local = "substring_index(norm, '@', 1)"
    email = f"concat({_alike(local, '1', salt, key)}, CASE WHEN attempt > 3 THEN concat('.', CAST({_draw(key, salt, '1000000000')} AS STRING)) ELSE '' END, '@', {_alike(host, '1', host, key)}, '.', substring_index({domain}, '.', -1))"
    octet = "element_at(split(norm, '[.]'), k)"
    draw_octet = f"""CAST(CASE WHEN attempt > 3 THEN 1 + {_draw(key, salt + ', k', '254')} WHEN length({octet}) = 1 THEN 1 + {_draw(key, salt + ', k', '9')}
        WHEN length({octet}) = 2 THEN 10 + {_draw(key, salt + ', k', '90')} ELSE 100 + {_draw(key, salt + ', k', '124')} END AS STRING)"""
    ip = f"array_join(transform(sequence(1, 4), k -> {draw_octet}), '.')"
    # A number's first digit stays, as the network or country is told by it, and a ten-digit phone's exchange begins with 2 to 9; a valid card gets a valid check digit.
    number = _alike("norm", "2", salt, key)
    exchange = f"CASE WHEN kind = 'phone' AND length(norm) = 10 THEN overlay({number} PLACING CAST(2 + {_draw(key, salt, '8')} AS STRING) FROM 4) ELSE {number} END"
    found = entities.withColumn("plain", F.expr(f"CASE WHEN kind IN ('card', 'ssn', 'phone') THEN {exchange} WHEN kind = 'iban' THEN {_alike('norm', '3', salt, key)} WHEN kind = 'secret' THEN {plain} END"))
    found = found.withColumn("body", F.expr("CASE WHEN kind = 'card' THEN concat(substring(plain, 1, length(plain) - 1), '0') END"))
    card = f"CASE WHEN {_luhn('norm')} = 0 THEN concat(substring(body, 1, length(body) - 1), CAST((10 - {_luhn('body')}) % 10 AS STRING)) ELSE plain END"
    cases = []
    for script, words in FAMILY.items():
        for gender in ("",) if script == "latin" else ("-m", "-f", "-n"):
            cases.append((f"family-{script}{gender}", script, words, "а" if gender == "-f" else ""))
    cases += [(f"given-{kind}", kind.split("-")[0], words, "") for kind, words in GIVEN.items()]
    names = "CASE"
    for kind, script, words, ending in cases:
        # After the list, words of syllables that grow with the attempts, with an ending that fits the gender.
        built = "".join(f", {_from_list(SYLLABLES[script], f'{salt}, {n}', key)}" for n in range(3))
        longer = f"array_join(transform(sequence(1, 1 + attempt div 4), k -> {_from_list(SYLLABLES[script], salt + ', k + 10', key)}), '')"
        tail = ENDINGS[kind.removeprefix("given-")] if kind.startswith("given") else ending
        names += f" WHEN kind = '{kind}' THEN CASE WHEN attempt = 0 THEN concat({_from_list(words, salt, key)}, '{ending}') ELSE initcap(concat_ws(''{built}, {longer}, '{tail}')) END"
    return found.withColumn("surrogate", F.expr(f"CASE WHEN kind = 'email' THEN {email} WHEN kind = 'ip' THEN {ip} WHEN kind = 'card' THEN {card} WHEN plain IS NOT NULL THEN plain ELSE lower({names} END) END")).drop("plain", "body")


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, surrogate`` of distinct entities: no two of a kind share a surrogate, and none is an entity's own form.

    Of entities that draw the same surrogate the one with the smallest form keeps it; the others draw again.
    """
    waiting = saved(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)))
    taken = waiting.select("kind", F.col("norm").alias("surrogate"))
    rounds = []
    while waiting.limit(1).count():
        drawn = saved(_drawn(waiting, key))
        firsts = drawn.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        kept = saved(firsts.select("kind", "norm", "surrogate"))
        rounds.append(kept)
        taken = taken.unionByName(kept.select("kind", "surrogate"))
        waiting = saved(drawn.join(kept, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
    found = rounds[0] if rounds else waiting.select("kind", "norm", F.col("norm").alias("surrogate"))
    for more in rounds[1:]:
        found = found.unionByName(more)
    return found


def _written(raw: Column, kind: Column, found: Column) -> Column:
    """A found piece with its surrogate in the piece's own form. Where a surrogate is as long as what it replaces, its letters and digits
    fill the piece's from the right, in their case, between the piece's separators."""
    marks = F.regexp_replace(found[0], r"[^0-9A-Za-z]", "")
    own = F.regexp_replace(raw, r"[^0-9A-Za-z]", "")
    place = lambda i: F.length(marks) - F.length(own) + F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), r"[^0-9A-Za-z]", ""))
    one = lambda i: F.substring(raw, i, F.lit(1))
    mark = lambda i: F.when(one(i).rlike("[A-Z]"), F.upper(F.substring(marks, place(i), F.lit(1)))).otherwise(F.substring(marks, place(i), F.lit(1)))
    aligned = F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.when(one(i).rlike("[0-9A-Za-z]") & (place(i) > 0), mark(i)).otherwise(one(i))), "")
    whole = F.when(raw == F.upper(raw), F.upper(found[0])).otherwise(found[0])
    name = F.concat(F.split(raw, " ")[0], F.lit(" "), F.array_join(F.transform(found, F.initcap), " "))
    longer = kind.isin("email", "ip") & (F.length(found[0]) != F.length(raw))
    return F.when(kind == "name", name).when(longer, whole).otherwise(aligned)


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """``text_key, text_bytes, subs``: for each distinct text with entities, the replacements of its found pieces in their order."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("text_bytes"), _found(F.col("text")).alias("found"))
    mentions = texts.filter(F.size("found") > 0).select("text_key", "text_bytes", F.posexplode("found").alias("at", "raw")).distinct()
    mentions = saved(mentions)
    pieces = saved(mentions.select("raw").distinct().withColumn("kind", _kind(F.col("raw"))))
    parts = pieces.select("raw", F.posexplode(_parts(F.col("raw"), F.col("kind"))).alias("part", "entity"))
    parts = saved(parts.select("raw", "part", F.col("entity.kind").alias("part_kind"), F.col("entity.norm").alias("part_norm")))
    known = saved(assigned(parts.select(F.col("part_kind").alias("kind"), F.col("part_norm").alias("norm")), key))
    joined = parts.join(known.select(F.col("kind").alias("part_kind"), F.col("norm").alias("part_norm"), "surrogate"), ["part_kind", "part_norm"])
    filled = joined.groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("found"))
    written = pieces.join(filled, "raw").select("raw", _written(F.col("raw"), F.col("kind"), F.col("found.surrogate")).alias("sub"))
    written = saved(written)
    subs = mentions.join(written, "raw").groupBy("text_key", "text_bytes").agg(F.array_sort(F.collect_list(F.struct("at", "sub"))).alias("subs"))
    return saved(subs.select("text_key", "text_bytes", F.col("subs.sub").alias("subs")))


def with_surrogates(docs: DataFrame, key: str = "surrogates", count: str | None = None) -> DataFrame:
    """The rows, all columns, with personal data in ``text`` replaced and ``n_chars``, if there is one, the new text's length.

    ``count`` names a column for the number of replaced pieces. Null and empty texts stay as they are; rows that repeat get the same
    text. Two documents that name the same person, number or address do so afterwards too.
    """
    subs = replacements(docs, key)
    used = {c.lower() for c in docs.columns}
    private = lambda name: name if name not in used else private(name + "_")
    found, text_key, text_bytes = private("found_pieces"), private("found_key"), private("found_bytes")
    looked = docs.withColumn(found, _found(F.col("text")))
    has = F.coalesce(F.size(found) > 0, F.lit(False))
    plain, hit = looked.filter(~has), looked.filter(has)
    subs = subs.select(F.col("text_key").alias(text_key), F.col("text_bytes").alias(text_bytes), F.col("subs").alias(private("found_subs")))
    hit = hit.join(subs, (F.xxhash64("text") == F.col(text_key)) & (F.octet_length("text") == F.col(text_bytes)))
    pieces = F.split("text", ANY, -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(found)), private("found_subs"), lambda p, s: F.concat(p, s)), ""), F.element_at(pieces, -1))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    amount = lambda n: [n.cast("long").alias(count)] if count else []
    hit = hit.withColumn("text", text)
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return hit.select(*columns, *amount(F.size(found))).unionByName(plain.select(*columns, *amount(F.lit(0))))
