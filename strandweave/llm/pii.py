"""Personal data and secrets replaced by keyed surrogates, in built-in DataFrame functions only.

Entities are found by pattern and reduced to a canonical form (lower-cased address, bare digits, a phone's
digits after its country code, name without title).  The surrogate is made from a keyed hash of kind and
canonical form, so an entity is the same person everywhere, in whatever format it is written, and its digits
are poured back into each format.  A surrogate keeps kind, script, character classes, separators, country
code, first card digit and Luhn validity, and for names the title, the gender and the number of words.
Addresses fall into reserved space (``.example.``, class E).

A surname has one surrogate wherever it stands, alone or after given names.  A name met with titles of both
genders is two people; otherwise a title without gender takes the gender of the others.

Surrogates are checked over the whole corpus, in the form in which they are written: no two entities share
one and none equals a real entity; those that clash are drawn again until none do.

The patterns run over every text once.  Documents without an entity are passed on as they are; the others
meet their own replacements by the row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Workspace

#: Entities whose surrogates one task draws, about.
DRAWN_EACH = 2_000

# fixed values: titles by gender, given names by script and gender, syllables of surnames by script
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος"],
    "n": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    "latin": {"f": ["Alba", "Clara", "Edith", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Vera"], "m": ["Adam", "Bruno", "David", "Emil", "Hugo", "Ivan", "Karl", "Leon", "Marco", "Oscar", "Paul", "Viktor"], "n": ["Alex", "Andrea", "Chris", "Eden", "Jules", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael"]},
    "cyrillic": {"f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"], "m": ["Антон", "Борис", "Глеб", "Иван", "Кирилл", "Лев", "Олег", "Павел"], "n": ["Женя", "Саша", "Валя", "Слава", "Шура", "Вася", "Паша", "Тоня"]},
    "greek": {"f": ["Άννα", "Ελένη", "Ζωή", "Ιρις", "Μαρία", "Νίκη", "Ρέα", "Σοφία"], "m": ["Ανδρέας", "Γιώργος", "Ηλίας", "Κώστας", "Λουκάς", "Νίκος", "Πέτρος", "Φώτης"], "n": ["Αλεξ", "Κιμ", "Νοα", "Ρομι", "Σαμ", "Τονι", "Φοιβη", "Χρις"]},
}
SYLLABLES = {
    "latin": ["ba", "der", "fin", "gol", "han", "ker", "lin", "mor", "nes", "per", "ros", "stel", "tam", "ul", "ven", "wil"],
    "cyrillic": ["ба", "вер", "гор", "дан", "ел", "жар", "зим", "кол", "лин", "мар", "нов", "пет", "род", "сав", "тим", "яр"],
    "greek": ["αν", "βα", "γερ", "δα", "ερ", "ζα", "θεο", "κα", "λα", "μαρ", "νικ", "πα", "ρα", "σα", "τα", "φω"],
}

# fixed values: words before a secret, calling codes (no code begins with another), what is looked for, in order
# of preference where two could start at one place
_SECRET_WORD = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
_CODE = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_WORD = r"\p{Lu}[\p{L}'-]+"
PATTERNS = {
    "secret": rf"(?i:(?<![A-Za-z])(?:{_SECRET_WORD})\s{{0,3}}[=:]\s{{0,3}}[\"']?[A-Za-z0-9+/_.-]{{8,}}={{0,2}}[\"']?)|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,}})(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]*\d)",
    "card": r"(?<![\d.-])\d{4}(?: \d{4}){3}(?!\d)|(?<![\d.-])\d{4}(?:-\d{4}){3}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? (?:\p{{Lu}}\. ){{0,3}}{_WORD}(?:(?: \p{{Lu}}\.)? {_WORD}){{0,3}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has somewhere; a text without it is not searched further.
HINT = rf"[0-9@]|(?i:{_SECRET_WORD})\s{{0,3}}[=:]|AKIA|ghp_|sk-|(?:{_TITLE})\.? \p{{Lu}}"


def entities(text: Column) -> Column:
    """All entities of a text in order, as written."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


def _kind(raw: Column) -> Column:
    found = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        if name != "name":
            found = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


_SECRET_VALUE = rf"^(?i:(?:{_SECRET_WORD})\s*[=:]\s*[\"']?)?"


def _code(raw: Column) -> Column:
    """The calling code of a phone number in international form, however it is spaced; else empty."""
    return F.when(raw.startswith("+"), F.regexp_extract(F.regexp_replace(raw, r"\D", ""), f"^(?:{_CODE})", 0)).otherwise("")


def _bare(raw: Column, kind: Column) -> Column:
    """The canonical form, in which one entity is always written alike."""
    name = F.lower(F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", ""))
    secret = F.regexp_replace(F.regexp_replace(raw, _SECRET_VALUE, ""), r"[\"']$", "")
    digits = F.regexp_replace(raw, r"\D", "")
    digits = F.when(kind == "phone", F.substring(digits, F.length(_code(raw)) + 1, F.length(digits))).otherwise(digits)
    return F.when(kind == "name", name).when(kind == "secret", secret).when(kind == "email", F.lower(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(kind == "ip", raw).otherwise(digits)


def _gender(raw: Column) -> Column:
    def titled(g: str) -> Column:
        return raw.rlike(rf"^(?:{'|'.join(TITLES[g])})\.? ")

    return F.when(titled("f"), "f").when(titled("m"), "m").otherwise("n")


def _script(bare: Column) -> Column:
    return F.when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stream(seed: Column, length: Column) -> Column:
    """Two hexadecimal digits for each of ``length`` places."""
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(length, F.lit(1)) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, F.lit("|"), b.cast("string")), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _poured(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """The text with each letter and digit replaced by another of its class; other signs stay."""
    def one(i: Column) -> Column:
        c, b = F.substring(text, i + 1, F.lit(1)), _byte(stream, i)
        small = F.when(hexadecimal, F.substring(F.lit("abcdef"), b % 6 + 1, F.lit(1))).otherwise(F.char(b % 26 + 97))
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(text) - 1), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i)) % 10


def _pick(values: list[str], b: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), b % len(values) + 1)


def _syllables(seed: Column, script: str, count: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 4), 16, 10).cast("int"))), "")


def _by_script(bare: Column, of) -> Column:
    out = F.lit(None).cast("string")
    for script in GIVEN:
        out = F.when(_script(bare) == script, of(script)).otherwise(out)
    return out


def _given(script: str, seed: Column, bare: Column, gender: Column, attempt: Column) -> Column:
    """The words before a surname: a given name for each, of the gender; after a clash double names, ever longer,
    so that the supply never runs out.  Initials stay initials unless they clash."""
    words = F.split(bare, " ")

    def name(i: Column, k: Column) -> Column:
        b = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string"), k.cast("string")), 256), 1, 4), 16, 10).cast("int")
        out = F.lit(None).cast("string")
        for g, values in GIVEN[script].items():
            out = F.when(gender == g, _pick(values, b)).otherwise(out)
        return F.lower(out)

    def one(i: Column) -> Column:
        whole = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: name(i, k)), "-")
        return F.when((attempt == 0) & F.element_at(words, i).endswith("."), F.concat(F.substring(whole, 1, 1), F.lit("."))).otherwise(whole)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(words) - 1), one), " ")


def _surrogate(key: str) -> Column:
    """A surrogate in canonical form for columns kind, bare, gender, family (the surname's surrogate) and attempt."""
    kind, bare, attempt = F.col("kind"), F.col("bare"), F.col("attempt")
    seed = F.concat_ws("|", F.lit(key), kind, F.when(kind == "name", F.col("gender")), bare, attempt.cast("string"))
    stream = _stream(seed, F.length(bare) + 8)
    plain = _poured(bare, stream, bare.rlike("^[0-9a-f]+$"))
    local, domain = F.substring_index(bare, "@", 1), F.substring_index(bare, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(_poured(local, stream, F.lit(False)), F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 8), F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"))
    ip = F.concat_ws(".", (F.lit(240) + _byte(stream, F.lit(0)) % 15).cast("string"), *[_byte(stream, F.lit(i)).cast("string") for i in (1, 2, 3)])
    card = F.concat(F.substring(bare, 1, 1), F.substring(plain, F.lit(2), F.length(bare) - 1))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    card = F.when(_luhn(bare) == 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(card)
    ssn = F.concat(F.lit("9"), F.substring(plain, 2, 8))
    iban = F.concat(F.substring(bare, 1, 2), F.substring(plain, F.lit(3), F.length(bare) - 2))
    # a further syllable with each attempt: the supply of surnames never runs out
    family = _by_script(bare, lambda script: _syllables(seed, script, F.lit(3) + attempt))
    name = F.concat_ws(" ", _by_script(bare, lambda script: _given(script, seed, bare, F.col("gender"), attempt)), F.col("family"))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban).when(kind == "family", family).when(kind == "name", name).otherwise(plain)


def _written(raw: Column, kind: Column, new: Column) -> Column:
    """The canonical surrogate in the format of an occurrence."""
    signs = F.split(raw, "")
    code = F.when(kind == "phone", F.length(_code(raw))).otherwise(F.lit(0))
    spots = F.filter(F.transform(signs, lambda c, i: F.when(c.rlike(r"\d"), i)), lambda i: i.isNotNull())
    poured = F.array_join(F.transform(signs, lambda c, i: F.when(c.rlike(r"\d"), F.when(F.array_position(spots, i) <= code, c).otherwise(F.substring(new, (F.array_position(spots, i) - code).cast("int"), F.lit(1)))).otherwise(c)), "")
    title = F.regexp_extract(raw, rf"^(?:{_TITLE})\.? ", 0)
    capitals = F.array_join(F.transform(F.split(new, "-"), F.initcap), "-")
    shown = F.when(F.substring(raw, F.length(title) + 1, F.length(raw)).rlike(r"\p{Ll}"), capitals).otherwise(F.upper(new))
    lead = F.regexp_extract(raw, _SECRET_VALUE, 0)
    secret = F.concat(lead, new, F.when(raw.rlike("[\"']$"), F.substring(raw, -1, 1)).otherwise(""))
    spaced = F.array_join(F.transform(signs, lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, (i + 1 - F.size(F.filter(F.slice(signs, F.lit(1), i + 1), lambda x: x == " "))).cast("int"), F.lit(1)))), "")
    return F.when(kind == "name", F.concat(title, shown)).when(kind == "secret", secret).when(kind == "iban", spaced).when(kind.isin("email", "ip"), new).otherwise(poured)


def _settled(entities_: DataFrame, real: DataFrame, key: str, work: Workspace, tag: str, parts: int) -> DataFrame:
    """(kind, bare, gender, new) for the distinct rows (kind, bare, gender, family): surrogates of which no two are
    equal and none is in ``real`` (kind, new)."""
    who = ["kind", "bare", "gender"]
    open_, settled, turn = entities_.withColumn("attempt", F.lit(0)), None, 0
    while True:
        # few bytes of much work: a number of partitions of its own keeps it from being put into one task
        drawn = work.table(open_.repartition(parts, *who).withColumn("new", _surrogate(key)), f"{tag}-drawn-{turn}")
        order = F.row_number().over(Window.partitionBy("kind", "new").orderBy("bare", "gender"))
        fresh = drawn.join(real, ["kind", "new"], "left_anti")
        if settled is not None:
            fresh = fresh.join(settled.select("kind", "new"), ["kind", "new"], "left_anti")
        good = work.table(fresh.withColumn("i", order).where("i = 1").select(*who, "new"), f"{tag}-good-{turn}")
        settled = good if settled is None else settled.unionByName(good)
        open_ = work.table(drawn.join(good, who, "left_anti").select(*who, "family", (F.col("attempt") + 1).alias("attempt")), f"{tag}-open-{turn}")
        if open_.isEmpty():
            return settled
        turn += 1


def replacements(raw: DataFrame, key: str, work: Workspace) -> DataFrame:
    """(raw, new) for the distinct entities (raw): as written, and what to write instead."""
    raw = work.table(raw, "raw")
    parts = max(int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")), raw.count() // DRAWN_EACH)
    known = raw.repartition(parts, "raw").select("raw", _kind(F.col("raw")).alias("kind")).withColumn("bare", _bare(F.col("raw"), F.col("kind")))
    known = known.withColumn("said", F.when(F.col("kind") == "name", _gender(F.col("raw"))).otherwise("n"))
    known = work.table(known.withColumn("surname", F.when(F.col("kind") == "name", F.substring_index("bare", " ", -1))), "met-as")
    told = known.groupBy("kind", "bare").agg(F.max(F.when(F.col("said") == "f", 1)).alias("f"), F.max(F.when(F.col("said") == "m", 1)).alias("m"))
    one = F.when(F.col("f").isNull(), F.when(F.col("m").isNull(), "n").otherwise("m")).when(F.col("m").isNull(), "f").otherwise(F.col("said"))
    known = work.table(known.join(told, ["kind", "bare"]).select("raw", "kind", "bare", one.alias("gender"), "surname"), "known")
    real = known.select("kind", F.col("bare").alias("new")).unionByName(known.where("kind = 'name'").select(F.lit("family").alias("kind"), F.col("surname").alias("new"))).distinct()
    real = work.table(real, "real")
    none = F.lit(None).cast("string").alias("family")
    plain = known.where("kind <> 'name'").select("kind", "bare", "gender", none).unionByName(known.where("kind = 'name'").select(F.lit("family").alias("kind"), F.col("surname").alias("bare"), F.lit("n").alias("gender"), none))
    first = work.table(_settled(plain.distinct(), real, key, work, "plain", parts), "first")
    families = first.where("kind = 'family'").select(F.col("bare").alias("surname"), F.col("new").alias("family"))
    full = known.where("kind = 'name' and bare <> surname").select("kind", "bare", "gender", "surname").distinct().join(families, "surname").select("kind", "bare", "gender", "family")
    second = work.table(_settled(full, real, key, work, "full", parts), "second")
    alone = known.where("kind = 'name' and bare = surname").select("raw", "kind", "surname").join(families, "surname").select("raw", "kind", F.col("family").alias("new"))
    whole = known.select("raw", "kind", "bare", "gender").join(first.unionByName(second), ["kind", "bare", "gender"]).select("raw", "kind", "new").unionByName(alone)
    out = work.table(whole.repartition(parts, "raw").select("raw", _written(F.col("raw"), F.col("kind"), F.col("new")).alias("new")), "replacements")
    return out


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced in ``text_col``; ``key`` is the secret that fixes the surrogates.

    ``length_col``, if a column has that name, becomes the new text's length; ``count_col``, if given, holds
    the number of entities.  All other columns, ``id_col`` among them, stay.  Null and empty texts stay as they
    are.  Repeated rows and ids, null included, are rewritten each by itself, and alike where they are alike.  An
    empty table gives an empty result; an empty key is an error.
    """
    if not key:
        raise ValueError("surrogates need a key")
    work = Workspace(docs.sparkSession, "pii")
    columns = [c for c in docs.columns if c != count_col]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    names = [f"__sw_c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names)
    text = names[columns.index(text_col)]
    found = F.coalesce(entities(F.col(text)), F.array().cast("array<string>"))
    marked = work.table(plain.withColumn("__sw_found", found).withColumn("__sw_row", F.monotonically_increasing_id()), "marked")
    hit = marked.where(F.size("__sw_found") > 0)
    met = work.table(hit.select("__sw_row", F.posexplode("__sw_found").alias("at", "raw")), "met")
    table = replacements(met.select("raw").distinct(), key, work)
    work.keep("marked", "met", "replacements")
    per_row = met.join(table, "raw").groupBy("__sw_row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("__sw_new"))
    pieces = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("__sw_new.new"), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    changed = hit.join(per_row, "__sw_row")
    changed = changed.select(*[joined.alias(c) if c == text else F.col(c) for c in names], F.size("__sw_found").alias("__sw_n"))
    same = marked.where(F.size("__sw_found") == 0).select(*names, F.lit(0).alias("__sw_n"))
    out = same.unionByName(changed)
    if length_col in columns:
        n = names[columns.index(length_col)]
        out = out.withColumn(n, F.length(text).cast(plain.schema[n].dataType))
    return out.toDF(*columns, "__sw_n").withColumnRenamed("__sw_n", count_col) if count_col else out.select(*names).toDF(*columns)
