"""Surrogates for personal data, with built-in functions only.

Entities (e-mail and IP addresses, phone, card, account and social-security numbers,
secrets, names of persons) are found by patterns and replaced by surrogates of the
same kind.  A surrogate is drawn from a keyed hash of the entity's canonical form, so
an entity gets the same one everywhere, however it is written: numbers are laid
into the digits of each writing, names keep gender, script and case, addresses their
shape.  Surrogates of a kind are checked against each other and against all
entities of the corpus; where two meet, all but one draw again, so different entities
stay different and no surrogate is somebody else's value.  Card numbers and IBANs
keep valid check digits.  A name found beside a title is replaced wherever the document
holds it as a word, in any case; hyphened names are names each, and a possessive ending
stays.

Patterns repeat single characters or a bounded number of groups only, as Java's matcher
needs stack for each turn of a group: no text is too long for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.shared import discard, stash, table

KEY = "veilmark-demo-key"

#: Titles by gender (fixed values).
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа", "Госпожа"]
MALE_TITLES = ["Mr", "Herr", "Señor", "Monsieur", "Г-н", "Господин"]
#: Syllables that surrogate names are made of (fixed values).
LATIN = ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "te", "va", "vi"]
CYRILLIC = ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "зо", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "ра", "ре", "ро", "са", "се", "та"]

_TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES, key=len, reverse=True))
#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,127}\p{L}{2,}"),
    ("secret", r"(?<![\p{L}\p{N}])(?=\d*+[a-fA-F])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"),
    ("ipv4", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d\d?)(?!\d|\.\d)"),
    ("phone", r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?\(\d{1,4}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?!\d|\.\d)|(?<![\p{L}\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]|\.\d)"),
    ("ssn", r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("iban", r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"),
    ("card", r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?!\d)"),
    ("person", rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: (?!(?:{_TITLES})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'-]+)?"),
]
ENTITY = "|".join(f"(?:{p})" for k, p in PATTERNS if k != "card") + r"|(?<!\d)(?:\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{13,19})(?!\d)"
#: A text without these holds no entity; cheap to test.
HINT = rf"[\d@]|[0-9a-fA-F]{{32}}|(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}"
#: Put around matches; a text that holds it is taken apart in two passes.
FENCE = "\uf8ff"
KEY_SETTING = "spark.veilmark.surrogateKey"
NUMBERS = ["phone", "ssn", "card"]


def _kind(match: Column) -> Column:
    out = F.lit("card")
    for kind, pattern in reversed(PATTERNS[:-1]):
        out = F.when(match.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return F.when(match.rlike(PATTERNS[-1][1]), "person").otherwise(out)


def _byte(digest: Column, i) -> Column:
    """The i-th byte (from 0, cyclic) of a hex digest of 64 bytes, as a number."""
    return F.conv(F.substr(digest, (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _word(syllables: list[str], digest: Column, start: int, count: Column) -> Column:
    names = F.array(*[F.lit(s) for s in syllables])
    return F.array_join(
        F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.get(names, _byte(digest, k + start) % len(syllables))), ""
    )


def _redraw(text: Column, digest: Column) -> Column:
    """Each letter a-z and digit replaced by one of its class, the rest kept."""
    letters = F.array(*[F.lit(chr(97 + k)) for k in range(26)])
    cyrillic = F.array(*[F.lit(chr(0x430 + k)) for k in range(32)])
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch, i: F.when(ch.rlike(r"\d"), (_byte(digest, i) % 10).cast("string"))
            .when(ch.rlike(r"\p{IsCyrillic}"), F.get(cyrillic, _byte(digest, i) % 32))
            .when(ch.rlike(r"\p{L}"), F.get(letters, _byte(digest, i) % 26)).otherwise(ch),
        ),
        "",
    )


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` and it pass the Luhn test."""
    def add(acc: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int") * (2 - k % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def iban_digits(country: Column, account: Column) -> Column:
    """The two check digits of an account number in capitals and digits (modulo 97)."""
    def add(acc: Column, ch: Column) -> Column:
        v = F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.lpad((98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), add)).cast("string"), 2, "0")


def surrogate(kind: Column, canon: Column, attempt: Column, digest: Column, site: Column, digits: Column) -> Column:
    """The canonical form of the surrogate that an attempt draws; see :func:`draw`."""
    head = F.substr(digits, F.lit(1), F.length(digits) - 1)
    digits = F.when(kind == "card", F.concat(head, luhn_digit(head))).otherwise(digits)
    hexes = F.substr(F.repeat(digest, F.ceil(F.length(canon) / 128).cast("int")), F.lit(1), F.length(canon))
    ip = F.concat_ws(".", _byte(digest, 0) % 223 + 1, _byte(digest, 1), _byte(digest, 2), _byte(digest, 3))
    at = F.substring_index(canon, "@", 1)
    extra = F.when(attempt > 3, attempt.cast("string")).otherwise("")
    email = F.concat(
        _redraw(at, digest), extra, F.lit("@"),
        _redraw(F.regexp_extract(canon, r"@(.*)\.", 1), site), F.lit("."), F.regexp_extract(canon, r"\.([^.]*)$", 1),
    )
    cyr = kind.endswith("cyrillic")
    size = F.lit(2) + _byte(digest, 40) % 2 + attempt
    stem = F.when(cyr, _word(CYRILLIC, digest, 0, size)).otherwise(_word(LATIN, digest, 0, size))
    female = kind.contains("female")
    ending = (
        F.when(kind.startswith("surname"), F.when(cyr & female, "рова").when(cyr, "ров").otherwise("ner"))
        .when(cyr & female, "на").when(cyr, "н").when(female, "na").otherwise("n")
    )
    country, account = F.substring(canon, 1, 2), F.upper(_redraw(F.lower(F.substr(canon, F.lit(5))), digest))
    iban = F.concat(country, iban_digits(country, account), account)
    return (
        F.when(kind.isin(*NUMBERS), digits).when(kind == "secret", hexes).when(kind == "ipv4", ip)
        .when(kind == "email", email).when(kind == "iban", iban).otherwise(F.concat(stem, ending))
    )


def draw(state: DataFrame, key: str) -> DataFrame:
    """``state`` (kind, canon, attempt, ...) with ``drawn``, the form that the attempt draws.

    Digests and digits are columns of a projection below, computed once for a row; within
    the lambdas that read them they would be computed again for each character.
    """
    site = F.concat_ws("\x1f", F.lit(key), F.col("attempt"), F.regexp_extract("canon", "@(.*)$", 1))
    own = F.concat_ws("\x1f", F.lit(key), F.col("kind"), F.col("attempt"), F.col("canon"))
    hashed = state.withColumns({"digest": F.sha2(own, 512), "site": F.sha2(site, 512)})
    digit = lambda ch, i: (_byte(F.col("digest"), i) % 10).cast("string")
    hashed = hashed.withColumn("digits", F.array_join(F.transform(F.split("canon", ""), digit), ""))
    form = surrogate(*[F.col(c) for c in ("kind", "canon", "attempt", "digest", "site", "digits")])
    return hashed.withColumn("drawn", form).drop("digest", "site", "digits")


def _lay(form: Column, surface: Column, kind: Column) -> Column:
    """A surrogate's canonical form in the writing of ``surface``."""
    laid = F.aggregate(
        F.split(surface, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, ch: F.struct(
            F.concat(acc["out"], F.when(ch.rlike(r"[0-9A-Za-z]"), F.substr(form, acc["at"], F.lit(1))).otherwise(ch)).alias("out"),
            (acc["at"] + F.when(ch.rlike(r"[0-9A-Za-z]"), 1).otherwise(0)).alias("at"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(kind.isin(*NUMBERS, "iban"), laid).otherwise(_cased(form, surface))


def _cased(form: Column, surface: Column) -> Column:
    """``form`` in capitals, with one, or as it is, like ``surface``."""
    return (
        F.when((surface == F.upper(surface)) & (surface != F.lower(surface)), F.upper(form))
        .when(F.substring(surface, 1, 1) != F.lower(F.substring(surface, 1, 1)), F.concat(F.upper(F.substring(form, 1, 1)), F.substr(form, F.lit(2))))
        .otherwise(form)
    )


def _parts(match: Column) -> Column:
    """An entity as parts (surface, kind, canon); kind null: kept as it is."""
    kind = _kind(match)
    part = "struct<surface:string,kind:string,canon:string>"

    def one(surface: Column, k: Column, canon: Column) -> Column:
        return F.struct(surface.alias("surface"), k.cast("string").alias("kind"), canon.cast("string").alias("canon")).cast(part)

    canon = (
        F.when(kind.isin(*NUMBERS), F.regexp_replace(match, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(F.lower(match))
    )
    words = F.split(match, " ")
    title = F.regexp_replace(F.get(words, 0), r"\.$", "")
    gender = F.when(title.isin(*FEMALE_TITLES), "female").otherwise("male")
    last = F.element_at(words, -1)
    script = F.when(last.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    # In Cyrillic a surname has a form for each gender; elsewhere it is shared.
    surname_kind = F.when(script == "cyrillic", F.concat_ws("-", F.lit("surname"), gender, script)).otherwise("surname-latin")
    given = F.concat_ws("-", F.lit("given"), gender, script)

    def named(word: Column, k: Column) -> Column:
        """The names in a word between hyphens and apostrophes; single letters aren't names."""
        pieces = F.regexp_extract_all(word, F.lit(r"['’]s?$|[-'’]|[^-'’]+"), F.lit(0))
        return F.transform(pieces, lambda p: F.when(p.rlike(r"^['’-]") | (F.length(p) < 2), one(p, F.lit(None), F.lit(None))).otherwise(one(p, k, F.lower(p))))

    head = one(F.concat(F.get(words, 0), F.lit(" ")), F.lit(None), F.lit(None))
    gap = one(F.lit(" "), F.lit(None), F.lit(None))
    person = F.when(
        F.size(words) > 2, F.concat(F.array(head), named(F.get(words, 1), given), F.array(gap), named(last, surname_kind))
    ).otherwise(F.concat(F.array(head), named(last, surname_kind)))
    return F.when(kind == "person", person).otherwise(F.array(one(match, kind, canon)))


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, form) for distinct (kind, canon), all forms of a kind distinct.

    Rounds of: find forms that occur twice or are an entity themselves; all but
    the first of each draw again.  Rounds end when nothing meets; each is a table.
    """
    # Entities are few bytes but dear to draw, so they are dealt over as many tasks as a shuffle has;
    # left to their size, one task would draw them all.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = entities.repartition(tasks).withColumn("attempt", F.lit(0))
    state = stash(draw(first, key).withColumnRenamed("drawn", "form"), "surrogates")
    while True:
        # The smallest entity keeps a form: one minimum per form, no sorting of groups.
        first = state.groupBy("kind", "form").agg(F.min("canon").alias("owner"))
        taken = state.select("kind", F.col("canon").alias("form"), F.lit(True).alias("real"))
        checked = state.join(first, ["kind", "form"]).join(taken, ["kind", "form"], "left")
        clash = F.coalesce("real", F.lit(False)) | (F.col("owner") != F.col("canon"))
        marked = checked.select("kind", "canon", "attempt", "form", clash.alias("clash"))
        if marked.where("clash").isEmpty():
            return state.select("kind", "canon", "form")
        again = draw(marked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int")), key)
        form = F.when(F.col("clash"), F.col("drawn")).otherwise(F.col("form"))
        then = stash(again.select("kind", "canon", "attempt", form.alias("form")), "surrogates")
        discard(state)
        state = then


def _pieces(text: Column) -> Column:
    """The text as an array: what is between matches and the matches, in turn."""
    gaps, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    slow = F.flatten(F.zip_with(gaps, found, lambda gap, m: F.when(m.isNull(), F.array(gap)).otherwise(F.array(gap, m))))
    fenced = F.split(F.regexp_replace(text, ENTITY, f"{FENCE}$0{FENCE}"), FENCE, -1)
    return F.when(~F.coalesce(text.rlike(HINT), F.lit(False)), F.array(text)).when(text.contains(FENCE), slow).otherwise(fenced)


def _free(columns: list[str], name: str) -> str:
    """A name like ``name`` that is none of ``columns``, however their case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def replace_personal_data(docs: DataFrame, key: str = KEY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, all other columns kept.

    Texts without entities (null and empty ones among them) are unchanged and take
    no part in a shuffle.  Rows may repeat in part or whole and have any other columns,
    whatever their names; ``doc_id`` isn't read.  Texts are searched once, in the table
    that this writes.
    """
    columns = docs.columns
    row, held, new_ = _free(columns, "entity_row"), _free(columns, "entity_pieces"), _free(columns, "entity_new")
    named_ = _free(columns, "entity_names")
    others = [F.col(f"`{c}`") for c in columns if c != text]
    base = stash(docs.select(*others, F.monotonically_increasing_id().alias(row), _pieces(F.col(f"`{text}`")).alias(held)), "pieces")
    some = base.where(F.size(held) > 1)
    odd = F.filter(F.transform(held, lambda m, k: F.when(k % 2 == 1, m)), lambda m: m.isNotNull())
    parts = stash(
        some.select(F.col(row).alias("row"), F.posexplode(odd).alias("i", "m"))
        .select("row", "i", F.posexplode(_parts(F.col("m"))).alias("at", "p")).select("row", "i", "at", "p.*"),
        "entities",
    )
    forms = draw_surrogates(parts.where("kind is not null").select("kind", "canon").distinct(), key)
    laid = F.when(F.col("form").isNull(), F.col("surface")).otherwise(_lay(F.col("form"), F.col("surface"), F.col("kind")))
    new = parts.join(forms, ["kind", "canon"], "left").withColumn("new", laid)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), "").alias(c)
    is_name = F.col("kind").rlike("^(given|surname)")
    name = F.collect_set(F.when(is_name, F.struct(F.col("canon").alias("surface"), F.col("form").alias("new")))).alias("names")
    by_match = new.groupBy("row", "i").agg(joined("new"), name)
    by_row = by_match.groupBy(F.col("row").alias(row)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias(new_),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias(named_),
    )
    # Of a name with two surrogates (given and family name) the first one counts.
    first = F.aggregate(named_, F.create_map().cast("map<string,string>"), lambda acc, x: F.when(F.map_contains_key(acc, x["surface"]), acc).otherwise(F.map_concat(acc, F.create_map(x["surface"], x["new"]))))
    word_edge = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"
    names = _free(columns, "entity_map")

    def plain(gap: Column) -> Column:
        found = lambda w: F.transform(F.array(F.try_element_at(F.col(names), F.lower(w))), lambda f: F.coalesce(_cased(f, w), w))
        words = F.transform(F.split(gap, word_edge), lambda w: F.element_at(found(w), 1))
        return F.when(F.size(named_) == 0, gap).otherwise(F.array_join(words, ""))

    even = F.filter(F.transform(held, lambda m, k: F.when(k % 2 == 0, m)), lambda m: m.isNotNull())
    filled = F.array_join(F.zip_with(even, new_, lambda gap, n: F.concat(plain(gap), F.coalesce(n, F.lit("")))), "")
    # The map is made below the join; above it, it would move into the lambda and be made for each word.
    done = some.join(by_row.withColumn(names, first), row).select(*[filled.alias(text) if c == text else F.col(f"`{c}`") for c in columns])
    clean = base.where(f"size({held}) <= 1")
    return clean.select(*[F.get(held, 0).alias(text) if c == text else F.col(f"`{c}`") for c in columns]).union(done)


def surrogate_key(spark: SparkSession) -> str:
    """The session's key of surrogates, else the demonstration key."""
    return spark.conf.get(KEY_SETTING, KEY)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"), surrogate_key(spark))
