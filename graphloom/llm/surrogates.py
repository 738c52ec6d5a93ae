"""Personal data replaced by keyed surrogates of the same type.

Detection: e-mail addresses, bank account numbers, card numbers, social security numbers, telephone numbers, IP addresses,
and names after a form of address (which tells the gender) or a title (which does not). All patterns form one expression that is
applied once per text, and once more to texts with findings. Names carry through their document: where a given or family name
stands again as a word of its own in the same letter case, it is replaced alike.

An entity is a kind and a canonical form (letter case and punctuation taken away), so every way of writing it, in every
document, gets the same surrogate. A name is its given names, by gender, and its family name, each an entity of its own:
"Frau Anna Schmidt" and "Herr Schmidt" keep the family name in common. A surrogate is derived from a keyed hash of kind, canonical form and attempt:
digits stay digits, letters letters; card numbers keep their network digit and, where they had one, a valid check
digit; telephone numbers keep their country code; addresses keep their top-level domain under "example"; names come from
the same gender and script. The surface's punctuation and spacing are put back around it.

Collision checks: a surrogate that another entity of the kind has taken, or that is itself an entity found in the corpus, is refused
and its entity tries again with the next attempt, until every entity has its own. Only refused entities are tried again. From the
third attempt on names and addresses, and from the eighth on all others, grow by a character an attempt, so that the rounds end
even where all strings of a format are taken.

Everything is a DataFrame expression. Entities are distinct before they are shuffled, so one that a third of all documents
hold is one row per distinct text; documents meet their replacements by a hash of the text, which AQE may split.

Defined cases: null texts stay null, texts without findings stay as they are; repeated rows and copies are replaced alike; other columns
of the table are ignored; ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.storage import keep, texts

# Forms of address by gender, and titles of either.
MALE = r"Mr|Herrn?|Monsieur|Señor|Signor|[Гг]осподин|г-н"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señorita|Señora|Signora|[Гг]оспожа|г-жа"
TITLE = r"Dr|Prof"
_ADDRESS = rf"(?:(?:{MALE}|{FEMALE}|{TITLE})\.? )(?:(?:{TITLE})\.? )*"
_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L})(?!s(?!\p{L})))+"
_NAME = rf"{_WORD}(?: {_WORD}){{0,2}}"
# No alternative looks back further than a character or starts inside a word, so a text is read about once.
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        rf"(?=[A-ZГг])(?<![\p{{L}}\p{{N}}]){_ADDRESS}{_NAME}",
        r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?=[0-9])(?:"
        r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![\w+.-])[0-9]{3}([.-])[0-9]{3}\2[0-9]{4}(?![0-9-])",
        r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
        r")",
        r"(?=[+(])(?<![\w+])(?:"
        r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
        r")",
    )
)
NAME_KINDS = ("family", "given_m", "given_f", "given_n")
#: Attempts after which the space of a form counts as full: the surrogate grows by a character an attempt.
FULL = 8
# Names and syllables of surrogates.
GIVEN = {"given_m": "Aron Benno Carlo Dario Emil Fabian Gregor Hugo Ivo Jonas Kilian Lorenz Marius Nils Oskar Pavel".split(),
         "given_f": "Alma Bianca Clara Dora Elena Flora Greta Hanna Irma Judith Karla Lena Mira Nora Olga Paula".split(),
         "given_n": "Alexis Ariel Chris Conny Eike Gerrit Jules Kim Luca Marin Micha Robin Sascha Toni Uli Yael".split()}
CYRILLIC = {"given_m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(), "given_f": "Анна Вера Галина Дарья Елена Жанна Ирина Ксения".split(),
            "given_n": "Валя Женя Паша Саша Слава Тоня Шура Юля".split()}
SYLLABLES = "bar ben dal dor fal gar hal kel lan mar nor pel ran sel tar vel".split()
CYRILLIC_SYLLABLES = "бар вел гор дан зар кол лим мар нов пел рад сев тар фом хол шан".split()


def hits(text: Column) -> Column:
    """array<string> of a text's findings, in order; a name comes with its form of address."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _address(hit: Column) -> Column:
    """The form of address with its blank, "" if the finding is no name."""
    return F.regexp_extract(hit, f"^{_ADDRESS}", 0)


def _kind(hit: Column) -> Column:
    bare = F.regexp_replace(hit, "[ -]", "")
    return (
        F.when(F.contains(hit, F.lit("@")), "email").when(hit.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(bare.rlike("^[0-9]{16}$") & ~hit.startswith("+"), "card")
        .when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(hit.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").otherwise("phone")
    )


def _canonical(hit: Column, kind: Column) -> Column:
    return F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).when(hit.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(hit, "[^A-Za-z0-9]", ""))).otherwise(
        F.regexp_replace(hit, "[^A-Za-z0-9]", "")
    )


def entities(hit: Column) -> Column:
    """array<struct<kind, form>> of a finding: the parts of a name, else the finding itself."""
    address = _address(hit)
    gender = F.when(address.rlike(f"^(?:{MALE})[. ]"), "given_m").when(address.rlike(f"^(?:{FEMALE})[. ]"), "given_f").otherwise("given_n")
    words = F.split(F.substring(hit, F.length(address) + 1, F.length(hit)), " ")
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, "family").otherwise(gender).alias("kind"), w.alias("form")))
    kind = _kind(hit)
    return F.when(address != "", named).otherwise(F.array(F.struct(kind.alias("kind"), _canonical(hit, kind).alias("form"))))


def _digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits: 64 keyed bytes."""
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _byte(hexes: Column, i: Column) -> Column:
    return F.conv(F.substring(hexes, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(form: Column, hexes: Column, fixed: Column) -> Column:
    """The form with every digit and letter after the first ``fixed`` characters replaced by another of its class."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(hexes, i)
        return (
            F.when(i < fixed, c).when(c.rlike("^[0-9]$"), F.char(b % 10 + 48)).when(c.rlike("^[a-z]$"), F.char(b % 26 + 97))
            .when(c.rlike("^[A-Z]$"), F.char(b % 26 + 65)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, modulo 10."""
    weighted = F.transform(
        F.split(digits, ""),
        lambda c, i: F.when((F.length(digits) - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
    )
    return F.aggregate(weighted, F.lit(0), lambda s, x: s + x) % 10


def _pick(pool: list[str], b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), b % len(pool) + 1)


def surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity at an attempt, in canonical form."""
    hexes = _digest(key, kind, form, attempt.cast("string"))
    b = lambda i: _byte(hexes, F.lit(i))
    local, domain = F.split_part(form, F.lit("@"), F.lit(1)), F.split_part(form, F.lit("@"), F.lit(-1))
    host = _alike(F.split_part(domain, F.lit("."), F.lit(1)), _digest(key, F.lit("domain"), domain, attempt.cast("string")), F.lit(0))
    tail = F.when(attempt < 3, F.lit("")).otherwise(F.lower(F.left(F.translate(hexes, "0123456789", "ghijklmnop"), F.least(attempt, F.lit(64)))))
    email = F.concat(_alike(local, hexes, F.lit(0)), tail, F.lit("@"), host, F.lit(".example."), F.split_part(domain, F.lit("."), F.lit(-1)))
    drawn = _alike(form, hexes, F.lit(1))
    body = F.concat(F.left(drawn, F.length(form) - 1), F.lit("0"))
    card = F.when(_luhn(form) == 0, F.concat(F.left(drawn, F.length(form) - 1), ((10 - _luhn(body)) % 10).cast("string"))).otherwise(drawn)
    country = F.when(~form.startswith("+"), 0).when(form.rlike(r"^\+[17]"), 2).otherwise(3)
    ip = F.concat_ws(".", (b(0) % 223 + 1).cast("string"), b(1).cast("string"), b(2).cast("string"), (b(3) % 254 + 1).cast("string"))
    cyrillic = form.rlike(r"^\p{IsCyrillic}")
    name = lambda latin, other: F.when(cyrillic, F.concat(*[_pick(other, b(i)) for i in range(3)])).otherwise(F.concat(*[_pick(latin, b(i)) for i in range(3)]))
    given = lambda g: F.concat(F.when(cyrillic, _pick(CYRILLIC[g], b(0))).otherwise(_pick(GIVEN[g], b(0))), F.when(attempt == 0, F.lit("")).otherwise(F.concat(F.lit("-"), F.when(cyrillic, _pick(CYRILLIC[g], b(1))).otherwise(_pick(GIVEN[g], b(1))))), tail)
    more = F.when(attempt < FULL, F.lit("")).otherwise(F.left(F.translate(F.lower(hexes), "abcdef", "012345"), F.least(attempt - (FULL - 1), F.lit(64))))
    coded = (
        F.when(kind == "card", card).when(kind == "phone", _alike(form, hexes, country)).when(kind == "ip", ip)
        .when(kind == "iban", _alike(form, hexes, F.lit(2))).otherwise(_alike(form, hexes, F.lit(0)))
    )
    return (
        F.when(kind == "email", email).when(kind == "family", F.concat(F.initcap(name(SYLLABLES, CYRILLIC_SYLLABLES)), tail))
        .when(kind == "given_m", given("given_m")).when(kind == "given_f", given("given_f")).when(kind == "given_n", given("given_n"))
        .when((kind == "ip") & (more != ""), F.concat(coded, F.lit("."), more)).otherwise(F.concat(coded, more))
    )


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities (kind, form): distinct within a kind, and none that is an entity itself."""
    pending = keep(found.select("kind", "form", F.lit(0).alias("attempt")))
    real = pending.select("kind", F.col("form").alias("surrogate"))
    accepted = None
    while accepted is None or not pending.isEmpty():
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key))
        taken = real if accepted is None else real.union(accepted.select("kind", "surrogate"))
        free = tried.join(taken.distinct(), ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        won = keep(first.select("kind", "form", "surrogate"))
        accepted = won if accepted is None else accepted.union(won)
        pending = keep(pending.join(won, ["kind", "form"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
    return accepted


def _dressed(surface: Column, form: Column) -> Column:
    """The surrogate's letters and digits with the punctuation of the surface."""
    plain = F.regexp_replace(form, "[^A-Za-z0-9]", "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct(F.concat(s["out"], F.substring(plain, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))
    )
    # What a surrogate of a full space has more of than the surface goes last.
    return F.aggregate(F.split(surface, ""), start, step, lambda s: F.concat(s["out"], F.substring(plain, s["at"], F.length(plain))))


def _pieces(text: Column) -> Column:
    """A text cut before and after each of its words: array<string> whose concatenation is the text."""
    word = r"[\p{L}'’-]"
    return F.split(text, rf"(?<!{word})(?={word})|(?<={word})(?!{word})", -1)


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_entities (findings replaced, without carried names): a row per row of ``docs``."""
    docs = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = docs.select("key", F.explode(hits(F.col("text"))).alias("found")).distinct().select("key", F.explode(entities(F.col("found"))).alias("e"))
    found = keep(found.select("key", "e.kind", "e.form").distinct())
    named = assign(found.select("kind", "form").distinct(), key)
    entry = F.struct(F.concat_ws(":", "kind", "form").alias("key"), F.col("surrogate").alias("value"))
    by_text = keep(
        found.join(named, ["kind", "form"]).groupBy("key").agg(
            F.map_from_entries(F.collect_set(entry)).alias("names"), F.max(F.col("kind").isin(*NAME_KINDS)).alias("has_names"),
        )
    )

    def known(kind: Column | str, form: Column) -> Column:
        return F.try_element_at(F.col("names"), F.concat_ws(":", kind if isinstance(kind, Column) else F.lit(kind), form))

    def part(e: Column) -> Column:
        """A given name after a title takes the gender that the text states for it elsewhere."""
        own = known(e["kind"], e["form"])
        return F.when(e["kind"] != "given_n", own).otherwise(F.coalesce(known("given_f", e["form"]), known("given_m", e["form"]), own))

    def replaced(hit: Column) -> Column:
        own = entities(hit)
        kind = own[0]["kind"]
        whole = F.array_join(F.transform(own, part), " ")
        return F.when(kind.isin(*NAME_KINDS), F.concat(_address(hit), whole)).when(kind.isin("email", "ip"), whole).otherwise(_dressed(hit, whole))

    def carried(gap: Column) -> Column:
        """The text between findings, where the names of the document's findings stand alone."""

        def one(w: Column) -> Column:
            bare = F.regexp_replace(w, "['’]s$", "")
            return F.coalesce(F.concat(F.coalesce(*(known(kind, bare) for kind in ("family", "given_f", "given_m", "given_n"))), F.substring(w, F.length(bare) + 1, F.length(w))), w)

        return F.when(F.col("has_names"), F.array_join(F.transform(_pieces(gap), one), "")).otherwise(gap)

    # The names grow with the corpus: one merge join at every size. Texts with findings are cut once more; both arrays are columns
    # of their own, so each is made once a text.
    cut = docs.join(by_text.hint("merge"), "key", "left").select(
        "*", F.when(F.col("names").isNotNull(), F.split("text", PATTERN, -1)).alias("gaps"), F.when(F.col("names").isNotNull(), hits(F.col("text"))).alias("found"),
    )
    pieces = F.transform(
        F.arrays_zip(F.transform("gaps", carried).alias("gap"), F.transform("found", replaced).alias("hit")), lambda p: F.concat(p["gap"], F.coalesce(p["hit"], F.lit("")))
    )
    return cut.select(
        "doc_id", F.when(F.col("names").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"),
        F.when(F.col("names").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_entities"),
    )
