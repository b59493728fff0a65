"""Surrogates for personal data, with DataFrame functions only.

One pattern finds all entities of a text. An entity's norm - digits of a number, lower
case of an address, the words of a name - is what makes two mentions one entity. Every
distinct norm gets a surrogate from a keyed hash: the same kind, length, script, gender
and format. Surrogates are checked against each other and against the real norms: all but
the first of those that collide draw anew, until none do. So distinct entities stay
distinct, and all mentions of one, in whatever document and spelling, get the same
surrogate.

A name is found by its title. Each of its words is an entity of its own, whatever title or
place it has elsewhere, so `Ms Anna Smith`, `Dr Anna Smith` and `Ms Anna` agree; a word's
gender is that of the titles before it in all documents. Other mentions of the words in
the same document, without a title, are replaced too, if they begin with a capital.
Recognised forms: names after the titles below, with initials, particles, hyphens and
apostrophes; phone numbers as 3-3-4 digits or with + and a country code; cards as 13 to 19
digits in one run or in groups of 4-4-4-4(-1..3), 4-6-4 and 4-6-5; IPv4; 3-2-4 digits; mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_source, materialize

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|г-н"
_NEUTRAL = "Dr|Prof"
#: Titles in capitals count as well.
_FEMALE, _MALE, _NEUTRAL = (f"{x}|{x.upper()}" for x in (_FEMALE, _MALE, _NEUTRAL))
_TITLE = rf"(?<!\p{{L}})(?:{_FEMALE}|{_MALE}|{_NEUTRAL})\.?\x20"
_WORD = r"(?:\p{L}['’])?\p{Lu}\p{L}+(?:-\p{L}+)*"
_PARTICLES = r"(?:(?:van|von|zu|de|der|den|del|della|da|di|du|la|le|el|al|bin|ibn|y)\x20){0,3}"
_NAME = rf"{_TITLE}{_PARTICLES}{_WORD}(?:\x20(?:\p{{Lu}}\.\x20)?{_PARTICLES}{_WORD}){{0,2}}"
#: Kinds with their patterns, tried in this order.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[\x20-]\d{4}){3}(?:[\x20-]\d{1,3})?|\d{4}[\x20-]\d{6}[\x20-]\d{4,5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)\x20?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?!\w)",
    "abroad": r"(?<![\w+])\+\d(?:[\x20.-]?\(?\d\)?){7,14}(?!\w)",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "name": _NAME,
}
PATTERN = "|".join(KINDS.values())
#: What every entity has in it; texts without it need not meet the pattern.
HINT = rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|{_TITLE}"
#: Kinds of the words of names; their surrogates are told apart from each other across kinds.
NAMES = ("given-f", "given-m", "given-n", "family")

#: Syllables of made-up names, by script.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vi za zo",
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве ви за зо",
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το φα φε φι ζα ζο",
}
#: Endings of given names by script: female, male, neither.
ENDINGS = {"latin": ("na", "rus", "l"), "cyrillic": ("на", "рус", "л"), "greek": ("να", "ρος", "λ")}


def kind_of(entity: Column) -> Column:
    out = F.when(entity.rlike(f"^(?:{KINDS['email']})$"), "email")
    for kind in ("card", "ssn", "phone", "abroad", "ip"):
        out = out.when(entity.rlike(f"^(?:{KINDS[kind]})$"), kind)
    return out.otherwise("name")


def norm_of(kind: Column, part: Column) -> Column:
    digits = F.regexp_replace(part, r"\D", "")
    return F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn", "abroad"), digits).when(kind == "ip", part).otherwise(F.lower(part))


def _words(entity: Column) -> Column:
    """The words of a name that get surrogates: runs of two letters or more that begin with a capital."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(entity, rf"^{_TITLE}", ""), F.lit(r"\p{L}+"), F.lit(0)), _is_word)


def _is_word(run: Column) -> Column:
    return run.rlike(r"^\p{Lu}\p{L}")


def parts_of(entity: Column) -> Column:
    """The parts of an entity that get surrogates: (kind, norm, vote) structs.

    A part of a name has the kind `name`; vote is f, m or n if the word comes first of
    several after a title of that gender, otherwise null.
    """
    kind = kind_of(entity)
    words = _words(entity)
    sex = F.when(entity.rlike(rf"^(?:{_FEMALE})\.?\x20"), "f").when(entity.rlike(rf"^(?:{_MALE})\.?\x20"), "m").otherwise("n")
    names = F.transform(words, lambda w, i: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("norm"), F.when((i == 0) & (F.size(words) > 1), sex).alias("vote")))
    return F.when(kind != "name", F.array(F.struct(kind.alias("kind"), norm_of(kind, entity).alias("norm"), F.lit(None).cast("string").alias("vote")))).otherwise(names)


def _with_gender(norms: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of parts, with the kind of a name's word by all its votes."""
    has = lambda v: F.coalesce(F.bool_or(F.col("vote") == v), F.lit(False))
    each = norms.groupBy("kind", "norm").agg(has("f").alias("f"), has("m").alias("m"), has("n").alias("n"))
    given = F.when(F.col("f") & ~F.col("m"), "given-f").when(F.col("m") & ~F.col("f"), "given-m").when(F.col("m") | F.col("n"), "given-n").otherwise("family")
    return each.select(F.when(F.col("kind") == "name", given).otherwise(F.col("kind")).alias("kind"), "norm")


def _number(hexes: Column, at, below: int) -> Column:
    """A number below `below` from four hex digits of the hash; places wrap round."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.pmod(F.conv(F.substr(hexes, F.pmod(at, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(at / 16).cast("int") * 31, F.lit(below))


def _digits(hexes: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _number(hexes, i, 10).cast("string")), "")


def _luhn(digits: Column) -> Column:
    """The sum of the Luhn check, the last digit not doubled."""
    chars = F.reverse(F.split(digits, ""))
    return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.get(chars, i).cast("int")).otherwise(F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.get(chars, i).cast("int"))))


def _script(norm: Column) -> Column:
    return F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _syllable(table: Column, hexes: Column):
    return lambda i: F.get(table, _number(hexes, i, 32))


def _made_name(hexes: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    out = None
    for script, syllables in SYLLABLES.items():
        table = F.split(F.lit(syllables), " ")
        places = F.sequence(F.lit(0), F.least(F.lit(14), attempt + F.when(kind == "family", 3).otherwise(2)))
        stem = F.array_join(F.transform(places, _syllable(table, hexes)), "")
        f, m, n = ENDINGS[script]
        name = F.concat(stem, F.when(kind == "given-f", f).when(kind == "given-m", m).when(kind == "given-n", n).otherwise(""))
        out = F.when(_script(norm) == script, name) if out is None else out.when(_script(norm) == script, name)
    return out


def _made_email(hexes: Column, norm: Column, attempt: Column) -> Column:
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def masked(text: Column, shift: int) -> Column:
        chars = F.split(text, "")
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[a-z]"), F.substr(letters, _number(hexes, i + shift, 26) + 1, F.lit(1))).when(c.rlike("[0-9]"), _number(hexes, i + shift, 10).cast("string")).otherwise(c)), "")

    labels = F.split(domain, r"\.")
    host = F.when(F.size(labels) > 2, F.concat(masked(F.array_join(F.slice(labels, 1, F.size(labels) - 2), "."), 5), F.lit("."))).otherwise("")
    # the shape of an address bounds its surrogates; a label that grows with the attempts doesn't
    label = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(15), attempt + 2)), lambda i: F.substr(letters, _number(hexes, i, 26) + 1, F.lit(1))), "")
    return F.concat(masked(local, 0), F.lit("@"), host, F.when(attempt > 0, F.concat(label, F.lit("."))).otherwise(""), F.lit("example."), F.element_at(labels, -1))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    hexes = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 256)
    n = F.length(norm)
    body = F.concat(F.left(norm, F.lit(1)), F.substr(_digits(hexes, n), F.lit(2), n - 2))
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.concat(body, F.when(_luhn(norm) % 10 == 0, check).otherwise(_number(hexes, 15, 10).cast("string")))
    phone = F.concat((_number(hexes, 0, 8) + 2).cast("string"), F.substr(_digits(hexes, F.lit(10)), F.lit(2), F.lit(2)), F.when((F.substr(norm, F.lit(4), F.lit(3)) == "555") & (attempt < 8), "555").otherwise(F.concat((_number(hexes, 3, 8) + 2).cast("string"), F.substr(_digits(hexes, F.lit(10)), F.lit(5), F.lit(2)))), F.substr(_digits(hexes, F.lit(12)), F.lit(9), F.lit(4)))
    abroad = F.concat(F.left(norm, F.lit(2)), F.substr(_digits(hexes, n), F.lit(3), n - 2))
    ip = F.concat_ws(".", (_number(hexes, 0, 116) + 11).cast("string"), _number(hexes, 1, 256).cast("string"), _number(hexes, 2, 256).cast("string"), (_number(hexes, 3, 254) + 1).cast("string"))
    return F.when(kind == "email", _made_email(hexes, norm, attempt)).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", _digits(hexes, n)).when(kind == "abroad", abroad).when(kind == "ip", ip).otherwise(_made_name(hexes, kind, norm, attempt))


def _group(kind: Column) -> Column:
    return F.when(kind.isin(*NAMES), "name").otherwise(kind)


def surrogates(norms: DataFrame, key: str, most_rounds: int = 100) -> DataFrame:
    """kind, norm, surrogate for each distinct (kind, norm); no two of a kind are alike, nor two of names.

    A surrogate that another norm has, or that is itself a norm of the kind, is drawn
    again; of several norms the least keeps it. Names and addresses grow with the attempts
    and so never run out; numbers have their fixed space (10^9 for nine digits), and if
    more norms than that leave no room, it is an error.
    """
    kept = materialize(norms.select("kind", "norm", F.lit(0).alias("attempt")).withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "surrogates")
    for _ in range(most_rounds):
        drawn = kept.groupBy(_group(F.col("kind")).alias("k"), F.col("surrogate").alias("v")).agg(F.count("*").alias("n"), F.min("norm").alias("keeper"))
        real = kept.select(_group(F.col("kind")).alias("rk"), F.col("norm").alias("rv")).distinct()
        clash = drawn.join(real, (F.col("k") == F.col("rk")) & (F.col("v") == F.col("rv")), "left").select("k", "v", "n", "keeper", F.col("rv").isNotNull().alias("real")).where("n > 1 or real")
        joined = kept.join(clash, (_group(kept["kind"]) == F.col("k")) & (kept["surrogate"] == F.col("v")), "left")
        again = F.coalesce(F.col("real") | (F.col("keeper") != F.col("norm")), F.lit(False))
        attempt = F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt"))
        after = materialize(joined.select("kind", "norm", attempt.alias("attempt"), again.alias("again"), "surrogate").withColumn("surrogate", F.when(F.col("again"), surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)).otherwise(F.col("surrogate"))), "surrogates")
        drop_source(kept)
        kept = after
        if not after.where("again").limit(1).count():
            return kept.select("kind", "norm", "surrogate")
    raise RuntimeError(f"surrogates still collide after {most_rounds} rounds")


def _cased(word: Column, made: Column) -> Column:
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(made)).otherwise(F.initcap(made))


def _woven(gaps: Column, between: Column) -> Column:
    """A text put together from the gaps of a split and what comes between them."""
    return F.array_join(F.flatten(F.zip_with(gaps, between, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def written(entity: Column, made: Column) -> Column:
    """The surrogates of an entity's parts, an array in their order, in the entity's format."""
    last = F.element_at(made, -1)
    kind = kind_of(entity)
    # digits are filled in from the right; what is left of a longer number stays
    back = F.split(F.reverse(entity), "")
    fill = F.aggregate(back, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), lambda s, c: F.struct(F.concat(F.when(c.rlike("[0-9]") & (s["i"] < F.length(last)), F.substr(last, F.length(last) - s["i"], F.lit(1))).otherwise(c), s["out"]).alias("out"), (s["i"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("i")), lambda s: s["out"])
    title = F.regexp_extract(entity, rf"^{_TITLE}", 0)
    rest = F.regexp_replace(entity, rf"^{_TITLE}", "")
    runs = F.regexp_extract_all(rest, F.lit(r"\p{L}+"), F.lit(0))
    # the number of words up to each run says which surrogate it gets
    named = F.transform(runs, lambda w, i: F.when(_is_word(w), _cased(w, F.get(made, F.size(F.filter(F.slice(runs, F.lit(1), i + 1), _is_word)) - 1))).otherwise(w))
    name = F.concat(title, _woven(F.split(rest, r"\p{L}+", -1), named))
    mail = F.when(entity == F.upper(entity), F.upper(last)).otherwise(last)
    return F.when(kind == "email", mail).when(kind == "ip", last).when(kind == "name", name).otherwise(fill)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with the entities of `text` replaced, and n_entities, their number.

    All rows and columns stay (a column n_entities of docs is replaced); null and empty
    texts stay as they are, with no entities. Rows that are alike in doc_id and text are
    alike in the result. Only rows that may have an entity, by a plain hint, meet the
    pattern and are shuffled; those that have one meet it once more to be put together.
    Other columns may have any name.
    """
    docs = docs.drop("n_entities")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = docs.where(~hinted).withColumn("n_entities", F.lit(0))
    some = docs.where(hinted)
    mentions = materialize(some.select("doc_id", F.xxhash64("text").alias("t"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0), "mentions")
    parts = mentions.select("doc_id", "t", F.posexplode("found").alias("at", "entity")).select("doc_id", "t", "at", "entity", F.posexplode(parts_of(F.col("entity"))).alias("part", "p")).select("doc_id", "t", "at", "entity", "part", "p.kind", "p.norm", "p.vote")
    parts = materialize(parts, "parts")
    made = surrogates(_with_gender(parts), key).select(_group(F.col("kind")).alias("k"), F.col("norm").alias("m"), "surrogate")
    named = parts.join(made, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("m")))
    whole = named.groupBy("doc_id", "t", "at").agg(F.min("entity").alias("entity"), F.transform(F.array_sort(F.collect_set(F.struct("part", "surrogate", "norm", "kind"))), lambda x: F.struct(x["surrogate"].alias("surrogate"), x["norm"].alias("norm"), x["kind"].alias("kind"))).alias("made"))
    people = F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter("made", lambda x: x["kind"] == "name"), lambda x: F.struct(x["norm"], x["surrogate"]))))))
    new = written(F.col("entity"), F.transform("made", lambda x: x["surrogate"]))
    lists = whole.withColumn("new", new).groupBy("doc_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"), people.alias("people"))
    lists = lists.select(F.col("doc_id").alias("own_id"), F.col("t").alias("own_t"), "news", "people")
    # the row travels as one struct, so that none of its columns can clash with those of the lists
    rows = some.select(F.struct("*").alias("row"), F.xxhash64("text").alias("t"))
    joined = rows.join(lists, F.col("row.doc_id").eqNullSafe(F.col("own_id")) & (F.col("t") == F.col("own_t")), "left")
    # other mentions of the document's people: their words with a capital, or in capitals
    words = F.map_keys("people")
    again = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.flatten(F.transform(words, lambda w: F.array(F.initcap(w), F.upper(w)))), "|"), F.lit(r")(?!\p{L})"))
    seen = lambda gap: F.regexp_extract_all(gap, again, F.lit(0))
    fill = lambda gap: _woven(F.split(gap, again, -1), F.transform(seen(gap), lambda w: _cased(w, F.element_at("people", F.lower(w)))))
    gaps = F.split(F.col("row.text"), PATTERN, -1)
    known = F.size(words) > 0
    text = F.when(F.col("news").isNull(), F.col("row.text")).otherwise(_woven(F.when(known, F.transform(gaps, fill)).otherwise(gaps), F.col("news")))
    more = F.when(known, F.aggregate(F.transform(gaps, lambda g: F.size(seen(g))), F.lit(0), lambda a, b: a + b)).otherwise(0)
    n = F.when(F.col("news").isNull(), 0).otherwise(F.size("news") + more)
    replaced = joined.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns), n.alias("n_entities"))
    return plain.unionAll(replaced.select(*plain.columns))
